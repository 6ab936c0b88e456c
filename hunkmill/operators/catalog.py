"""Listing, filtering, paging and joining of stored results: splits, reviews, pull requests, repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S


def active(rows: DataFrame) -> DataFrame:
    """Rows whose state is not deleted; null counts as active."""
    return rows.filter(~F.col("state").eqNullSafe("deleted"))


def unarchived(rows: DataFrame, include_archived: bool = False) -> DataFrame:
    return rows if include_archived else rows.filter(~F.col("status").eqNullSafe("archived"))


def search(rows: DataFrame, query: str, texts: tuple[str, ...] = ("title", "author"), number: str = "number") -> DataFrame:
    """Rows with the query in a text, whatever the case, or in the number's digits."""
    found = F.contains(F.col(number).cast("string"), F.lit(query))
    for c in texts:
        found = found | F.contains(F.lower(c), F.lit(query.lower()))
    return rows.filter(found)


def page(rows: DataFrame, order: list[Column], skip: int = 0, limit: int = 20) -> DataFrame:
    """A page of rows in order and, on each, whether more follow: one row over the limit is read to know."""
    taken = rows.orderBy(*order).offset(skip).limit(limit + 1)
    nth = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    more = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > limit
    return taken.withColumn("has_more", more).withColumn("__nth", nth).filter(F.col("__nth") <= limit).drop("__nth")


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; with n = 1 a latest-wins snapshot, with 50 a branch's newest commits."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__nth", nth).filter(F.col("__nth") <= n).drop("__nth")


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return newest(rows, keys, order, 1)


def neighbours(rows: DataFrame, key: str = "split_id", value: str = "patch_id") -> DataFrame:
    """rows with the previous and next value in order; deleted ones are not skipped."""
    w = Window.partitionBy(key).orderBy(value)
    return rows.withColumn("previous_id", F.lag(value).over(w)).withColumn("next_id", F.lead(value).over(w))


def preceding(rows: DataFrame, key: str, order: str, value: str, n: int = 3) -> DataFrame:
    """rows with the n values before them, oldest first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    return rows.withColumn("before", F.collect_list(value).over(w))


def soft_delete(rows: DataFrame, tombstones: DataFrame, keys: list[str], state: str = "deleted") -> DataFrame:
    """rows with state and its time from tombstones (keys, at); the latest stands."""
    last = tombstones.groupBy(*keys).agg(F.max("at").alias("__at"))
    out = rows.join(last, keys, "left")
    return out.withColumn("state", F.when(F.col("__at").isNotNull(), state).otherwise(F.col("state"))).withColumnRenamed("__at", f"{state}_at")


def enrich(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Shallow merge by key: the right side's values win where it has any."""
    extra = more.select(*keys, *[F.col(c).alias(f"__{c}") for c in more.columns if c not in keys])
    out = rows.join(extra, keys, "left")
    for c in more.columns:
        if c not in keys:
            out = out.withColumn(c, F.coalesce(f"__{c}", *([c] if c in rows.columns else []))).drop(f"__{c}")
    return out


def patch_totals(splits: DataFrame) -> DataFrame:
    """split_id, patches, files, categories over active patches of splits (patches: array of struct with state, files, category)."""
    live = F.filter("patches", lambda p: ~p["state"].eqNullSafe("deleted"))
    files = F.aggregate(live, F.lit(0), lambda a, p: a + F.coalesce(F.size(p["files"]), F.lit(0)))
    return splits.select("split_id", F.size(live).alias("patches"), files.alias("files"), F.array_distinct(F.transform(live, lambda p: p["category"])).alias("categories"))


def pull_splits(pulls: DataFrame, splits: DataFrame) -> DataFrame:
    """Pull requests with their splits (owner, repo, number, generated_at) newest first, and the latest; splits without a pull request do not count."""
    made = splits.filter("number is not null").groupBy("owner", "repo", "number").agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("generated_at", F.lit(0))).alias("age"), "split_id"))).alias("s"))
    made = made.select("owner", "repo", "number", F.transform("s", lambda x: x["split_id"]).alias("splits"))
    return pulls.join(made, ["owner", "repo", "number"], "left").withColumn("latest", F.try_element_at("splits", F.lit(1)))


def with_details(pulls: DataFrame, details: DataFrame) -> DataFrame:
    """Pull requests with additions, deletions and changed_files; 0 where no detail was read."""
    names = ("additions", "deletions", "changed_files")
    out = pulls.drop(*names).join(details.select("owner", "repo", "number", *names), ["owner", "repo", "number"], "left")
    return out.fillna(0, list(names))


def by_path(wanted: DataFrame, repos: DataFrame) -> DataFrame:
    """path, name: of each wanted path the repository with that path, else one that contains it or lies in it.

    The containment test compares ancestors by equality: each path is listed with its parents, so no cross join forms."""
    def ancestors(path: str) -> Column:
        parts = F.split(F.rtrim(F.col(path), F.lit("/")), "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))

    want = wanted.select("path").distinct()
    have = repos.select(F.col("path").alias("repo_path"), "name")
    up = want.withColumn("key", F.explode(ancestors("path"))).join(have.withColumn("key", F.rtrim("repo_path", F.lit("/"))), "key")
    down = have.withColumn("key", F.explode(ancestors("repo_path"))).join(want.withColumn("key", F.rtrim("path", F.lit("/"))), "key")
    both = up.select("path", "repo_path", "name").unionByName(down.select("path", "repo_path", "name")).distinct()
    rank = F.struct((F.col("path") != F.col("repo_path")).alias("other"), (-F.char_length("repo_path")).alias("short"), F.col("repo_path"), F.col("name"))
    return both.groupBy("path").agg(F.min(rank).alias("r")).select("path", F.col("r.name").alias("name"))


def annotation_matches(annotations: DataFrame, hunks: DataFrame) -> DataFrame:
    """annotations (split_id, file_path, hunk_header, start_line, end_line) with hunks (split_id, file, old_start, new_start,
    section) of their change set that they describe: equal starts, one path equal to or ending with the other, and the
    section within the header. The join is on the change set, the last part of the path and both starts."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    notes = annotations.withColumn("__base", last("file_path"))
    own = hunks.withColumn("__base", last("file")).withColumnsRenamed({"old_start": "__old", "new_start": "__new"})
    on = [notes["split_id"] == own["split_id"], notes["__base"] == own["__base"], F.col("start_line") == F.col("__old"), F.col("end_line") == F.col("__new")]
    pairs = notes.join(own, on).drop(own["split_id"]).drop("__base").withColumnsRenamed({"__old": "old_start", "__new": "new_start"})
    return pairs.filter(same_file(F.col("file_path"), F.col("file")) & F.contains(F.trim("hunk_header"), F.trim("section")))


def same_file(a: Column, b: Column) -> Column:
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def patch_at(patches: DataFrame, key: str) -> DataFrame:
    """The patch with that id as text, else the one at that 0-based place."""
    nth = F.row_number().over(Window.partitionBy("split_id").orderBy("patch_id")) - 1
    hit = F.when(F.col("patch_id").cast("string") == key, 0).when(F.col("nth").cast("string") == key, 1)
    return newest(patches.withColumn("nth", nth).withColumn("hit", hit).filter("hit is not null"), ["split_id"], [F.col("hit")]).drop("nth", "hit")


def in_branch(commits: DataFrame, membership: DataFrame, branch: str) -> DataFrame:
    """commits (sha) that membership (sha, branch) has on the branch, a remote's copy of it included."""
    on = (F.col("branch") == branch) | (F.col("branch") == f"origin/{branch}") | F.endswith("branch", F.lit(f"/{branch}"))
    return commits.join(membership.filter(on), "sha", "left_semi")


def badge(status: Column) -> Column:
    """Staged, unstaged and untracked files together; 0 for no status."""
    n = lambda f: F.coalesce(F.when(status[f].isNotNull(), F.size(status[f])), F.lit(0))
    return n("staged") + n("unstaged") + n("untracked")


def of_repository(pulls: DataFrame, repository: str | None = None) -> DataFrame:
    """Pull requests of `owner/repo`, all where none is asked for."""
    return pulls if not repository else pulls.filter(F.concat_ws("/", "owner", "repo") == repository)


def all_pulls(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pull requests of all repositories, newest change first, and what went wrong, apart. answers: slug, error, pulls
    (array of struct with updated_at), one row a repository asked."""
    fine = F.col("slug").rlike("^[^/]+/[^/]+") & F.col("error").isNull()
    pulls = answers.filter(fine).select("slug", F.explode("pulls").alias("p")).select("slug", "p.*").orderBy(F.desc("updated_at"), "slug", "number")
    told = F.when(~F.col("slug").rlike("^[^/]+/[^/]+"), F.concat(F.lit(fixed.BAD_REPOSITORY), F.col("slug"))).otherwise(F.concat_ws(": ", "slug", "error"))
    return pulls, answers.filter(~fine).select("slug", told.alias("error"))


def find_file(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """split_id, wanted, and the first file (pos, old_path, new_path) of the diff whose path is the wanted one or ends with
    it, or with which the wanted one ends."""
    name = F.col("wanted")
    ends = lambda a, b: F.endswith(a, F.concat(F.lit("/"), b))
    new, old = F.col("new_path"), F.col("old_path")
    hit = (new == name) | (old == name) | ends(new, name) | ends(old, name) | ends(name, F.coalesce(new, old))
    return newest(wanted.join(files, "split_id").filter(hit), ["split_id", "wanted"], [F.col("pos")])


def newest_folder(folders: DataFrame) -> DataFrame:
    """repository, folder: the last by name of the result folders (commit_, patch_, pr_) of each repository."""
    return folders.filter(F.col("folder").rlike("^(commit|patch|pr)_")).groupBy("repository").agg(F.max("folder").alias("folder"))


def first_page(snapshot: DataFrame, live: DataFrame, keys: list[str], order: list[Column], skip: int = 0, limit: int = 20) -> DataFrame:
    """A page of each key's rows: the first from the snapshot where it holds the key, all others from the live table;
    with has_more and whether it was cached."""
    cached = snapshot.withColumn("cached", F.lit(True)).limit(0 if skip else 1 << 30)
    rows = cached.unionByName(live.join(cached.select(*keys).distinct(), keys, "left_anti").withColumn("cached", F.lit(False)))
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("__nth", F.row_number().over(w)).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy(*keys)) > skip + limit)
    return rows.filter((F.col("__nth") > skip) & (F.col("__nth") <= skip + limit)).drop("__nth")


def by_name(wanted: DataFrame, repos: DataFrame) -> DataFrame:
    """Each wanted name's repository, the first in the configured order (pos)."""
    return newest(wanted.join(repos, "name"), ["name"], [F.col("pos")])


def badges(status: DataFrame) -> DataFrame:
    """repository, badge: the number of states of its files (repository, file, state)."""
    lists = status.groupBy("repository").agg(F.struct(*[F.collect_list(F.when(F.col("state") == x, F.col("file"))).alias(x) for x in ("staged", "unstaged", "untracked")]).alias("s"))
    return lists.select("repository", badge(F.col("s")).alias("badge"))
