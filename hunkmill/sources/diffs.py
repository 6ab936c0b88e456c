"""Unified diffs in, change rows out: scan, parse, filter, synthesise, statistics."""

from __future__ import annotations

import re
import subprocess
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

HEADER = r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@"


def scan_patches(spark: SparkSession, path: str) -> DataFrame:
    """split_id (the file), value: every file below path, blank ones left out."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("split_id"), "value").filter(F.trim("value") != "")


def _plain(value: str) -> Column:
    return F.regexp_replace(F.regexp_replace(value, "\r\n", "\n"), "\n$", "")


def lines(diffs: DataFrame) -> DataFrame:
    """split_id, pos, line of diffs (split_id, value); a final newline ends the last line rather than starting one."""
    return diffs.select("split_id", F.posexplode(F.split(_plain("value"), "\n")).alias("pos", "line"))


def _strip(path: Column, prefix: str) -> Column:
    path = F.element_at(F.split(path, "\t"), 1)
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, 3, 1 << 30)).otherwise(path)


def body_lines(rows: DataFrame) -> DataFrame:
    """lines() with hunk_no, header, in_body, old_path, new_path.

    A line belongs to a hunk's body until the lengths in its header are used up, so a removed line that starts
    with "-- " is not taken for a file header; the mark of a missing newline belongs to the hunk before it.
    """
    whole = Window.partitionBy("split_id").orderBy("pos")
    upto = whole.rowsBetween(Window.unboundedPreceding, 0)
    is_header = F.col("line").rlike(HEADER)
    rows = rows.withColumn("hunk_no", F.sum(is_header.cast("int")).over(upto))
    hunk = Window.partitionBy("split_id", "hunk_no").orderBy("pos")
    first = F.substring("line", 1, 1)
    body = ~is_header
    used = lambda marks: F.coalesce(F.sum((body & first.isin(*marks)).cast("int")).over(hunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("header", F.first(F.when(is_header, F.col("line")), ignorenulls=True).over(hunk.rowsBetween(Window.unboundedPreceding, 0)))
    inside = (used((" ", "-", "")) < S.hunk_field(F.col("header"), 2)) | (used((" ", "+", "")) < S.hunk_field(F.col("header"), 4))
    rows = rows.withColumn("in_body", F.coalesce((F.col("hunk_no") > 0) & body & ((inside & first.isin(" ", "+", "-", "")) | F.startswith("line", F.lit("\\"))), F.lit(False)))
    mark = lambda text: F.last(F.when(~F.col("in_body") & F.startswith("line", F.lit(text)), F.substring("line", 5, 1 << 30)), ignorenulls=True).over(upto)
    return rows.withColumn("old_path", _strip(mark("--- "), "a/")).withColumn("new_path", _strip(mark("+++ "), "b/")).withColumn("is_header", is_header)


#: The lengths in a hunk's header, as functions.scalars.hunk_field reads them.
_LENGTHS = re.compile(r"@@ -[0-9]+(?:,([0-9]+))? \+[0-9]+(?:,([0-9]+))? @@ ?[^\n\r\x85\u2028\u2029]*(?:[\r\x85\u2028\u2029])?\Z")
_HEADER = re.compile(r"@@ -[0-9]+(?:,[0-9]+)? \+[0-9]+(?:,[0-9]+)? @@")
_HUNK = "split_id {id}, hunk_no int, header string, body string, old_path string, new_path string, file string, hunk_id int, added int, deleted int"
#: Characters of hunks that a batch holds.
_HELD = 4_000_000


def _path(line: str, prefix: str) -> str:
    path = line[4:].split("\t", 1)[0]
    return path[2:] if path.startswith(prefix) else path


def hunks_of(text: str):
    """hunk_no, header, body (lines), old_path, new_path, file, hunk_id (its place in the file), added, deleted of each hunk
    of one diff, by the rules of body_lines()."""
    old = new = hunk = None
    no, nth = 0, defaultdict(int)
    left_old = left_new = added = deleted = 0
    for line in text.split("\n"):
        first = line[:1]
        if first == "@" and _HEADER.match(line):
            if hunk:
                yield (*hunk, added, deleted)
            lengths = _LENGTHS.match(line)
            left_old, left_new = (int(x) if x else 1 for x in (lengths.groups() if lengths else (None, None)))
            file = old if new == "/dev/null" else new
            file = "unknown" if file is None else file
            no, added, deleted = no + 1, 0, 0
            hunk = (no, line, [], old, new, file, nth[file])
            nth[file] += 1
            continue
        inside = left_old > 0 or left_new > 0
        if first == "+":
            left_new -= 1
        elif first == "-":
            left_old -= 1
        elif first in ("", " "):
            left_old, left_new = left_old - 1, left_new - 1
        if hunk and (inside and first in ("", " ", "+", "-") or first == "\\"):
            hunk[2].append(line)
            added, deleted = added + (first == "+"), deleted + (first == "-")
        elif line.startswith("--- "):
            old = _path(line, "a/")
        elif line.startswith("+++ "):
            new = _path(line, "b/")
    if hunk:
        yield (*hunk, added, deleted)


def _parsed(batches):
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    names = ["split_id", "hunk_no", "header", "body", "old_path", "new_path", "file", "hunk_id", "added", "deleted"]
    for batch in batches:
        ids, texts = batch.column("split_id"), batch.column("value")
        rows, at, held = [], [], 0
        for i in range(len(batch)):
            for no, header, body, *rest in hunks_of(texts[i].as_py()):
                # Null tells a hunk without lines from one with an empty line.
                rows.append((no, header, "\n".join(body) if body else None, *rest))
                at.append(i)
                held += len(rows[-1][2] or "") + 200
            if rows and (held > _HELD or i == len(batch) - 1):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)
                rows, at, held = [], [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """Change rows of diffs (split_id, value), one for each hunk. A diff lies in one row and its hunks are cut there, so
    its lines are neither shuffled nor sorted; body_lines() has the same rules line by line."""
    kind = diffs.schema["split_id"].dataType.simpleString()
    texts = diffs.filter("value is not null").select("split_id", _plain("value").alias("value"))
    hunks = texts.mapInArrow(_parsed, _HUNK.format(id=kind))
    field = lambda i: S.hunk_field(F.col("header"), i)
    section = F.when(field(5) != "", F.concat(F.lit(" "), field(5))).otherwise("")
    header = F.concat(F.format_string("@@ -%d,%d +%d,%d @@", field(1), field(2), field(3), field(4)), section)
    return hunks.select(
        "split_id", (F.col("hunk_no") - 1).cast("int").alias("change_ord"), F.concat("file", F.lit(":hunk_"), F.col("hunk_id").cast("string")).alias("change_id"), "file", "hunk_id",
        S.change_type(F.col("added"), F.col("deleted")).alias("type"), field(3).alias("line_start"), (field(3) + field(4)).alias("line_end"),
        F.concat_ws("\n", header, "body").alias("content"), F.col("added").alias("added_lines"), F.col("deleted").alias("deleted_lines"),
        S.language_of(F.col("file")).alias("language"), "old_path", "new_path",
    )


def hunk_digests(changes: DataFrame) -> DataFrame:
    """split_id, change_id, file, digest over context, added and removed lines."""
    return changes.select("split_id", "change_id", "file", S.hunk_digest(F.split("content", "\n")).alias("digest"))


def file_sections(diffs: DataFrame) -> DataFrame:
    """split_id, file_name, old_path, new_path, diff: the text of each file without its mode and index lines."""
    rows = lines(diffs)
    start = F.col("line").rlike(r"^diff --git a/(.+) b/(.+)")
    rows = rows.withColumn("file_no", F.sum(start.cast("int")).over(Window.partitionBy("split_id").orderBy("pos"))).filter("file_no > 0")
    keep = ~F.col("line").rlike(r"^(diff --git|index |old mode|new mode|new file mode|deleted file mode)")
    name = lambda i: F.max(F.when(start, F.regexp_extract("line", r"^diff --git a/(.+) b/(.+)", i)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "line")))), lambda x: x.line), "\n")
    return rows.groupBy("split_id", "file_no").agg(name(2).alias("file_name"), name(1).alias("old_path"), name(2).alias("new_path"), text.alias("diff"))


def stats(changes: DataFrame) -> DataFrame:
    """split_id, additions, deletions, n_files, files of change rows."""
    return changes.groupBy("split_id").agg(
        F.sum("added_lines").alias("additions"), F.sum("deleted_lines").alias("deletions"), F.count_distinct("file").alias("n_files"), F.array_sort(F.collect_set("file")).alias("files"),
    )


def main_language(files: DataFrame) -> DataFrame:
    """split_id, language: of the most frequent suffix of files (split_id, pos, file); ties go to the first seen."""
    ext = F.regexp_extract("file", r"(\.[^./]+)$", 1)
    counts = files.withColumn("ext", ext).filter("ext <> ''").groupBy("split_id", "ext").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    best = F.max_by("ext", F.struct("n", -F.col("first")))
    return counts.groupBy("split_id").agg(best.alias("ext")).select("split_id", S.main_language_of(F.col("ext")).alias("language"))


def from_text(spark: SparkSession, text: str, split_id: str = "stdin") -> DataFrame:
    """split_id, value of a diff that is at hand, such as one read from standard input; nothing where it is blank."""
    return spark.createDataFrame([(split_id, text)] if text.strip() else [], "split_id string, value string")


def between(spark: SparkSession, repository: str, base: str, head: str | None = None, paths: tuple[str, ...] = ()) -> DataFrame:
    """split_id, value: the diff of two refs of a repository on the driver's disk, by plain git; without head, of the
    working directory against base. A driver-side step before the engine, for one change set."""
    command = ["git", "-C", repository, "diff", *([f"{base}..{head}"] if head else [base]), *(["--", *paths] if paths else [])]
    done = subprocess.run(command, capture_output=True, text=True, check=False)
    if done.returncode:
        raise ValueError(f"no diff between {base} and {head}: {done.stderr.strip()}")
    return from_text(spark, done.stdout, f"{base}..{head}" if head else base)


MODES = ("patch", "commit", "branch", "working directory")


def generated(requests: DataFrame, commits: DataFrame, branches: DataFrame, working: DataFrame, untracked: DataFrame) -> DataFrame:
    """split_id, mode, value of patch requests (split_id, patch, commit_id, branch, base_branch, with_untracked).

    The first that is given counts: a ready patch, a commit's diff, the diff of a branch from its base, else the working
    directory, to which the new files' diffs are added where with_untracked is set. Diffs are looked up in commits
    (commit_id, value), branches (branch, base_branch, value) and working (split_id, value); untracked has split_id, file
    and text, folders already listed file by file. Requests without a diff have value null; base_branch without branch
    is an error told by mode `invalid`.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    mode = F.when(given("patch"), MODES[0]).when(given("base_branch") & ~given("branch"), "invalid").when(given("commit_id"), MODES[1]).when(given("branch") & given("base_branch"), MODES[2]).otherwise(MODES[3])
    rows = requests.withColumn("mode", mode)
    mine = lambda m: F.col("mode") == m
    made = rows.filter(mine(MODES[0])).select("split_id", "mode", F.col("patch").alias("value"))
    made = made.unionByName(rows.filter(mine(MODES[1])).join(commits, "commit_id", "left").select("split_id", "mode", "value"))
    made = made.unionByName(rows.filter(mine(MODES[2])).join(branches, ["branch", "base_branch"], "left").select("split_id", "mode", "value"))
    own = rows.filter(mine(MODES[3])).select("split_id", "mode", "with_untracked").join(working, "split_id", "left")
    added = new_file_diffs(untracked).groupBy("split_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "value"))), lambda x: x.value), "").alias("added"))
    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    whole = F.concat("value", F.when(F.endswith("value", F.lit("\n")), "").otherwise("\n"), "added")
    own = own.join(added, "split_id", "left").select("split_id", "mode", F.when(blank, F.lit(None)).when(F.col("with_untracked") & F.col("added").isNotNull(), whole).otherwise(F.col("value")).alias("value"))
    made = made.unionByName(own).unionByName(rows.filter(mine("invalid")).select("split_id", "mode", F.lit(None).cast("string").alias("value")))
    return made.withColumn("value", F.when(F.trim("value") != "", F.col("value")))


def commit_view(infos: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits (infos: sha and further fields) with their diff (commits: commit_id, value) and the files it changes; a
    commit without a diff is left out."""
    rows = infos.join(commits.select(F.col("commit_id").alias("sha"), F.col("value").alias("diff")), "sha").filter("diff is not null")
    sections = file_sections(rows.select(F.col("sha").alias("split_id"), F.col("diff").alias("value")))
    files = sections.groupBy(F.col("split_id").alias("sha")).agg(F.transform(F.array_sort(F.collect_list(F.struct("file_no", "file_name"))), lambda x: x.file_name).alias("files"))
    return rows.join(files, "sha", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))


def working_view(diffs: DataFrame, status: DataFrame, prefix: str | None = None) -> DataFrame:
    """split_id, diff, files, staged, unstaged, untracked of working directories: diffs (split_id, value) and status rows
    (split_id, file, state), all below prefix and given from there where one is set."""
    text = strip_prefix_in_text(F.col("value"), prefix) if prefix else F.col("value")
    sections = file_sections(diffs)
    if prefix:
        sections = sections.filter(S.under(F.col("file_name"), prefix)).withColumn("file_name", S.without_prefix(F.col("file_name"), prefix))
        status = status.filter(S.under(F.col("file"), prefix)).withColumn("file", S.without_prefix(F.col("file"), prefix))
    files = sections.groupBy("split_id").agg(F.array_sort(F.collect_set("file_name")).alias("files"))
    states = status.groupBy("split_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("state") == x, F.col("file")))).alias(x) for x in ("staged", "unstaged", "untracked")])
    none = F.array().cast("array<string>")
    out = diffs.select("split_id", text.alias("diff")).join(files, "split_id", "left").join(states, "split_id", "left")
    return out.select("split_id", "diff", *[F.coalesce(c, none).alias(c) for c in ("files", "staged", "unstaged", "untracked")])


def filter_paths(changes: DataFrame, prefix: str, strip: bool = False) -> DataFrame:
    """Changes at or below prefix; with strip their paths are given from there."""
    kept = changes.filter(S.under(F.col("file"), prefix))
    return kept.withColumn("file", S.without_prefix(F.col("file"), prefix)) if strip else kept


def strip_prefix_in_text(text: Column, prefix: str) -> Column:
    """A diff's text with the prefix cut from its four kinds of path."""
    p = prefix.rstrip("/").replace(".", r"\.") + "/"
    for before in ("diff --git a/", "--- a/", r"\+\+\+ b/"):
        text = F.regexp_replace(text, f"(?m)^({before}){p}", "$1")
    return F.regexp_replace(text, f"(?m)^(diff --git a/.+ b/){p}", "$1")


def new_file_diffs(files: DataFrame) -> DataFrame:
    """split_id, file, value: the diff that adds each of files (split_id, file, text)."""
    text = F.regexp_replace("text", "\n$", "")
    body = F.split(text, "\n")
    head = F.concat(F.lit("diff --git a/"), F.col("file"), F.lit(" b/"), F.col("file"), F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), F.col("file"), F.format_string("\n@@ -0,0 +1,%d @@\n", F.size(body)))
    return files.filter("text is not null").select("split_id", "file", F.concat(head, F.lit("+"), F.replace(text, F.lit("\n"), F.lit("\n+")), F.lit("\n")).alias("value"))


def working_directory(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """split_id, value: the tracked diff of each split followed by those of its untracked files."""
    both = tracked.select("split_id", F.lit("").alias("file"), "value").unionByName(new_file_diffs(untracked))
    return both.groupBy("split_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "value"))), lambda x: x.value), "\n").alias("value"))


def versions(content: Column) -> Column:
    """struct(old, new): the two versions of a file's text that its diff shows."""
    body = F.filter(F.split(content, "\n"), lambda x: ~x.rlike(r"^(---|\+\+\+|@@)"))
    cut = lambda x: F.when(F.substring(x, 1, 1).isin("+", "-", " "), F.substring(x, 2, 1 << 30)).otherwise(x)
    side = lambda other: F.array_join(F.transform(F.filter(body, lambda x: ~F.startswith(x, F.lit(other))), cut), "\n")
    return F.struct(side("+").alias("old"), side("-").alias("new"))


def headers(diffs: DataFrame) -> DataFrame:
    """split_id, pos, header and its numbers and section, of every hunk header."""
    rows = lines(diffs).filter(F.col("line").rlike(HEADER))
    names = ("old_start", "old_length", "new_start", "new_length", "section")
    return rows.select("split_id", "pos", F.col("line").alias("header"), *[S.hunk_field(F.col("line"), i + 1).alias(n) for i, n in enumerate(names)])
