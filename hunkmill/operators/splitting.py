"""Change sets into disjoint, bounded, ordered patches.

Cycles, groups and the merge depend on order within one change set, so they run as one kernel on a change set; change
sets run in parallel, many to an Arrow batch, and are shuffled once, by split_id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from . import grouping, kernels

MEMBERS = "split_id string, patch_id int, change_id string, change_ord int, depends_on array<int>, file string, type string, lines int, names array<string>"
GROUPERS: list = []
SUMMARIZERS: list = []


def register_summarizer(make) -> None:
    """make(patches) returns names and descriptions (split_id, patch_id, name, description) for patch rows; null, or no
    row, leaves the rule's own. None is registered at first; later ones win."""
    SUMMARIZERS.append(make)


def summarised(patches: DataFrame) -> DataFrame:
    for make in SUMMARIZERS:
        own = make(patches).select("split_id", "patch_id", F.col("name").alias("__name"), F.col("description").alias("__text"))
        rows = patches.join(own, ["split_id", "patch_id"], "left")
        patches = rows.withColumn("name", F.coalesce("__name", "name")).withColumn("description", F.coalesce("__text", "description")).drop("__name", "__text")
    return patches


def register_grouper(make) -> None:
    """make(changes, symbols) returns further groups (split_id, key, score, change_ids, first)."""
    GROUPERS.append(make)


def semantic_groups(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """split_id, group_ord, group_id, name, description, score, change_ids of all families in their fixed order."""
    families = [
        ("file", grouping.by_file(changes), "Changes in "), ("subpkg", grouping.by_directory(changes), "Subpackage: "), ("filetype", grouping.by_layer(changes), "Layer: "),
        ("rename", grouping.renames(symbols), "Rename "), ("extract", grouping.extractions(changes, symbols), "Extract from "), ("api", grouping.api_changes(changes, symbols), "API change "),
        ("symbol", symbol_groups(symbols).repartition("split_id"), "Related by symbols "), *[(f"own{i}", make(changes, symbols), "Group ") for i, make in enumerate(GROUPERS)],
    ]
    out = None
    for i, (name, rows, text) in enumerate(families):
        own = F.col("idx").cast("string") if "idx" in rows.columns else F.lit(None).cast("string")
        rows = rows.select("split_id", F.lit(i).alias("family"), F.lit(name).alias("kind"), own.alias("idx"), "key", "first", F.col("score").cast("double").alias("score"), "change_ids", F.concat(F.lit(text), F.col("key")).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    nth = F.row_number().over(Window.partitionBy("split_id", "family").orderBy("first", "key")) - 1
    out = out.withColumn("group_id", F.when(F.col("kind") == "filetype", F.concat(F.lit("filetype_"), F.col("key"))).otherwise(F.concat("kind", F.lit("_"), F.coalesce("idx", nth.cast("string")))))
    order = F.row_number().over(Window.partitionBy("split_id").orderBy("family", "first", "key")) - 1
    return out.select("split_id", order.cast("int").alias("group_ord"), "group_id", "name", F.col("name").alias("description"), "score", "change_ids")


def symbol_groups(symbols: DataFrame) -> DataFrame:
    """Greedy clusters of changes with similar names, score 0.8."""
    packed = grouping.name_sets(symbols, 2).groupBy("split_id").agg(F.array_sort(F.collect_list(F.struct("change_ord", "change_id", "names"))).alias("c"))

    def cluster(batches):
        for batch in batches:
            out = []
            for split, own in zip(kernels.plain(batch.column("split_id")), kernels.plain(batch.column("c")), strict=True):
                place = {r["change_id"]: r["change_ord"] for r in own}
                found = kernels.symbol_clusters({r["change_id"]: set(r["names"]) for r in own})
                out += [(split, c[0], place[c[0]], 0.8, c) for c in found]
            yield kernels.batch_of(out, {"split_id": pa.string(), "key": pa.string(), "first": pa.int32(), "score": pa.float64(), "change_ids": pa.list_(pa.string())})

    return packed.mapInArrow(cluster, "split_id string, key string, first int, score double, change_ids array<string>")


def pack(changes: DataFrame, symbols: DataFrame, deps: DataFrame, suggested: DataFrame | None = None) -> DataFrame:
    """split_id, changes, symbols, deps, more, late: all that a change set's plan needs, in one row.

    more: groups of the registered groupers, which take part in the cover rule; late: suggested groups (split_id,
    group_id, change_ids), which join after it and may overlap.
    """
    per = F.struct("change_ord", "change_id", "file", "type", "line_start", "line_end", (F.col("added_lines") + F.col("deleted_lines")).alias("lines"))
    listed = lambda rows, columns, name: rows.groupBy("split_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    out = changes.groupBy("split_id").agg(F.array_sort(F.collect_list(per)).alias("changes"))
    out = out.join(listed(symbols, ["change_ord", "sym_ord", "change_id", "name", "type"], "symbols"), "split_id", "left")
    out = out.join(listed(deps, ["source", "target", "strength"], "deps"), "split_id", "left")
    own = [make(changes, symbols).select("split_id", F.lit(i).alias("family"), "first", "key", F.col("score").cast("double").alias("score"), "change_ids") for i, make in enumerate(GROUPERS)]
    for rows, name, columns in ((own, "more", ["family", "first", "key", "score", "change_ids"]), ([suggested] if suggested is not None else [], "late", ["group_id", "change_ids"])):
        if rows:
            every = rows[0]
            for r in rows[1:]:
                every = every.unionByName(r)
            out = out.join(listed(every, columns, name), "split_id", "left")
        else:
            out = out.withColumn(name, F.lit(None).cast("array<struct<key:string>>"))
    return out


def unpacked(batch: pa.RecordBatch) -> list[dict]:
    """The rows of a batch of pack(), each change with the facts of its path."""
    rows = kernels.rows_of(batch)
    for row in rows:
        for c in row["changes"]:
            c.update(kernels.facts_of(c["file"]))
    return rows


def members(packed: DataFrame, target: int = fixed.TARGET_LINES) -> DataFrame:
    """Rows of MEMBERS: every change in exactly one patch; patches are numbered in order, each after those it depends on."""

    def plan(batches):
        listed = {"array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
        kinds = {name: listed.get(kind) or kernels.ARROW[kind] for name, kind in (x.split() for x in MEMBERS.split(", "))}
        for batch in batches:
            yield kernels.batch_of([(row["split_id"], *x) for row in unpacked(batch) for x in _split(row, target)], kinds)

    return packed.mapInArrow(plan, MEMBERS)


def groups_of(row: dict) -> list[tuple[str, float, list[str]]]:
    """The groups of one packed change set that the cover rule keeps, in their fixed order, then the suggested ones."""
    groups = kernels.families(row["changes"], row["symbols"] or [])
    nth: dict[int, int] = defaultdict(int)
    for g in row["more"] or ():
        groups.append((f"own{g['family']}_{nth[g['family']]}", g["score"], g["change_ids"]))
        nth[g["family"]] += 1
    kept = [groups[i] for i in sorted(kernels.keep_uncovered(groups))]
    return kept + [(g["group_id"], 0.0, g["change_ids"]) for g in row["late"] or ()]


def candidates_of(row: dict, target: int) -> tuple[list[list[str]], list[list[str]]]:
    """The cycles of one packed change set, and its candidates: cycles, packed layers of a large new feature, single changes."""
    rows = row["changes"]
    ids = [r["change_id"] for r in rows]
    sizes, files, layers = ({r["change_id"]: r[k] for r in rows} for k in ("lines", "file", "pack_layer"))
    rings = kernels.components(ids, [(e["source"], e["target"]) for e in row["deps"] or ()])
    new_feature = sum(r["type"] == "add" for r in rows) > 0.7 * len(rows)
    found = []
    for ring in rings:
        large = new_feature and sum(sizes[i] for i in ring) > 2 * target
        found += kernels.pack_layers(ring, files, sizes, layers, target) if large else [ring]
    taken = {i for c in found for i in c}
    rest = [i for i in ids if i not in taken]
    return rings, found + (kernels.pack_layers(rest, files, sizes, layers, target) if new_feature and len(rest) > 5 else [[i] for i in rest])


def merged_of(row: dict, target: int) -> list[list[str]]:
    """The candidates of one packed change set, merged."""
    rings, candidates = candidates_of(row, target)
    member_of = defaultdict(set)
    for gid, _, own in groups_of(row):
        for c in own:
            member_of[c].add(gid)
    ring_of = {i: k for k, ring in enumerate(rings) for i in ring}
    strong = {(e["source"], e["target"]) for e in row["deps"] or () if e["strength"] >= 1.0}
    return kernels.merge_candidates(candidates, {r["change_id"]: r["lines"] for r in row["changes"]}, ring_of, strong, member_of, target)


def _split(row: dict, target: int):
    merged = merged_of(row, target)
    at = {r["change_id"]: r for r in row["changes"]}
    names = defaultdict(list)
    for x in row["symbols"] or ():
        if len(names[x["change_id"]]) < fixed.SHOWN_SYMBOLS:
            names[x["change_id"]].append(x["name"])
    patch_of = {i: k for k, own in enumerate(merged) for i in own}
    edges = [(e["source"], e["target"]) for e in row["deps"] or ()]
    needs = sorted({(patch_of[a], patch_of[b]) for a, b in edges if a in patch_of and b in patch_of and patch_of[a] != patch_of[b]})
    order, cut = kernels.prerequisite_order(list(range(len(merged))), needs)
    number = {k: n for n, k in enumerate(order)}
    wanted = defaultdict(set)
    for a, b in set(needs) - set(cut):
        wanted[a].add(number[b])
    for k in order:
        for i in merged[k]:
            r = at[i]
            yield number[k], i, r["change_ord"], sorted(wanted[k]), r["file"], r["type"], r["lines"], names[i]


def kernel_rows(packed: DataFrame, work: Callable, schema: str) -> DataFrame:
    """split_id and the rows that work(packed row) gives, as a table: the kernel's steps one by one."""

    def run(batches):
        for batch in batches:
            yield kernels.batch_of([(row["split_id"], *x) for row in unpacked(batch) for x in work(row)], KERNEL_SCHEMAS[schema])

    return packed.mapInArrow(run, f"split_id string, {schema}")


GROUP_ROWS, SET_ROWS = "group_ord int, group_id string, score double, change_ids array<string>", "nth int, change_ids array<string>"
KERNEL_SCHEMAS = {
    GROUP_ROWS: {"split_id": pa.string(), "group_ord": pa.int32(), "group_id": pa.string(), "score": pa.float64(), "change_ids": pa.list_(pa.string())},
    SET_ROWS: {"split_id": pa.string(), "nth": pa.int32(), "change_ids": pa.list_(pa.string())},
}


def kept_groups(packed: DataFrame) -> DataFrame:
    """split_id, group_ord, group_id, score, change_ids of the groups that guide the merge."""
    return kernel_rows(packed, lambda row: ((i, *g) for i, g in enumerate(groups_of(row))), GROUP_ROWS)


def candidates(packed: DataFrame, target: int = fixed.TARGET_LINES) -> DataFrame:
    """split_id, nth, change_ids of the candidates before the merge."""
    return kernel_rows(packed, lambda row: enumerate(candidates_of(row, target)[1]), SET_ROWS)


def merged(packed: DataFrame, target: int = fixed.TARGET_LINES) -> DataFrame:
    """split_id, nth, change_ids of the candidates after the merge."""
    return kernel_rows(packed, lambda row: enumerate(merged_of(row, target)), SET_ROWS)


def _summary(rows: DataFrame, order: str, line: Column, what: str) -> DataFrame:
    """split_id, text: the first SUMMARY_ROWS lines in order, and how many more there are."""
    nth = F.row_number().over(Window.partitionBy("split_id").orderBy(order))
    rows = rows.withColumn("__line", line).withColumn("__nth", nth)
    shown = F.array_sort(F.collect_list(F.when(F.col("__nth") <= fixed.SUMMARY_ROWS, F.struct("__nth", "__line"))))
    text = F.array_join(F.transform(shown, lambda x: x["__line"]), "\n")
    more = F.count(F.lit(1)) - fixed.SUMMARY_ROWS
    return rows.groupBy("split_id").agg(F.concat(text, F.when(more > 0, F.format_string(f"\n... and %d more {what}", more)).otherwise("")).alias("text"))


def change_summaries(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """split_id, text: a line a change, for a prompt."""
    names = symbols.groupBy("split_id", "change_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("sym_ord", "name"))), lambda x: x["name"]), 1, fixed.SHOWN_SYMBOLS).alias("names"))
    rows = changes.join(names, ["split_id", "change_id"], "left")
    line = F.format_string("- %s: %s in %s, symbols: [%s], %d+ %d-", "change_id", "type", "file", F.coalesce(F.array_join("names", ", "), F.lit("")), "added_lines", "deleted_lines")
    return _summary(rows, "change_ord", line, "changes")


def dependency_summaries(deps: DataFrame) -> DataFrame:
    line = F.format_string("- %s -> %s (%s, strength=%.1f): %s", "source", "target", "type", "strength", "reason")
    return _summary(deps, "dep_ord", line, "dependencies")


def atomic_summaries(groups: DataFrame) -> DataFrame:
    """split_id, text: a line a group, with its first SUMMARY_IDS changes."""
    ids = F.concat(F.array_join(F.slice("change_ids", 1, fixed.SUMMARY_IDS), ", "), F.when(F.size("change_ids") > fixed.SUMMARY_IDS, "...").otherwise(""))
    packed = F.array_sort(F.collect_list(F.struct("group_ord", F.format_string("- %s: [%s] - %s", "group_id", ids, "reason").alias("line"))))
    return groups.groupBy("split_id").agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias("text"))


def semantic_summaries(groups: DataFrame) -> DataFrame:
    line = F.format_string("- %s (cohesion=%.2f): %s [%d changes]", "name", "score", "description", F.size("change_ids"))
    packed = F.array_sort(F.collect_list(F.struct("group_ord", line.alias("line"))))
    return groups.groupBy("split_id").agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias("text"))


def patch_summaries(patches: DataFrame) -> DataFrame:
    needs = F.when(F.size("depends_on") > 0, F.concat(F.lit("depends on ["), F.array_join(F.transform("depends_on", lambda d: d.cast("string")), ", "), F.lit("]"))).otherwise("no dependencies")
    line = F.format_string("- Patch %d: %s (%d changes, %d lines, %s)", "patch_id", "name", F.size("changes"), "size_lines", needs)
    packed = F.array_sort(F.collect_list(F.struct("patch_id", line.alias("line"))))
    return patches.groupBy("split_id").agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias("text"))


def type_counts(kind: str = "type") -> Column:
    n = lambda t: F.sum((F.col(kind) == t).cast("int"))
    return S.type_counts(n("add"), n("modify"), n("delete"))


def patches(rows: DataFrame) -> DataFrame:
    """Patch rows of members(): name, description, size and warnings."""
    out = rows.groupBy("split_id", "patch_id").agg(
        grouping.ordered_ids().alias("changes"), F.first("depends_on").alias("depends_on"), F.sum("lines").cast("int").alias("size_lines"), F.array_sort(F.collect_set("file")).alias("files"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.concat(F.lit("no_llm_"), type_counts()).alias("description"),
    )
    two = F.array_join(F.slice("names", 1, 2), ", ")
    one, some = F.size("files") == 1, F.size("names") > 0
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    name = F.when(one & some, say("Update ", S.base_name(F.col("files")[0]), ": ", two)).when(one, say("Changes in ", S.base_name(F.col("files")[0])))
    name = name.when(some, say("Update ", two)).otherwise(say("Changes across ", F.size("files").cast("string"), " files"))
    return out.select("split_id", "patch_id", name.alias("name"), "description", "changes", "depends_on", F.lit("").alias("rationale"), "size_lines", warnings(F.col("size_lines"), F.size("changes")).alias("warnings"))


def warnings(size: Column, hunks: Column) -> Column:
    large = F.when(size > fixed.LARGE_LINES, F.concat(F.lit("Large patch: "), size.cast("string"), F.lit(" lines")))
    many = F.when(hunks > fixed.MANY_HUNKS, F.concat(F.lit("Many changes: "), hunks.cast("string"), F.lit(" hunks")))
    return F.array_compact(F.array(large, many))


def patch_edges(deps: DataFrame, parts: DataFrame) -> DataFrame:
    """split_id, patch_id, needs: patches whose changes depend on another's."""
    a = parts.select("split_id", F.col("change_id").alias("source"), "patch_id")
    b = parts.select("split_id", F.col("change_id").alias("target"), F.col("patch_id").alias("needs"))
    return deps.join(a, ["split_id", "source"]).join(b, ["split_id", "target"]).filter("patch_id <> needs").select("split_id", "patch_id", "needs").distinct()


def categories(parts: DataFrame, symbols: DataFrame) -> DataFrame:
    """split_id, patch_id, category: refactor with any import, feature with any definition, else other."""
    rows = parts.join(symbols.select("split_id", "change_id", F.col("type").alias("kind")), ["split_id", "change_id"], "left")
    has = lambda *t: F.coalesce(F.bool_or(F.col("kind").isin(*t)), F.lit(False))
    return rows.groupBy("split_id", "patch_id").agg(F.when(has("import"), "refactor").when(has("function", "method", "class"), "feature").otherwise("other").alias("category"))


def resplit(patches: DataFrame, old_id: int, parts: DataFrame) -> DataFrame:
    """patches with patch old_id replaced by parts (patch_id from 0, depends_on within them); later ids move up."""
    n = parts.groupBy("split_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    shift = lambda x: F.when(x > old_id, x + F.col("n") - 1).when(x == old_id, x + F.col("n") - 1).otherwise(x)
    kept = patches.filter(F.col("patch_id") != old_id).join(n, "split_id", "left").fillna(1, ["n"])
    kept = kept.withColumn("patch_id", F.when(F.col("patch_id") > old_id, F.col("patch_id") + F.col("n") - 1).otherwise(F.col("patch_id"))).withColumn("depends_on", F.transform("depends_on", shift)).drop("n")
    before = patches.filter(F.col("patch_id") == old_id).select("split_id", F.col("depends_on").alias("inherited"))
    fresh = parts.join(before, "split_id", "left").withColumn("depends_on", F.array_sort(F.array_union(F.coalesce("inherited", F.array().cast("array<int>")), F.transform("depends_on", lambda d: d + old_id)))).withColumn("patch_id", F.col("patch_id") + old_id).drop("inherited")
    return kept.unionByName(fresh.select(*kept.columns))


def halve_large(patches: DataFrame, sizes: DataFrame, target: int = fixed.TARGET_LINES) -> DataFrame:
    """split_id, patch_id, changes, depends_on, size_lines: patches over two targets with over one change in halves; the
    second half gets a new id at the end and depends on the first. sizes: split_id, change_id, lines."""
    large = (F.col("size_lines") > 2 * target) & (F.size("changes") > 1)
    half = F.floor(F.size("changes") / 2).cast("int")
    top = F.max("patch_id").over(Window.partitionBy("split_id"))
    nth = F.sum(large.cast("int")).over(Window.partitionBy("split_id").orderBy("patch_id"))
    rows = patches.withColumn("top", top).withColumn("nth", nth).withColumn("large", large)
    first = rows.select("split_id", "patch_id", F.when(F.col("large"), F.slice("changes", 1, half)).otherwise(F.col("changes")).alias("changes"), "depends_on")
    second = rows.filter("large").select("split_id", (F.col("top") + F.col("nth")).cast("int").alias("patch_id"), F.slice("changes", half + 1, F.size("changes")).alias("changes"), F.array("patch_id").alias("depends_on"))
    out = first.unionByName(second)
    lines = out.select("split_id", "patch_id", F.explode("changes").alias("change_id")).join(sizes, ["split_id", "change_id"], "left").groupBy("split_id", "patch_id").agg(F.coalesce(F.sum("lines"), F.lit(0)).cast("int").alias("size_lines"))
    return out.join(lines, ["split_id", "patch_id"], "left")
