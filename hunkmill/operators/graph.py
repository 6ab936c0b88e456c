"""Graph operators over dependency edges (split_id, source, target, strength), one change set a key."""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from . import kernels

#: Rows of a batch of paths or cycles.
ROWS = 10_000


def distinct_edges(deps: DataFrame) -> DataFrame:
    """Parallel edges collapse, the last one's attributes stay."""
    last = F.max_by(F.struct("type", "strength", "reason"), "dep_ord")
    return deps.groupBy("split_id", "source", "target").agg(last.alias("a")).select("split_id", "source", "target", "a.*")


def _packed(deps: DataFrame) -> DataFrame:
    return deps.groupBy("split_id").agg(F.collect_set(F.struct("source", "target")).alias("edges"))


def _kernel(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(split_id, edges, ...) yields the rows of one change set; change sets come in Arrow batches, many a call."""
    kinds = {name: kernels.ARROW[kind] for name, kind in (x.split() for x in schema.split(", "))}

    def run(batches):
        for batch in batches:
            yield kernels.batch_of([x for row in zip(*map(kernels.plain, batch.columns), strict=True) for x in work(*row)], kinds)

    return rows.mapInArrow(run, schema)


def reach(deps: DataFrame) -> DataFrame:
    """split_id, source, target: every pair with a path, by a search from each node of a change set."""
    def work(split, edges):
        after = defaultdict(list)
        for e in edges:
            after[e["source"]].append(e["target"])
        for start in list(after):
            seen, stack = set(), list(after[start])
            while stack:
                v = stack.pop()
                if v not in seen:
                    seen.add(v)
                    stack.extend(after.get(v, ()))
            yield from ((split, start, v) for v in seen)

    return _kernel(_packed(deps), work, "split_id string, source string, target string")


def reach_by_joins(deps: DataFrame, path: str | None = None) -> DataFrame:
    """The relational twin of reach, for change sets too large for a worker: paths are doubled until no pair is new, so
    the number of joins is the logarithm of the longest path. Each step's pairs are written below `path`, or below
    spark.checkpoint.dir, so that a lost executor loses none."""
    spark = deps.sparkSession
    base = path or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("reach_by_joins needs a path or spark.checkpoint.dir")
    base = f"{base.rstrip('/')}/reach-{uuid.uuid4().hex}"

    def written(rows: DataFrame, step: int) -> DataFrame:
        rows.write.parquet(f"{base}/{step}")
        return spark.read.parquet(f"{base}/{step}")

    pairs, step = written(deps.select("split_id", "source", "target").distinct(), 0), 0
    known = pairs.count()
    while True:
        onward = pairs.select("split_id", F.col("source").alias("target"), F.col("target").alias("next"))
        step += 1
        pairs = written(pairs.unionByName(pairs.join(onward, ["split_id", "target"]).select("split_id", "source", F.col("next").alias("target"))).distinct(), step)
        now = pairs.count()
        if now == known:
            return pairs
        known = now


def cycles(deps: DataFrame, least_strength: float | None = None) -> DataFrame:
    """split_id, change_id, scc (least member): changes on a cycle."""
    edges = deps if least_strength is None else deps.filter(F.col("strength") >= least_strength)

    def work(split, edges):
        pairs = [(e["source"], e["target"]) for e in edges]
        for ring in kernels.components(sorted({n for p in pairs for n in p}), pairs):
            yield from ((split, n, min(ring)) for n in ring)

    return _kernel(_packed(edges), work, "split_id string, change_id string, scc string")


def atomic_groups(cycles_all: DataFrame, cycles_strong: DataFrame, changes: DataFrame, most: int = fixed.ATOMIC_LINES) -> DataFrame:
    """split_id, group_ord, group_id, reason, change_ids: cycles as scc_i, strong ones as strong_i; over `most` lines
    cut by directory, else by interface and the rest, where that gives two parts."""
    info = changes.select("split_id", "change_id", "change_ord", "file", (F.col("added_lines") + F.col("deleted_lines")).alias("lines"))
    parts = []
    for name, found, base in (("scc", cycles_all, 0), ("strong", cycles_strong, 1)):
        rows = found.join(info, ["split_id", "change_id"])
        key = Window.partitionBy("split_id", "scc")
        directory = F.coalesce(S.directory(F.col("file")), F.lit("root"))
        rows = rows.withColumn("dir", directory).withColumn("face", S.interface_file(F.col("file")))
        rows = rows.withColumn("total", F.sum("lines").over(key)).withColumn("n", F.count(F.lit(1)).over(key)).withColumn("dirs", F.size(F.collect_set("dir").over(key))).withColumn("faces", F.size(F.collect_set("face").over(key))).withColumn("first", F.min("change_ord").over(key))
        large = (F.col("total") > most) & (F.col("n") > 2)
        part = F.when(large & (F.col("dirs") > 1), F.col("dir")).when(large & (F.col("faces") > 1), F.when(F.col("face"), "interface").otherwise("impl")).otherwise("")
        rows = rows.withColumn("part", part)
        nth = F.dense_rank().over(Window.partitionBy("split_id").orderBy("first")) - 1
        rows = rows.withColumn("nth", nth)
        gid = F.concat(F.lit(f"{name}_"), F.col("nth").cast("string"), F.when(F.col("part") != "", F.concat(F.lit("_"), F.col("part"))).otherwise(""))
        ids = F.transform(F.array_sort(F.collect_list(F.struct("change_ord", "change_id"))), lambda x: x.change_id)
        parts.append(rows.withColumn("group_id", gid).groupBy("split_id", "nth", "part", "group_id").agg(ids.alias("change_ids"), F.lit(base).alias("family")))
    rows = parts[0].unionByName(parts[1])
    nth = F.row_number().over(Window.partitionBy("split_id").orderBy("family", "nth", "part")) - 1
    reason = F.when(F.col("family") == 0, "Circular dependency").otherwise("Strong dependencies")
    return rows.select("split_id", nth.cast("int").alias("group_ord"), "group_id", reason.alias("reason"), "change_ids")


def group_sizes(groups: DataFrame, changes: DataFrame) -> DataFrame:
    """split_id, group_id, size: added and deleted lines; unknown members count nothing."""
    rows = groups.select("split_id", "group_id", F.explode("change_ids").alias("change_id"))
    sizes = changes.select("split_id", "change_id", (F.col("added_lines") + F.col("deleted_lines")).alias("lines"))
    return rows.join(sizes, ["split_id", "change_id"], "left").groupBy("split_id", "group_id").agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("size"))


def inseparable(deps: DataFrame, found: DataFrame) -> DataFrame:
    """split_id, a, b: pairs that must stay together, both ways: each member of a cycle with the cycle's least (all others
    of the cycle follow through it), or an edge of strength 1."""
    same = found.filter("change_id <> scc").select("split_id", F.col("scc").alias("a"), F.col("change_id").alias("b"))
    strong = deps.filter("strength >= 1").select("split_id", F.col("source").alias("a"), F.col("target").alias("b"))
    once = same.unionByName(strong)
    return once.unionByName(once.select("split_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def separable(found: DataFrame, deps: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (split_id, a, b) with the boolean separable: not on one cycle, and no edge of strength 1 either way."""
    ring = lambda c: found.select("split_id", F.col("change_id").alias(c), F.col("scc").alias(f"__{c}"))
    strong = deps.filter("strength >= 1").select("split_id", F.col("source").alias("a"), F.col("target").alias("b"))
    strong = strong.unionByName(strong.select("split_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("__strong", F.lit(True))
    rows = pairs.join(ring("a"), ["split_id", "a"], "left").join(ring("b"), ["split_id", "b"], "left").join(strong, ["split_id", "a", "b"], "left")
    return rows.select("split_id", "a", "b", (F.col("__strong").isNull() & ~F.coalesce(F.col("__a") == F.col("__b"), F.lit(False))).alias("separable"))


def simple_cycles(edges: DataFrame) -> DataFrame:
    """split_id, nth, nodes of every simple cycle of edges (split_id, source, target), each from its least node, in the order
    of their nodes. Cycles are made one at a time; their number may be exponential in a change set's edges."""
    kind = edges.schema["source"].dataType.simpleString()

    def found(split, own):
        pairs = [(e["source"], e["target"]) for e in own]
        return ((split, i, c) for i, c in enumerate(kernels.simple_cycles(sorted({n for p in pairs for n in p}), pairs)))

    kinds = {"split_id": pa.string(), "nth": pa.int64(), "nodes": pa.list_(kernels.ARROW[kind])}
    return _packed(edges).mapInArrow(_streamed(found, kinds, "split_id", "edges"), f"split_id string, nth long, nodes array<{kind}>")


def _streamed(work, kinds: dict, *columns: str):
    """A mapInArrow function that gives the rows of work(these columns) of all change sets, ROWS a batch, none held longer."""

    def run(batches):
        for batch in batches:
            rows = (x for row in zip(*(kernels.plain(batch.column(c)) for c in columns), strict=True) for x in work(*row))
            while part := list(itertools.islice(rows, ROWS)):
                yield kernels.batch_of(part, kinds)

    return run


def order_without_cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """split_id, node, place, failed for nodes (split_id, node) and edges (split_id, source, target), a source after its
    targets: of each simple cycle the edge from its last node to its least is cut; where one edge closes two cycles that
    fails, and nodes are in their own order."""
    packed = nodes.groupBy("split_id").agg(F.array_sort(F.collect_set("node")).alias("nodes")).join(_packed(edges), "split_id", "left")

    def work(split, own, pairs):
        order, _, failed = kernels.order_without_cycles(list(own), [] if pairs is None else [(e["source"], e["target"]) for e in pairs])
        yield from ((split, n, i, failed) for i, n in enumerate(order))

    return _kernel(packed, work, f"split_id string, node {nodes.schema['node'].dataType.simpleString()}, place int, failed boolean")


def critical_paths(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """split_id, path: every simple path of over two changes from one that nothing leads to, to one that leads nowhere.
    Paths are made one at a time; their number may be exponential in a change set's edges."""
    packed = nodes.groupBy("split_id").agg(F.array_sort(F.collect_list(F.struct("change_ord", "change_id"))).alias("nodes")).join(_packed(deps), "split_id")

    def found(split, names, edges):
        return ((split, path) for path in kernels.critical_paths([n["change_id"] for n in names], sorted((e["source"], e["target"]) for e in edges)))

    return packed.mapInArrow(_streamed(found, {"split_id": pa.string(), "path": pa.list_(pa.string())}, "split_id", "nodes", "edges"), "split_id string, path array<string>")


def file_order(files: DataFrame, edges: DataFrame) -> DataFrame:
    """split_id, patch_id, file, place: the files of each patch (split_id, patch_id, file), those first that others depend
    on (edges: split_id, file_a depends on file_b); of a cycle the last edge is cut; ties go by name."""
    rows = files.groupBy("split_id", "patch_id").agg(F.array_sort(F.collect_set("file")).alias("files"))
    own = edges.groupBy("split_id").agg(F.collect_set(F.struct("file_a", "file_b")).alias("edges"))

    def work(split, patch, names, pairs):
        here = set(names)
        links = [] if pairs is None else sorted((e["file_a"], e["file_b"]) for e in pairs if e["file_a"] in here and e["file_b"] in here)
        order, _ = kernels.prerequisite_order(list(names), links)
        yield from ((split, patch, f, i) for i, f in enumerate(order))

    return _kernel(rows.join(own, "split_id", "left").select("split_id", "patch_id", "files", "edges"), work, "split_id string, patch_id int, file string, place int")


def levels(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """split_id, change_id, level, place: edges on the longest path to a prerequisite, and the order by level and
    change_ord, prerequisites first; edges that close a cycle are cut."""
    packed = nodes.groupBy("split_id").agg(F.array_sort(F.collect_list(F.struct("change_ord", "change_id"))).alias("nodes")).join(_packed(deps), "split_id", "left")

    def work(split, nodes, edges):
        names = [n["change_id"] for n in nodes]
        pairs = [] if edges is None else [(e["source"], e["target"]) for e in edges]
        order, cut = kernels.prerequisite_order(names, pairs)
        needs = defaultdict(set)
        for a, b in set(pairs) - set(cut):
            needs[a].add(b)
        level: dict[str, int] = {}
        for place, n in enumerate(order):
            level[n] = max((level[b] + 1 for b in needs[n] if b in level), default=0)
            yield split, n, level[n], place

    return _kernel(packed, work, "split_id string, change_id string, level int, place long")


def statistics(nodes: DataFrame, deps: DataFrame, found: DataFrame) -> DataFrame:
    """split_id, nodes, edges, components (single ones too), is_dag, average degree."""
    n = nodes.groupBy("split_id").agg(F.count(F.lit(1)).alias("nodes"))
    e = deps.select("split_id", "source", "target").distinct().groupBy("split_id").agg(F.count(F.lit(1)).alias("edges"))
    c = found.groupBy("split_id").agg(F.count(F.lit(1)).alias("on_cycles"), F.count_distinct("scc").alias("rings"))
    rows = n.join(e, "split_id", "left").join(c, "split_id", "left").fillna(0, ["edges", "on_cycles", "rings"])
    return rows.select("split_id", "nodes", "edges", (F.col("nodes") - F.col("on_cycles") + F.col("rings")).alias("components"), (F.col("on_cycles") == 0).alias("is_dag"), (F.col("edges") / F.col("nodes")).alias("avg_degree"))
