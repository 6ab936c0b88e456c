"""Merkle manifest of a table: an external-memory store of nodes, level by level, and proofs read from it.

Every row is a leaf. The leaves of a source, in the order of doc_id, are the bottom of its tree; 16 consecutive nodes form
a run, whose hash is a node of the next level. The trees' tops, in the order of the sources, are the leaves of one
more tree, whose top is the root.

Building: leaves are range-sorted into runs of the sort (one partition each) and written; counts by partition and source turn
positions there into coordinates (tree, at), so a source of any size is spread over many partitions. The store has one
Parquet folder a level, a row for each run of nodes; each level is one sequential scan of the level below, with runs
put together before the shuffle. Proving goes the other way: merge joins by coordinate hand every node the siblings
of all levels above it, so a row of the table meets its whole path once, in the last join.

Defined cases: null fields are hashed as `-`; a null source comes before all others, a null doc_id before all ids of
its source; rows with one source and doc_id are ordered by leaf, and equal leaves can change places, so the result is the same;
empty and very long texts are hashed whole; a source's lone leaf is its top; an empty table gives an empty
result and no root; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, scratch, session, tidy

#: Nodes of a run.
FAN = 16
#: Leaves of one sorted partition, about.
PARTITION_ROWS = 2_000_000
#: monotonically_increasing_id keeps the partition above these bits.
PLACE_BITS = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(text: Column) -> Column:
    """Hash of a row's five fields, with the given text."""
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return digest(*[F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields])


def tampered() -> Column:
    """The text as an intruder leaves it: A-Z in lower case where 5 divides crc32 of the id."""
    upper = "".join(map(chr, range(65, 91)))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))


def _sorted(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """rows in sorted partitions, with `part` and `place` in it; written, so that both are fixed."""
    count = rows.count()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // PARTITION_ROWS)) if count > 10_000 else 1
    # rows alike in all keys would be one range: their place in the scan parts them
    keys = [*keys, F.col("__place")]
    dealt = rows.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    kept = materialise(dealt.drop("__place").withColumn("__at", F.monotonically_increasing_id()), "sorted")
    return kept.withColumn("part", F.shiftrightunsigned("__at", PLACE_BITS)).withColumn("place", F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).drop("__at")


def _shifts(rows: DataFrame, tree: str) -> DataFrame:
    """(part, tree, shift, n): place + shift counts from the tree's start, n are the tree's rows. One row for each tree in
    each partition."""
    found = rows.groupBy("part", tree).agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("rows"))
    so_far = F.sum("rows").over(Window.partitionBy(tree).orderBy("part"))
    return found.select("part", tree, (so_far - F.col("rows") - F.col("low")).alias("shift"), F.sum("rows").over(Window.partitionBy(tree)).alias("n"))


def _numbered(rows: DataFrame, shifts: DataFrame, tree: str) -> DataFrame:
    """rows with their coordinate; joined by partition and tree, so a tree of many rows is met in many places."""
    shifts = shifts.withColumnRenamed("part", "__part").withColumnRenamed(tree, "__tree")
    found = rows.join(shifts, (F.col("part") == F.col("__part")) & F.col(tree).eqNullSafe(F.col("__tree")))
    return found.withColumn("at", F.col("place") + F.col("shift")).drop("part", "place", "shift", "__part", "__tree")


def _nodes(run: Column) -> Column:
    return F.array_join(F.transform(run, lambda x: x["node"]), "")


def _runs(nodes: DataFrame, *more: str) -> DataFrame:
    """(tree, at, n, run): the nodes of trees that hold several, 16 a row, in order."""
    run = F.array_sort(F.collect_list(F.struct("at", "node", *more)))
    return nodes.filter("n > 1").groupBy("tree", F.expr(f"at div {FAN}").alias("at")).agg(F.max("n").alias("n"), run.alias("run"))


def _level(runs: DataFrame) -> DataFrame:
    """The nodes (tree, at, n, node) that the runs of a level become."""
    return runs.select("tree", "at", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), digest(_nodes(F.col("run"))).alias("node"))


@dataclass
class Store:
    """What build() wrote: folders of `path`, by the levels' numbers."""

    path: str
    #: levels of runs of the sources' trees, and of the tree above them
    levels: int
    upper: int
    #: None for an empty table
    root: str | None


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stack(bottom: DataFrame, path: str, most: int) -> int:
    """Writes level after level from the nodes of `bottom`; most: the largest tree's nodes. Level 0's nodes keep all columns."""
    extra = [c for c in bottom.columns if c not in ("tree", "at", "n", "node")]
    nodes, level = bottom, 0
    while most > 1:
        nodes = _level(_write(_runs(nodes, *(extra if level == 0 else [])), f"{path}/level={level}"))
        most, level = -(-most // FAN), level + 1
    return level


def _tops(nodes: DataFrame, spark: SparkSession, path: str, levels: int) -> DataFrame:
    """(tree, at_level, node): the single node that each tree ends in; at_level 0 is a lone leaf."""
    found = nodes.filter("n = 1").select("tree", F.lit(0).alias("at_level"), "node")
    for k in range(levels):
        found = found.unionByName(_level(spark.read.parquet(f"{path}/level={k}")).filter("n = 1").select("tree", F.lit(k + 1).alias("at_level"), "node"))
    return found


def build(docs: DataFrame, path: str, seen: Column | None = None) -> Store:
    """Writes the store of docs (doc_id, source, lang, n_chars, text) under `path`. `seen`: the text as found later, which
    check() holds against the manifest; the leaf's own text if None."""
    spark = docs.sparkSession
    own = leaf(F.col("text"))
    other = F.lit(None).cast("string") if seen is None else F.nullif(leaf(seen), own)
    leaves = _sorted(
        materialise(docs.select("doc_id", "source", own.alias("node"), other.alias("seen")), "leaves"),
        [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("node")],
    )
    shifts = materialise(_shifts(leaves, "source"), "shifts")
    sources = _sorted(shifts.select("source", "n").distinct(), [F.asc_nulls_first("source")]).withColumn("one", F.lit(0))
    sources = _write(_numbered(sources.withColumnRenamed("n", "leaves"), _shifts(sources, "one"), "one").drop("one"), f"{path}/sources")
    tree = sources.select(F.col("source").alias("__source"), F.col("at").alias("tree"))
    shifts = shifts.join(tree, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    bottom = _numbered(leaves, shifts, "source").drop("source")
    lone = _write(bottom.filter("n = 1"), f"{path}/lone")
    most, trees = sources.agg(F.max("leaves"), F.count(F.lit(1))).first()
    levels = _stack(bottom, f"{path}/nodes", most or 0)
    tops = _write(_tops(lone, spark, f"{path}/nodes", levels), f"{path}/tops")
    top = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(trees).alias("n"), "node")
    upper = _stack(top, f"{path}/upper", trees)
    last = _level(spark.read.parquet(f"{path}/upper/level={upper - 1}")) if upper else top
    root = last.filter("n = 1").select("node").first() if trees else None
    return Store(path, levels, upper, root and root[0])


#: A level of a path: the nodes before and after one's own, concatenated.
_STEP = "array<struct<before:string,after:string>>"


def _descend(runs: DataFrame, above: DataFrame, *more: str) -> DataFrame:
    """The nodes of `runs`, each with its siblings ahead of the path of the node that its run became."""
    above = above.select(F.col("tree").alias("__tree"), F.col("at").alias("__at"), "path", *[c for c in above.columns if c not in ("tree", "at", "path")])
    kept = [c for c in above.columns if not c.startswith("__") and c != "path"]
    met = runs.hint("merge").join(above, (F.col("tree") == F.col("__tree")) & (F.col("at") == F.col("__at")))
    one = met.select("tree", *kept, "path", "run", F.posexplode("run").alias("i", "x"))
    step = F.struct(_nodes(F.slice("run", F.lit(1), F.col("i"))).alias("before"), _nodes(F.slice("run", F.col("i") + 2, F.lit(FAN))).alias("after"))
    return one.select("tree", F.col("x.at").alias("at"), *kept, *[F.col(f"x.{c}").alias(c) for c in more], F.concat(F.array(step), "path").alias("path"))


def proofs(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, leaf (node), seen, subroot, path of every row: the path has a step for each level, lowest first."""
    read = lambda part: spark.read.parquet(f"{store.path}/{part}")
    above = spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("at"), F.array().cast(_STEP).alias("path"))
    for k in reversed(range(store.upper)):
        above = _descend(read(f"upper/level={k}"), above)
    top = read("tops").withColumnRenamed("node", "subroot").join(above.select(F.col("at").alias("tree"), "path"), "tree")
    top = materialise(top, "tops")
    ends = lambda k: top.filter(F.col("at_level") == k).select("tree", F.lit(0).cast("long").alias("at"), "subroot", "path")
    above = ends(store.levels)
    for k in reversed(range(1, store.levels)):
        above = materialise(_descend(read(f"nodes/level={k}"), above).unionByName(ends(k)), f"paths-{k}")
    alone = read("lone").join(ends(0).drop("at"), "tree").select("doc_id", "node", "seen", "subroot", "path")
    if not store.levels:
        return alone
    return _descend(read("nodes/level=0"), above, "doc_id", "node", "seen").select(*alone.columns).unionByName(alone)


def check(found: DataFrame, root: str | None) -> DataFrame:
    """The rows of proofs() with the root that each row's leaf, as seen, folds to."""
    step = lambda node, x: digest(x["before"], node, x["after"])
    joined = F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "")
    out = found.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), digest(joined).alias("proof_sha256"),
        F.aggregate("path", F.coalesce("seen", "node"), step).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@tidy
def manifest(docs: DataFrame, seen: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs."""
    spark = session()
    store = build(docs, scratch(spark, "store"), seen)
    if store.root is None:
        nothing = docs.select("doc_id", *[F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
        return nothing.filter("false")
    return check(proofs(spark, store), store.root)
