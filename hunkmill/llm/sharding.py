"""K-d tree sharding by bytes, in DataFrame functions only.

Rows are points over the metadata dimensions size (logarithm), source and lang (the first six bytes as a number, which
keeps their order), each scaled to the span that the table has. A node that stands for L shards is cut at the weighted
median (half of its bytes) of its widest dimension; its halves get shards in proportion to their bytes, until each leaf
is one shard, that is, until leaves reach the target bytes. Medians are exact to 2**-30: each is found by two histograms
of 2**15 bins, counted where the rows are; the driver sees one row per open node.

Below the dimension, a point's key carries a hash of its text, so equal texts share every key and stay together (they
take the least source and lang among them); a cut goes to the side of such a group that is nearer to the median. The law
has one exception: a text whose copies hold over SPREAD of a shard's bytes together would upset the balance, so its rows
are told apart by doc_id and spread.

Defined cases: null text has size 1 and the CRC of empty bytes; null source or lang comes first; a text of any length is
one row of one shard, however large; ties at a median share a key and stay together; repeated rows go to one shard with
slots of their own; an empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, session, tidy, with_groups

DIMENSIONS = ("size", "source", "lang")
#: Bits of a histogram, of the hash below a dimension, and the steps of a dimension.
HALF, TIE, STEPS = 15, 18, 4095
#: Copies of a text with over this share of a shard's bytes are spread.
SPREAD = 1 / 4
#: Rows that one slot-numbering window should hold.
WINDOW_ROWS = 20_000
#: Up to so many nodes their values are literals of an expression; more are a broadcast table of some bytes a node.
LITERALS = 256
#: Levels of the tree after which the nodes of rows are written.
WRITTEN = 4


def _code(text: Column) -> Column:
    """The first six bytes as a number, in the order of the bytes; null comes first."""
    first = F.rpad(F.hex(F.substring(text.cast("binary"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(first, 16, 10).cast("long") + 1, F.lit(0))


def points(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, h and the keys k0.. of each dimension; written once."""
    text = F.col("text").cast("binary")
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), _code(F.col("source")).alias("src"), _code(F.col("lang")).alias("lng"),
    )
    rows = materialise(rows, "points")
    groups = rows.groupBy("h", "text_crc32", "size").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("g_src"), F.min("lng").alias("g_lng"))
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("size", "src", "lng") for f in (F.min, F.max)]
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), *ends).first()
    rows = with_groups(rows.drop("src", "lng"), groups, ["h", "text_crc32", "size"], "n", r["n"])
    large = F.col("n") * F.col("size") > F.lit((r["total"] or 0) / shards * SPREAD)
    tie = F.pmod(F.when(large, F.xxhash64("doc_id", "h")).otherwise(F.xxhash64("h", "text_crc32")), F.lit(1 << TIE))

    def step(value: Column, low: float, high: float) -> Column:
        return F.floor((value - F.lit(low)) * F.lit(STEPS / (high - low if high > low else 1.0))).cast("long")

    at = [step(F.log2("size"), *(_log2(r[f"{f}_size"]) for f in ("min", "max")))]
    at += [step(F.col(f"g_{c}").cast("double"), *(float(r[f"{f}_{c}"] or 0) for f in ("min", "max"))) for c in ("src", "lng")]
    keys = [(F.shiftleft(F.greatest(F.lit(0), F.least(F.lit(STEPS), x)), TIE) + tie).alias(f"k{i}") for i, x in enumerate(at)]
    return materialise(rows.select("doc_id", "size", "text_crc32", "h", *keys), "keyed")


def _log2(x: int | None) -> float:
    import math

    return math.log2(x) if x else 0.0


def _with(rows: DataFrame, values: dict[int, tuple], names: tuple[str, ...]) -> DataFrame:
    """rows with columns `names` from values[node]; null for other nodes."""
    if len(values) <= LITERALS:
        top = max(values, default=-1) + 1
        pick = lambda i: F.array(*[F.lit(values[n][i] if n in values else None).cast("long") for n in range(top)]) if top else F.array().cast("array<long>")
        return rows.select("*", *[F.try_element_at(pick(i), (F.col("node") + 1).cast("int")).alias(name) for i, name in enumerate(names)])
    table = session().createDataFrame([(n, *v) for n, v in values.items()], ", ".join(["__node long", *(f"{x} long" for x in names)]))
    return rows.join(F.broadcast(table), F.col("node") == F.col("__node"), "left").drop("__node")


def _medians(rows: DataFrame, wanted: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each node the last key of its lower part and that part's bytes: of the two cuts beside the place where
    wanted[node] bytes are reached, the nearer one. rows: node, key, size."""
    high: dict[int, tuple[int, int]] = {}
    out: dict[int, tuple[int, int]] = {}
    for step in (0, 1):
        if step:
            rows = _with(rows, {n: (h,) for n, (h, _) in high.items()}, ("__high",)).filter(F.shiftright("key", HALF) == F.col("__high")).drop("__high")
            bins = rows.select("node", (F.col("key") % (1 << HALF)).alias("bin"), "size")
        else:
            bins = rows.select("node", F.shiftright("key", HALF).alias("bin"), "size")
        sums = bins.groupBy("node", "bin").agg(F.sum("size").alias("w"))
        need = {n: (2 * (w - (high[n][1] if step else 0)),) for n, w in wanted.items()}  # doubled: halves stay whole
        sums = sums.withColumn("run", F.sum("w").over(Window.partitionBy("node").orderBy("bin")))
        found = _with(sums, need, ("__need",)).filter(F.col("run") * 2 >= F.col("__need")).groupBy("node").agg(F.min(F.struct("bin", "run", "w")).alias("m")).collect()
        for r in found:
            node, m = r["node"], r["m"]
            if not step:
                high[node] = (m["bin"], m["run"] - m["w"])
                continue
            base = high[node][1]
            upto, before = base + m["run"], base + m["run"] - m["w"]
            key = (high[node][0] << HALF) + m["bin"]
            out[node] = (key - 1, before) if before and wanted[node] - before < upto - wanted[node] else (key, upto)
    return out


def kd_shards(rows: DataFrame, shards: int) -> DataFrame:
    """rows (size, k0..) with their shard."""
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    leaves, done, level = {0: (0, shards)}, {}, 0  # node -> first shard, number of shards
    while True:
        done |= {n: s for n, s in leaves.items() if s[1] == 1}
        leaves = {n: s for n, s in leaves.items() if s[1] > 1}
        if not leaves:
            break
        placed = _with(rows, {n: (1,) for n in leaves}, ("__open",)).filter("__open = 1").drop("__open")
        ends = [f(f"k{i}").alias(f"{f.__name__}{i}") for i in range(len(DIMENSIONS)) for f in (F.min, F.max)]
        widest, total = {}, {}
        for r in placed.groupBy("node").agg(F.sum("size").alias("all"), *ends).collect():
            spans = [(r[f"max{i}"] >> TIE) - (r[f"min{i}"] >> TIE) for i in range(len(DIMENSIONS))]
            widest[r["node"]], total[r["node"]] = max(range(len(DIMENSIONS)), key=spans.__getitem__), r["all"]
        key = F.element_at(F.array(*[F.col(f"k{i}") for i in range(len(DIMENSIONS))]), (F.col("__dim") + 1).cast("int"))
        keyed = _with(placed, {n: (d,) for n, d in widest.items()}, ("__dim",)).select("node", key.alias("key"), "size")
        cuts = _medians(keyed, {n: w * (leaves[n][1] // 2) // leaves[n][1] for n, w in total.items()})
        after, moves, fresh = {}, {}, max([0, *leaves, *done]) + 1
        for n, (first, count) in leaves.items():
            if n not in cuts:  # no rows
                done[n] = (first, 1)
                continue
            cut, lower = cuts[n]
            left = min(count - 1, max(1, round(count * lower / total[n])))
            moves[n] = (widest[n], cut, fresh, fresh + 1)
            after[fresh], after[fresh + 1] = (first, left), (first + left, count - left)
            fresh += 2
        rows = _with(rows, moves, ("__dim", "__cut", "__low", "__high"))
        rows = rows.withColumn("node", F.when(F.col("__cut").isNull(), F.col("node")).when(key > F.col("__cut"), F.col("__high")).otherwise(F.col("__low"))).drop("__dim", "__cut", "__low", "__high")
        leaves, level = after, level + 1
        if level % WRITTEN == 0 or len(moves) > LITERALS:
            rows = materialise(rows, "nodes")
    return _with(rows, {n: (s[0],) for n, s in done.items()}, ("shard",)).withColumn("shard", F.col("shard").cast("int"))


@tidy
def shard(docs: DataFrame, shards: int = 16, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; target_bytes, if given, sets the number of shards."""
    if target_bytes:
        total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 1
        shards = max(1, -(-total // target_bytes))
    rows = kd_shards(points(docs, shards), shards).select("doc_id", "size", "text_crc32", "h", "shard")
    rows = materialise(rows, "shards")
    parts = max(1, rows.count() // (shards * WINDOW_ROWS) + 1)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "h"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "h", "size"))
    return rows.withColumn("nth", nth).join(counts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
