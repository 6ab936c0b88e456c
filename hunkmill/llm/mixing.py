"""Mixing sources to target weights by capped water-filling.

Each source gets budget in proportion to its weight; a source whose share exceeds `epochs` times its words is
clamped there and the excess goes to the others by weight, again and again until none is above. Documents are then
repeated whole floor(target / words) times, and the fractional repetition goes to documents in a seeded hash
order until the target is met; the document on the line is taken in part.

Defined cases: null or blank text has size 0 and takes nothing; a text of any length counts whole; a null source is a
source of its own, last; a source without words gets target 0; repeated rows are rows of their own (equal ids follow
in any order with the same total); ties in the seeded order go by id and size; an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, tidy, with_groups

#: Weights of the sources in code-point order, repeating (fixed by the contract of the query).
WEIGHTS = (3, 1, 2)
#: Up to so many sources their table (about 60 bytes a row) is broadcast; beyond, large ones are and the rest is shuffled.
BROADCAST_SOURCES = 50_000
#: Rows that a slice of the seeded order should hold; one slice of a source is ordered row by row.
SLICE_ROWS = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float, epochs: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size, ...), one row each, plus weight and target.

    Sources above their cap at the present level are clamped and the excess raises the level of the others, until none
    is above: a few sums over the sources, each clamping one more at least. Only the weights' turn by code point needs
    one window, over one narrow row a source.
    """
    last = Window.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), "source")
    nth = (F.row_number().over(last) - 1) % len(weights)
    out = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int")))
    out = materialise(out.withColumn("cap", F.col("source_size") * F.lit(float(epochs))), "mix-weights")
    level = 0.0
    while True:
        # Caps reached at the level stay reached, since the level only rises.
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        r = out.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("clamped"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        new = (share * r["all"] - (r["clamped"] or 0.0)) / r["open"]
        if new <= level:
            break
        level = new
    return out.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight"))).drop("cap")


def _rows(docs: DataFrame, seed: int, slices: int, *more: Column) -> DataFrame:
    """doc_id, source, size, the seeded order (62 bits) and its slice, the leading bits, of every row of docs: so the
    order is the same for any number of slices."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")).bitwiseAND(F.lit((1 << 62) - 1))
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order.alias("order"), *more)
    return rows.withColumn("slice", F.shiftright("order", 62 - (slices.bit_length() - 1)).cast("int"))


def slices_for(docs: DataFrame) -> int:
    """A power of two, so that a slice of all rows has about SLICE_ROWS."""
    return 1 << max(0, (docs.select(F.lit(1)).count() // SLICE_ROWS).bit_length())


def plan(rows: DataFrame, share: float, epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """For each source (s_source): source_size, target, whole repetitions, words of the fractional one (part), and
    the slice (cut) in which it ends, with the words before that slice."""
    slices = materialise(rows.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mix-slices")
    totals = materialise(slices.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_rows")), "mix-totals")
    sources = water_fill(totals, share, epochs, weights)
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    sources = sources.withColumn("whole", whole.cast("long")).withColumn("part", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    sources = materialise(sources.select(F.col("source").alias("s_source"), "n_rows", "source_size", "target", "whole", "part"), "mix-sources")
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    cut = slices.join(sources, F.col("source").eqNullSafe(F.col("s_source"))).filter("before < part and part <= before + words")
    cut = cut.select(F.col("source").alias("c_source"), F.col("slice").alias("cut"), "before")
    return materialise(sources.join(cut, F.col("s_source").eqNullSafe(F.col("c_source")), "left").drop("c_source"), "mix-cuts")


def take(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with their source's plan and `extra`, the words of the fractional repetition taken from each."""
    if sources.count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s_source")))
    else:
        rows = with_groups(rows, sources.withColumnRenamed("s_source", "source"), ["source"], "n_rows", sources.agg(F.sum("n_rows")).first()[0])
    # Only the slice on the line of each source is ordered row by row, by ids alone.
    on_line = F.coalesce(F.col("slice") == F.col("cut"), F.lit(False))
    so_far = Window.partitionBy("source", "slice").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sliced = rows.filter(on_line).withColumn("room", F.col("part") - F.col("before") - F.coalesce(F.sum("size").over(so_far), F.lit(0)))
    sliced = sliced.withColumn("extra", F.greatest(F.lit(0), F.least("size", "room"))).drop("room")
    others = rows.filter(~on_line).withColumn("extra", F.when(F.coalesce(F.col("slice") < F.col("cut"), F.lit(False)), F.col("size")).otherwise(0))
    return sliced.unionByName(others)


@tidy
def mix(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, source, text)."""
    rows = materialise(_rows(docs, seed, slices_for(docs)), "mix")
    return take(rows, plan(rows, share, epochs, weights)).select(
        "doc_id", "source", F.col("size").cast("long"), F.col("source_size").cast("long"), "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken")
    )


@tidy
def _cuts(docs: DataFrame, slices: int, share: float, epochs: float, weights: tuple[float, ...], seed: int) -> DataFrame:
    """s_source, whole, and the order and id (last) up to which a document has one repetition more."""
    rows = materialise(_rows(docs, seed, slices), "mix")
    sources = plan(rows, share, epochs, weights)
    more = take(rows, sources).filter((F.col("extra") * 2 >= F.col("size")) & (F.col("extra") > 0))
    last = more.groupBy(F.col("source").alias("l_source")).agg(F.max(F.struct("order", "doc_id", "size")).alias("last"))
    return sources.join(last, F.col("s_source").eqNullSafe(F.col("l_source")), "left").select("s_source", "whole", "last", "n_rows")


def repeat_documents(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all its columns and its whole text.

    The one document of a source that the line cuts is taken whole where at least half of it is; documents without
    words, which no target asks for, stay once. Texts are not shuffled while the table of sources can be broadcast.
    """
    slices = slices_for(docs)
    cuts = _cuts(docs, slices, share, epochs, weights, seed)
    rows = _rows(docs, seed, slices, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if cuts.count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(cuts), F.col("source").eqNullSafe(F.col("s_source")))
    else:
        rows = with_groups(rows, cuts.withColumnRenamed("s_source", "source"), ["source"], "n_rows", cuts.agg(F.sum("n_rows")).first()[0])
    once_more = F.coalesce(F.struct("order", "doc_id", "size") <= F.col("last"), F.lit(False))
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("whole") + once_more.cast("int")).cast("int")
    # One copy at a time: an array of copies would hold a long text several times.
    return rows.filter(times > 0).select("row", F.explode(F.sequence(F.lit(1), times))).select("row.*")
