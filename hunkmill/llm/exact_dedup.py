"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass one hashes every text to two bits of a filter (16 bits a row) and keeps the bits that two or more rows hit.
Pass two probes it: a row with a bit nobody else hit has no equal and passes straight through; only the
others, possibly repeated, are shuffled (without their texts) and grouped by SHA-256. A filter up to 32 MB (17 million
rows) is broadcast; a larger one grows with the rows all the same and is joined by hash range in a shuffle.

Texts are equal when identical after deleting \\x20 and \\x09-\\x0D. Defined cases: null text counts as empty,
and empty and all-blank texts equal one another; a text of any length counts whole; ties in length go to the
smallest doc_id (of any type that has an order), a null doc_id last; a row repeated with the same id and text counts each time in group_size and is kept once; an empty table gives
an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bit_set, bits_for, has_bit, materialise, tidy, with_groups


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def repeated_bits(hashes: DataFrame, bits: int) -> DataFrame:
    """Filter of the bits that at least two rows of `hashes` (h) hit; counts are combined before the shuffle."""
    at = hashes.select(F.explode(F.array(*positions(F.col("h"), bits))).alias("at"))
    return bit_set(at.groupBy("at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "at")


def positions(h: Column, bits: int) -> list[Column]:
    return [F.pmod(h, F.lit(bits)), F.pmod(F.xxhash64(h), F.lit(bits))]


def possibly_repeated(df: DataFrame, filter_bits: DataFrame, bits: int) -> DataFrame:
    """df with column h, plus the boolean column candidate."""
    one, two = positions(F.col("h"), bits)
    df = df.withColumn("__p1", one).withColumn("__p2", two)
    df = has_bit(has_bit(df, "__p1", filter_bits, bits, "__c1"), "__p2", filter_bits, bits, "__c2")
    return df.withColumn("candidate", F.col("__c1") & F.col("__c2")).drop("__p1", "__p2", "__c1", "__c2")


def _filter(docs: DataFrame, filter_bits: int | None) -> tuple[DataFrame, int]:
    bits = filter_bits or bits_for(docs.select(F.lit(1)).count())
    return repeated_bits(docs.select(F.xxhash64(normalised(F.col("text"))).alias("h")), bits), bits


#: Which row of equal texts stays: most code points, then smallest doc_id, null last.
def _rank(doc_id: str, n_code: str, *more: Column) -> Column:
    return F.struct((-F.col(n_code)).alias("less"), F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), *more)


@tidy
def dedup_report(docs: DataFrame, filter_bits: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text)."""
    seen, bits = _filter(docs, filter_bits)
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"), F.coalesce(F.char_length("text"), F.lit(0)).alias("n_code"))
    # Texts end here: a filter too large to broadcast is met by narrow rows alone.
    norm = norm.select("doc_id", "n_code", F.xxhash64("norm").alias("h"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    rows = materialise(possibly_repeated(norm, seen, bits).drop("h"), "dedup")
    alone = rows.filter(~F.col("candidate")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = rows.filter("candidate").groupBy("text_sha256", "doc_id", "n_code").agg(F.count(F.lit(1)).alias("copies"))
    best = some.groupBy("text_sha256").agg(F.sum("copies").alias("group_size"), F.min(_rank("doc_id", "n_code")).alias("best"))
    best = best.select("text_sha256", "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("keep_len"))
    found = with_groups(some, best, ["text_sha256"], "group_size", rows.count())
    found = found.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_code") == F.col("keep_len")) & (F.col("__nth") == 1)
    return alone.unionByName(found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, filter_bits: int | None = None) -> DataFrame:
    """The rows of docs that dedup_report keeps, with all their columns; unrepeated texts are never shuffled, and of
    the others each task sends the best row of a text on. Of rows with one id and length the least text stays."""
    seen, bits = _filter(docs, filter_bits)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(normalised(F.col("text"))).alias("h"))
    rows = possibly_repeated(rows, seen, bits)
    some = rows.filter("candidate").select(
        "row", F.col("row.doc_id").alias("doc_id"), F.coalesce(F.char_length("row.text"), F.lit(0)).alias("n_code"),
        F.sha2(normalised(F.col("row.text")).cast("binary"), 256).alias("text_sha256"),
    )
    won = some.groupBy("text_sha256").agg(F.min_by("row", _rank("doc_id", "n_code", F.col("row.text").alias("text"))).alias("row"))
    return rows.filter(~F.col("candidate")).select("row.*").unionByName(won.select("row.*"))
