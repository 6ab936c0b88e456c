"""Shared pieces of the training-data operators: storage, skew-safe lookups, bit sets, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that end a word: \x20 and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"

#: Groups holding at least this share of all rows are looked up by broadcast: there are at most 1 / share.
HOT_SHARE = 1 / 1000


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where it is unset, a folder of this machine
    serves a local master (tests); on a cluster that is an error, since each executor would write to its own disk."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="hunkmill-")
        spark.sparkContext.setCheckpointDir(there)
        there = spark.sparkContext.getCheckpointDir() or there
    return there.rstrip("/")


#: Folders of the operators under way, innermost last; see tidy().
_open: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    base = _open[-1] if _open else f"{shared_dir(spark)}/llm"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df under the shared folder and reads it back: lineage ends here and lost executors lose nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tidy(make):
    """For a function that returns one narrow DataFrame: its result is written, the tables it wrote on the way are deleted."""

    @functools.wraps(make)
    def run(*args, **more):
        spark = session()
        work = scratch(spark, make.__name__)
        _open.append(work)
        try:
            out = make(*args, **more)
            _open.pop()
            return materialise(out, f"{make.__name__}-result")
        finally:
            if work in _open:
                del _open[_open.index(work):]
            discard(spark, work)
            trim()

    return run


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Joins each row to its group's one row of `groups` (inner, null keys match).

    Groups with at least HOT_SHARE of `total` rows, at most 1 / HOT_SHARE of them, are broadcast, so the
    rows of a hot key never meet in one task; all others are joined by a shuffle.
    """
    floor = max(64, int(total * HOT_SHARE))
    named = groups.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    mine = [f"__{k}" for k in keys]
    hot = F.broadcast(named.filter(F.col(size) >= floor))
    cold = named.filter(F.col(size) < floor)
    return (
        rows.join(hot, on, "inner").drop(*mine)
        .unionByName(rows.join(F.broadcast(named.filter(F.col(size) >= floor).select(*mine)), on, "left_anti").join(cold, on, "inner").drop(*mine))
    )


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Arrow batches of at most n rows for the jobs run inside: for rows of many kilobytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trim() -> None:
    """Gives freed memory back to the system; allocators would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """A mapInArrow function that trims its worker's memory at the end of its task: workers stay alive between tasks, and
    what their allocators keep is lost to other stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


#: Bits of one bitmap row of bitmap_construct_agg.
BITMAP_BITS = 32768
#: Bit sets up to this size (32 MB) are broadcast; larger ones are joined by bucket in a shuffle.
BROADCAST_BITS = 1 << 28


def bits_for(rows: int, per_row: int = 16, least: int = 1 << 20) -> int:
    """Size of a bit set for so many rows, a power of two: its share of set bits is the same at every size."""
    want = max(least, rows * per_row)
    return 1 << (want - 1).bit_length()


def bit_set(df: DataFrame, position: str) -> DataFrame:
    """Rows (bucket, bitmap) of the set of the given bit positions; at most bits / BITMAP_BITS rows of 4 KB."""
    return df.groupBy(F.expr(f"{position} div {BITMAP_BITS}").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col(position) % BITMAP_BITS).alias("bitmap")
    )


def has_bit(df: DataFrame, position: str, bits: DataFrame, size: int, into: str) -> DataFrame:
    """Adds the boolean column `into`: is the row's bit set? `bits` is a bit_set of `size` bits."""
    own = bits.select(F.col("bucket").alias("__b"), F.col("bitmap").alias("__m"))
    own = F.broadcast(own) if size <= BROADCAST_BITS else own.hint("merge")
    joined = df.join(own, F.expr(f"{position} div {BITMAP_BITS}") == F.col("__b"), "left")
    byte = F.expr(f"conv(hex(substring(__m, int(({position} % {BITMAP_BITS}) div 8) + 1, 1)), 16, 10)").cast("int")
    return joined.withColumn(into, F.coalesce(F.getbit(byte, (F.col(position) % 8).cast("int")) == 1, F.lit(False))).drop("__b", "__m")


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than texts) and the flat array of words [^\\x20\\x09-\\x0D]+; null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if lower:
        texts = pc.ascii_lower(texts if texts.offset == 0 else texts.take(pa.array(np.arange(len(texts)))))
    lists = pc.ascii_split_whitespace(texts)
    flat, ends = lists.flatten(), lists.offsets.to_numpy()
    ends = ends - ends[0]
    full = pc.not_equal(pc.binary_length(flat), 0)
    if not pc.all(full).as_py() and len(flat):
        mask = full.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(mask)])[ends]
        flat = flat.filter(full)
    return ends.astype(np.int64), flat


def pieces(batch: pa.RecordBatch, column: str, most: int = 4_000_000):
    """Copies of slices of a batch with about `most` bytes of text each; one longer text comes alone.

    Copies, since pyarrow's ascii_lower (23.0.1) garbles arrays that start inside their buffer.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.take(pa.array(np.arange(at, to)))
        at = to


@contextlib.contextmanager
def without_gc():
    """For loops that make many small lists and no cycles: the collector would only walk them again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
