"""A query over an object store that Spark writes from documents: two versions of a tree of files, then their diff."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import diffs, gitstore
from .adapters import letters, table
from .queries import query

#: Files of a folder.
PER_FOLDER = 64


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, of this machine for a local master alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="hunkmill-")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


def _put(root: str, kind: str):
    """Writes the column `data` as objects; the other columns stay, with the object's id."""

    def run(batches):
        for batch in batches:
            ids = []
            for data in batch.column("data").to_pylist():
                oid, stored = gitstore.loose(kind, data)
                system, base = gitstore._open(f"{root}/objects")
                system.create_dir(f"{base}/{oid[:2]}", recursive=True)
                name = f"{base}/{oid[:2]}/{oid[2:]}"
                own = f"{name}.{uuid.uuid4().hex}"  # tasks that run twice put the same file in place
                with system.open_output_stream(own) as f:
                    f.write(stored)
                system.move(own, name)
                ids.append(oid)
            kept = [c for c in batch.schema.names if c != "data"]
            yield pa.record_batch({**{c: batch.column(c) for c in kept}, "oid": pa.array(ids, pa.string())})

    return run


#: Bytes of the objects of a pack.
PACKED = 32 << 20


def _pack(root: str, kind: str):
    """Like _put(), but in packs: the number of files grows with the bytes, not with the objects."""

    def write(held: list) -> None:
        name, pack, index = gitstore.pack(held)
        system, base = gitstore._open(f"{root}/objects/pack")
        system.create_dir(base, recursive=True)
        for end, data in (("pack", pack), ("idx", index)):  # readers list indexes, so those come last
            own = f"{base}/{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(own) as f:
                f.write(data)
            system.move(own, f"{base}/pack-{name}.{end}")

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = []
            for data in batch.column("data").to_pylist():
                ids.append(gitstore.oid_of(kind, data))
                held.append((kind, data))
                size += len(data)
                if size > PACKED:
                    write(held)
                    held, size = [], 0
            kept = [c for c in batch.schema.names if c != "data"]
            yield pa.record_batch({**{c: batch.column(c) for c in kept}, "oid": pa.array(ids, pa.string())})
        if held:
            write(held)

    return run


def _tree(entries: DataFrame, root: str, *keys: str) -> DataFrame:
    """The tree objects of entries (keys, mode, name, oid), one for each of the keys."""
    part = F.concat(F.concat_ws(" ", "mode", "name").cast("binary"), F.unhex(F.lit("00")), F.unhex("oid"))
    order = F.when(F.col("mode") == gitstore.FOLDER, F.concat("name", F.lit("/"))).otherwise(F.col("name"))
    parts = entries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), part.alias("part")))).alias("parts"))
    data = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["part"]))
    return parts.select(*keys, data.alias("data")).mapInArrow(_put(root, "tree"), ", ".join(f"{k} {dict(entries.dtypes)[k]}" for k in keys) + ", oid string")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, side (old or new), text: a word a line. By doc_id mod 5: a line at the top, gone, new, a line at the end, the same."""
    words = F.filter(F.split(letters(F.coalesce("text", F.lit(""))), " "), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(5)).alias("way"), F.explode(F.array(words)).alias("w"))
    new = F.when(F.col("way") == 0, F.concat(F.array(F.lit("0 first")), "w")).when(F.col("way") == 3, F.concat("w", F.array(F.lit("0 extra")))).otherwise(F.col("w"))
    both = F.array(F.struct(F.lit("old").alias("side"), F.col("w").alias("lines")), F.struct(F.lit("new").alias("side"), new.alias("lines")))
    rows = rows.select("doc_id", "way", F.explode(both).alias("v")).filter("not (way = 1 and v.side = 'new') and not (way = 2 and v.side = 'old')")
    text = F.array_join(F.transform("v.lines", lambda x: F.concat(x, F.lit("\n"))), "")
    return rows.select("doc_id", F.col("v.side").alias("side"), text.alias("text"))


@query(f"""
WITH d AS (SELECT doc_id, doc_id % 5 AS way, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z ]+', '', 'g'), ' '), lambda x: x <> '')) AS n FROM documents)
SELECT 'd' || doc_id // {PER_FOLDER} || '/f' || doc_id || '.txt' AS path, CASE way WHEN 1 THEN 'deleted' WHEN 2 THEN 'added' ELSE 'modified' END AS status,
       CAST(CASE way WHEN 1 THEN 0 WHEN 2 THEN n ELSE 1 END AS BIGINT) AS added, CAST(CASE way WHEN 1 THEN n ELSE 0 END AS BIGINT) AS deleted FROM d WHERE way <> 4""")
def ref_diffs(spark, sf_dir):
    """The diff of two trees of an object store, a file for each document."""
    root = shared_folder(spark)
    blobs = _versions(spark, sf_dir).select("doc_id", "side", F.col("text").cast("binary").alias("data")).mapInArrow(_pack(root, "blob"), "doc_id long, side string, oid string")
    folder = F.concat(F.lit("d"), F.expr(f"doc_id div {PER_FOLDER}").cast("string"))
    files = blobs.select("side", folder.alias("folder"), F.lit("100644").alias("mode"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "oid")
    folders = _tree(files, root, "side", "folder").select("side", F.lit(gitstore.FOLDER).alias("mode"), F.col("folder").alias("name"), "oid")
    tops = {r.side: r.oid for r in _tree(folders, root, "side").collect()}
    pairs = spark.createDataFrame([("s", tops["old"], tops["new"])] if len(tops) == 2 else [], "split_id string, base string, head string")
    store = gitstore.stored(gitstore.objects(spark, root), f"{root}/work")
    found = gitstore.changed_files(store, pairs, f"{root}/work")
    name = F.col("path").cast("string")
    status = F.when(F.col("new_oid").isNull(), "deleted").when(F.col("old_oid").isNull(), "added").otherwise("modified")
    each = gitstore.file_diffs(store, found).select(name.alias("split_id"), F.col("diff").alias("value"))
    counts = diffs.parse_diffs(each).groupBy(F.col("split_id").alias("path")).agg(F.sum("added_lines").alias("added"), F.sum("deleted_lines").alias("deleted"))
    rows = found.select(name.alias("path"), status.alias("status")).join(counts, "path", "left")
    return rows.select("path", "status", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("added", "deleted")])
