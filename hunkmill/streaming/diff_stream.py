"""Diffs that arrive as files: each micro-batch runs the batch plan and replaces the metrics of its change sets.

A diff arrives whole, so there is no state between batches; change sets are matched by split_id. Tables are kept in buckets of
split_id, and a batch rewrites the buckets that it touches: a read costs what is current, however many batches came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..plans import engine
from ..sources import versions


def read(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """split_id, value of every new file below path."""
    files = spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", files_a_batch).text(path)
    return files.select(F.col("_metadata.file_path").alias("split_id"), "value").filter(F.trim("value") != "")


def start(diffs: DataFrame, out: str, checkpoint: str, target: int = fixed.TARGET_LINES, buckets: int = 64):
    """Merges patches and metrics of each micro-batch into versioned tables below `out`; a batch that runs again changes
    nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        p = engine.split(batch, target)
        for name, table in (("patches", p.patches), ("metrics", p.metrics)):
            versions.merge(table, f"{out}/{name}", "split_id", buckets, batch_id)
        p.close()

    return diffs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, name: str = "metrics") -> DataFrame | None:
    """The newest rows of each split_id; None before the first batch."""
    found = versions.read(spark, f"{out}/{name}")
    return None if found is None else found.drop("bucket")
