"""Tables that are replaced while others read them: written aside, then made current by one small file.

A table is a folder with `data`, where every write has a folder of its own, and `log`, with a numbered file for each
version that names the folders of its parts. A writer claims the next number by creating a file that must not exist, so of
two writers one fails; a claim whose writer died is given up by forget(). A writer names the version only when its rows are whole. Readers take the highest named version: they
see the old rows or the new ones, and a writer that dies leaves the old ones. Parts that a write doesn't touch stay where
they are, so the cost of a read follows the rows that are current, not the number of writes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has made a version since the one that this write builds on."""


@dataclass
class Version:
    number: int = 0
    #: of the last batch that was merged; batches up to it change nothing
    batch: int = -1
    #: folder of each part
    parts: dict[str, str] = field(default_factory=dict)
    schema: dict | None = None


class _Files:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.system = self.at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        there = self.at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self.system.listStatus(there)) if self.system.exists(there) else []

    def claim(self, name: str) -> bool:
        self.system.mkdirs(self.at(f"{self.path}/log"))
        try:
            return self.system.createNewFile(self.at(f"{self.path}/log/{name}"))
        except Exception as error:  # some stores raise instead
            if "exist" in str(error).lower():
                return False
            raise

    def put(self, name: str, text: str) -> None:
        """Writes a file aside and moves it into place, so that none is read half."""
        aside = self.at(f"{self.path}/log/.{name}.{uuid.uuid4().hex}")
        out = self.system.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.system.rename(aside, self.at(f"{self.path}/log/{name}")):
            raise RuntimeError(f"{name} could not be put in place")

    def read(self, name: str) -> str:
        stream = self.system.open(self.at(f"{self.path}/log/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, folder: str) -> None:
        self.system.delete(self.at(f"{self.path}/{folder}"), True)


def version(spark: SparkSession, path: str) -> Version:
    """The current version; number 0 with no parts where nothing was written."""
    files = _Files(spark, path)
    named = [n for n in files.names("log") if n.endswith(".json") and not n.startswith(".")]
    return Version(**json.loads(files.read(named[-1]))) if named else Version()


def read(spark: SparkSession, path: str, at: Version | None = None) -> DataFrame | None:
    """The rows of a version, the current one by default; None where nothing was written."""
    at = at or version(spark, path)
    if at.schema is None:
        return None
    schema = StructType.fromJson(at.schema)
    folders = [f"{path.rstrip('/')}/{p}" for p in sorted(at.parts.values())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def replace(rows: DataFrame, path: str, by: str | None = None, after: Version | None = None, batch: int | None = None, whole: bool = False, keep: int = 2) -> Version:
    """Makes rows the current ones of their parts and returns the new version. by: the column whose values are parts, all of
    one part if None; with `whole` parts without rows go. after: the version that this builds on, the current one by
    default. batch: a number that is stored; up to the stored one nothing is done. keep: versions whose rows stay."""
    spark = rows.sparkSession
    files = _Files(spark, path)
    base = after or version(spark, path)
    if batch is not None and batch <= base.batch:
        return base
    mine = f"data/{uuid.uuid4().hex}"
    aside = rows.withColumn("__part", F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("all"))
    # hex, since a part's name may hold any character
    aside.withColumn("__part", F.hex(F.col("__part").cast("binary"))).write.partitionBy("__part").parquet(f"{files.path}/{mine}")
    own = {n.removeprefix("__part="): f"{mine}/{n}" for n in files.names(mine) if n.startswith("__part=")}
    parts = own if whole or by is None else base.parts | own
    new = Version(base.number + 1, base.batch if batch is None else batch, parts, rows.schema.jsonValue())
    if version(spark, path).number != base.number or not files.claim(f"{new.number:012d}.claim"):
        files.delete(mine)
        raise Conflict(f"version {new.number} of {path} is another writer's")
    files.put(f"{new.number:012d}.json", json.dumps(new.__dict__))
    _clear(files, keep)
    return new


def forget(spark: SparkSession, path: str) -> None:
    """Gives up claims above the current version, after their writers are known to be dead."""
    files, now = _Files(spark, path), version(spark, path).number
    for name in files.names("log"):
        if name.endswith(".claim") and int(name.removesuffix(".claim")) > now:
            files.delete(f"log/{name}")


def _clear(files: _Files, keep: int) -> None:
    """Deletes old versions, and folders of rows that none of the last `keep` versions names and no writer is at work on."""
    named = [n for n in files.names("log") if n.endswith(".json") and not n.startswith(".")]
    for name in named[:-keep]:
        old = Version(**json.loads(files.read(name)))
        kept = {p for n in named[-keep:] for p in json.loads(files.read(n))["parts"].values()}
        for folder in set(old.parts.values()) - kept:
            files.delete(folder)
        files.delete(f"log/{name}")


def merge(rows: DataFrame, path: str, key: str, buckets: int = 64, batch: int | None = None) -> Version:
    """Replaces all rows of the keys that occur in rows, in the buckets of the key's hash that they fall in; the other buckets
    are not read. A batch that was merged before changes nothing."""
    spark = rows.sparkSession
    base = version(spark, path)
    if batch is not None and batch <= base.batch:
        return base
    new = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [str(r[0]) for r in new.select("bucket").distinct().collect()]
    names = {b: b.encode().hex().upper() for b in touched}
    held = {names[b]: base.parts[names[b]] for b in touched if names[b] in base.parts}
    if held:
        before = read(spark, path, Version(base.number, base.batch, held, base.schema))
        new = before.join(rows.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)
    return replace(new.repartition(F.col("bucket")), path, "bucket", base, batch)
