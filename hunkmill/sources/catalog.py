"""Scans of stored results and of recorded command output, each with a declared schema."""

from __future__ import annotations

import fnmatch
import itertools
import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from . import versions
from .gitstore import _open, entries


_SPLIT = ",".join(x.strip().replace(" ", ":", 1) for x in ("goal_summary string", "patches array<struct<id:int,name:string,filename:string,state:string>>"))


def files_below(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file_path, text of the files below path whose names match pattern, listed and read in tasks, level by level: the
    driver holds neither names nor texts. Listings are written below spark.checkpoint.dir, or beside path."""
    glob = re.compile(fnmatch.translate(pattern))
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or path.rstrip("/") + ".listed"
    base = f"{base.rstrip('/')}/listed-{uuid.uuid4().hex}"

    def listed(batches):
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                names = (x for x in entries(folder) if x[1] or glob.match(x[0].rpartition("/")[2]))
                while part := list(itertools.islice(names, 10_000)):
                    yield pa.record_batch({"path": pa.array([x[0] for x in part], pa.string()), "folder": pa.array([x[1] for x in part], pa.bool_())})

    def read(batches):
        for batch in batches:
            for paths in (batch.column("path").slice(i, 64).to_pylist() for i in range(0, len(batch), 64)):
                texts = []
                for p in paths:
                    system, name = _open(p)
                    with system.open_input_stream(name) as f:
                        texts.append(f.read())
                yield pa.record_batch({"file_path": pa.array(paths, pa.string()), "text": pa.array(texts, pa.binary())})

    levels, folders = [], spark.createDataFrame([(path.rstrip("/"),)], "path string")
    while folders.head(1):
        levels.append(f"{base}/{len(levels)}")
        # One name a row, dealt anew: a wide folder's children are read by many tasks.
        folders.mapInArrow(listed, "path string, folder boolean").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))).write.parquet(levels[-1])
        folders = spark.read.schema("path string, folder boolean").parquet(levels[-1]).filter("folder").select("path")
    found = spark.read.schema("path string, folder boolean").parquet(*levels).filter("not folder").select("path")
    return found.mapInArrow(read, "file_path string, text binary").withColumn("text", F.col("text").cast("string"))


def split_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row for each folder below path: its first metadata_*.json; unreadable files are left out."""
    raw = files_below(spark, path, "metadata_*.json")
    schema = StructType.fromDDL(f"{schemas.SPLIT_METADATA}, _corrupt string")
    rows = raw.select("file_path", F.from_json("text", schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("m")).select("file_path", "m.*").filter("_corrupt is null").drop("_corrupt")
    rows = rows.withColumn("split_id", F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1))
    nth = F.row_number().over(Window.partitionBy("split_id").orderBy("file_path"))
    return rows.withColumn("nth", nth).filter("nth = 1").drop("nth", "file_path")


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews of all *.json below path, with defaults where fields are absent."""
    raw = spark.read.schema(f"{schemas.REVIEW}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    rows = raw.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified")).filter("_corrupt is null")
    stem = F.regexp_extract("file_path", r"([^/]+)\.json$", 1)
    return rows.select(
        F.coalesce("id", stem).alias("id"), F.coalesce("title", stem).alias("title"), F.coalesce("status", F.when(F.col("archived"), "archived").otherwise("complete")).alias("status"), "repository",
        F.coalesce(F.try_to_timestamp("created_at"), "modified").alias("created_at"), "summary", F.coalesce(F.size("issues"), F.lit(0)).alias("n_issues"),
    )


def pulls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PULL).option("multiLine", "true").json(path)


def configured_repositories(spark: SparkSession, config: dict) -> DataFrame:
    """name, path, description of a configuration: `repositories` at the top, else under `source`."""
    rows = config.get("repositories") or config.get("source", {}).get("repositories") or []
    return spark.createDataFrame([(r.get("name"), r.get("path"), r.get("description")) for r in rows], "name string, path string, description string")


def commit_log(lines: DataFrame) -> DataFrame:
    """sha, short, author, email, at, relative, message of lines (value) with | between; a | in the message stays."""
    parts = F.split("value", r"\|", 7)
    names = ("sha", "short", "author", "email", "at", "relative", "message")
    return lines.filter(F.trim("value") != "").select(*[F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def commit_info(records: DataFrame) -> DataFrame:
    """sha, author, email, date, committer, committer_email, subject, body of records (value) with a field a line; the body keeps its lines."""
    parts = F.split("value", "\n", 8)
    names = ("sha", "author", "email", "date", "committer", "committer_email", "subject", "body")
    return records.select(*[F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(names)])


def status(lines: DataFrame) -> DataFrame:
    """file, state of porcelain lines (value): staged, unstaged or untracked; a file may be staged and unstaged."""
    x, y = F.substring("value", 1, 1), F.substring("value", 2, 1)
    states = F.array_compact(F.array(F.when(~x.isin(" ", "?"), "staged"), F.when(~y.isin(" ", "?"), "unstaged"), F.when((x == "?") & (y == "?"), "untracked")))
    return lines.filter(F.char_length("value") > 3).select(F.substring("value", 4, 1 << 30).alias("file"), F.explode(states).alias("state"))


def branches(lines: DataFrame) -> DataFrame:
    """name, current of branch list lines (value)."""
    return lines.filter(F.trim("value") != "").select(F.trim(F.regexp_replace("value", r"^\*", "")).alias("name"), F.startswith("value", F.lit("*")).alias("current"))


def remotes(lines: DataFrame) -> DataFrame:
    """owner, repo, name of remote lines (pos, value): the first of each owner and repository."""
    pattern = r"^(\S+)\s+\S*github\.com[:/]([^/\s]+)/([^/\s]+?)(?:\.git)?(?:\s|$)"
    got = lambda i: F.regexp_extract("value", pattern, i)
    rows = lines.select("pos", got(1).alias("name"), got(2).alias("owner"), got(3).alias("repo")).filter("owner <> ''")
    return rows.groupBy("owner", "repo").agg(F.min_by("name", "pos").alias("name"))


def patch_by_name(patches: DataFrame, split_id: str, filename: str) -> DataFrame:
    """The patch of a split by file name; a doubled .patch is taken as one, the name as given comes second."""
    plain = filename.replace(".patch.patch", ".patch")
    hit = F.when(F.col("filename") == plain, 0).when(F.col("filename") == filename, 1)
    rows = patches.filter(F.col("split_id") == split_id).withColumn("hit", hit).filter("hit is not null")
    return rows.orderBy("hit").limit(1).drop("hit")


def snapshot(commits: DataFrame, path: str, n: int = 50) -> DataFrame:
    """Makes the newest n commits of each repository and branch the listing's snapshot and reads it back; readers see the
    rows before or the new ones, never a part."""
    nth = F.row_number().over(Window.partitionBy("repo", "branch").orderBy(F.desc("at"), "sha"))
    versions.replace(commits.withColumn("nth", nth).filter(F.col("nth") <= n).drop("nth"), path, "repo", whole=True)
    return versions.read(commits.sparkSession, path)


def read_config(path: str) -> dict:
    """A configuration file: JSON, or YAML where its reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML needs the yaml package") from error
    return yaml.safe_load(text) or {}


def current_branch(lines: DataFrame) -> DataFrame:
    """repository, branch of rows (repository, value, failed) of the command that tells it: HEAD where it failed."""
    name = F.regexp_replace(F.coalesce("value", F.lit("")), r"^\s+|\s+$", "")
    return lines.select("repository", F.when(F.coalesce("failed", F.lit(False)) | (name == ""), "HEAD").otherwise(name).alias("branch"))


def untracked_files(lines: DataFrame) -> DataFrame:
    """Files listed one a line (value); blank lines are none."""
    return lines.filter(F.trim("value") != "").select(F.col("value").alias("file"))


def bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """commits and patches (commit_id, filename, content) of a bundled file that stands for the service: JSON with a list
    `commits` and a map `patches` keyed by commit/filename."""
    rows = spark.read.schema(f"commits array<struct<id:string,message:string,metadata:struct<{_SPLIT}>>>, patches map<string,string>").option("multiLine", "true").json(path)
    commits = rows.select(F.explode("commits").alias("c")).select("c.*")
    each = rows.select(F.explode("patches").alias("key", "content"))
    cut = F.length("key") - F.length(F.substring_index("key", "/", -1))
    return commits, each.select(F.substring("key", F.lit(1), (cut - 1).cast("int")).alias("commit_id"), F.substring_index("key", "/", -1).alias("filename"), "content")


def commit_rows(commits: DataFrame) -> DataFrame:
    """The columns of a listed commit, with their defaults."""
    return commits.select(F.col("id"), F.coalesce("message", F.lit("")).alias("message"), F.coalesce(F.col("metadata.goal_summary"), F.lit("")).alias("goal"), F.coalesce(F.size(F.filter(F.col("metadata.patches"), lambda p: ~p["state"].eqNullSafe("deleted"))), F.lit(0)).alias("patches"))


def repository_rows(repos: DataFrame) -> DataFrame:
    return repos.select("name", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("description", F.lit("")).alias("description"))


def pull_rows(pulls: DataFrame) -> DataFrame:
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("additions", "deletions", "changed_files")]
    return pulls.select("owner", "repo", "number", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("author", F.lit("unknown")).alias("author"), F.coalesce("state", F.lit("open")).alias("state"), "updated_at", *zero)


def write_progress(rows: DataFrame, path: str, repository: str) -> None:
    """Makes one repository's rows of a snapshot current, in place of what it had there and nothing else: a run that is
    repeated, or ends half-way, leaves whole repositories."""
    versions.replace(rows.filter(F.col("repo") == repository), path, "repo")
