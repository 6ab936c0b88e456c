"""Queries over files that Spark writes from the tables and the scans read back: patches, split folders, reviews, bundles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import splitting
from ..sources import catalog as scans
from ..sources import diffs
from ..sources.gitstore import _open
from . import adapters
from .adapters import cte, table
from .queries import joined, query
from .store_queries import shared_folder


def _write(rows: DataFrame, root: str) -> None:
    """Writes a file for each of rows (path, text) below root."""

    def run(batches):
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                system, whole = _open(f"{root}/{path}")
                system.create_dir(whole.rpartition("/")[0], recursive=True)
                with system.open_output_stream(whole) as f:
                    f.write(text.encode())
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    rows.select("path", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _text(column: str) -> F.Column:
    return F.col(column).cast("string")


@query("""
WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents WHERE text IS NOT NULL)
SELECT CAST(doc_id AS VARCHAR) AS name, md5('+' || line) AS digest FROM t""")
def scanned_patches(spark, sf_dir):
    """A file of text for each document, in folders, blank ones left out."""
    root = shared_folder(spark)
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    body = F.concat(F.lit("+"), F.element_at(F.split("text", "\n"), 1))
    blank = rows.select(F.concat(F.lit("blank/b"), _text("doc_id"), F.lit(".diff")).alias("path"), F.lit("  ").alias("text"))
    _write(rows.select(F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), _text("doc_id"), F.lit(".diff")).alias("path"), body.alias("text")).unionByName(blank), root)
    found = diffs.scan_patches(spark, root)
    return found.select(F.regexp_extract("split_id", r"([^/]+)\.diff$", 1).alias("name"), F.md5(F.col("value").cast("binary")).alias("digest"))


@query("""SELECT 'split_' || c_custkey AS split_id, CAST(c_custkey % 9 AS INTEGER) AS total_patches, c_mktsegment AS goal_summary, CAST(len(range(c_custkey % 3)) AS INTEGER) AS n_patches, c_name AS repository FROM customer WHERE c_custkey % 5 <> 0""")
def scanned_splits(spark, sf_dir):
    """A folder for each customer with one or two metadata files, the first of which counts; broken ones are left out."""
    root = shared_folder(spark)
    rows = table(spark, sf_dir, "customer")
    patches = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<struct<id:int>>")).otherwise(F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 3).cast("int")), lambda i: F.struct(i.alias("id"))))
    text = F.to_json(F.struct((F.col("c_custkey") % 9).cast("int").alias("total_patches"), F.col("c_mktsegment").alias("goal_summary"), F.struct(F.col("c_name").alias("name")).alias("repository"), patches.alias("patches")))
    folder = F.concat(F.lit("split_"), _text("c_custkey"), F.lit("/metadata_"))
    first = rows.select(F.concat(folder, F.lit("1.json")).alias("path"), F.when(F.col("c_custkey") % 5 == 0, F.lit("{broken")).otherwise(text).alias("text"))
    again = rows.filter("c_custkey % 4 = 1").filter("c_custkey % 5 <> 0").select(F.concat(folder, F.lit("2.json")).alias("path"), F.lit('{"total_patches": 99}').alias("text"))
    _write(first.unionByName(again), root)
    return scans.split_metadata(spark, root).select("split_id", "total_patches", "goal_summary", F.size("patches").alias("n_patches"), F.col("repository.name").alias("repository"))


@query("""SELECT CASE s_suppkey % 3 WHEN 0 THEN 'r' || s_suppkey ELSE 'file' || s_suppkey END AS id, CASE s_suppkey % 2 WHEN 0 THEN s_name ELSE 'file' || s_suppkey END AS title,
       CASE s_suppkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'archived' ELSE 'complete' END AS status, CAST(s_suppkey % 3 AS INTEGER) AS n_issues FROM supplier""")
def scanned_reviews(spark, sf_dir):
    """A review of each supplier as JSON, with fields left out that have defaults."""
    root = shared_folder(spark)
    key = F.col("s_suppkey")
    issues = F.when(key % 3 != 0, F.transform(F.sequence(F.lit(1), (key % 3).cast("int")), lambda i: F.struct(i.alias("line"))))
    text = F.to_json(F.struct(
        F.when(key % 3 == 0, F.concat(F.lit("r"), _text("s_suppkey"))).alias("id"), F.when(key % 2 == 0, F.col("s_name")).alias("title"), F.when(key % 4 == 0, F.lit("open")).alias("status"),
        (key % 4 == 1).alias("archived"), issues.alias("issues"),
    ))
    _write(table(spark, sf_dir, "supplier").select(F.concat(F.lit("file"), _text("s_suppkey"), F.lit(".json")).alias("path"), text.alias("text")), root)
    return scans.reviews(spark, root).select("id", "title", "status", "n_issues")


@query("""
WITH l AS (SELECT n_nationkey AS pos, 'own' || n_regionkey AS owner, lower(replace(n_name, ' ', '-')) AS repo, 'rem' || n_nationkey AS name FROM nation)
SELECT owner, repo, name FROM l""")
def remote_lines(spark, sf_dir):
    """Remotes: each owner and repository once, by both forms of address; lines of other hosts are left out."""
    rows = table(spark, sf_dir, "nation")
    repo = F.concat(F.lit("own"), _text("n_regionkey"), F.lit("/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))))
    name = F.concat(F.lit("rem"), _text("n_nationkey"), F.lit("\t"))
    both = F.array(
        F.struct((F.col("n_nationkey") * 3).alias("pos"), F.concat(name, F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("git@github.com:"), repo, F.lit(".git"))).otherwise(F.concat(F.lit("https://github.com/"), repo)), F.lit(" (fetch)")).alias("value")),
        F.struct((F.col("n_nationkey") * 3 + 1).alias("pos"), F.concat(F.lit("later\thttps://github.com/"), repo, F.lit(" (push)")).alias("value")),
        F.struct((F.col("n_nationkey") * 3 + 2).alias("pos"), F.concat(F.lit("x\thttps://example.com/"), repo).alias("value")),
    )
    return scans.remotes(rows.select(F.explode(both).alias("l")).select("l.*")).select("owner", "repo", "name")


@query("""SELECT 'c/' || n_regionkey AS commit_id, CAST(n_nationkey AS VARCHAR) || '.patch' AS filename, n_name AS content, 'message ' || r_name AS message, CAST((SELECT count(*) FROM nation m WHERE m.n_regionkey = n.n_regionkey AND m.n_nationkey % 2 = 0) AS INTEGER) AS patches
FROM nation n JOIN region ON r_regionkey = n_regionkey""")
def bundled_patches(spark, sf_dir):
    """One JSON file of commits and patches in place of a service, and the rows of its listing."""
    root = shared_folder(spark)
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = F.concat(F.lit("c/"), _text("n_regionkey"))
    state = F.when(F.col("n_nationkey") % 2 == 1, "deleted")
    own = nations.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").cast("int").alias("id"), state.alias("state"))).alias("p"))
    commits = own.join(regions, F.col("r_regionkey") == F.col("n_regionkey")).agg(F.collect_list(F.struct(name.alias("id"), F.concat(F.lit("message "), F.col("r_name")).alias("message"), F.struct(F.col("p").alias("patches")).alias("metadata"))).alias("commits"))
    patches = nations.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(name, F.lit("/"), _text("n_nationkey"), F.lit(".patch")), F.col("n_name")))).alias("patches"))
    _write(commits.join(F.broadcast(patches), F.lit(True)).select(F.lit("bundle.json").alias("path"), F.to_json(F.struct("commits", "patches")).alias("text")), root)
    listed, found = scans.bundle(spark, f"{root}/bundle.json")
    listed = scans.commit_rows(listed).select(F.col("id").alias("commit_id"), "message", "patches")
    return found.join(listed, "commit_id").select("commit_id", "filename", "content", "message", "patches")


@query(cte("SELECT split_id, 'told_' || (change_ord % 2) AS group_id, string_agg(change_id, ',' ORDER BY change_ord) AS change_ids FROM changes GROUP BY 1, 2"))
def suggested_groups(spark, sf_dir):
    """Groups that a model suggests join those of the rules, whatever these cover."""
    changes = adapters.changes(spark, sf_dir)
    group = F.concat(F.lit("told_"), (F.col("change_ord") % 2).cast("string"))
    told = changes.groupBy("split_id", group.alias("group_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("change_ord", "change_id"))), lambda x: x["change_id"]).alias("change_ids"))
    packed = splitting.pack(changes, adapters.symbols(spark, sf_dir), adapters.changes(spark, sf_dir).select("split_id", F.col("change_id").alias("source"), F.col("change_id").alias("target"), F.lit(0.8).alias("strength")).limit(0), told)
    return splitting.kept_groups(packed).filter(F.startswith("group_id", F.lit("told_"))).select("split_id", "group_id", joined(F.col("change_ids")).alias("change_ids"))
