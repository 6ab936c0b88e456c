"""Queries that take every change set as too large for a worker, and tables that are merged and replaced while read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, rounds
from ..sources import catalog as scans
from ..sources import versions
from . import adapters, queries
from .adapters import table
from .queries import joined, query
from .store_queries import shared_folder


@query(queries.ORACLE_SQL["dependency_cycles"])
def cycles_by_rounds(spark, sf_dir):
    """G2 for large change sets: colours by rounds of joins."""
    return rounds.cycles(queries._usage_deps(spark, sf_dir), most=0, path=shared_folder(spark))


@query(queries.ORACLE_SQL["prerequisite_order"])
def levels_by_rounds(spark, sf_dir):
    """G9, G11 for large change sets."""
    rows = adapters.changes(spark, sf_dir).select("split_id", "change_id", "change_ord")
    deps = queries._backward(spark, sf_dir).select("split_id", "source", "target")
    # change sets without edges go to the kernel
    return rounds.levels(rows, deps, most=0, path=shared_folder(spark))


@query(queries.ORACLE_SQL["symbol_clusters"])
def clusters_by_rounds(spark, sf_dir):
    """A10 for large change sets."""
    found = rounds.symbol_groups(adapters.symbols(spark, sf_dir), most=0, path=shared_folder(spark))
    return found.select("split_id", joined(F.col("change_ids")).alias("change_ids"))


@query("""
WITH b AS (SELECT *, event_id % 3 AS batch FROM events), last AS (SELECT user_id, max(batch) AS batch FROM b GROUP BY 1)
SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM b JOIN last USING (user_id, batch) GROUP BY 1""")
def merged_batches(spark, sf_dir):
    """Streaming upsert by key: three batches of events, each replacing its users' rows, the last one merged twice."""
    path = shared_folder(spark)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    for batch in (0, 1, 2, 2):
        versions.merge(rows.filter(F.col("event_id") % 3 == batch), path, "user_id", 8, batch)
    return versions.read(spark, path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""
WITH c AS (SELECT CAST(o_custkey % 7 AS VARCHAR) AS repo, CAST(o_custkey % 3 AS VARCHAR) AS branch, CAST(o_orderkey AS VARCHAR) AS sha, o_orderdate AS day FROM orders),
n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY repo, branch ORDER BY day DESC, sha) <= 50)
SELECT repo, branch, sha FROM n WHERE repo <> '3' UNION ALL SELECT repo, branch, sha FROM c WHERE repo = '3'""")
def replaced_snapshot(spark, sf_dir):
    """The listing's snapshot, then one repository's rows replaced by all that it has."""
    path = shared_folder(spark)
    text = lambda c, m: (F.col(c) % m).cast("string")
    rows = table(spark, sf_dir, "orders").select(text("o_custkey", 7).alias("repo"), text("o_custkey", 3).alias("branch"), F.col("o_orderkey").cast("string").alias("sha"), F.col("o_orderdate").alias("at"))
    scans.snapshot(rows, path)
    scans.write_progress(rows, path, "3")
    return versions.read(spark, path).select("repo", "branch", "sha")


#: Patches by layer that need each other, with each pair turned round too where the change set is even: graphs with cycles.
_PATCH_EDGES = queries.ORACLE_SQL["patch_dependencies"]
_RINGS = f"""
, e0 AS ({{edges}}),
e AS (SELECT DISTINCT split_id, patch_id AS source, needs AS target FROM e0 WHERE patch_id <> needs UNION SELECT split_id, needs, patch_id FROM e0 WHERE patch_id <> needs AND CAST(split_id AS BIGINT) % 2 = 0),
walk AS (SELECT split_id, source AS start, [source, target] AS nodes FROM e WHERE target > source
         UNION ALL SELECT w.split_id, w.start, list_append(w.nodes, e.target) FROM walk w JOIN e ON e.split_id = w.split_id AND e.source = w.nodes[-1] WHERE e.target > w.start AND NOT list_contains(w.nodes, e.target)),
rings AS (SELECT w.split_id, w.start, w.nodes FROM walk w JOIN e ON e.split_id = w.split_id AND e.source = w.nodes[-1] AND e.target = w.start)"""


def _with_rings(select: str) -> str:
    """The edges' SQL is one WITH statement: its last SELECT becomes a table, and recursion is allowed."""
    sql = _PATCH_EDGES.strip()
    at = sql.rindex("SELECT DISTINCT d.split_id")
    return sql[:at].replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + _RINGS.format(edges=sql[at:]) + select


def _ring_edges(spark, sf_dir):
    rows = queries.patch_dependencies(spark, sf_dir).filter("patch_id <> needs").select("split_id", F.col("patch_id").alias("source"), F.col("needs").alias("target"))
    back = rows.filter(F.col("split_id").cast("long") % 2 == 0).select("split_id", F.col("target").alias("source"), F.col("source").alias("target"))
    return rows.unionByName(back).distinct()


@query(_with_rings(" SELECT split_id, row_number() OVER (PARTITION BY split_id ORDER BY nodes) - 1 AS nth, array_to_string(nodes, '>') AS nodes FROM rings"))
def patch_cycles(spark, sf_dir):
    """All simple cycles of patch graphs."""
    found = graph.simple_cycles(_ring_edges(spark, sf_dir))
    return found.select("split_id", "nth", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("nodes"))


@query(_with_rings("""
, cut AS (SELECT DISTINCT split_id, nodes[-1] AS source, start AS target FROM rings),
odd AS (SELECT split_id, count(*) > count(DISTINCT (nodes[-1], start)) AS failed FROM rings GROUP BY 1),
left_ AS (SELECT * FROM e ANTI JOIN cut USING (split_id, source, target)),
n AS (SELECT split_id, source AS node FROM e UNION SELECT split_id, target FROM e),
lv AS (SELECT split_id, node, 0 AS level FROM n UNION SELECT l.split_id, l.source, lv.level + 1 FROM lv JOIN left_ l ON l.split_id = lv.split_id AND l.target = lv.node),
m AS (SELECT split_id, node, max(level) AS level FROM lv GROUP BY 1, 2)
SELECT m.split_id, node, CAST(row_number() OVER (PARTITION BY m.split_id ORDER BY CASE WHEN coalesce(failed, false) THEN 0 ELSE level END, node) - 1 AS INTEGER) AS place, coalesce(failed, false) AS failed FROM m LEFT JOIN odd USING (split_id)"""))
def patch_order_without_cycles(spark, sf_dir):
    """G12 as surveyed: of every cycle the edge from last to first is cut; where that fails, patches keep their order."""
    edges = _ring_edges(spark, sf_dir)
    nodes = edges.select("split_id", F.col("source").alias("node")).unionByName(edges.select("split_id", F.col("target").alias("node"))).distinct()
    return graph.order_without_cycles(nodes, edges)
