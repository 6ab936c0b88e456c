"""Change-set views of the driver's tables, each as a DataFrame and as the same SQL.

A lineitem row stands for a hunk: its order is the change set, the ordinal is a row number over a total order. Rows are
shuffled by split_id, so what is keyed by it and more columns later needs no shuffle of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(text: Column) -> Column:
    """text without all that is neither an ASCII letter nor a space; what stays is collected, as replacing the rest takes ten
    times as long."""
    return F.array_join(F.regexp_extract_all(text, F.lit("[A-Za-z ]+"), 0), "")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("split_id", F.col("l_orderkey").cast("string"))
    layer = F.element_at(F.array(*map(F.lit, ("models", "utils", "api", "core", "svc"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    file = F.concat(F.lit("pkg"), (F.col("l_suppkey") % 5).cast("string"), F.lit("/"), layer, F.lit("/f"), (F.col("l_partkey") % 4).cast("string"), F.lit(".py"))
    order = Window.partitionBy("split_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    rows = rows.withColumn("change_ord", F.row_number().over(order)).withColumn("file", file)
    nth = F.row_number().over(Window.partitionBy("split_id", "file").orderBy("change_ord")) - 1
    start = (F.col("l_linenumber") * 20 + F.col("change_ord")).cast("int")
    added = F.col("l_quantity").cast("int")
    kind = F.when(F.col("l_returnflag") == "A", "add").when(F.col("l_returnflag") == "N", "modify").otherwise("delete")
    return rows.withColumn("hunk_id", nth.cast("int")).select(
        "split_id", "change_ord", F.concat("file", F.lit(":hunk_"), F.col("hunk_id").cast("string")).alias("change_id"), "file", "hunk_id", kind.alias("type"),
        start.alias("line_start"), (start + added).alias("line_end"), F.lit("").alias("content"), added.alias("added_lines"), F.round(F.col("l_discount") * 100).cast("int").alias("deleted_lines"),
        F.lit("python").alias("language"), (F.col("l_partkey") % 7).alias("d"), (F.col("l_suppkey") % 7).alias("u"),
    )


def symbols(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """rows: changes() where they are at hand."""
    rows = changes(spark, sf_dir) if rows is None else rows
    kind = F.when(F.col("d") % 2 == 0, "function").otherwise("class")
    pair = F.array(
        F.struct(F.lit(0).alias("sym_ord"), F.concat(F.lit("n"), F.col("d").cast("string")).alias("name"), kind.alias("type"), F.lit("definition").alias("role")),
        F.struct(F.lit(1).alias("sym_ord"), F.concat(F.lit("n"), F.col("u").cast("string")).alias("name"), F.lit("function").alias("type"), F.lit("usage").alias("role")),
    )
    rows = rows.select("split_id", "change_ord", "change_id", "file", F.col("line_start").alias("line"), F.explode(pair).alias("s"))
    qualified = F.when(F.col("s.role") == "usage", F.concat(F.lit("ns."), F.col("s.name")))
    return rows.select("split_id", "change_ord", "change_id", "s.sym_ord", "s.name", "s.type", "file", "line", "s.role", F.lit("ns").alias("package"), qualified.alias("qualified_name"), F.lit(None).cast("string").alias("scope"))


def imports(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    rows = changes(spark, sf_dir) if rows is None else rows
    path = F.concat(F.lit("pkg"), F.col("u").cast("string"), F.lit("/api"))
    return rows.select("split_id", "change_id", F.lit("api").alias("alias"), path.alias("path"))


#: The same views for DuckDB; they stand before each query's own text.
SQL = """
WITH c0 AS (
  SELECT *, 'pkg' || (l_suppkey % 5) || '/' || list_extract(['models','utils','api','core','svc'], CAST(l_partkey % 5 + 1 AS INT)) || '/f' || (l_partkey % 4) || '.py' AS file,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS change_ord
  FROM lineitem),
c1 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, file ORDER BY change_ord) - 1 AS hunk_id FROM c0),
changes AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS split_id, change_ord, file || ':hunk_' || hunk_id AS change_id, file, hunk_id,
         CASE l_returnflag WHEN 'A' THEN 'add' WHEN 'N' THEN 'modify' ELSE 'delete' END AS type,
         l_linenumber * 20 + change_ord AS line_start, l_linenumber * 20 + change_ord + CAST(l_quantity AS INT) AS line_end,
         CAST(l_quantity AS INT) AS added_lines, CAST(round(l_discount * 100) AS INT) AS deleted_lines, l_partkey % 7 AS d, l_suppkey % 7 AS u,
         regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir, CAST(l_quantity AS INT) + CAST(round(l_discount * 100) AS INT) AS lines
  FROM c1),
symbols AS (
  SELECT split_id, change_ord, change_id, file, 0 AS sym_ord, 'n' || d AS name, CASE WHEN d % 2 = 0 THEN 'function' ELSE 'class' END AS type, 'definition' AS role FROM changes
  UNION ALL SELECT split_id, change_ord, change_id, file, 1, 'n' || u, 'function', 'usage' FROM changes),
definers AS (SELECT split_id, name, max_by(change_id, change_ord) AS target FROM symbols WHERE role = 'definition' GROUP BY split_id, name),
uses AS (
  SELECT s.split_id, s.change_id AS source, x.target, min(s.change_ord) AS change_ord, min_by(s.name, s.change_ord) AS name
  FROM symbols s JOIN definers x USING (split_id, name) WHERE s.role = 'usage' AND s.change_id <> x.target GROUP BY 1, 2, 3),
deps AS (
  SELECT u.split_id, u.source, u.target, u.name, u.change_ord, CASE WHEN a.type = 'add' AND b.type = 'add' THEN 0.8 ELSE 1.0 END AS strength
  FROM uses u JOIN changes a ON a.split_id = u.split_id AND a.change_id = u.source JOIN changes b ON b.split_id = u.split_id AND b.change_id = u.target),
layered AS (
  SELECT *, CASE WHEN file LIKE '%/models/%' THEN 'interface' WHEN file LIKE '%/utils/%' THEN 'util' WHEN file LIKE '%/api/%' THEN 'controller' ELSE 'impl' END AS layer FROM changes),
patches AS (
  SELECT split_id, layer, CASE layer WHEN 'interface' THEN 0 WHEN 'util' THEN 1 WHEN 'controller' THEN 2 ELSE 3 END AS patch_id, CAST(sum(lines) AS BIGINT) AS size_lines, count(*) AS hunks,
         count(DISTINCT file) AS files, CAST(sum(lines) > 500 AS INT) + CAST(count(*) > 20 AS INT) AS n_warnings
  FROM layered GROUP BY split_id, layer)
"""


def cte(query: str) -> str:
    return SQL + query
