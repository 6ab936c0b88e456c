"""Queries over stored results and recorded command output: listing, views, joins, sinks, text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog, deps, graph, quality, splitting
from ..sources import catalog as scans
from ..sources import diffs, sinks
from . import adapters, queries
from .adapters import cte, table
from .queries import _layer_parts, _layer_patches, _usage_deps, joined, query, r9


def text(c: str):
    return F.col(c).cast("string")


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer patches as patch rows: a patch depends on those before it that its changes use."""
    parts = _layer_parts(spark, sf_dir)
    rows = parts.withColumn("lines", F.col("added_lines") + F.col("deleted_lines")).groupBy("split_id", "patch_id", "layer")
    from ..operators.grouping import ordered_ids

    made = rows.agg(ordered_ids().alias("changes"), F.sum("lines").cast("int").alias("size_lines"), splitting.type_counts().alias("description"))
    needs = splitting.patch_edges(_usage_deps(spark, sf_dir), parts).filter("needs < patch_id").groupBy("split_id", "patch_id").agg(F.array_sort(F.collect_list("needs")).alias("depends_on"))
    out = made.join(needs, ["split_id", "patch_id"], "left")
    return out.select("split_id", "patch_id", F.concat(F.lit("Layer "), F.col("layer")).alias("name"), "description", "changes", F.coalesce("depends_on", F.array().cast("array<int>")).alias("depends_on"), "size_lines", F.array().cast("array<string>").alias("warnings"))


_PATCHES = """
, home AS (SELECT l.*, p.patch_id FROM layered l JOIN patches p ON p.split_id = l.split_id AND p.layer = l.layer),
needs AS (SELECT DISTINCT d.split_id, a.patch_id, b.patch_id AS needs FROM deps d JOIN home a ON a.split_id = d.split_id AND a.change_id = d.source JOIN home b ON b.split_id = d.split_id AND b.change_id = d.target WHERE b.patch_id < a.patch_id),
pn AS (SELECT split_id, patch_id, count(*) AS k, string_agg(CAST(needs AS VARCHAR), ', ' ORDER BY needs) AS listed FROM needs GROUP BY 1, 2),
pr AS (
  SELECT h.split_id, h.patch_id, 'Layer ' || h.layer AS name, count(*) AS n, CAST(sum(lines) AS INT) AS size_lines, coalesce(max(k), 0) AS k, coalesce(max(listed), '') AS listed, string_agg(h.change_id, ',' ORDER BY change_ord) AS changes,
         concat_ws(', ', CASE WHEN count(*) FILTER (type = 'add') > 0 THEN count(*) FILTER (type = 'add') || ' additions' END, CASE WHEN count(*) FILTER (type = 'modify') > 0 THEN count(*) FILTER (type = 'modify') || ' modifications' END, CASE WHEN count(*) FILTER (type = 'delete') > 0 THEN count(*) FILTER (type = 'delete') || ' deletions' END) AS description
  FROM home h LEFT JOIN pn ON pn.split_id = h.split_id AND pn.patch_id = h.patch_id GROUP BY h.split_id, h.patch_id, h.layer)"""


@query(cte(_PATCHES + ", l AS (SELECT split_id, string_agg('- Patch ' || patch_id || ': ' || name || ' (' || n || ' changes, ' || size_lines || ' lines, ' || CASE WHEN k > 0 THEN 'depends on [' || listed || ']' ELSE 'no dependencies' END || ')', chr(10) ORDER BY patch_id) AS text FROM pr GROUP BY 1) SELECT * FROM l"))
def patch_summaries(spark, sf_dir):
    """A line a patch, for a prompt."""
    return splitting.patch_summaries(_patches(spark, sf_dir))


@query(cte(", l AS (SELECT split_id, string_agg('- ' || change_id || ': ' || type || ' in ' || file || ', symbols: [n' || d || ', n' || u || '], ' || added_lines || '+ ' || deleted_lines || '-', chr(10) ORDER BY change_ord) AS text FROM changes GROUP BY 1) SELECT * FROM l"))
def change_summaries(spark, sf_dir):
    """A line a change."""
    return splitting.change_summaries(adapters.changes(spark, sf_dir), adapters.symbols(spark, sf_dir))


@query("""
WITH l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n, o_orderpriority AS p, count(*) OVER (PARTITION BY o_orderpriority) AS all_n FROM orders)
SELECT p AS split_id, string_agg('- ' || o_orderkey || ' -> ' || o_custkey || ' (import, strength=0.8): r', chr(10) ORDER BY n) FILTER (n <= 50) || CASE WHEN max(all_n) > 50 THEN chr(10) || '... and ' || (max(all_n) - 50) || ' more dependencies' ELSE '' END AS text FROM l GROUP BY p""")
def dependency_summaries(spark, sf_dir):
    """The first 50 dependencies, and how many more."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split_id"), text("o_orderkey").alias("source"), text("o_custkey").alias("target"), F.lit("import").alias("type"), F.lit(0.8).alias("strength"), F.lit("r").alias("reason"), F.col("o_orderkey").alias("dep_ord"))
    return splitting.dependency_summaries(rows)


@query(cte("""
, g AS (SELECT split_id, dir, min(change_ord) AS first, count(*) AS n, string_agg(change_id, ', ' ORDER BY change_ord) FILTER (change_ord <= 99) AS ids, list(change_id ORDER BY change_ord) AS l FROM changes GROUP BY 1, 2)
SELECT split_id, string_agg('- ' || dir || ': [' || array_to_string(l[1:5], ', ') || CASE WHEN n > 5 THEN '...' ELSE '' END || '] - one folder', chr(10) ORDER BY first) AS atomic,
       string_agg('- ' || dir || ' (cohesion=' || CASE WHEN n > 1 THEN '0.85' ELSE '0.70' END || '): folder [' || n || ' changes]', chr(10) ORDER BY first) AS semantic FROM g GROUP BY 1"""))
def group_summaries(spark, sf_dir):
    """Lines of atomic and of semantic groups."""
    from ..operators import grouping

    rows = grouping.by_directory(adapters.changes(spark, sf_dir)).select("split_id", F.col("first").alias("group_ord"), F.col("key").alias("group_id"), F.col("key").alias("name"), F.lit("folder").alias("description"), F.lit("one folder").alias("reason"), "score", "change_ids")
    return splitting.atomic_summaries(rows).withColumnRenamed("text", "atomic").join(splitting.semantic_summaries(rows).withColumnRenamed("text", "semantic"), "split_id")


@query(cte(_PATCHES + ", l AS (SELECT split_id, '# Patches' || chr(10) || chr(10) || '## Other' || chr(10) || chr(10) || string_agg('- **' || lpad(CAST(patch_id AS VARCHAR), 2, '0') || '** ' || name || ' (' || size_lines || ' lines)', chr(10) ORDER BY patch_id) || chr(10) || chr(10) || '## Order' || chr(10) || chr(10) || string_agg((patch_id + 1) || '. ' || name, chr(10) ORDER BY patch_id) || chr(10) AS text FROM pr GROUP BY 1) SELECT split_id, md5(text) AS digest FROM l"))
def split_markdown(spark, sf_dir):
    """K3, O3."""
    p = _patches(spark, sf_dir)
    return sinks.markdown(p, p.select("split_id", "patch_id", F.lit("other").alias("category"))).select("split_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(cte(_PATCHES + ", f AS (SELECT *, lpad(CAST(patch_id AS VARCHAR), 2, '0') || '_' || replace(name, ' ', '_') || '.patch' AS file FROM pr), l AS (SELECT split_id, '#!/bin/bash' || chr(10) || 'set -e' || chr(10) || chr(10) || string_agg('echo ''Applying ' || file || '''' || chr(10) || 'git apply --check ''' || file || ''' && git apply ''' || file || '''', chr(10) || chr(10) ORDER BY patch_id) || chr(10) AS text FROM f GROUP BY 1) SELECT split_id, md5(text) AS digest FROM l"))
def apply_scripts(spark, sf_dir):
    """K4, P18."""
    return sinks.apply_script(_patches(spark, sf_dir)).select("split_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(cte(_PATCHES + ", l AS (SELECT split_id, '| # | Patch | Lines | Hunks |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || patch_id || ' | ' || name || ' | ' || size_lines || ' | ' || n || ' |', chr(10) ORDER BY patch_id) || chr(10) || chr(10) || string_agg('<details><summary>' || name || '</summary>' || chr(10) || chr(10) || description || chr(10) || chr(10) || '</details>', chr(10) ORDER BY patch_id) AS text FROM pr GROUP BY 1) SELECT split_id, md5(text) AS digest FROM l"))
def pull_comments(spark, sf_dir):
    """K10."""
    return sinks.comment(_patches(spark, sf_dir)).select("split_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(cte(_PATCHES + """
SELECT p.split_id, p.patch_id, p.name, CAST(k + 1 AS INT) AS priority, listed AS dependencies, (SELECT string_agg(DISTINCT h.file, ',' ORDER BY h.file) FROM home h WHERE h.split_id = p.split_id AND h.patch_id = p.patch_id) AS files,
       lpad(CAST(patch_id AS VARCHAR), 2, '0') || '_' || replace(name, ' ', '_') || '.patch' AS filename, CAST(count(*) OVER (PARTITION BY p.split_id) AS INT) AS total, string_agg(name, '; ') OVER (PARTITION BY p.split_id ORDER BY patch_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS goal, 'r' AS repository FROM pr p"""))
def split_metadata(spark, sf_dir):
    """The metadata files, read back."""
    p = _patches(spark, sf_dir)
    made = sinks.metadata(p, p.select("split_id", "patch_id", F.lit("other").alias("category")), 7, {"name": "r"}, "model")
    schema = "generated_at int, total_patches int, goal_summary string, repository struct<name:string>, mental_model string, patches array<struct<id:int,name:string,priority:int,files:array<string>,dependencies:array<int>,filename:string>>"
    # Through explode a file is read once; a plain column is read again for each field and for the filter.
    rows = made.select("split_id", F.explode(F.array(F.from_json("json", schema))).alias("m")).filter("m.generated_at = 7 and m.mental_model = 'model'").select("split_id", "m.*", F.explode("m.patches").alias("p"))
    own = rows.select("split_id", F.col("p.id").alias("patch_id"), F.col("p.name").alias("name"), F.col("p.priority").alias("priority"), F.array_join(F.transform("p.dependencies", lambda d: d.cast("string")), ", ").alias("dependencies"), F.col("p.filename").alias("filename"), F.col("total_patches").alias("total"), F.col("goal_summary").alias("goal"), F.col("repository.name").alias("repository"))
    files = sinks.patch_files(p, adapters.changes(spark, sf_dir)).select("split_id", "patch_id", joined(F.col("files")).alias("files"))
    return own.join(files, ["split_id", "patch_id"])


@query(cte(_PATCHES + """
, d AS (SELECT * FROM pr WHERE patch_id <> 2)
SELECT split_id, CAST(patch_id + CASE WHEN patch_id > 2 THEN 1 ELSE 0 END AS INT) AS patch_id, name, lpad(CAST(patch_id + CASE WHEN patch_id > 2 THEN 1 ELSE 0 END AS VARCHAR), 2, '0') || '_' || replace(name, ' ', '_') || '.patch' AS filename FROM d WHERE split_id IN (SELECT split_id FROM pr WHERE patch_id = 2)
UNION ALL SELECT split_id, CAST(2 + i AS INT), 'part ' || i, '0' || (2 + i) || '_part_' || i || '.patch' FROM pr, (SELECT unnest([0, 1]) AS i) WHERE patch_id = 2"""))
def resplit_files(spark, sf_dir):
    """A stored patch replaced by two; later ones move up, in their file names too."""
    p = _patches(spark, sf_dir).select("split_id", "patch_id", "name", "depends_on")
    own = p.filter("patch_id = 2").select("split_id")
    parts = own.select("split_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("patch_id")).withColumn("name", F.concat(F.lit("part "), text("patch_id"))).withColumn("depends_on", F.array().cast("array<int>"))
    out = splitting.resplit(p.join(own, "split_id", "left_semi"), 2, parts)
    return out.select("split_id", "patch_id", "name", sinks.patch_name().alias("filename"))


@query(cte(_PATCHES + """
SELECT h.split_id, h.change_id AS source, d.target FROM deps d JOIN home h ON h.split_id = d.split_id AND h.change_id = d.source JOIN home t ON t.split_id = d.split_id AND t.change_id = d.target WHERE h.patch_id = 2 AND t.patch_id NOT IN (0, 2)"""))
def unmet_dependencies(spark, sf_dir):
    """What patch 2 needs beside itself and the applied patch 0."""
    return quality.unmet(_usage_deps(spark, sf_dir), _layer_parts(spark, sf_dir), 2, [0])


@query(cte(_PATCHES + """, n AS (SELECT *, row_number() OVER (PARTITION BY split_id ORDER BY patch_id) - 1 AS nth FROM pr)
SELECT split_id, CAST(coalesce(max(CASE WHEN patch_id = 2 THEN patch_id END), max(CASE WHEN nth = 2 THEN patch_id END)) AS INT) AS patch_id FROM n GROUP BY 1 HAVING max(CASE WHEN patch_id = 2 OR nth = 2 THEN 1 END) = 1"""))
def patch_by_key(spark, sf_dir):
    """The patch with id 2, else the third."""
    return catalog.patch_at(_patches(spark, sf_dir), "2").select("split_id", "patch_id")


@query(cte(_PATCHES + "SELECT split_id, patch_id, name FROM pr WHERE split_id = '4' AND patch_id = 1"))
def patch_by_file(spark, sf_dir):
    """By file name, a doubled suffix taken as one."""
    rows = _patches(spark, sf_dir).withColumn("filename", sinks.patch_name())
    return scans.patch_by_name(rows, "4", "01_Layer_util.patch.patch").select("split_id", "patch_id", "name")


@query(cte("""
, f AS (SELECT split_id, change_id, file, change_ord FROM changes)
SELECT a.split_id, a.change_id AS wanted, arg_min(b.change_ord, b.change_ord) AS pos FROM f a JOIN f b ON a.split_id = b.split_id AND a.file = b.file GROUP BY 1, 2"""))
def file_lookup(spark, sf_dir):
    """the first file of a diff that ends with, or lies at the end of, the wanted path."""
    rows = adapters.changes(spark, sf_dir)
    files = rows.select("split_id", F.col("change_ord").alias("pos"), F.col("file").alias("old_path"), F.concat(F.lit("root/"), F.col("file")).alias("new_path"))
    wanted = rows.select("split_id", F.concat(F.lit("root/"), F.col("file")).alias("wanted"), "change_id")
    out = catalog.find_file(files, wanted.select("split_id", "wanted").distinct())
    return wanted.join(out, ["split_id", "wanted"]).select("split_id", F.col("change_id").alias("wanted"), "pos")


@query(cte("SELECT split_id, source, target, count(*) AS n FROM (SELECT split_id, source, target FROM deps) GROUP BY 1, 2, 3"))
def distinct_edges(spark, sf_dir):
    """G1: parallel edges collapse, the last one's attributes stay."""
    edges = _usage_deps(spark, sf_dir).select("split_id", "source", "target", "strength")
    twice = edges.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("dep_ord")).withColumn("type", F.when(F.col("dep_ord") == 1, "last").otherwise("first")).withColumn("reason", F.lit(""))
    return graph.distinct_edges(twice).filter("type = 'last'").groupBy("split_id", "source", "target").agg(F.count(F.lit(1)).alias("n"))


@query(cte(", f AS (SELECT split_id, change_id FROM changes WHERE change_ord = 1) SELECT f.split_id, d.target AS change_id, 'prerequisite' AS side FROM f JOIN deps d ON d.split_id = f.split_id AND d.source = f.change_id WHERE f.change_id = 'pkg1/models/f0.py:hunk_0' UNION SELECT f.split_id, d.source, 'dependent' FROM (SELECT DISTINCT split_id FROM changes) f JOIN deps d ON d.split_id = f.split_id AND d.target = 'pkg1/models/f0.py:hunk_0' UNION SELECT d.split_id, d.target, 'prerequisite' FROM deps d WHERE d.source = 'pkg1/models/f0.py:hunk_0'"))
def change_neighbours(spark, sf_dir):
    """What one change depends on, and what depends on it."""
    return deps.neighbours(_usage_deps(spark, sf_dir), "pkg1/models/f0.py:hunk_0")


@query(adapters.SQL.replace("\nWITH c0", "\nWITH RECURSIVE c0", 1) + """
, b AS (SELECT DISTINCT d.split_id, d.source, d.target FROM deps d JOIN changes x ON x.split_id = d.split_id AND x.change_id = d.source JOIN changes y ON y.split_id = d.split_id AND y.change_id = d.target WHERE x.change_ord < y.change_ord),
walk AS (SELECT split_id, [source, target] AS path FROM b WHERE NOT EXISTS (SELECT 1 FROM b c WHERE c.split_id = b.split_id AND c.target = b.source)
  UNION ALL SELECT w.split_id, list_append(w.path, b.target) FROM walk w JOIN b ON b.split_id = w.split_id AND b.source = w.path[-1] AND NOT list_contains(w.path, b.target))
SELECT split_id, array_to_string(path, ',') AS path FROM walk WHERE len(path) > 2 AND NOT EXISTS (SELECT 1 FROM b WHERE b.split_id = walk.split_id AND b.source = walk.path[-1])""")
def critical_paths(spark, sf_dir):
    """G10 over edges that point to later changes."""
    places = adapters.changes(spark, sf_dir).select("split_id", "change_id", "change_ord")
    edges = deps.with_ends(deps.usage_edges(adapters.symbols(spark, sf_dir)).select("split_id", "source", "target"), places, "change_ord").filter("s.change_ord < t.change_ord")
    return graph.critical_paths(places, edges).withColumn("path", joined(F.col("path")))


@query(cte("""
, x AS (SELECT split_id, change_id AS source, 'n' || u AS name FROM changes),
t AS (SELECT split_id, name, max_by(change_id, change_ord) AS target FROM symbols WHERE role = 'definition' GROUP BY 1, 2)
SELECT x.split_id, x.source, t.target, count(*) AS calls FROM x JOIN t USING (split_id, name) WHERE x.source <> t.target GROUP BY 1, 2, 3"""))
def call_edges(spark, sf_dir):
    """By bare name to the last definer."""
    calls = adapters.changes(spark, sf_dir).select("split_id", F.col("change_id").alias("source"), F.concat(F.lit("n"), text("u")).alias("name"))
    return deps.call_edges(adapters.symbols(spark, sf_dir), calls).groupBy("split_id", "source", "target").agg(F.count(F.lit(1)).alias("calls"))


@query(cte("""
, i AS (SELECT split_id, file, change_id AS target, type, CASE d % 3 WHEN 0 THEN 'lib.n' || u WHEN 1 THEN 'n' || u ELSE 'n' || u || '.x' END AS package, CASE WHEN u = 0 THEN 'stdlib' WHEN u = 1 THEN 'external' ELSE 'internal' END AS kind FROM changes WHERE hunk_id = 0),
s AS (SELECT split_id, file, change_id AS source, type, 'n' || d AS usage FROM changes WHERE hunk_id > 0)
SELECT s.split_id, source, target, CASE WHEN s.type = 'add' AND i.type = 'add' THEN 0.8 ELSE 1.0 END AS strength FROM s JOIN i ON i.split_id = s.split_id AND i.file = s.file AND (usage = package OR starts_with(package, usage || '.') OR list_contains(string_split(package, '.'), usage)) WHERE i.kind = 'internal'"""))
def same_file_imports(spark, sf_dir):
    """The first hunk of a file imports, the others use; standard and external imports alone do not count."""
    rows = adapters.changes(spark, sf_dir)
    n = F.concat(F.lit("n"), text("u"))
    package = F.when(F.col("d") % 3 == 0, F.concat(F.lit("lib."), n)).when(F.col("d") % 3 == 1, n).otherwise(F.concat(n, F.lit(".x")))
    kind = F.when(F.col("u") == 0, "stdlib").when(F.col("u") == 1, "external").otherwise("internal")
    imported = rows.filter("hunk_id = 0").select("split_id", "file", F.col("change_id").alias("target"), package.alias("package"), kind.alias("kind"), "language")
    used = rows.filter("hunk_id > 0").select("split_id", "file", F.col("change_id").alias("source"), F.concat(F.lit("n"), text("d")).alias("usage"))
    return deps.same_file_import_edges(imported, used, rows)


@query(cte("""
, s AS (SELECT split_id, change_ord AS nth, change_id AS source, CASE WHEN d = 3 THEN 'pkg*' ELSE 'x' END AS target, CASE WHEN u % 2 = 0 THEN 0.5 END AS strength FROM changes),
k AS (SELECT split_id, count(*) AS k FROM deps GROUP BY 1)
SELECT s.split_id, row_number() OVER (PARTITION BY s.split_id ORDER BY nth) - 1 + coalesce(k, 0) AS dep_ord, source, coalesce(strength, 0.8) AS strength FROM s LEFT JOIN k USING (split_id) WHERE target <> 'pkg*'"""))
def suggested_edges(spark, sf_dir):
    """Suggested edges after the others, without those that hold a wildcard."""
    edges = _usage_deps(spark, sf_dir).select("split_id", "source", "target", F.lit("u").alias("type"), "strength", F.lit("").alias("reason"))
    edges = edges.withColumn("dep_ord", (F.row_number().over(Window.partitionBy("split_id").orderBy("source", "target")) - 1).cast("int")).select("split_id", "dep_ord", "source", "target", "type", "strength", "reason")
    more = adapters.changes(spark, sf_dir).select("split_id", F.col("change_ord").alias("nth"), F.col("change_id").alias("source"), F.when(F.col("d") == 3, "pkg*").otherwise("x").alias("target"), F.when(F.col("u") % 2 == 0, 0.5).alias("strength"), F.lit(None).cast("string").alias("reason"))
    return deps.with_suggested(edges, more).filter("type = 'call_chain'").select("split_id", "dep_ord", "source", "strength")


_R = "SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS split_id, o_orderkey % 6 AS m FROM orders"


@query(f"""
WITH r AS ({_R})
SELECT split_id, CASE m WHEN 0 THEN 'patch' WHEN 1 THEN 'commit' WHEN 2 THEN 'branch' WHEN 5 THEN 'invalid' ELSE 'working directory' END AS mode,
       CASE m WHEN 0 THEN 'ready' WHEN 1 THEN 'commit ' || (k % 50) WHEN 2 THEN 'b' || (k % 7) || '..main' WHEN 3 THEN 'work ' || k WHEN 4 THEN CASE WHEN k % 5 = 0 THEN NULL ELSE 'work ' || k || chr(10) || 'diff --git a/n.txt b/n.txt' || chr(10) || 'new file mode 100644' || chr(10) || '--- /dev/null' || chr(10) || '+++ b/n.txt' || chr(10) || '@@ -0,0 +1,2 @@' || chr(10) || '+one' || chr(10) || '+' || k || chr(10) END END AS value FROM r""")
def patch_requests(spark, sf_dir):
    """Four ways to a diff, by priority."""
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 6
    orders = table(spark, sf_dir, "orders")
    base = orders.select(text("o_orderkey").alias("split_id"), F.when(m == 0, "ready").alias("patch"), F.when(m <= 1, (k % 50).cast("string")).alias("commit_id"), F.when(m <= 2, F.concat(F.lit("b"), (k % 7).cast("string"))).alias("branch"), F.when((m <= 2) | (m == 5), "main").alias("base_branch"), (m == 4).alias("with_untracked"))
    commits = orders.select((k % 50).cast("string").alias("commit_id")).distinct().withColumn("value", F.concat(F.lit("commit "), F.col("commit_id")))
    branches = orders.select(F.concat(F.lit("b"), (k % 7).cast("string")).alias("branch")).distinct().withColumn("base_branch", F.lit("main")).withColumn("value", F.concat(F.col("branch"), F.lit("..main")))
    working = orders.select(text("o_orderkey").alias("split_id"), F.when((m == 4) & (k % 5 == 0), " ").otherwise(F.concat(F.lit("work "), text("o_orderkey"))).alias("value"))
    untracked = orders.select(text("o_orderkey").alias("split_id"), F.lit("n.txt").alias("file"), F.concat(F.lit("one\n"), text("o_orderkey"), F.lit("\n")).alias("text"))
    return diffs.generated(base, commits, branches, working, untracked)


_DIFF = "'diff --git a/p/' || {x} || '.py b/p/' || {x} || '.py' || chr(10) || '--- a/p/' || {x} || '.py' || chr(10) || '+++ b/p/' || {x} || '.py' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-a' || chr(10) || '+b'"


def _diff(x):
    return F.concat(F.lit("diff --git a/p/"), x, F.lit(".py b/p/"), x, F.lit(".py\n--- a/p/"), x, F.lit(".py\n+++ b/p/"), x, F.lit(".py\n@@ -1 +1 @@\n-a\n+b"))


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS sha, c_name AS message, 'p/' || c_custkey || '.py,p/z.py' AS files, md5({_DIFF.format(x='c_custkey')} || chr(10) || {_DIFF.format(x=chr(39) + 'z' + chr(39))}) AS digest FROM customer WHERE c_custkey % 4 <> 0")
def commit_views(spark, sf_dir):
    """A commit's row with its diff and the files it changes."""
    rows = table(spark, sf_dir, "customer")
    infos = rows.select(text("c_custkey").alias("sha"), F.col("c_name").alias("message"))
    commits = rows.filter("c_custkey % 4 <> 0").select(text("c_custkey").alias("commit_id"), F.concat(_diff(text("c_custkey")), F.lit("\n"), _diff(F.lit("z"))).alias("value"))
    return diffs.commit_view(infos, commits).select("sha", "message", joined(F.col("files")).alias("files"), F.md5(F.col("diff").cast("binary")).alias("digest"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS split_id, s_suppkey || '.py' AS files, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey || '.py' ELSE '' END AS staged, 'new.py' AS untracked, 'diff --git a/' || s_suppkey || '.py b/' || s_suppkey || '.py' AS head FROM supplier")
def working_views(spark, sf_dir):
    """A working directory's diff, files and states, given from a folder."""
    rows = table(spark, sf_dir, "supplier")
    own = rows.select(text("s_suppkey").alias("split_id"), _diff(text("s_suppkey")).alias("value"))
    file = F.concat(F.lit("p/"), text("s_suppkey"), F.lit(".py"))
    status = rows.select(text("s_suppkey").alias("split_id"), file.alias("file"), F.when(F.col("s_suppkey") % 2 == 0, "staged").otherwise("unstaged").alias("state"))
    status = status.unionByName(rows.select(text("s_suppkey").alias("split_id"), F.lit("p/new.py").alias("file"), F.lit("untracked").alias("state"))).unionByName(rows.select(text("s_suppkey").alias("split_id"), F.lit("q/other.py").alias("file"), F.lit("untracked").alias("state")))
    out = diffs.working_view(own, status, "p")
    return out.select("split_id", joined(F.col("files")).alias("files"), joined(F.col("staged")).alias("staged"), joined(F.col("untracked")).alias("untracked"), F.substring_index("diff", "\n", 1).alias("head"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS split_id, md5('tracked ' || s_suppkey || chr(10) || 'diff --git a/n.py b/n.py' || chr(10) || 'new file mode 100644' || chr(10) || '--- /dev/null' || chr(10) || '+++ b/n.py' || chr(10) || '@@ -0,0 +1,1 @@' || chr(10) || '+' || s_name || chr(10)) AS digest FROM supplier")
def working_directories(spark, sf_dir):
    """Tracked changes, then new files."""
    rows = table(spark, sf_dir, "supplier")
    tracked = rows.select(text("s_suppkey").alias("split_id"), F.concat(F.lit("tracked "), text("s_suppkey")).alias("value"))
    untracked = rows.select(text("s_suppkey").alias("split_id"), F.lit("n.py").alias("file"), F.col("s_name").alias("text"))
    return diffs.working_directory(tracked, untracked).select("split_id", F.md5(F.col("value").cast("binary")).alias("digest"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS sha, c_name AS author, 'line one' || chr(10) || 'line | two' AS body, 'subject ' || c_custkey AS subject FROM customer")
def commit_details(spark, sf_dir):
    """One field a line, the body keeps its lines."""
    lines = table(spark, sf_dir, "customer").select(F.concat_ws("\n", text("c_custkey"), F.col("c_name"), F.lit("e"), F.lit("d"), F.lit("c"), F.lit("ce"), F.concat(F.lit("subject "), text("c_custkey")), F.lit("line one\nline | two")).alias("value"))
    return scans.commit_info(lines).select("sha", "author", "body", "subject")


@query("SELECT n_name AS name, n_nationkey % 5 = 0 AS current FROM nation")
def branch_list(spark, sf_dir):
    """S14."""
    lines = table(spark, sf_dir, "nation").select(F.concat(F.when(F.col("n_nationkey") % 5 == 0, "* ").otherwise("  "), F.col("n_name")).alias("value"))
    return scans.branches(lines)


@query("SELECT n_nationkey AS repository, CASE WHEN n_nationkey % 3 = 0 THEN 'HEAD' ELSE n_name END AS branch FROM nation")
def current_branches(spark, sf_dir):
    """HEAD where the command failed."""
    return scans.current_branch(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("repository"), F.concat("n_name", F.lit("\n")).alias("value"), (F.col("n_nationkey") % 3 == 0).alias("failed")))


@query("SELECT 'f' || n_nationkey AS file FROM nation WHERE n_nationkey % 2 = 0")
def untracked_list(spark, sf_dir):
    """Blank lines are no files."""
    return scans.untracked_files(table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("f"), text("n_nationkey"))).otherwise(" ").alias("value")))


@query("SELECT s_suppkey % 50 AS repository, CAST(sum(CASE s_suppkey % 4 WHEN 2 THEN 2 ELSE 1 END) AS INT) AS badge FROM supplier GROUP BY 1")
def repository_badges(spark, sf_dir):
    """States of a repository's files together."""
    code = F.element_at(F.array(*map(F.lit, ("M  a", " M a", "MM a", "?? a"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    lines = table(spark, sf_dir, "supplier").select(F.col("s_suppkey"), F.concat(code, text("s_suppkey")).alias("value"))
    got = scans.status(lines).withColumn("repository", F.regexp_extract("file", r"(\d+)", 1).cast("long") % 50)
    return catalog.badges(got)


@query("SELECT n_regionkey AS repository, max('commit_' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0')) AS folder FROM nation WHERE n_nationkey % 3 = 0 GROUP BY 1")
def newest_folders(spark, sf_dir):
    """The last result folder by name."""
    name = F.concat(F.when(F.col("n_nationkey") % 3 == 0, "commit_").otherwise("zz_"), F.lpad(text("n_nationkey"), 3, "0"))
    return catalog.newest_folder(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("repository"), name.alias("folder")))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS k FROM events)
SELECT user_id, event_id, k > 20 AS has_more, user_id % 2 = 0 AS cached FROM r WHERE n <= 20""")
def first_pages(spark, sf_dir):
    """L3, L1: a first page from the snapshot where it has the key, else from the live table."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    out = catalog.first_page(rows.filter("user_id % 2 = 0"), rows, ["user_id"], [F.desc("ts"), F.col("event_id")])
    return out.select("user_id", "event_id", "has_more", "cached")


@query("""
SELECT 'o/r' || s_nationkey AS slug, s_suppkey AS number, NULL AS error FROM supplier WHERE s_nationkey % 3 <> 0 AND s_nationkey % 5 <> 0
UNION ALL SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'bad' || n_nationkey ELSE 'o/r' || n_nationkey END, NULL, CASE WHEN n_nationkey % 3 = 0 THEN 'Invalid repo format: bad' || n_nationkey ELSE 'o/r' || n_nationkey || ': no access' END FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 5 = 0""")
def all_pull_requests(spark, sf_dir):
    """Pull requests of all repositories, and what went wrong, apart."""
    made = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list(F.struct(F.col("s_suppkey").alias("number"), F.col("s_acctbal").alias("updated_at"))).alias("pulls"))
    n = F.col("n_nationkey")
    slug = F.concat(F.when(n % 3 == 0, "bad").otherwise("o/r"), text("n_nationkey"))
    answers = table(spark, sf_dir, "nation").join(made, "n_nationkey", "left").select(slug.alias("slug"), F.when((n % 5 == 0) & (n % 3 != 0), "no access").alias("error"), "pulls")
    pulls, errors = catalog.all_pulls(answers)
    return pulls.select("slug", "number", F.lit(None).cast("string").alias("error")).unionByName(errors.select("slug", F.lit(None).cast("long").alias("number"), "error"))


@query("SELECT s_suppkey AS number FROM supplier WHERE s_nationkey = 3")
def pulls_of_repository(spark, sf_dir):
    """F7."""
    rows = table(spark, sf_dir, "supplier").select(F.lit("o").alias("owner"), F.concat(F.lit("r"), text("s_nationkey")).alias("repo"), F.col("s_suppkey").alias("number"))
    return catalog.of_repository(rows, "o/r3").select("number")


@query("SELECT event_id FROM events WHERE event_type <> 'error' AND event_id % 2 = 0 UNION ALL SELECT event_id FROM events WHERE event_id % 2 = 1")
def unarchived_reviews(spark, sf_dir):
    """archived ones only where asked for."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "archived").alias("status"))
    return catalog.unarchived(rows.filter("event_id % 2 = 0")).select("event_id").unionByName(catalog.unarchived(rows.filter("event_id % 2 = 1"), True).select("event_id"))


@query("SELECT r_name AS name, (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS pos FROM region")
def repository_by_name(spark, sf_dir):
    """The first of a name in the configured order."""
    wanted = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), "r_regionkey")
    repos = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("name"), F.col("n_nationkey").alias("pos"))
    return catalog.by_name(wanted.select("name"), repos)


@query("""
SELECT s_suppkey AS number, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS title, CASE WHEN s_suppkey % 3 = 0 THEN 'a' ELSE 'unknown' END AS author, CASE WHEN s_suppkey % 5 = 0 THEN 'closed' ELSE 'open' END AS state, CASE WHEN s_suppkey % 7 = 0 THEN 5 ELSE 0 END AS additions FROM supplier""")
def pull_rows(spark, sf_dir):
    """the columns of a listed pull request, with their defaults."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.lit("o").alias("owner"), F.lit("r").alias("repo"), k.alias("number"), F.when(k % 2 == 0, F.col("s_name")).alias("title"), F.when(k % 3 == 0, "a").alias("author"), F.when(k % 5 == 0, "closed").alias("state"), F.lit("t").alias("updated_at"), F.when(k % 7 == 0, 5).alias("additions"), F.lit(None).cast("int").alias("deletions"), F.lit(None).cast("int").alias("changed_files"))
    return scans.pull_rows(rows).select("number", "title", "author", "state", "additions")


@query(r"""
SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS cut, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN coalesce(lang, 'x') || '.' || source ELSE source END AS qualified,
       CASE doc_id % 4 WHEN 3 THEN NULL ELSE '{"id": ' || doc_id || '}' END AS json, lang || '|repo' AS scopes FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL""")
def text_rules(spark, sf_dir):
    """P8, P21, P25, P26."""
    rows = table(spark, sf_dir, "documents").filter("text is not null and lang is not null and source is not null")
    k, j = F.col("doc_id"), F.concat(F.lit('{"id": '), text("doc_id"), F.lit("}"))
    answer = F.when(k % 4 == 0, j).when(k % 4 == 1, F.concat(F.lit("Here:\n```json\n"), j, F.lit("\n```\nend"))).when(k % 4 == 2, F.concat(F.lit("so "), j, F.lit(" it is"))).otherwise("no answer { here")
    name = S.qualified_name(F.when(k % 3 == 0, F.col("source")).otherwise(""), F.when(k % 3 == 1, F.col("lang")), F.col("source"))
    scopes = S.scopes(F.concat(F.lit(" "), F.col("lang"), F.lit(", ,repo,")))
    return rows.select("doc_id", S.truncate(F.col("text"), 80, 77).alias("cut"), name.alias("qualified"), S.json_of(answer).alias("json"), F.array_join(scopes, "|").alias("scopes"))


@query(cte(", p AS (SELECT a.split_id, a.change_id AS a, b.change_id AS b, list_intersect([a.d, a.u], [b.d, b.u]) AS i, list_distinct([a.d, a.u, b.d, b.u]) AS u FROM changes a JOIN changes b ON b.split_id = a.split_id AND b.change_ord = a.change_ord + 1) SELECT split_id, a, b, round(len(list_distinct(i)) / len(u), 9) AS similarity FROM p"))
def neighbour_similarity(spark, sf_dir):
    """M4: Jaccard of two sets."""
    rows = adapters.changes(spark, sf_dir)
    names = F.array("d", "u")
    a = rows.select("split_id", F.col("change_id").alias("a"), names.alias("x"), (F.col("change_ord") + 1).alias("n"))
    b = rows.select("split_id", F.col("change_id").alias("b"), names.alias("y"), F.col("change_ord").alias("n"))
    return a.join(b, ["split_id", "n"]).select("split_id", "a", "b", r9(S.jaccard(F.col("x"), F.col("y"))).alias("similarity"))


@query(cte(", ord AS (SELECT split_id, max(patch_id) AS top, count(*) AS k FROM patches GROUP BY 1) SELECT split_id, CAST(k AS INT) AS max_dependency_depth FROM ord"))
def chain_depths(spark, sf_dir):
    """Each patch depends on the one before it."""
    rows = _layer_patches(spark, sf_dir)
    before = F.lag("patch_id").over(Window.partitionBy("split_id").orderBy("patch_id"))
    return quality.chain_depths(rows.select("split_id", "patch_id", F.array_compact(F.array(before)).alias("depends_on")))


@query(cte("SELECT p.split_id, p.patch_id, CASE WHEN p.patch_id = 1 THEN 'Short' ELSE 'Layer ' || p.layer END AS name FROM patches p"))
def summarised_patches(spark, sf_dir):
    """N3, 2.12: a registered summarizer's names, the rule's own where it has none."""
    splitting.register_summarizer(lambda p: p.filter("patch_id = 1").select("split_id", "patch_id", F.lit("Short").alias("name"), F.lit(None).cast("string").alias("description")))
    try:
        return splitting.summarised(_patches(spark, sf_dir)).select("split_id", "patch_id", "name")
    finally:
        splitting.SUMMARIZERS.pop()


@query(queries._recursive(queries._REACH_SQL + """
SELECT d.split_id, d.source AS a, d.target AS b, NOT EXISTS (SELECT 1 FROM reach r WHERE r.split_id = d.split_id AND r.source = d.target AND r.target = d.source)
       AND NOT EXISTS (SELECT 1 FROM deps s WHERE s.split_id = d.split_id AND s.strength >= 1 AND ((s.source = d.source AND s.target = d.target) OR (s.source = d.target AND s.target = d.source))) AS separable
FROM (SELECT DISTINCT split_id, source, target FROM deps) d"""))
def separable_pairs(spark, sf_dir):
    """May the two changes of an edge be parted? For every edge."""
    edges = _usage_deps(spark, sf_dir)
    pairs = edges.select("split_id", F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    return graph.separable(graph.cycles(edges), edges, pairs)


@query("SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN '/r/' || s_name ELSE '' END AS path, CASE WHEN s_suppkey % 3 = 0 THEN 'in ' || s_nationkey ELSE '' END AS description FROM supplier")
def listed_repositories(spark, sf_dir):
    """the columns of a listed repository, with their defaults."""
    rows = table(spark, sf_dir, "supplier")
    held = lambda n, c: F.when(F.col("s_suppkey") % n == 0, c)
    return scans.repository_rows(rows.select(F.col("s_name").alias("name"), held(2, F.concat(F.lit("/r/"), F.col("s_name"))).alias("path"), held(3, F.concat(F.lit("in "), F.col("s_nationkey").cast("string"))).alias("description")))
