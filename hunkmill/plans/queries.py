"""Queries over the driver's tables, one for each operator or family of operators, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..operators import catalog, deps, extract, graph, grouping, quality, splitting
from ..sources import catalog as scans
from ..sources import diffs, sinks
from . import adapters, engine, plan_sql
from .adapters import cte, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def joined(ids: Column) -> Column:
    return F.array_join(ids, ",")


def r9(c: Column) -> Column:
    return F.round(c, 9)


def _layer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.changes(spark, sf_dir).withColumn("layer", S.pack_layer(F.col("file")))
    nth = F.array_position(F.array(*map(F.lit, fixed.LAYERS)), F.col("layer")) - 1
    return rows.withColumn("patch_id", nth.cast("int"))


def _layer_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch for each layer of a change set."""
    rows = _layer_parts(spark, sf_dir).withColumn("lines", F.col("added_lines") + F.col("deleted_lines"))
    out = rows.groupBy("split_id", "layer", "patch_id").agg(F.sum("lines").alias("size_lines"), F.count(F.lit(1)).alias("hunks"), F.count_distinct("file").alias("files"))
    return out.withColumn("n_warnings", F.size(splitting.warnings(F.col("size_lines"), F.col("hunks"))))


_SIZE_SCORE = "CASE WHEN size_lines = 0 THEN 0 WHEN size_lines < 10 THEN 0.3 WHEN size_lines < 50 THEN 0.3 + (size_lines - 10) / 40.0 * 0.7 WHEN size_lines <= 200 THEN 1.0 WHEN size_lines <= 500 THEN 1.0 - (size_lines - 200) / 300.0 * 0.7 ELSE 0.1 END"
_REVIEW = f"(0.5 * ({_SIZE_SCORE}) + 0.3 / (1 + 0.2 * (files - 1)) + 0.2 * greatest(0, 1 - 0.2 * n_warnings))"


@query(cte(f"""
SELECT split_id, count(*) AS num_patches, CAST(sum(size_lines) AS BIGINT) AS total_lines, round(avg(size_lines), 9) AS avg_patch_size, max(size_lines) AS max_patch_size,
       min(size_lines) AS min_patch_size, round(var_pop(size_lines), 9) AS size_variance, CAST(sum(CAST(n_warnings > 0 AS INT)) AS BIGINT) AS patches_with_warnings,
       round(CASE WHEN count(*) < 2 OR avg(size_lines) = 0 THEN 1 ELSE greatest(0, 1 - stddev_pop(size_lines) / avg(size_lines)) END, 9) AS balance_score,
       round(avg({_REVIEW}), 9) AS reviewability_score
FROM patches GROUP BY split_id"""))
def metrics_by_split(spark, sf_dir):
    """A17, M1, M3, M5 over layer patches."""
    out = quality.measures(_layer_patches(spark, sf_dir))
    return out.select("split_id", "num_patches", "total_lines", r9(F.col("avg_patch_size")).alias("avg_patch_size"), "max_patch_size", "min_patch_size", r9(F.col("size_variance")).alias("size_variance"), "patches_with_warnings", r9(F.col("balance_score")).alias("balance_score"), r9(F.col("reviewability_score")).alias("reviewability_score"))


@query(cte("SELECT split_id, CAST(sum(added_lines) AS BIGINT) AS additions, CAST(sum(deleted_lines) AS BIGINT) AS deletions, count(DISTINCT file) AS n_files, array_to_string(list_sort(list(DISTINCT file)), ',') AS files FROM changes GROUP BY split_id"))
def diff_stats(spark, sf_dir):
    """A1, A2."""
    return diffs.stats(adapters.changes(spark, sf_dir)).withColumn("files", joined(F.col("files")))


_SUFFIXES = [".py", ".rb", ".php", ".go", ".h", ".tsx"]


@query(f"""
WITH f AS (SELECT user_id, event_id, ({_SUFFIXES!r})[(event_id * 7 + user_id) % {len(_SUFFIXES)} + 1] AS ext FROM events),
e AS (SELECT user_id, ext, count(*) AS n, min(event_id) AS first FROM f GROUP BY 1, 2),
t AS (SELECT user_id, arg_max(ext, n * 1000000000000 - first) AS ext FROM e GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS split_id, CASE ext {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.MAIN_LANGUAGES.items())} ELSE 'unknown' END AS language FROM t""")
def mode_first_seen(spark, sf_dir):
    """A3: the language of the most frequent suffix, ties to the first seen."""
    ext = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(len(_SUFFIXES))) + 1).cast("int"))
    files = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("split_id"), F.col("event_id").alias("pos"), F.concat(F.lit("a/f"), ext).alias("file"))
    return diffs.main_language(files)


@query(cte("SELECT split_id, dir AS key, count(*) AS n, CASE WHEN count(*) > 1 THEN 0.85 ELSE 0.7 END AS score, string_agg(change_id, ',' ORDER BY change_ord) AS change_ids FROM changes GROUP BY split_id, dir"))
def group_by_directory(spark, sf_dir):
    """A5, P6."""
    return grouping.by_directory(adapters.changes(spark, sf_dir)).select("split_id", "key", "n", "score", joined(F.col("change_ids")).alias("change_ids"))


@query(cte("""
, g AS (SELECT *, greatest(0, line_start - lag(line_end) OVER (PARTITION BY split_id, file ORDER BY line_start, change_ord)) AS raw, lag(line_end) OVER (PARTITION BY split_id, file ORDER BY line_start, change_ord) AS prev FROM changes),
f AS (SELECT split_id, file, count(*) AS n, string_agg(change_id, ',' ORDER BY change_ord) AS change_ids, min(change_ord) AS first,
             greatest(0.5, 1 - coalesce(avg(CASE WHEN prev IS NOT NULL THEN raw END), 0) / 100.0) AS score FROM g GROUP BY split_id, file),
o AS (SELECT *, row_number() OVER (PARTITION BY split_id ORDER BY first) - 1 AS idx FROM f)
SELECT split_id, file AS key, idx, n, round(score, 9) AS score, change_ids FROM o WHERE n > 1"""))
def group_by_file(spark, sf_dir):
    """A6, M2, W2."""
    return grouping.by_file(adapters.changes(spark, sf_dir)).select("split_id", "key", "idx", "n", r9(F.col("score")).alias("score"), joined(F.col("change_ids")).alias("change_ids"))


@query(cte("SELECT split_id, layer AS key, count(*) AS n, CASE layer WHEN 'interface' THEN 0.9 WHEN 'util' THEN 0.85 WHEN 'controller' THEN 0.8 ELSE 0.75 END AS score, string_agg(change_id, ',' ORDER BY change_ord) AS change_ids FROM layered GROUP BY split_id, layer"))
def group_by_layer(spark, sf_dir):
    """A7, F16."""
    return grouping.by_layer(adapters.changes(spark, sf_dir)).select("split_id", "key", "n", "score", joined(F.col("change_ids")).alias("change_ids"))


@query(cte("""
, o AS (SELECT DISTINCT split_id, name, change_id, change_ord FROM symbols)
SELECT s.split_id, s.name AS key, s.n, string_agg(o.change_id, ',' ORDER BY o.change_ord) AS change_ids
FROM (SELECT split_id, name, count(*) AS n FROM symbols GROUP BY 1, 2 HAVING count(*) >= 3) s JOIN o ON o.split_id = s.split_id AND o.name = s.name GROUP BY 1, 2, 3"""))
def rename_groups(spark, sf_dir):
    """A8."""
    return grouping.renames(adapters.symbols(spark, sf_dir)).select("split_id", "key", "n", joined(F.col("change_ids")).alias("change_ids"))


@query(cte("""
, n AS (SELECT DISTINCT split_id, name, change_id FROM symbols),
k AS (SELECT split_id, name FROM n GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT n.split_id, n.change_id, string_agg(n.name, ',' ORDER BY n.name) AS names FROM n JOIN k ON n.split_id = k.split_id AND n.name = k.name GROUP BY 1, 2"""))
def shared_symbol_index(spark, sf_dir):
    """A9."""
    return grouping.shared_names(adapters.symbols(spark, sf_dir)).withColumn("names", joined(F.col("names")))


@query(cte("""
, n AS (SELECT DISTINCT split_id, name, change_id FROM symbols),
z AS (SELECT split_id, change_id, count(*) AS size FROM n GROUP BY 1, 2),
p AS (SELECT a.split_id, a.change_id AS a, b.change_id AS b, count(*) AS k FROM n a JOIN n b ON a.split_id = b.split_id AND a.name = b.name AND a.change_id < b.change_id GROUP BY 1, 2, 3)
SELECT p.split_id, a, b, round(k / (x.size + y.size - k), 9) AS similarity FROM p JOIN z x ON x.split_id = p.split_id AND x.change_id = a JOIN z y ON y.split_id = p.split_id AND y.change_id = b WHERE k / (x.size + y.size - k) > 0.3"""))
def similar_changes(spark, sf_dir):
    """A10's pairs, U4."""
    return grouping.similar_pairs(adapters.symbols(spark, sf_dir)).withColumn("similarity", r9(F.col("similarity")))


@query(plan_sql.clusters())
def symbol_clusters(spark, sf_dir):
    """A10: greedy, order-dependent."""
    return splitting.symbol_groups(adapters.symbols(spark, sf_dir)).select("split_id", joined(F.col("change_ids")).alias("change_ids"))


@query(cte("""
, d AS (SELECT DISTINCT split_id, change_id FROM symbols WHERE type IN ('function', 'class')),
a AS (SELECT c.*, regexp_extract(file, '[^/]*$') AS base FROM changes c JOIN d USING (split_id, change_id) WHERE c.type = 'add'),
g AS (SELECT *, regexp_extract(file, '[^/]*$') AS base FROM changes WHERE type = 'delete')
SELECT a.split_id, a.change_id AS key, a.change_id || ',' || string_agg(g.change_id, ',' ORDER BY g.change_ord) AS change_ids
FROM a JOIN g ON a.split_id = g.split_id AND (a.dir = g.dir OR contains(split_part(a.base, '.', 1), split_part(g.base, '.', 1)) OR contains(split_part(g.base, '.', 1), split_part(a.base, '.', 1))) GROUP BY 1, 2"""))
def extraction_groups(spark, sf_dir):
    """J6, P7."""
    return grouping.extractions(adapters.changes(spark, sf_dir), adapters.symbols(spark, sf_dir)).select("split_id", "key", joined(F.col("change_ids")).alias("change_ids"))


@query(cte("""
, n AS (SELECT DISTINCT split_id, change_id, change_ord, name FROM symbols),
a AS (SELECT DISTINCT s.split_id, s.change_id FROM symbols s JOIN changes c USING (split_id, change_id) WHERE s.type IN ('function', 'method') AND c.type = 'modify'),
u AS (SELECT DISTINCT x.split_id, x.change_id AS key, y.change_id, y.change_ord FROM n x JOIN a USING (split_id, change_id) JOIN n y ON x.split_id = y.split_id AND x.name = y.name AND x.change_id <> y.change_id)
SELECT split_id, key, key || ',' || string_agg(change_id, ',' ORDER BY change_ord) AS change_ids FROM u GROUP BY 1, 2"""))
def api_change_groups(spark, sf_dir):
    """J7."""
    return grouping.api_changes(adapters.changes(spark, sf_dir), adapters.symbols(spark, sf_dir)).select("split_id", "key", joined(F.col("change_ids")).alias("change_ids"))


@query(cte("SELECT split_id, source, target, strength, 'Uses ' || name AS reason FROM deps"))
def usage_dependencies(spark, sf_dir):
    """J1, J3, A31, W4."""
    rows = deps._with_strength(deps.usage_edges(adapters.symbols(spark, sf_dir)), adapters.changes(spark, sf_dir))
    return rows.select("split_id", "source", "target", "strength", F.concat(F.lit("Uses "), F.col("name")).alias("reason"))


@query(cte("""
SELECT DISTINCT a.split_id, a.change_id AS source, b.change_id AS target, 'pkg' || a.u || '/api' AS path FROM changes a
JOIN changes b ON a.split_id = b.split_id AND b.dir = 'pkg' || a.u || '/api' AND a.change_id <> b.change_id"""))
def import_dependencies(spark, sf_dir):
    """J2, A30."""
    return deps.import_edges(adapters.imports(spark, sf_dir), adapters.changes(spark, sf_dir)).select("split_id", "source", "target", "path")


@query(cte("SELECT split_id, name AS key, target FROM (SELECT split_id, 'ns.' || name AS name, target FROM definers) UNION ALL SELECT split_id, file || ':' || name, max_by(change_id, change_ord) FROM symbols WHERE role = 'definition' GROUP BY split_id, file, name"))
def symbol_index(spark, sf_dir):
    """A31."""
    return deps.symbol_index(adapters.symbols(spark, sf_dir))


@query(cte("SELECT DISTINCT split_id, dir AS path, change_id FROM changes"))
def package_index(spark, sf_dir):
    """A30."""
    return deps.package_index(adapters.changes(spark, sf_dir))


def _usage_deps(spark, sf_dir) -> DataFrame:
    return deps._with_strength(deps.usage_edges(adapters.symbols(spark, sf_dir)), adapters.changes(spark, sf_dir))


def _recursive(text: str) -> str:
    return adapters.SQL.replace("\nWITH c0", "\nWITH RECURSIVE c0", 1) + text


_REACH_SQL = ", reach AS (SELECT DISTINCT split_id, source, target FROM deps UNION SELECT r.split_id, r.source, d.target FROM reach r JOIN deps d ON d.split_id = r.split_id AND d.source = r.target)"


@query(_recursive(_REACH_SQL + " SELECT split_id, source, target FROM reach"))
def transitive_closure(spark, sf_dir):
    """G8."""
    return graph.reach(_usage_deps(spark, sf_dir))


@query(_recursive(_REACH_SQL + " SELECT a.split_id, a.source AS change_id, least(a.source, min(a.target)) AS scc FROM reach a JOIN reach b ON a.split_id = b.split_id AND a.source = b.target AND a.target = b.source WHERE a.source <> a.target GROUP BY a.split_id, a.source"))
def dependency_cycles(spark, sf_dir):
    """G2."""
    return graph.cycles(_usage_deps(spark, sf_dir))


@query(_recursive(_REACH_SQL.replace("FROM deps UNION", "FROM deps WHERE strength >= 1 UNION").replace("JOIN deps d ON", "JOIN (SELECT * FROM deps WHERE strength >= 1) d ON") + " SELECT a.split_id, a.source AS change_id, least(a.source, min(a.target)) AS scc FROM reach a JOIN reach b ON a.split_id = b.split_id AND a.source = b.target AND a.target = b.source WHERE a.source <> a.target GROUP BY a.split_id, a.source"))
def strong_cycles(spark, sf_dir):
    """G3."""
    return graph.cycles(_usage_deps(spark, sf_dir), 1.0)


@query(_recursive(_REACH_SQL + """
, s AS (SELECT a.split_id, a.source AS change_id, least(a.source, min(a.target)) AS scc FROM reach a JOIN reach b ON a.split_id = b.split_id AND a.source = b.target AND a.target = b.source WHERE a.source <> a.target GROUP BY a.split_id, a.source),
n AS (SELECT split_id, count(*) AS nodes FROM changes GROUP BY 1), e AS (SELECT split_id, count(*) AS edges FROM deps GROUP BY 1),
k AS (SELECT split_id, count(*) AS m, count(DISTINCT scc) AS r FROM s GROUP BY 1)
SELECT n.split_id, nodes, coalesce(edges, 0) AS edges, nodes - coalesce(m, 0) + coalesce(r, 0) AS components, coalesce(m, 0) = 0 AS is_dag, round(coalesce(edges, 0) / nodes, 9) AS avg_degree
FROM n LEFT JOIN e ON n.split_id = e.split_id LEFT JOIN k ON n.split_id = k.split_id"""))
def graph_statistics(spark, sf_dir):
    """A23."""
    edges = _usage_deps(spark, sf_dir)
    return graph.statistics(adapters.changes(spark, sf_dir), edges, graph.cycles(edges)).withColumn("avg_degree", r9(F.col("avg_degree")))


@query(_recursive(_REACH_SQL + """
, s AS (SELECT a.split_id, a.source AS change_id, least(a.source, min(a.target)) AS scc FROM reach a JOIN reach b ON a.split_id = b.split_id AND a.source = b.target AND a.target = b.source WHERE a.source <> a.target GROUP BY a.split_id, a.source)
SELECT DISTINCT split_id, a, b FROM (SELECT split_id, scc AS a, change_id AS b FROM s WHERE scc <> change_id UNION ALL SELECT split_id, change_id, scc FROM s WHERE scc <> change_id
 UNION ALL SELECT split_id, source, target FROM deps WHERE strength >= 1 UNION ALL SELECT split_id, target, source FROM deps WHERE strength >= 1)"""))
def inseparable_changes(spark, sf_dir):
    """G7."""
    edges = _usage_deps(spark, sf_dir)
    return graph.inseparable(edges, graph.cycles(edges))


@query(_recursive(_REACH_SQL + """
, s AS (SELECT a.split_id, a.source AS change_id, least(a.source, min(a.target)) AS scc FROM reach a JOIN reach b ON a.split_id = b.split_id AND a.source = b.target AND a.target = b.source WHERE a.source <> a.target GROUP BY a.split_id, a.source)
SELECT s.split_id, string_agg(s.change_id, ',' ORDER BY c.change_ord) AS change_ids, CAST(sum(c.lines) AS BIGINT) AS size FROM s JOIN changes c ON c.split_id = s.split_id AND c.change_id = s.change_id GROUP BY s.split_id, s.scc"""))
def atomic_cycles(spark, sf_dir):
    """Cycles within the bound stay whole."""
    edges = _usage_deps(spark, sf_dir)
    rows = adapters.changes(spark, sf_dir)
    groups = graph.atomic_groups(graph.cycles(edges), graph.cycles(edges, 1.0), rows, 10**9).filter("group_id like 'scc%'")
    return groups.join(graph.group_sizes(groups, rows), ["split_id", "group_id"]).select("split_id", joined(F.col("change_ids")).alias("change_ids"), "size")


_RINGS_SQL = """
, s{n} AS (SELECT a.split_id, a.source AS change_id, least(a.source, min(a.target)) AS scc FROM {r} a JOIN {r} b ON a.split_id = b.split_id AND a.source = b.target AND a.target = b.source WHERE a.source <> a.target GROUP BY a.split_id, a.source)"""


@query(_recursive(_REACH_SQL + _REACH_SQL.replace(", reach AS", ", firm AS").replace("FROM deps UNION", "FROM deps WHERE strength >= 1 UNION").replace("FROM reach r JOIN deps d ON", "FROM firm r JOIN (SELECT * FROM deps WHERE strength >= 1) d ON") + _RINGS_SQL.format(n=0, r="reach") + _RINGS_SQL.format(n=1, r="firm") + """
, rings AS (SELECT 0 AS family, 'scc' AS kind, * FROM s0 UNION ALL SELECT 1, 'strong', * FROM s1),
rows AS (SELECT r.*, c.change_ord, c.lines, c.dir, c.file LIKE '%/models/%' AS face, sum(c.lines) OVER w AS total, count(*) OVER w AS n, min(c.change_ord) OVER w AS first FROM rings r JOIN changes c USING (split_id, change_id) WINDOW w AS (PARTITION BY r.split_id, r.family, r.scc)),
spread AS (SELECT split_id, family, scc, count(DISTINCT dir) AS dirs, count(DISTINCT face) AS faces FROM rows GROUP BY 1, 2, 3),
parts AS (SELECT *, CASE WHEN total > 60 AND n > 2 AND dirs > 1 THEN dir WHEN total > 60 AND n > 2 AND faces > 1 THEN CASE WHEN face THEN 'interface' ELSE 'impl' END ELSE '' END AS part,
                 dense_rank() OVER (PARTITION BY split_id, family ORDER BY first) - 1 AS nth FROM rows JOIN spread USING (split_id, family, scc)),
made AS (SELECT split_id, family, nth, part, kind || '_' || nth || CASE WHEN part <> '' THEN '_' || part ELSE '' END AS group_id, CASE family WHEN 0 THEN 'Circular dependency' ELSE 'Strong dependencies' END AS reason,
                string_agg(change_id, ',' ORDER BY change_ord) AS change_ids, CAST(sum(lines) AS BIGINT) AS size FROM parts GROUP BY split_id, family, nth, part, kind)
SELECT split_id, row_number() OVER (PARTITION BY split_id ORDER BY family, nth, part) - 1 AS group_ord, group_id, reason, change_ids, size FROM made"""))
def atomic_groups(spark, sf_dir):
    """Cycles and strong cycles, large ones cut by directory or by interface."""
    edges = _usage_deps(spark, sf_dir)
    rows = adapters.changes(spark, sf_dir)
    groups = graph.atomic_groups(graph.cycles(edges), graph.cycles(edges, 1.0), rows, 60)
    return groups.join(graph.group_sizes(groups, rows), ["split_id", "group_id"]).withColumn("change_ids", joined(F.col("change_ids")))


# Edges that point to earlier changes only, so that levels exist.
_BACK_SQL = ", b AS (SELECT d.split_id, d.source, d.target FROM deps d JOIN changes x ON x.split_id = d.split_id AND x.change_id = d.target WHERE x.change_ord < d.change_ord)"


def _backward(spark, sf_dir) -> DataFrame:
    edges = deps.usage_edges(adapters.symbols(spark, sf_dir)).select("split_id", "source", "target")
    return deps.with_ends(edges, adapters.changes(spark, sf_dir), "change_ord").filter("t.change_ord < s.change_ord").drop("s", "t")


@query(_recursive(_BACK_SQL + """
, lv AS (SELECT split_id, change_id, 0 AS level FROM changes UNION SELECT b.split_id, b.source, lv.level + 1 FROM lv JOIN b ON b.split_id = lv.split_id AND b.target = lv.change_id),
m AS (SELECT split_id, change_id, max(level) AS level FROM lv GROUP BY 1, 2)
SELECT m.split_id, m.change_id, m.level, row_number() OVER (PARTITION BY m.split_id ORDER BY m.level, c.change_ord) - 1 AS place FROM m JOIN changes c USING (split_id, change_id)"""))
def prerequisite_order(spark, sf_dir):
    """G9, G11's relational twin: prerequisites first, by (level, place)."""
    rows = adapters.changes(spark, sf_dir).select("split_id", "change_id", "change_ord")
    return graph.levels(rows, _backward(spark, sf_dir).select("split_id", "source", "target"))


@query(cte("SELECT DISTINCT d.split_id, a.patch_id AS patch_id, b.patch_id AS needs FROM deps d JOIN (SELECT l.split_id, l.change_id, p.patch_id FROM layered l JOIN patches p ON p.split_id = l.split_id AND p.layer = l.layer) a ON a.split_id = d.split_id AND a.change_id = d.source JOIN (SELECT l.split_id, l.change_id, p.patch_id FROM layered l JOIN patches p ON p.split_id = l.split_id AND p.layer = l.layer) b ON b.split_id = d.split_id AND b.change_id = d.target WHERE a.patch_id <> b.patch_id"))
def patch_dependencies(spark, sf_dir):
    """J10."""
    return splitting.patch_edges(_usage_deps(spark, sf_dir), _layer_parts(spark, sf_dir))


@query(cte("""SELECT split_id, layer, size_lines, hunks, files, n_warnings FROM patches"""))
def layer_patches(spark, sf_dir):
    """A14, F17."""
    return _layer_patches(spark, sf_dir).select("split_id", "layer", "size_lines", "hunks", "files", "n_warnings")


@query(cte("""
, k AS (SELECT split_id, layer, count(*) FILTER (type = 'add') AS a, count(*) FILTER (type = 'modify') AS m, count(*) FILTER (type = 'delete') AS d FROM layered GROUP BY 1, 2)
SELECT split_id, layer, concat_ws(', ', CASE WHEN a > 0 THEN a || ' additions' END, CASE WHEN m > 0 THEN m || ' modifications' END, CASE WHEN d > 0 THEN d || ' deletions' END) AS description FROM k"""))
def patch_descriptions(spark, sf_dir):
    """A15."""
    return _layer_parts(spark, sf_dir).groupBy("split_id", "layer").agg(splitting.type_counts().alias("description"))


#: Lines of a patch in the plans of the test tables, whose change sets are small.
TARGET = 40


def _packed(spark, sf_dir) -> DataFrame:
    """Every change set of the table, packed for its plan."""
    changes, symbols = adapters.changes(spark, sf_dir), adapters.symbols(spark, sf_dir)
    return splitting.pack(changes, symbols, deps.dependencies(changes, symbols, adapters.imports(spark, sf_dir)))


@query(plan_sql.kept_groups())
def kept_groups(spark, sf_dir):
    """All families of groups, and those that the cover rule keeps."""
    return splitting.kept_groups(_packed(spark, sf_dir)).select("split_id", "group_ord", "group_id", r9(F.col("score")).alias("score"), joined(F.array_sort("change_ids")).alias("change_ids"))


@query(plan_sql.candidates(TARGET))
def split_candidates(spark, sf_dir):
    """Cycles, packed layers, single changes."""
    return splitting.candidates(_packed(spark, sf_dir), TARGET).select("split_id", "nth", joined(F.array_sort("change_ids")).alias("change_ids"))


@query(plan_sql.merged(TARGET))
def merged_candidates(spark, sf_dir):
    """A13, J8, M4."""
    return splitting.merged(_packed(spark, sf_dir), TARGET).select("split_id", "nth", joined(F.col("change_ids")).alias("change_ids"))


def _plan(spark, sf_dir, keep: bool = True) -> engine.Plan:
    changes = adapters.changes(spark, sf_dir)
    changes = changes.persist() if keep else changes
    symbols = adapters.symbols(spark, sf_dir, changes)
    return engine.plan(changes, symbols, deps.dependencies(changes, symbols, adapters.imports(spark, sf_dir, changes)), TARGET, keep=keep)


@query(plan_sql.patches(TARGET))
def split_patches(spark, sf_dir):
    """The whole plan: A11-A16, G11-G12, J8, L2, M4, N6, U2, U3."""
    p = _plan(spark, sf_dir, keep=False)
    return p.patches.select("split_id", "patch_id", "name", "description", joined(F.col("changes")).alias("changes"), joined(F.transform("depends_on", lambda d: d.cast("string"))).alias("depends_on"), "size_lines", joined(F.col("warnings")).alias("warnings"))


@query(plan_sql.metrics(TARGET, _SIZE_SCORE))
def split_metrics(spark, sf_dir):
    """A17, A19, G14 of the whole plan."""
    p = _plan(spark, sf_dir)
    out = quality.metrics_and_suggestions(p.patches)
    return out.select("split_id", "num_patches", "total_lines", r9(F.col("avg_patch_size")).alias("avg_patch_size"), "max_patch_size", "min_patch_size", "max_dependency_depth", r9(F.col("balance_score")).alias("balance_score"), r9(F.col("reviewability_score")).alias("reviewability_score"), F.array_join("suggestions", "; ").alias("suggestions"))


@query("SELECT 'valid' AS status, count(DISTINCT l_orderkey) AS splits FROM lineitem")
def plan_is_valid(spark, sf_dir):
    """A18 on the engine's own plans, which have no finding; spoilt_plans has plans with findings."""
    p = _plan(spark, sf_dir)
    bad = quality.validate(p.patches, p.changes).select("split_id").distinct().withColumn("bad", F.lit(True))
    rows = p.changes.select("split_id").distinct().join(bad, "split_id", "left")
    return rows.groupBy(F.when(F.col("bad"), "invalid").otherwise("valid").alias("status")).agg(F.count(F.lit(1)).alias("splits"))


@query(cte("""
, p AS (SELECT split_id, CAST(change_ord % 3 AS INT) AS patch_id, change_id FROM changes WHERE change_ord % 5 <> 4 UNION ALL SELECT split_id, CAST((change_ord + 1) % 3 AS INT), change_id FROM changes WHERE change_ord % 7 = 2),
n AS (SELECT split_id, patch_id, count(*) AS k FROM p GROUP BY 1, 2),
found AS (
  SELECT split_id, 'missing change' AS problem, change_id AS what FROM changes c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.split_id = c.split_id AND p.change_id = c.change_id)
  UNION ALL SELECT split_id, 'repeated change', change_id FROM (SELECT split_id, change_id, count(*) AS k FROM p GROUP BY 1, 2), LATERAL (SELECT unnest(range(k - 1)))
  UNION ALL SELECT split_id, 'depends on later', CAST(patch_id AS VARCHAR) FROM n WHERE k % 2 = patch_id % 2)
SELECT split_id, problem, what, count(*) AS times FROM found GROUP BY 1, 2, 3"""))
def spoilt_plans(spark, sf_dir):
    """Patches that leave out every fifth change, repeat others and depend on later ones."""
    rows = adapters.changes(spark, sf_dir)
    own = rows.filter("change_ord % 5 <> 4").select("split_id", (F.col("change_ord") % 3).cast("int").alias("patch_id"), "change_id")
    own = own.unionByName(rows.filter("change_ord % 7 = 2").select("split_id", ((F.col("change_ord") + 1) % 3).cast("int").alias("patch_id"), "change_id"))
    patches = own.groupBy("split_id", "patch_id").agg(F.collect_list("change_id").alias("changes"))
    patches = patches.withColumn("depends_on", F.when(F.size("changes") % 2 == F.col("patch_id") % 2, F.array(F.col("patch_id") + 1)).otherwise(F.array().cast("array<int>")))
    return quality.validate(patches, rows).groupBy("split_id", "problem", "what").agg(F.count(F.lit(1)).alias("times"))


@query(cte("""
, k AS (SELECT DISTINCT split_id, change_id FROM changes WHERE type <> 'delete'), m AS (SELECT split_id, change_id FROM changes)
SELECT split_id, change_id FROM m EXCEPT SELECT split_id, change_id FROM k"""))
def missing_changes(spark, sf_dir):
    """Patches without the deletions miss them."""
    rows = adapters.changes(spark, sf_dir)
    return quality.missing(rows, rows.filter("type <> 'delete'").select("split_id", "change_id"))


@query("""
WITH p AS (SELECT CAST(l_orderkey AS VARCHAR) AS split_id, CAST(l_partkey AS VARCHAR) AS change_id, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_suppkey, l_linenumber, l_extendedprice) AS nth FROM lineitem)
SELECT split_id, change_id, count(*) AS again FROM p WHERE nth > 1 GROUP BY 1, 2""")
def repeated_changes(spark, sf_dir):
    """Later occurrences."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("split_id"), F.col("l_partkey").cast("string").alias("change_id"), F.col("l_suppkey").alias("patch_id"))
    return quality.repeated(rows).groupBy("split_id", "change_id").agg(F.count(F.lit(1)).alias("again"))


@query(cte("""
, s AS (SELECT l.split_id, l.layer, CASE WHEN l.u = 3 THEN 'import' WHEN l.layer = 'util' THEN 'variable' WHEN l.d % 2 = 0 THEN 'function' ELSE 'class' END AS kind FROM layered l WHERE l.layer <> 'impl' OR l.d < 3)
SELECT l.split_id, l.layer, CASE WHEN bool_or(coalesce(kind = 'import', false)) THEN 'refactor' WHEN bool_or(coalesce(kind IN ('function', 'class'), false)) THEN 'feature' ELSE 'other' END AS category
FROM (SELECT DISTINCT split_id, layer FROM layered) l LEFT JOIN s ON s.split_id = l.split_id AND s.layer = l.layer GROUP BY 1, 2"""))
def patch_categories(spark, sf_dir):
    """A change with u = 3 imports; utilities define nothing, implementations only some."""
    parts = _layer_parts(spark, sf_dir)
    kind = F.when(F.col("u") == 3, "import").when(F.col("layer") == "util", "variable").when(F.col("d") % 2 == 0, "function").otherwise("class")
    symbols = parts.filter("layer <> 'impl' or d < 3").select("split_id", "change_id", kind.alias("type"))
    names = parts.select("split_id", "patch_id", "layer").distinct()
    return splitting.categories(parts, symbols).join(names, ["split_id", "patch_id"]).select("split_id", "layer", "category")


@query(cte("""
, a AS (SELECT DISTINCT split_id, md5(CAST(d AS VARCHAR)) AS digest FROM changes), b AS (SELECT DISTINCT split_id, md5(CAST(u AS VARCHAR)) AS digest FROM changes)
SELECT coalesce(a.split_id, b.split_id) AS split_id, CAST(sum(CAST(b.digest IS NULL AS INT)) AS BIGINT) AS input_only, CAST(sum(CAST(a.digest IS NULL AS INT)) AS BIGINT) AS output_only, CAST(sum(CAST(a.digest IS NOT NULL AND b.digest IS NOT NULL AS INT)) AS BIGINT) AS common
FROM a FULL JOIN b ON a.split_id = b.split_id AND a.digest = b.digest GROUP BY 1"""))
def digest_reconcile(spark, sf_dir):
    """J17, U6."""
    rows = adapters.changes(spark, sf_dir)
    digest = lambda c: F.md5(F.col(c).cast("string").cast("binary")).alias("digest")
    return quality.reconcile(rows.select("split_id", digest("d")), rows.select("split_id", digest("u")))


@query(cte("SELECT split_id, change_id, CASE WHEN type = 'add' THEN 'Adds n' || d || ', n' || u || ' to ' || file WHEN type = 'modify' THEN 'Modifies n' || d || ', n' || u || ' in ' || file ELSE 'Removes n' || d || ', n' || u || ' from ' || file END AS description FROM changes"))
def change_descriptions(spark, sf_dir):
    """P24, K12."""
    names = F.array(F.concat(F.lit("n"), F.col("d").cast("string")), F.concat(F.lit("n"), F.col("u").cast("string")))
    return adapters.changes(spark, sf_dir).select("split_id", "change_id", S.change_description(F.col("type"), names, F.col("file"), F.col("added_lines"), F.col("deleted_lines")).alias("description"))


@query(cte("""
, n AS (SELECT DISTINCT split_id, file, name, role FROM symbols)
SELECT DISTINCT a.split_id, a.file AS file_a, b.file AS file_b FROM n a JOIN n b ON a.split_id = b.split_id AND a.name = b.name AND a.file <> b.file AND a.role = 'usage' AND b.role = 'definition'"""))
def file_dependencies(spark, sf_dir):
    """A file that uses what another defines."""
    return deps.file_edges(adapters.symbols(spark, sf_dir))


@query(cte("""
, g AS (SELECT split_id, dir AS group_id, change_id, file, line_start, line_end FROM changes),
w AS (SELECT *, greatest(0, line_start - lag(line_end) OVER (PARTITION BY split_id, group_id ORDER BY line_start, change_id)) AS raw, lag(line_end) OVER (PARTITION BY split_id, group_id ORDER BY line_start, change_id) AS prev FROM g),
b AS (SELECT split_id, group_id, count(*) AS n, count(DISTINCT file) AS files, least(1, coalesce(sum(CASE WHEN prev IS NOT NULL THEN raw END), 0) / 100.0) AS far FROM w GROUP BY 1, 2),
s AS (SELECT split_id, group_id, count(*) AS names, sum(CAST(k > 1 AS INT)) AS shared FROM (SELECT g.split_id, g.group_id, s.name, count(*) AS k FROM g JOIN symbols s USING (split_id, change_id) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT b.split_id, b.group_id, round(CASE WHEN n < 2 THEN 1 ELSE (CASE WHEN files = 1 THEN 1 ELSE 0.5 END) * 0.4 + shared / greatest(1, names) * 0.4 + (CASE WHEN files = 1 THEN 1 - far ELSE 0.5 END) * 0.2 END, 9) AS cohesion
FROM b JOIN s ON b.split_id = s.split_id AND b.group_id = s.group_id"""))
def group_cohesion(spark, sf_dir):
    """M6."""
    rows = adapters.changes(spark, sf_dir)
    groups = grouping.by_directory(rows).select("split_id", F.col("key").alias("group_id"), "change_ids")
    return grouping.score_cohesion(rows, adapters.symbols(spark, sf_dir), groups).withColumn("cohesion", r9(F.col("cohesion")))


@query(plan_sql.kept_groups())
def uncovered_groups(spark, sf_dir):
    """The relational form of the groups and of the cover rule."""
    every = splitting.semantic_groups(adapters.changes(spark, sf_dir), adapters.symbols(spark, sf_dir))
    kept = grouping.keep_uncovered(every)
    nth = F.row_number().over(Window.partitionBy("split_id").orderBy("group_ord")) - 1
    return kept.select("split_id", nth.alias("group_ord"), "group_id", r9(F.col("score")).alias("score"), joined(F.array_sort("change_ids")).alias("change_ids"))


@query(cte("SELECT split_id, change_id, file LIKE '%/models/%' AS interface FROM changes"))
def interface_files(spark, sf_dir):
    """F15."""
    return adapters.changes(spark, sf_dir).select("split_id", "change_id", S.interface_file(F.col("file")).alias("interface"))


@query(cte("SELECT split_id, change_id, substr(file, 6) AS file FROM changes WHERE file LIKE 'pkg1/%'"))
def path_filter(spark, sf_dir):
    """F1-F3, F12."""
    return diffs.filter_paths(adapters.changes(spark, sf_dir), "pkg1", strip=True).select("split_id", "change_id", "file")


_PATH = "'pkg' || p_partkey % 5 || '/Sub ' || p_size % 4 || '/f' || p_partkey || CASE WHEN p_partkey % 17 = 0 THEN '' ELSE '.' || (" + repr([x.lstrip(".") for x in fixed.LANGUAGES] + list(fixed.HIGHLIGHT)) + ")[p_partkey % " + str(len(fixed.LANGUAGES) + len(fixed.HIGHLIGHT)) + " + 1] END"
_choice = lambda key, table, other: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"
_HIGHLIGHT = _choice("lower(regexp_extract(file, '[^.]*$'))", fixed.HIGHLIGHT, "text")


@query(f"""
WITH f AS (SELECT p_partkey, {_PATH} AS file FROM part)
SELECT p_partkey, regexp_extract(file, '^(.*)/[^/]*$', 1) AS directory, split_part(file, '/', 2) AS package, CASE {" ".join(f"WHEN ends_with(file, '{k}') THEN '{v}'" for k, v in fixed.LANGUAGES.items())} ELSE 'unknown' END AS language,
       {_HIGHLIGHT} AS highlight, {_choice(_HIGHLIGHT, fixed.TYPE_NAMES, "Unknown")} AS type_name, CASE WHEN contains(regexp_extract(file, '[^/]*$'), '.') THEN {_choice("lower(regexp_extract(file, '[^.]*$'))", fixed.HIGHLIGHT, "default")} ELSE 'default' END AS icon,
       substr(replace(replace(file || file || file, ' ', '_'), '/', '_'), 1, 50) AS safe_name, CASE WHEN file LIKE 'pkg1/%' THEN 'root' || substr(file, 5) ELSE file END AS moved FROM f""")
def path_functions(spark, sf_dir):
    """P1, P5, P6, P14, P15, P18, P28, F18, over paths with all suffixes, and without one."""
    suffixes = [x.lstrip(".") for x in fixed.LANGUAGES] + list(fixed.HIGHLIGHT)
    key = F.col("p_partkey")
    suffix = F.when(key % 17 == 0, "").otherwise(F.concat(F.lit("."), F.element_at(F.array(*map(F.lit, suffixes)), (key % len(suffixes) + 1).cast("int"))))
    file = F.concat(F.lit("pkg"), (key % 5).cast("string"), F.lit("/Sub "), (F.col("p_size") % 4).cast("string"), F.lit("/f"), key.cast("string"), suffix)
    f = F.col("file")
    rows = table(spark, sf_dir, "part").select("p_partkey", file.alias("file"))
    return rows.select("p_partkey", S.directory(f).alias("directory"), S.package_of(f).alias("package"), S.language_of(f).alias("language"), S.highlight_language(f).alias("highlight"), S.type_name(f).alias("type_name"), S.icon_kind(f).alias("icon"), S.safe_file_name(F.concat(f, f, f)).alias("safe_name"), S.swap_root(f, "pkg1", "root").alias("moved"))


@query("""
SELECT doc_id, length(text) > 80 OR contains(text, chr(10)) AS cut, CASE WHEN length(split_part(text, chr(10), 1)) > 80 THEN substr(split_part(text, chr(10), 1), 1, 80) || '...' WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 1) || '...' ELSE split_part(text, chr(10), 1) END AS short,
       md5(text) AS digest, substr(md5(text), 1, 7) AS short_hash, regexp_replace(source || ':' || lang, '[^A-Za-z0-9_-]', '', 'g') AS safe_id FROM documents""")
def text_functions(spark, sf_dir):
    """P20, P21, P23."""
    t = F.col("text")
    digest = F.md5(t.cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", ((F.char_length(t) > 80) | F.contains(t, F.lit("\n"))).alias("cut"), S.first_line_cut(t).alias("short"), digest.alias("digest"), S.short_hash(digest).alias("short_hash"), S.safe_id(F.concat_ws(":", "source", "lang")).alias("safe_id"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(rtrim(text, chr(10)), chr(10))) AS line, generate_subscripts(string_split(rtrim(text, chr(10)), chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, md5(string_agg(regexp_replace(line, '[ \t\r\f\v]+$', ''), chr(10) ORDER BY pos)) AS digest FROM l WHERE regexp_replace(line, '[ \t\r\f\v]+$', '') <> '' AND NOT starts_with(line, '@@') GROUP BY doc_id""")
def line_digests(spark, sf_dir):
    """P9, S5 over the lines of documents."""
    return table(spark, sf_dir, "documents").select("doc_id", S.hunk_digest(F.split("text", "\n")).alias("digest"))


@query("""
WITH e AS (SELECT *, (epoch_us(ts) // 1000000) % 200000 AS age FROM events)
SELECT event_id, CASE WHEN age < 60 THEN 'just now' WHEN age < 3600 THEN age // 60 || 'm ago' WHEN age < 86400 THEN age // 3600 || 'h ago' ELSE age // 86400 || 'd ago' END AS told,
       CASE WHEN age < 60 THEN age || 's ago' WHEN age < 3600 THEN age // 60 || 'm ago' WHEN age < 86400 THEN age // 3600 || 'h ago' ELSE age // 86400 || 'd ago' END AS cached FROM e""")
def age_texts(spark, sf_dir):
    """P22, P29."""
    age = F.unix_timestamp("ts") % 200000
    return table(spark, sf_dir, "events").select("event_id", S.relative_time(age).alias("told"), S.cache_age(age).alias("cached"))


@query("""
SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error' AND (contains(lower(event_type), 'c') OR contains(CAST(user_id AS VARCHAR), 'C'))""")
def listing_search(spark, sf_dir):
    """F5, F8, F9."""
    rows = table(spark, sf_dir, "events").withColumn("state", F.when(F.col("event_type") == "error", "deleted"))
    return catalog.search(catalog.active(rows), "C", ("event_type",), "user_id").select("event_id", "user_id", "event_type")


@query("SELECT event_id, ts, event_type, true AS has_more FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def listing_page(spark, sf_dir):
    """L1, L4, O4, O5."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return catalog.page(rows, [F.desc("ts"), F.col("event_id")], 40, 20)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 50")
def newest_per_key(spark, sf_dir):
    """W8, S21."""
    return catalog.newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")], 50).select("user_id", "event_id")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def latest_wins(spark, sf_dir):
    """W7, U9, K6."""
    return catalog.first_of_each(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_id, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_id FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def neighbouring_turns(spark, sf_dir):
    """W9."""
    return catalog.neighbours(table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct(), "conv_id", "turn")


@query("SELECT conv_id, turn, coalesce(array_to_string(list(CAST(turn AS VARCHAR)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS before FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def preceding_turns(spark, sf_dir):
    """W5."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn")).distinct().withColumn("text", F.col("turn").cast("string"))
    return catalog.preceding(rows, "conv_id", "turn", "text").select("conv_id", "turn", joined(F.col("before")).alias("before"))


@query("""
SELECT o_custkey AS custkey, count(*) AS patches, CAST(sum(o_orderkey % 4) AS BIGINT) AS files, count(DISTINCT o_orderpriority) AS categories FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def active_totals(spark, sf_dir):
    """A25, A26, A28 over orders as patches of a customer; status F plays deleted."""
    one = F.struct(F.when(F.col("o_orderstatus") == "F", "deleted").alias("state"), F.array_repeat(F.lit("f"), (F.col("o_orderkey") % 4).cast("int")).alias("files"), F.col("o_orderpriority").alias("category"))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("split_id")).agg(F.collect_list(one).alias("patches"))
    return catalog.patch_totals(rows).filter("patches > 0").select(F.col("split_id").alias("custkey"), F.col("patches").cast("long").alias("patches"), F.col("files").cast("long").alias("files"), F.size("categories").cast("long").alias("categories"))


@query("""
WITH s AS (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS splits, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(splits, '') AS splits, coalesce(split_part(splits, ',', 1), '') AS latest FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def pull_request_splits(spark, sf_dir):
    """Customers as pull requests, orders as their splits."""
    pulls = table(spark, sf_dir, "customer").select(F.lit("o").alias("owner"), F.lit("r").alias("repo"), F.col("c_custkey").alias("number"))
    made = table(spark, sf_dir, "orders").select(F.lit("o").alias("owner"), F.lit("r").alias("repo"), F.col("o_custkey").alias("number"), F.col("o_orderkey").cast("string").alias("split_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("generated_at"))
    out = catalog.pull_splits(pulls, made)
    return out.select(F.col("number").alias("c_custkey"), F.coalesce(joined(F.col("splits")), F.lit("")).alias("splits"), F.coalesce("latest", F.lit("")).alias("latest"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 1 THEN coalesce(n, 0) ELSE 0 END AS additions FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def pull_request_details(spark, sf_dir):
    """Details that were not read, those of even numbers, count 0."""
    pulls = table(spark, sf_dir, "supplier").select(F.lit("o").alias("owner"), F.lit("r").alias("repo"), F.col("s_suppkey").alias("number"), "s_name")
    details = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("number")).agg(F.count(F.lit(1)).alias("additions")).filter("number % 2 = 1")
    details = details.select(F.lit("o").alias("owner"), F.lit("r").alias("repo"), "number", "additions", F.lit(0).alias("deletions"), F.lit(0).alias("changed_files"))
    return catalog.with_details(pulls, details).select(F.col("number").alias("s_suppkey"), "s_name", "additions")


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def commits_in_branch(spark, sf_dir):
    """Semi join on branch membership."""
    commits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sha"))
    member = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sha"), F.when(F.col("o_orderpriority").like("1%"), "origin/main").otherwise("other").alias("branch"))
    return catalog.in_branch(commits, member, "main").select(F.col("sha").alias("c_custkey"))


@query("""
SELECT page_id, regexp_extract(url, '^https?://([^/]+)/([^/]+)/(\\d+)', 1) AS host, regexp_extract(url, '^https?://([^/]+)/([^/]+)/(\\d+)', 2) AS part, CAST(nullif(regexp_extract(url, '^https?://([^/]+)/([^/]+)/(\\d+)', 3), '') AS INT) AS number FROM pages""")
def url_parts(spark, sf_dir):
    """P19 over page URLs, turned into pull request URLs and parsed."""
    pattern = r"^https?://([^/]+)/([^/]+)/(\d+)"
    get = lambda i: F.regexp_extract("url", pattern, i)
    made = F.when(get(1) != "", F.concat(F.lit("https://github.com/"), get(1), F.lit("/"), get(2), F.lit("/pull/"), get(3)))
    parsed = table(spark, sf_dir, "pages").select("page_id", S.pull_request_url(made).alias("p"))
    return parsed.select("page_id", F.coalesce("p.owner", F.lit("")).alias("host"), F.coalesce("p.repo", F.lit("")).alias("part"), F.col("p.number").alias("number"))


@query("""
WITH t AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'deleted' END AS state FROM t""")
def soft_deleted(spark, sf_dir):
    """K6, K7: tombstones, latest wins."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(None).cast("string").alias("state"))
    marks = rows.filter("s_suppkey % 3 = 0").select("s_suppkey", F.lit(1).alias("at")).unionByName(rows.filter("s_suppkey % 6 = 0").select("s_suppkey", F.lit(2).alias("at")))
    return catalog.soft_delete(rows, marks, ["s_suppkey"]).select("s_suppkey", "state")


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS label FROM part")
def enriched(spark, sf_dir):
    """K9: the right side wins where it has a value."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_brand").alias("label"))
    more = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("label"))
    return catalog.enrich(rows, more, ["p_partkey"]).select("p_partkey", "p_name", "label")


@query("SELECT s_suppkey, n_name AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def repository_by_path(spark, sf_dir):
    """A path finds the repository that contains it."""
    repos = table(spark, sf_dir, "nation").select(F.concat(F.lit("/src/"), F.col("n_nationkey").cast("string")).alias("path"), F.col("n_name").alias("name"))
    want = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("/src/"), F.col("s_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string")).alias("path"))
    return want.join(catalog.by_path(want, repos), "path").select("s_suppkey", "name")


@query(cte("SELECT a.split_id, a.change_id AS a, b.change_id AS b FROM changes a JOIN changes b ON a.split_id = b.split_id AND a.line_start = b.line_start AND a.line_end = b.line_end AND a.file = b.file AND a.type = 'add'"))
def annotation_matches(spark, sf_dir):
    """Equal starts and one path ending with the other."""
    rows = adapters.changes(spark, sf_dir)
    notes = rows.filter("type = 'add'").select("split_id", F.col("change_id").alias("a"), F.concat_ws("/", F.lit("x"), "split_id", "file").alias("file_path"), F.lit("@@ s @@").alias("hunk_header"), F.col("line_start").alias("start_line"), F.col("line_end").alias("end_line"))
    hunks = rows.select("split_id", F.col("change_id").alias("b"), F.concat_ws("/", "split_id", "file").alias("file"), F.col("line_start").alias("old_start"), F.col("line_end").alias("new_start"), F.lit("s").alias("section"))
    # Ids of the change set are part of the path, as a repository's folder would be.
    return catalog.annotation_matches(notes, hunks).select("split_id", "a", "b")


@query(cte("""
, o AS (SELECT l.split_id, p.patch_id, p.size_lines, p.hunks, l.change_id, l.lines, row_number() OVER (PARTITION BY l.split_id, l.layer ORDER BY l.change_ord) AS nth FROM layered l JOIN patches p ON p.split_id = l.split_id AND p.layer = l.layer),
big AS (SELECT split_id, patch_id, row_number() OVER (PARTITION BY split_id ORDER BY patch_id) + (SELECT max(patch_id) FROM patches q WHERE q.split_id = p.split_id) AS fresh FROM patches p WHERE size_lines > 40 AND hunks > 1),
h AS (SELECT o.split_id, CASE WHEN b.patch_id IS NOT NULL AND nth > hunks // 2 THEN fresh ELSE o.patch_id END AS patch_id, CASE WHEN b.patch_id IS NOT NULL AND nth > hunks // 2 THEN CAST(o.patch_id AS VARCHAR) ELSE '' END AS needs, change_id, lines, nth FROM o LEFT JOIN big b ON b.split_id = o.split_id AND b.patch_id = o.patch_id)
SELECT split_id, CAST(patch_id AS INT) AS patch_id, needs AS depends_on, string_agg(change_id, ',' ORDER BY nth) AS changes, CAST(sum(lines) AS INT) AS size_lines FROM h GROUP BY split_id, patch_id, needs"""))
def halved_patches(spark, sf_dir):
    """The halves' changes, sizes and dependency."""
    rows = _layer_parts(spark, sf_dir).withColumn("lines", F.col("added_lines") + F.col("deleted_lines"))
    patches = rows.groupBy("split_id", "patch_id").agg(F.sum("lines").alias("size_lines"), grouping.ordered_ids().alias("changes"), F.array().cast("array<int>").alias("depends_on"))
    out = splitting.halve_large(patches, rows.select("split_id", "change_id", "lines"), 20)
    return out.select("split_id", "patch_id", joined(F.transform("depends_on", lambda d: d.cast("string"))).alias("depends_on"), joined(F.col("changes")).alias("changes"), "size_lines")


@query(cte("""SELECT split_id, CAST(patch_id + CASE WHEN patch_id > 1 THEN 1 ELSE 0 END AS INT) AS patch_id, layer AS name FROM patches WHERE patch_id <> 1
UNION ALL SELECT DISTINCT split_id, CAST(1 + i AS INT), 'part' || i FROM patches, (SELECT unnest([0, 1]) AS i)"""))
def resplit_numbers(spark, sf_dir):
    """Patch 1 becomes two; later ids move up."""
    rows = _layer_patches(spark, sf_dir).select("split_id", "patch_id", F.col("layer").alias("name"), F.array().cast("array<int>").alias("depends_on"))
    parts = rows.select("split_id").distinct().select("split_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("patch_id")).withColumn("name", F.concat(F.lit("part"), F.col("patch_id").cast("string"))).withColumn("depends_on", F.array().cast("array<int>"))
    return splitting.resplit(rows, 1, parts).select("split_id", "patch_id", "name")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS split_id, CAST(line_no AS INT) AS line_no FROM l WHERE regexp_matches(line, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)')""")
def name_references(spark, sf_dir):
    """X7, S3's line scan."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("split_id"), F.col("text").alias("value"))
    return extract.references(diffs.lines(docs), "the").select("split_id", "line_no")


@query("SELECT CAST(doc_id AS VARCHAR) AS split_id, '+' || replace(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10), chr(10) || '+') AS body FROM documents")
def synthesised_diffs(spark, sf_dir):
    """S9."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("split_id"), F.lit("f.txt").alias("file"), "text")
    return diffs.new_file_diffs(docs).select("split_id", F.regexp_replace(F.regexp_extract("value", r"(?s)@@ -0,0 \+1,\d+ @@\n(.*)$", 1), "\n$", "").alias("body"))


@query("SELECT CAST(doc_id AS VARCHAR) AS split_id, 1 AS hunks, len(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS added, 0 AS deleted, 'add' AS type FROM documents")
def parsed_diffs(spark, sf_dir):
    """S3, S4, A1 over diffs made from documents: one new file each."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("split_id"), F.lit("f.txt").alias("file"), "text")
    rows = diffs.parse_diffs(diffs.new_file_diffs(docs).select("split_id", "value"))
    return rows.groupBy("split_id").agg(F.count(F.lit(1)).cast("int").alias("hunks"), F.sum("added_lines").alias("added"), F.sum("deleted_lines").cast("int").alias("deleted"), F.first("type").alias("type"))


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) || '|short' AS head, 'fix | ' || c_name AS message FROM customer")
def commit_log(spark, sf_dir):
    """A | in the message stays."""
    lines = table(spark, sf_dir, "customer").select(F.concat_ws("|", F.col("c_custkey").cast("string"), F.lit("short"), F.lit("a"), F.lit("e"), F.lit("t"), F.lit("r"), F.concat(F.lit("fix | "), F.col("c_name"))).alias("value"))
    return scans.commit_log(lines).select(F.col("sha").cast("long").alias("c_custkey"), F.concat_ws("|", "sha", "short").alias("head"), "message")


@query("""
SELECT file, state FROM (SELECT p_name || p_partkey AS file, unnest(CASE p_partkey % 4 WHEN 0 THEN ['staged'] WHEN 1 THEN ['unstaged'] WHEN 2 THEN ['staged', 'unstaged'] ELSE ['untracked'] END) AS state FROM part)""")
def working_status(spark, sf_dir):
    """S13."""
    code = F.element_at(F.array(*map(F.lit, ("M  ", " M ", "MM ", "?? "))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return scans.status(table(spark, sf_dir, "part").select(F.concat(code, F.col("p_name"), F.col("p_partkey").cast("string")).alias("value")))
