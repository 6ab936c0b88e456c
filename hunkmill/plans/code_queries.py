"""Queries over diffs and code made from the words of documents: parsing, extraction, classification of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..operators import deps, extract, graph, splitting
from ..sources import diffs, sinks
from . import engine
from .adapters import letters, table
from .queries import joined, query

#: Code of each language as lines over a document's first words: {a} to {d}, {A} and {C} with a capital.
CODE = {
    "python": ("py", ["import os.{a}", "from pkg.{b} import {c} as {d}, {a}x", "def {a}(v):", "class C{b}:", "    y = {c}.{d}(v) + {b}.z", "    return {a}x.Go, {a}.up"]),
    "go": ("go", ["import (", '  "net/{a}"', '  al "example.com/kv/{b}"', "func {c}(x int) {{", "func (r *T) {d}() {{", "type S{a} struct {{", "type I{b} interface {{", "{a}.Open(al.Type)"]),
    "javascript": ("js", ["import {{ {a} as {b}, {c} }} from './{d}'", 'import D from "./d"', "import * as N from 'n'", "export async function {a}() {{", "const {b}f = (v) => {c}.call(v)", "export class K{d} {{", "N.{a}; D.X; {b}.y"]),
    "typescript": ("ts", ["import {{ {a} }} from './{b}'", "export interface I{a} {{", "type T{b} = string", "export const {c}g = async (v) => {a}.Run(v)", "class Q{d} {{"]),
    "java": ("java", ["import java.util.{A};", "import static x.y.{C}.*;", "public abstract class C{c} {{", "public interface I{d} {{", "public enum E{a} {{", "private static int {b}(int v) {{", "{A}.of(v); if (v) {{ }}"]),
    "rust": ("rs", ["fn {a}() {{", "struct S{b} {{", "enum E{c} {{", "trait R{d} {{", "use {a}::{b};"]),
    "c": ("c", ["#include <{a}.h>", "int {b}(int v) {{"]),
}
NAMES = list(CODE)
_WORDS = ("a", "b", "c", "d")


def _parts(line: str) -> list[tuple[str, bool]]:
    """The pieces of a template: (text, is it a word's name)."""
    out, rest = [], line.replace("{{", "\x01").replace("}}", "\x02")
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [(before, False), (name, True)]
    return [(t.replace("\x01", "{").replace("\x02", "}"), w) for t, w in [*out, (rest, False)] if t]


def _spark_line(line: str) -> Column:
    pick = lambda name: F.initcap(F.col(name.lower())) if name.isupper() else F.col(name)
    return F.concat(*[pick(t) if w else F.lit(t) for t, w in _parts(line)])


def _sql_line(line: str) -> str:
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    pick = lambda name: f"upper({name.lower()}[1]) || {name.lower()}[2:]" if name.isupper() else name
    return " || ".join(pick(t) if w else quote(t) for t, w in _parts(line))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split_id, n (the language's place), a, b, c, d: a document's first words in ASCII letters, `w` for those it lacks."""
    # The text up to the end of its first words, letters in each: the rest has no part in them.
    head = F.regexp_extract(F.coalesce("text", F.lit("")), rf"^(?:[^A-Za-z]*+[A-Za-z][^ ]*+){{0,{len(_WORDS)}}}", 0)
    words = F.filter(F.split(F.lower(letters(head)), " "), lambda x: x != "")
    # Through explode the words are cut once a row; a plain column is worked out again in each place of the lines that use it.
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("split_id"), F.pmod("doc_id", F.lit(len(NAMES))).cast("int").alias("n"), F.explode(F.array(words)).alias("w"))
    return rows.select("split_id", "n", *[F.coalesce(F.try_element_at("w", F.lit(i + 1)), F.lit("w")).alias(x) for i, x in enumerate(_WORDS)])


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split_id, file, text: one new file of code a document."""
    rows = _words(spark, sf_dir)
    text, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (suffix, lines) in enumerate(CODE.values()):
        text = F.when(F.col("n") == i, F.concat_ws("\n", *map(_spark_line, lines))).otherwise(text)
        name = F.when(F.col("n") == i, F.lit(f"src/lib/m.{suffix}")).otherwise(name)
    return rows.select("split_id", name.alias("file"), text.alias("text"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.parse_diffs(diffs.new_file_diffs(_files(spark, sf_dir)).select("split_id", "value"))


_LANGUAGE = "CASE n " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(NAMES)) + " END"
#: The same code as rows (split_id, language, r, code).
_CODE_SQL = f"""
WITH w0 AS (SELECT CAST(doc_id AS VARCHAR) AS split_id, doc_id % {len(NAMES)} AS n, list_filter(string_split(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z ]+', '', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
words AS (SELECT split_id, n, {_LANGUAGE} AS language, {", ".join(f"coalesce(w[{i + 1}], 'w') AS {x}" for i, x in enumerate(_WORDS))} FROM w0),
code AS ({" UNION ALL ".join(f"SELECT split_id, language, {r} AS r, {_sql_line(line)} AS code FROM words WHERE n = {i}" for i, (_, lines) in enumerate(CODE.values()) for r, line in enumerate(lines))})
"""


def _rules(table_of: dict, columns: str, where: str = "true") -> str:
    """One SELECT a pattern over the code of its language; %P stands for the pattern, %T for its type, %N for its place."""
    out = []
    for language, rules in table_of.items():
        for i, (p, t) in enumerate(rules):
            p = p.replace("'", "''")
            out.append(f"SELECT split_id, language, r, {columns.replace('%P', f'{chr(39)}{p}{chr(39)}').replace('%T', f'{chr(39)}{t}{chr(39)}' if t else 'NULL').replace('%N', str(i))} FROM code WHERE language = '{language}' AND {where.replace('%P', f'{chr(39)}{p}{chr(39)}')}")
    return " UNION ALL ".join(out)


_JAVA = ", ".join(f"'{w}'" for w in fixed.JAVA_WORDS)
_DEFINED = f"""
, defined AS (SELECT * FROM ({_rules(fixed.DEFINITIONS, "%N AS nth, regexp_extract(code, %P, 1) AS name, %T AS type", "regexp_matches(code, %P)")}) WHERE name <> '' AND NOT (language = 'java' AND type = 'method' AND name IN ({_JAVA})))"""

_IMPORTED = r"""
, one AS (
  SELECT split_id, r, regexp_extract(regexp_extract(code, '^\s*"([^"]+)"', 1), '[^/]*$') AS alias, regexp_extract(code, '^\s*"([^"]+)"', 1) AS path FROM code WHERE language = 'go' AND regexp_matches(code, '^\s*"([^"]+)"')
  UNION ALL SELECT split_id, r, regexp_extract(code, '^\s*([a-z_][a-z0-9_]*)\s+"([^"]+)"', 1), regexp_extract(code, '^\s*([a-z_][a-z0-9_]*)\s+"([^"]+)"', 2) FROM code WHERE language = 'go' AND regexp_matches(code, '^\s*([a-z_][a-z0-9_]*)\s+"([^"]+)"')
  UNION ALL SELECT split_id, r, regexp_extract(regexp_extract(code, '^\s*import\s+([a-zA-Z_][a-zA-Z0-9_.]*)', 1), '[^.]*$'), regexp_extract(code, '^\s*import\s+([a-zA-Z_][a-zA-Z0-9_.]*)', 1) FROM code WHERE language = 'python' AND regexp_matches(code, '^\s*import\s+([a-zA-Z_][a-zA-Z0-9_.]*)')
  UNION ALL SELECT split_id, r, trim(string_split(trim(x), ' as ')[1]), base || '.' || trim(string_split(trim(x), ' as ')[1]) FROM (
    SELECT split_id, r, regexp_extract(code, '^\s*from\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s+import\s+(.+)', 1) AS base, unnest(string_split(regexp_extract(code, '^\s*from\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s+import\s+(.+)', 2), ',')) AS x FROM code WHERE language = 'python' AND regexp_matches(code, '^\s*from\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s+import\s+(.+)'))
  UNION ALL SELECT split_id, r, trim(string_split(trim(x), ' as ')[-1]), path FROM (
    SELECT split_id, r, regexp_extract(code, '^\s*import\s+\{([^}]+)\}\s+from\s+[''"]([^''"]+)[''"]', 2) AS path, unnest(string_split(regexp_extract(code, '^\s*import\s+\{([^}]+)\}\s+from\s+[''"]([^''"]+)[''"]', 1), ',')) AS x FROM code WHERE language IN ('javascript', 'typescript') AND regexp_matches(code, '^\s*import\s+\{([^}]+)\}\s+from\s+[''"]([^''"]+)[''"]'))
  UNION ALL SELECT split_id, r, regexp_extract(code, '^\s*import\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+from\s+[''"]([^''"]+)[''"]', 1), regexp_extract(code, '^\s*import\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+from\s+[''"]([^''"]+)[''"]', 2) FROM code WHERE language IN ('javascript', 'typescript') AND regexp_matches(code, '^\s*import\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+from\s+[''"]([^''"]+)[''"]')
  UNION ALL SELECT split_id, r, regexp_extract(code, '^\s*import\s+\*\s+as\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+from\s+[''"]([^''"]+)[''"]', 1), regexp_extract(code, '^\s*import\s+\*\s+as\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+from\s+[''"]([^''"]+)[''"]', 2) FROM code WHERE language IN ('javascript', 'typescript') AND regexp_matches(code, '^\s*import\s+\*\s+as\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+from\s+[''"]([^''"]+)[''"]')
  UNION ALL SELECT split_id, r, regexp_extract(path, '[^.]*$'), path FROM (SELECT split_id, r, regexp_extract(code, '^\s*import\s+(?:static\s+)?([a-zA-Z_][a-zA-Z0-9_.]*);', 1) AS path FROM code WHERE language = 'java' AND regexp_matches(code, '^\s*import\s+(?:static\s+)?([a-zA-Z_][a-zA-Z0-9_.]*);')) WHERE regexp_extract(path, '[^.]*$') NOT IN ('', '*')),
imported AS (SELECT split_id, r, alias, path FROM one WHERE alias NOT IN ('', '*'))"""

_USED = _IMPORTED + f"""
, seen AS ({_rules(fixed.USAGES, "%N AS nth, %T AS kind, unnest(regexp_extract_all(code, %P, 1)) AS alias, unnest(regexp_extract_all(code, %P, 2)) AS name, unnest(range(len(regexp_extract_all(code, %P, 1)))) AS pos")}),
used AS (
  SELECT s.split_id, s.language, s.r, s.nth, s.pos, CASE WHEN s.language = 'java' AND s.nth = 0 THEN s.alias ELSE s.name END AS name, coalesce(s.kind, CASE WHEN regexp_matches(s.name[1], '[a-z]') THEN 'function' ELSE 'class' END) AS type,
         CASE WHEN s.language = 'java' AND s.nth = 0 THEN CASE WHEN contains(max_by(i.path, i.r), '.') THEN regexp_extract(max_by(i.path, i.r), '^(.*)\\.[^.]*$', 1) END ELSE s.alias END AS package,
         CASE WHEN s.language = 'java' AND s.nth = 0 THEN max_by(i.path, i.r) ELSE s.alias || '.' || s.name END AS qualified_name
  FROM seen s JOIN imported i ON i.split_id = s.split_id AND i.alias = s.alias AND i.r <= s.r GROUP BY s.split_id, s.language, s.r, s.nth, s.pos, s.alias, s.name, s.kind)"""


@query(_CODE_SQL + _DEFINED + " SELECT split_id, r + 1 AS line, nth, name, type FROM defined")
def symbol_definitions(spark, sf_dir):
    """Definitions on added lines."""
    return extract.definitions(extract.added_lines(_changes(spark, sf_dir))).select("split_id", "line", "nth", "name", "type")


@query(_CODE_SQL + _IMPORTED + " SELECT split_id, r AS row, alias, path FROM imported")
def symbol_imports(spark, sf_dir):
    """Imports on added lines."""
    return extract.imports(extract.added_lines(_changes(spark, sf_dir))).select("split_id", "row", "alias", "path")


@query(_CODE_SQL + _USED + " SELECT split_id, r AS row, nth, pos, name, type, package, qualified_name FROM used")
def symbol_usages(spark, sf_dir):
    """Usages of what was imported before."""
    lines = extract.added_lines(_changes(spark, sf_dir))
    return extract.usages(lines).select("split_id", "row", "nth", F.col("at").alias("pos"), "name", "type", "package", "qualified_name")


@query(_CODE_SQL + _DEFINED + _USED + """
, every AS (
  SELECT split_id, 0 AS part, r, nth, 0 AS pos, name, type, 'definition' AS role, 'lib' AS package FROM defined
  UNION ALL SELECT split_id, 1, r, nth, pos, name, type, 'usage', package FROM used
  UNION ALL SELECT DISTINCT split_id, 2, 0, 0, 0, 'import', 'import', 'usage', NULL FROM imported),
first AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY split_id, name, type, role, package ORDER BY part, r, nth, pos) = 1)
SELECT split_id, row_number() OVER (PARTITION BY split_id ORDER BY part, r, nth, pos, name, type) - 1 AS sym_ord, name, type, role, package FROM first""")
def hunk_symbols(spark, sf_dir):
    """X8, X9, U1, W3, U8's kind of union: all symbols of a hunk, the first of each."""
    return extract.hunk_symbols(_changes(spark, sf_dir)).select("split_id", "sym_ord", "name", "type", "role", "package")


@query(_CODE_SQL + f"""
, firsts AS (SELECT split_id, language, r, code FROM code WHERE r = 0)
SELECT split_id, nth, name, type FROM ({_rules(fixed.BASIC, "%N AS nth, regexp_extract(code, %P, 1) AS name, %T AS type", "regexp_matches(code, %P)").replace("FROM code", "FROM firsts")}) WHERE name <> ''""")
def basic_symbols(spark, sf_dir):
    """Basic patterns, on the first line alone."""
    rows = _files(spark, sf_dir).select("split_id", S.language_of(F.col("file")).alias("language"), F.col("text").alias("code"))
    return extract.basic_symbols(rows)


_IMPORT_LINE = " OR ".join(f"(language = '{name}' AND ({' OR '.join('regexp_matches(code, ' + chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39) + ')' for p in patterns)}))" for name, patterns in fixed.IMPORT_LINES.items())


@query(_CODE_SQL + f" SELECT split_id, r AS row, {_IMPORT_LINE} AS import_line, array_to_string(list_distinct(list_filter(regexp_extract_all(code, '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\s*\\(', 1), lambda x: x NOT IN ('if', 'for', 'while', 'switch', 'catch', 'return'))), ',') AS called FROM code".replace("list_distinct(list_filter", "list_sort(list_distinct(list_filter").replace("'return')))", "'return'))))"))
def line_kinds(spark, sf_dir):
    """F13, P13."""
    lines = extract.added_lines(_changes(spark, sf_dir))
    return lines.select("split_id", "row", S.import_line(F.col("code"), F.col("language")).alias("import_line"), joined(F.array_sort(extract.called_functions(F.col("code")))).alias("called"))


@query(_CODE_SQL + "SELECT language, count(DISTINCT split_id) AS diffs, count(*) AS added FROM code GROUP BY 1")
def diffs_by_language(spark, sf_dir):
    """P1, A24, S8."""
    rows = _changes(spark, sf_dir)
    return rows.groupBy("language").agg(F.count_distinct("split_id").alias("diffs"), F.sum("added_lines").alias("added"))


# A change set of two files and up to four hunks from a document's words: a file with two hunks of edits, and one that is
# deleted, or for odd documents added.
_EDIT = [
    "diff --git a/pkg/a.py b/pkg/a.py", "index 111..222 100644", "--- a/pkg/a.py", "+++ b/pkg/a.py", "@@ -1,3 +1,4 @@ def {a}", " {b}", "-{c}", "--- {d}", "+{d}", "+++ {c}", "+{a}",
    "@@ -20 +21,2 @@", "-{d}", "+{a}", "+{b}", "\\ No newline at end of file",
]
_GONE = ["diff --git a/lib/{a}/b.js b/lib/{a}/b.js", "deleted file mode 100644", "index 1..0", "--- a/lib/{a}/b.js", "+++ /dev/null", "@@ -1,2 +0,0 @@", "--- {b}", "-{c}"]
_NEW = ["diff --git a/b/{b}.go b/b/{b}.go", "new file mode 100644", "--- /dev/null", "+++ b/b/{b}.go", "@@ -0,0 +1,2 @@", "+{a}", "+"]


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lambda rows: F.concat_ws("\n", *map(_spark_line, rows))
    return _words(spark, sf_dir).select("split_id", "a", "b", "c", "d", F.concat_ws("\n", lines(_EDIT), F.when(F.col("split_id").cast("long") % 2 == 0, lines(_GONE)).otherwise(lines(_NEW)), F.lit("")).alias("value"))


_EDITS_SQL = _CODE_SQL + f"""
, hunks AS (
  SELECT split_id, 0 AS change_ord, 'pkg/a.py' AS file, 0 AS hunk_id, 'modify' AS type, 1 AS line_start, 5 AS line_end, 3 AS added_lines, 2 AS deleted_lines, 'python' AS language,
         '@@ -1,3 +1,4 @@ def ' || a || chr(10) || {" || chr(10) || ".join(_sql_line(x) for x in _EDIT[5:11])} AS content FROM words
  UNION ALL SELECT split_id, 1, 'pkg/a.py', 1, 'modify', 21, 23, 2, 1, 'python', '@@ -20,1 +21,2 @@' || chr(10) || {" || chr(10) || ".join(_sql_line(x) for x in _EDIT[12:])} FROM words
  UNION ALL SELECT split_id, 2, 'lib/' || a || '/b.js', 0, 'delete', 0, 0, 0, 2, 'javascript', '@@ -1,2 +0,0 @@' || chr(10) || {" || chr(10) || ".join(_sql_line(x) for x in _GONE[6:])} FROM words WHERE CAST(split_id AS BIGINT) % 2 = 0
  UNION ALL SELECT split_id, 2, 'b/' || b || '.go', 0, 'add', 1, 3, 2, 0, 'go', '@@ -0,0 +1,2 @@' || chr(10) || '+' || a || chr(10) || '+' FROM words WHERE CAST(split_id AS BIGINT) % 2 <> 0)
"""


@query(_EDITS_SQL + "SELECT split_id, change_ord, file || ':hunk_' || hunk_id AS change_id, type, line_start, line_end, added_lines, deleted_lines, language, md5(content) AS digest FROM hunks")
def parsed_edits(spark, sf_dir):
    """S3, S4, P2-P4, W1 over diffs of several files and hunks."""
    rows = diffs.parse_diffs(_edits(spark, sf_dir).select("split_id", "value"))
    return rows.select("split_id", "change_ord", "change_id", "type", "line_start", "line_end", "added_lines", "deleted_lines", "language", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(_EDITS_SQL + """
SELECT split_id, 'pkg/a.py' AS file_name, md5('--- a/pkg/a.py' || chr(10) || '+++ b/pkg/a.py' || chr(10) || """ + " || chr(10) || ".join(_sql_line(x) for x in _EDIT[4:]) + """) AS digest FROM words
UNION ALL SELECT split_id, 'lib/' || a || '/b.js', md5('--- a/lib/' || a || '/b.js' || chr(10) || """ + " || chr(10) || ".join(_sql_line(x) for x in _GONE[4:]) + """) FROM words WHERE CAST(split_id AS BIGINT) % 2 = 0
UNION ALL SELECT split_id, 'b/' || b || '.go', md5(""" + " || chr(10) || ".join(_sql_line(x) for x in _NEW[2:]) + """) FROM words WHERE CAST(split_id AS BIGINT) % 2 <> 0""")
def file_sections(spark, sf_dir):
    """Each file's part of a diff, without mode and index lines."""
    return diffs.file_sections(_edits(spark, sf_dir).select("split_id", "value")).select("split_id", "file_name", F.md5(F.col("diff").cast("binary")).alias("digest"))


@query(_EDITS_SQL + """
, pairs AS (SELECT split_id, change_ord, split_part(content, chr(10), 1) AS header, old_start, old_length, new_start, new_length FROM hunks JOIN (VALUES (0, 1, 3, 1, 4), (1, 20, 1, 21, 2)) v(o, old_start, old_length, new_start, new_length) ON o = change_ord
  UNION ALL SELECT split_id, change_ord, split_part(content, chr(10), 1), CASE type WHEN 'add' THEN 0 ELSE 1 END, CASE type WHEN 'add' THEN 0 ELSE 2 END, CASE type WHEN 'add' THEN 1 ELSE 0 END, CASE type WHEN 'add' THEN 2 ELSE 0 END FROM hunks WHERE change_ord = 2)
SELECT split_id, change_ord AS nth, old_start, old_length, new_start, new_length, CASE WHEN change_ord = 0 THEN 'def ' || a ELSE '' END AS section FROM pairs JOIN words USING (split_id)""")
def hunk_headers(spark, sf_dir):
    """P4, P17."""
    rows = diffs.headers(_edits(spark, sf_dir).select("split_id", "value"))
    nth = F.row_number().over(Window.partitionBy("split_id").orderBy("pos")) - 1
    return rows.select("split_id", nth.alias("nth"), "old_start", "old_length", "new_start", "new_length", "section")


@query(_EDITS_SQL + """
SELECT split_id, change_ord, CASE change_ord WHEN 0 THEN md5(b || chr(10) || c) WHEN 1 THEN md5(d || chr(10) || '\\ No newline at end of file') WHEN 2 THEN CASE type WHEN 'add' THEN md5('') ELSE md5(c) END END AS old,
       CASE change_ord WHEN 0 THEN md5(b || chr(10) || d || chr(10) || a) WHEN 1 THEN md5(a || chr(10) || b || chr(10) || '\\ No newline at end of file') WHEN 2 THEN CASE type WHEN 'add' THEN md5(a || chr(10)) ELSE md5('') END END AS new
FROM hunks JOIN words USING (split_id)""")
def file_versions(spark, sf_dir):
    """The two versions that a hunk's body shows."""
    rows = diffs.parse_diffs(_edits(spark, sf_dir).select("split_id", "value"))
    body = F.array_join(F.slice(F.split("content", "\n"), 2, 1 << 30), "\n")
    v = rows.select("split_id", "change_ord", diffs.versions(body).alias("v"))
    return v.select("split_id", "change_ord", F.md5(F.col("v.old").cast("binary")).alias("old"), F.md5(F.col("v.new").cast("binary")).alias("new"))


@query(_EDITS_SQL + "SELECT split_id, 'a.py:hunk_' || hunk_id AS change_id, 'diff --git a/a.py b/a.py' AS git_line, '--- a/a.py' AS old_line, '+++ b/a.py' AS new_line FROM hunks WHERE change_ord < 2")
def stripped_diffs(spark, sf_dir):
    """A diff cut to a folder, in its text and in its rows."""
    rows = _edits(spark, sf_dir).select("split_id", diffs.strip_prefix_in_text(F.col("value"), "pkg").alias("value"))
    got = diffs.filter_paths(diffs.parse_diffs(_edits(spark, sf_dir).select("split_id", "value")), "pkg", strip=True)
    got = got.select("split_id", F.concat("file", F.lit(":hunk_"), F.col("hunk_id").cast("string")).alias("change_id"))
    line = lambda p, i: F.element_at(F.filter(F.split("value", "\n"), lambda x: F.startswith(x, F.lit(p))), i)
    return got.join(rows, "split_id").select("split_id", "change_id", line("diff --git", 1).alias("git_line"), line("--- a", 1).alias("old_line"), line("+++ b", 1).alias("new_line"))


def _patch_text_sql(body: str, files: str, name: str, description: str) -> str:
    return f"'# ' || {name} || chr(10) || '# Category: other' || chr(10) || '# Priority: 1' || chr(10) || '# Generated: now' || chr(10) || '# Files: ' || {files} || chr(10) || '# Description: ' || {description} || chr(10) || chr(10) || {body} || chr(10)"


@query(_EDITS_SQL + f"""
, texts AS (
  SELECT split_id, {_patch_text_sql("'diff --git a/pkg/a.py b/pkg/a.py' || chr(10) || '--- a/pkg/a.py' || chr(10) || '+++ b/pkg/a.py' || chr(10) || string_agg(content, chr(10) ORDER BY line_start)", "'pkg/a.py'", "'One'", "'two hunks'")} AS text
  FROM hunks WHERE change_ord < 2 GROUP BY split_id)
SELECT split_id, '00_One.patch' AS filename, md5(text) AS digest, length(text) AS n FROM texts""")
def patch_files(spark, sf_dir):
    """The whole text of a patch of two hunks."""
    changes = diffs.parse_diffs(_edits(spark, sf_dir).select("split_id", "value"))
    own = changes.filter("change_ord < 2").groupBy("split_id").agg(F.array_sort(F.collect_list("change_id"), lambda a, b: F.when(a < b, 1).when(a > b, -1).otherwise(0)).alias("changes"))
    patches = own.select("split_id", F.lit(0).alias("patch_id"), F.lit("One").alias("name"), F.lit("two hunks").alias("description"), "changes", F.array().cast("array<int>").alias("depends_on"))
    cats = patches.select("split_id", "patch_id", F.lit("other").alias("category"))
    return sinks.patch_texts(patches, changes, cats, "now").select("split_id", "filename", F.md5(F.col("text").cast("binary")).alias("digest"), F.char_length("text").alias("n"))


@query(_EDITS_SQL + """
, h AS (SELECT split_id, change_ord, file, split_part(content, chr(10), 1) AS header, line_start, type, added_lines, deleted_lines, CASE change_ord WHEN 0 THEN 1 WHEN 1 THEN 20 ELSE CASE type WHEN 'add' THEN 0 ELSE 1 END END AS old_start FROM hunks)
SELECT split_id, row_number() OVER (PARTITION BY split_id ORDER BY file, line_start, change_ord) - 1 AS nth, file AS file_path, header AS hunk_header, old_start AS start_line, line_start AS end_line,
       CASE type WHEN 'add' THEN 'Adds ' || added_lines || ' lines to ' || file WHEN 'modify' THEN 'Modifies ' || file ELSE 'Removes ' || deleted_lines || ' lines from ' || file END AS description FROM h""")
def hunk_annotations(spark, sf_dir):
    """K12, O2, P24."""
    changes = diffs.parse_diffs(_edits(spark, sf_dir).select("split_id", "value"))
    patches = changes.groupBy("split_id").agg(F.collect_list("change_id").alias("changes")).withColumn("patch_id", F.lit(0))
    none = changes.select("split_id", "change_id", F.lit(0).alias("sym_ord"), F.lit("").alias("name")).limit(0)
    return sinks.annotations(patches, changes, none).select("split_id", "nth", "file_path", "hunk_header", "start_line", "end_line", "description")


@query(_EDITS_SQL + """
SELECT split_id, 'pkg/a.py' AS file_path, CAST(2 AS BIGINT) + 1 - 1 + 1 AS lines FROM words WHERE false
UNION ALL SELECT split_id, file, CAST(sum(line_start - CASE change_ord WHEN 0 THEN 1 WHEN 1 THEN 20 ELSE CASE type WHEN 'add' THEN 0 ELSE 1 END END + 1) AS BIGINT) FROM hunks GROUP BY 1, 2""")
def annotated_lines(spark, sf_dir):
    """Lines that a file's annotations span."""
    changes = diffs.parse_diffs(_edits(spark, sf_dir).select("split_id", "value"))
    patches = changes.groupBy("split_id").agg(F.collect_list("change_id").alias("changes")).withColumn("patch_id", F.lit(0))
    none = changes.select("split_id", "change_id", F.lit(0).alias("sym_ord"), F.lit("").alias("name")).limit(0)
    return sinks.annotated_lines(sinks.annotations(patches, changes, none)).select("split_id", "file_path", "lines")


@query(_EDITS_SQL + "SELECT split_id, CAST(max(CASE WHEN language = 'python' THEN 1 ELSE 0 END) AS INT) AS has_python, CASE WHEN CAST(split_id AS BIGINT) % 2 = 0 THEN 'python' ELSE 'python' END AS language, count(*) AS hunks FROM hunks GROUP BY split_id")
def edit_languages(spark, sf_dir):
    """A3 over the files of hunks: .py counts twice, so it wins."""
    changes = diffs.parse_diffs(_edits(spark, sf_dir).select("split_id", "value"))
    main = diffs.main_language(changes.select("split_id", F.col("change_ord").alias("pos"), "file"))
    out = changes.groupBy("split_id").agg(F.max((F.col("language") == "python").cast("int")).alias("has_python"), F.count(F.lit(1)).alias("hunks"))
    return out.join(main, "split_id").select("split_id", "has_python", "language", "hunks")


@query(_EDITS_SQL + """
, t AS (SELECT split_id, count(DISTINCT file) AS files, CAST(sum(added_lines) AS BIGINT) AS added, CAST(sum(deleted_lines) AS BIGINT) AS deleted, array_to_string(list_sort(list(DISTINCT lower(regexp_extract(file, '\\.([^./]+)$', 1)))), ',') AS extensions FROM hunks GROUP BY 1)
SELECT * FROM t""")
def plan_totals(spark, sf_dir):
    """A24 through the whole engine, from text to summary."""
    p = engine.split(_edits(spark, sf_dir).select("split_id", "value"))
    return engine.summary(p).select("split_id", "files", "added", "deleted", joined(F.col("extensions")).alias("extensions"))


@query(_EDITS_SQL + """
, d AS (SELECT split_id, change_ord, md5(string_agg(rtrim(line, ' ' || chr(9) || chr(13)), chr(10) ORDER BY pos)) AS digest FROM (
    SELECT split_id, change_ord, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM hunks) WHERE rtrim(line) <> '' AND NOT starts_with(line, '@@') GROUP BY 1, 2)
SELECT split_id, 0 AS input_only, 0 AS output_only, count(DISTINCT digest) AS common FROM d GROUP BY 1""")
def round_trip(spark, sf_dir):
    """The digests of a plan's written patches are those of its input."""
    p = engine.split(_edits(spark, sf_dir).select("split_id", "value"))
    texts = sinks.patch_texts(p.patches, p.changes, splitting.categories(p.members, p.symbols), "now")
    each = texts.select(F.concat_ws("#", "split_id", "patch_id").alias("split_id"), F.col("text").alias("value"))
    after = diffs.hunk_digests(diffs.parse_diffs(each)).withColumn("split_id", F.element_at(F.split("split_id", "#"), 1))
    from ..operators import quality

    out = quality.reconcile(diffs.hunk_digests(p.changes), after)
    return out.select("split_id", F.col("input_only").cast("int").alias("input_only"), F.col("output_only").cast("int").alias("output_only"), F.col("common").cast("long").alias("common"))


@query(_CODE_SQL + _USED.replace(", one AS", ", one AS", 1) + """
, kinds AS (SELECT split_id, alias, path, CASE WHEN starts_with(lower(path), 'os') OR starts_with(lower(path), 'java') THEN 'stdlib' WHEN starts_with(lower(path), 'example.com') THEN 'external' ELSE 'internal' END AS kind FROM imported)
SELECT split_id, alias, path, kind FROM kinds""")
def import_kinds(spark, sf_dir):
    """P10."""
    rows = extract.imports(extract.added_lines(_changes(spark, sf_dir)))
    return rows.select("split_id", "alias", "path", deps.import_kind(F.col("path"), ("os", "java"), ("example.com",)).alias("kind"))


@query(_CODE_SQL + """
, f AS (SELECT split_id, unnest([a || '.x', b || '.x', c || '.x']) AS file FROM words),
files AS (SELECT DISTINCT split_id, file FROM f)
SELECT split_id, file, row_number() OVER (PARTITION BY split_id ORDER BY file DESC) - 1 AS place FROM files""")
def file_order(spark, sf_dir):
    """Each file depends on the next by name, so that the order is turned round."""
    rows = _words(spark, sf_dir).select("split_id", F.explode(F.array_distinct(F.array(*[F.concat(F.col(x), F.lit(".x")) for x in "abc"]))).alias("file"))
    after = F.lead("file").over(Window.partitionBy("split_id").orderBy("file"))
    edges = rows.select("split_id", F.col("file").alias("file_a"), after.alias("file_b")).filter("file_b is not null")
    return graph.file_order(rows.withColumn("patch_id", F.lit(0)), edges).select("split_id", "file", "place")
