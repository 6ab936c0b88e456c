"""Symbols and imports of added code, by line patterns; registering a language adds patterns for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S

DEFINITIONS, USAGES = dict(fixed.DEFINITIONS), dict(fixed.USAGES)


def register_language(name: str, definitions: list[tuple[str, str]], usages: list[tuple[str, str | None]] = ()) -> None:
    DEFINITIONS[name], USAGES[name] = list(definitions), list(usages)


def added_lines(changes: DataFrame) -> DataFrame:
    """split_id, change_ord, change_id, file, language, row, line, code: added lines, counted from the hunk's start."""
    rows = changes.select("split_id", "change_ord", "change_id", "file", "language", "line_start", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    rows = rows.filter((F.col("pos") > 0) & F.startswith("text", F.lit("+")))
    nth = F.row_number().over(Window.partitionBy("split_id", "change_id").orderBy("pos")) - 1
    return rows.withColumn("row", nth).select("split_id", "change_ord", "change_id", "file", "language", "row", (F.col("line_start") + F.col("row")).cast("int").alias("line"), F.substring("text", 2, 1 << 30).alias("code"))


def _definitions() -> Column:
    """The definitions on a line, as (nth, name, type)."""
    out = F.when(F.lit(False), F.array().cast("array<struct<nth:int,name:string,type:string>>"))
    for language, rules in DEFINITIONS.items():
        each = F.array(*[F.struct(F.lit(i).alias("nth"), F.regexp_extract("code", p, 1).alias("name"), F.lit(t).alias("type")) for i, (p, t) in enumerate(rules)])
        each = F.filter(each, lambda x: x["name"] != "")
        if language == "java":
            each = F.filter(each, lambda x: (x["type"] != "method") | ~x["name"].isin(*fixed.JAVA_WORDS))
        out = out.when(F.col("language") == language, each)
    return out


def definitions(lines: DataFrame) -> DataFrame:
    """One row for each definition on lines (added_lines)."""
    rows = lines.withColumn("d", F.explode(_definitions()))
    return rows.select(*lines.columns, F.col("d.nth").alias("nth"), F.col("d.name").alias("name"), F.col("d.type").alias("type"))


def _imports() -> Column:
    """The (alias, path) pairs that a line imports."""
    code = F.col("code")
    get = lambda pattern, i=1: F.regexp_extract(code, pattern, i)
    pair = lambda alias, path: F.struct(alias.alias("alias"), path.alias("path"))
    last = lambda text, sep: F.element_at(F.split(text, sep), -1)
    when = lambda cond, pairs: F.when(cond, pairs).otherwise(F.array().cast("array<struct<alias:string,path:string>>"))
    go_plain, go_alias, py_import, py_from, js_named, js_default, js_space, java = fixed.IMPORTS.values()
    has = lambda pattern: code.rlike(pattern)
    go = F.concat(when(has(go_plain), F.array(pair(last(get(go_plain), "/"), get(go_plain)))), when(has(go_alias), F.array(pair(get(go_alias), get(go_alias, 2)))))
    named = F.filter(F.transform(F.split(get(py_from, 2), ","), lambda x: F.trim(F.element_at(F.split(F.trim(x), " as "), 1))), lambda x: (x != "") & (x != "*"))
    python = F.concat(when(has(py_import), F.array(pair(last(get(py_import), r"\."), get(py_import)))), when(has(py_from), F.transform(named, lambda x: pair(x, F.concat(get(py_from), F.lit("."), x)))))
    listed = F.filter(F.transform(F.split(get(js_named), ","), lambda x: F.trim(F.element_at(F.split(F.trim(x), " as "), -1))), lambda x: x != "")
    script = F.concat(when(has(js_named), F.transform(listed, lambda x: pair(x, get(js_named, 2)))), when(has(js_default), F.array(pair(get(js_default), get(js_default, 2)))), when(has(js_space), F.array(pair(get(js_space), get(js_space, 2)))))
    java_one = when(has(java) & (last(get(java), r"\.") != "*"), F.array(pair(last(get(java), r"\."), get(java))))
    language = F.col("language")
    return F.when(language == "go", go).when(language == "python", python).when(language.isin("javascript", "typescript"), script).when(language == "java", java_one)


def imports(lines: DataFrame) -> DataFrame:
    """split_id, change_id, row, alias, path of every import on lines."""
    return lines.withColumn("i", F.explode(_imports())).select("split_id", "change_id", "row", F.col("i.alias").alias("alias"), F.col("i.path").alias("path"))


def _uses(pairs: Column, nth: int, kind: str | None) -> Column:
    def one(x, at):
        by_case = F.when(F.substring(x["n"], 1, 1).rlike("[a-z]"), "function").otherwise("class")
        return F.struct(F.lit(nth).alias("nth"), at.alias("at"), x["a"].alias("alias"), x["n"].alias("name"), (F.lit(kind) if kind else by_case).alias("type"))

    return F.transform(pairs, one)


def _usages() -> Column:
    """What a line may use, as (nth, at, alias, name, type)."""
    out = F.when(F.lit(False), F.array().cast("array<struct<nth:int,at:int,alias:string,name:string,type:string>>"))
    for language, rules in USAGES.items():
        if not rules:
            continue
        parts = []
        for i, (p, t) in enumerate(rules):
            pairs = F.arrays_zip(F.regexp_extract_all("code", F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all("code", F.lit(p), F.lit(2)).alias("n"))
            parts.append(_uses(pairs, i, t))
        out = out.when(F.col("language") == language, F.concat(*parts))
    return out


_EVENT = "array<struct<part:int,nth:int,at:int,alias:string,name:string,type:string,path:string>>"


def found(lines: DataFrame) -> DataFrame:
    """Rows of lines (added_lines), one for each definition (part 0), use (1) and import (2) on them; a use comes with the path
    that its alias was last imported from on its line or above, and is left out without one. One pass over the lines."""
    nothing = F.lit(None).cast("string")
    event = lambda part, nth, at, alias, name, kind, path: F.struct(F.lit(part).alias("part"), nth.alias("nth"), at.alias("at"), alias.alias("alias"), name.alias("name"), kind.alias("type"), path.alias("path"))
    zero = F.lit(0)
    events = [
        F.transform(_definitions(), lambda d: event(0, d["nth"], zero, nothing, d["name"], d["type"], nothing)),
        F.transform(_usages(), lambda u: event(1, u["nth"], u["at"], u["alias"], u["name"], u["type"], nothing)),
        F.transform(_imports(), lambda i: event(2, zero, zero, i["alias"], F.lit("import"), F.lit("import"), i["path"])),
    ]
    each = F.explode(F.concat(*[F.coalesce(e.cast(_EVENT), F.array().cast(_EVENT)) for e in events]))
    rows = lines.select("split_id", "change_ord", "change_id", "file", "language", "row", "line", each.alias("e")).select("split_id", "change_ord", "change_id", "file", "language", "row", "line", "e.*")
    above = Window.partitionBy("split_id", "change_id", "alias").orderBy("row").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    path = F.max(F.when(F.col("part") == 2, F.struct("row", "path"))).over(above)["path"]
    rows = rows.withColumn("path", path).filter("part <> 1 or path is not null")
    java_type = (F.col("part") == 1) & (F.col("language") == "java") & (F.col("nth") == 0)
    parent = F.when(F.contains("path", F.lit(".")), F.regexp_extract("path", r"^(.*)\.[^.]*$", 1))
    package = F.when(F.col("part") == 0, S.package_of(F.col("file"))).when(java_type, parent).when(F.col("part") == 1, F.col("alias"))
    qualified = F.when(java_type, F.col("path")).when(F.col("part") == 1, F.concat_ws(".", "alias", "name"))
    return rows.withColumn("name", F.when(java_type, F.col("alias")).otherwise(F.col("name"))).withColumn("package", package).withColumn("qualified_name", qualified)


def usages(lines: DataFrame) -> DataFrame:
    """Uses of names whose alias is imported on the same or an earlier line of the hunk."""
    return found(lines).filter("part = 1")


def hunk_symbols(changes: DataFrame) -> DataFrame:
    """Symbols of change rows: definitions, usages, and `import` where a hunk imports anything; the first of each
    (name, type, role, package) stays."""
    rows = found(added_lines(changes))
    mark = F.col("part") == 2  # stands at the hunk's start
    start = lambda c: F.when(mark, 0).otherwise(F.col(c)).alias(c)
    role = F.when(F.col("part") == 0, "definition").otherwise("usage")
    rows = rows.select("split_id", "change_ord", "change_id", "file", F.when(mark, F.col("line") - F.col("row")).otherwise(F.col("line")).cast("int").alias("line"), start("row"), "part", "at", "nth", "name", "type", role.alias("role"), "package", "qualified_name")
    order = [F.col("part"), F.col("row"), F.col("nth"), F.col("at")]
    same = Window.partitionBy("split_id", "change_id", "name", "type", "role", "package").orderBy(*order)
    rows = rows.withColumn("again", F.row_number().over(same)).filter("again = 1")
    nth = F.row_number().over(Window.partitionBy("split_id", "change_id").orderBy(*order, "name", "type")) - 1
    return rows.select("split_id", "change_ord", "change_id", nth.cast("int").alias("sym_ord"), "name", "type", "file", "line", "role", "package", "qualified_name", F.lit(None).cast("string").alias("scope"))


def references(lines: DataFrame, name: str) -> DataFrame:
    """Rows of lines (split_id, pos, line) that hold the name as a word, with 1-based line numbers."""
    return lines.filter(F.col("line").rlike(rf"\b{name}\b")).select("split_id", (F.col("pos") + 1).alias("line_no"), "line")


def called_functions(code: Column) -> Column:
    """Names that a parenthesis follows, without control words."""
    words = F.regexp_extract_all(code, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\("), F.lit(1))
    return F.array_distinct(F.filter(words, lambda x: ~x.isin("if", "for", "while", "switch", "catch", "return")))


def basic_symbols(texts: DataFrame) -> DataFrame:
    """split_id, nth, name, type of the basic patterns over code (split_id, language, code): each pattern can match at the
    start of the text alone, in the order of its language's list."""
    out = F.when(F.lit(False), F.array().cast("array<struct<nth:int,name:string,type:string>>"))
    for language, rules in fixed.BASIC.items():
        each = F.array(*[F.struct(F.lit(i).alias("nth"), F.regexp_extract("code", p, 1).alias("name"), F.lit(t).alias("type")) for i, (p, t) in enumerate(rules)])
        out = out.when(F.col("language") == language, F.filter(each, lambda x: x["name"] != ""))
    return texts.select("split_id", F.explode(out).alias("d")).select("split_id", "d.*")
