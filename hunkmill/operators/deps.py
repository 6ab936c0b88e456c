"""Dependency edges between changes: a change that uses what another defines or imports its directory depends on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S


def _key(prefix: str, name: Column) -> Column:
    return F.concat(F.lit(prefix), name)


def symbol_index(symbols: DataFrame, by_scope: bool = False) -> DataFrame:
    """split_id, key, target: one change for each key of a definition; with by_scope the keys scope.name of methods alone,
    whatever else they are keys of.

    Keys are package.name, file:name, scope.name and method:name; the last definition holds a key, for method:name the first.
    """
    method = F.col("type") == "method"
    entry = lambda k, first, scope=False: F.struct(k.alias("key"), F.lit(first).alias("first"), F.lit(scope).alias("by_scope"))
    keys = F.array(
        entry(F.when(F.coalesce("package", F.lit("")) != "", F.concat_ws(".", "package", "name")), False),
        entry(F.concat_ws(":", "file", "name"), False),
        entry(F.when(method & (F.coalesce("scope", F.lit("")) != ""), F.concat_ws(".", "scope", "name")), False, True),
        entry(F.when(method, _key("method:", F.col("name"))), True),
    )
    rows = symbols.filter("role = 'definition'").select("split_id", "change_id", F.struct("change_ord", "sym_ord").alias("at"), F.explode(keys).alias("k"))
    rows = rows.select("split_id", "change_id", "at", "k.*").filter("key is not null")
    out = rows.groupBy("split_id", "key").agg(F.min_by("change_id", "at").alias("least"), F.max_by("change_id", "at").alias("most"), F.first("first").alias("first"), F.bool_or("by_scope").alias("by_scope"))
    out = out.filter("by_scope") if by_scope else out
    return out.select("split_id", "key", F.when(F.col("first"), F.col("least")).otherwise(F.col("most")).alias("target"))


def package_index(changes: DataFrame) -> DataFrame:
    """split_id, path, change_id: the changes of each directory."""
    return changes.select("split_id", S.directory(F.col("file")).alias("path"), "change_id").filter("path is not null").distinct()


def strength(source_type: Column, target_type: Column) -> Column:
    """0.8 between additions, else 1."""
    return F.when((source_type == "add") & (target_type == "add"), 0.8).otherwise(1.0)


def with_ends(edges: DataFrame, changes: DataFrame, *columns: str) -> DataFrame:
    """edges (split_id, source, target and more; each row once) with structs s and t: these columns of both changes, null
    where one is unknown. Both ends of an edge and the changes meet by one window: rows that lie by split_id stay there."""
    edge = F.struct(*[c for c in edges.columns if c != "split_id"])
    end = lambda name: F.struct(F.lit(name).alias("end"), F.col(name).alias("id"))
    asked = edges.select("split_id", edge.alias("edge"), F.explode(F.array(end("source"), end("target"))).alias("e")).select("split_id", "edge", "e.*")
    known = changes.select("split_id", F.col("change_id").alias("id"), F.struct(*columns).alias("fact"))
    rows = asked.unionByName(known, allowMissingColumns=True).withColumn("fact", F.max("fact").over(Window.partitionBy("split_id", "id"))).filter("edge is not null")
    side = lambda name: F.max(F.when(F.col("end") == name, F.col("fact")))
    return rows.groupBy("split_id", "edge").agg(side("source").alias("s"), side("target").alias("t")).select("split_id", "edge.*", "s", "t")


def _with_strength(edges: DataFrame, changes: DataFrame) -> DataFrame:
    return with_ends(edges, changes, "type").withColumn("strength", strength(F.col("s.type"), F.col("t.type"))).drop("s", "t")


def usage_edges(symbols: DataFrame) -> DataFrame:
    """split_id, source, target, at, name: a usage's first key that is indexed, not its own change; the first of each pair.

    Definitions and usages of a key meet in one window over the rows of symbols, read once; see symbol_index for the keys."""
    method, defines = F.col("type") == "method", F.col("role") == "definition"
    package = F.when(F.coalesce("package", F.lit("")) != "", F.concat_ws(".", "package", "name"))
    named = F.when(method, _key("method:", F.col("name")))
    held = F.array(package, F.concat_ws(":", "file", "name"), F.when(method & (F.coalesce("scope", F.lit("")) != ""), F.concat_ws(".", "scope", "name")), named)
    used = F.array(F.col("qualified_name"), F.when(~package.eqNullSafe(F.col("qualified_name")), package), named)
    rows = symbols.filter("role in ('definition', 'usage')").select("split_id", "change_id", "change_ord", "sym_ord", "name", "role", F.posexplode(F.when(defines, held).otherwise(used)).alias("level", "key")).filter("key <> ''")
    key = Window.partitionBy("split_id", "key")
    at = F.when(defines, F.struct("change_ord", "sym_ord"))
    first = F.bool_or(defines & (F.col("level") == 3)).over(key)
    target = F.when(first, F.min_by("change_id", at).over(key)).otherwise(F.max_by("change_id", at).over(key))
    hits = rows.withColumn("target", target).filter("role = 'usage' and target is not null")
    hits = hits.groupBy("split_id", F.col("change_id").alias("source"), "change_ord", "sym_ord", "name").agg(F.min_by("target", "level").alias("target")).filter("source <> target")
    least = F.min(F.struct("change_ord", "sym_ord", "name"))
    return hits.groupBy("split_id", "source", "target").agg(least.alias("f")).select("split_id", "source", "target", F.struct("f.change_ord", "f.sym_ord").alias("at"), F.col("f.name").alias("name"))


def import_edges(imports: DataFrame, changes: DataFrame, suffix: bool = False) -> DataFrame:
    """split_id, source, target, path: imports of another change's directory, by exact path, or with `suffix` by any
    trailing part of the path."""
    index = changes.select("split_id", S.directory(F.col("file")).alias("path"), F.col("change_id").alias("target")).filter("path is not null")
    own = imports.select("split_id", F.col("change_id").alias("source"), "path").filter("path is not null")
    if suffix:
        parts = F.split(F.replace("path", F.lit("."), F.lit("/")), "/")
        tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
        own = own.select("split_id", "source", F.explode(tails).alias("path"))
    met = own.unionByName(index, allowMissingColumns=True).groupBy("split_id", "path").agg(F.collect_set("source").alias("sources"), F.collect_set("target").alias("targets")).filter("size(sources) > 0 and size(targets) > 0")
    pairs = met.select("split_id", "path", F.explode("sources").alias("source"), "targets").select("split_id", "path", "source", F.explode("targets").alias("target"))
    return pairs.filter("source <> target").groupBy("split_id", "source", "target").agg(F.min("path").alias("path"))


def dependencies(changes: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges of both kinds in order: by source, usages before imports; one edge of each kind for a pair may stand."""
    used = usage_edges(symbols).select("split_id", "source", "target", F.lit(0).alias("part"), F.lit("defines_uses").alias("type"), F.concat(F.lit("Uses "), F.col("name")).alias("reason"))
    brought = import_edges(imports, changes).select("split_id", "source", "target", F.lit(1).alias("part"), F.lit("import").alias("type"), F.concat(F.lit("Imports "), F.col("path")).alias("reason"))
    rows = with_ends(used.unionByName(brought), changes, "type", "change_ord")
    nth = F.row_number().over(Window.partitionBy("split_id").orderBy("s.change_ord", "part", "target")) - 1
    return rows.select("split_id", nth.cast("int").alias("dep_ord"), "source", "target", "type", strength(F.col("s.type"), F.col("t.type")).alias("strength"), "reason")


def call_edges(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """By bare name, to the last definer; repeated calls repeat their edge. calls: split_id, source, name."""
    index = symbols.filter("role = 'definition'").groupBy("split_id", "name").agg(F.max_by("change_id", F.struct("change_ord", "sym_ord")).alias("target"))
    return calls.join(index, ["split_id", "name"]).filter("source <> target")


def same_file_import_edges(imported: DataFrame, used: DataFrame, changes: DataFrame) -> DataFrame:
    """split_id, source, target, strength: a hunk that uses a package another hunk of its file imports.

    imported: split_id, file, target, package, kind, language; used: split_id, file, source, usage. In Go the last part of
    the import path matches, in C and C++ the header's name, else the package itself, a package below the usage, or a part
    of its path. A pair that rests on standard or on external imports alone is dropped; hunks that import are no users.
    """
    usage, package = F.col("usage"), F.col("package")
    other = (usage == package) | F.startswith(package, F.concat(usage, F.lit("."))) | F.array_contains(F.split(package, r"\."), usage)
    header = F.replace(F.replace(package, F.lit(".h"), F.lit("")), F.lit(".hpp"), F.lit(""))
    on = F.when(F.col("language") == "go", F.element_at(F.split(package, "/"), -1) == usage).when(F.col("language").isin("c", "cpp"), header == usage).otherwise(other)
    users = used.join(imported.select("split_id", F.col("target").alias("source")).distinct(), ["split_id", "source"], "left_anti")
    pairs = users.join(imported, ["split_id", "file"]).filter(on)
    kinds = F.collect_set("kind")
    found = pairs.groupBy("split_id", "source", "target").agg(kinds.alias("kinds")).filter(~((F.size("kinds") == 1) & F.col("kinds")[0].isin("stdlib", "external")))
    return _with_strength(found.select("split_id", "source", "target"), changes)


def with_suggested(deps: DataFrame, suggested: DataFrame) -> DataFrame:
    """deps and, after them, suggested edges (split_id, nth, source, target, strength, reason): a strength of 0.8 and a
    standing reason where none is given; edges with a wildcard are left out."""
    wild = F.contains("source", F.lit("*")) | F.contains("target", F.lit("*"))
    top = deps.groupBy("split_id").agg(F.max("dep_ord").alias("__top"))
    nth = F.row_number().over(Window.partitionBy("split_id").orderBy("nth"))
    more = suggested.filter(~wild).withColumn("nth", nth).join(top, "split_id", "left")
    more = more.select("split_id", (F.coalesce("__top", F.lit(-1)) + F.col("nth")).cast("int").alias("dep_ord"), "source", "target", F.lit("call_chain").alias("type"), F.coalesce("strength", F.lit(fixed.SUGGESTED_STRENGTH)).alias("strength"), F.coalesce("reason", F.lit(fixed.SUGGESTED_REASON)).alias("reason"))
    return deps.unionByName(more)


def file_edges(symbols: DataFrame, common: bool = False) -> DataFrame:
    """split_id, file_a, file_b: files of which a uses a name that b defines; with `common` any name that both hold
    counts, both ways."""
    names = symbols.select("split_id", "file", "name", "role").distinct()
    left = names if common else names.filter("role = 'usage'")
    right = names if common else names.filter("role = 'definition'")
    pairs = left.select("split_id", "name", F.col("file").alias("file_a")).join(right.select("split_id", "name", F.col("file").alias("file_b")), ["split_id", "name"])
    return pairs.filter("file_a <> file_b").select("split_id", "file_a", "file_b").distinct()


def import_kind(package: Column, standard: tuple[str, ...], external: tuple[str, ...]) -> Column:
    low, base = F.lower(package), F.element_at(F.split(F.lower(package), r"[./]"), 1)
    starts = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.startswith(low, p) | (base == p)) if parts else F.lit(False)
    return F.when(starts(standard), "stdlib").when(starts(external), "external").otherwise("internal")


def neighbours(deps: DataFrame, change_id: str) -> DataFrame:
    """split_id, change_id, side: what the change depends on (prerequisite) and what depends on it (dependent)."""
    return deps.filter(F.col("source") == change_id).select("split_id", F.col("target").alias("change_id"), F.lit("prerequisite").alias("side")).unionByName(
        deps.filter(F.col("target") == change_id).select("split_id", F.col("source").alias("change_id"), F.lit("dependent").alias("side"))
    ).distinct()
