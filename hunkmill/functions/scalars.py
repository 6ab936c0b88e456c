"""Scalar rules as Column expressions; all run inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _has_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Does the text hold any of the parts? One pattern, so that the generated code stays small; it looks for the parts'
    first characters first, as most places of a text have none of them."""
    firsts = sorted({p[0] for p in parts})
    ways = [f"{re.escape(c)}(?:{'|'.join(re.escape(p[1:]) for p in parts if p[0] == c)})" for c in firsts]
    return text.rlike(f"(?=[{''.join(map(re.escape, firsts))}])(?:{'|'.join(ways)})")


def _choose(key: Column, table: dict[str, str], otherwise: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(otherwise))


def language_of(file: Column) -> Column:
    """Language by suffix, case-sensitive, else unknown."""
    out = F.when(F.lit(False), F.lit(""))
    for suffix, name in fixed.LANGUAGES.items():
        out = out.when(F.endswith(file, F.lit(suffix)), name)
    return out.otherwise("unknown")


def main_language_of(ext: Column) -> Column:
    """Language of a suffix for the main language, else unknown."""
    return _choose(ext, fixed.MAIN_LANGUAGES, "unknown")


def import_line(line: Column, language: Column) -> Column:
    """Is the line an import of its language?"""
    out = F.when(F.lit(False), F.lit(False))
    for name, patterns in fixed.IMPORT_LINES.items():
        out = out.when(language == name, line.rlike("|".join(f"(?:{p})" for p in patterns)))
    return F.coalesce(out.otherwise(False), F.lit(False))


def change_type(added: Column, deleted: Column) -> Column:
    return F.when((added > 0) & (deleted > 0), "modify").when(added > 0, "add").otherwise("delete")


def hunk_field(header: Column, group: int) -> Column:
    """Group 1 old start, 2 old length, 3 new start, 4 new length, 5 section of a hunk header; lengths default to 1."""
    got = F.regexp_extract(header, r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$", group)
    if group == 5:
        return got
    return F.when(got != "", got.cast("int")).otherwise(F.when(header.rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@"), F.lit(1)))


def directory(file: Column) -> Column:
    """Parent directory with /, null at the root."""
    path = F.replace(file, F.lit("\\"), F.lit("/"))
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def package_of(file: Column) -> Column:
    """Name of the parent directory, null at the root."""
    return F.element_at(F.split(directory(file), "/"), -1)


def base_name(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -1)


def files_related(a: Column, b: Column) -> Column:
    """Same directory, or one base name (before the first dot) within the other."""
    stem = lambda f: F.element_at(F.split(base_name(f), r"\."), 1)
    return directory(a).eqNullSafe(directory(b)) | F.contains(stem(a), stem(b)) | F.contains(stem(b), stem(a))


def qualified_name(qualified: Column, package: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(qualified, F.lit("")), F.when(F.coalesce(package, F.lit("")) != "", F.concat_ws(".", package, name)), name)


def hunk_digest(lines: Column) -> Column:
    """MD5 over the lines without empty ones and headers, trailing white space cut."""
    kept = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: (x != "") & ~F.startswith(x, F.lit("@@")))
    return F.md5(F.array_join(kept, "\n").cast("binary"))


def interface_file(file: Column) -> Column:
    return _has_any(F.lower(file), fixed.SPLIT_INTERFACES)


def _layer(file: Column, interfaces: tuple[str, ...]) -> Column:
    rule = lambda low: F.when(_has_any(low, interfaces), "interface").when(_has_any(low, fixed.UTILITIES), "util").when(_has_any(low, fixed.CONTROLLERS), "controller").otherwise("impl")
    return F.transform(F.array(F.lower(file)), rule)[0]  # lowered once


def group_layer(file: Column) -> Column:
    return _layer(file, fixed.GROUP_INTERFACES)


def pack_layer(file: Column) -> Column:
    return _layer(file, fixed.PACK_INTERFACES)


def layer_cohesion(layer: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for name, score in fixed.LAYERS.items():
        out = out.when(layer == name, score)
    return out


def highlight_language(file: Column) -> Column:
    ext = F.lower(F.element_at(F.split(file, r"\."), -1))
    return F.when(F.coalesce(file, F.lit("")) == "", "text").otherwise(_choose(ext, fixed.HIGHLIGHT, "text"))


def type_name(file: Column) -> Column:
    return _choose(highlight_language(file), fixed.TYPE_NAMES, "Unknown")


def icon_kind(file: Column) -> Column:
    """Exact names first, then the last extension, else default."""
    low = F.lower(base_name(file))
    ext = F.element_at(F.split(low, r"\."), -1)
    return F.when(low.isin("dockerfile", "makefile"), low).when(F.contains(low, F.lit(".")), _choose(ext, fixed.HIGHLIGHT, "default")).otherwise("default")


def safe_file_name(name: Column) -> Column:
    return F.substring(F.replace(F.replace(name, F.lit(" "), F.lit("_")), F.lit("/"), F.lit("_")), 1, 50)


def pull_request_url(url: Column) -> Column:
    """struct(owner, repo, number), null where the URL is none."""
    pattern = r"^https?://github\.com/([^/]+)/([^/]+)/pull/(\d+)"
    parts = F.struct(F.regexp_extract(url, pattern, 1).alias("owner"), F.regexp_extract(url, pattern, 2).alias("repo"), F.regexp_extract(url, pattern, 3).cast("int").alias("number"))
    return F.when(url.rlike(pattern), parts)


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "")


def truncate(text: Column, most: int, keep: int) -> Column:
    """The first `keep` characters and three dots where the text is longer than `most`."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def first_line(text: Column) -> Column:
    return F.element_at(F.split(text, "\n"), 1)


def _ago(seconds: Column, unit: int, mark: str) -> Column:
    return F.concat(F.floor(seconds / unit).cast("string"), F.lit(f"{mark} ago"))


def relative_time(seconds: Column) -> Column:
    """Just now under a minute, minutes under an hour, hours under a day, else days."""
    return F.when(seconds < 60, "just now").when(seconds < 3600, _ago(seconds, 60, "m")).when(seconds < 86400, _ago(seconds, 3600, "h")).otherwise(_ago(seconds, 86400, "d"))


def cache_age(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "").when(seconds < 60, _ago(seconds, 1, "s")).when(seconds < 3600, _ago(seconds, 60, "m")).when(seconds < 86400, _ago(seconds, 3600, "h")).otherwise(_ago(seconds, 86400, "d"))


def first_line_cut(text: Column, most: int = 80) -> Column:
    """The first line, cut at `most` characters; three dots where anything was left out."""
    line = first_line(text)
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(F.char_length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).when(F.contains(text, F.lit("\n")), F.concat(line, F.lit("..."))).otherwise(line)


def short_hash(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def scopes(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def change_description(kind: Column, symbols: Column, file: Column, added: Column, deleted: Column) -> Column:
    """What a hunk does to its file: by type, with its first three symbols where it has any."""
    named = F.array_join(F.slice(symbols, 1, 3), ", ")
    some = F.size(symbols) > 0
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return (
        F.when(some & (kind == "add"), say("Adds ", named, " to ", file)).when(some & (kind == "modify"), say("Modifies ", named, " in ", file))
        .when(some & (kind == "delete"), say("Removes ", named, " from ", file)).when(kind == "add", say("Adds ", added.cast("string"), " lines to ", file))
        .when(kind == "modify", say("Modifies ", file)).when(kind == "delete", say("Removes ", deleted.cast("string"), " lines from ", file)).otherwise(say("Changes in ", file))
    )


def type_counts(adds: Column, modifies: Column, deletes: Column) -> Column:
    part = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}")))
    return F.concat_ws(", ", part(adds, "additions"), part(modifies, "modifications"), part(deletes, "deletions"))


def size_score(size: Column) -> Column:
    """0 at 0, 0.3 under 10, rising to 1 at 50, 1 to 200, falling to 0.3 at 500, then 0.1."""
    return (
        F.when(size == 0, 0.0).when(size < 10, 0.3).when(size < 50, 0.3 + (size - 10) / 40.0 * 0.7).when(size <= 200, 1.0)
        .when(size <= 500, 1.0 - (size - 200) / 300.0 * 0.7).otherwise(0.1)
    )


def reviewability(size: Column, files: Column, warnings: Column) -> Column:
    return 0.5 * size_score(size) + 0.3 / (1.0 + 0.2 * (files - 1)) + 0.2 * F.greatest(F.lit(0.0), 1.0 - 0.2 * warnings)


def balance(sizes_avg: Column, sizes_std: Column, count: Column) -> Column:
    return F.when((count < 2) | (sizes_avg == 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - sizes_std / sizes_avg))


def jaccard(a: Column, b: Column) -> Column:
    """0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def without_prefix(path: Column, prefix: str) -> Column:
    """Path below prefix, for paths that lie there; an exact match stays."""
    p = prefix.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(p)), F.substring(path, len(p) + 1, 1 << 30)).otherwise(path)


def under(path: Column, prefix: str) -> Column:
    return F.startswith(path, F.lit(prefix.rstrip("/") + "/")) | (path == prefix.rstrip("/"))


def swap_root(path: Column, old: str, new: str) -> Column:
    """Paths under the root `old` moved to `new`; others unchanged."""
    return F.when(under(path, old), F.concat(F.lit(new.rstrip("/")), F.substring(path, len(old.rstrip("/")) + 1, 1 << 30))).otherwise(path)


def json_of(text: Column) -> Column:
    """JSON in a free text, as a string: the whole, a fenced block, or the span from the first { to the last }."""
    fenced = F.regexp_extract(text, r"```(?:json)?\s*(\{[\s\S]*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(\{[\s\S]*\})", 1)
    fine = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(fine(text), fine(F.nullif(fenced, F.lit(""))), fine(F.nullif(braces, F.lit(""))))
