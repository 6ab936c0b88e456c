"""Patch tables out: patch files, metadata, summaries, scripts, comments, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import splitting


def patch_name() -> Column:
    return F.format_string("%02d_%s.patch", "patch_id", S.safe_file_name(F.col("name")))


def patch_files(patches: DataFrame, changes: DataFrame) -> DataFrame:
    """split_id, patch_id, files: the files that a patch's changes touch."""
    rows = patches.select("split_id", "patch_id", F.explode("changes").alias("change_id")).join(changes.select("split_id", "change_id", "file"), ["split_id", "change_id"])
    return rows.groupBy("split_id", "patch_id").agg(F.array_sort(F.collect_set("file")).alias("files"))


def patch_texts(patches: DataFrame, changes: DataFrame, categories: DataFrame, generated_at: str) -> DataFrame:
    """split_id, patch_id, filename, text: six comment lines (name, category, priority, time, files, description), then
    each file's header and its hunks in line order, the files by name."""
    rows = patches.select("split_id", "patch_id", F.explode("changes").alias("change_id")).join(changes, ["split_id", "change_id"])
    old = F.when(F.col("old_path") == "/dev/null", "/dev/null").otherwise(F.concat(F.lit("a/"), F.coalesce("old_path", "file")))
    new = F.when(F.col("new_path") == "/dev/null", "/dev/null").otherwise(F.concat(F.lit("b/"), F.coalesce("new_path", "file")))
    mode = F.when(F.col("old_path") == "/dev/null", "\nnew file mode 100644").when(F.col("new_path") == "/dev/null", "\ndeleted file mode 100644").otherwise("")
    head = F.concat(F.lit("diff --git a/"), F.col("file"), F.lit(" b/"), F.col("file"), mode, F.lit("\n--- "), old, F.lit("\n+++ "), new, F.lit("\n"))
    hunks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "change_ord", "content"))), lambda x: x["content"]), "\n")
    files = rows.groupBy("split_id", "patch_id", "file").agg(F.concat(F.min(head), hunks).alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("file", "text")))
    body = files.groupBy("split_id", "patch_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("body"), F.array_join(F.transform(listed, lambda x: x["file"]), ", ").alias("files"))
    out = patches.join(body, ["split_id", "patch_id"]).join(categories, ["split_id", "patch_id"], "left")
    line = lambda name, value: F.concat(F.lit(f"# {name}"), value)
    comment = F.concat_ws(
        "\n", line("", F.col("name")), line("Category: ", F.coalesce("category", F.lit("other"))), line("Priority: ", (F.size("depends_on") + 1).cast("string")), line("Generated: ", F.lit(generated_at)),
        line("Files: ", F.col("files")), line("Description: ", F.col("description")), F.lit(""),
    )
    return out.select("split_id", "patch_id", patch_name().alias("filename"), F.concat(comment, F.lit("\n"), F.col("body"), F.lit("\n")).alias("text"))


def write_patches(texts: DataFrame, path: str) -> None:
    """One text file for each patch, in split_id=/filename= folders; the writer commits a task's files together."""
    texts.select("split_id", "filename", "text").repartition("split_id", "filename").write.mode("overwrite").partitionBy("split_id", "filename").option("lineSep", "\0").text(path)


def metadata(patches: DataFrame, categories: DataFrame, generated_at: int, repository: dict | None = None, mental_model: str | None = None) -> DataFrame:
    """split_id, json: what a split's metadata file holds. repository: name, path, branch; mental_model only where one is given."""
    rows = patches.join(categories, ["split_id", "patch_id"], "left")
    files = F.array_sort(F.array_distinct(F.transform("changes", lambda c: F.element_at(F.split(c, ":"), 1))))
    one = F.struct(F.col("patch_id").alias("id"), "name", "description", "category", (F.size("depends_on") + 1).alias("priority"), files.alias("files"), F.col("depends_on").alias("dependencies"), patch_name().alias("filename"), "size_lines", "warnings")
    out = rows.groupBy("split_id").agg(F.array_sort(F.collect_list(one)).alias("patches"))
    goal = F.array_join(F.transform("patches", lambda p: p["name"]), "; ")
    repo = F.struct(*[F.lit((repository or {}).get(k)).cast("string").alias(k) for k in ("name", "path", "branch")])
    parts = [F.lit(generated_at).alias("generated_at"), F.size("patches").alias("total_patches"), goal.alias("goal_summary"), repo.alias("repository"), "patches"]
    if mental_model is not None:
        parts.append(F.lit(mental_model).alias("mental_model"))
    return out.select("split_id", F.to_json(F.struct(*parts)).alias("json"))


def write_resplit(patches: DataFrame, old_id: int, parts: DataFrame, path: str) -> None:
    """Replaces patch old_id in the stored patch tables at `path` (patches, by split_id) by parts: the whole table of the
    splits concerned is written anew, other splits stay as they are."""
    spark = patches.sparkSession
    fresh = splitting.resplit(patches, old_id, parts)
    fresh = fresh.withColumn("filename", patch_name())
    with_mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        fresh.write.mode("overwrite").partitionBy("split_id").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", with_mode)


def markdown(patches: DataFrame, categories: DataFrame) -> DataFrame:
    """split_id, text: patches by category in alphabetical order, then the order in which to apply them."""
    rows = patches.join(categories, ["split_id", "patch_id"])
    line = F.format_string("- **%02d** %s (%d lines)", "patch_id", "name", "size_lines")
    parts = rows.groupBy("split_id", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("patch_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "lines"))), lambda x: F.concat(F.lit("## "), F.initcap(x["category"]), F.lit("\n\n"), x["lines"])), "\n\n")
    order = rows.groupBy("split_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("patch_id", "name"))), lambda x: F.format_string("%d. %s", x["patch_id"] + 1, x["name"])), "\n").alias("order"))
    return parts.groupBy("split_id").agg(text.alias("sections")).join(order, "split_id").select("split_id", F.concat(F.lit("# Patches\n\n"), F.col("sections"), F.lit("\n\n## Order\n\n"), F.col("order"), F.lit("\n")).alias("text"))


def apply_script(patches: DataFrame) -> DataFrame:
    """split_id, text: a shell script with a step for each patch."""
    name = patch_name()
    step = F.format_string("echo 'Applying %s'\ngit apply --check '%s' && git apply '%s'", name, name, name)
    steps = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("patch_id", step.alias("step")))), lambda x: x["step"]), "\n\n")
    return patches.groupBy("split_id").agg(F.concat(F.lit("#!/bin/bash\nset -e\n\n"), steps, F.lit("\n")).alias("text"))


def comment(patches: DataFrame) -> DataFrame:
    """split_id, text: a table of the patches and one folded block for each."""
    row = F.format_string("| %d | %s | %d | %d |", "patch_id", "name", "size_lines", F.size("changes"))
    block = F.format_string("<details><summary>%s</summary>\n\n%s\n\n</details>", "name", "description")
    packed = F.array_sort(F.collect_list(F.struct("patch_id", row.alias("row"), block.alias("block"))))
    out = patches.groupBy("split_id").agg(packed.alias("p"))
    join = lambda f: F.array_join(F.transform("p", lambda x: x[f]), "\n")
    return out.select("split_id", F.concat(F.lit("| # | Patch | Lines | Hunks |\n|---|---|---|---|\n"), join("row"), F.lit("\n\n"), join("block")).alias("text"))


def annotations(patches: DataFrame, changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """A row for each change of each patch, numbered by file and start: header (made up where the content has none), old
    and new start, description."""
    names = symbols.groupBy("split_id", "change_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sym_ord", "name"))), lambda x: x["name"]).alias("names"))
    rows = patches.select("split_id", "patch_id", F.explode("changes").alias("change_id")).join(changes, ["split_id", "change_id"]).join(names, ["split_id", "change_id"], "left")
    first = F.try_element_at(F.filter(F.split("content", "\n"), lambda x: F.startswith(x, F.lit("@@"))), F.lit(1))
    header = F.coalesce(first, F.format_string("@@ -%d,1 +%d,1 @@", "line_start", "line_start"))
    starts = [F.coalesce(S.hunk_field(header, i), F.col("line_start")) for i in (1, 3)]
    text = S.change_description(F.col("type"), F.coalesce("names", F.array().cast("array<string>")), F.col("file"), F.col("added_lines"), F.col("deleted_lines"))
    nth = F.row_number().over(Window.partitionBy("split_id", "patch_id").orderBy("file", "line_start", "change_ord")) - 1
    return rows.select("split_id", "patch_id", nth.alias("nth"), F.col("file").alias("file_path"), header.alias("hunk_header"), starts[0].alias("start_line"), starts[1].alias("end_line"), text.alias("description"))


def annotated_lines(rows: DataFrame) -> DataFrame:
    """split_id, patch_id, file_path, lines: the lines that a file's annotations span, ends included."""
    return rows.groupBy("split_id", "patch_id", "file_path").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"))
