"""Plans over the test tables shuffle rows of change sets once a scan: a change set's joins are windows and groups in place."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hunkmill.functions import fixed, scalars
from hunkmill.operators import deps, grouping, kernels
from hunkmill.plans import queries, result_queries

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode).count("Exchange hash")


@pytest.mark.parametrize("make, most", [
    (queries.usage_dependencies, 2), (queries.import_dependencies, 2), (queries.prerequisite_order, 3), (result_queries.critical_paths, 3), (queries.split_candidates, 6), (queries.kept_groups, 6), (queries.split_patches, 7), (queries.api_change_groups, 2), (queries.symbol_clusters, 1), (queries.group_by_file, 1), (queries.uncovered_groups, 16),
])
def test_one_shuffle_a_scan(spark, make, most):
    assert exchanges(make(spark, SF)) <= most


def test_ends_of_edges(spark):
    changes = spark.createDataFrame([("s", "a", "add", 1), ("s", "b", "modify", 2), ("t", "a", "add", 3)], "split_id string, change_id string, type string, change_ord int")
    edges = spark.createDataFrame([("s", "a", "b", 7), ("s", "b", "a", 8), ("s", "a", "gone", 9), ("t", "a", "b", 7)], "split_id string, source string, target string, n int")
    got = deps.with_ends(edges, changes, "type", "change_ord").select("split_id", "source", "target", "n", F.col("s.type"), F.col("t.change_ord"))
    assert sorted(map(tuple, got.collect())) == [("s", "a", "b", 7, "add", 2), ("s", "a", "gone", 9, "add", None), ("s", "b", "a", 8, "modify", 1), ("t", "a", "b", 7, "add", None)]


def test_facts_of_paths_are_those_of_the_expressions(spark):
    paths = ["", "a", "a.py", "x/y.Z.py", "X\\y/Utils/b.go", "m/Models/helper.go", "api/handler/a_controller.py", "pkg/result.py", "a/", "/a", "src/routes/x.ts", "pkg/types.ts", "UTİLS/utils.GO", "ö/common/ä.d.ts"]
    paths += [f"p/{x}q" for x in (*fixed.PACK_INTERFACES, *fixed.UTILITIES, *fixed.CONTROLLERS)]
    f = F.col("file")
    stem = F.element_at(F.split(scalars.base_name(f), r"\."), 1)
    rows = spark.createDataFrame([(x,) for x in paths], "file string").select("file", scalars.directory(f).alias("parent"), F.coalesce(scalars.directory(f), F.lit("root")).alias("dir"), stem.alias("stem"), scalars.group_layer(f).alias("group_layer"), scalars.pack_layer(f).alias("pack_layer"))
    for r in rows.collect():
        assert kernels.facts_of(r.file) == {k: v for k, v in r.asDict().items() if k != "file"}


def test_plain_reads_nested_columns_as_pyarrow_does():
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.string()), ("c", pa.list_(pa.string())), ("d", pa.float64())]))
    rows = [[{"a": 1, "b": None, "c": ["x", None], "d": 0.5}, None, {"a": None, "b": "y", "c": None, "d": None}], None, [], [{"a": 2, "b": "", "c": [], "d": 1.0}]]
    column = pa.array(rows * 3, kind)
    for part in (column, column.slice(1, 5), column.slice(5), column.slice(2, 1), column.slice(0, 0)):
        assert kernels.plain(part) == part.to_pylist()


def test_kept_groups_in_one_pass(spark):
    rows = [("s", 0, "g", 0.9, ["a", "b"]), ("s", 1, "h", 0.8, ["b", "c"]), ("s", 2, "i", 0.7, ["c", "d", "b"]), ("t", 0, "g", 0.1, ["a"])]
    groups = spark.createDataFrame(rows, "split_id string, group_ord int, group_id string, score double, change_ids array<string>")
    kept = grouping.keep_uncovered(groups)
    assert sorted(map(tuple, kept.select(groups.columns).collect())) == [rows[0], rows[2], rows[3]] and exchanges(kept) == 1


def test_words_of_documents_are_cut_once(spark, tmp_path):
    from hunkmill.plans import code_queries

    texts = [None, "", "  ", "123 --- 45", "One", "a1b c\nd  é 7 É2x, (y) z w", "\tfoo\U0001f600bar\n\nbaz Qux\x00q", "x" * 3000 + " b", "é" * 5000, "a 1 2 3 b 4 c 5 6 d 7 e"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    whole = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]+", "")), " "), lambda x: x != "")
    want = {(str(r.doc_id), *((r.w + ["w"] * 4)[:4])) for r in rows.select("doc_id", whole.alias("w")).collect()}
    got = code_queries._words(spark, str(tmp_path))
    assert {tuple(r) for r in got.select("split_id", *"abcd").collect()} == want
    plan = code_queries.diffs_by_language(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("A-Za-z ]+") == 1


def test_parts_are_sought_where_they_may_begin(spark):
    parts = ("/model/", "/m", "_types.py", ".d.ts", "a", "]x", "^y", "-z", "\\w")
    texts = ["", "/m", "x/model/", "q_types.py", "_types_py", "d.ts", "x.d.ts", "xdd.ts", "b]x", "]", "^y", "^", "-z", "z-", "\\w", "w", "ä/ü", "bab"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("got", scalars._has_any(F.col("t"), parts)).collect()
    assert [r.got for r in rows] == [any(p in t for p in parts) for t in texts]


def test_metadata_files_are_read_once(spark):
    plan = result_queries.split_metadata(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 1


def test_metrics_and_suggestions_meet_in_one_shuffle(spark):
    from hunkmill.operators import quality

    size = (10, 600, 30, 700, 5, 90, 900)
    rows = [("s", i, n, [f"f{i}.py:1", "g.py:2"], list(range(i)), ["w"] if n > 500 else []) for i, n in enumerate(size)] + [("t", 0, 1, ["a.py:1"], [], [])]
    patches = spark.createDataFrame(rows, "split_id string, patch_id int, size_lines int, changes array<string>, depends_on array<int>, warnings array<string>")
    found = quality.metrics(patches)
    want = found.join(quality.suggestions(found, patches), "split_id")
    got = quality.metrics_and_suggestions(patches)
    assert exchanges(got) == 1 and set(got.columns) == set(want.columns)
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())


def test_split_metrics_works_out_changes_once(spark):
    spark.catalog.clearCache()
    out = queries.split_metrics(spark, SF)
    scans = out._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in scans and queries._plan(spark, SF).changes.is_cached
    spark.catalog.clearCache()
