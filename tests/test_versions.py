import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hunkmill.functions import scalars as S
from hunkmill.operators import grouping, kernels
from hunkmill.sources import versions


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, value int")


def test_parts_are_replaced_and_readers_keep_their_version(spark, tmp_path):
    path = str(tmp_path)
    assert versions.read(spark, path) is None and versions.version(spark, path).number == 0
    versions.replace(frame(spark, ("a", 1), ("b", 2), (None, 3)), path, "key")
    old = versions.read(spark, path)
    versions.replace(frame(spark, ("a", 9), ("x/y=z ü", 4)), path, "key")
    assert sorted(map(str, old.collect())) == sorted(map(str, frame(spark, ("a", 1), ("b", 2), (None, 3)).collect()))
    got = {(r.key, r.value) for r in versions.read(spark, path).collect()}
    assert got == {("a", 9), ("b", 2), (None, 3), ("x/y=z ü", 4)}
    versions.replace(frame(spark, ("c", 5)), path, "key", whole=True)
    assert rows_of(versions.read(spark, path)) == [("c", 5)]
    versions.replace(frame(spark), path, whole=True)
    assert versions.read(spark, path).count() == 0


def test_of_two_writers_one_fails(spark, tmp_path):
    path = str(tmp_path)
    base = versions.replace(frame(spark, ("a", 1)), path)
    versions.replace(frame(spark, ("a", 2)), path, after=base)
    with pytest.raises(versions.Conflict):
        versions.replace(frame(spark, ("a", 3)), path, after=base)
    assert rows_of(versions.read(spark, path)) == [("a", 2)]


def test_a_writer_that_dies_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    versions.replace(frame(spark, ("a", 1)), path)
    fail = F.udf(lambda v: 1 // 0, "int")
    with pytest.raises(Exception, match="ZeroDivision|integer division"):
        versions.replace(frame(spark, ("a", 2)).withColumn("value", fail("value")), path)
    assert rows_of(versions.read(spark, path)) == [("a", 1)]

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # after its rows were written and its number claimed
        m.setattr(versions._Files, "put", die)
        with pytest.raises(KeyboardInterrupt):
            versions.replace(frame(spark, ("a", 3)), path)
    assert rows_of(versions.read(spark, path)) == [("a", 1)]
    with pytest.raises(versions.Conflict):  # it might still be at work
        versions.replace(frame(spark, ("a", 4)), path)
    versions.forget(spark, path)
    versions.replace(frame(spark, ("a", 5)), path)
    assert rows_of(versions.read(spark, path)) == [("a", 5)]


def test_batches_are_merged_once_and_reads_do_not_grow(spark, tmp_path):
    path, want = str(tmp_path), {}
    sizes = []
    for batch in range(7):
        rows = [(f"k{i}", batch * 100 + i) for i in range(batch, batch + 5)]
        for _ in range(2):  # each batch comes twice
            versions.merge(frame(spark, *rows), path, "key", 4, batch)
        want |= dict(rows)
        assert dict(rows_of(versions.read(spark, path).select("key", "value"))) == want
        sizes.append(len(versions.version(spark, path).parts))
    assert max(sizes) <= 4 and versions.version(spark, path).number == 7
    versions.merge(frame(spark, ("k0", -1)), path, "key", 4, 3)  # an old batch changes nothing
    assert dict(rows_of(versions.read(spark, path).select("key", "value"))) == want
    assert len(list((Path(path) / "log").glob("0*.json"))) == 2  # old versions and their rows are gone
    kept = {str(p.parent.parent.name) for p in Path(path).glob("data/*/*/*.parquet")}
    assert len(kept) <= 8


def test_related_files_meet_by_parts_of_their_names(spark):
    rnd = random.Random(2)
    names = ["", "a", "ab", "abc", "b", "bc", "x", ".git", "A", "é"]
    files = [f"{rnd.choice(['', 'p/', 'p/q/', 'r/'])}{rnd.choice(names)}{rnd.choice(['', '.py', '.x.py'])}" for _ in range(60)]
    added = spark.createDataFrame([("s", f) for f in files[:30]] + [("t", "a.py")], "split_id string, a_file string").distinct()
    gone = spark.createDataFrame([("s", f) for f in files[30:]], "split_id string, d_file string").distinct()
    want = added.join(gone, "split_id").filter(S.files_related(F.col("d_file"), F.col("a_file")) | (F.col("a_file") == F.col("d_file")))
    assert rows_of(grouping.related_files(added, gone).select("split_id", "a_file", "d_file")) == rows_of(want.select("split_id", "a_file", "d_file"))


def test_extraction_groups_of_a_large_change_set():
    change = lambda i, kind, stem: {"change_id": f"{kind}{i}", "change_ord": i, "file": f"d{i}/{stem}.py", "type": kind, "line_start": 1, "line_end": 2, "dir": f"d{i}", "parent": f"d{i}", "stem": stem, "group_layer": "impl"}
    rows = [change(i, "add" if i % 2 else "delete", f"module{i // 2}x" if i % 4 < 2 else f"module{i // 2}x_old") for i in range(20_000)]
    symbols = [{"change_id": r["change_id"], "name": r["change_id"], "type": "function"} for r in rows if r["type"] == "add"]
    start = time.time()
    found = [g for g in kernels.families(rows, symbols) if g[0].startswith("extract_")]
    assert time.time() - start < 20 and len(found) == 10_000 and found[0][2] == ["add1", "delete0"]
    few = rows[:400]
    got = [g[2] for g in kernels.families(few, symbols[:200]) if g[0].startswith("extract_")]
    gone = [d for d in few if d["type"] == "delete"]
    want = [[c["change_id"], *(d["change_id"] for d in gone if d["parent"] == c["parent"] or d["stem"] in c["stem"] or c["stem"] in d["stem"])] for c in few if c["type"] == "add"]
    assert got == [w for w in want if len(w) > 1]
