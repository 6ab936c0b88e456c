import re
from collections import Counter

import pytest

from hunkmill.llm import mixing

from .fixtures import awkward, docs

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_mix_repeats_whole_documents(spark):
    df = awkward(spark)
    taken = Counter()
    size = {}
    for r in mixing.mix(df).collect():
        taken[(r.doc_id, r.size)] += r.taken
        size[(r.doc_id, r.size)] = r.size
    out = mixing.repeat_documents(df)
    assert out.columns == df.columns
    copies = Counter((r.doc_id, len(re.findall("[^\x20\x09-\x0D]+", r.text or ""))) for r in out.collect())
    rows = Counter((r.doc_id, len(re.findall("[^\x20\x09-\x0D]+", r.text or ""))) for r in df.collect())
    for key, n in rows.items():
        assert copies[key] == n if not key[1] else abs(copies[key] - taken[key] / key[1]) <= 0.5
    assert mixing.repeat_documents(docs(spark, [])).count() == 0


def test_stages_keep_columns_and_run_to_the_end(spark, tmp_path):
    rows = [(i, f"plain words of document number {i} with a tail {i * 7} and some more {'grubbish' if i % 5 == 0 else ''} here", "en", f"s{i % 3}") for i in range(200)]
    rows += [(1000 + i, rows[1][1], "en", "s1") for i in range(5)] + [(2000, rows[2][1].replace(" ", "\n"), "en", "s0"), (2001, None, None, None)]
    docs(spark, rows).drop("h", "node", "candidate", "size").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, table, str(tmp_path))
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows if i >= 1000 or i % 5}
    once = corpus_pipeline.drop_copies(spark, kept, str(tmp_path))
    assert {1, 2, 2000, 2001} & {r.doc_id for r in once.collect()} == {1, 2, 2001} and once.columns == table.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 0 < out.count() and out.filter("not round_trip").count() == 0


def test_awkward_tables_run_through(spark, tmp_path):
    """Null ids and texts, very long and repeated rows, clashing columns, and an empty table, by every stage."""
    df = awkward(spark)
    long_text = " ".join(f"w{i}" for i in range(60000))
    more = docs(spark, [(5000, long_text, "en", "s1"), (5001, long_text + " tail", "en", "s1"), (5002, long_text, None, None)])
    for name, rows in (("some", df.unionByName(more)), ("none", docs(spark, []))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    out = corpus_pipeline.run(spark, f"{tmp_path}/some")
    assert spark.conf.get(key) == before
    assert out.count() > 0 and out.filter("not round_trip or not parity").count() == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    stages, rows = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    ids = {}
    for name in [name for name, _ in corpus_pipeline.STAGES[:-1]]:
        kept = stages[name](spark, rows, f"{tmp_path}/some")
        assert kept.columns == rows.columns
        kept.write.parquet(f"{tmp_path}/some/{name}")
        rows = spark.read.parquet(f"{tmp_path}/some/{name}")
        ids[name] = Counter(r.doc_id for r in rows.select("doc_id").collect())
    # Labels teach nothing, so all rows stay; of equal texts the longest with the least id; then one of the near copies.
    assert sum(ids["toxicity"].values()) == df.count() + 3
    assert ids["exact dedup"][5000] == 1 and ids["exact dedup"][5002] == 0 and ids["exact dedup"][5001] == 1 and ids["exact dedup"][None] == 1
    assert ids["exact dedup"][1000] == 1 and ids["exact dedup"][1001] == 0
    assert ids["n-gram jaccard join"][5000] == 1 and ids["n-gram jaccard join"][5001] == 0 and ids["n-gram jaccard join"][None] == 1
    spark.conf.set(key, before)
