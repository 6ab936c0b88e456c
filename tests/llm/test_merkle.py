import hashlib
import zlib
from collections import Counter, defaultdict

from hunkmill.llm import common, merkle

from .fixtures import awkward, docs


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[i:i + 16]) for i in range(0, len(low), 16)])
    return levels


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        seen = r.text
        if r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
            seen = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
        by[r.source].append((r.doc_id, leaf(r, r.text), leaf(r, seen)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: tree([x[1] for x in by[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    root = top[-1][0]
    out = Counter()
    for nth, s in enumerate(order):
        for i, (doc_id, own, seen) in enumerate(by[s]):
            node, siblings = seen, []
            for levels, k in ((trees[s], i), (top, nth)):
                for level in levels[:-1]:
                    at = k // 16 * 16
                    before, after = level[at:k], level[k + 1:at + 16]
                    siblings += before + after
                    node, k = h(*before, node, *after), k // 16
            out[(doc_id, own, trees[s][-1][0], root, h(*siblings), node, node == root)] += 1
    return out


def check(df):
    got = merkle.manifest(df, merkle.tampered())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == brute(df.collect())


def test_awkward_rows(spark):
    check(awkward(spark))


def test_deep_trees_lone_leaves_and_a_run_of_one(spark):
    rows = [(i, f"Text {i}", "en", "hot") for i in range(300)] + [(1000 + i, f"T{i}", "de", "seventeen") for i in range(17)]
    rows += [(2000 + i, f"Alone {i}", None, f"s{i:03d}") for i in range(40)] + [(None, None, None, None)] * 2 + [(7, "Same", "en", "twice")] * 35
    check(docs(spark, rows).repartition(7))


def test_one_source_one_row_and_none(spark):
    check(docs(spark, [(5, "Alone", "en", "s")]))
    check(docs(spark, [(i, "Some", "en", "s") for i in range(20)]))
    none = merkle.manifest(docs(spark, []), merkle.tampered())
    assert none.count() == 0 and "folded_root" in none.columns


def test_many_sorted_partitions(spark, monkeypatch):
    """The same rows sorted into one partition and into many, a source of equal rows among them, have the same root."""
    rows = [(i % 4000, f"Row {i % 4000}", "en", ("hot", "b", None)[i % 3]) for i in range(12000)] + [(1, "Copy", "en", "copies")] * 500
    df = docs(spark, rows)
    store = merkle.build(df, common.scratch(spark, "test"))
    monkeypatch.setattr(merkle, "PARTITION_ROWS", 10**9)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert merkle.build(df.repartition(3), common.scratch(spark, "test")).root == store.root
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    trees = spark.read.parquet(f"{store.path}/sources")
    assert sorted((r.source or "", r.leaves) for r in trees.collect()) == [("", 4000), ("b", 4000), ("copies", 500), ("hot", 4000)]
    found = merkle.check(merkle.proofs(spark, store), store.root)
    assert found.count() == len(rows) and found.filter("not verified").count() == 0


def test_folder_of_each_level(spark):
    store = merkle.build(docs(spark, [(i, "t", "en", "s") for i in range(300)]), common.scratch(spark, "test"))
    assert (store.levels, store.upper) == (3, 0)
    sizes = [spark.read.parquet(f"{store.path}/nodes/level={k}").selectExpr("sum(size(run))").first()[0] for k in range(3)]
    assert sizes == [300, 19, 2]
