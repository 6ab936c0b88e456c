import hashlib
import re
import zlib
from collections import Counter, defaultdict

from hunkmill.llm import exact_dedup, mixing, sharding

from .fixtures import awkward, docs

BLANK = re.compile("[\x20\x09-\x0D]")


def test_exact_dedup_matches_brute_force(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub("", t)].append((i, len(t)))
    want = Counter()
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        left = 1
        for m in sorted(members, key=lambda m: m != keep):
            want[(m[0], keep[0], len(members), left > 0 and m == keep, hashlib.sha256(norm.encode()).hexdigest())] += 1
            left -= m == keep
    for bits in (None, 64):  # a crowded filter lets more rows through to the shuffle, with the same result
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup_report(df, bits).collect())
        assert got == want
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k, n in want.items() if k[3] for _ in range(n))


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.dedup_report(docs(spark, [])).count() == 0
    assert exact_dedup.drop_copies(docs(spark, [])).count() == 0


def test_mix_meets_targets(spark):
    df = awkward(spark)
    out = mixing.mix(df).collect()
    assert len(out) == df.count()
    size = Counter()
    for r in df.collect():
        size[r.source] += len(re.findall("[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, rest = 1.5 * sum(size.values()), {}, set(order)
    while rest:
        level = left / sum(weight[s] for s in rest)
        over = {s for s in rest if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in rest}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        rest -= over
    taken = Counter()
    for r in out:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted((r.doc_id or -1, r.taken) for r in mixing.mix(df.repartition(3)).collect()) == sorted((r.doc_id or -1, r.taken) for r in out)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_shards_are_even_and_keep_equal_texts_together(spark):
    rows = [(i, f"text {i % 1000} " * (1 + i % 5), ("en", "de", None)[i % 3], f"s{i % 6}") for i in range(3000)] + [(9000, None, None, None), (9000, None, None, None), (None, "x", "en", "s")]
    df = docs(spark, rows)
    out = sharding.shard(df, 16).collect()
    assert len(out) == len(rows)
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    texts = {i: t for i, t, _, _ in rows}
    for r in out:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[t].add(r.shard)
    assert set(load) == set(range(16)) and max(load.values()) < 1.25 * min(load.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in where.values())
    hot = sharding.shard(docs(spark, [(i, "one text", "en", "s") for i in range(1600)]), 16).groupBy("shard").count().collect()
    assert len(hot) == 16 and max(r["count"] for r in hot) < 150
    assert sharding.shard(docs(spark, [])).count() == 0
    assert sharding.shard(awkward(spark), target_bytes=2000).count() == awkward(spark).count()


def test_the_widest_dimension_is_cut_first(spark):
    """Sizes alike, sources far apart: the first cut parts the sources in their order."""
    df = docs(spark, [(i, f"{i:06d} text", "en", "a" if i < 500 else "z") for i in range(1000)])
    out = sharding.shard(df, 2).collect()
    assert {r.shard for r in out if r.doc_id < 500} == {0} and {r.shard for r in out if r.doc_id >= 500} == {1}


def test_copies_are_spread_only_where_they_hold_much_of_a_shard(spark):
    rows = [(i, f"text number {i} " * 10, "en", f"s{i % 5}") for i in range(4000)] + [(10000 + i, "some copies " * 10, "en", "s1") for i in range(40)]
    out = sharding.shard(docs(spark, rows), 16).collect()
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    assert len({r.shard for r in out if r.doc_id >= 10000}) == 1 and max(load.values()) < 1.3 * min(load.values())


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LITERALS", 4)  # tables of nodes instead of literals
    rows = [(i, f"text number {i} " * (1 + i % 7), "en", f"s{i % 9}") for i in range(3000)]
    out = sharding.shard(docs(spark, rows), target_bytes=2000).collect()
    load, slots = Counter(), defaultdict(list)
    for r in out:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    total = sum(load.values())
    assert len(out) == 3000 and len(load) >= 0.95 * (total // 2000) and max(load.values()) < 2 * total / len(load)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_dedup_of_text_ids(spark):
    df = spark.createDataFrame([("b", "same text"), ("a", "same  text"), ("c", "sametext"), (None, "x"), ("d", "x"), ("d", "x")], "doc_id string, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup_report(df).collect()}
    assert got == {("b", "a", 3, False), ("a", "a", 3, True), ("c", "a", 3, False), (None, "d", 3, False), ("d", "d", 3, True), ("d", "d", 3, False)}
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(df).collect()) == ["a", "d"]


def test_sets_of_bits_beyond_the_broadcast_bound(spark, monkeypatch):
    """Larger bit sets are joined in a shuffle, with the same result."""
    from hunkmill.llm import common

    df = awkward(spark)
    want = Counter(map(str, exact_dedup.dedup_report(df).collect()))
    monkeypatch.setattr(common, "BROADCAST_BITS", 1)
    assert Counter(map(str, exact_dedup.dedup_report(df).collect())) == want
    assert common.bits_for(10**9) >= 16 * 10**9


def test_mix_does_not_depend_on_slices(spark, monkeypatch):
    df = awkward(spark)
    want = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "SLICE_ROWS", 4)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(map(str, mixing.mix(df).collect())) == want
    assert mixing.repeat_documents(df).columns == df.columns


def test_words_of_slices():
    import pyarrow as pa

    from hunkmill.llm.common import words_of

    texts = pa.array([f"ÄB{i} É Ünd\x85x  \t\n Ende " if i % 3 else None for i in range(50)])
    for part in (texts, texts.slice(7), texts.slice(13, 20)):
        ends, flat = words_of(part)
        ascii_lower = {i: i + 32 for i in range(65, 91)}
        want = [re.findall("[^\x20\x09-\x0D]+", (t or "").translate(ascii_lower)) for t in part.to_pylist()]
        assert [flat.slice(a, b - a).to_pylist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want


def test_no_text_meets_a_filter_too_large_to_broadcast(spark, monkeypatch):
    """Beyond the broadcast bound the report's shuffles carry ids, lengths and hashes, no text; the result is the same."""
    from hunkmill.llm import common

    df = awkward(spark)
    want = sorted(map(str, exact_dedup.dedup_report(df).collect()))
    monkeypatch.setattr(common, "BROADCAST_BITS", 1)
    plans = []
    keep = exact_dedup.materialise

    def seen(out, name):
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return keep(out, name)

    monkeypatch.setattr(exact_dedup, "materialise", seen)
    assert sorted(map(str, exact_dedup.dedup_report(df).collect())) == want
    joins = [line for line in plans[0].split("\n") if "Join" in line]
    assert joins and "text#" not in plans[0].split("Project")[1]
    top = plans[0][: plans[0].rindex("Join")]
    assert "norm#" not in top
