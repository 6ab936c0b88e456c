import random
import re
import time

import numpy as np
import pyarrow as pa

from hunkmill.llm import jaccard_join

from .fixtures import awkward, docs


def brute_sets(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [brute_sets(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return sorted((-1 if i is None else i, len(s), least.get(x, -1) if least.get(x) is not None else -1) for (i, _), s, x in zip(rows, sets, label, strict=True))


def families(rng, n):
    passage = [f"p{i}" for i in range(40)]
    out = []
    for _ in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 5, 30, 80, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"m{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                at = rng.randrange(len(copy))
                copy[at:at] = passage
            out.append(" ".join(copy))
    return out


def shown(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


def test_components_match_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate(families(rng, 60))]
    rows += [(7000, None), (7001, ""), (7002, " \t"), (7003, "A b c"), (7004, "a B\nc"), (7005, "a b"), (5, rows[5][1]), (None, "null id with some more words here")]
    rng.shuffle(rows)
    df = docs(spark, [(i, t, "en", "s") for i, t in rows])
    for cell, small in ((2000, 256), (3, 2), (2000, 2)):  # small cells force pivots, blocks and boundaries
        assert shown(jaccard_join.near_components(df, cell, small)) == brute(rows)
    kept = jaccard_join.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i if i is not None and i > 0 else -1 for i, _, c in brute(rows) if i == c)


def test_awkward_and_empty(spark):
    df = awkward(spark)
    assert shown(jaccard_join.near_components(df)) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert jaccard_join.near_components(docs(spark, [])).count() == 0


def close(links, label):
    for i, j in links:
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def linked(a, b):
    common = len(np.intersect1d(a, b))
    return 100 * common >= 80 * (len(a) + len(b) - common)


def test_join_region_connects_what_brute_force_connects():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.choice(10**6, 40, replace=False)
        sets = []
        for _ in range(25):
            own = base.copy()
            own[rng.integers(0, 40, rng.integers(0, 9))] = rng.integers(10**6, 10**7)
            sets.append(np.unique(own[: rng.integers(30, 41)]).astype(np.int64))
        want = [(i, j) for i in range(25) for j in range(i) if linked(sets[i], sets[j])]
        assert close(jaccard_join.join_region(sets), list(range(25))) == close(want, list(range(25)))
        # A ball, connected beforehand, and the others: only links between the two count.
        ball = np.array([linked(sets[0], s) for s in sets])
        want = [(i, j) for i, j in want if ball[i] != ball[j]]
        start = [0 if ball[i] else i for i in range(25)]
        assert close(jaccard_join.join_region(sets, ball), start) == close(want, start)


def test_blocks_of_a_cell_are_not_connected_beforehand():
    """Every link between two blocks of a cell counts: members of the lower one need not be connected."""
    base = np.arange(40, dtype=np.int64)
    # a - x - b: a and b lie in the lower block and are far apart, x links with both
    a, x, b = base, np.concatenate([base[4:], 100 + base[:4]]), np.concatenate([base[8:], 100 + base[:8]])
    sets, low = [a, b, np.sort(x), base + 1000, base + 2000, base + 3000], np.array([True, True, False, False, False, False])
    sets = [np.sort(s) for s in sets]
    assert linked(a, x) and linked(x, b) and not linked(a, b)
    rows = pa.Table.from_pylist([{"region": 1, "low": 0, "high": 1, "class": i, "block": int(not low[i]), "shingles": s.tobytes()} for i, s in enumerate(sets)])
    rows = rows.cast(pa.schema([("region", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("class", pa.int64()), ("block", pa.int32()), ("shingles", pa.binary())]))
    found = [tuple(r.values()) for batch in jaccard_join._join_regions(rows.to_batches()) for r in batch.to_pylist()]
    assert close(found, list(range(6))) == [0, 0, 0, 3, 4, 5]
    assert close(jaccard_join.join_region(sets, low, ball=False), list(range(6))) == [0, 0, 0, 3, 4, 5]
    assert close(jaccard_join.join_region(sets, ~low, ball=False), list(range(6))) == [0, 0, 0, 3, 4, 5]


def test_a_large_family_takes_linear_time(spark):
    """Distinct near copies of one text: one component, found by a turn of balls and no blocks of pairs."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(6000):
        own = list(words)
        own[i % 60] = f"x{i}"
        rows.append((i, " ".join(own), "en", "s"))
    took = []
    for n in (1500, 6000):
        began = time.time()
        out = jaccard_join.near_components(docs(spark, rows[:n])).groupBy("component_id").count().collect()
        took.append(time.time() - began)
        assert [(r.component_id, r["count"]) for r in out] == [(0, n)]
    assert took[1] < 4 * took[0] + 10


def test_may_link_keeps_all_that_link():
    rng = np.random.default_rng(4)
    for _ in range(20):
        base = rng.integers(-(2**63), 2**63, 60)
        sets = []
        for _ in range(20):
            own = base.copy()
            own[rng.integers(0, 60, rng.integers(0, 25))] = rng.integers(-(2**63), 2**63)
            sets.append(np.unique(own[: rng.integers(40, 61)]))
        size = np.array([len(s) for s in sets])
        counts = np.stack([np.frombuffer(jaccard_join._counts(s), np.uint8) for s in sets])
        for left in (None, rng.random(20) < 0.5):
            kept = jaccard_join.may_link(size, counts, left)
            for i in range(20):
                for j in range(i):
                    common = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * common >= 80 * (size[i] + size[j] - common) and (left is None or left[i] != left[j]):
                        assert kept[i] and kept[j]
