import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hunkmill.llm import hard_negatives

SCHEMA = "label int, embedding array<double>, slot string, vec_id long, score double, group int"


def rows_of(spark, rows):
    """rows of (vec_id, label, vector); the other columns clash with names used inside the operator."""
    return spark.createDataFrame([(label, v, "x", i, 1.0, 2) for i, label, v in rows], SCHEMA)


def brute(rows, anchors, positives=5, k=3, lower=50, upper=95):
    whole = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, label, [math.floor(256 * x) for x in v]))
    out = Counter()
    for a, label, v in whole:
        if not anchors(a):
            continue
        scored = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), i, lab) for i, lab, w in whole)  # noqa: B905
        for p, pos, _ in [s for s in scored if s[2] == label and s[1] != a][:positives]:
            fits = [s for s in scored if s[2] != label and lower * -p <= 100 * -s[0] <= upper * -p][:k]
            for rank, (n, neg, _) in enumerate(fits, 1):
                out[(a, pos, rank, neg, -p, -n)] += 1
    return out


def check(spark, rows, parts=3, **more):
    got = hard_negatives.mine(rows_of(spark, rows).repartition(parts), F.col("vec_id") % 10 == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, lambda i: i % 10 == 0, **more)
    assert Counter(map(tuple, got.collect())) == want
    return want


def vectors(n, dim=6, seed=5, spread=1.0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.4) for _ in range(dim)] for _ in range(4)]
    return [(i, rnd.randrange(4), [c + rnd.gauss(0, 0.3) * spread for c in centres[rnd.randrange(4)]]) for i in range(n)]


def test_all_scores_of_all_anchors(spark, monkeypatch):
    rows = vectors(300)
    assert len(check(spark, rows)) > 200
    for name, value in (("ROWS", 16), ("ANCHORS", 4), ("GROUP_BYTES", 500)):  # many blocks, chunks and groups
        monkeypatch.setattr(hard_negatives, name, value)
    check(spark, rows[:120], positives=3, k=4, lower=20, upper=99)


def test_awkward_rows(spark):
    rows = vectors(60, dim=3)
    rows += [(100, None, [1.0, 1.0]), (110, 1, None), (120, 1, [0.5, None]), (130, 1, [0.5, math.nan]), (140, 1, [math.inf]), (None, 1, [1.0])]
    rows += [(150, 1, []), (160, 2, [0.5]), (170, 3, [0.5] * 9), (0, 1, [0.2, 0.3, 0.4]), (180, 9, [0.3, 0.3, 0.3])]
    rows += [(200 + i, i % 2, [0.25, 0.5, 0.75]) for i in range(40)] + [(201, 1, [0.25, 0.5, 0.75])] * 3
    check(spark, rows)


@pytest.mark.parametrize("scale", [1e3, 1e7, 1e300])
def test_large_components(spark, scale):
    rows = [(i, label, [x * scale for x in v]) for i, label, v in vectors(40, dim=3)]
    check(spark, rows)


def test_none(spark):
    check(spark, [])
    check(spark, [(10, 1, [1.0])])
    check(spark, [(10, 1, [1.0]), (11, 1, [1.0])])
    check(spark, [(11, 1, [1.0]), (12, 2, [1.0])])
