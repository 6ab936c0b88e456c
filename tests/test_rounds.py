import itertools
import random

import pytest

from hunkmill.operators import graph, grouping, kernels, rounds, splitting


@pytest.fixture(scope="module")
def few(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def graphs(seed, n_sets=3, nodes=14, edges=22):
    rnd = random.Random(seed)
    return [(f"s{s}", f"n{rnd.randrange(nodes):02d}", f"n{rnd.randrange(nodes):02d}", rnd.choice([0.8, 1.0])) for s in range(n_sets) for _ in range(edges)]


def tables(spark, rows, nodes=14):
    deps = spark.createDataFrame(rows, "split_id string, source string, target string, strength double")
    own = [(s, (i * 5) % nodes, f"n{i:02d}") for s in sorted({r[0] for r in rows}) for i in range(nodes)]
    return spark.createDataFrame(own, "split_id string, change_ord int, change_id string"), deps


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_cycles_by_rounds_are_those_of_the_kernel(spark, few, tmp_path):
    _, deps = tables(spark, graphs(2, n_sets=8, edges=20) + graphs(1, n_sets=2, edges=12) + [("s0", "n00", "n00", 1.0)])
    assert rows_of(rounds.cycles(deps, most=1, path=str(tmp_path))) == rows_of(graph.cycles(deps))
    deps = deps.filter("split_id in ('s1', 's2')")
    assert rows_of(rounds.cycles(deps, 1.0, most=5, path=str(tmp_path))) == rows_of(graph.cycles(deps, 1.0))


def test_levels_by_rounds_are_those_of_the_kernel(spark, few, tmp_path):
    nodes, deps = tables(spark, graphs(5, n_sets=2, edges=16))
    want = graph.levels(nodes, deps).select("split_id", "change_id", "level", "place")
    assert rows_of(rounds.levels(nodes, deps, most=1, path=str(tmp_path))) == rows_of(want)


def names(seed, changes=40, vocabulary=25, most=6, hot=0.5):
    rnd = random.Random(seed)
    return [("s", i, f"c{i:03d}", n) for i in range(changes) for n in {*(f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(1, most))), *(["hot"] if rnd.random() < hot else [])}]


def symbols(spark, rows):
    return spark.createDataFrame(rows, "split_id string, change_ord int, change_id string, name string")


@pytest.mark.parametrize("progress", [0.05, 2.0])
def test_clusters_by_rounds_are_those_of_the_kernel(spark, few, tmp_path, monkeypatch, progress):
    monkeypatch.setattr(rounds, "PROGRESS", progress)  # beyond 1 pairs are formed after the first round
    df = symbols(spark, names(7) + [("t", 0, "a", "x"), ("t", 1, "b", "x"), ("t", 2, "c", "y")])
    want = splitting.symbol_groups(df).select("split_id", "key", "first", "score", "change_ids")
    got = rounds.symbol_groups(df, most=3, path=str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_keys_meet_for_every_similar_pair(spark):
    """The keys' filter loses none: against all pairs."""
    df = symbols(spark, names(11, changes=60, vocabulary=30, most=8))
    sets = grouping.name_sets(df, 2).persist()
    keys = grouping.similar_keys(sets.withColumnRenamed("change_ord", "id"), 0.3)
    got = {(r.a, r.b) for r in keys.withColumnRenamed("id", "a").join(keys.withColumnRenamed("id", "b"), ["split_id", "key"]).filter("a < b").select("a", "b").distinct().collect()}
    own = {r.change_ord: set(r.names) for r in sets.collect()}
    similar = {(a, b) for a in own for b in own if a < b and len(own[a] & own[b]) / len(own[a] | own[b]) > 0.3}
    assert similar <= got and len(got) < len(own) * (len(own) - 1) / 2


def test_a_name_of_all_changes_costs_its_holders(spark, few, tmp_path):
    """20,000 changes share a name, each with one of its own beside: one seed takes all, and no square is formed."""
    df = spark.range(20_000).selectExpr("'s' AS split_id", "CAST(id AS INT) AS change_ord", "concat('c', id) AS change_id", "explode(array('hot', concat('w', id div 2))) AS name")
    got = rounds.symbol_groups(df, most=100, path=str(tmp_path)).collect()
    assert len(got) == 1 and got[0].key == "c0" and len(got[0].change_ids) == 20_000


def test_a_large_set_of_changes(spark, few, tmp_path):
    """200,000 changes in rings of four, with edges from ring to ring that close no cycle."""
    n = 200_000
    rings = spark.range(n).selectExpr("'s' AS split_id", "concat('n', id) AS source", "concat('n', CASE WHEN id % 4 = 3 THEN id - 3 ELSE id + 1 END) AS target", "1.0D AS strength")
    across = spark.range(n // 4 - 1).filter("id % 3 = 0").selectExpr("'s' AS split_id", "concat('n', id * 4) AS source", "concat('n', (id + 1) * 4 + 3) AS target", "1.0D AS strength")
    got = rounds.cycles(rings.unionByName(across), most=1000, path=str(tmp_path))
    assert got.groupBy("scc").count().selectExpr("count(*) AS n", "min(count) AS a", "max(count) AS b").first() == (n // 4, 4, 4)
    assert got.filter("cast(substring(change_id, 2) as int) div 4 <> cast(substring(scc, 2) as int) div 4").count() == 0


def test_nothing_to_do(spark, tmp_path):
    nodes, deps = tables(spark, [("s0", "n00", "n01", 1.0)])
    assert rounds.cycles(deps.limit(0)).count() == 0 and rounds.cycles(deps, most=0, path=str(tmp_path)).count() == 0
    assert kernels.symbol_clusters({}) == [] and rounds.levels(nodes, deps.limit(0)).count() == 14


def test_simple_cycles_are_all_and_in_order():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 6)
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(0, 14))]
        want = [list(c) for r in range(1, n + 1) for c in itertools.permutations(range(n), r) if c[0] == min(c) and all((c[i], c[(i + 1) % r]) in edges for i in range(r))]
        assert list(kernels.simple_cycles(list(range(n)), edges)) == sorted(want)


def test_order_without_cycles():
    assert kernels.order_without_cycles([0, 1, 2], [(0, 1), (1, 2)]) == ([2, 1, 0], [], False)
    assert kernels.order_without_cycles([0, 1, 2], [(0, 1), (1, 0), (1, 2)]) == ([2, 1, 0], [(1, 0)], False)
    order, cut, failed = kernels.order_without_cycles([0, 1, 2], [(0, 1), (1, 2), (0, 2), (2, 0)])  # two cycles end in 2 -> 0
    assert (order, failed) == ([0, 1, 2], True) and cut == [(2, 0)]
    many = [(a, b) for a in range(40) for b in range(40)]  # more cycles than can be listed; the second closes what is cut
    assert kernels.order_without_cycles(list(range(40)), many)[2]


def test_similar_pairs_are_those_of_all_pairs(spark):
    rows = names(13, changes=50, vocabulary=20)
    own = {c: {n for _, _, d, n in rows if d == c} for _, _, c, _ in rows}
    want = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for a in own for b in own if a < b}
    got = {(r.a, r.b): r.similarity for r in grouping.similar_pairs(symbols(spark, rows)).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v > 0.3}


def test_tables_of_past_rounds_are_deleted(spark, tmp_path):
    n = 5
    nodes = spark.createDataFrame([("s", i, f"c{i}") for i in range(n)] + [("alone", 0, "c0")], "split_id string, change_ord int, change_id string")
    chain = spark.createDataFrame([("s", f"c{i + 1}", f"c{i}") for i in range(n - 1)], "split_id string, source string, target string")
    got = rounds.levels(nodes, chain, most=0, path=str(tmp_path))
    assert rows_of(got) == rows_of(graph.levels(nodes, chain))
    # The edges, those that are left, the order, and what each round settled.
    assert len(list(tmp_path.glob("rounds-*/*/_SUCCESS"))) <= 3 + n - 1
