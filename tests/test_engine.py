"""Goldens derived by hand from the rules, and properties of whole plans."""

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from hunkmill import schemas
from hunkmill.functions import scalars as S
from hunkmill.operators import catalog, deps, extract, graph, grouping, kernels, quality, splitting
from hunkmill.plans import engine
from hunkmill.sources import catalog as scans
from hunkmill.sources import diffs, sinks, versions
from hunkmill.streaming import diff_stream

SIMPLE = """diff --git a/test.py b/test.py
--- a/test.py
+++ b/test.py
@@ -1,5 +1,8 @@
-def hello():
-    pass
-
+def greet(name):
+    print(name)
+
+def main():
+    greet("x")
+
 # end
 # file
"""

MIXED = """diff --git a/b/backend/b.py b/b/backend/b.py
index 111..222 100644
--- a/b/backend/b.py
+++ b/b/backend/b.py
@@ -3 +3 @@ def f():
--- old comment
+++ new comment
diff --git a/a/api/x.go b/a/api/x.go
deleted file mode 100644
--- a/a/api/x.go
+++ /dev/null
@@ -1,2 +0,0 @@
-package api
-var x = 1
diff --git a/pkg/new.go b/pkg/new.go
new file mode 100644
--- /dev/null
+++ b/pkg/new.go
@@ -0,0 +1,5 @@
+import (
+    "fmt"
+    store "example.com/kv/store"
+)
+func Run() { fmt.Println(store.Open("x")) }
"""


def texts(spark, *values):
    return spark.createDataFrame([(f"s{i}", v) for i, v in enumerate(values)], "split_id string, value string")


def test_parse_simple(spark):
    rows = diffs.parse_diffs(texts(spark, SIMPLE)).collect()
    assert [(r.change_id, r.type, r.line_start, r.line_end, r.added_lines, r.deleted_lines, r.language) for r in rows] == [("test.py:hunk_0", "modify", 1, 9, 6, 3, "python")]
    found = {(r.name, r.type, r.role) for r in extract.hunk_symbols(diffs.parse_diffs(texts(spark, SIMPLE))).collect()}
    assert found == {("greet", "function", "definition"), ("main", "function", "definition")}


def test_parse_paths_lengths_and_deletions(spark):
    changes = diffs.parse_diffs(texts(spark, MIXED))
    rows = changes.orderBy("change_ord").collect()
    assert [(r.change_id, r.type, r.added_lines, r.deleted_lines, r.line_start, r.line_end) for r in rows] == [
        ("b/backend/b.py:hunk_0", "modify", 1, 1, 3, 4), ("a/api/x.go:hunk_0", "delete", 0, 2, 0, 0), ("pkg/new.go:hunk_0", "add", 5, 0, 1, 6),
    ]
    assert rows[0].content == "@@ -3,1 +3,1 @@ def f():\n--- old comment\n+++ new comment"
    known = {(r.alias, r.path) for r in extract.imports(extract.added_lines(changes)).collect()}
    assert known == {("fmt", "fmt"), ("store", "example.com/kv/store")}
    used = {(r.qualified_name, r.type) for r in extract.hunk_symbols(changes).filter("role = 'usage' and name <> 'import'").collect()}
    assert used == {("fmt.Println", "type"), ("fmt.Println", "function"), ("store.Open", "type"), ("store.Open", "function")}
    stats = diffs.stats(changes).first()
    assert (stats.additions, stats.deletions, stats.n_files) == (6, 3, 3)
    assert [r.file_name for r in diffs.file_sections(texts(spark, MIXED)).orderBy("file_no").collect()] == ["b/backend/b.py", "a/api/x.go", "pkg/new.go"]
    assert diffs.filter_paths(changes, "pkg", True).first().file == "new.go"


@pytest.mark.parametrize(("language", "code", "defined", "used"), [
    ("go", ['type T struct', 'func (t *T) Do(x int) {', 'type I interface'], {("T", "type"), ("Do", "method"), ("I", "interface")}, set()),
    ("python", ["x.y()", "import a.b", "from m import x as y, z", "b.run(x.go)", "class K:"], {("K", "class")}, {("b.run", "function"), ("x.go", "function")}),
    ("typescript", ["import { A as B } from 'm'", "import * as N from 'n'", "export const f = async (a) => 1", "interface P {", "B.make(N.Thing)"], {("f", "function"), ("P", "interface")}, {("B.make", "function"), ("N.Thing", "class")}),
    ("java", ["import a.b.Foo;", "public class Bar {", "  public int size(int x) {", "    if (x) Foo.run(1);"], {("Bar", "class"), ("size", "method")}, {("a.b.Foo", "class"), ("Foo.run", "function")}),
    ("rust", ["fn go() {", "trait Q {"], {("go", "function"), ("Q", "interface")}, set()),
])
def test_patterns(spark, language, code, defined, used):
    ext = {"go": "go", "python": "py", "typescript": "ts", "java": "java", "rust": "rs"}[language]
    text = f"diff --git a/d/f.{ext} b/d/f.{ext}\n--- a/d/f.{ext}\n+++ b/d/f.{ext}\n@@ -0,0 +1,{len(code)} @@\n" + "\n".join("+" + c for c in code) + "\n"
    rows = extract.hunk_symbols(diffs.parse_diffs(texts(spark, text))).collect()
    assert {(r.name, r.type) for r in rows if r.role == "definition"} == defined
    assert {(r.qualified_name, r.type) for r in rows if r.role == "usage" and r.name != "import"} == used


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def changes_of(spark, rows):
    """rows: (split, ord, file, type, added[, line_start])."""
    seen, out = {}, []
    for split, n, file, kind, added, *start in rows:
        k = seen[(split, file)] = seen.get((split, file), -1) + 1
        first = start[0] if start else n * 10
        out.append((split, n, f"{file}:hunk_{k}", file, k, kind, first, first + added, "", added, 0, "python"))
    return frame(spark, schemas.CHANGES, out)


def test_resolution_levels_and_strength(spark):
    changes = changes_of(spark, [("s", 0, "a/x.py", "add", 1), ("s", 1, "b/y.py", "add", 1), ("s", 2, "c/z.py", "modify", 1)])
    ids = ["a/x.py:hunk_0", "b/y.py:hunk_0", "c/z.py:hunk_0"]
    row = lambda i, n, name, kind, role, package=None, qualified=None: ("s", i, ids[i], n, name, kind, ids[i].split(":")[0], 1, role, package, qualified, None)
    schema = schemas.SYMBOLS.replace("split_id string, change_id string", "split_id string, change_ord int, change_id string")
    symbols = frame(spark, schema, [
        row(0, 0, "f", "function", "definition", "a"), row(0, 1, "m", "method", "definition", "a"), row(1, 0, "f", "function", "usage", "a", "a.f"), row(2, 0, "m", "method", "usage", "q", "q.m"), row(2, 1, "nothing", "function", "usage", "q", "q.nothing"),
    ])
    imports = frame(spark, schemas.IMPORTS, [("s", ids[2], "b", "b"), ("s", ids[2], "b2", "b")])
    rows = deps.dependencies(changes, symbols, imports).orderBy("dep_ord").collect()
    assert [(r.source, r.target, r.type, r.strength) for r in rows] == [(ids[1], ids[0], "defines_uses", 0.8), (ids[2], ids[0], "defines_uses", 1.0), (ids[2], ids[1], "import", 1.0)]


def test_kernels():
    assert kernels.components(["a", "b", "c"], [("a", "b"), ("b", "a"), ("b", "c")]) == [["a", "b"]]
    assert kernels.prerequisite_order(["x", "y"], [("y", "x")]) == (["x", "y"], [])
    order, cut = kernels.prerequisite_order([0, 1, 2], [(0, 1), (1, 2), (2, 0)])
    assert len(cut) == 1 and sorted(order) == [0, 1, 2]
    assert kernels.longest_chain({0: [], 1: [0], 2: [1], 3: [0]}) == 3 and kernels.longest_chain({}) == 0
    assert list(kernels.critical_paths(list("abcd"), [("a", "b"), ("b", "c"), ("a", "d")])) == [["a", "b", "c"]]
    assert kernels.keep_uncovered([("g", 0.9, ["a", "b"]), ("h", 0.8, ["b", "c"]), ("i", 0.7, ["c", "d", "b"])]) == [0, 2]
    assert kernels.symbol_clusters({"a": {"x", "y", "z"}, "b": {"x", "p", "q"}, "c": {"x", "y", "q"}}) == [["a", "c"]]
    layers = {"1": "interface", "2": "impl", "3": "impl", "4": "impl"}
    files = {"1": "m/a", "2": "p/a", "3": "q/a", "4": "r/a"}
    assert kernels.pack_layers(list("1234"), files, {"1": 5, "2": 10, "3": 100, "4": 20}, layers, 200) == [["1"], ["2"], ["3"], ["4"]]
    # All interfaces are one candidate, whatever their directories and size; controllers come last.
    two = {"1": "a/models/x.py", "2": "b/models/y.py", "3": "a/api/z.py", "4": "a/core/w.py", "5": "b/core/v.py", "6": "c/core/u.py"}
    kinds = dict(zip("123456", ("interface", "interface", "controller", "impl", "impl", "impl"), strict=True))
    assert kernels.pack_layers(list("312456"), two, dict.fromkeys("123", 150) | {"4": 40, "5": 120, "6": 30}, kinds, 200) == [["1", "2"], ["4"], ["5"], ["6"], ["3"]]
    assert kernels.pack_layers(list("456"), two, {"4": 99, "5": 99, "6": 99}, kinds, 200) == [["4", "5", "6"]]
    assert kernels.pack_layers(list("456"), two, {"4": 19, "5": 14, "6": 19}, kinds, 30) == [["4"], ["5"], ["6"]]
    assert kernels.merge_candidates([["a"], ["b"], ["c"]], {"a": 500, "b": 500, "c": 1}, {"a": 0, "b": 0}, set(), {}, 10) == [["a", "b"], ["c"]]


def test_kernels_agree_with_relations(spark):
    rng = random.Random(1)
    rows = []
    for s in range(12):
        n = rng.randint(2, 13)
        rows += [(f"s{s}", i, f"{a}", f"{b}", "defines_uses", 1.0, "") for i, (a, b) in enumerate({(rng.randrange(n), rng.randrange(n)) for _ in range(n + 3)}) if a != b]
    edges = frame(spark, schemas.DEPS, rows)
    twin = {(r.split_id, r.source, r.target) for r in graph.reach_by_joins(edges).collect()}
    assert {(r.split_id, r.source, r.target) for r in graph.reach(edges).collect()} == twin
    rings = {(r.split_id, r.change_id, r.scc) for r in graph.cycles(edges).collect()}
    want = {}
    for s, a, b in twin:
        if a != b and (s, b, a) in twin:
            want[(s, a)] = min(want.get((s, a), a), b)
    assert rings == {(s, a, m) for (s, a), m in want.items()}


def test_large_cycle_shows_parts_but_stays_whole(spark):
    rows = [("s", 0, "a/x.py", "modify", 300), ("s", 1, "b/y.py", "modify", 300), ("s", 2, "b/z.py", "modify", 300)]
    changes = changes_of(spark, rows)
    ids = [r.change_id for r in changes.orderBy("change_ord").collect()]
    edges = frame(spark, schemas.DEPS, [("s", i, ids[i], ids[(i + 1) % 3], "defines_uses", 1.0, "") for i in range(3)])
    rings = graph.cycles(edges)
    groups = graph.atomic_groups(rings, graph.cycles(edges, 1.0), changes).orderBy("group_ord").collect()
    assert [g.group_id for g in groups] == ["scc_0_a", "scc_0_b", "strong_0_a", "strong_0_b"]
    none = spark.createDataFrame([], schemas.SYMBOLS.replace("change_id", "change_ord int, change_id", 1))
    p = engine.plan(changes, none, edges)
    assert [len(r.changes) for r in p.patches.collect()] == [3]
    assert p.patches.first().warnings == ["Large patch: 900 lines"]


def test_plan_of_example(spark):
    p = engine.split(texts(spark, SIMPLE, MIXED))
    row = {r.split_id: r for r in p.metrics.collect()}["s0"]
    assert (row.num_patches, row.total_lines, row.balance_score, row.max_dependency_depth) == (1, 9, 1.0, 1)
    assert row.reviewability_score == pytest.approx(0.65)
    told = {r.split_id: r.suggestions for r in p.suggestions.collect()}["s0"]
    assert told == ["1 patches are very small (<20 lines). Consider merging related patches."]
    assert quality.validate(p.patches, p.changes).count() == 0
    before = diffs.hunk_digests(p.changes)
    cats = splitting.categories(p.members, p.symbols)
    written = sinks.patch_texts(p.patches, p.changes, cats, "20260101")
    head = written.filter("split_id = 's0'").first().text.split("\n")[:7]
    assert head == ["# Update test.py: greet, main", "# Category: feature", "# Priority: 1", "# Generated: 20260101", "# Files: test.py", "# Description: no_llm_1 modifications", ""]
    each = written.select(F.concat_ws("#", "split_id", "patch_id").alias("split_id"), F.col("text").alias("value"))
    after = diffs.hunk_digests(diffs.parse_diffs(each)).withColumn("split_id", F.element_at(F.split("split_id", "#"), 1))
    found = quality.reconcile(before, after).collect()
    assert all(r.input_only == r.output_only == 0 for r in found) and sum(r.common for r in found) == 4
    assert json.loads(sinks.metadata(p.patches, cats, 5).filter("split_id = 's0'").first().json)["total_patches"] == 1
    assert "## " in sinks.markdown(p.patches, cats).first().text and "git apply" in sinks.apply_script(p.patches).first().text
    assert sinks.comment(p.patches).first().text.startswith("| # |")
    assert {r.description for r in sinks.annotations(p.patches, p.changes, p.symbols).filter("split_id = 's0'").collect()} == {"Modifies greet, main in test.py"}


def test_plans_hold_their_properties_whatever_the_order(spark):
    rng = random.Random(5)
    rows, links = [], []
    for s in range(8):
        n = rng.randint(1, 14)
        own = [(f"s{s}", i, f"{rng.choice(['models', 'utils', 'api', 'core'])}/f{rng.randrange(4)}.py", rng.choice(["add", "add", "modify", "delete"]), rng.randint(1, 150)) for i in range(n)]
        rows += own
    changes = changes_of(spark, rows)
    ids = {}
    for r in changes.collect():
        ids.setdefault(r.split_id, []).append(r.change_id)
    for s, own in ids.items():
        links += [(s, i, a, b, "defines_uses", rng.choice([0.8, 1.0]), "") for i, (a, b) in enumerate({(rng.choice(own), rng.choice(own)) for _ in own}) if a != b]
    edges = frame(spark, schemas.DEPS, links)
    none = spark.createDataFrame([], schemas.SYMBOLS.replace("change_id", "change_ord int, change_id", 1))

    def run(c, e):
        return sorted((r.split_id, r.patch_id, tuple(r.changes), tuple(r.depends_on)) for r in engine.plan(c, none, e).patches.collect())

    first = run(changes, edges)
    assert first == run(changes.repartition(7), edges.repartition(3))
    assert sorted(c for _, _, own, _ in first for c in own) == sorted(c for own in ids.values() for c in own)
    assert all(d < p for _, p, _, needs in first for d in needs)
    home = {(s, c): p for s, p, own, _ in first for c in own}
    for r in graph.cycles(edges).collect():
        assert home[(r.split_id, r.change_id)] == home[(r.split_id, r.scc)]


def test_scores_at_their_edges(spark):
    sizes = [0, 9, 10, 49, 50, 200, 201, 500, 501]
    rows = spark.createDataFrame([(s,) for s in sizes], "s int").select("s", S.size_score(F.col("s")).alias("v")).orderBy("s").collect()
    want = [0, 0.3, 0.3, 0.3 + 39 / 40 * 0.7, 1, 1, 1 - 0.7 / 300, 0.3, 0.1]
    assert [r.v for r in rows] == pytest.approx(want)


def test_validation_finds_each_problem(spark):
    changes = changes_of(spark, [("s", 0, "a.py", "add", 1), ("s", 1, "b.py", "add", 1)])
    patches = frame(spark, "split_id string, patch_id int, changes array<string>, depends_on array<int>", [("s", 0, ["a.py:hunk_0"], [0]), ("s", 1, ["a.py:hunk_0"], [0])])
    assert {(r.problem, r.what) for r in quality.validate(patches, changes).collect()} == {("missing change", "b.py:hunk_0"), ("repeated change", "a.py:hunk_0"), ("depends on later", "0")}


def test_resplit_moves_ids_and_dependencies(spark):
    schema = "split_id string, patch_id int, depends_on array<int>"
    patches = frame(spark, schema, [("s", 0, []), ("s", 1, [0]), ("s", 2, [1]), ("s", 3, [0, 2])])
    parts = frame(spark, schema, [("s", 0, []), ("s", 1, [0])])
    out = {r.patch_id: list(r.depends_on) for r in splitting.resplit(patches, 1, parts).collect()}
    assert out == {0: [], 1: [0], 2: [0, 1], 3: [2], 4: [0, 3]}


def test_listing_rules(spark):
    rows = frame(spark, "number int, title string, author string, state string", [(12, "Fix", "Ann", None), (3, "Add X", "bob", "deleted"), (7, "x", "Cy", "open")])
    assert {r.number for r in catalog.active(rows).collect()} == {12, 7}
    assert {r.number for r in catalog.search(rows, "X").collect()} == {12, 3, 7} and {r.number for r in catalog.search(rows, "1").collect()} == {12}
    for limit, more in ((3, False), (2, True)):
        got = catalog.page(rows, [F.col("number")], 0, limit).collect()
        assert len(got) == limit and all(r.has_more == more for r in got)
    log = scans.commit_log(frame(spark, "value string", [("a|b|c|d|e|f|msg | with bar",)])).first()
    assert log.message == "msg | with bar"
    states = {(r.file, r.state) for r in scans.status(frame(spark, "value string", [("MM a.py",), ("?? b.py",), (" D c.py",)])).collect()}
    assert states == {("a.py", "staged"), ("a.py", "unstaged"), ("b.py", "untracked"), ("c.py", "unstaged")}
    remote = scans.remotes(frame(spark, "pos int, value string", [(0, "origin\tgit@github.com:o/r.git (fetch)"), (1, "up\thttps://github.com/o/r (push)")])).collect()
    assert [(r.owner, r.repo, r.name) for r in remote] == [("o", "r", "origin")]
    text = frame(spark, "t string", [('{"a": 1}',), ('so ```json\n{"b": 2}\n``` end',), ('x {"c": 3} y',), ("none",)])
    assert [r.j for r in text.select(S.json_of(F.col("t")).alias("j")).collect()] == ['{"a": 1}', '{"b": 2}', '{"c": 3}', None]


def test_metadata_scan_skips_broken_files(spark, tmp_path):
    for name, body in (("one/metadata_1.json", '{"total_patches": 2, "patches": [{"id": 1, "state": null}]}'), ("one/metadata_2.json", '{"total_patches": 9}'), ("two/metadata_1.json", "{broken")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    assert [(r.split_id, r.total_patches) for r in scans.split_metadata(spark, str(tmp_path)).collect()] == [("one", 2)]


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.diff").write_text(SIMPLE)
    for _ in range(2):
        diff_stream.start(diff_stream.read(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        (tmp_path / "in/b.diff").write_text(MIXED)
    assert diff_stream.latest(spark, str(tmp_path / "out")).count() == 2


def test_patch_files_on_disk(spark, tmp_path):
    assert diffs.scan_patches(spark, str(tmp_path)).count() == 0 if any(tmp_path.iterdir()) else True
    p = engine.split(texts(spark, MIXED))
    sinks.write_patches(sinks.patch_texts(p.patches, p.changes, splitting.categories(p.members, p.symbols), "now"), str(tmp_path / "out"))
    back = diffs.scan_patches(spark, str(tmp_path / "out"))
    assert back.count() == p.patches.count()


def test_groups(spark):
    changes = changes_of(spark, [("s", 0, "a/x.py", "add", 5, 1), ("s", 1, "a/x.py", "add", 5, 30), ("s", 2, "b/y.py", "delete", 5, 1)])
    rows = {r.key: r for r in grouping.by_file(changes).collect()}
    assert rows["a/x.py"].score == pytest.approx(1 - 24 / 100) and rows["a/x.py"].idx == 0
    assert {r.key: r.score for r in grouping.by_directory(changes).collect()} == {"a": 0.85, "b": 0.7}
    symbols = frame(spark, "split_id string, change_ord int, change_id string, sym_ord int, name string, type string", [("s", 0, "a/x.py:hunk_0", 0, "f", "function"), ("s", 0, "a/x.py:hunk_0", 1, "f", "function"), ("s", 1, "a/x.py:hunk_1", 0, "f", "class")])
    rename = grouping.renames(symbols).first()
    assert (rename.n, rename.change_ids) == (3, ["a/x.py:hunk_0", "a/x.py:hunk_1"])


def test_diffs_at_hand_and_of_a_repository(spark, tmp_path):
    assert diffs.from_text(spark, " \n").count() == 0
    assert [r.change_id for r in diffs.parse_diffs(diffs.from_text(spark, SIMPLE)).collect()] == ["test.py:hunk_0"]
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    for text, name in (("one\n", "first"), ("one\ntwo\n", "second")):
        (tmp_path / "f.py").write_text(text)
        git("add", "f.py")
        git("commit", "-q", "-m", name)
    found = diffs.parse_diffs(diffs.between(spark, str(tmp_path), "main~1", "main")).collect()
    assert [(r.change_id, r.type, r.added_lines) for r in found] == [("f.py:hunk_0", "add", 1)]
    (tmp_path / "f.py").write_text("three\n")
    assert diffs.parse_diffs(diffs.between(spark, str(tmp_path), "HEAD")).first().deleted_lines == 2
    assert diffs.between(spark, str(tmp_path), "main", "main").count() == 0
    with pytest.raises(ValueError, match="no diff"):
        diffs.between(spark, str(tmp_path), "main", "nowhere")


def test_scans_of_stored_results(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
        return str((tmp_path / name).parent)

    at = put("reviews/a.json", {"title": "T", "archived": True, "issues": [{"file": "f"}], "created_at": "2026-01-02T03:04:05Z"})
    put("reviews/b.json", "{broken")
    put("reviews/c.json", {"id": "own", "status": "failed"})
    got = {r.id: (r.title, r.status, r.n_issues) for r in scans.reviews(spark, at).collect()}
    assert got == {"a": ("T", "archived", 1), "own": ("c", "failed", 0)}
    at = put("pulls/p.json", [{"number": 4, "title": "x"}, {"number": 5, "owner": "o"}])
    assert {(r.number, r.title, r.author, r.state) for r in scans.pull_rows(scans.pulls(spark, at)).collect()} == {(4, "x", "unknown", "open"), (5, "", "unknown", "open")}
    for name, value in (("c.json", {"source": {"repositories": [{"name": "r", "path": "/p"}]}}), ("d.json", {"repositories": [{"name": "r", "path": "/p"}]})):
        config = scans.read_config(f"{put(name, value)}/{name}")
        rows = scans.repository_rows(scans.configured_repositories(spark, config)).collect()
        assert [(r.name, r.path, r.description) for r in rows] == [("r", "/p", "")]
    at = put("bundle/b.json", {"commits": [{"id": "c1", "message": "m", "metadata": {"goal_summary": "g", "patches": [{"id": 1, "state": "deleted"}, {"id": 2}]}}, {"id": "c2"}], "patches": {"c1/00_a.patch": "text", "x/y/01_b.patch": "more"}})
    commits, patches = scans.bundle(spark, at)
    assert {(r.id, r.message, r.goal, r.patches) for r in scans.commit_rows(commits).collect()} == {("c1", "m", "g", 1), ("c2", "", "", 0)}
    assert {(r.commit_id, r.filename, r.content) for r in patches.collect()} == {("c1", "00_a.patch", "text"), ("x/y", "01_b.patch", "more")}


def test_configuration_in_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("source:\n  repositories:\n    - name: r\n      path: /p\n")
    assert scans.read_config(str(tmp_path / "c.yaml"))["source"]["repositories"] == [{"name": "r", "path": "/p"}]


def test_snapshots_are_replaced_by_repository(spark, tmp_path):
    rows = frame(spark, "repo string, branch string, sha string, at int", [("a", "m", f"s{i}", i) for i in range(60)] + [("b", "m", "t", 1)])
    assert scans.snapshot(rows, str(tmp_path / "all")).groupBy("repo").count().orderBy("repo").collect()[0]["count"] == 50
    for repo in ("a", "b", "a"):
        scans.write_progress(rows, str(tmp_path / "parts"), repo)
    assert versions.read(spark, str(tmp_path / "parts")).count() == 61


def test_a_stored_split_is_rewritten_alone(spark, tmp_path):
    schema = "split_id string, patch_id int, name string, depends_on array<int>"
    every = frame(spark, schema, [("s", 0, "zero", []), ("s", 1, "one", [0]), ("t", 0, "other", [])])
    path = str(tmp_path / "patches")
    every.withColumn("filename", sinks.patch_name()).write.partitionBy("split_id").parquet(path)
    stored = spark.read.parquet(path)
    own = stored.filter("split_id = 's'").select("split_id", "patch_id", "name", "depends_on")
    own = spark.createDataFrame(own.collect(), own.schema)
    parts = frame(spark, schema, [("s", 0, "half", []), ("s", 1, "rest", [0])])
    sinks.write_resplit(own, 0, parts, path)
    got = {(r.split_id, r.patch_id, r.filename, tuple(r.depends_on)) for r in spark.read.parquet(path).collect()}
    assert got == {("s", 0, "00_half.patch", ()), ("s", 1, "01_rest.patch", (0,)), ("s", 2, "02_one.patch", (1,)), ("t", 0, "00_other.patch", ())}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static").lower() == "static"


def test_extension_points(spark):
    """A language, a grouper, suggested groups and a summarizer, each off again afterwards."""
    extract.register_language("lua", [(r"^\s*function\s+([a-z]+)", "function")])
    lines = frame(spark, "split_id string, change_ord int, change_id string, file string, language string, row int, line int, code string", [("s", 0, "c", "f.lua", "lua", 0, 1, "function go()")])
    assert [r.name for r in extract.definitions(lines).collect()] == ["go"]
    del extract.DEFINITIONS["lua"], extract.USAGES["lua"]
    changes = changes_of(spark, [("s", i, f"{d}/f.py", "modify", 10) for i, d in enumerate(("a/models", "b/utils", "c/api", "d/core"))])
    none = spark.createDataFrame([], schemas.SYMBOLS.replace("change_id", "change_ord int, change_id", 1))
    edges = frame(spark, schemas.DEPS, [])
    ids = [r.change_id for r in changes.orderBy("change_ord").collect()]
    # Four layers, so no group in common; three suggested groups, which may overlap, bring two changes together.
    assert engine.plan(changes, none, edges).patches.count() == 4
    more = frame(spark, "split_id string, group_id string, change_ids array<string>", [("s", f"llm_{i}", ids[:2]) for i in range(3)])
    assert sorted(len(r.changes) for r in engine.plan(changes, none, edges, suggested=more).patches.collect()) == [1, 1, 2]
    pair = lambda c, s: c.groupBy("split_id").agg(F.lit("own").alias("key"), F.min("change_ord").alias("first"), F.array(*map(F.lit, ids[2:])).alias("change_ids")).withColumn("score", F.lit(0.99))
    splitting.register_grouper(pair)
    try:
        kept = engine.plan(changes, none, edges).groups.collect()
    finally:
        splitting.GROUPERS.pop()
    assert "own0_0" in {r.group_id for r in kept}


def test_the_mark_of_a_missing_newline_stays(spark):
    text = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n-a\n\\ No newline at end of file\n+b\n\\ No newline at end of file\n"
    row = diffs.parse_diffs(texts(spark, text)).first()
    assert row.content.split("\n")[1:] == ["-a", "\\ No newline at end of file", "+b", "\\ No newline at end of file"] and (row.added_lines, row.deleted_lines) == (1, 1)


def test_hunks_are_cut_by_the_rules_of_body_lines(spark):
    """hunks_of() against the line by line form, on random texts of the lines that matter."""
    import random

    rng = random.Random(5)
    kinds = ["@@ -1,2 +1,3 @@", "@@ -1 +1 @@ def f", "@@ -0,0 +1 @@", "@@ -3,0 +4,0 @@", "@@ x", "--- a/x", "+++ b/y\tnow", "+++ /dev/null", "--- a", "-- x", "++ y", "+", "-", " ", "", "+a", "-b", " c\r", "\\ No newline", "diff --git a/x b/y"]
    texts_of = ["", "\n", "\n\n", "@@ -1 +1 @@\n+a\n\n", *["\n".join(rng.choice(kinds) for _ in range(rng.randrange(40))) for _ in range(300)]]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts_of)], "split_id string, value string")
    cut = diffs.body_lines(diffs.lines(rows)).filter("hunk_no > 0").collect()
    want = {}
    for r in sorted(cut, key=lambda r: (r.split_id, r.pos)):
        if r.is_header:
            want[r.split_id, r.hunk_no] = [r.line, [], r.old_path, r.new_path]
        elif r.in_body:
            want[r.split_id, r.hunk_no][1].append(r.line)
    plain = rows.select("split_id", diffs._plain("value").alias("value")).collect()
    got = {(r.split_id, h[0]): [h[1], h[2], h[3], h[4]] for r in plain for h in diffs.hunks_of(r.value)}
    assert got == want and len(want) > 300
    rows = diffs.parse_diffs(rows).collect()
    assert len(rows) == len(want)
    for r in rows:
        body = want[r.split_id, r.change_ord + 1][1]
        assert r.content.split("\n")[1:] == body and (r.added_lines, r.deleted_lines) == (sum(x[:1] == "+" for x in body), sum(x[:1] == "-" for x in body))
