import random
import subprocess

import pytest

from hunkmill.operators import linediff
from hunkmill.sources import diffs, gitstore


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    rnd = random.Random(4)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b.c", "-c", "core.autocrlf=false", *a], check=True, capture_output=True).stdout
    git("init", "-q", "-b", "main")

    def put(name, text):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())

    lines = [f"line {i} {rnd.random()}" for i in range(400)]
    for i in range(30):
        put(f"pkg{i % 5}/sub{i % 3}/f{i}.py", "def f():\n" + "\n".join(lines[i:i + 120]) + "\n")
    put("top.txt", "a\nb\nc")
    put("same/untouched.txt", "same\n")
    put("bin.dat", b"\0\1\2")
    put("with space.txt", "x\n")
    put("é/ü.txt", "ü\n")
    put("foo/x", "1\n")
    put("foo.txt", "2\n")
    git("add", "-A")
    git("commit", "-q", "-m", "one")
    git("tag", "v1")
    for i in range(0, 30, 2):
        rows = (root / f"pkg{i % 5}/sub{i % 3}/f{i}.py").read_text().splitlines()
        for _ in range(6):
            at = rnd.randrange(1, len(rows))
            rows[at:at + rnd.randrange(3)] = [f"new {rnd.random()}" for _ in range(rnd.randrange(3))]
        put(f"pkg{i % 5}/sub{i % 3}/f{i}.py", "\n".join(rows) + "\n")
    (root / "pkg1/sub1/f1.py").unlink()
    put("top.txt", "a\nB\nc\n")
    put("bin.dat", b"\0\1\3")
    put("with space.txt", "y\n")
    put("é/ü.txt", "ö\n")
    put("foo/x", "3\n")
    put("foo.txt", "4\n")
    put("new/deep/er/file.go", "package x\n")
    put("empty", "")
    (root / "same/untouched.txt").chmod(0o755)
    (root / "link").symlink_to("top.txt")
    git("add", "-A")
    git("commit", "-q", "-m", "two")
    git("gc", "-q")  # both commits in a pack, with deltas
    git("branch", "side", "v1")
    (root / "link").unlink()
    put("link", "no link\n")
    put("loose.txt", "loose\n")
    git("add", "-A")
    git("commit", "-q", "-m", "three")
    return root, git


PAIRS = [("a", "v1", "main~1"), ("b", "main~1", "main"), ("c", "v1", "main"), ("d", "main", "side"), ("e", "v1", "side")]


def test_diffs_of_many_pairs_are_those_of_plain_git(spark, repository, tmp_path):
    root, git = repository
    store, names = gitstore.objects(spark, f"{root}/.git", per_task=10), gitstore.refs(spark, f"{root}/.git")
    assert store.rdd.getNumPartitions() > 5
    pairs = [(s, git("rev-parse", a).decode().strip() if "~" in a else a, git("rev-parse", b).decode().strip() if "~" in b else b) for s, a, b in PAIRS]
    rows = spark.createDataFrame([*pairs, ("none", "v1", "nowhere")], "split_id string, base string, head string")
    got = {r.split_id: r.value for r in gitstore.ref_diffs(store, names, rows, str(tmp_path)).collect()}
    assert set(got) == {"a", "b", "c", "d"}  # v1 and side are the same, nowhere is unknown
    for s, a, b in PAIRS[:4]:
        want = git("diff", "--no-renames", "--full-index", "--no-indent-heuristic", a, b).decode()
        assert got[s] == want
    parsed = diffs.parse_diffs(spark.createDataFrame(list(got.items()), "split_id string, value string"))
    assert parsed.filter("split_id = 'b' and file = 'loose.txt'").first().added_lines == 1


def test_every_object_is_read(spark, repository):
    root, git = repository
    listed = [line.split() for line in git("cat-file", "--batch-all-objects", "--batch-check").decode().splitlines()]
    for per_task in (7, 10**6):
        got = sorted((r.oid, r.kind, r["size"]) for r in gitstore.objects(spark, f"{root}/.git", per_task).select("oid", "kind", "size").distinct().collect())
        assert got == sorted((oid, kind, int(size)) for oid, kind, size in listed)


def test_refs(spark, repository):
    root, git = repository
    got = {r.ref: r.oid for r in gitstore.refs(spark, f"{root}/.git").collect()}
    for name in ("main", "refs/heads/side", "v1", "HEAD"):
        assert got[name] == git("rev-parse", name).decode().strip()


def test_an_empty_store(spark, tmp_path):
    (tmp_path / "objects").mkdir()
    (tmp_path / "HEAD").write_text("ref: refs/heads/main\n")
    store, names = gitstore.objects(spark, str(tmp_path)), gitstore.refs(spark, str(tmp_path))
    pairs = spark.createDataFrame([("s", "a", "b")], "split_id string, base string, head string")
    assert store.count() == 0 and gitstore.ref_diffs(store, names, pairs, f"{tmp_path}/w").count() == 0


def apply(old, diff):
    """A hunk text applied to its old version."""
    source, out, at = linediff._lines(old), [], 0
    for line in linediff._lines(diff):
        if line.startswith(b"@@"):
            start = int(line.split(b" ")[1][1:].split(b",")[0])
            length = line.split(b" ")[1].split(b",")[1:] or [b"1"]
            to = start - (length != [b"0"])
            out, at = out + source[at:to], to
        elif line.startswith(b"\\"):
            if kept:
                out[-1] = out[-1][:-1]
        else:
            kept = line[:1] in b" +"
            out += [line[1:]] if kept else []
            at += line[:1] in b" -"
    return b"".join(out + source[at:])


def test_any_two_versions_give_a_diff_that_applies(monkeypatch):
    rnd = random.Random(9)
    for most in (256, 2):
        monkeypatch.setattr(linediff, "MOST_STEPS", most)
        for _ in range(400):
            old, new = ([b"%d" % rnd.randrange(rnd.choice([2, 5, 50])) for _ in range(rnd.randint(0, 40))] for _ in range(2))
            a, b = (b"\n".join(v) + rnd.choice([b"\n", b""]) if v else b"" for v in (old, new))
            assert apply(a, linediff.hunks(a, b)) == b
            gone, come = linediff.marks(old, new)
            assert [x for x, g in zip(old, gone, strict=True) if not g] == [y for y, c in zip(new, come, strict=True) if not c]


def test_packs_are_those_of_git(spark, tmp_path):
    objects = [("blob", b""), ("blob", b"x" * 15), ("blob", b"y" * 16), ("blob", bytes(range(256)) * 900), ("blob", b"x" * 15), *[("blob", b"%d\n" % i) for i in range(300)]]
    name, pack, index = gitstore.pack(objects)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    folder = tmp_path / ".git/objects/pack"
    (folder / f"pack-{name}.pack").write_bytes(pack)
    made = subprocess.run(["git", "index-pack", str(folder / f"pack-{name}.pack")], check=True, capture_output=True, text=True).stdout
    assert name in made and (folder / f"pack-{name}.idx").read_bytes() == index
    got = sorted((r.kind, bytes(r.data)) for r in gitstore.objects(spark, str(tmp_path / ".git"), 100).collect())
    assert got == sorted(set(objects))


def test_objects_are_read_once(spark, repository, tmp_path):
    folder = f"{repository[0]}/.git"
    pairs = spark.createDataFrame([("p", "v1", "main")], "split_id string, base string, head string")
    got = gitstore.ref_diffs(gitstore.objects(spark, folder), gitstore.refs(spark, folder), pairs, str(tmp_path))
    assert got.count() == 1
    assert "git_objects" not in got._jdf.queryExecution().executedPlan().toString()
