import random
import zlib

import numpy as np
import pytest

from hunkmill.llm import language_id, toxicity
from hunkmill.llm.queries import tokenizer_path

from .fixtures import awkward, docs

LABELS = "doc_id long, toxic int, text string"


def words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_forward_sums_all_segmentations():
    index = {"▁": 0, "▁a": 1, "a": 2, "ab": 3, "b": 4, "▁ab": 5, "ba": 6}
    rng = np.random.default_rng(0)
    prob = rng.random((len(index) + 1, 2)) / 10

    def brute(word, k):
        if not word:
            return 1.0
        total = sum(prob[i, k] * brute(word[len(p):], k) for p, i in index.items() if word.startswith(p))
        return total + (prob[-1, k] * brute(word[1:], k) if word[0] not in index else 0)

    some = ["▁abab", "▁bxa", "▁", "▁aaaa", "x", "▁ba"]
    lattice = language_id.Lattice(some, index)
    got = lattice.log_probability(prob)
    for i, w in enumerate(some):
        for k in range(2):
            assert got[i, k] == pytest.approx(np.log(brute(w, k)) - len(w) * np.log(language_id.SCALE))
    # A long word's sums are held for its last characters only, and scaled back as they go.
    model = {"index": index, "prob": prob, "reach": 3, "langs": ["a", "b"]}
    for word in ("ab" * 90, "abxba" * 40 + "q", "b" * 64, "a" * 63):
        whole = language_id.Lattice(["▁" + word], index).log_probability(prob)[0]
        assert language_id.long_word(word, model) == pytest.approx(whole, rel=1e-9)
        assert language_id.score_words(["ab", word, "x"], model)[1] == pytest.approx(whole, rel=1e-9)
    # Expected uses, weighted by length, add up to the characters of the words.
    use = lattice.expected(prob, np.ones((len(some), 2)))
    lengths = np.array([*map(len, index), 1])
    assert (use * lengths[:, None]).sum(0) == pytest.approx([sum(map(len, some))] * 2)


def test_language_of_held_out_documents(spark):
    rng = random.Random(4)
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ver"], "cc": ["qu", "eau", "ois"]}
    rows = [(i, words(rng, kinds[k], 30), k, "s") for i in range(150) for k in [rng.choice(list(kinds))]]
    truth = {i: k for i, _, k, _ in rows}
    rows += [(1000, None, "aa", "s"), (1001, "123 !!", "aa", "s"), (1002, "", None, None), (1003, "x" * 5000, None, "s"), (7, rows[7][1], "bb", "s"), (None, "kalomi", "aa", "s")]
    out = language_id.identify(docs(spark, rows), tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(out) == len(rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth]) > 0.95
    got = {r.doc_id: r for r in out}
    assert got[1000].lang_pred == got[1001].lang_pred == got[1002].lang_pred == "und" and got[1000].score == 0
    assert all(0 <= r.score <= 1 for r in out)
    assert language_id.identify(docs(spark, []), tokenizer_path("piece_bpe_32k.model")).count() == 0
    none = language_id.identify(docs(spark, [(1, "abc", None, None)]), tokenizer_path("piece_bpe_32k.model")).collect()
    assert none[0].lang_pred == "und"


def test_pooling_is_a_maximum_over_each_text():
    rng = np.random.default_rng(2)
    model = {"bias": rng.normal(0, 0.1, 24).astype(np.float32)}
    each = rng.normal(0, 1, (40, 48)).astype(np.float32)
    offsets = np.array([0, 0, 1, 3, 3, 20, 39, 40])
    out, arg = toxicity.pooled(each, offsets, model, want_arg=True)
    at = {1: [0], 2: [8, 16], 3: [24, 32, 40]}
    for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        for j, w in enumerate((1, 2, 3)):
            for f in range(8):
                values = [sum(each[i + k, at[w][k] + f] for k in range(w)) for i in range(a, b - w + 1)]
                want = max(0, max(values) + model["bias"][j * 8 + f]) if values else 0
                assert out[d, j * 8 + f] == pytest.approx(want, abs=1e-5)
                if values:
                    assert arg[d, j * 8 + f] == a + int(np.argmax(values))


def test_toxicity_of_held_out_documents(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        text = words(rng, ["ka", "lo", "mi", "ter", "un", "da"], 60).split()
        for _ in range(3 if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["grubbish", "Snotface,", "vileness"]))
        rows.append((i, " ".join(text), "en" if i % 3 else "de", "s"))
        labels.append((i, int(bad), "clash"))
    extra = [(2000, None, "en", "s"), (2001, "", "en", "s"), (2002, "grubbish " * 3000, None, None), (5, rows[5][1], "en", "s"), (None, "some text", "en", "s")]
    marks = spark.createDataFrame([*labels, (3000, 1, None), (7, None, None), (6, 1, None)], LABELS)
    df = docs(spark, rows + extra)
    out = toxicity.score(df, marks).collect()
    assert len(out) == len(rows) + len(extra)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    got = {r.doc_id: r for r in out}
    assert got[2000].predicted == got[2001].predicted == 0 and got[2002].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    kept = toxicity.drop_toxic(df, marks)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in out if not r.predicted)
    assert toxicity.score(docs(spark, []), marks).count() == 0
    assert toxicity.score(awkward(spark), marks.limit(0)).filter("score = 0").count() == awkward(spark).count()


def test_toxicity_does_not_depend_on_partitions(spark):
    """Ids with two texts each, dealt in several ways: the same model, so the same scores."""
    rng = random.Random(21)
    rows = []
    for i in range(300):
        for bad in (False, True):
            rows.append((i, words(rng, ["ka", "lo", "mi", "ter"], 20) + (" grubbish vileness" if bad and i % 2 else ""), "en", "s"))
    marks = spark.createDataFrame([(i, i % 2, None) for i in range(300)], LABELS)
    got = []
    for n in (1, 3, 7):
        out = toxicity.score(docs(spark, rows).repartition(n), marks).collect()
        got.append(sorted((r.doc_id, round(r.score, 9), r.predicted) for r in out))
    assert got[0] == got[1] == got[2]


def test_what_is_learned_from_is_bounded_in_bytes(spark):
    rows = [(i, "kalo miter " * (2000 if i % 2 else 3) + ("grubbish" if i % 4 == 0 else ""), "en", "s") for i in range(200)]
    marks = spark.createDataFrame([(i, int(i % 4 == 0), None) for i in range(200)], LABELS)
    assert toxicity.train(docs(spark, rows), marks, class_bytes=100_000)["tables"].shape[0] == 3
    assert language_id.train(docs(spark, rows), tokenizer_path("piece_bpe_32k.model"), sample_bytes=50_000)["langs"] == ["en"]


def test_toxicity_is_calibrated_on_all_labelled_rows(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(i, words(rng, ["ka", "lo", "mi"], 12) + (" grubbish" if i % 10 == 0 else ""), "en", "s") for i in range(900)]
    seen = []
    monkeypatch.setattr(toxicity, "calibrate", lambda *a: seen.append(a) or np.zeros(a[-1]))
    marks = spark.createDataFrame([(i, int(i % 10 == 0), None) for i in range(900)], LABELS)
    toxicity.train(docs(spark, rows), marks, per_class=30)
    outside = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1]
    _, _, clean, toxic, _ = seen[0]
    # All but the rows fitted, at most 30 of each label, in the mix of the labels.
    assert len(outside) - 60 <= clean.sum() + toxic.sum() < len(outside)
    assert clean.sum() > 5 * toxic.sum() > 0


def test_thresholds_weigh_rows_by_their_number():
    z, lang = np.array([2.0, 1.0, 0.0]), np.zeros(3, int)
    few = toxicity.calibrate(z, lang, np.array([0, 10, 50]), np.array([10, 10, 0]), 1)
    many = toxicity.calibrate(z, lang, np.array([0, 100, 500]), np.array([10, 10, 0]), 1)
    assert (few[0], many[0]) == (0.5, 1.5)
