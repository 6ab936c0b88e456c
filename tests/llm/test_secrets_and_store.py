import re
import zlib
from collections import defaultdict

import hashlib
import numpy as np
import pytest

from hunkmill.llm import secrets, token_store
from hunkmill.llm.queries import tokenizer_path

from .fixtures import awkward, docs

KEY = "AKIA" + "Z9" * 9
HEX = "0123456789abcdef" * 2


def test_base_spans_and_ownership(spark):
    own = "Qw3rtyUiop4sdfGhjk5lZxcv"
    rows = [
        (1, f"😀 PASSWORD = 'hunter22' and {KEY} {HEX}", "en", "a"), (2, "token: abc", "en", "a"), (3, None, "en", "b"), (4, f"api_key=\"{HEX}\"", "en", "c"),
        (5, f"bare {own} here", "en", "a"), (6, "ſecret=aaaaaaaa secret:bbbbbb", None, None), (7, "toKen=zzzzzz toKen=zzzzzz", "en", "d"), (7, "toKen=zzzzzz toKen=zzzzzz", "en", "d"),
        (None, "password=shared1", "en", "a"), (9, "password=shared1", "en", "b"), (10, "password=shared1", "en", "c"), (11, "Example7Value8Example9Value", "en", "a"), (12, "Example7Value8Example9Value", "en", "b"),
    ]
    out = defaultdict(list)
    for r in secrets.digest(secrets.scan_secrets(docs(spark, rows))).collect():
        out[r.doc_id].append(r)
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, text, _, _ in rows:
        text = text or ""
        base = [(m.start(), 0, m.end()) for m in pattern.finditer(text) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        shown = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base))
        for r in out[i]:
            assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
    assert len(out[7]) == 2
    assert out[5][0].spans == f"owned:5:{5 + len(own)}" and out[11][0].spans == out[12][0].spans == ""
    assert out[9][0].n_example == 1 and out[9][0].n_live == 0 and out[2][0].spans == ""
    assert secrets.scan_secrets(docs(spark, [])).count() == 0
    assert secrets.digest(secrets.scan_secrets(awkward(spark))).count() == awkward(spark).count()


def test_status_counts_owners_and_repositories(spark):
    rows = [("a", "o1", f"r{i}") for i in range(30)] + [("b", "o1", "r1"), ("b", "o1", "r1")] + [("c", f"o{i}", "r") for i in range(3)] + [("d", "o1", "r"), ("d", "o2", "r")]
    got = {r.value_hash: (r.repos, r.owners, r.occurrences, r.status) for r in secrets.ownership(spark.createDataFrame(rows, "value_hash string, owner string, repo string")).collect()}
    assert got == {"a": (30, 1, 30, "example"), "b": (1, 1, 2, "live"), "c": (3, 3, 3, "example"), "d": (2, 2, 2, "shared")}


def test_bare_tokens_are_found_in_linear_time():
    import time

    text = "".join(f"token={'aB3' * 8}{i} xY9{'qW7' * 8}{i:05d} " for i in range(20000))
    began = time.time()
    base = secrets.base_spans(text)
    bare = secrets.bare_spans(text, base)
    assert len(base) >= 20000 and len(bare) == 20000 and time.time() - began < 5
    assert all(not any(s < e2 and s2 < e for _, s2, e2, _ in base[max(0, i - 2):i + 3]) for i, (_, s, e, _) in list(enumerate(bare))[:50])


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_word_cache_is_exact(tokenizer):
    import pyarrow as pa

    texts = ["it's   Á <|endoftext|> x<|startoftext|>y", "", None, "ΣΑΣ ΣΑΣ 12a3 !!'ll don't", "tab\tnl\n\x0b\x0c\r é́", "日本 😀 \x1c w", " lead", "trail "] * 2
    offsets, ids = token_store.Encoder(tokenizer_path("word_bpe_49k.json"))(pa.array(texts), 2)
    for i, t in enumerate(texts):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def test_store_round_trip(spark, tokenizer, tmp_path):
    df = awkward(spark)
    path = f"{tmp_path}/store"
    out = token_store.store_and_read(df, tokenizer_path("word_bpe_49k.json"), path=path).collect()
    rows = sorted(((r.doc_id is None, r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0], r[1] or 0))
    got = sorted(out, key=lambda r: r.start)
    assert len(got) == len(rows) and all(r.verified for r in got)
    at = 0
    for r, (_, i, t) in zip(got, rows, strict=True):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    packs = spark.read.parquet(f"{path}/packs").collect()
    held = [a for p in packs for a, x in zip(p.recipe, p.payloads, strict=True) if x is not None]
    assert len(held) == len(set(held)) == len({a for p in packs for a in p.recipe}) < sum(len(p.recipe) for p in packs)
    assert token_store.store_and_read(docs(spark, []), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_lost_and_altered_chunks_are_reported(spark, tmp_path):
    rows = [(i, f"words of document {i} " * 30, "en", "s") for i in range(400)] + [(1000 + i, "one text held by many", "en", "s") for i in range(200)]
    path, tokenizer = f"{tmp_path}/store", tokenizer_path("word_bpe_49k.json")
    token_store.write_store(docs(spark, rows).repartition(6), tokenizer, 2, path)
    out = token_store.read_store(spark, path).collect()
    assert len(out) == 600 and all(r.verified for r in out)
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == sorted(i for i, *_ in rows)
    files = sorted(p for p in (tmp_path / "store" / "packs" / "shares=false").glob("*.parquet") if spark.read.parquet(str(p)).count() > 20)
    files[0].unlink()
    out = token_store.read_store(spark, path).collect()
    assert len(out) == 600 and not any(r.verified for r in out)  # all lie in one segment
    assert {r.doc_id for r in out} == {i for i, *_ in rows} and any(r.n_tokens == 0 for r in out)
    assert token_store.width_of(tokenizer, 2) == "<u2" and token_store.width_of(tokenizer, 1 << 16) == "<u4"


def test_cuts_keep_bounds_and_find_shared_chunks():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 49000, 20000).astype(np.uint32)
    found = []
    for n in (0, 700):
        ids = np.concatenate([rng.integers(0, 49000, n).astype(np.uint32), shared])
        ends = token_store.cuts(ids, token_store.proposals(ids))
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(ids) and sizes.max() <= token_store.MOST and sizes[:-1].min() >= token_store.LEAST
        found.append({ids[e - s:e].tobytes() for s, e in zip(sizes, ends, strict=True)})
    assert len(found[0] & found[1]) > len(found[0]) / 2
    ids = np.zeros(10000, np.uint32)
    assert max(np.diff([0, *token_store.cuts(ids, token_store.proposals(ids))])) <= token_store.MOST
