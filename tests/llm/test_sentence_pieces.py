import zlib

import numpy as np
import pyarrow as pa
import pytest

from hunkmill.llm import sentence_pieces as sp
from hunkmill.llm.queries import tokenizer_path

from .fixtures import awkward, docs

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def reference():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_parse_agrees_with_the_library(reference):
    model = sp.parse(PATH)
    assert len(model.pieces) == reference.get_piece_size()
    for i in range(0, len(model.pieces), 97):
        piece, score, kind = model.pieces[i]
        assert (piece, kind == sp.BYTE, kind == sp.CONTROL) == (reference.id_to_piece(i), reference.is_byte(i), reference.is_control(i))
        assert score == pytest.approx(reference.get_score(i))


def test_parity_and_round_trip(spark, reference):
    odd = ["Hello  world", " lead", "trail  ", "", None, "   ", " ", "日本 \n é\t<s></s>", "x\r\ny", "aaaaaaa aaa", "ﬁ é é", "😀" * 50, "\x00\x01 nul", "word" * 4000]
    backend = sp.Backend(PATH)
    offsets, ids, same = backend.encode(pa.array(odd))
    for i, t in enumerate(odd):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == reference.encode(t or "")
    assert same.all()
    assert [x.decode() for x in backend.decode(offsets, ids)] == [t or "" for t in odd]
    whole = sp.build(backend.model)
    assert [whole.encode(t or "", add_special_tokens=False).ids for t in odd[:4]] == [reference.encode(t or "") for t in odd[:4]]

    df = awkward(spark)
    out = sp.report(df, PATH).collect()
    assert len(out) == df.count() and all(r.parity and r.round_trip for r in out)
    want = sorted(((r.doc_id or -1), zlib.crc32(np.array(reference.encode(r.text or ""), "<u4").tobytes())) for r in df.collect())
    assert sorted(((r.doc_id or -1), r.ids_crc32) for r in out) == want
    back = sp.decode(sp.encode(df, PATH), PATH)
    assert sorted(((r.doc_id or -1), r.text) for r in back.collect()) == sorted(((r.doc_id or -1), r.text or "") for r in df.collect())
    assert sp.report(docs(spark, []), PATH).count() == 0


def test_unigram_model_with_squeezed_spaces(tmp_path):
    """A hand-written model file: unigram scores, byte fallback, spaces squeezed."""
    import struct

    def field(n, kind, value):
        key = bytes([n << 3 | kind]) if n < 16 else bytes([(n << 3 | kind) & 127 | 128, n >> 4])
        return key + (bytes([len(value)]) + value if kind == 2 else value)

    def piece(text, score, kind=1):
        body = field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, body)

    items = [piece("<unk>", 0, 2)] + [piece(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    items += [piece("▁", -3.0), piece("a", -4.0), piece("b", -4.0), piece("ab", -5.0), piece("▁a", -4.5), piece("▁ab", -9.0)]
    data = b"".join(items) + field(2, 2, field(3, 0, b"\x01") + field(35, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x01"))
    (tmp_path / "m.model").write_bytes(data)
    model = sp.parse(str(tmp_path / "m.model"))
    assert (model.kind, model.byte_fallback, model.squeeze, sp.splits_at_marks(model)) == (sp.UNIGRAM, True, True, False)
    tokens = sp.build(model).encode("  ab   ba ", add_special_tokens=False).tokens
    assert tokens == ["▁", "ab", "▁", "b", "a"]
    assert sp.build(model).encode("é", add_special_tokens=False).tokens == ["▁", "<0xC3>", "<0xA9>"]
    for more in (piece("<user>", 0, 4), field(2, 2, field(24, 0, b"\x01")), field(3, 2, field(5, 0, b"\x00"))):
        (tmp_path / "odd.model").write_bytes(data + more)
        with pytest.raises(ValueError, match="not supported"):
            sp.parse(str(tmp_path / "odd.model"))
