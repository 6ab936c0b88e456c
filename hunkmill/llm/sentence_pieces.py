"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here and rebuilt: normaliser (character map, spaces, dummy prefix), metaspace
marker, byte fallback and the scores, as unigram scores or, for a BPE model, as merges ranked by score. Batches
are encoded by the library's threads. As long as no piece holds a marker after another character, a text falls
into runs of spaces with the word after them, and each distinct run is encoded once; otherwise whole texts are.
Parity with the sentencepiece library is verified for every distinct run (or text).

Defined cases: null text is empty, and empty text has no ids; decoding gives back the normalised text, for an
identity normaliser the text itself, byte for byte; characters outside the vocabulary become bytes, or the
unknown id where the model has no bytes; texts of any length are encoded whole; repeated rows encode alike.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import lean, pieces, without_gc

MARK = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
CACHE_RUNS = 120_000
#: Bytes of text encoded at a time: the library's results for new runs take many times their text.
PIECE_BYTES = 500_000


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at:at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = data[at:at + n], at + n
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    char_map: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True


def parse(path: str) -> Model:
    """Field numbers are those of the public model format."""
    out = Model()
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            if kind == USER:
                raise ValueError(f"{path}: user-defined symbol {piece!r} is not supported")
            out.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    out.kind = v
                elif n == 24 and v:
                    raise ValueError(f"{path}: white space as a suffix is not supported")
                elif n == 35:
                    out.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    out.char_map = v
                elif n == 3:
                    out.dummy_prefix = bool(v)
                elif n == 4:
                    out.squeeze = bool(v)
                elif n == 5 and not v:
                    raise ValueError(f"{path}: white space that is not escaped is not supported")
    return out


def merges(model: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, best score first."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
    found = []
    for whole, s in score.items():
        found += [(-s, len(whole), whole, cut) for cut in range(1, len(whole)) if whole[:cut] in score and whole[cut:] in score]
    found.sort(key=lambda m: (m[0], m[2], m[3]))
    return [(w[:c], w[c:]) for _, _, w, c in found]


def splits_at_marks(model: Model) -> bool:
    return not model.char_map and not model.squeeze and not any(MARK in p.lstrip(MARK) for p, _, _ in model.pieces)


def build(model: Model, prefix: bool = True):
    """A tokenizers.Tokenizer for the model; without prefix the dummy prefix is left to the caller."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    elif model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, merges(model), unk_token=model.pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.char_map)] if model.char_map else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if prefix and model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not any(MARK in p.lstrip(MARK) for p, _, _ in model.pieces):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return out


class Backend:
    """Encodes and decodes arrays of texts; remembers the runs that it has met."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = parse(path)
        self.by_run = splits_at_marks(self.model)
        self.tokenizer = build(self.model, prefix=not self.by_run)
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.forget()
        bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() if k != CONTROL else b"" for p, _, k in self.model.pieces]
        self.sizes = np.array([*map(len, bytes_of)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.is_byte = np.array([k == BYTE for _, _, k in self.model.pieces])

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.count, self.same = np.zeros(0, np.int64), np.zeros(0, bool)

    def _rows(self, runs: list[str]) -> np.ndarray:
        """Rows in the table of known runs, which takes up new ones."""
        get = self.known.get
        rows = np.fromiter((get(r, -1) for r in runs), np.int64, len(runs))
        missing = np.nonzero(rows < 0)[0]
        if not len(missing):
            return rows
        fresh = [runs[i] for i in missing.tolist()]
        own = [e.ids for e in self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)]
        # The library adds the dummy prefix itself; a run of spaces alone needs a text before it.
        if self.by_run and self.model.dummy_prefix:
            theirs = self.reference.encode([r[1:] if len(r) > 1 and r[-1] != " " else "" for r in fresh], num_threads=1)
            for i in [i for i, r in enumerate(fresh) if r[-1] == " "]:
                theirs[i] = self.reference.encode("a" + fresh[i])[len(self.reference.encode("a")):]
        else:
            theirs = self.reference.encode(fresh, num_threads=1)
        size = np.fromiter(map(len, own), np.int64, len(own))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.count = np.concatenate([self.count, size])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(own), np.int32, int(size.sum()))])
        self.same = np.concatenate([self.same, np.fromiter((x == y for x, y in zip(own, theirs, strict=True)), bool, len(own))])
        # Runs come from a dictionary, so each is new once.
        rows[missing] = np.arange(len(self.known), len(self.known) + len(fresh))
        self.known.update(zip(fresh, rows[missing].tolist(), strict=True))
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets, ids, and for each text whether all its runs are encoded as by the sentencepiece library."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if len(self.known) > CACHE_RUNS:
            self.forget()
        if self.by_run:
            full = pc.not_equal(pc.binary_length(texts), 0).cast(pa.int8())
            lead = pa.array(["", " " if self.model.dummy_prefix else ""], pa.large_string()).take(full)
            marked = pc.binary_join_element_wise(lead, texts, pa.scalar("", pa.large_string()))
            ends = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset:marked.offset + len(marked) + 1]
            data = marked.buffers()[2]
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            space = raw[ends[0]:ends[-1]] == 32
            begins = space.copy()
            begins[1:] &= ~space[:-1]
            begins[(ends[:-1] - ends[0])[ends[:-1] < ends[-1]]] = True  # every text begins a run
            at = np.append(np.nonzero(begins)[0] + ends[0], ends[-1])
            runs = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), data) if len(at) > 1 else pa.array([], pa.large_string())
            ends = np.searchsorted(at, ends)
        else:
            runs, ends = texts, np.arange(len(texts) + 1)
        coded = runs.dictionary_encode()
        row = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        n = self.count[row]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.first[row] - upto[:-1], n) + np.arange(upto[-1])]
        bad = np.concatenate([[0], np.cumsum(~self.same[row])])
        return upto[ends], ids, bad[ends[1:]] == bad[ends[:-1]]

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[bytes]:
        n = self.sizes[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        raw = self.pool[np.repeat(self.starts[ids] - upto[:-1], n) + np.arange(upto[-1])]
        lead, at = int(self.model.dummy_prefix), upto[offsets]
        return [raw[min(a + lead, b):b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


@functools.cache
def _backend(path: str) -> Backend:
    """One for each worker process."""
    return Backend(path)


def _encode(path: str):
    def run(batches):
        backend = _backend(path)
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                offsets, ids, _ = backend.encode(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        backend = _backend(path)
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy()[offsets[0]:offsets[-1]]
            texts = backend.decode(offsets - offsets[0], ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["doc_id", "text"])

    return run


def _report(path: str):
    def run(batches):
        # Threads of the library for each task; more than the cores of an executor only spin.
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        backend = _backend(path)
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                text = pc.fill_null(part.column("text"), "")
                with without_gc():
                    offsets, ids, same = backend.encode(text)
                back = backend.decode(offsets, ids)
                raw, in_bytes = ids.astype("<u4"), np.concatenate([[0], np.cumsum(backend.is_byte[ids])])
                crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                whole = [x == y for x, y in zip(back, text.cast(pa.binary()).to_pylist(), strict=True)]
                columns = [part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64()), pa.array(np.diff(in_bytes[offsets]), pa.int64()), pa.array(same), pa.array(whole, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_crc32", "n_bytes", "parity", "round_trip"])
        backend.forget()  # an idle worker holds no memory that other stages need

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every row of docs (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_encode(path), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of encoded (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, n_bytes (ids of single bytes), parity, round_trip for every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(_report(path)), f"doc_id {kind}, n_tokens long, ids_crc32 long, n_bytes long, parity boolean, round_trip boolean")
