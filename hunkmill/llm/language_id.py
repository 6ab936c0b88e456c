"""Language identification with segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces, found by the forward algorithm; a text's is the product over its words. The
piece probabilities come from expectation maximisation (forward-backward) over the word counts of at most `sample`
training rows, in hash order, and of these the first whose texts come to `sample_bytes`, so what the driver holds is
bounded; scoring covers every word of every text.

Defined cases: null text and text without a letter get `und` and score 0; a character outside the vocabulary is a
piece of fixed small probability; words are lower-cased and stripped of marks at their ends; a word of any length is
summed over all its segmentations (to learn from, those over 64 characters are cut in runs of 64), and a text of any
length is scored whole; the score is the winner's share of the languages' posterior for the mean word count 40; equal
scores go to the first language by name; with nothing to learn from, as in an empty table, all are `und`; repeated rows
score alike and count each time in learning; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, lean, pieces, words_of

MARK, LONGEST = "▁", 64
#: Marks cut from both ends of a word.
MARKS = ".,;:!?\"'()[]{}<>«»“”‘’…-–—*_/\\|#=+~`"
#: Scale a character, which keeps the sums near 1; taken back in the logarithm.
SCALE = float(np.exp(2.0))
OTHER = 1e-6
CACHE_WORDS = 400_000
#: Words whose segmentations are summed together.
BLOCK = 4096


def vocabulary(path: str) -> list[str]:
    """The pieces of a SentencePiece model that are text, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return sorted({p.lower() for p in found if p.strip(MARK)} | {MARK})


def tokens(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    ends, flat = words_of(pc.utf8_lower(pc.fill_null(texts, "")), lower=False)
    return ends, pc.utf8_trim(flat, MARKS).dictionary_encode()


class Lattice:
    """All ways to cut words into pieces: an edge (word, start, end, piece) for each match."""

    def __init__(self, words: list[str], index: dict[str, int]):
        longest = max(map(len, index), default=1)
        w, s, e, p = [], [], [], []
        for i, word in enumerate(words):
            n = len(word)
            for a in range(n):
                one = len(w)
                for b in range(a + 1, min(n, a + longest) + 1):
                    k = index.get(word[a:b])
                    if k is not None:
                        w.append(i), s.append(a), e.append(b), p.append(k)
                if len(w) == one or e[one] > a + 1:
                    w.append(i), s.append(a), e.append(a + 1), p.append(len(index))
        self.n = np.fromiter(map(len, words), np.int64, len(words))
        self.w, self.s, self.e, self.p = (np.array(x, np.int32) for x in (w, s, e, p))
        self.longest = int(self.n.max(initial=0))

    def _sweep(self, prob: np.ndarray, at: np.ndarray, to: np.ndarray, steps, first: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.n), self.longest + 1, prob.shape[1]))
        out[np.arange(len(self.n)), first] = 1
        order = np.lexsort((self.w, to))
        cuts = np.searchsorted(to[order], np.arange(self.longest + 2))
        for j in steps:
            own = order[cuts[j]:cuts[j + 1]]
            if len(own):
                w = self.w[own]
                heads = np.concatenate([[0], np.nonzero(np.diff(w))[0] + 1])
                out[w[heads], j] = np.add.reduceat(out[w, at[own]] * prob[self.p[own]], heads)
        return out

    def forward(self, prob: np.ndarray) -> np.ndarray:
        return self._sweep(prob, self.s, self.e, range(1, self.longest + 1), np.zeros(len(self.n), np.int64))

    def log_probability(self, prob: np.ndarray) -> np.ndarray:
        """Words by languages; prob is scaled by SCALE a character."""
        total = self.forward(prob)[np.arange(len(self.n)), self.n]
        return np.log(np.maximum(total, 1e-300)) - (self.n * np.log(SCALE))[:, None]

    def expected(self, prob: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language, for counts of words by languages."""
        left = self.forward(prob)
        right = self._sweep(prob, self.e, self.s, range(self.longest - 1, -1, -1), self.n)
        total = left[np.arange(len(self.n)), self.n]
        share = left[self.w, self.s] * prob[self.p] * right[self.w, self.e] * (counts / np.maximum(total, 1e-300))[self.w]
        return np.stack([np.bincount(self.p, share[:, k], len(prob)) for k in range(prob.shape[1])], 1)


def _runs(word: str) -> list[str]:
    word = MARK + word
    return [word[i:i + LONGEST] for i in range(0, len(word), LONGEST)]


def long_word(word: str, model: dict) -> np.ndarray:
    """log_probability of one word, the forward sums held for the last characters only and scaled back as they go."""
    word, index, prob = MARK + word, model["index"], model["prob"]
    reach = model["reach"]
    kept = [np.ones(prob.shape[1])]
    scaled = np.zeros(prob.shape[1])
    for end in range(1, len(word) + 1):
        total, one = 0.0, False
        for n in range(1, min(reach, end) + 1):
            k = index.get(word[end - n:end])
            if k is not None:
                total = total + kept[-n] * prob[k]
                one |= n == 1
        if not one:
            total = total + kept[-1] * prob[len(index)]
        kept = [*kept[-reach:], total]
        if end % LONGEST == 0:
            by = np.maximum(total, 1e-300)
            kept = [x / by for x in kept]
            scaled += np.log(by)
    return np.log(np.maximum(kept[-1], 1e-300)) + scaled - len(word) * np.log(SCALE)


def fit(counts: list[tuple[str, str, int]], names: list[str], rounds: int = 3) -> dict:
    """counts: (lang, word, n). Returns the languages, pieces and the scaled probabilities (pieces + 1, languages)."""
    langs = sorted({c[0] for c in counts})
    index = {p: i for i, p in enumerate(names)}
    runs: dict[str, np.ndarray] = {}
    for lang, word, n in counts:
        for r in _runs(word):
            runs.setdefault(r, np.zeros(len(langs)))[langs.index(lang)] += n
    length = np.array([*map(len, names), 1])
    scale = (SCALE ** length)[:, None]
    prob = np.full((len(names) + 1, len(langs)), 1 / len(names))
    prob[-1] = OTHER
    words, weight = list(runs), np.array(list(runs.values())).reshape(len(runs), len(langs))
    blocks = [(Lattice(words[i:i + BLOCK], index), weight[i:i + BLOCK]) for i in range(0, len(words), BLOCK)]
    for _ in range(rounds):
        use = sum((lattice.expected(prob * scale, w) for lattice, w in blocks), np.zeros_like(prob))[:-1] + 0.05
        prob[:-1] = use / use.sum(0) * (1 - OTHER)
    return {"langs": langs, "index": index, "prob": prob * scale, "reach": max(map(len, names), default=1)}


def score_words(words: list[str], model: dict) -> np.ndarray:
    out = np.zeros((len(words), len(model["langs"])))
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    short = order[size[order] < LONGEST]
    for i in range(0, len(short), BLOCK):
        own = short[i:i + BLOCK]
        out[own] = Lattice([MARK + words[k] for k in own], model["index"]).log_probability(model["prob"])
    for k in order[len(short):]:
        out[k] = long_word(words[k], model)
    return out


def _predict(model):
    def run(batches):
        m, known, table = model.value, {}, []
        langs, size = m["langs"], 0
        for batch in batches:
            for part in pieces(batch, "text"):
                ends, code = tokens(part.column("text"))
                words = code.dictionary.to_pylist()
                if size > CACHE_WORDS:
                    known, table, size = {}, [], 0
                fresh = [w for w in words if w not in known]
                known.update(zip(fresh, range(size, size + len(fresh)), strict=True))
                size += len(fresh)
                table = [np.concatenate([*table, score_words(fresh, m)])] if fresh or not table else table
                rows = table[0][np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
                total = np.concatenate([np.zeros((1, len(langs))), np.cumsum(rows[code.indices.to_numpy()], 0)])
                n = np.maximum(np.diff(ends), 1)[:, None]
                mean = (total[ends[1:]] - total[ends[:-1]]) / n
                best = mean.argmax(1)
                share = np.exp((mean - mean.max(1, keepdims=True)) * np.minimum(n, 40))
                lettered = pc.match_substring_regex(pc.fill_null(part.column("text"), ""), r"\p{L}").to_numpy(zero_copy_only=False)
                lang = [langs[b] if k else "und" for b, k in zip(best, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(np.where(lettered, 1 / share.sum(1), 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _count(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            ends, code = tokens(part.column("text"))
            lang = np.repeat(part.column("lang").to_numpy(zero_copy_only=False), np.diff(ends))
            counted = pa.table({"lang": pa.array(lang, pa.string()), "word": code.cast(pa.large_string())}).group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from counted.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).cast(pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])).combine_chunks().to_batches()


def train(docs: DataFrame, pieces_path: str, sample: int = 6000, sample_bytes: int = 64 << 20) -> dict:
    """Learns from text and non-null lang of at most `sample` rows and sample_bytes of text outside the held-out third."""
    own = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    n = own.count()
    # A seeded share of the rows, a little over the bound, then cut to it.
    share = min(1.0, 1.2 * sample / max(n, 1))
    order = [F.xxhash64(F.lit(7), "doc_id"), F.col("doc_id"), F.xxhash64("text"), F.col("lang")]
    own = own.filter(F.pmod(order[0], F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    first = own.select("doc_id", order[0].alias("h"), order[2].alias("t"), "lang", F.octet_length("text").alias("bytes")).orderBy("h", "doc_id", "t", "lang").limit(sample)
    before = Window.partitionBy(F.lit(1)).orderBy("h", "doc_id", "t", "lang").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("before", F.sum("bytes").over(before)).filter(F.coalesce("before", F.lit(0)) < sample_bytes)
    chosen = first.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()
    own = own.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("__id")) & (order[2] == F.col("__t")), "left_semi").select("lang", "text")
    counts = own.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = counts.toPandas() if n else None
    found = [] if rows is None else list(zip(rows.lang, rows.word, rows.n, strict=True))
    return fit(sorted(found), vocabulary(pieces_path)) if found else {}


def identify(docs: DataFrame, pieces_path: str, sample: int = 6000) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang)."""
    model = train(docs, pieces_path, sample)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    if not model:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
