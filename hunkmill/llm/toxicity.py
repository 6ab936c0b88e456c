"""Toxicity by a convolutional text classifier in numpy.

A word is the sum of three hashed embeddings (two hashes of the word, one of its first four letters). Filters of
width 1, 2 and 3 slide over the words, the maximum of each over the text feeds a logistic output. One dimension of
each embedding starts from the log odds of its bucket, the rest at random; all are trained by Adagrad, and as a
maximum passes its gradient to one window only, a step touches few rows. Thresholds are calibrated by language:
a guess from the text alone (never the lang column) picks the language, and its threshold becomes score 0.7.

Learning takes at most `per_class` rows of each label, in hash order, outside the held-out third, and of these the first
whose texts come to `class_bytes` bytes, so what the driver holds is bounded; thresholds come from all other labelled
rows outside that third, in their own mix of labels; scoring covers every word of every text, so a document's score
depends on its text and the model alone.

Defined cases: null and blank texts have no words and score below 0.7; a text of any length is scored whole, alone in
its piece; labels of ids without a document, null labels and repeated labels that disagree are left out; where an id
has several texts, the one of least hash is learned from and each is scored by itself; with one label only or none,
and with an empty table, there is no model and every score is 0; repeated rows score alike; equal responses go to the
first word; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, lean, pieces, trim
from .language_id import tokens

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
CUT = 0.7
#: Buckets of fewer training documents have no embedding; log odds are shrunk as by so many average documents.
MIN_DOCS, SHRINK = 4, 6.0
#: Logits are counted in steps of 1 / BINS from -FAR to FAR for the thresholds.
BINS, FAR = 64, 64
#: Buckets of the language guess.
GUESS = 1 << 14
#: Bytes of text scored at a time: the responses of its words take some fifty times as much.
PIECE_BYTES = 500_000


def hashes(words: list[str]) -> np.ndarray:
    """Rows of the three tables for each word."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    p = np.fromiter((xxhash.xxh3_64_intdigest(w[:4], 1) for w in words), np.uint64, len(words))
    m = np.uint64(BUCKETS - 1)
    return np.stack([h & m, (h >> np.uint64(20)) & m, p & m], 1).astype(np.int64)


def _columns() -> list[tuple[int, int]]:
    """(width, place) of each block of FILTERS columns of the filter matrix."""
    return [(w, k) for w in WIDTHS for k in range(w)]


def responses(x: np.ndarray, model: dict) -> np.ndarray:
    """Words (or distinct words) by all filter columns, in double precision first: a word's do not depend on its batch."""
    return (x.astype(np.float64) @ model["filters"].astype(np.float64)).astype(np.float32)


def pooled(each: np.ndarray, offsets: np.ndarray, model: dict, want_arg: bool = False):
    """Largest response of each filter over each document, and where; documents without words get 0."""
    n, docs = len(each), len(offsets) - 1
    out, arg = np.zeros((docs, len(WIDTHS) * FILTERS), np.float32), np.full((docs, len(WIDTHS) * FILTERS), -1)
    size = np.diff(offsets)
    blocks = {c: each[:, i * FILTERS:(i + 1) * FILTERS] for i, c in enumerate(_columns())}
    left = np.repeat(offsets[1:], size) - np.arange(n)  # words from here to the end of the document
    for j, w in enumerate(WIDTHS):
        full = np.nonzero(size >= w)[0]
        if not len(full):
            continue
        total = blocks[(w, 0)].copy()
        for k in range(1, w):
            total[:-k] += blocks[(w, k)][k:]
        total[left < w] = -np.inf
        heads = offsets[:-1][full]
        # Every word lies in some document; those of too short ones follow another's head and are -inf.
        best = np.maximum.reduceat(total, heads)
        own = slice(j * FILTERS, (j + 1) * FILTERS)
        out[full, own] = np.maximum(best + model["bias"][own], 0)
        if want_arg:
            for f in range(FILTERS):
                top = np.repeat(best[:, f], np.diff([*heads, n]))
                at = np.nonzero(total[heads[0]:, f] == top)[0] + heads[0]
                doc = np.searchsorted(heads, at, "right") - 1
                first = np.concatenate([[True], np.diff(doc) > 0])
                arg[full[doc[first]], j * FILTERS + f] = at[first]
    return (out, arg) if want_arg else out


def _embed(h: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][h[:, 0]] + tables[1][h[:, 1]] + tables[2][h[:, 2]]


def fit(docs: list[tuple[np.ndarray, int]], seed: int = 5, epochs: int = 4, batch: int = 64, rate: float = 0.02) -> dict:
    """docs: rows of the three tables for each word in order, and the label."""
    rng = np.random.default_rng(seed)
    label = np.array([y for _, y in docs], np.float64)
    tables = rng.normal(0, 0.02, (3, BUCKETS, DIM)).astype(np.float32)
    rare = np.zeros((3, BUCKETS), bool)
    for t in range(3):
        seen = np.zeros((2, BUCKETS))
        for h, y in docs:
            seen[y, np.unique(h[:, t])] += 1
        base, all_docs = label.mean(), seen.sum(0)
        odds = np.log((seen[1] + SHRINK * base) / (all_docs + SHRINK) / base)
        tables[t, :, 0] = np.clip(odds / np.log(1 / base), 0, 1)
        rare[t] = all_docs < MIN_DOCS
        tables[t, rare[t]] = 0
    columns = _columns()
    filters = rng.normal(0, 0.1, (DIM, len(columns) * FILTERS)).astype(np.float32)
    filters[0, :] = np.abs(filters[0, :]) + 0.5 / np.repeat([w for w, _ in columns], FILTERS)
    model = {"filters": filters, "bias": np.zeros(len(WIDTHS) * FILTERS, np.float32), "out": rng.uniform(0.1, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), "out_bias": -2.0}
    squares = {k: np.full_like(v, 1e-4) for k, v in (*((k, model[k]) for k in ("filters", "bias", "out")), ("tables", tables))}
    bias_square = 1e-4
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))

    def step(name, value, at, g):
        squares[name][at] += g * g
        value[at] -= rate * g / np.sqrt(squares[name][at])

    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), batch):
            own = order[i:i + batch]
            h = np.concatenate([docs[k][0] for k in own])
            offsets = np.cumsum([0, *(len(docs[k][0]) for k in own)])
            x = _embed(h, tables)
            hidden, arg = pooled(responses(x, model), offsets, model, want_arg=True)
            z = hidden @ model["out"] + model["out_bias"]
            err = ((1 / (1 + np.exp(-z)) - label[own]) * weight[own] / len(own)).astype(np.float32)
            back = np.where(hidden > 0, err[:, None] * model["out"][None, :], 0).astype(np.float32)
            d_filters, rows, grads = np.zeros_like(filters), [], []
            for c, (w, k) in enumerate(columns):
                j = WIDTHS.index(w)
                for f in range(FILTERS):
                    q = j * FILTERS + f
                    live = np.nonzero((arg[:, q] >= 0) & (back[:, q] != 0))[0]
                    if len(live):
                        at, g = arg[live, q] + k, back[live, q]
                        d_filters[:, c * FILTERS + f] += x[at].T @ g
                        rows.append(at)
                        grads.append(g[:, None] * filters[None, :, c * FILTERS + f])
            step("out", model["out"], slice(None), hidden.T @ err)
            step("bias", model["bias"], slice(None), back.sum(0))
            step("filters", filters, slice(None), d_filters)
            g = float(err.sum())
            bias_square += g * g
            model["out_bias"] -= rate * g / bias_square**0.5
            if rows:
                at, g = np.concatenate(rows), np.concatenate(grads)
                for t in range(3):
                    common = ~rare[t, h[at, t]]
                    u, back_to = np.unique(h[at[common], t], return_inverse=True)
                    sums = np.zeros((len(u), DIM), np.float32)
                    np.add.at(sums, back_to, g[common])
                    squares["tables"][t, u] += sums * sums
                    tables[t, u] -= rate * sums / np.sqrt(squares["tables"][t, u])
    return model | {"tables": tables}


def logits(x: np.ndarray, code: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    """x: embeddings of distinct words; code: the words of all documents in order."""
    hidden = pooled(responses(x, model)[code], offsets, model)
    return hidden.astype(np.float64) @ model["out"].astype(np.float64) + model["out_bias"]


def guess_language(h: np.ndarray, code: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    total = np.concatenate([np.zeros((1, model["guess"].shape[1])), np.cumsum(model["guess"][h[:, 0] % GUESS][code], 0)])
    return (total[offsets[1:]] - total[offsets[:-1]]).argmax(1)


def calibrate(z: np.ndarray, lang: np.ndarray, clean: np.ndarray, toxic: np.ndarray, count: int) -> np.ndarray:
    """For each language the logit with the best F1 over rows counted by logit, midway between the two logits it parts;
    all rows' where a class is missing."""

    def best(own):
        value, back = np.unique(-z[own], return_inverse=True)
        hit, rows = (np.cumsum(np.bincount(back, n[own])) for n in (toxic, clean + toxic))
        f1 = 2 * hit / (rows + hit[-1])
        top = np.nonzero(f1 == f1.max())[0]
        at = top[len(top) // 2]
        after = -value[at + 1] if at + 1 < len(value) else -value[at] - 1
        return (-value[at] + after) / 2

    every = best(np.ones(len(z), bool))
    return np.array([best(lang == k) if clean[lang == k].sum() and toxic[lang == k].sum() else every for k in range(count)])


def _features(batches):
    for batch in batches:
        for part in pieces(batch, "text", PIECE_BYTES):
            offsets, code = tokens(part.column("text"))
            h = hashes(code.dictionary.to_pylist()).astype("<i4")[code.indices.to_numpy()]
            rows = [h[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), part.column("lang"), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "lang", "h"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500, class_bytes: int = 16 << 20) -> dict:
    """Learns from at most per_class rows and class_bytes of text of each label, of ids that are not held out."""
    marks = labels.select("doc_id", "toxic").filter(~held_out() & F.col("toxic").isin(0, 1))
    marks = marks.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most")
    order = [F.xxhash64(F.lit(11), "doc_id"), F.col("doc_id")]
    some = marks.filter("toxic = 0").orderBy(*order).limit(per_class).unionByName(marks.filter("toxic = 1").orderBy(*order).limit(per_class))
    some = some.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    own = docs.select("doc_id", "text", "lang").join(F.broadcast(some), F.col("doc_id") == F.col("__id"))
    # One text of each id, the same whatever the partitioning; at most 2 * per_class rows go on.
    own = own.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), F.col("lang"))).alias("t")).select("doc_id", "toxic", "t.*")
    before = Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("__before", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(before)).filter(F.coalesce("__before", F.lit(0)) < class_bytes)
    found = own.select("doc_id", "toxic", "lang", "text").mapInArrow(lean(_features), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, lang string, h binary").toPandas()
    found = found.sort_values("doc_id").reset_index(drop=True)
    rows = [np.frombuffer(x, "<i4").reshape(-1, 3).astype(np.int64) for x in found.h]
    label = found.toxic.to_numpy()
    if len(set(label)) < 2:
        return {}
    inner = np.random.default_rng(3).random(len(rows)) < 0.8
    if len(set(label[inner])) < 2:
        inner[:] = True
    model = fit([(r, int(y)) for r, y, k in zip(rows, label, inner, strict=True) if k])
    langs = sorted(x for x in set(found.lang) if x is not None)
    guess = np.full((GUESS, max(1, len(langs))), 0.1)
    for r, lang in zip(rows, found.lang, strict=True):
        if lang in langs:
            guess[:, langs.index(lang)] += np.bincount(r[:, 0] % GUESS, minlength=GUESS)
    model["guess"] = np.log(guess / guess.sum(0)).astype(np.float32)
    fitted = found.doc_id[inner].tolist()
    counts = histogram(docs, marks, model, fitted)
    if min(counts.clean.sum(), counts.toxic.sum()) == 0:
        counts = histogram(docs, marks, model, [])
    if not counts.clean.sum() + counts.toxic.sum():
        return {}
    model["thresholds"] = calibrate((counts.bin.to_numpy() + 0.5) / BINS, counts.guess.to_numpy(), counts.clean.to_numpy(), counts.toxic.to_numpy(), model["guess"].shape[1])
    return model


def _binned(model):
    def run(batches):
        m = model.value
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                offsets, code = tokens(part.column("text"))
                h, at = hashes(code.dictionary.to_pylist()), code.indices.to_numpy()
                z = logits(_embed(h, m["tables"]), at, offsets, m)
                bins = np.floor(np.clip(z, -FAR, FAR) * BINS).astype(np.int32)
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(guess_language(h, at, offsets, m).astype(np.int32)), pa.array(bins)], names=["doc_id", "guess", "bin"])
                yield out.filter(pa.array(np.diff(offsets) > 0))

    return run


def histogram(docs: DataFrame, marks: DataFrame, model: dict, fitted: list) -> pd.DataFrame:
    """guess, bin, clean, toxic: how many documents of marks (doc_id, toxic), those fitted left out, by guessed language
    and logit. Blank texts are left out, whose score is fixed."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    rows = docs.filter(~held_out()).select("doc_id", "text")
    rows = rows.mapInArrow(lean(_binned(spark.sparkContext.broadcast(model))), f"doc_id {kind}, guess int, bin int")
    own = marks.select(F.col("doc_id").cast(kind).alias("doc_id"), "toxic")
    if fitted:
        own = own.join(F.broadcast(spark.createDataFrame([(x,) for x in fitted], f"doc_id {kind}")), "doc_id", "left_anti")
    # Documents repeated count once.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("guess", "bin")).alias("at")).join(own, "doc_id")
    return rows.groupBy("at.guess", "at.bin").agg(F.sum((F.col("toxic") == 0).cast("long")).alias("clean"), F.sum((F.col("toxic") == 1).cast("long")).alias("toxic")).toPandas()


def _score(model):
    def run(batches):
        m = model.value
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                offsets, code = tokens(part.column("text"))
                h, at = hashes(code.dictionary.to_pylist()), code.indices.to_numpy()
                z = logits(_embed(h, m["tables"]), at, offsets, m) - m["thresholds"][guess_language(h, at, offsets, m)]
                z = np.where(np.diff(offsets) > 0, z, np.minimum(z, -1.0))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(1 / (1 + np.exp(-(z.astype(np.float64) + np.log(CUT / (1 - CUT))))))], names=["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text, lang) by labels (doc_id, toxic)."""
    model = train(docs, labels, per_class)
    trim()
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    if not model:
        rows = rows.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = rows.mapInArrow(lean(_score(docs.sparkSession.sparkContext.broadcast(model))), f"doc_id {kind}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def _keep(model):
    score_of = _score(model)

    def run(batches):
        for batch in batches:
            narrow = pa.RecordBatch.from_arrays([batch.column("text"), pa.array(range(len(batch))), pa.array([False] * len(batch))], names=["text", "doc_id", "held_out"])
            kept = np.concatenate([b.column("score").to_numpy() < CUT for b in score_of([narrow])] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(kept))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all their columns."""
    model = train(docs, labels, per_class)
    trim()
    return docs.mapInArrow(lean(_keep(docs.sparkSession.sparkContext.broadcast(model))), docs.schema) if model else docs
