"""Hard negatives by a full sort of each anchor's scores.

Every row is scored against every anchor, as an integer inner product. The scores of an anchor with a block of rows are
sorted by score and id; a binary search finds where a positive's upper limit begins, and the next rows of another label
are read on down to its lower limit. Blocks, then tasks, then partitions are merged with the same order, which gives the
sort of all scores without ever holding it. Anchors go out in groups of GROUP_BYTES, the only thing that is
broadcast; each group reads the rows twice, for its positives and for their negatives, and no vector is shuffled.

Defined cases: rows with a null label, vector or component, or a component that is not finite, take no part, nor do
rows without an id; vectors of unequal length are taken as if zeros followed the shorter; empty vectors score 0; scores
beyond a long are held at its limits. An anchor is never its own positive, nor is another row with its id; rows that
repeat an id count each, as anchors too. Ties go to the smaller id. An anchor without positives, and a positive without
negatives, give no rows; an empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialise, scratch, session, tidy

#: A vector's components are floor(SCALE * x).
SCALE = 256
#: Anchors that are broadcast at once.
GROUP_BYTES = 16 << 20
#: Anchors and rows whose scores are sorted at once.
ANCHORS, ROWS = 128, 8192

#: Stands for no entry; scores stay above it.
NONE = np.iinfo(np.int64).min

_ROWS = "vec_id long, label long, vector array<double>"


@lean
def _quantise(batches):
    """vec_id, label, vector of the rows that take part; the columns of a batch come in this order."""
    for batch in batches:
        ids, labels, vectors = batch.columns
        offsets = vectors.offsets.to_numpy().astype(np.int64)
        flat = pc.cast(vectors.values, pa.float64(), safe=False)
        values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        keep = (bad[offsets[1:]] == bad[offsets[:-1]]) & pc.and_(pc.and_(ids.is_valid(), labels.is_valid()), vectors.is_valid()).to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.nan_to_num(np.floor(values * SCALE))
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(whole))
        out = pa.record_batch([ids, labels.cast(pa.int64()), lists], names=["vec_id", "label", "vector"])
        yield out.filter(pa.array(keep))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Row by row, short vectors padded with zeros."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values, sizes = lists.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return values[offsets[0]:offsets[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values[offsets[0]:offsets[-1]]
    return out


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as longs: in floating point as long as no sum can be rounded."""
    width = min(anchors.shape[1], rows.shape[1])
    anchors, rows = anchors[:, :width], rows[:, :width]
    largest = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * width
    for kind, exact in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
        if largest < exact:
            return (anchors.astype(kind) @ rows.astype(kind).T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in side] for side in (anchors, rows)]
    return np.array([[min(max(sum(x * y for x, y in zip(a, b, strict=True)), NONE + 1), -(NONE + 1)) for b in whole[1]] for a in whole[0]], np.int64).reshape(len(anchors), len(rows))


def _ordered(scores: np.ndarray) -> np.ndarray:
    """Columns of each row of `scores`, highest first; columns are in the order of their ids already."""
    bits = max(1, int(scores.shape[1] - 1).bit_length())
    if scores.size and max(int(scores.max()), -int(scores.min())) < 1 << (62 - bits):
        keys = (-scores << bits) | np.arange(scores.shape[1])  # one number for score and place sorts many times faster
        keys.sort(axis=1)
        return keys & ((1 << bits) - 1)
    return np.argsort(-scores, axis=1, kind="stable")


def _merge(best: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Of two arrays of (score, id) pairs, the first of each row in the order of score, then id; as many as in `best`."""
    both = np.concatenate([best, found], axis=1)
    score, ids = both[:, :, 0], both[:, :, 1]
    order = np.lexsort((ids, -score, score == NONE), axis=1)[:, : best.shape[1]]
    return np.take_along_axis(both, order[:, :, None], axis=1)


def _blocks(batches):
    """ids, labels and vectors of at most ROWS rows, in the order of ids."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids = part.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            yield ids[order], part.column(1).to_numpy()[order], _matrix(part.column(2))[order]


def _rows_of(best: np.ndarray, keys: dict[str, np.ndarray]):
    """A batch of the entries of `best` (slots, k, 2) that are set, with the slot's keys."""
    slot, place = np.nonzero(best[:, :, 0] != NONE)
    columns = {name: pa.array(values[slot]) for name, values in keys.items()}
    return pa.record_batch(columns | {"score": pa.array(best[slot, place, 0]), "id": pa.array(best[slot, place, 1])})


def _best_same(anchors, most: int):
    """The task's first rows of each anchor's label, other than itself."""

    @lean
    def run(batches):
        ids, labels, vectors = anchors.value
        best = np.full((len(ids), most, 2), NONE)
        for row_ids, row_labels, rows in _blocks(batches):
            for at in range(0, len(ids), ANCHORS):
                part = slice(at, at + ANCHORS)
                scores = _scores(vectors[part], rows)
                order = _ordered(scores)
                found = np.full((len(order), most, 2), NONE)
                fits = (row_labels[order] == labels[part, None]) & (row_ids[order] != ids[part, None])
                for i in range(len(order)):
                    chosen = order[i, np.flatnonzero(fits[i])[:most]]
                    found[i, : len(chosen), 0], found[i, : len(chosen), 1] = scores[i, chosen], row_ids[chosen]
                best[part] = _merge(best[part], found)
        yield _rows_of(best, {"slot": np.arange(len(ids))})

    return run


def _best_other(anchors, limits, k: int):
    """The task's first k rows of another label between the limits of each positive. limits: anchor's slot, low, high."""

    @lean
    def run(batches):
        ids, labels, vectors = anchors.value
        slots, low, high = limits.value
        starts = np.searchsorted(slots, np.arange(len(ids) + 1))
        best = np.full((len(slots), k, 2), NONE)
        for row_ids, row_labels, rows in _blocks(batches):
            for at in range(0, len(ids), ANCHORS):
                to = min(at + ANCHORS, len(ids))
                mine = slice(starts[at], starts[to])
                scores = _scores(vectors[at:to], rows)
                order = _ordered(scores)
                found = np.full((starts[to] - starts[at], k, 2), NONE)
                for i in range(to - at):
                    falling = -scores[i, order[i]]
                    others = np.flatnonzero(row_labels[order[i]] != labels[at + i])
                    for p in range(starts[at + i], starts[at + i + 1]):
                        first = np.searchsorted(others, np.searchsorted(falling, -high[p], "left"))
                        chosen = others[first:first + k]
                        chosen = order[i, chosen[falling[chosen] <= -low[p]]]
                        found[p - starts[at], : len(chosen), 0], found[p - starts[at], : len(chosen), 1] = scores[i, chosen], row_ids[chosen]
                best[mine] = _merge(best[mine], found)
        yield _rows_of(best, {"pair": np.arange(len(slots))})

    return run


def _first(found: DataFrame, slot: str, most: int) -> DataFrame:
    """The first rows of each slot over all tasks, numbered by `rank`."""
    order = Window.partitionBy(slot).orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _held(limit: int) -> int:
    return min(max(limit, NONE + 1), -(NONE + 1))


@tidy
def mine(rows: DataFrame, anchors: Column, positives: int = 5, k: int = 3, lower: int = 50, upper: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows (vec_id, label, embedding).

    Anchors are the rows where `anchors` holds. Negatives score from `lower` to `upper` percent of their positive.
    """
    spark = session()
    sc = spark.sparkContext
    rows = materialise(rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(_quantise, _ROWS), "rows")
    asked = rows.filter(F.coalesce(anchors, F.lit(False)))
    size = asked.agg(F.sum(F.size("vector") * 8 + 16)).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    # groups by a hash of the place: ids may repeat
    asked = materialise(asked.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))), "anchors")
    out, schema = scratch(spark, "negatives"), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for group in range(groups):
        mine_now = asked.filter(F.col("group") == group).select("vec_id", "label", "vector").toArrow().combine_chunks()
        if not mine_now.num_rows:
            continue
        ids = mine_now["vec_id"].to_numpy()
        sent = sc.broadcast((ids, mine_now["label"].to_numpy(), _matrix(mine_now["vector"].combine_chunks())))
        best = rows.mapInArrow(_best_same(sent, positives), "slot long, score long, id long")
        found = _first(best, "slot", positives).orderBy("slot", "rank").select("slot", "score", "id").toArrow()
        slots, scores, pos_ids = (found[c].to_numpy() for c in ("slot", "score", "id"))
        low = np.array([_held(-(-lower * int(s) // 100)) for s in scores], np.int64)
        high = np.array([_held(upper * int(s) // 100) for s in scores], np.int64)
        bounds = sc.broadcast((slots, low, high))
        best = rows.mapInArrow(_best_other(sent, bounds, k), "pair long, score long, id long")
        pairs = spark.createDataFrame(pa.table({"pair": np.arange(len(slots)), "anchor_id": ids[slots], "positive_id": pos_ids, "positive_score": scores}))
        chosen = _first(best, "pair", k).join(F.broadcast(pairs), "pair")
        chosen.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
        sent.destroy()
        bounds.destroy()
    return spark.read.schema(schema).parquet(out)
