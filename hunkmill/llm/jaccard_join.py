"""Exact self-join of documents on the Jaccard similarity of their word 5-grams, as a metric-space join.

1 - J is a metric. Documents with the same set form one class; the join of the classes runs in these steps:

1. Cells. Documents without a common shingle are all at distance 1, which pivots cannot tell apart, so the first cells
   come from rare shingles: each class lists its shingles in one global order, rare ones first, and two sets that link
   share one of the first n - ceil(0.8 n) + 1. All classes with such a shingle in common form the cell of its least class.
2. Voronoi regions. In every cell of more than SMALL classes PIVOTS pivots are drawn, and each class is measured once
   against them (a linear pass, dealt by parts of a cell). Classes within 0.2 of a pivot, its ball, link with it and
   belong to the region of the nearest such pivot. By the triangle inequality whatever else links with the ball lies
   within 0.4 of the pivot: these boundary classes are replicated into the region, and ball and boundary are joined
   where their distances to the pivot leave room. With that all links of the ball are known.
3. Recursion. Classes in no ball are left in the cell, which is joined again with new pivots, until it is small or its
   balls take in less than a fifth, for TURNS turns at most. What is left goes to tasks of CELL classes and is joined there by the same
   recursion, one pivot at a time. Only classes that share a rare shingle but hardly resemble one another reach this
   with more than CELL members; they are dealt in blocks and cost the square of their number, as in any metric index.
4. Slices of the hash space are pivot sets too: sets that link differ by a ninth of the sum of their sizes, so members
   whose numbers of shingles by slice differ by more from all others in the task are left out before sets are read.
5. Links, a spanning set per region, are joined to components by spreading the least label with pointer jumping.

No step gathers a hot key: shingles and cells that many classes share are counted by aggregation and met by a bounded
broadcast, cells are dealt by parts, labels of nodes with many links are looked up by broadcast.

Defined cases: with fewer than five words the whole sequence is the one shingle; without words or with null text
the set is empty, links to nothing and is its own component; equal sets (repeated rows too) link; a class of rows
with null ids only has a null component; a text of any length is one set, in memory alone in its piece; an empty
table gives an empty result; other columns, whatever their names, play no part. Shingles and classes are told apart
by 64-bit hashes.
"""

from __future__ import annotations

import functools
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, arrow_rows, bit_set, bits_for, has_bit, lean, materialise, pieces, tidy, trim, with_groups, without_gc, words_of

WIDTH = 5
#: Link at 100 * |intersection| >= 80 * |union|, so |intersection| >= 4 / 9 of the sum of sizes.
NEAR, RADIUS = 0.8, 0.2
#: Shingles known to repeat, at most; the order of the rest is by hash alone. It affects speed, not results.
KNOWN = 1 << 20
#: Shingles that a task counts together.
COUNTED = 2_500_000
#: Members of a cell that one task joins; cells above SMALL get pivots first, PIVOTS a turn, measured in parts of PART.
CELL, SMALL, PIVOTS, PART = 2000, 256, 8, 256
#: Shingles that a task takes together, in cells of long documents: its memory is some ten times 8 bytes each.
WEIGHT = 2_000_000
#: Turns of new pivots, and the share of a cell that a turn must take in for another one.
TURNS, WORTH = 3, 0.2
#: A shingle of fewer classes, or of a thousandth of all rows, is sorted to leave out members by size; others are met by broadcast.
SORTED = 10_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers of a window's places.
PLACES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and the sorted distinct shingle hashes of each text, one after the other."""
    ends, flat = words_of(texts)
    coded = flat.dictionary_encode()
    with without_gc():
        known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = known[coded.indices.to_numpy()]
    size = np.diff(ends)
    windows = np.zeros(len(h), np.uint64)
    full = max(0, len(h) - WIDTH + 1)
    for k in range(WIDTH):
        windows[:full] += h[k:k + full] * PLACES[k]
    windows = _mix(windows)
    out, count = [], np.zeros(len(size), np.int64)
    for i, (a, n) in enumerate(zip(ends[:-1].tolist(), size.tolist(), strict=True)):
        if n >= WIDTH:
            own = windows[a:a + n - WIDTH + 1]
            own.sort()
            if n > WIDTH:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n:
            # The whole sequence as one shingle, told apart from windows by its length.
            own = _mix((h[a:a + n] * np.array(PLACES[:n])).sum(keepdims=True) + np.uint64(n))
        else:
            continue
        out.append(own)
        count[i] = len(own)
    return np.concatenate([[0], np.cumsum(count)]), (np.concatenate(out) if out else np.zeros(0, np.uint64)).view(np.int64)


def _class(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64)) if len(own) else 0


PROFILE = "kind int, doc_id {id}, n int, value long, counts binary"
#: Slices of the hash space; the numbers of a set's shingles in each are its profile.
SLICES = 256


def _counts(own: np.ndarray) -> bytes:
    """Shingles in each slice, 255 at most. Two sets differ in at least the sum of the profiles' differences, since
    each slice is a pivot set whose distances bound theirs."""
    return np.minimum(np.bincount((own.view(np.uint64) >> np.uint64(56)).astype(np.int64), minlength=SLICES), 255).astype(np.uint8).tobytes()


def _repeats(held: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
    found, times = np.unique(np.concatenate(held), return_counts=True)
    found, times = found[times >= 2], times[times >= 2]
    return pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), np.int32)), pa.nulls(len(found), kind), pa.array(times, pa.int32()), pa.array(found), pa.nulls(len(found), pa.binary())], names=["kind", "doc_id", "n", "value", "counts"])


def _profile(batches):
    """kind 0: each document's class and set size; kind 1: shingles that repeat among the sets of a task (or of
    COUNTED shingles of it), with their number as n."""
    held, count, kind = [], 0, None
    for batch in batches:
        kind = batch.column("doc_id").type
        for part in pieces(batch, "text", 2_000_000):
            offsets, values = shingle_sets(part.column("text"))
            classes = [_class(values[a:b]) for a, b in pairwise(offsets)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(part), np.int32)), part.column("doc_id"), pa.array(np.diff(offsets), pa.int32()), pa.array(classes, pa.int64()), pa.array([_counts(values[a:b]) for a, b in pairwise(offsets)], pa.binary())], names=["kind", "doc_id", "n", "value", "counts"])
            held.append(values)
            count += len(values)
            if count > COUNTED:
                yield _repeats(held, kind)
                held, count = [], 0
    if held:
        yield _repeats(held, kind)


def _prefixes(known):
    """Each class once a piece: its first shingles in the global order and their places."""

    def run(batches):
        hashes, times = known.value
        for batch in batches:
            for part in pieces(batch, "text", 2_000_000):
                offsets, values = shingle_sets(part.column("text"))
                seen: set[int] = set()
                out = []
                place = np.minimum(np.searchsorted(hashes, values), max(len(hashes) - 1, 0))
                rank = np.where(hashes[place] == values, times[place], 0) if len(hashes) else np.zeros(len(values), np.int64)
                # Times seen, then the hash mixed anew, as one number.
                key = (np.minimum(rank, (1 << 20) - 1).astype(np.uint64) << np.uint64(44)) | (_mix(values.view(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(20))
                for a, b in pairwise(offsets):
                    n = int(b - a)
                    if not n or (c := _class(values[a:b])) in seen:
                        continue
                    seen.add(c)
                    first, own = n - (4 * n + 4) // 5 + 1, key[a:b]
                    order = np.argpartition(own, first - 1)[:first] if first < n else np.arange(n)
                    # Equal keys (44 bits of hash) are ordered by the hash itself, so all sets agree.
                    order = order[np.lexsort((values[a:b][order], own[order]))]
                    out.append((np.full(len(order), c), np.full(len(order), n), np.arange(len(order)), values[a:b][order]))
                if out:
                    c, n, at, value = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(at, pa.int32())], names=["shingle", "class", "n", "at"])

    return run


def _sets(batches):
    for batch in batches:
        for part in pieces(batch, "text", 2_000_000):
            offsets, values = shingle_sets(part.column("text"))
            blobs = [values[a:b].tobytes() for a, b in pairwise(offsets)]
            yield pa.RecordBatch.from_arrays([pa.array([_class(values[a:b]) for a, b in pairwise(offsets)], pa.int64()), pa.array(blobs, pa.binary())], names=["class", "shingles"])


def join_region(sets: list[np.ndarray], left: np.ndarray | None = None, ball: bool = True) -> list[tuple[int, int]]:
    """Links that connect what the exact join of the sets connects. left: one of two sides; then only links between the
    sides count. With `ball` that side is connected already, so one link of each other member with it is enough."""
    m = len(sets)
    size = np.fromiter(map(len, sets), np.int64, m)
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(local, kind="stable")
    posting = np.repeat(np.arange(m), size)[order]
    start = np.searchsorted(local[order], np.arange(local.max() + 2))
    first = np.cumsum(size) - size

    def common(i: int) -> np.ndarray:
        own = local[first[i]:first[i] + size[i]]
        n = start[own + 1] - start[own]
        at = np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(posting[at], minlength=m)

    def near(i: int, shared: np.ndarray) -> np.ndarray:
        return 9 * shared >= 4 * (size + size[i])

    links: list[tuple[int, int]] = []
    parent, waiting = np.arange(m), np.ones(m, bool)

    def connect(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = parent[i], parent[j]
            if a != b:
                links.append((i, j))
                parent[parent == b] = a

    if left is not None:
        few = left if left.sum() <= m - left.sum() else ~left
        done = np.zeros(m, bool)
        for i in np.nonzero(few)[0].tolist():
            if not ball:
                connect(i, np.nonzero(near(i, common(i)) & ~few & (parent != parent[i]))[0])
                continue
            found = np.nonzero(near(i, common(i)) & (few != few[i]) & ~done)[0].tolist()
            if left[i]:
                links += [(i, j) for j in found]
                done[found] = True
            elif found:
                links.append((i, found[0]))
        return links
    for pivot in range(m):
        if not waiting[pivot]:
            continue
        shared = common(pivot)
        distance = 1 - shared / (size + size[pivot] - shared)
        linked = near(pivot, shared)
        connect(pivot, np.nonzero(linked)[0])
        own, shell = linked & waiting, ~linked & waiting & (distance <= 2 * RADIUS + 1e-9)
        own[pivot] = False
        for i in np.nonzero(own)[0].tolist() if shell.any() else ():
            room = shell & (distance <= distance[i] + RADIUS + 1e-9) & (5 * size >= 4 * size[i]) & (4 * size <= 5 * size[i]) & (parent != parent[i])
            if room.any():
                connect(i, np.nonzero(room & near(i, common(i)))[0])
        # All links of the ball are known; the rest is joined without it.
        waiting[own] = waiting[pivot] = False
    return links


def _groups(batches, keys: tuple[str, ...]):
    """The groups of rows sorted by keys, each as a table once it is complete; it may span batches."""
    held: list[pa.RecordBatch] = []

    def cut(rows: pa.Table) -> list[pa.Table]:
        key = np.stack([rows.column(c).to_numpy() for c in keys], 1)
        ends = [0, *(np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1), len(key)]
        return [rows.slice(a, b - a) for a, b in pairwise(ends)]

    for batch in batches:
        if len(batch):
            held.append(batch)
            groups = cut(pa.Table.from_batches(held))
            yield from groups[:-1]
            held = groups[-1].to_batches()
    if held:
        yield from cut(pa.Table.from_batches(held))


REGION = ("region", "low", "high")
#: Blocks of a boundary are told from those of a ball, or of a cell, by their numbers.
EDGE = 1 << 20


def _once(rows: pa.Table):
    """Classes, their first rows, and which lie in the ball (or in the lower block); None within one block."""
    classes, once = np.unique(rows.column("class").to_numpy(), return_index=True)
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    left = None if low == high else rows.column("block").to_numpy()[once] == low
    return classes, once, left


def may_link(size: np.ndarray, counts: np.ndarray, left: np.ndarray | None) -> np.ndarray:
    """Members with a partner that sizes and profiles allow: linked sets differ in a ninth of the sum of sizes at most."""
    out = np.zeros(len(size), bool)
    order = np.argsort(size, kind="stable")
    n, c = size[order], counts[order].astype(np.int16)
    upto = np.searchsorted(4 * n, 5 * n, "right")
    for i in range(len(n)):
        j = np.arange(i + 1, upto[i])
        if left is not None:
            j = j[left[order[j]] != left[order[i]]]
        if len(j):
            near = np.abs(c[j] - c[i]).sum(1, dtype=np.int64) * 9 <= n[j] + n[i]
            if near.any():
                out[order[i]] = True
                out[order[j[near]]] = True
    return out


def _sift(batches):
    for rows in _groups(batches, REGION):
        _, once, left = _once(rows)
        counts = np.frombuffer(b"".join(rows.column("counts")[int(i)].as_py() for i in once), np.uint8).reshape(-1, SLICES)
        kept = may_link(rows.column("n").to_numpy()[once].astype(np.int64), counts, left)
        if kept.any():
            yield from rows.select([*REGION, "class", "block"]).take(pa.array(once[kept])).combine_chunks().to_batches()


def _set(rows: pa.Table, i) -> np.ndarray:
    return np.frombuffer(rows.column("shingles")[int(i)].as_py(), np.int64)


def _bound(batches):
    """Members of a part of a cell and the pivots that their sizes and profiles allow within 0.4: a bound without sets."""
    for rows in _groups(batches, ("cell", "part")):
        pivot = rows.column("pivot").to_numpy(zero_copy_only=False)
        classes, n = rows.column("class").to_numpy(), rows.column("n").to_numpy().astype(np.int64)
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint8).reshape(-1, SLICES).astype(np.int16)
        members = np.nonzero(~pivot)[0]
        for q in np.nonzero(pivot)[0]:
            near = members[np.abs(counts[members] - counts[q]).sum(1, dtype=np.int64) * 4 <= n[members] + n[q]]
            if len(near):
                same = pa.array(np.full(len(near), rows.column("cell")[0].as_py()), pa.int64()), pa.array(np.full(len(near), rows.column("part")[0].as_py()), pa.int32())
                yield pa.RecordBatch.from_arrays([*same, pa.array(classes[near]), pa.array(np.full(len(near), classes[q]))], names=["cell", "part", "class", "near"])


def _measure(batches):
    """Members of a part of a cell against its pivots: the nearest ball they lie in (home), and the pivots within 0.4."""
    for rows in _groups(batches, ("cell", "part")):
        pivot = rows.column("pivot").to_numpy(zero_copy_only=False)
        classes = rows.column("class").to_numpy()
        heads = np.nonzero(pivot)[0]
        sets = [_set(rows, i) for i in heads]
        known = np.unique(np.concatenate(sets))
        holds = np.zeros((len(known), len(sets)), np.int32)
        for k, own in enumerate(sets):
            holds[np.searchsorted(known, own), k] = 1
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        out = []
        for i in np.nonzero(~pivot)[0]:
            own = _set(rows, i)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            shared = holds[at[known[at] == own]].sum(0, dtype=np.int64)
            linked, distance = 9 * shared >= 4 * (n + len(own)), 1 - shared / (n + len(own) - shared)
            beside = np.nonzero(16 * shared >= 6 * (n + len(own)))[0]
            best = int(np.argmin(np.where(linked, distance, 2.0)))
            home = int(classes[heads[best]]) if linked[best] else None
            out.append((int(classes[i]), len(own), home, float(distance[best]), [{"pivot": int(classes[heads[k]]), "distance": float(distance[k]), "linked": bool(linked[k])} for k in beside]))
        if out:
            near = pa.list_(pa.struct([("pivot", pa.int64()), ("distance", pa.float64()), ("linked", pa.bool_())]))
            c, sizes, home, d, beside = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([rows.column("cell")[0].as_py()] * len(c), pa.int64()), pa.array(c, pa.int64()), pa.array(sizes, pa.int32()), pa.array(home, pa.int64()), pa.array(d), pa.array(beside, near)], names=["cell", "class", "n", "home", "distance", "near"])


MEASURED = "cell long, class long, n int, home long, distance double, near array<struct<pivot:long,distance:double,linked:boolean>>"


def _join_regions(batches):
    for rows in _groups(batches, REGION):
        classes, once, left = _once(rows)
        # Two blocks of a cell are not connected beforehand, as a ball is.
        links = join_region([_set(rows, i) for i in once], left, rows.column("high")[0].as_py() >= EDGE) if len(classes) > 1 else []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(classes[[x for x, _ in links]]), pa.array(classes[[y for _, y in links]])], names=["a", "b"])


@tidy
def components(links: DataFrame) -> DataFrame:
    """node, label (least node of its component) of every node of links (a, b)."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    total = both.count()
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"), F.count(F.lit(1)).alias("degree")), "labels")
    while True:
        # The least label among the neighbours, then the label's own label.
        near = with_groups(both, labels.withColumnRenamed("node", "b"), ["b"], "degree", total).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = materialise(labels.join(near, "node").select("node", "degree", "label", F.least("label", "near").alias("new")), "steps")
        far = labels.select(F.col("node").alias("new"), F.col("label").alias("far")).join(step.groupBy("new").agg(F.count(F.lit(1)).alias("rows")), "new")
        step = materialise(with_groups(step, far, ["new"], "rows", total).select("node", "degree", F.least("new", "far").alias("next"), F.col("label").alias("was")), "labels")
        moved = step.filter("next <> was").limit(1).count()
        labels = step.select("node", F.col("next").alias("label"), "degree")
        if not moved:
            return labels.select("node", "label")


def cells(docs: DataFrame, known) -> DataFrame:
    """pivot, class, n (its shingles), members and weight (classes and shingles of the cell): the members of each cell that
    may link with someone there. known: a broadcast, which is destroyed when prefixes are written."""
    prefixes = materialise(docs.mapInArrow(lean(_prefixes(known)), "shingle long, class long, n int, at int"), "prefixes")
    known.destroy()  # the driver's two processes and all workers hold it
    del known
    trim()
    shared = prefixes.groupBy("shingle").agg(F.min("class").alias("pivot"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    shared = materialise(shared, "shared-shingles")
    # Most shingles of a prefix are one class's alone: only rows of the others are shuffled again.
    size = bits_for(shared.count())
    place = F.pmod(F.xxhash64("shingle"), F.lit(size))
    rows = has_bit(prefixes.withColumn("p", place), "p", bit_set(shared.select(place.alias("p")).distinct(), "p"), size, "in").filter("in").drop("p", "in")
    rows = materialise(rows, "holders")
    floor = max(SORTED, int(rows.count() * HOT_SHARE))
    hot, cold = F.broadcast(shared.filter(F.col("k") >= floor)), shared.filter(F.col("k") < floor)
    few = rows.join(hot.select("shingle"), "shingle", "left_anti").join(cold.hint("merge"), "shingle")
    by_size = Window.partitionBy("shingle").orderBy("n", "class")
    beside = F.struct("n", "at")
    few = few.withColumn("less", F.lag(beside).over(by_size)).withColumn("more", F.lead(beside).over(by_size))
    # In a region of two, both places decide: what is left of either list holds 4 / 9 of the sum of sizes. In others a
    # smaller partner has 4 / 5 of the size at least, and with a larger one the shingle is in the first ninth.
    other = F.coalesce("less", "more")
    two = F.least(F.col("n") - F.col("at"), other["n"] - other["at"]) * 9 >= (F.col("n") + other["n"]) * 4
    some = (F.col("less.n") * 5 >= F.col("n") * 4) | ((F.col("more.n") * 4 <= F.col("n") * 5) & (F.col("at") * 9 <= F.col("n")))
    few = few.filter(F.when(F.col("k") == 2, two).otherwise(some)).select("pivot", "class", "n")
    pairs = few.unionByName(rows.join(hot, "shingle").select("pivot", "class", "n"))
    pairs = materialise(pairs.filter("pivot <> class").distinct(), "cells")
    mean = F.avg("n")
    sizes = materialise(pairs.groupBy("pivot").agg((F.count(F.lit(1)) + 1).alias("members"), (F.sum("n") + mean).alias("weight"), mean.alias("n")), "cell-sizes")
    out = with_groups(pairs.withColumn("n", F.col("n").cast("double")), sizes.drop("n"), ["pivot"], "members", pairs.count())
    # The pivot's own size counts as the mean of the others', which it is near.
    return materialise(out.unionByName(sizes.select("pivot", F.col("pivot").alias("class"), "n", "members", "weight")), "members")


def _known(spark, often: DataFrame):
    """The KNOWN most frequent shingles and their numbers, sorted by hash, on all workers. Numbers are cut at a level
    of their logarithm; of the level that does not fit a share by hash is taken. The driver sees one row a level."""
    level = F.floor(F.log2("n") * 16).cast("int")
    room, cut, share = KNOWN, -1, 1.0
    for r in often.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("level")).collect():
        if r.k > room:
            cut, share = r.level, room / r.k
            break
        room -= r.k
    some = F.pmod(F.xxhash64("value"), F.lit(1 << 20)) < int(share * (1 << 20))
    found = often.filter((level > cut) | ((level == cut) & some)).toArrow()
    value, n = found["value"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(value)
    known = spark.sparkContext.broadcast((value[order], n[order].astype(np.int64)))
    del found, value, n, order
    trim()
    return known


def _sifted(tasks: DataFrame, firsts: DataFrame) -> DataFrame:
    sized = tasks.join(firsts.select("class", "n", "counts").hint("merge"), "class").repartition(*REGION).sortWithinPartitions(*REGION)
    return materialise(sized.select(*REGION, "class", "block", "n", "counts").mapInArrow(lean(_sift), "region long, low int, high int, class long, block int"), "sifted")


def _parts(classes, shingles, cell: int) -> Column:
    return F.greatest(F.ceil(F.col(classes) / F.lit(cell)), F.ceil(F.col(shingles) / F.lit(WEIGHT))).cast("int")


def _dealt(left: DataFrame, cell: int) -> DataFrame:
    """Tasks for the members of cells (cell, class, members, weight): one for a cell up to `cell` members and WEIGHT
    shingles, else one a pair of blocks."""
    parts = _parts("members", "weight", cell)
    own = F.pmod(F.xxhash64("class"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(F.least(i, own).alias("low"), F.greatest(i, own).alias("high")))
    return left.select(F.col("cell").alias("region"), "class", own.alias("block"), F.explode(pairs).alias("x")).select("region", "x.low", "x.high", "class", "block")


def _regions(found: DataFrame, cell: int, total: int) -> DataFrame:
    """Tasks that join each pivot's ball with its boundary, from measured members; most balls have no boundary."""
    ball = found.filter("home is not null").select(F.col("home").alias("pivot"), "class", "distance", "n")
    edge = found.select("class", "n", F.explode("near").alias("x")).filter("not x.linked").select("x.pivot", "class", "x.distance", "n")
    nearest = edge.groupBy("pivot").agg(F.count(F.lit(1)).alias("outer"), F.sum("n").alias("outer_n"), F.min("distance").alias("least"))
    sizes = ball.groupBy("pivot").agg(F.count(F.lit(1)).alias("inner"), F.sum("n").alias("inner_n")).join(nearest, "pivot")
    sizes = materialise(sizes.withColumn("rows", F.col("inner") + F.col("outer")), "region-sizes")
    inner, outer = _parts("inner", "inner_n", cell), _parts("outer", "outer_n", cell)
    ball = with_groups(ball, sizes, ["pivot"], "rows", total).filter(F.col("distance") >= F.col("least") - RADIUS - 1e-9)
    mine = F.pmod(F.xxhash64("class"), inner).cast("int")
    ball = ball.select(F.col("pivot").alias("region"), mine.alias("low"), F.explode(F.sequence(F.lit(EDGE), outer + EDGE - 1)).alias("high"), "class", mine.alias("block"))
    edge = with_groups(edge, sizes, ["pivot"], "rows", total)
    mine = (F.pmod(F.xxhash64("class"), outer) + EDGE).cast("int")
    edge = edge.select(F.col("pivot").alias("region"), F.explode(F.sequence(F.lit(0), inner - 1)).alias("low"), mine.alias("high"), "class", mine.alias("block"))
    return ball.unionByName(edge)


def voronoi(large: DataFrame, firsts: DataFrame, docs: DataFrame, cell: int, small: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Cells (cell, class) by pivots, balls and boundaries: links (a, b), and the tasks that are left to join."""
    links, tasks = [], []
    for turn in range(TURNS + 1):
        large = materialise(large, "open")
        total = large.count()
        if not total:
            break
        sizes = materialise(large.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"), F.min("was").alias("was")), "open-sizes")
        # A cell is done once it is small, or when its last pivots took in too little.
        done = F.lit(turn == TURNS) | (F.col("members") <= small) | F.coalesce(F.col("members") > F.col("was") * (1 - WORTH), F.lit(False))
        sized = materialise(with_groups(large.drop("was"), sizes.withColumn("done", done), ["cell"], "members", total), "open-sized")
        tasks.append(_dealt(sized.filter("done"), cell))
        sized = sized.filter("not done").select("cell", "class", "n", "members", "weight")
        h = F.xxhash64(F.lit(turn), F.col("class"))
        pivots = sized.groupBy("cell", F.pmod(h, F.lit(PIVOTS))).agg(F.min(F.struct(h.alias("h"), "class")).alias("m"), F.first("members").alias("members"), F.first("weight").alias("weight"))
        parts = _parts("members", "weight", PART)
        rows = sized.select("cell", "class", F.pmod(F.xxhash64("class"), parts).cast("int").alias("part"), F.lit(False).alias("pivot"))
        rows = rows.unionByName(pivots.select("cell", "m.class", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("pivot")))
        rows = rows.join(firsts.select("class", "n", "counts").hint("merge"), "class").repartition("cell", "part").sortWithinPartitions("cell", "part")
        rows = rows.select("cell", "part", "class", "pivot", "n", "counts")
        near = materialise(rows.mapInArrow(lean(_bound), "cell long, part int, class long, near long"), "bounds")
        # Sets are read for those alone that the bound leaves near a pivot.
        rows = near.select("cell", "part", "class", F.lit(False).alias("pivot")).unionByName(near.select("cell", "part", F.col("near").alias("class"), F.lit(True).alias("pivot"))).distinct()
        rows = rows.join(sets_of(docs, firsts, rows.select("class")).hint("merge"), "class").repartition("cell", "part").sortWithinPartitions("cell", "part")
        found = materialise(rows.select("cell", "part", "class", "pivot", "shingles").mapInArrow(lean(_measure), MEASURED), "measured")
        links.append(found.select("class", F.explode("near").alias("x")).filter("x.linked and x.pivot <> class").select(F.col("x.pivot").alias("a"), F.col("class").alias("b")))
        tasks.append(_regions(found, cell, total))
        homes = found.filter("home is not null").select("cell", "class")
        large = sized.join(homes, ["cell", "class"], "left_anti").select("cell", "class", "n", F.col("members").alias("was"))
    return links, tasks


def sets_of(docs: DataFrame, firsts: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, shingles of the wanted classes, from one document of each, found by its id."""
    wanted = materialise(wanted.distinct(), "wanted")
    bits = bits_for(docs.select(F.lit(1)).count())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    marked = bit_set(wanted.join(firsts.select("class", "doc_id"), "class").select(place.alias("p")).distinct(), "p")
    some = has_bit(docs.select("doc_id", "text").withColumn("p", place), "p", marked, bits, "in").filter("in").select("text")
    sets = some.mapInArrow(lean(_sets), "class long, shingles binary").join(wanted.hint("merge"), "class", "left_semi")
    # Documents of one id may have several sets, and equal ones count once.
    return sets.dropDuplicates(["class"])


def links_of(docs: DataFrame, profile: DataFrame, cell: int = CELL, small: int = SMALL) -> DataFrame:
    """a, b: classes that link; what is connected by all links is connected by these."""
    spark = docs.sparkSession
    often = materialise(profile.filter("kind = 1").groupBy("value").agg(F.sum("n").alias("n")), "often")
    members = cells(docs.select("text"), _known(spark, often))
    # Profiles of classes that lie in a cell; the others are not shuffled.
    kept = materialise(members.select("class").distinct(), "kept")
    bits = bits_for(kept.count())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    firsts = has_bit(profile.filter("kind = 0").withColumn("p", place("value")), "p", bit_set(kept.select(place("class").alias("p")).distinct(), "p"), bits, "in").filter("in")
    firsts = materialise(firsts.groupBy(F.col("value").alias("class")).agg(F.min(F.struct("doc_id", "n", "counts")).alias("f")).select("class", "f.*"), "firsts")
    large = members.filter(F.col("members") > small).select(F.col("pivot").alias("cell"), "class", "n", F.lit(None).cast("long").alias("was"))
    links, tasks = voronoi(large, firsts, docs, cell, small)
    tasks.append(_dealt(members.filter(F.col("members") <= small).select(F.col("pivot").alias("cell"), "class", "members", "weight"), cell))
    tasks = _sifted(functools.reduce(DataFrame.unionByName, tasks), firsts)
    rows = tasks.join(sets_of(docs, firsts, tasks.select("class")).hint("merge"), "class").repartition(*REGION).sortWithinPartitions(*REGION)
    out = rows.select(*REGION, "class", "block", "shingles").mapInArrow(lean(_join_regions), "a long, b long")
    return functools.reduce(DataFrame.unionByName, links, out)


@tidy
def near_components(docs: DataFrame, cell: int = CELL, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    with arrow_rows(docs.sparkSession, 128):  # a row has a whole text or set
        profile = materialise(docs.mapInArrow(lean(_profile), PROFILE.format(id=kind)), "profile")
        links = materialise(links_of(docs, profile, cell, small), "edges")
    labels = components(links)
    rows = profile.filter("kind = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("value").alias("class"))
    full = rows.filter("n_shingles > 0")
    classes = full.groupBy("class").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    classes = materialise(classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class")), "classes")
    least = materialise(classes.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("parts")), "least")
    classes = with_groups(classes, least, ["label"], "parts", classes.count())
    found = with_groups(full, classes.select("class", "component_id", "rows"), ["class"], "rows", rows.count())
    return found.select("doc_id", "n_shingles", "component_id").unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_near_copies(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """The rows of docs whose id is the least of its component, with all their columns. Rows that repeat an id
    stay or go together; documents that no other resembles are not shuffled."""
    gone = materialise(near_components(docs, cell).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    bits = bits_for(docs.select(F.lit(1)).count())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("__p", place("row.doc_id"))
    rows = has_bit(rows, "__p", bit_set(gone.select(place("__gone").alias("p")).distinct(), "p"), bits, "__in")
    sure, maybe = rows.filter("not __in"), rows.filter("__in")
    return sure.select("row.*").unionByName(maybe.join(gone, maybe["row.doc_id"] == F.col("__gone"), "left_anti").select("row.*"))
