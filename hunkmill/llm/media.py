"""Copies among images, cropped, turned and edited ones too, by local descriptors.

Corners (Harris) are found at several scales, their number growing with the pixels. Each is turned to its patch's
orientation, by the exact angle, and described by 256 comparisons of smoothed pixels, which a change of brightness or
contrast leaves as they are. Images then meet in these steps:

1. Hamming tables. A descriptor is listed in TABLES tables, each by WIDTH of its bits: two that differ in a twentieth
   of their bits share a table's key with a chance of 0.2. Up to FEW images with a key are paired; more are told apart
   by MORE further bits, again all pairs up to FEW, else each with the least. An image has a key once, so no key holds
   more than one row an image, a small part of all rows.
2. Two images that met by two keys or more are compared, where those are two only if the turn, scale and shift between the
   corners that hold them are the same (one corner of each may hold both): keys that unlike images share by chance lie
   anywhere. To compare: descriptors that are each other's nearest and differ in at most MOST bits match, and each match proposes a turn, scale and shift. The images link when the best proposal puts VOTES
   matches and SHARE of the smaller image's corners where it should. A logo that many pictures share does not suffice.
3. Where more than FEW images share a key, holders that these links do not connect with the largest component among
   them meet all the others, whatever their further bits; pairs with two keys in common, crowded or not, are compared by
   the same rule. So no pair of a crowded key is left out, copies cost nothing more, and unlike images that share a key
   cost the square of their number: a narrow row a pair, and a comparison for the few whose keys agree.

A table may miss copies whose descriptors share no two keys, or two that do not agree; recall is measured against the comparison of all pairs in
the tests. Images with the same pixels form a class before any of this. Defined cases: null, empty or wrongly sized
pixels have no corners and are their own component, as are images without texture or too small for a patch; images of
any size are described, large ones alone in their piece; repeated rows and equal pixels are one component; ties in
corner strength go to the upper left; null ids are least only among themselves; an empty table gives an empty result;
other columns, whatever their names, play no part.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_set, bits_for, has_bit, lean, materialise, pieces, tidy, with_groups
from .jaccard_join import components

RADIUS, LEVELS, BITS = 9, 3, 256
#: Corners of a level: one for each so many pixels, and at least so many where there are.
PIXELS, CORNERS = 170, 24
TABLES, WIDTH, MORE, FEW = 8, 32, 15, 4
#: Bits of an image's number beside the further bits of a key.
NUMBER = 48
#: Bits of a coordinate as keys carry it, and of one that is compared; corners farther out agree with all.
PLACE, NEAR = 23, 12
#: Bits in which a match may differ, matches a link needs, and their share of the smaller image's corners.
MOST, VOTES, SHARE = 64, 4, 0.15
#: A match's place may be off by SLACK pixels and LEAN of its distance from the proposing one, its angle by BEND.
SLACK, LEAN, BEND = 3.0, 0.12, 0.4
#: Turns in which each image's best pair alone is compared, so that a family of copies costs a few pairs an image.
TURNS = 2
#: One corner as stored: bits, place in the full image, angle in 2**16ths of a turn, level.
CORNER = np.dtype([("bits", "<i8", (BITS // 64,)), ("x", "<u4"), ("y", "<u4"), ("angle", "<u2"), ("level", "u1")])


@functools.cache
def _tests() -> np.ndarray:
    """x, y, x, y of the two points of each comparison, within the patch and apart from each other."""
    rng, out = np.random.default_rng(23), []
    while len(out) < BITS:
        p = rng.normal(0, RADIUS * 0.45, (2, 2))
        if (np.hypot(*p.T) <= RADIUS).all() and np.hypot(*(p[0] - p[1])) >= 3.5:
            out.append(p.reshape(4))
    return np.array(out)


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2 r + 1, edges repeated; the last two axes are rows and columns."""
    for axis in (-2, -1):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (r + 1, r)
        run = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis)
        n = x.shape[axis]
        x = np.take(run, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(run, range(n), axis)
    return x


def _level(stack: np.ndarray) -> tuple[np.ndarray, ...]:
    """image, x, y, angle and bits of the corners of a stack of images at one scale."""
    patch = np.arange(-RADIUS, RADIUS + 1)
    inside = (patch[:, None] ** 2 + patch[None, :] ** 2) <= RADIUS**2
    gy, gx = np.gradient(_box(stack, 1) / 9, axis=(1, 2))
    xx, yy, xy = (_box(a, 2) for a in (gx * gx, gy * gy, gx * gy))
    strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    peak = strength > 1e-5 * (1 + strength.max(axis=(1, 2), keepdims=True))
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            if (dy, dx) != (0, 0):
                beside = np.roll(strength, (dy, dx), (1, 2))
                # Of equal neighbours the upper left one stays.
                peak &= (strength > beside) if (dy, dx) > (0, 0) else (strength >= beside)
    h, w = stack.shape[1:]
    m = RADIUS + 2
    border = np.zeros((h, w), bool)
    border[m:h - m, m:w - m] = True
    value = np.where(peak & border, strength, 0).reshape(len(stack), -1)
    top = np.argsort(-value, axis=1, kind="stable")[:, :max(CORNERS, h * w // PIXELS)]
    image, k = np.nonzero(np.take_along_axis(value, top, 1) > 0)
    y, x = np.divmod(top[image, k], w)
    broad = _box(stack, 2)
    own = broad[image[:, None, None], (y[:, None] + patch)[:, :, None], (x[:, None] + patch)[:, None, :]]
    disc = (own - own.mean((1, 2), keepdims=True)) * inside
    angle = np.arctan2((disc * patch[:, None]).sum((1, 2)), (disc * patch[None, :]).sum((1, 2)))
    cos, sin = np.cos(angle)[:, None].astype(np.float32), np.sin(angle)[:, None].astype(np.float32)
    # Smoothed and drawn out to half pixels, so that the turned points are met to a quarter of a pixel.
    smooth = _box(_box(stack, 1), 1).astype(np.float32)
    fine = np.empty((len(stack), 2 * h - 1, 2 * w - 1), np.float32)
    fine[:, ::2, ::2] = smooth
    fine[:, 1::2, ::2] = (smooth[:, :-1] + smooth[:, 1:]) / 2
    fine[:, :, 1::2] = (fine[:, :, :-1:2] + fine[:, :, 2::2]) / 2
    flat, base, step = fine.reshape(-1), (image * fine[0].size + 2 * y * (2 * w - 1) + 2 * x)[:, None], np.float32(2 * w - 1)

    def seen(px: np.ndarray, py: np.ndarray) -> np.ndarray:
        right, down = np.rint(2 * (cos * px - sin * py)), np.rint(2 * (sin * px + cos * py))
        return flat[base + (down * step + right).astype(np.int64)]

    a, b, c, d = _tests().T.astype(np.float32)
    bits = np.packbits(seen(a, b) < seen(c, d), axis=1).reshape(-1, BITS // 8)
    return image, x, y, angle, np.ascontiguousarray(bits).view("<i8").reshape(-1, BITS // 64)


def describe(stack: np.ndarray) -> list[np.ndarray]:
    """The corners (CORNER) of each image of a stack: images by rows by columns."""
    parts, owner, level = [], [], 0
    while min(stack.shape[1:]) >= 2 * RADIUS + 6 and level < LEVELS:
        image, x, y, angle, bits = _level(stack)
        own = np.zeros(len(image), CORNER)
        scale = 1 << level
        own["bits"], own["x"], own["y"], own["level"] = bits, x * scale + scale // 2, y * scale + scale // 2, level
        own["angle"] = np.rint(angle / (2 * np.pi) * 65536).astype(np.int64) % 65536
        parts.append(own)
        owner.append(image)
        h, w = stack.shape[1:]
        stack = stack[:, : h // 2 * 2, : w // 2 * 2].reshape(len(stack), h // 2, 2, w // 2, 2).mean((2, 4))
        level += 1
    if not parts:
        return [np.zeros(0, CORNER)] * len(stack)
    corners, owner = np.concatenate(parts), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(stack) + 1))
    return [corners[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _describe(batches):
    """image_id, class (hash of the pixels and their shape; null without any) and packed corners of each image."""
    for batch in batches:
        for part in pieces(batch, "pixels", 2_000_000):
            shape = np.stack([part.column(c).fill_null(0).to_numpy() for c in ("height", "width")], 1)
            size = pc.fill_null(pc.binary_length(part.column("pixels")), 0).to_numpy()
            raw = part.column("pixels").to_pylist()
            classes = [xxhash.xxh3_64_intdigest(x, seed=h << 32 | w) - (1 << 63) if x else None for x, (h, w) in zip(raw, shape.astype(np.uint32).tolist(), strict=True)]
            out: list[bytes | None] = [b""] * len(part)
            good = (size > 0) & (size == shape[:, 0].astype(np.int64) * shape[:, 1])
            for h, w in {tuple(s) for s in shape[good].tolist()}:
                own = np.nonzero(good & (shape == (h, w)).all(1))[0]
                step = max(1, 500_000 // (h * w))
                for i in range(0, len(own), step):
                    stack = np.stack([np.frombuffer(raw[k], np.uint8).reshape(h, w) for k in own[i:i + step]]).astype(np.float32)
                    for k, corners in zip(own[i:i + step], describe(stack), strict=True):
                        out[k] = corners.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("image_id"), pa.array(classes, pa.int64()), pa.array(out, pa.binary())], names=["image_id", "class", "corners"])


def _keys(batches):
    """For each image its distinct keys (table and WIDTH bits), each with MORE further bits above the image's number, and the
    spot (place, angle and level) of a corner that holds it."""
    step = WIDTH // 8
    for batch in batches:
        keys, values, spots = [], [], []
        for num, blob in zip(batch.column("num").to_pylist(), batch.column("corners").to_pylist(), strict=True):
            corners = np.frombuffer(blob, CORNER)
            bits = corners["bits"]
            x, y = (np.minimum(corners[c], (1 << PLACE) - 1).astype(np.int64) for c in ("x", "y"))
            spot = (((x << PLACE | y) << 16 | corners["angle"]) << 2) | corners["level"]
            raw = np.ascontiguousarray(bits).view(np.uint8).reshape(len(bits), BITS // 8).astype(np.int64)
            own = []
            for t in range(TABLES):
                key = np.full(len(bits), t, np.int64)
                for k in range(step):
                    key = (key << 8) | raw[:, (t * step + k) % (BITS // 8)]
                further = (raw[:, (t * step + step) % (BITS // 8)] << 8) | raw[:, (t * step + step + 1) % (BITS // 8)]
                own.append(np.stack([key, further >> (16 - MORE), spot], 1))
            own = np.concatenate(own)
            own = own[np.lexsort((own[:, 2], own[:, 1], own[:, 0]))]
            own = own[np.concatenate([[True], own[1:, 0] != own[:-1, 0]])] if len(own) else own
            keys.append(own[:, 0])
            values.append((own[:, 1] << NUMBER) | num)
            spots.append(own[:, 2])
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in (keys, values, spots)], names=["key", "value", "spot"])


def _pairs(held: list[tuple[int, int]], key: int | None):
    """a, b, key and both spots of all pairs of holders (number, spot)."""
    held = sorted(held)
    return [(a, b, key, s, t) for i, (a, s) in enumerate(held) for b, t in held[i + 1:]]


def _meet(batches):
    """Rows sorted by key and value: pairs a, b of images with a key, and the spots of both; of crowded keys, told by sub,
    also all holders a, without b."""
    mask = (1 << NUMBER) - 1
    held: list[tuple[int, int]] = []  # value and spot of the first holders of the present key with their further bits; all of a crowded one pass by parts
    out: list[tuple] = []
    key = part = None
    crowded = False
    run: list[tuple[int, int]] = []  # number and spot in the present part of a crowded key, FEW + 1 at most; the first is the least

    def shift(value: int, spot: int) -> None:
        nonlocal part, run
        num, x = value & mask, value >> NUMBER
        if x != part:
            close()
            part, run = x, []
        out.append((num, None, key, spot, None))
        if len(run) <= FEW:
            run.append((num, spot))
            if len(run) == FEW + 1:
                out.extend((run[0][0], n, key, run[0][1], s) for n, s in run[1:])
        else:
            out.append((run[0][0], num, key, run[0][1], spot))

    def close() -> None:
        if part is not None and len(run) <= FEW:
            out.extend(_pairs(run, key))

    def end() -> None:
        nonlocal held, part, run, crowded
        if crowded:
            close()
        else:
            out.extend(_pairs([(v & mask, s) for v, s in held], None))
        held, part, run, crowded = [], None, [], False

    for batch in batches:
        keys, values, spots = (batch.column(c).to_numpy() for c in ("key", "value", "spot"))
        # Keys of one image make nothing; only runs are looked at, and the batch's ends.
        same = np.concatenate([[True], keys[1:] == keys[:-1]]) if len(keys) else np.zeros(0, bool)
        look = same.copy()
        look[:-1] |= same[1:]
        if len(look):
            look[-1] = True
        for k, value, spot in zip(keys[look].tolist(), values[look].tolist(), spots[look].tolist(), strict=True):
            if k != key:
                end()
                key = k
            if crowded:
                shift(value, spot)
                continue
            held.append((value, spot))
            if len(held) > FEW:
                crowded, early = True, held
                held = []
                for v in early:
                    shift(*v)
        if len(out) > 100_000:
            yield _met(out)
            out = []
    end()
    if out:
        yield _met(out)


def _met(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "sub", "spot", "other"])


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """Matches that the best turn, scale and shift puts in place, of the corners of two images."""
    if not len(a) or not len(b):
        return 0
    differ = np.bitwise_count(a["bits"][:, None, :] ^ b["bits"][None, :, :]).sum(2, dtype=np.int64)
    there = differ.argmin(1)
    i = np.nonzero((differ.argmin(0)[there] == np.arange(len(a))) & (differ[np.arange(len(a)), there] <= MOST))[0]
    if len(i) < VOTES:
        return len(i)
    p, q = a[i], b[there[i]]
    turn = (q["angle"].astype(np.float64) - p["angle"]) * (2 * np.pi / 65536)
    scale = 2.0 ** (q["level"].astype(np.int64) - p["level"])
    px, py, qx, qy = (z.astype(np.float64) for z in (p["x"], p["y"], q["x"], q["y"]))
    dx, dy = px[None, :] - px[:, None], py[None, :] - py[:, None]
    cos, sin = (scale * np.cos(turn))[:, None], (scale * np.sin(turn))[:, None]
    off = np.hypot(qx[:, None] + cos * dx - sin * dy - qx[None, :], qy[:, None] + sin * dx + cos * dy - qy[None, :])
    bent = np.abs((turn[None, :] - turn[:, None] + np.pi) % (2 * np.pi) - np.pi)
    fine = (off <= np.maximum(1, scale)[:, None] * SLACK + LEAN * scale[:, None] * np.hypot(dx, dy)) & (bent <= BEND) & (scale[:, None] == scale[None, :])
    return int(fine.sum(1).max())


def copied(a: np.ndarray, b: np.ndarray) -> bool:
    """a and b: corners of two images."""
    return agreement(a, b) >= max(VOTES, SHARE * min(len(a), len(b)))


def _agree(batches):
    for batch in batches:
        left, right = (batch.column(c).to_pylist() for c in ("left", "right"))
        kept = [copied(np.frombuffer(x, CORNER), np.frombuffer(y, CORNER)) for x, y in zip(left, right, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def pose(spot: str, other: str) -> Column:
    """How a corner of image a lies to the one of image b with the same key: both places, the turn and the difference of
    levels, in one number; -1 where a place is beyond NEAR bits."""
    part = lambda c, at, bits: F.shiftright(F.col(c), at).bitwiseAND(F.lit((1 << bits) - 1))
    places = [part(c, at, PLACE) for c in (spot, other) for at in (18 + PLACE, 18)]
    turn = F.shiftright(F.pmod(part(other, 2, 16) - part(spot, 2, 16), F.lit(1 << 16)), 16 - NEAR)
    out = (part(other, 0, 2) - part(spot, 0, 2) + LEVELS - 1) * (1 << NEAR) + turn
    for p in places:
        out = out * (1 << NEAR) + p
    return F.when(F.greatest(*places) < 1 << NEAR, out).otherwise(F.lit(-1)).cast("long")


def agree(one: str, two: str) -> Column:
    """Whether one of two poses puts the other's corner where it is, by the bounds of agreement()."""
    def fields(c):
        part = lambda n, bits: F.shiftright(F.col(c), n * NEAR).bitwiseAND(F.lit((1 << bits) - 1)).cast("double")
        return [part(n, NEAR) for n in (3, 2, 1, 0)], part(4, NEAR) * (2 * np.pi / (1 << NEAR)), part(5, 3) - (LEVELS - 1)

    def puts(first, second):
        ((px, py, qx, qy), turn, level), ((rx, ry, sx, sy), bend, other) = fields(first), fields(second)
        scale, dx, dy = F.pow(F.lit(2.0), level), rx - px, ry - py
        cos, sin = scale * F.cos(turn), scale * F.sin(turn)
        off = F.hypot(qx + cos * dx - sin * dy - sx, qy + sin * dx + cos * dy - sy)
        bent = F.abs(F.pmod(bend - turn + np.pi, F.lit(2 * np.pi)) - np.pi)
        return (level == other) & (off <= F.greatest(F.lit(1.0), scale) * SLACK + LEAN * scale * F.hypot(dx, dy)) & (bent <= BEND + 2 * np.pi / (1 << NEAR))

    return (F.least(one, two) < 0) | puts(one, two) | puts(two, one)


def meetings(rows: DataFrame) -> DataFrame:
    """a, b, met, low, high: how often a pair met (a, b, pose each time), and its least and greatest pose: both of them
    where it met twice."""
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.min("pose").alias("low"), F.max("pose").alias("high"))


def agreeing() -> Column:
    """Whether a pair of meetings() goes on to be compared: three keys in common, or two that agree."""
    return (F.col("met") > 2) | ((F.col("met") == 2) & agree("low", "high"))


def met_twice(pairs: DataFrame) -> DataFrame:
    """a, b, met of the pairs of image numbers that met by keys that agree (a row and its pose each time)."""
    return materialise(meetings(pairs).filter(agreeing()).select("a", "b", "met"), "pairs")


def verified(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """a, b: the pairs of image numbers that are copies, by all their corners."""
    pairs = materialise(pairs.select("a", "b"), "tested")
    size = bits_for(pairs.count())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("num")).select(place("num").alias("at")).distinct()
    own = has_bit(images.select("num", "corners").withColumn("at", place("num")), "at", bit_set(wanted, "at"), size, "in").filter("in").select("num", "corners")
    rows = pairs.join(own.toDF("a", "left").hint("merge"), "a").join(own.toDF("b", "right").hint("merge"), "b")
    return materialise(rows.select("a", "b", "left", "right").mapInArrow(lean(_agree), "a long, b long"), "copies")


def spanning(pairs: DataFrame, images: DataFrame, found: DataFrame) -> DataFrame:
    """found and those of the pairs (a, b, met) that are copies, as far as they connect what is not connected yet: first
    each image's best pair, in TURNS turns, then all pairs between what is still apart."""
    for turn in range(TURNS + 1):
        if turn or found is not None:
            label = components(found)
            label = materialise(label, "label")
            pairs = pairs.join(label.toDF("a", "la"), "a", "left").join(label.toDF("b", "lb"), "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b", "met")
            pairs = materialise(pairs, "apart")
        if turn == TURNS:
            tested = pairs
        else:
            both = pairs.select(F.col("a").alias("num"), F.col("b").alias("other"), "met").unionByName(pairs.select(F.col("b").alias("num"), F.col("a").alias("other"), "met"))
            best = both.groupBy("num").agg(F.max_by("other", F.struct(F.col("met"), -F.col("other"))).alias("other"))
            tested = materialise(best.select(F.least("num", "other").alias("a"), F.greatest("num", "other").alias("b")).distinct(), "best")
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        more = verified(tested, images)
        found = more if found is None else materialise(found.unionByName(more), "found")
    return found


def links(images: DataFrame) -> DataFrame:
    """a, b: numbers of images (num, corners) that are copies; what is connected by all links is connected by these."""
    keys = images.select("num", "corners").mapInArrow(lean(_keys), "key long, value long, spot long")
    met = materialise(keys.repartition("key").sortWithinPartitions("key", "value").mapInArrow(lean(_meet), "a long, b long, sub long, spot long, other long"), "met")
    once = met.filter("b is not null and a <> b").select("a", "b", "sub", pose("spot", "other").alias("pose"))
    found = spanning(met_twice(once), images, None)
    # Of a crowded key, holders that are not connected with its largest component meet all the others.
    label = components(found).toDF("num", "label")
    left = materialise(met.filter("b is null").select("sub", F.col("a").alias("num"), "spot").join(label, "num", "left").withColumn("label", F.coalesce("label", "num")), "crowded")
    parts = left.groupBy("sub", "label").agg(F.count(F.lit(1)).alias("m"))
    keys = parts.groupBy("sub").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    keys = materialise(keys.select("sub", "main", "n"), "split-keys")
    left = materialise(with_groups(left, keys, ["sub"], "n", left.count()).select("sub", "num", "spot", "label", "main"), "split-holders")
    apart = left.filter("label <> main").select("sub", F.col("num").alias("other"), F.col("spot").alias("other_spot"), F.col("label").alias("other_label"))
    pairs = left.join(apart, "sub").filter("label <> other_label and (label = main or num < other)")
    least = F.col("num") < F.col("other")
    spots = (F.when(least, F.col("spot")).otherwise(F.col("other_spot")).alias("spot"), F.when(least, F.col("other_spot")).otherwise(F.col("spot")).alias("other"))
    pairs = pairs.select(F.least("num", "other").alias("a"), F.greatest("num", "other").alias("b"), *spots)
    pairs = meetings(pairs.select("a", "b", pose("spot", "other").alias("pose")))
    # Keys that are not crowded count too.
    plain = meetings(once.filter("sub is null")).toDF("a", "b", "more", "lower", "higher")
    pairs = pairs.join(plain, ["a", "b"], "left").select("a", "b", (F.col("met") + F.coalesce("more", F.lit(0))).alias("met"), F.least("low", "lower").alias("low"), F.greatest("high", "higher").alias("high"))
    return found.unionByName(verified(pairs.filter(agreeing()), images))


def copies(images: DataFrame) -> DataFrame:
    """image_id, n_corners, component_id (least image_id of its copies) for every row of images (image_id, width, height, pixels)."""
    kind = images.schema["image_id"].dataType.simpleString()
    rows = images.select("image_id", F.col("width").cast("int"), F.col("height").cast("int"), "pixels")
    return joined_copies(rows.mapInArrow(lean(_describe), f"image_id {kind}, class long, corners binary"))


@tidy
def joined_copies(made: DataFrame) -> DataFrame:
    """copies() of described images (image_id, class, corners)."""
    made = materialise(made.withColumn("num", F.monotonically_increasing_id()), "corners")
    n = F.coalesce(F.octet_length("corners") / CORNER.itemsize, F.lit(0)).cast("long")
    keys = made.select("num", "image_id", "class", n.alias("n_corners"))
    classes = materialise(keys.filter("class is not null").groupBy("class").agg(F.min("num").alias("num"), F.min("image_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.min("n_corners").alias("n_corners")), "classes")
    # One image of each class goes on; corners of classes with one image are not shuffled for that.
    again = classes.filter("rows > 1")
    bits = bits_for(classes.count())
    at = F.pmod(F.xxhash64("class"), F.lit(bits))
    flagged = has_bit(made.filter("class is not null and octet_length(corners) > 0").withColumn("at", at), "at", bit_set(again.select(at.alias("at")).distinct(), "at"), bits, "again")
    one = flagged.filter("not again").select("num", "corners").unionByName(flagged.filter("again").join(classes.select("num"), "num", "left_semi").select("num", "corners"))
    label = components(links(one)).toDF("num", "label")
    classes = classes.join(label, "num", "left").withColumn("label", F.coalesce("label", "num"))
    classes = materialise(classes, "labelled")
    least = materialise(classes.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("parts")), "least")
    classes = with_groups(classes.select("label", "class", "rows"), least, ["label"], "parts", classes.count())
    out = with_groups(keys.filter("class is not null"), classes.select("class", "component_id", "rows"), ["class"], "rows", keys.count())
    out = out.select("image_id", "n_corners", "component_id")
    return out.unionByName(keys.filter("class is null").select("image_id", "n_corners", F.col("image_id").alias("component_id")))


SIDE, TERMS = 64, 64


def _patterns() -> np.ndarray:
    """Fixed smooth random patterns, one for each component of a vector."""
    rng = np.random.default_rng(41)
    x = _box(rng.normal(0, 1, (TERMS, SIDE, SIDE)), 1)
    return (x / x.std(axis=(1, 2), keepdims=True)).reshape(TERMS, -1).astype(np.float32)


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned about its centre, grey where nothing was."""
    h, w = image.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    fx, fy = np.cos(a) * x - np.sin(a) * y + (w - 1) / 2, np.sin(a) * x + np.cos(a) * y + (h - 1) / 2
    x0, y0 = np.clip(np.floor(fx).astype(int), 0, w - 2), np.clip(np.floor(fy).astype(int), 0, h - 2)
    u, v = np.clip(fx - x0, 0, 1), np.clip(fy - y0, 0, 1)
    out = (image[y0, x0] * (1 - u) + image[y0, x0 + 1] * u) * (1 - v) + (image[y0 + 1, x0] * (1 - u) + image[y0 + 1, x0 + 1] * u) * v
    return np.where((fx < 0) | (fy < 0) | (fx > w - 1) | (fy > h - 1), 128, out)


EDITS = ("crop", "turn", "noise", "brightness", "blur")


def edited(image: np.ndarray, number: int) -> tuple[str, np.ndarray]:
    """The edit of that number (its kind, angle and place follow from it) and the edited image."""
    kind, rng = EDITS[number % len(EDITS)], np.random.default_rng(number)
    image = image.astype(np.float64)
    if kind == "crop":
        dy, dx = rng.integers(0, 9, 2)
        image = image[dy:dy + 56, dx:dx + 56]
    elif kind == "turn":
        image = turned(image, float(rng.uniform(0, 360)))
    elif kind == "noise":
        image = image + rng.normal(0, 8, image.shape)
    elif kind == "brightness":
        image = image * 0.8 + 20
    else:
        image = _box(image, 1) / 9
    return kind, np.clip(np.rint(image), 0, 255).astype(np.uint8)


DRAWN = "image_id long, edit string, width int, height int, pixels binary"


def _draw(every: int | None):
    def run(batches):
        patterns = _patterns()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                lists, ids = part.column("embedding").to_pylist(), part.column("image_id").to_pylist()
                flat = np.array([(list(v or []) + [0.0] * TERMS)[:TERMS] for v in lists], np.float32).reshape(-1, TERMS)
                gray = np.clip(np.rint(128 + 50 * np.nan_to_num(flat) @ patterns), 0, 255).astype(np.uint8)
                out = [(i, None, SIDE, SIDE, None if v is None else x.tobytes()) for i, v, x in zip(ids, lists, gray, strict=True)]
                for i, v, x in zip(ids, lists, gray, strict=True):
                    if every and i is not None and v is not None and i % every == 0:
                        kind, image = edited(x.reshape(SIDE, SIDE), i // every)
                        out.append((i, kind, image.shape[1], image.shape[0], image.tobytes()))
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["image_id", "edit", "width", "height", "pixels"])

    return run


def _draw_and_describe(every: int):
    """An image and its edited copy are two ids, in the order of their vectors."""

    def run(batches):
        for batch in _draw(every)(batches):
            ids = [None if i is None else 2 * i + (e is not None) for i, e in zip(batch.column("image_id").to_pylist(), batch.column("edit").to_pylist(), strict=True)]
            yield from _describe([pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(batch.column(c) for c in ("width", "height", "pixels"))], names=["image_id", "width", "height", "pixels"])])

    return run


def drawn(embeddings: DataFrame, key: str = "vec_id", every: int | None = None) -> DataFrame:
    """image_id, edit, width, height, pixels: each vector as the sum of fixed patterns, for tables without images of their
    own; with `every`, an edited copy too (edit is its kind) of each image whose id is divisible by it."""
    return embeddings.select(F.col(key).cast("long").alias("image_id"), "embedding").mapInArrow(lean(_draw(every)), DRAWN)


def find_edits(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """vec_id, edit, n_corners, component_id of all drawn vectors and of the edited copies: the copy of an image is found
    where both are in one component. component_id is the least vec_id of the component."""
    made = embeddings.select(F.col("vec_id").cast("long").alias("image_id"), "embedding").mapInArrow(lean(_draw_and_describe(every)), "image_id long, class long, corners binary")
    kind = F.when(F.pmod("image_id", F.lit(2)) == 1, F.element_at(F.array(*map(F.lit, EDITS)), (F.pmod(F.floor(F.col("vec_id") / every), F.lit(len(EDITS))) + 1).cast("int")))
    out = joined_copies(made).withColumn("vec_id", F.floor(F.col("image_id") / 2))
    return out.select("vec_id", kind.alias("edit"), "n_corners", F.floor(F.col("component_id") / 2).alias("component_id"))
