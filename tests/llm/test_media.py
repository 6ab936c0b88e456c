from itertools import combinations

import numpy as np
import pytest

from hunkmill.llm import media

SCHEMA = "image_id long, width int, height int, pixels binary, class string, num string, size string"


def picture(rng, side=96):
    cells = rng.integers(0, 256, (side // 8, side // 8))
    return np.clip(cells.repeat(8, 0).repeat(8, 1) + rng.integers(-3, 4, (side, side)), 0, 255).astype(np.uint8)


def smooth(rng, side=96):
    x = media._box(rng.normal(0, 1, (side, side)), 2)
    return np.clip(128 + 50 * x / x.std(), 0, 255).astype(np.uint8)


def row(i, x):
    x = np.ascontiguousarray(np.clip(np.rint(x), 0, 255).astype(np.uint8))
    return (i, x.shape[1], x.shape[0], bytearray(x.tobytes()), "clash", "clash", "clash")


def corners(x):
    return media.describe(np.clip(np.rint(x), 0, 255)[None].astype(np.float32))[0]


EDITS = {
    "crop": lambda x, rng: x[8:88, 3:83], "large crop": lambda x, rng: x[:72, 20:], "brightness": lambda x, rng: x * 0.8 + 20, "quarter turn": lambda x, rng: np.rot90(x),
    "turn by 10": lambda x, rng: media.turned(x, 10), "turn by 37": lambda x, rng: media.turned(x, 37), "noise 5": lambda x, rng: x + rng.normal(0, 5, x.shape),
    "noise 10": lambda x, rng: x + rng.normal(0, 10, x.shape), "blur": lambda x, rng: media._box(x.astype(float), 1) / 9, "half": lambda x, rng: x.reshape(48, 2, 48, 2).mean((1, 3)),
}


def test_crops_turns_and_edits_join_and_others_do_not(spark):
    rng = np.random.default_rng(6)
    rows, truth, kinds = [], {}, {}
    for k in range(24):
        base = picture(rng) if k % 2 else smooth(rng)
        for j, (kind, x) in enumerate([("base", base), ("base", base.copy()), *((n, f(base, rng)) for n, f in EDITS.items())]):
            rows.append(row(100 * k + j, x))
            truth[100 * k + j], kinds[100 * k + j] = 100 * k, kind
    odd = [(9000, 64, 64, None), (9001, 64, 64, bytearray(b"")), (9002, 5, 5, bytearray(b"123")), (9003, 64, 64, bytearray(bytes(4096))), (9004, 3, 3, bytearray(b"123456789")), (None, 4, 4, None), (9005, None, None, bytearray(b"12"))]
    rows += [(*r, "x", "y", "z") for r in odd] + [row(9006, smooth(rng, 400))]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.image_id: r for r in media.copies(df).collect()}
    assert len(out) == len(rows)
    for kind in EDITS:
        own = [i for i in truth if kinds[i] == kind]
        assert np.mean([out[i].component_id == truth[i] for i in own]) >= 0.9, kind
    # No link between pictures that are not copies.
    assert all(truth.get(out[i].component_id) == t for i, t in truth.items())
    for i in (9000, 9001, 9002, 9003, 9004, 9005):
        assert (out[i].n_corners, out[i].component_id) == (0, i)
    assert out[9006].component_id == 9006 and out[9006].n_corners > 200
    assert media.copies(df.limit(0)).count() == 0


def test_pictures_that_share_a_logo_are_no_copies(spark):
    rng = np.random.default_rng(9)
    logo = smooth(rng, 48)
    rows = []
    for k in range(20):
        x = smooth(rng, 128)
        at = rng.integers(0, 80, 2)
        x[at[0]:at[0] + 48, at[1]:at[1] + 48] = logo
        rows.append(row(k, x))
    out = media.copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.component_id == r.image_id for r in out)


def test_equal_images_are_one_component(spark):
    rng = np.random.default_rng(7)
    x = picture(rng)
    df = spark.createDataFrame([row(i, x) for i in (5, 5, 3, 9)], SCHEMA)
    assert {r.component_id for r in media.copies(df).collect()} == {3}
    vectors = spark.createDataFrame([(1, [0.1] * 64), (2, None), (3, [])], "vec_id long, embedding array<float>")
    assert media.copies(media.drawn(vectors)).count() == 3


@pytest.mark.parametrize("few", [media.FEW, 1])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, few):
    """Against the comparison of all pairs; with FEW = 1 every key is crowded, so that least holders and components do the work."""
    monkeypatch.setattr(media, "FEW", few)
    rng = np.random.default_rng(8)
    images = []
    for k in range(12):
        base = smooth(rng)
        images += [corners(base + rng.normal(0, 3, base.shape)) for _ in range(1 + k % 5)]
    texture = images[0][:8]
    images = [np.concatenate([x, texture]) for x in images]  # corners that all images share
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(images)], "num long, corners binary")

    def close(pairs):
        label = list(range(len(images)))
        for i, j in pairs:
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
        return label

    want = close((i, j) for i, j in combinations(range(len(images)), 2) if media.copied(images[i], images[j]))
    assert close((r.a, r.b) for r in media.links(df).collect()) == want
    assert len(set(want)) == 12


def test_holders_of_a_crowded_key_meet_whatever_their_further_bits(spark):
    """Two copies share two keys alone, both crowded by unlike images, and differ in the further bits of each."""
    rng = np.random.default_rng(12)

    def made(n):
        x = np.zeros(n, media.CORNER)
        x["bits"] = rng.integers(-(2**63), 2**63, (n, media.BITS // 64))
        x["x"], x["y"] = rng.integers(0, 500, (2, n))
        return x

    def raw(x):
        return x["bits"].view(np.uint8).reshape(len(x), -1)

    one = made(12)
    two = one.copy()
    step = media.WIDTH // 8
    for t in range(media.TABLES):
        raw(two)[:, t * step] ^= 0x80  # no key is left in common ...
    for t in (0, 4):
        raw(two)[0, t * step] ^= 0x80  # ... but two of the first corner's, whose further bits still differ
    others = [made(12) for _ in range(2 * media.FEW)]
    for x in others:
        for t in (0, 4):
            raw(x)[t, t * step:(t + 1) * step] = raw(one)[0, t * step:(t + 1) * step]
    images = [one, *others, two]
    assert media.copied(one, two) and not any(media.copied(a, b) for a, b in combinations(images[:-1], 2))
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(images)], "num long, corners binary")
    assert {(r.a, r.b) for r in media.links(df).collect()} == {(0, len(images) - 1)}


def test_keys_at_odds_make_no_comparison(spark, monkeypatch):
    """Unlike images share two crowded keys, each held anywhere: they are not compared, copies that hold them are."""
    rng = np.random.default_rng(13)
    step, images = media.WIDTH // 8, []
    shared = rng.integers(0, 256, (2, media.BITS // 8), np.uint8)
    for k in range(60):
        x = np.zeros(12, media.CORNER)
        x["bits"] = rng.integers(-(2**63), 2**63, (12, media.BITS // 64))
        x["x"], x["y"], x["angle"] = rng.integers(0, 500, 12), rng.integers(0, 500, 12), rng.integers(0, 65536, 12)
        raw = x["bits"].view(np.uint8).reshape(12, -1)
        for t in (0, 1):
            raw[t, t * step:(t + 1) * step] = shared[t, t * step:(t + 1) * step]
        images.append(x)
    far = images[0].copy()
    far["x"] += 5000
    images += [images[0].copy(), far]
    tested, verified = [], media.verified
    monkeypatch.setattr(media, "verified", lambda pairs, own: (tested.extend((r.a, r.b) for r in pairs.select("a", "b").collect()), verified(pairs, own))[1])
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(images)], "num long, corners binary")
    found = {(r.a, r.b) for r in media.links(df).collect()}
    label = {i: i for i in range(62)}
    for a, b in sorted(found):
        label[b] = label[a]
    assert label[0] == label[60] == label[61] and all(label[i] == i for i in range(1, 60))
    # Corners beyond NEAR bits agree with all, so the one far image may meet each of the others.
    assert len([p for p in tested if 61 not in p]) < 60, len(tested)


def test_query_finds_edited_copies(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(0, 0.125, 64)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = media.find_edits(df, every=5).collect()
    assert len(out) == 360 and {r.edit for r in out} == {None, *media.EDITS}
    # Queries: every image whose id is divisible by 5, its copy against all rows; brute force compares all pairs.
    assert np.mean([r.component_id == r.vec_id for r in out if r.edit]) >= 0.9
    assert all(r.component_id == r.vec_id for r in out if not r.edit)
