"""Content-addressed store of token ids.

Texts are encoded with a tokenizers file, each document ends with an end id. A rolling hash over a window of ids
cuts a document's stream into chunks (64 to 4096 ids, 512 on average); a chunk is addressed by its 16-byte
BLAKE2b. The files of a store:

  recipes/   in ascending doc_id order by segment: doc_id, n_tokens, the recipe (chunk addresses in order) and its Merkle
             root; this is the order of the ids
  packs/     one row a document, apart by whether it shares a chunk: the payloads it owns, little-endian, 2 bytes an id where the tokenizer's largest id
             allows, else 4; every chunk is owned once, by the first document that has it
  shared/    addresses that several documents use, with their owner
  manifest/  a row for each segment: documents, ids, root over its documents' roots, bytes an id

Reading back takes ids from packs only, checks each payload against its address, each document against its root and
each segment against the manifest; a document that packs lost is not verified, and so are all of its segment. A chunk
that repeats is found by its address, so only documents that share chunks are shuffled with payloads; the others are
copied and read where they are.

Defined cases: null text is empty and leaves the end id alone; a null doc_id comes last; repeated ids follow each other
in the order of the rows; a text of any length is encoded whole, alone in its piece; equal chunks belong to the first
row that has them; an empty table gives empty files; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import zlib
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, bit_set, bits_for, discard, has_bit, lean, materialise, pieces, scratch, tidy, with_groups, without_gc, words_of

WINDOW, LEAST, MOST, MEAN_BITS = 8, 64, 4096, 9
#: Distinct words whose ids a worker remembers at most.
CACHE_WORDS = 600_000
ROWS_A_SEGMENT = 20_000
#: Bytes of text encoded at a time: a word is looked up once in each piece.
PIECE_BYTES = 8_000_000
#: Byte-level alphabet of the vocabulary: printable Latin-1 stands for itself, other bytes for 256 and on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _gear(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def cuts(ids: np.ndarray, marks: np.ndarray) -> list[int]:
    """Chunk ends of one document; marks are the positions that the rolling hash proposes."""
    ends, at, n = [], 0, len(ids)
    for m in itertools.chain(marks.tolist(), [n]):
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m - at >= LEAST and m < n:
            ends.append(m)
            at = m
    if at < n:
        ends.append(n)
    return ends


def proposals(ids: np.ndarray) -> np.ndarray:
    """Positions after which the hash of the last WINDOW ids has MEAN_BITS zero bits."""
    g = _gear(ids)
    h = g.copy()
    for k in range(1, WINDOW):
        h[k:] += g[:-k] << np.uint64(k * 5)
    return np.nonzero((h >> np.uint64(64 - MEAN_BITS)) == 0)[0] + 1


def _ends_in_stop(words: pa.Array) -> np.ndarray:
    """Does the word end in one of .,;:!? (words are LargeString and not empty)?"""
    if not len(words):
        return np.zeros(0, bool)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset + 1:words.offset + len(words) + 1]
    return np.isin(np.frombuffer(words.buffers()[2], np.uint8)[ends - 1], np.frombuffer(b".,;:!?", np.uint8))


class Encoder:
    """ids of whole texts. White space is dropped by the tokenizer, so words are encoded once and remembered.

    A word that ends in a letter or digit and then stops (.,;:!?) is the word and the stops, since the tokenizer
    parts letters from marks; a word of lower-case letters is one unit of its model, which then is asked directly.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Rows in the table of known words, which takes up new ones."""
        known, listed = self.known, words.to_pylist()
        rows = np.fromiter(map(known.get, listed, itertools.repeat(-1)), np.int64, len(listed))
        missing = np.nonzero(rows < 0)[0]
        if len(missing):
            fresh = [listed[i] for i in missing.tolist()]
            plain = [w for w in fresh if w.isalpha() and w.islower() and (w.isascii() or (w.lower() == w and is_normalized("NFC", w)))]
            found = set(plain)
            rest = [w for w in fresh if w not in found]
            shown = [w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_CHARS) for w in plain]
            ids = [[t.id for t in found] for found in map(self.tokenizer.model.tokenize, shown)]
            ids += [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.pool = np.concatenate([self.pool, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum()))])
            known.update(zip(itertools.chain(plain, rest), range(len(known), len(known) + len(ids)), strict=True))
            rows[missing] = np.fromiter(map(known.__getitem__, fresh), np.int64, len(fresh))
        return rows

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts, each with the end id."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        # Special tokens are told by case, so texts that may hold one keep theirs.
        special = pc.any(pc.match_substring(pc.fill_null(texts, ""), "<|")).as_py()
        ends, flat = words_of(texts, lower=not special)
        coded = flat.dictionary_encode()
        words = coded.dictionary
        stopped = np.nonzero(_ends_in_stop(words))[0]
        some = words.take(pa.array(stopped))
        core = pc.replace_substring_regex(some, r"([\pL\pN])[.,;:!?]+$", r"\1")
        parts = pc.not_equal(pc.binary_length(core), pc.binary_length(some)).to_numpy(zero_copy_only=False)
        stopped = stopped[parts]
        core = core.filter(pa.array(parts))
        stops = pc.replace_substring_regex(some.filter(pa.array(parts)), r"^.*[^.,;:!?]", "").dictionary_encode()
        # A word with stops is its core, looked up like any word, and the stops; another is itself and nothing.
        plain = np.ones(len(words), bool)
        plain[stopped] = False
        units = pa.concat_arrays([words.filter(pa.array(plain)), core]).dictionary_encode()
        row = self._rows(units.dictionary)[units.indices.to_numpy()]
        first, then = np.empty(len(words), np.int64), np.full(len(words), self._rows(pa.array([""]))[0])
        first[plain], first[stopped] = row[: len(words) - len(stopped)], row[len(words) - len(stopped):]
        then[stopped] = self._rows(stops.dictionary)[stops.indices.to_numpy()]
        # The ids of each distinct word together, then those of all words.
        pairs = np.stack([first, then], 1).reshape(-1)
        upto, pool = _gather(self.pool, self.start[pairs], self.size[pairs])
        start, size = upto[:-2:2], upto[2::2] - upto[:-2:2]
        code = coded.indices.to_numpy()
        upto, found = _gather(pool, start[code], size[code])
        offsets = upto[ends] + np.arange(len(ends))
        out = np.full(offsets[-1], end_id, np.uint32)
        place = np.ones(len(out), bool)
        place[offsets[1:] - 1] = False
        out[place] = found
        return offsets, out


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each slice of pool ends among all (one more than slices), and the slices one after the other."""
    upto = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=upto[1:])
    at = np.repeat(start - upto[:-1], size)
    at += np.arange(upto[-1])
    return upto, pool[at]


STAGED = "doc_id {id}, n_tokens long, recipe array<binary>, payloads array<binary>, root string"


@functools.cache
def _encoder(path: str) -> Encoder:
    """One for each worker process, so that its words outlast a task."""
    return Encoder(path)


def _encode(path: str, end_id: int, width: str):
    def run(batches):
        encode = _encoder(path)
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                with without_gc():
                    offsets, ids = encode(part.column("text"), end_id)
                marks = proposals(ids)
                at = np.searchsorted(marks, offsets)
                raw = ids.astype(width)
                recipe, payloads = [], []
                for i in range(len(part)):
                    a, b = offsets[i], offsets[i + 1]
                    own = marks[at[i]:at[i + 1]] - a
                    own = own[own >= WINDOW]  # no window reaches into the document before
                    last, blobs = 0, []
                    for end in cuts(ids[a:b], own):
                        blobs.append(raw[a + last:a + end].tobytes())
                        last = end
                    payloads.append(blobs)
                    recipe.append([hashlib.blake2b(x, digest_size=16).digest() for x in blobs])
                many = pa.list_(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(recipe, many), pa.array(payloads, many), pa.array(map(merkle, recipe), pa.string())], names=["doc_id", "n_tokens", "recipe", "payloads", "root"])

    return run


def _read(width: str):
    """Per document: whether each payload has its address, the Merkle root, the number and CRC of the ids."""

    def run(batches):
        for batch in batches:
            fine, root, n, crc = [], [], [], []
            for recipe, payloads in zip(batch.column("recipe").to_pylist(), batch.column("payloads").to_pylist(), strict=True):
                fine.append(len(recipe) == len(payloads) and all(p is not None and hashlib.blake2b(p, digest_size=16).digest() == d for d, p in zip(recipe, payloads, strict=False)))
                ids = np.frombuffer(b"".join(p or b"" for p in payloads), width)
                root.append(merkle(recipe))
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("nth"), pa.array(fine, pa.bool_()), pa.array(root, pa.string()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["nth", "fine", "read_root", "read_n", "ids_crc32"])

    return run


def merkle(leaves: list[bytes]) -> str:
    level = list(leaves) or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i:i + 2])).digest() for i in range(0, len(level), 2)]
    return hashlib.sha256(level[0]).hexdigest()


def width_of(tokenizer: str, end_id: int) -> str:
    """Bytes of an id in the files, by the tokenizer's own largest id."""
    from tokenizers import Tokenizer

    top = max([end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()])
    return "<u2" if top < 1 << 16 else "<u4"


#: Order of documents; the place in the input parts repeated ids.
ORDER = ("(doc_id is null)", "doc_id", "nth")


def _root(name: str) -> Column:
    """Hash over the roots of a segment's documents in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*[F.expr(x).alias(f"o{i}") for i, x in enumerate(ORDER)], name)))
    return F.sha2(F.array_join(F.transform(ordered, lambda r: F.coalesce(r[name], F.lit("lost"))), "").cast("binary"), 256)


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Encodes docs (doc_id, text) into a store at `path`, a folder all executors share."""
    spark, width = docs.sparkSession, width_of(tokenizer, end_id)
    kind = docs.schema["doc_id"].dataType.simpleString()
    staged = docs.select("doc_id", "text").mapInArrow(lean(_encode(tokenizer, end_id, width)), STAGED.format(id=kind))
    staged.withColumn("nth", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{path}/staged")
    staged = spark.read.parquet(f"{path}/staged")
    uses = staged.select("nth", F.posexplode("recipe").alias("seq", "address"))
    # Addresses used more than once, with the first use as owner.
    shared = uses.groupBy("address").agg(F.count(F.lit(1)).alias("uses"), F.min("nth").alias("owner")).filter("uses > 1")
    shared.write.parquet(f"{path}/shared")
    shared = spark.read.parquet(f"{path}/shared")
    total = staged.count()
    bits = bits_for(total)
    place = F.pmod(F.xxhash64("nth"), F.lit(bits))
    # A chunk of many documents, such as the empty text's, is met by broadcast.
    sharing = with_groups(uses, shared, ["address"], "uses", total).select("nth", "seq", "address", "owner")
    sharing.write.parquet(f"{path}/sharing")
    sharing = spark.read.parquet(f"{path}/sharing")
    marked = bit_set(sharing.select(place.alias("at")).distinct(), "at")
    flagged = has_bit(staged.withColumn("at", place), "at", marked, bits, "shares").drop("at")
    # A document keeps the payloads that it owns, a chunk repeated within it once; the others become null.
    drop = sharing.groupBy("nth", "address").agg(F.min("seq").alias("first"), F.first("owner").alias("owner"), F.collect_list("seq").alias("seqs"))
    drop = drop.select("nth", F.explode(F.filter("seqs", lambda s: (F.col("owner") != F.col("nth")) | (s != F.col("first")))).alias("seq"))
    drop = drop.groupBy("nth").agg(F.collect_list("seq").alias("foreign"))
    some = flagged.filter("shares").join(drop.hint("merge"), "nth", "left").withColumn("foreign", F.coalesce("foreign", F.array().cast("array<int>")))
    some = some.withColumn("payloads", F.transform("payloads", lambda p, i: F.when(~F.array_contains("foreign", i), p)))
    columns = ["nth", "recipe", "payloads", "shares"]
    packs = flagged.filter("not shares").select(*columns).unionByName(some.select(*columns))
    packs.write.option("compression", "zstd").partitionBy("shares").parquet(f"{path}/packs")
    # Recipes in ascending doc_id order; positions come from the files' own counts.
    order = [F.expr(x) for x in ORDER]
    entries = staged.select("nth", "doc_id", "n_tokens", "root", "recipe").repartitionByRange(max(1, total // ROWS_A_SEGMENT), *order).sortWithinPartitions(*order)
    entries.withColumn("segment", F.spark_partition_id()).write.parquet(f"{path}/recipes")
    discard(spark, f"{path}/staged")
    discard(spark, f"{path}/sharing")
    sums = spark.read.parquet(f"{path}/recipes").groupBy("segment").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("ids"), _root("root").alias("merkle"))
    sums.withColumn("width", F.lit(width)).write.parquet(f"{path}/manifest")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified, from the files alone, for every document of the recipes: one whose
    chunks are lost or altered, or whose segment does not give the manifest's root, is not verified."""
    manifest = spark.read.parquet(f"{path}/manifest")
    widths = manifest.select("width").distinct().collect()
    width = widths[0][0] if widths else "<u2"
    packs = spark.read.schema("nth long, recipe array<binary>, payloads array<binary>, shares boolean").parquet(f"{path}/packs")
    entries = spark.read.parquet(f"{path}/recipes")
    result = "nth long, fine boolean, read_root string, read_n long, ids_crc32 long"
    whole = packs.filter("not shares").select("nth", "recipe", "payloads").mapInArrow(lean(_read(width)), result)
    # Documents that share chunks: owned ones come along, the others from their owners, which share them too.
    parts = packs.filter("shares").select("nth", F.posexplode(F.arrays_zip("recipe", "payloads")).alias("seq", "c")).select("nth", "seq", F.col("c.recipe").alias("address"), F.col("c.payloads").alias("payload"))
    wanted = spark.read.parquet(f"{path}/shared").select("address", "uses", F.col("owner").alias("o"))
    lent = parts.filter("payload is not null").join(wanted.hint("merge"), "address").filter("nth = o").select("address", "uses", F.col("payload").alias("lent"))
    lent = materialise(lent, "lent")
    # At most 1 / HOT_SHARE chunks of MOST ids are broadcast. A chunk whose owner is lost stays null.
    floor = max(64, int(entries.count() * HOT_SHARE))
    needed = parts.filter("payload is null").drop("payload")
    hot = wanted.filter(F.col("uses") >= floor).select("address")
    hot_rows = needed.join(F.broadcast(hot), "address", "left_semi").join(F.broadcast(lent.filter(F.col("uses") >= floor)), "address", "left")
    cold_rows = needed.join(F.broadcast(hot), "address", "left_anti").join(lent.filter(F.col("uses") < floor).hint("merge"), "address", "left")
    filled = hot_rows.unionByName(cold_rows).select("nth", "seq", "address", F.col("lent").alias("payload"))
    filled = parts.filter("payload is not null").select("nth", "seq", "address", "payload").unionByName(filled)
    filled = filled.groupBy("nth").agg(F.array_sort(F.collect_list(F.struct("seq", "address", "payload"))).alias("c"))
    filled = filled.select("nth", F.col("c.address").alias("recipe"), F.col("c.payload").alias("payloads")).mapInArrow(lean(_read(width)), result)
    out = entries.select("nth", "doc_id", "n_tokens", "root", "segment").join(whole.unionByName(filled).hint("merge"), "nth", "left")
    out = materialise(out, "read")
    # Segments as read against the manifest, and where each begins: thousands of segments a step, then the steps.
    found = out.groupBy("segment").agg(_root("read_root").alias("read_merkle"))
    upto = lambda *by: Window.partitionBy(*by).orderBy("segment" if by else "step").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.withColumn("step", F.floor(F.col("segment") / 1000))
    steps = starts.groupBy("step").agg(F.sum("ids").alias("ids"))
    steps = steps.select("step", F.coalesce(F.sum("ids").over(upto()), F.lit(0)).alias("base"))
    starts = starts.withColumn("within", F.coalesce(F.sum("ids").over(upto("step")), F.lit(0))).join(steps, "step")
    starts = starts.join(found, "segment").select("segment", (F.col("base") + F.col("within")).alias("base"), (F.col("merkle") == F.col("read_merkle")).alias("sound"))
    run = F.sum("n_tokens").over(Window.partitionBy("segment").orderBy(*[F.expr(x) for x in ORDER]).rowsBetween(Window.unboundedPreceding, -1))
    fine = F.col("fine") & (F.col("root") == F.col("read_root")) & (F.col("n_tokens") == F.col("read_n")) & F.col("sound")
    out = out.withColumn("run", F.coalesce(run, F.lit(0))).join(starts, "segment")
    return out.select("doc_id", (F.col("base") + F.col("run")).alias("start"), F.coalesce("read_n", F.lit(0)).alias("n_tokens"), "ids_crc32", F.coalesce(fine, F.lit(False)).alias("verified"))


def store_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes a store at `path` and reads it back; without a path the store is deleted once it is read."""
    if path is None:
        return _checked(docs, tokenizer, end_id)
    write_store(docs, tokenizer, end_id, path)
    return read_store(docs.sparkSession, path)


@tidy
def _checked(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    path = scratch(docs.sparkSession, "token-store")
    write_store(docs, tokenizer, end_id, path)
    return read_store(docs.sparkSession, path)
