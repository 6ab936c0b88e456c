"""Diffs of many pairs of refs, from a repository's object store: objects read by partitions, trees compared by joins.

`objects` reads loose objects and packs as a table. A pack is dealt by ranges of its entries in the order of the file, so
a large one is read by many tasks; deltas are resolved against entries of the same pack, wherever they lie. `ref_diffs`
joins the trees of both sides level by level, following only entries that differ, so unchanged folders are never opened.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.linediff import file_diff

#: Kinds of a pack's entries that hold whole objects; the others are deltas by offset and by id.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
BY_OFFSET, BY_ID = 6, 7
SCHEMA = "oid string, kind string, size long, data binary"
#: Bytes of resolved bases that a task remembers, and bytes read from a pack at once.
REMEMBERED, CHUNK = 64 << 20, 1 << 16
#: What stands for a missing side's tree or file.
FOLDER = "40000"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def entries(folder: str):
    """(path, is a folder) of what lies in a folder, hidden names left out; a local folder is read name by name."""
    system, name = _open(folder)
    prefix = folder.rstrip("/") + "/"
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(name) as found:
            for x in found:
                if not x.name.startswith((".", "_")):
                    yield prefix + x.name, x.is_dir()
    else:
        for x in system.get_file_info(fs.FileSelector(name)):
            if not x.base_name.startswith((".", "_")):
                yield prefix + x.base_name, x.type == fs.FileType.Directory


def _names(system: fs.FileSystem, folder: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found)


class _Index:
    """A pack's index, version 2: ids in order, and where each object lies."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError("not an index of version 2")
        self.data = data
        self.count = struct.unpack_from(">I", data, 8 + 255 * 4)[0]
        small = 8 + 1024 + self.count * 24
        raw = struct.unpack_from(f">{self.count}I", data, small)
        large = small + self.count * 4
        self.offsets = [x if x < 1 << 31 else struct.unpack_from(">Q", data, large + 8 * (x & 0x7FFFFFFF))[0] for x in raw]
        self.order = sorted(range(self.count), key=self.offsets.__getitem__)

    def oid(self, i: int) -> bytes:
        return self.data[8 + 1024 + 20 * i:8 + 1024 + 20 * (i + 1)]

    def offset_of(self, oid: bytes) -> int | None:
        i = bisect_left(range(self.count), oid, key=self.oid)
        return self.offsets[i] if i < self.count and self.oid(i) == oid else None


class _Pack:
    """Objects of a pack by their offset."""

    def __init__(self, file, index: _Index):
        self.file, self.index = file, index
        self.bases: OrderedDict[int, tuple[str, bytes]] = OrderedDict()
        self.held = 0

    def _entry(self, offset: int) -> tuple[int, object, bytes]:
        """Kind, base (None, an offset or an id) and inflated content."""
        self.file.seek(offset)
        buffer = self.file.read(CHUNK)
        at, byte = 1, buffer[0]
        kind = byte >> 4 & 7
        while byte & 128:
            byte, at = buffer[at], at + 1
        base = None
        if kind == BY_OFFSET:
            byte, at = buffer[at], at + 1
            back = byte & 127
            while byte & 128:
                byte, at = buffer[at], at + 1
                back = (back + 1 << 7) | byte & 127
            base = offset - back
        elif kind == BY_ID:
            base, at = buffer[at:at + 20], at + 20
        stream, parts = zlib.decompressobj(), []
        buffer = buffer[at:]
        while not stream.eof and buffer:
            parts.append(stream.decompress(buffer))
            if not stream.eof:
                buffer = self.file.read(CHUNK)
        return kind, base, b"".join(parts)

    def read(self, offset: int) -> tuple[str, bytes]:
        deltas = []
        while True:
            if offset in self.bases:
                self.bases.move_to_end(offset)
                kind, data = self.bases[offset]
                break
            number, base, data = self._entry(offset)
            if base is None:
                kind = KINDS[number]
                self._remember(offset, kind, data)
                break
            deltas.append((offset, data))
            offset = base if number == BY_OFFSET else self.index.offset_of(base)
            if offset is None:
                raise ValueError(f"a base is not in its pack: {base.hex()}")
        for place, delta in reversed(deltas):
            data = patched(data, delta)
            self._remember(place, kind, data)
        return kind, data

    def _remember(self, offset: int, kind: str, data: bytes) -> None:
        if offset not in self.bases and len(data) < REMEMBERED // 8:
            self.bases[offset] = (kind, data)
            self.held += len(data)
        while self.held > REMEMBERED:
            self.held -= len(self.bases.popitem(last=False)[1][1])


def patched(base: bytes, delta: bytes) -> bytes:
    """An object from its base and a delta: copies of parts of the base, and bytes of its own."""
    at = 0
    for _ in range(2):  # the sizes of base and result
        while delta[at] & 128:
            at += 1
        at += 1
    out = []
    while at < len(delta):
        code, at = delta[at], at + 1
        if not code & 128:
            out.append(delta[at:at + code])
            at += code
            continue
        offset = size = 0
        for bit in range(7):
            if code >> bit & 1:
                value, at = delta[at], at + 1
                if bit < 4:
                    offset |= value << 8 * bit
                else:
                    size |= value << 8 * (bit - 4)
        size = size or 1 << 16
        out.append(base[offset:offset + size])
    return b"".join(out)


class _Part(InputPartition):
    def __init__(self, pack: str | None, start: int = 0, end: int = 0, folders: tuple[str, ...] = ()):
        self.pack, self.start, self.end, self.folders = pack, start, end, folders


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.per = options["path"].rstrip("/"), int(options.get("objectspertask", 50_000))

    def partitions(self):
        """Loose objects by four of their 256 folders, packs by entries; of an index only its count is read here."""
        system, root = _open(self.path)
        fans = [n for n in _names(system, f"{root}/objects") if len(n) == 2]
        parts = [_Part(None, folders=tuple(fans[i:i + 4])) for i in range(0, len(fans), 4)]
        for name in _names(system, f"{root}/objects/pack"):
            if name.endswith(".idx"):
                with system.open_input_file(f"{root}/objects/pack/{name}") as f:
                    count = struct.unpack(">I", f.read_at(4, 8 + 255 * 4))[0]
                parts += [_Part(name[:-4], i, min(i + self.per, count)) for i in range(0, count, self.per)]
        return parts or [_Part(None)]

    def read(self, part):
        system, root = _open(self.path)
        if part.pack is None:
            for folder in part.folders:
                for name in _names(system, f"{root}/objects/{folder}"):
                    if len(name) != 38:  # a file that is being written
                        continue
                    with system.open_input_file(f"{root}/objects/{folder}/{name}") as f:
                        head, _, data = zlib.decompress(f.read()).partition(b"\0")
                    yield folder + name, head.split(b" ")[0].decode(), len(data), data
            return
        base = f"{root}/objects/pack/{part.pack}"
        with system.open_input_file(f"{base}.idx") as f:
            index = _Index(f.read())
        with system.open_input_file(f"{base}.pack") as f:
            pack = _Pack(f, index)
            for i in index.order[part.start:part.end]:
                kind, data = pack.read(index.offsets[i])
                yield index.oid(i).hex(), kind, len(data), data


class GitObjects(DataSource):
    """Format `git_objects`: option path is a repository's .git folder, objectsPerTask the entries of a pack a task reads."""

    @classmethod
    def name(cls):
        return "git_objects"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def objects(spark: SparkSession, git_dir: str, per_task: int = 50_000) -> DataFrame:
    """oid, kind, size, data of all objects of a repository; one that lies in several packs comes several times."""
    spark.dataSource.register(GitObjects)
    return spark.read.format("git_objects").option("path", git_dir).option("objectsPerTask", str(per_task)).load()


def refs(spark: SparkSession, git_dir: str) -> DataFrame:
    """ref, oid: branches and tags by their short and full names, and HEAD. A loose ref outweighs a packed one."""
    system, root = _open(git_dir.rstrip("/"))

    def text(path: str) -> str:
        with system.open_input_file(path) as f:
            return f.read().decode().strip()

    found = {}
    if system.get_file_info(f"{root}/packed-refs").type == fs.FileType.File:
        for line in text(f"{root}/packed-refs").splitlines():
            oid, _, name = line.partition(" ")
            if line[:1] not in ("#", "^", ""):
                found[name] = oid
    for info in system.get_file_info(fs.FileSelector(f"{root}/refs", recursive=True, allow_not_found=True)):
        if info.type == fs.FileType.File:
            found["refs/" + info.path.split("/refs/", 1)[1]] = text(info.path)
    head = text(f"{root}/HEAD")
    head = found.get(head.removeprefix("ref: ")) if head.startswith("ref: ") else head
    rows = [(name, oid) for name, oid in found.items()]
    rows += [(name.removeprefix(kind), oid) for kind in ("refs/tags/", "refs/heads/") for name, oid in found.items() if name.startswith(kind)]
    rows += [("HEAD", head)] if head else []
    return spark.createDataFrame(sorted(dict(rows).items()), "ref string, oid string")


def _parse_trees(batches):
    """tree, name, mode, oid of every entry of tree objects (oid, data)."""
    for batch in batches:
        trees, names, modes, oids = [], [], [], []
        for tree, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at = 0
            while at < len(data):
                space = data.index(b" ", at)
                end = data.index(b"\0", space)
                trees.append(tree)
                modes.append(data[at:space].decode())
                names.append(data[space + 1:end])
                oids.append(data[end + 1:end + 21].hex())
                at = end + 21
        yield pa.record_batch({"tree": pa.array(trees, pa.string()), "name": pa.array(names, pa.binary()), "mode": pa.array(modes, pa.string()), "oid": pa.array(oids, pa.string())})


def _cut(df: DataFrame, work: str) -> DataFrame:
    path = f"{work}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(store: DataFrame, work: str) -> DataFrame:
    """The rows of objects(), read once and kept in a new folder below work by kind: of what is asked of them after that only
    the kind in question is read, and no object is opened or unpacked again."""
    path = f"{work}/{uuid.uuid4().hex}"
    store.write.partitionBy("kind").parquet(path)
    return store.sparkSession.read.schema(SCHEMA).parquet(path).select("oid", "kind", "size", "data")


def changed_files(store: DataFrame, pairs: DataFrame, work: str) -> DataFrame:
    """split_id, path (binary), old_mode, old_oid, new_mode, new_oid of the files that differ between base and head, object
    ids of commits or trees in pairs (split_id, base, head). work: a shared folder for the rows of each level."""
    store = store.filter("kind in ('commit', 'tree')").dropDuplicates(["oid"])
    commits = store.filter("kind = 'commit'").select("oid", F.regexp_extract(F.decode("data", "ISO-8859-1"), "^tree ([0-9a-f]{40})", 1).alias("tree"))
    entries = _cut(store.filter("kind = 'tree'").select("oid", "data").mapInArrow(_parse_trees, "tree string, name binary, mode string, oid string"), work)
    of = lambda side: commits.select(F.col("oid").alias(side), F.col("tree").alias(f"{side}_tree"))
    open_ = pairs.join(of("base"), "base", "left").join(of("head"), "head", "left").select(
        "split_id", F.lit(b"").alias("at"), F.coalesce("base_tree", "base").alias("old"), F.coalesce("head_tree", "head").alias("new"),
    ).filter(~F.col("old").eqNullSafe(F.col("new")))
    found = None
    while True:
        open_ = _cut(open_, work)
        if not open_.head(1):
            break
        side = lambda c: open_.join(entries, F.col(c) == F.col("tree")).select("split_id", "at", "name", F.struct("mode", "oid").alias(f"{c}_entry"))  # noqa: E731, B023
        both = side("old").join(side("new"), ["split_id", "at", "name"], "full").filter(~F.col("old_entry").eqNullSafe(F.col("new_entry")))
        path = F.when(F.length("at") == 0, F.col("name")).otherwise(F.concat("at", F.lit(b"/"), "name"))
        both = both.select("split_id", path.alias("path"), "old_entry", "new_entry")
        both = _cut(both, work)
        folder = lambda c: F.when(F.col(f"{c}_entry.mode") == FOLDER, F.col(f"{c}_entry.oid"))
        plain = lambda c: F.when(F.col(f"{c}_entry.mode") != FOLDER, F.col(f"{c}_entry"))
        open_ = both.select("split_id", F.col("path").alias("at"), folder("old").alias("old"), folder("new").alias("new")).filter("(old is not null or new is not null) and not old <=> new")
        files = both.select("split_id", "path", plain("old").alias("a"), plain("new").alias("b")).filter("a is not null or b is not null")
        files = files.select("split_id", "path", F.col("a.mode").alias("old_mode"), F.col("a.oid").alias("old_oid"), F.col("b.mode").alias("new_mode"), F.col("b.oid").alias("new_oid"))
        found = files if found is None else found.unionByName(files)
    empty = "split_id string, path binary, old_mode string, old_oid string, new_mode string, new_oid string"
    return pairs.sparkSession.createDataFrame([], empty) if found is None else found


def _diffs(batches):
    for batch in batches:
        out = []
        for path, old_mode, old_oid, old, new_mode, new_oid, new in zip(*[batch.column(c).to_pylist() for c in ("path", "old_mode", "old_oid", "old", "new_mode", "new_oid", "new")], strict=True):
            # a file that becomes a link or a module, or the reverse, goes and comes again
            before, after = (old_mode, old_oid, old or b"") if old_mode else None, (new_mode, new_oid, new or b"") if new_mode else None
            if before and after and before[0][:3] != after[0][:3]:
                text = file_diff(path, before, None) + file_diff(path, None, after)
            else:
                text = file_diff(path, before, after)
            out.append(text.decode("utf-8", "replace"))
        yield pa.record_batch({"split_id": batch.column("split_id"), "path": batch.column("path"), "diff": pa.array(out, pa.string())})


def file_diffs(store: DataFrame, files: DataFrame) -> DataFrame:
    """split_id, path, diff of each row of changed_files(). Modules of other repositories show their commit's id."""
    blobs = store.filter("kind = 'blob'").dropDuplicates(["oid"]).select("oid", "data")
    module = lambda c: F.when(F.col(f"{c}_mode") == "160000", F.concat(F.lit("Subproject commit "), F.col(f"{c}_oid"), F.lit("\n")).cast("binary"))
    of = lambda c: blobs.select(F.col("oid").alias(f"{c}_oid"), F.col("data").alias(f"{c}_data"))
    rows = files.join(of("old"), "old_oid", "left").join(of("new"), "new_oid", "left")
    rows = rows.select("split_id", "path", "old_mode", "old_oid", F.coalesce("old_data", module("old")).alias("old"), "new_mode", "new_oid", F.coalesce("new_data", module("new")).alias("new"))
    return rows.mapInArrow(_diffs, "split_id string, path binary, diff string")


def ref_diffs(store: DataFrame, names: DataFrame, pairs: DataFrame, work: str) -> DataFrame:
    """split_id, value: the diff of each pair (split_id, base, head) of refs, ids of commits or trees; renames are shown as
    files that go and come. store: objects(), names: refs(). A pair without differences, or with a ref that neither names
    nor the store know, gives no row."""
    oid = lambda side: F.coalesce(F.col(f"{side}_oid"), F.col(side)).alias(side)
    of = lambda side: names.select(F.col("ref").alias(side), F.col("oid").alias(f"{side}_oid"))
    known = pairs.join(of("base"), "base", "left").join(of("head"), "head", "left").select("split_id", oid("base"), oid("head"))
    store = stored(store, work)
    here = store.filter("kind in ('commit', 'tree')").select("oid").distinct()
    for side in ("base", "head"):
        known = known.join(here.withColumnRenamed("oid", side), side, "left_semi")
    each = file_diffs(store, changed_files(store, known, work))
    ordered = F.array_sort(F.collect_list(F.struct("path", "diff")))
    return each.groupBy("split_id").agg(F.array_join(F.transform(ordered, lambda x: x["diff"]), "").alias("value"))


def oid_of(kind: str, data: bytes) -> str:
    return hashlib.sha1(kind.encode() + b" %d\0" % len(data) + data).hexdigest()


def loose(kind: str, data: bytes) -> tuple[str, bytes]:
    """The id and the file of an object that is stored by itself."""
    whole = kind.encode() + b" %d\0" % len(data) + data
    return hashlib.sha1(whole).hexdigest(), zlib.compress(whole)


def pack(objects: list[tuple[str, bytes]]) -> tuple[str, bytes, bytes]:
    """The name of a pack of whole objects (kind, data), the pack and its index of version 2; each object lies there once."""
    code, entries = {kind: i for i, kind in KINDS.items()}, {}
    parts, at = [b"PACK" + struct.pack(">II", 2, 0)], 12
    for kind, data in objects:
        oid = bytes.fromhex(oid_of(kind, data))
        if oid in entries:
            continue
        size, head = len(data) >> 4, [code[kind] << 4 | len(data) & 15]
        while size:
            head[-1] |= 128
            head.append(size & 127)
            size >>= 7
        part = bytes(head) + zlib.compress(data)
        entries[oid] = (zlib.crc32(part), at)
        parts.append(part)
        at += len(part)
    parts[0] = b"PACK" + struct.pack(">II", 2, len(entries))
    whole = b"".join(parts)
    whole += hashlib.sha1(whole).digest()
    ids = sorted(entries)
    fans = struct.pack(">256I", *(bisect_right(ids, bytes([i]) + b"\xff" * 20) for i in range(256)))
    large = [entries[oid][1] for oid in ids if entries[oid][1] >= 1 << 31]
    nth = {x: i for i, x in enumerate(large)}
    places = [(1 << 31) + nth[x] if x in nth else x for x in (entries[oid][1] for oid in ids)]
    crcs = struct.pack(f">{len(ids)}I", *(entries[oid][0] for oid in ids))
    index = b"\xfftOc\x00\x00\x00\x02" + fans + b"".join(ids) + crcs + struct.pack(f">{len(ids)}I", *places) + struct.pack(f">{len(large)}Q", *large) + whole[-20:]
    return whole[-20:].hex(), whole, index + hashlib.sha1(index).digest()
