"""Operator 9: token-id files with a minimal perfect hash index.

``write`` encodes every text, appends an end id to each, deals the rows into ascending ranges of the key and
writes one shard per range into the shared folder:

- ``<shard>.ids``: the raw ids, little-endian, row after row in ascending key order;
- ``<shard>.idx``: per row its key and end offset; and a minimal perfect hash from each distinct key to a
  slot that holds a stored 32-bit fingerprint and the key's rows.

A lookup picks the shard by its key range, hashes the key once, compares the fingerprint (then the key) and reads
the rows' ids at their offset: constant time over raw payloads. ``read`` gives all rows back from the files.

Rows of one task are streamed to the file; the task holds the shard's index, never its payload. File names carry a
random part and only those of finished tasks enter the manifest, so a repeated task does no harm.

Defined cases: a null or empty text has the end id alone. Null keys come first, in the first shard; they are found
by the key None. Rows of equal keys stay together, ordered by their ids. An empty table gives a manifest with no
rows. Other columns of the table are not read.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge.llm import common, pretokens

MAGIC = b"OIDS0001"
END_ID = 0
_M = (1 << 64) - 1


def _mix(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """A 64-bit mixer; equal on every machine."""
    x = keys.astype(np.uint64) + np.asarray(seed, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minimal_perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The levels of distinct int64 keys: their widths, and the bits of all levels one after the other.

    A key that is alone at its position in a level sets its bit there; keys that collide go on to the next level,
    with another hash. A key's slot is the number of set bits before its own: every slot from 0 to n - 1 once.
    """
    rest, widths, levels = keys.astype(np.int64).view(np.uint64), [], []
    while len(rest):
        width = -(-2 * len(rest) // 64) * 64
        at = (_mix(rest, len(widths) + 2) % np.uint64(width)).astype(np.int64)
        alone = np.bincount(at, minlength=width) == 1
        widths.append(width)
        levels.append(alone)
        rest = rest[~alone[at]]
    return np.array(widths, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool)


class Slots:
    """The slots of a minimal perfect hash; constant time for a key, by counts of set bits before each word of 64."""

    def __init__(self, widths: np.ndarray, bits: np.ndarray):
        self.widths, self.bits = widths, bits
        self.before = np.concatenate(([0], np.cumsum(bits.reshape(-1, 64).sum(axis=1)))) if len(bits) else np.zeros(1, np.int64)

    def one(self, key: int) -> int:
        """The slot of a key of the set; for any other key some slot, or -1."""
        begin, own = 0, np.array([key], np.int64).view(np.uint64)
        for level, width in enumerate(self.widths.tolist()):
            at = begin + int(_mix(own, level + 2)[0] % np.uint64(width))
            if self.bits[at]:
                return int(self.before[at // 64] + self.bits[at // 64 * 64 : at].sum())
            begin += width
        return -1

    def all(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys that are all of the set."""
        keys = keys.astype(np.int64).view(np.uint64)
        rank = np.cumsum(self.bits) - 1
        slot, rest, begin = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, width in enumerate(self.widths.tolist()):
            at = begin + (_mix(keys[rest], level + 2) % np.uint64(width)).astype(np.int64)
            hit = self.bits[at]
            slot[rest[hit]] = rank[at[hit]]
            rest, begin = rest[~hit], begin + width
        return slot


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype(np.int64).view(np.uint64), 0xF1) >> np.uint64(32)).astype(np.uint32)


def pack_index(keys: list[int | None], lengths: list[int], dtype: np.dtype) -> bytes:
    """The index of a shard whose rows come in key order, nulls first. Offsets count ids."""
    nulls = sum(k is None for k in keys)
    rows = np.array([0 if k is None else k for k in keys], np.int64)
    ends = np.cumsum(np.array(lengths, np.int64)) if lengths else np.zeros(0, np.int64)
    distinct, first, count = np.unique(rows[nulls:], return_index=True, return_counts=True)
    widths, bits = minimal_perfect_hash(distinct)
    slot = Slots(widths, bits).all(distinct)
    marks, at, many = (np.zeros(len(distinct), t) for t in (np.uint32, np.int64, np.int64))
    marks[slot], at[slot], many[slot] = fingerprints(distinct), first + nulls, count
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<5q", dtype.itemsize, len(rows), nulls, len(distinct), len(widths)))
    for array in (rows, ends, widths, np.packbits(bits), marks, at, many):
        out.write(array.astype(array.dtype.newbyteorder("<")).tobytes())
    return out.getvalue()


class ShardIndex:
    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not an index of token ids")
        width, n, self.nulls, self.n_keys, m = struct.unpack_from("<5q", data, 8)
        self.dtype, at = np.dtype(f"<u{width}"), 48

        def array(kind: str, size: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, size, at)
            at += found.nbytes
            return found

        self.keys, self.ends, widths = array("<i8", n), array("<i8", n), array("<i8", m)
        self.slots = Slots(widths, np.unpackbits(array("u1", int(widths.sum()) // 8)).astype(bool))
        self.marks, self.first, self.many = array("<u4", self.n_keys), array("<i8", self.n_keys), array("<i8", self.n_keys)

    def rows(self, key: int | None) -> range:
        """The rows of a key: one hash, one fingerprint, one comparison."""
        if key is None:
            return range(self.nulls)
        slot = self.slots.one(key)
        if slot < 0 or self.marks[slot] != fingerprints(np.array([key]))[0] or self.keys[self.first[slot]] != key:
            return range(0)
        return range(self.first[slot], self.first[slot] + self.many[slot])

    def span(self, row: int) -> tuple[int, int]:
        return (int(self.ends[row - 1]) if row else 0), int(self.ends[row])


def _encode(cuts: list[int], path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pretokens.encoder(path or pretokens.vocabulary())
        end = np.array([end_id], coder.dtype).tobytes()
        edges = np.array(cuts, np.int64)
        for batch in batches:
            for part in common.pieces(batch, "text", 1 << 20):
                keys = part.column("doc_id")
                dealt = np.searchsorted(edges, np.asarray(keys.fill_null(0)), side="left").astype(np.int32)
                dealt[np.asarray(keys.is_null())] = 0
                ids = [x + end for x in coder.encode(part.column("text").to_pylist())]
                yield pa.record_batch([pa.array(dealt), keys, pa.array(ids, pa.binary())], ["shard", "doc_id", "ids"])

    return run


def _write(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = common.filesystem(folder)
        shard, keys, lengths, out, name = None, [], [], None, ""

        def close():
            out.close()
            with system.open_output_stream(f"{path}/{name}.idx") as index:
                index.write(pack_index(keys, lengths, np.dtype(f"<u{width}")))
            known = [k for k in keys if k is not None]
            row = (shard, name, len(keys), sum(lengths), known[0] if known else None, known[-1] if known else None)
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                                   ["shard", "name", "n_rows", "n_ids", "first_key", "last_key"])

        system.create_dir(path, recursive=True)
        for batch in batches:
            dealt = np.asarray(batch.column("shard"))
            ids = batch.column("ids")
            ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
            payload = memoryview(ids.buffers()[2]) if ids.buffers()[2] is not None else memoryview(b"")
            cuts = np.flatnonzero(dealt[1:] != dealt[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(dealt)]):
                if a == b:
                    continue
                s = int(dealt[a])
                if s != shard:
                    if out is not None:
                        yield close()
                    shard, keys, lengths = s, [], []
                    name = f"shard-{s:05d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(f"{path}/{name}.ids")
                out.write(payload[int(ends[a]) : int(ends[b])])
                keys += batch.column("doc_id")[a:b].to_pylist()
                lengths += (np.diff(ends[a : b + 1]) // width).tolist()
        if out is not None:
            yield close()

    return run


def write(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Writes the files of ``docs(doc_id, text)``; returns the manifest, a row per shard.

    ``tokenizer``: a tokenizers file, by default the public 50k vocabulary as each machine has it.
    """
    spark = docs.sparkSession
    folder = folder or common.shared_folder(spark, "token-ids")
    shards = shards or common.partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))
    width = pretokens.encoder(tokenizer or pretokens.vocabulary()).dtype.itemsize
    rows = docs.mapInArrow(_encode(common.id_cuts(docs, "doc_id", shards), tokenizer, end_id), "shard int, doc_id long, ids binary")
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    files = rows.mapInArrow(_write(folder, width), "shard int, name string, n_rows long, n_ids long, first_key long, last_key long")
    return common.stage_table(files.withColumn("folder", F.lit(folder)), "token-manifest")


def _runs(index: ShardIndex, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Runs of at most so many rows, and of at most ``most`` ids where they have more than one row."""
    at = 0
    while at < len(index.keys):
        begin = int(index.ends[at - 1]) if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(index.ends, begin + most, side="right"))))
        yield at, to
        at = to


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, path = common.filesystem(row["folder"])
            with system.open_input_file(f"{path}/{row['name']}.idx") as f:
                index = ShardIndex(f.read())
            with system.open_input_file(f"{path}/{row['name']}.ids") as f:
                for at, to in _runs(index, 512, 1 << 26):
                    begin, end = index.span(at)[0], index.span(to - 1)[1]
                    f.seek(begin * index.dtype.itemsize)
                    ids = np.frombuffer(f.read((end - begin) * index.dtype.itemsize), index.dtype).astype("<u4")
                    edges = np.concatenate(([begin], index.ends[at:to]))
                    keys = pa.array(index.keys[at:to], mask=np.arange(at, to) < index.nulls)
                    places = pa.py_buffer((4 * (edges - begin)).astype(np.int32).tobytes())
                    own = pa.Array.from_buffers(pa.binary(), to - at, [None, places, pa.py_buffer(ids.tobytes())])
                    yield pa.record_batch([keys, pa.array(edges[:-1] + row["base"]), own], ["doc_id", "start", "ids"])


def read(manifest: DataFrame) -> DataFrame:
    """All rows of the files: doc_id, start (ids of all rows before it) and ids (32-bit, little-endian).

    Only the manifest's counts, one row per shard, pass through the driver, to place each shard.
    """
    spark = manifest.sparkSession
    base, rows = 0, []
    for r in manifest.orderBy("shard").collect():
        rows.append((r.folder, r.name, base))
        base += r.n_ids
    placed = spark.createDataFrame(rows, "folder string, name string, base long")
    return placed.repartition(max(1, len(rows))).mapInArrow(_read, "doc_id long, start long, ids binary")


def lookup(manifest_rows: list, key: int | None) -> list[np.ndarray]:
    """The ids of every row with this key, from the files; ``manifest_rows`` are the manifest's collected rows."""
    found = []
    for r in manifest_rows:
        if key is not None and (r.first_key is None or not r.first_key <= key <= r.last_key):
            continue
        system, path = common.filesystem(r.folder)
        with system.open_input_file(f"{path}/{r.name}.idx") as f:
            index = ShardIndex(f.read())
        with system.open_input_file(f"{path}/{r.name}.ids") as f:
            for row in index.rows(key):
                begin, end = index.span(row)
                f.seek(begin * index.dtype.itemsize)
                found.append(np.frombuffer(f.read((end - begin) * index.dtype.itemsize), index.dtype))
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(write(common.table(spark, sf_dir, "documents")))
    return ids.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
