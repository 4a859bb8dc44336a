"""Operator 6: exact n-gram Jaccard join by T-occurrence search with DivideSkip, and its connected components.

A text's set holds its distinct runs of five words (or the whole sequence, if it is shorter). Sets with n and m members
link when 100 * overlap >= 75 * union, so a partner holds at least T = ceil(0.75 n) of a set's members.

1. One pass hashes the texts and writes each distinct set once per task; equal sets are one node from the start, so copies never
   meet as pairs.
2. DivideSkip: a set's inverted lists are divided into T - 1 long ones and n - T + 1 short ones. Every partner is on one
   of the short lists, so only these are merged: postings are sorted by list in the shuffle, and each list is read as a
   stream. Which lists are long follows from an overall order of the members: those found frequent while reading all data
   come last, the others by hash. (Any one order gives the exact result; this one keeps common passages out of the merge.)
3. On a list, every node is paired with the list's first node of a size it can link with (a star: as many pairs as nodes).
   Pairs whose short lists leave too few members for T are dropped; of the others the long lists are probed by binary
   search in the sorted sets, and linked nodes are joined to components.
4. Lists on which nodes of different components remain (one of those that hold the same nodes) get further stars
   with a few other centres: the first nodes of the list in an order that changes with the round and is the same on all lists,
   so lists of one group of near copies share their centres. A round costs a few pairs per node; a group of near copies
   falls together after some, and nodes of the own component are no partners any more. Rounds end when they join little.
   From here on a set's members are also counted in 256 bins: the counts that two sets have in common bound their
   overlap from above, and only pairs whose bound reaches T leave a list.
5. What is then still apart is compared list by list, now every pair of different components whose sizes and bins allow a link.
   Long lists are cut into a grid of tiles of bounded size.
6. Components are found by passing on minima. Every stage is a table; tables that are read no more are deleted.

Defined cases: null and empty texts and texts without words have an empty set and link with nothing; rows of a null doc_id
link with nothing and have a null component. Equal rows are one class. Rows that share a doc_id with different texts are
documents of their own, each in the component of its text (a doc_id links nothing by itself). Members are told apart
by 64-bit hashes. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge.llm import common

WORDS = 5
#: Likeness in hundredths.
LEAST = 75
#: Occurrences from which a member counts as frequent, of which a task must have seen some, and the bits that mark them.
FREQUENT, SEEN = 64, 4
BITS = 1 << 22
#: Members whose occurrences a task remembers at a time; the rarest are forgotten beyond.
REMEMBERED = 1 << 20
#: Pairs of one node that a task takes.
FAN = 512
#: Further rounds of stars, the centres of a list in each, and the share of the pairs probed that must link for another round.
ROUNDS, CENTRES, WORTH = 1, 8, 0.02
#: Bins of a set's members, and nodes of a list that a tile takes from each of two blocks.
BINS, TILE = 256, 1024
#: Tasks over which the lists of one first node are spread.
SALTS = 2
FULL = 255
SLICE = 1 << 20

_BASE = 0xD6E8FEB86659FD93
_LETTER = np.array([not (x == 32 or 9 <= x <= 13) for x in range(256)])
_ODD = np.array([pow(0xA0761D6478BD642F, k, 1 << 64) for k in range(1, WORDS + 1)], np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64, for n places."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct member hashes of each text; all words of a slice are hashed at once."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        data, total, j = [], 0, i
        while j < len(texts) and (j == i or total + len(texts[j]) <= SLICE):
            data.append(texts[j].encode())
            total += len(texts[j])
            j += 1
        out += _slice_sets(data)
        i = j
    return out


def _slice_sets(data: list[bytes]) -> list[np.ndarray]:
    none = np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join(data).lower(), np.uint8)  # bytes lower-case A-Z alone
    letter = _LETTER[raw]
    starts = np.flatnonzero(letter & ~np.concatenate(([False], letter[:-1]))) if len(raw) else np.zeros(0, np.int64)
    if not len(starts):
        return [none] * len(data)
    # a word's hash sums its bytes times powers of a base by place; the place of its first byte is divided out
    powers, inverse = _powers(1 << (len(raw) - 1).bit_length())
    terms = (raw + letter).astype(np.uint64) * letter * powers[: len(raw)]
    words = _scramble(np.add.reduceat(terms, starts) * inverse[starts])
    begins = np.cumsum([0] + [len(x) + 1 for x in data[:-1]])
    first = np.searchsorted(starts, begins, side="left").tolist() + [len(starts)]
    runs = np.zeros(0, np.uint64)
    if len(words) >= WORDS:
        runs = words[: len(words) - WORDS + 1] * _ODD[0]
        for k in range(1, WORDS):
            runs = runs + words[k : len(words) - WORDS + 1 + k] * _ODD[k]
        runs = _scramble(runs)
    out = []
    for a, b in zip(first, first[1:]):
        if b - a >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        elif b > a:
            out.append(_scramble((words[a:b] * _ODD[: b - a]).sum(dtype=np.uint64).reshape(1) + np.uint64(b - a)))
        else:
            out.append(none)
    return out


def node_of(members: np.ndarray) -> int:
    """The identity of a set, as a signed 64-bit number."""
    return int(_scramble(np.array([_scramble(members).sum(dtype=np.uint64) + np.uint64(len(members))], np.uint64)).view(np.int64)[0])


def links(n: int, m: int, overlap: int) -> bool:
    return n > 0 and m > 0 and 100 * overlap >= LEAST * (n + m - overlap)


def _fits(small, large):
    """Could sets of these sizes link?"""
    return 100 * small >= LEAST * large


_READ = "doc_id long, node long, n long, members binary, member boolean"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (its set's node and size; the set itself with the first of its node in the task), and after them a
    row per member that the task has seen often (node: the member, n: how often)."""
    names = [c.split()[0] for c in _READ.split(", ")]
    seen: set[int] = set()
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    fresh: list[np.ndarray] = []

    def merge() -> None:
        nonlocal keys, counts
        own, n = np.unique(np.concatenate(fresh), return_counts=True)
        fresh.clear()
        keys, place = np.unique(np.concatenate((keys, own)), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate((counts, n))).astype(np.int64)
        while len(keys) > REMEMBERED:  # all counts fall until enough are at nothing
            counts = counts - max(1, int(counts.min()))
            keys, counts = keys[counts > 0], counts[counts > 0]

    for batch in batches:
        for part in common.pieces(batch, "text", SLICE):
            own = sets(part.column("text").to_pylist())
            nodes = [node_of(s) for s in own]
            written: list[bytes | None] = []
            for s, node, known in zip(own, nodes, part.column("doc_id").is_valid().to_pylist()):
                first = known and len(s) > 0 and node not in seen
                if first:
                    seen.add(node)
                    fresh.append(s)
                written.append(s.astype("<u8").tobytes() if first else None)
            if sum(map(len, fresh)) > REMEMBERED:
                merge()
            yield pa.record_batch([part.column("doc_id"), pa.array(nodes, pa.int64()), pa.array([len(s) for s in own], pa.int64()),
                                   pa.array(written, pa.binary()), pa.array(np.zeros(len(own), bool))], names)
    if fresh:
        merge()
    often = counts >= SEEN - 1
    many = int(often.sum())
    yield pa.record_batch([pa.nulls(many, pa.int64()), pa.array(keys[often].view(np.int64)), pa.array(counts[often]), pa.nulls(many, pa.binary()),
                           pa.array(np.ones(many, bool))], names)


def _members(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in batch.column("members").to_pylist()]


def frequent_bits(members: DataFrame) -> np.ndarray:
    """A fixed number of bits that mark the frequent members (and, by chance, a few more): 512 KB on the driver and in tasks."""
    return _marked(members.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "node")


def _marked(rows: DataFrame, column: str) -> np.ndarray:
    """A fixed number of bits, with those set where a value of the column falls."""
    place = F.pmod(F.col(column), F.lit(BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(32)).cast("int"))
    bits = np.zeros(BITS // 32, np.uint32)
    for r in rows.groupBy(F.floor(place / 32).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).collect():
        bits[r["word"]] = r["bits"]
    return np.unpackbits(bits.astype("<u4").view(np.uint8), bitorder="little").astype(bool)


def short_lists(members: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The members whose lists are merged: all but the T - 1 last in the overall order."""
    n = len(members)
    keep = n - -(-LEAST * n // 100) + 1
    hot = frequent[(members.view(np.int64) % BITS)]
    rare = members[~hot]
    return rare[:keep] if len(rare) >= keep else np.concatenate((rare, members[hot][: keep - len(rare)]))


def _postings(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(frequent.value).astype(bool)
        for batch in batches:
            for part in common.pieces(batch, "members", SLICE):
                own = _members(part)
                lists = [short_lists(s, bits) for s in own]
                many = [len(x) for x in lists]
                if many:
                    yield pa.record_batch([pa.array(np.concatenate(lists).view(np.int64)), pa.array(np.repeat(np.asarray(part.column("node")), many)),
                                           pa.array(np.repeat(np.array([len(s) for s in own], np.int32), many))], ["member", "node", "n"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads lists as a stream, sorted by member, size and node: a row per node with its star's centre; lists of one node go.

    Where a list goes on with a new centre whose size still fits the nodes before, a bridge row leads from the old to the new."""
    member = centre = None
    centre_n = last_n = last_node = 0
    alone: tuple | None = None
    for batch in batches:
        rows: list[tuple] = []
        members = batch.column("member").to_numpy()
        # nodes that are alone on their list, most of all, are passed over at once
        edge = np.flatnonzero(members[1:] != members[:-1]) + 1
        starts = np.concatenate(([0], edge))
        ends = np.concatenate((edge, [len(members)]))
        nodes, sizes = batch.column("node").to_numpy(), batch.column("n").to_numpy()
        long = (ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            for m, node, n in zip(members[a:b].tolist(), nodes[a:b].tolist(), sizes[a:b].tolist()):
                if m != member:
                    member, centre, centre_n, last_n, last_node, alone = m, node, n, n, node, (m, node, node, n, False)
                    continue
                if node == last_node:
                    continue
                if alone is not None:
                    rows.append(alone)
                    alone = None
                if _fits(centre_n, n):
                    rows.append((m, centre, node, n, False))
                else:
                    if _fits(last_n, n):
                        rows.append((m, centre, node, n, True))
                    rows.append((m, node, node, n, False))
                    centre, centre_n = node, n
                last_n, last_node = n, node
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["member", "centre", "node", "n", "bridge"])


def sketch(members: np.ndarray) -> np.ndarray:
    """How many members fall in each bin (at most what 8 bits hold)."""
    return np.minimum(np.bincount((members >> np.uint64(56)).astype(np.int64), minlength=BINS), FULL).astype(np.uint8)


def reachable(n: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which sets (rows: sizes n, sketches a; columns: m, b) may link by their sizes and the members that their bins have in common."""
    fits = _fits(np.minimum(n[:, None], m[None, :]), np.maximum(n[:, None], m[None, :]))
    full_a, full_b = (a == FULL).any(1), (b == FULL).any(1)  # bins that may hold more than they say
    x, y = np.nonzero(fits)
    for at in range(0, len(x), 1 << 14):
        i, j = x[at : at + (1 << 14)], y[at : at + (1 << 14)]
        shared = np.minimum(a[i], b[j]).sum(1, dtype=np.int64)
        full = full_a[i] & full_b[j]
        fits[i, j] = full | ((100 + LEAST) * shared >= LEAST * (n[i].astype(np.int64) + m[j]))
    return fits


class _Pairs:
    """Pairs of nodes found so far in a task (as far as it remembers them), each given out once."""

    def __init__(self):
        self.done: set[tuple[int, int]] = set()
        self.rows: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for pair in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()):
            if pair not in self.done:
                self.done.add(pair)
                self.rows.append(pair)
        if len(self.done) > REMEMBERED:
            self.done.clear()

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.record_batch([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], ["a", "b"])


class _Part:
    """Rows of a list: node, size, component and sketch."""

    def __init__(self, batch: pa.RecordBatch):
        self.node, self.n, self.comp = (np.asarray(batch.column(c)) for c in ("node", "n", "comp"))
        self.sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)

    def at(self, rows) -> _Part:
        out = object.__new__(_Part)
        out.node, out.n, out.comp, out.sketch = self.node[rows], self.n[rows], self.comp[rows], self.sketch[rows]
        return out

    def with_rows(self, other: _Part) -> _Part:
        out = object.__new__(_Part)
        out.node, out.n, out.comp, out.sketch = (np.concatenate((getattr(self, k), getattr(other, k))) for k in ("node", "n", "comp", "sketch"))
        return out

    def meet(self, other: _Part, out: _Pairs) -> None:
        """Pairs across the two whose components differ and whose sizes and sketches allow a link."""
        for at in range(0, len(self.node), 128):
            own = self.at(slice(at, at + 128))
            apart = own.comp[:, None] != other.comp[None, :]
            some = np.flatnonzero(apart.any(1))
            if len(some):
                own = own.at(some)
                i, j = np.nonzero(apart[some] & reachable(own.n, own.sketch, other.n, other.sketch))
                out.add(own.node[i], other.node[j])


def _keyed(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, bool, bool]]:
    """The batches cut at every change of the sorted keys: (rows of one key, is the key new, last rows of the batch)."""
    last = None
    for batch in batches:
        own = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in keys], axis=1)
        cuts = np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
            if a < b:
                yield batch.slice(a, b - a), last != tuple(own[a]), b == len(own)
                last = tuple(own[a])


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists in the round's order: the pairs of their first nodes with all."""
    out, centres = _Pairs(), None
    for rows, new, end in _keyed(batches, ("member",)):
        part = _Part(rows)
        if new:
            centres = part.at(slice(0, CENTRES))
        elif len(centres.node) < CENTRES:
            centres = centres.with_rows(part.at(slice(0, CENTRES - len(centres.node))))
        centres.meet(part, out)
        if end:
            yield out.batch()


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a tile: of its two blocks, or within its one."""
    out = _Pairs()
    held: list[pa.RecordBatch] = []

    def close() -> None:
        if held:
            tile = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            block, part = np.asarray(tile.column("block")), _Part(tile)
            first = block == block.min()
            part.at(first).meet(part if first.all() else part.at(~first), out)
            held.clear()

    for rows, new, end in _keyed(batches, ("member", "high", "wide")):
        if new:
            close()
        held.append(rows)
        if end:
            yield out.batch()
    close()
    yield out.batch()


def _wanted(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(marks[np.asarray(batch.column("node")) % BITS]))

    return run


def _shorts(frequent):
    """Per set its short lists as 32-bit numbers in the overall order (the frequent ones last, then by hash), and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(frequent.value).astype(bool)
        for batch in batches:
            for part in common.pieces(batch, "members", SLICE):
                shorts, sketches = [], []
                own = _members(part)
                for members in own:
                    short = short_lists(members, bits)
                    last = bits[short.view(np.int64) % BITS].astype(np.uint64) << np.uint64(31)
                    shorts.append(((short >> np.uint64(33)) | last).astype("<u4").tobytes())
                    sketches.append(sketch(members).tobytes())
                yield pa.record_batch([part.column("node"), pa.array([len(s) for s in own], pa.int64()), pa.array(shorts, pa.binary()), pa.array(sketches, pa.binary())],
                                      ["node", "size", "short", "sketch"])

    return run


def possible(n: int, a: np.ndarray, m: int, b: np.ndarray) -> bool:
    """Can sets of n and m members with these short lists link? Up to where both lists reach, members that the other lacks are
    missing from the overlap, and of a linking pair at most n - T (m - T) are. Equal numbers of different members only let more pass."""
    least = -(-LEAST * (n + m) // (100 + LEAST))
    reach = min(a[-1], b[-1])
    x, y = a[: np.searchsorted(a, reach)], b[: np.searchsorted(b, reach)]
    if not len(x) and not len(y):
        return True
    shared_x = np.count_nonzero(b[np.minimum(np.searchsorted(b, x), len(b) - 1)] == x)
    shared_y = np.count_nonzero(a[np.minimum(np.searchsorted(a, y), len(a) - 1)] == y)
    return len(x) - shared_x <= n - least and len(y) - shared_y <= m - least


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for n, a, m, b in zip(*(batch.column(c).to_pylist() for c in ("size_a", "short_a", "size_b", "short_b"))):
            keep.append(possible(n, np.frombuffer(a, "<u4"), m, np.frombuffer(b, "<u4")))
        yield batch.select(["a", "b", "lists"]).filter(pa.array(keep, pa.bool_()))


def likely(pairs: DataFrame, shorts: DataFrame) -> DataFrame:
    """The pairs (a, b, lists) whose short lists allow a link, before any long one is probed."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    marks = pairs.sparkSession.sparkContext.broadcast(np.packbits(_marked(need, "node")))
    shorts = shorts.select("node", "size", "short").mapInArrow(_wanted(marks), "node long, size long, short binary")
    of = lambda k: shorts.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("short").alias(f"short_{k}"))
    return pairs.select("a", "b", "lists").join(of("a"), "a").join(of("b"), "b").mapInArrow(_possible, "a long, b long, lists long")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group the centre's set comes first; each other set is probed in the centre's by binary search."""
    group, centre, last = None, np.zeros(0, np.uint64), None
    for batch in batches:
        for part in common.pieces(batch, "members", SLICE):
            found = []
            for a, salt, b, members in zip(part.column("a").to_pylist(), part.column("salt").to_pylist(), part.column("b").to_pylist(), _members(part)):
                if b is None:
                    group, centre, last = (a, salt), members.copy(), None
                elif group == (a, salt) and b != last:
                    last = b
                    small, large = (members, centre) if len(members) < len(centre) else (centre, members)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    if links(len(small), len(large), int((large[at] == small).sum())):
                        found.append((a, b))
            yield pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


class _Tables:
    """The stage tables of a run, deleted when they are read no more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        table, path = common.staged(df, name)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if (found := self.paths.pop(id(t), None)) is not None:
                common.discard(self.spark, found[1])

    def clear(self) -> None:
        self.drop(*[t for t, _ in list(self.paths.values())])


def verify(pairs: DataFrame, own: DataFrame, stage: _Tables) -> DataFrame:
    """The pairs (a, b) of nodes that link. Sets ``own(node, members)`` of nodes in pairs are sent to the pairs' centres."""
    spark = own.sparkSession
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("salts"))
    pairs = stage(pairs.select("a", "b").join(fan, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")), "pairs")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # a fixed number of bits marks the wanted sets, so that the others need not be shuffled
    marks = np.packbits(_marked(need, "node"))
    wanted = own.mapInArrow(_wanted(spark.sparkContext.broadcast(marks)), own.schema)
    wanted = stage(wanted.join(need, "node", "left_semi"), "pair-sets")
    centres = pairs.select("a", "salts").distinct().join(wanted, F.col("a") == F.col("node")).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "members")
    others = pairs.join(wanted, F.col("b") == F.col("node")).select("a", "salt", "b", "members")
    rows = centres.unionByName(others).repartition(common.partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    found = stage(rows.mapInArrow(_probe, "a long, b long").distinct(), "links")
    stage.drop(wanted, pairs)
    return found


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the least node reachable) for the nodes of ``edges(a, b)``.

    Each round hangs every node below the least label among its neighbours, then below that label's own label."""
    stage = _Tables(edges.sparkSession)
    both = stage(edges.select("a", "b").union(edges.select("b", "a")), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("least"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("was"), F.least("comp", "least").alias("comp"))
        up = labels.select(F.col("node").alias("top"), F.col("comp").alias("above"))
        after = step.join(up, F.col("comp") == F.col("top"), "left").select("node", "was", F.least("comp", F.coalesce("above", "comp")).alias("comp"))
        after = stage(after, "labels")
        stage.drop(labels)
        changed = not after.where(F.col("was") != F.col("comp")).isEmpty()
        labels = after
        if not changed:
            stage.drop(both)
            return labels.select("node", "comp")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    stage = _Tables(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))
    read = common.stage_table(docs.mapInArrow(_read, _READ), "sets")
    rows = read.where(~F.col("member")).select("doc_id", "node", F.col("n").alias("n_shingles"))
    own = read.where(F.col("members").isNotNull()).select("node", "members")
    marks = spark.sparkContext.broadcast(np.packbits(frequent_bits(read.where("member").select("node", "n"))))
    lists = (
        own.mapInArrow(_postings(marks), "member long, node long, n int")
        .repartition(common.partitions(spark), "member").sortWithinPartitions("member", "n", "node")
        .mapInArrow(_stars, "member long, centre long, node long, n int, bridge boolean")
    )
    lists = stage(lists, "short-lists")
    stars = lists.where(F.col("centre") != F.col("node")).groupBy(F.col("centre").alias("a"), F.col("node").alias("b")).agg(
        F.count(F.lit(1)).alias("lists"), F.bool_and("bridge").alias("bridge"))
    stars = stage(stars.where("NOT bridge"), "stars")
    shorts = stage(own.mapInArrow(_shorts(marks), "node long, size long, short binary, sketch binary").dropDuplicates(["node"]), "short-arrays")
    close = stage(likely(stars, shorts), "close-pairs")
    found = verify(close, own, stage)
    labels = components(found)
    tested = _ordered(stars)
    open_lists = stage(_open_lists(lists.where(~F.col("bridge")).select("member", "node", "n"), labels, shorts), "open-lists")
    stage.drop(lists, close)
    for k in range(ROUNDS):
        order = ["member", F.xxhash64("node", F.lit(k)), "node"]
        pairs = open_lists.repartition(common.partitions(spark), "member").sortWithinPartitions(*order).mapInArrow(_centres, "a long, b long")
        pairs = stage(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "round-pairs")
        tested = tested.unionByName(pairs)
        probed = stage(likely(pairs.withColumn("lists", F.lit(1).cast("long")), shorts), "close-pairs")
        more = verify(probed, own, stage)
        linked, n_probed = more.count(), probed.count()
        stage.drop(probed)
        if linked:
            found = found.unionByName(more)
            labels = components(found)
            after = stage(_still_open(_labelled(open_lists.drop("comp"), labels)), "open-lists")
            stage.drop(open_lists)
            open_lists = after
        if linked <= WORTH * n_probed:
            break
    # lists with the same first node hold much the same nodes: few tasks see a pair, and each gives it out once
    cross = _tiles(open_lists).repartition(common.partitions(spark), "first", "salt", "high", "wide").sortWithinPartitions("member", "high", "wide")
    cross = stage(cross.mapInArrow(_cross, "a long, b long").distinct().join(tested, ["a", "b"], "left_anti"), "cross-pairs")
    last = verify(likely(cross.withColumn("lists", F.lit(1).cast("long")), shorts), own, stage)
    if not last.isEmpty():
        labels = components(found.unionByName(last))
    named = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left")
    named = named.withColumn("comp", F.coalesce("comp", "node"))
    of_node = named.join(named.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("node", "component_id")
    of_node = common.stage_table(of_node, "node-components")
    stage.clear()
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(of_node, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select(F.col("node").alias("_node"), "comp")
    return lists.join(named, F.col("node") == F.col("_node"), "left").drop("_node").withColumn("comp", F.coalesce("comp", "node"))


def _still_open(lists: DataFrame) -> DataFrame:
    """The rows of the lists on which more than one component is left."""
    odd = lists.groupBy("member").agg((F.min("comp") != F.max("comp")).alias("odd")).where("odd").select("member")
    return lists.join(odd, "member", "left_semi")


def _open_lists(lists: DataFrame, labels: DataFrame, shorts: DataFrame) -> DataFrame:
    """The rows (member, node, n, comp, sketch) of the lists with more than one component, one list of those that hold the same nodes."""
    rows = _labelled(lists, labels)
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"same_{k}") for k in range(2)]
    odd = rows.groupBy("member").agg(F.count(F.lit(1)).alias("many"), (F.min("comp") != F.max("comp")).alias("odd"), *same).where("odd")
    odd = odd.groupBy("many", "same_0", "same_1").agg(F.min("member").alias("member")).select("member")
    sketches = shorts.select(F.col("node").alias("_node"), "sketch")
    return rows.join(odd, "member", "left_semi").join(sketches, F.col("node") == F.col("_node")).drop("_node")


def _tiles(open_lists: DataFrame) -> DataFrame:
    """The rows of the open lists dealt to tiles: a list of up to TILE nodes is one, a longer one a grid of blocks."""
    first = F.min_by("node", F.xxhash64("node", F.lit("first"))).alias("first")
    blocks = open_lists.groupBy("member").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"), first)
    rows = open_lists.join(blocks, "member").withColumn("salt", F.pmod(F.xxhash64("member", F.lit("salt")), F.lit(SALTS)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("first", "salt", "member", F.least("block", "other").alias("high"), F.greatest("block", "other").alias("wide"), "block", "node", "n", "comp", "sketch")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))
