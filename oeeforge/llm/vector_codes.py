"""Operator 11: vector codes by product quantisation, nearest entries found through a GNAT over each codebook.

A vector becomes whole numbers, floor(1024 * x), and is cut into equal parts; each part position has a codebook of up to 256
entries, improved over rounds of assignment and averaging (floors of exact means).

Search: the entries of a codebook are held in a GNAT (a tree of split points). Split points lie far apart; every other
entry hangs below its nearest one, and for each pair (split point, child) the tree holds the range of distances from the
split point to all entries of the child. A query at distance d from a split point, with b the best distance so far, can skip
a child as soon as [d - b, d + b] lies strictly outside that range: whole subtrees go, and never one that holds an entry at
distance b. Ranges and distances are rounded to the safe side, entries that remain are compared by exact 64-bit squared
distances and then by index, so ties go to the lower index whatever the order of the walk. Queries walk the tree in blocks.

On Spark: kept vectors are staged once as whole numbers; each round is a narrow pass over them that sends one row per task and
used entry (its count and sum) to an aggregation. Codebooks and their trees have a fixed size (parts x 256 entries), so
they go to the tasks with the function, and only they reach the driver. No row is shuffled but for the sums by label.

Defined cases: rows whose vector is null, has null or non-finite components, components of 2**16 or more in size, or another
number of components than ``dim`` are left out. Rows of a null vec_id are kept and start no codebook while there are others;
rows that repeat a vec_id or a vector are vectors of their own, equal vec_ids ordered by vector. With fewer than 256 rows a
codebook has as many entries; an empty table gives no rows. label_error is null where the sum leaves 64 bits. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge.llm import common, vectors

DIM, PARTS, ENTRIES, ROUNDS = 64, 4, 256, 4
#: Split points of an inner node; entries that a leaf holds at most.
FAN, LEAF = 8, 12
#: Queries that walk a tree together.
BLOCK = 4096


class Gnat:
    """The entries (rows of whole numbers) of one codebook, searched for the nearest by exact distance, then lower index."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.int64)
        self.compared = self.asked = 0
        self.root = self._node(np.arange(len(entries)))

    def _node(self, own: np.ndarray) -> tuple:
        """(entries to compare, children); a child is (node, lows, highs): the range of distances from each compared entry."""
        if len(own) <= LEAF:
            return own, []
        apart = vectors.squares(self.entries[own], self.entries[own])
        chosen = [0]
        nearest = apart[0].copy()
        while len(chosen) < FAN:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, apart[chosen[-1]])
        chosen = sorted(set(chosen))  # fewer where entries are equal
        rest = np.setdiff1d(np.arange(len(own)), chosen)
        side = apart[np.ix_(rest, chosen)].argmin(1)
        children = []
        for j in range(len(chosen)):
            members = rest[side == j]
            if len(members):
                reach = apart[np.ix_(chosen, members)]
                children.append((self._node(own[members]), vectors.below(reach.min(1)), vectors.above(reach.max(1))))
        return own[chosen], children

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest entry."""
        index, squared = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for at in range(0, len(queries), BLOCK):
            index[at : at + BLOCK], squared[at : at + BLOCK] = self._block(queries[at : at + BLOCK])
        return index, squared

    def _block(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = np.full(len(queries), len(self.entries), np.int64)
        best = np.full(len(queries), np.iinfo(np.int64).max)
        self.asked += len(queries)
        walk = [(self.root, np.arange(len(queries)), np.zeros(len(queries)))]
        while walk:
            (own, children), rows, floor = walk.pop()
            open_ = floor <= vectors.above(best[rows])  # the best may have come nearer since the child was put aside
            rows = rows[open_]
            if not len(rows):
                continue
            squared = vectors.squares(queries[rows], self.entries[own])
            self.compared += squared.size
            place = squared.argmin(1)  # own is ascending: the first of equal ones has the lowest index
            found, which = squared[np.arange(len(rows)), place], own[place]
            better = (found < best[rows]) | ((found == best[rows]) & (which < index[rows]))
            best[rows[better]], index[rows[better]] = found[better], which[better]
            if not children:
                continue
            reach, near, far = vectors.above(best[rows]), vectors.below(squared), vectors.above(squared)
            for child, low, high in children:
                # no entry of the child can be nearer than this
                least = np.maximum(near - high[None, :], low[None, :] - far).max(1)
                go = least <= reach
                if go.any():
                    walk.append((child, rows[go], least[go]))
        return index, best


def _trees(books: list[np.ndarray]) -> list[Gnat]:
    return [Gnat(b) for b in books]


def _sums(books: list[np.ndarray]):
    """Per task and used entry: part, entry, count and sum of the parts assigned to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(books)
        width = books[0].shape[1]
        total = np.zeros((len(books), max(map(len, books)), width), np.int64)
        count = np.zeros(total.shape[:2], np.int64)
        for batch in batches:
            x = vectors.matrix(batch).astype(np.int64)
            if not len(x):
                continue
            for p, tree in enumerate(trees):
                own = x[:, p * width : (p + 1) * width]
                index, _ = tree.nearest(own)
                np.add.at(total[p], index, own)
                count[p] += np.bincount(index, minlength=count.shape[1])
        part, entry = np.nonzero(count)
        yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]),
                               pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _codes(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(books)
        width = books[0].shape[1]
        for batch in batches:
            x = vectors.matrix(batch).astype(np.int64)
            code = np.zeros((len(x), len(books)), np.uint8)
            error = np.zeros(len(x), np.int64)
            for p, tree in enumerate(trees if len(x) else []):
                index, squared = tree.nearest(x[:, p * width : (p + 1) * width])
                code[:, p] = index
                error += squared
            text = code.tobytes().hex()
            step = 2 * len(books)
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()),
                                   pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def first_books(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Each part of the ``entries`` rows with the smallest vec_ids: a fixed number of rows reaches the driver."""
    rows = kept.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not rows:
        return []
    return np.split(np.array([r["vector"] for r in rows], np.int64), parts, axis=1)


def improve(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every part to its nearest entry, every used entry to the floor of its parts' mean."""
    width = books[0].shape[1]
    partial = kept.select("vector").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect()
    after = [b.copy() for b in books]
    for r in found:
        after[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return after


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    books = first_books(kept, parts, entries)
    for _ in range(rounds if books else 0):
        books = improve(kept, books)
    return books


def encode(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of every kept row."""
    label = kept.schema["label"].dataType.simpleString()
    return kept.select("vec_id", "label", "vector").mapInArrow(_codes(books), f"vec_id long, label {label}, code string, error long")


def decode(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The coded rows with ``vector``: the entries that their codes name, as whole numbers."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in row]) for row in b]) for b in books])
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return coded.withColumn("vector", F.concat(*[table[p][at(p)] for p in range(len(books))]))


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for row in b for x in row).encode()).hexdigest()


def compress(table: DataFrame, dim: int = DIM, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes, errors and the digest of the codebooks for every kept row of ``table(vec_id, embedding, label)``."""
    if dim % parts or not 0 < entries <= 256:
        raise ValueError("parts must divide dim, and an entry's index must fit two hex digits")
    spark = table.sparkSession
    kept, kept_at = common.staged(vectors.whole_numbers(table, dim, F.col("vec_id").cast("long").alias("vec_id"), "label"), "whole-vectors")
    books = fit(kept, parts, entries, rounds)
    if not books:
        label = kept.schema["label"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id long, label {label}, code string, error long, label_error long, codebooks_sha256 string").drop("label")
    coded = common.stage_table(encode(kept, books), "vector-codes")
    common.discard(spark, kept_at)
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(common.table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    width = DIM // PARTS
    out = [
        f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({vectors.SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[{width} * p + 1 : {width} * p + {width}] AS x FROM kept, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS BIGINT) AS entry, x FROM parts QUALIFY entry < {ENTRIES})"""
    ]
    for r in range(ROUNDS + 1):
        out.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, label, a.p, a.x, min(CAST(list_inner_product(a.x, a.x) + list_inner_product(b.x, b.x) - 2 * list_inner_product(a.x, b.x) AS BIGINT) * {ENTRIES} + entry) AS k
  FROM parts a JOIN book{r} b ON a.p = b.p GROUP BY ALL)""")
        if r < ROUNDS:
            out.append(f"""means{r} AS (
  SELECT p, k % {ENTRIES} AS entry, i, CAST(floor(sum(x[i]) / count(*)) AS DOUBLE) AS m FROM near{r}, range(1, {width + 1}) t(i) GROUP BY ALL),
book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.entry, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (SELECT p, entry, list(m ORDER BY i) AS x FROM means{r} GROUP BY ALL) m ON b.p = m.p AND b.entry = m.entry)""")
    out.append(f"""digest AS (
  SELECT sha256(string_agg(CAST(CAST(x[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, entry, i)) AS codebooks_sha256 FROM book{ROUNDS}, range(1, {width + 1}) t(i)),
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', CAST(k % {ENTRIES} AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(k // {ENTRIES}) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest""")
    return ",\n".join(out[:-1]) + ",\n" + out[-1]


ORACLE_SQL = _oracle()
