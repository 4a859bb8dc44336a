"""Operator 3: document fingerprints by a homomorphic multiset hash of paragraphs.

A text is the multiset of its paragraphs (the parts between line feeds). Each paragraph is hashed to a wide
vector of whole numbers, and the fingerprint is the sum of the vectors modulo powers of two. Sums do not depend on
the order, so texts with the same paragraphs in any order are equal, and a paragraph is inserted or deleted by adding
or subtracting its vector: an edited text's fingerprint comes from the parts that changed, not from the whole.

A paragraph's vector has two parts:

- DENSE lanes modulo 2**32, cut from an extendable hash of the paragraph: these decide equality;
- SIGNED lanes modulo 2**32: each run of up to three words adds +1 or -1 to one lane. These sums stay close for texts
  that share most of their words, so the cosine of two fingerprints estimates their likeness (error about 0.06).

``likeness`` is 1 for equal fingerprints, else the cosine, at least 0.

Defined cases: null and empty texts are the empty multiset, with a vector of zeros; likeness to it is 0 unless both
are empty. Ascending doc_id puts nulls first; equal ids are ordered by their text. A single row is its own next.
Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge.llm import common

DENSE = 32
SIGNED = 256
#: UTF-8 bytes hashed at a time.
SLICE = 1 << 20

_PRIME = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(1, 1025)], np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_PRIME)
    return x ^ (x >> np.uint64(32))


def _signed_lanes(data: bytes, owner_starts: np.ndarray, owners: int) -> np.ndarray:
    """Signed lane sums per owner of a buffer whose owners start at the given bytes; paragraphs end at line feeds.

    A word's hash sums its bytes, each times a power for its place in the word, so words are hashed all at once.
    """
    lanes = np.zeros((owners, SIGNED), np.int64)
    raw = np.frombuffer(data, np.uint8)
    letter = (raw != 32) & ((raw < 9) | (raw > 13))
    starts = np.flatnonzero(letter & ~np.concatenate(([False], letter[:-1]))) if len(raw) else np.zeros(0, np.int64)
    if not len(starts):
        return lanes
    word_of = np.cumsum(np.bincount(starts, minlength=len(raw))) - 1
    place = np.arange(len(raw)) - starts[word_of]
    terms = np.where(letter, (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 1023], np.uint64(0))
    words = _scramble(np.add.reduceat(terms, starts))
    paragraph = np.cumsum(raw == 10)[starts]
    runs = words.copy()
    for k in (1, 2):
        if len(words) > k:
            same = paragraph[k:] == paragraph[:-k]
            runs[:-k] += np.where(same, _scramble(words[k:] + np.uint64(k * _PRIME & (2**64 - 1))), np.uint64(0))
    runs = _scramble(runs)
    owner = np.searchsorted(owner_starts, starts, side="right") - 1
    cell = owner * SIGNED + (runs % np.uint64(SIGNED)).astype(np.int64)
    sign = np.where((runs >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    return np.bincount(cell, weights=sign, minlength=owners * SIGNED).astype(np.int64).reshape(owners, SIGNED)


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The dense and signed lane sums of each text."""
    dense, signed = np.zeros((len(texts), DENSE), np.uint32), np.zeros((len(texts), SIGNED), np.uint32)
    i = 0
    while i < len(texts):
        data, total, j = [], 0, i
        while j < len(texts) and (j == i or total + len(texts[j]) <= SLICE):
            data.append(texts[j].encode())
            total += len(texts[j])
            j += 1
        starts = np.cumsum([0] + [len(x) + 1 for x in data[:-1]])
        signed[i:j] = (_signed_lanes(b"\n".join(data), starts, j - i) & 0xFFFFFFFF).astype(np.uint32)
        digests, owner = [], []
        for k, text in enumerate(data):
            if text:
                parts = text.split(b"\n")
                owner.append((i + k, len(parts)))
                digests += [hashlib.shake_128(p).digest(4 * DENSE) for p in parts]
        if digests:
            rows = np.frombuffer(b"".join(digests), "<u4").reshape(-1, DENSE)
            at = np.cumsum([0] + [n for _, n in owner[:-1]])
            dense[[o for o, _ in owner]] = np.add.reduceat(rows, at, axis=0, dtype=np.uint32)
        i = j
    return dense, signed


def pack(dense: np.ndarray, signed: np.ndarray) -> list[str]:
    both = [np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<")).tobytes() for x in (dense, signed)]
    return [base64.b64encode(both[0][k * DENSE * 4 : (k + 1) * DENSE * 4] + both[1][k * SIGNED * 4 : (k + 1) * SIGNED * 4]).decode() for k in range(len(dense))]


def unpack(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [base64.b64decode(x) for x in fingerprints]
    dense = np.frombuffer(b"".join(x[: DENSE * 4] for x in raw), "<u4").reshape(-1, DENSE)
    return dense, np.frombuffer(b"".join(x[DENSE * 4 :] for x in raw), "<u4").reshape(-1, SIGNED)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    x, y = (p[1].astype(np.uint32).view(np.int32).astype(np.float64) for p in (a, b))
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.divide((x * y).sum(axis=1), size, out=np.zeros(len(x)), where=size > 0)
    return np.where((a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1), 1.0, np.clip(cosine, 0.0, 1.0))


def insert(vector: tuple[np.ndarray, np.ndarray], texts: list[str], sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Each vector with the paragraphs of a text added (or, with -1, taken away)."""
    dense, signed = vectors(texts)
    return (vector[0] + dense, vector[1] + signed) if sign > 0 else (vector[0] - dense, vector[1] - signed)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.pieces(batch, "text", SLICE):
            yield pa.record_batch([part.column("doc_id"), pa.array(pack(*vectors(part.column("text").to_pylist())))], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row: a narrow pass."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))
    return docs.mapInArrow(_fingerprint, "doc_id long, fingerprint string")


def _deal(cuts: list[int], heads: dict[int, list[int]]):
    """Adds each row's range; the first row of a range goes to the range before as well, as that one's successor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(cuts, np.int64)
        marks = {int(k): v for k, v in heads.items()}
        for batch in batches:
            row = np.asarray(batch.column("rank"))
            dealt = np.searchsorted(edges, row, side="left").astype(np.int32)
            extra = [(i, b) for i, r in enumerate(row.tolist()) if r in marks for b in marks[r]]
            own = pa.array(np.zeros(len(row), bool))
            yield pa.record_batch([pa.array(dealt), own, *batch.columns], ["range", "ahead", *batch.schema.names])
            if extra:
                more = batch.take(pa.array([i for i, _ in extra]))
                yield pa.record_batch([pa.array([b for _, b in extra], pa.int32()), pa.array([True] * len(extra)), *more.columns], ["range", "ahead", *batch.schema.names])

    return run


def with_next(docs: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text)`` dealt into ascending ranges of doc_id and sorted in them.

    Each range also holds, marked ``ahead``, the row that follows its last one (the first row of the next range that
    has rows; after the last: the very first). So a task sees every row's successor without a global sort or window.
    Only the ranges' cut points and first ids, a few per range, reach the driver.
    """
    spark = docs.sparkSession
    parts = common.partitions(spark)
    # the lowest value stands for null, which comes first
    ranked = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("rank"), F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))
    cuts = common.id_cuts(ranked, "rank", parts)
    first = (
        ranked.select("rank", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<long>"), lambda c: c < F.col("rank"))).alias("range"))
        .groupBy("range").agg(F.min("rank").alias("rank")).orderBy("range").collect()
    )
    heads: dict[int, list[int]] = {}
    for k, r in enumerate(first):
        heads.setdefault(r["rank"], []).append(first[k - 1]["range"])
    schema = "range int, ahead boolean, rank long, doc_id long, text string"
    dealt = ranked.mapInArrow(_deal(cuts, heads), schema)
    return dealt.repartitionById(parts, F.col("range")).sortWithinPartitions("range", "ahead", "rank", "text")


def _edited(rows: list[tuple], following: str) -> pa.RecordBatch:
    """Result rows for consecutive documents; ``following`` is the text after the last of them."""
    texts = [r[1] for r in rows]
    after = [*texts[1:], following]
    heads = [t[: len(t) - len(t) // 4] for t in texts]
    tails = [n[: len(t) // 4] for t, n in zip(texts, after)]
    own = vectors([*texts, following])
    base, ahead = (own[0][:-1], own[1][:-1]), (own[0][1:], own[1][1:])
    # only the paragraphs from the last line feed before the edit change
    seams = [h.rfind("\n") + 1 for h in heads]
    edited = [h + t for h, t in zip(heads, tails)]
    gone = [t[s:] if e != t else "" for t, e, s in zip(texts, edited, seams)]
    come = [e[s:] if e != t else "" for t, e, s in zip(texts, edited, seams)]
    changed = insert(insert(base, gone, -1), come)
    # a text that starts after a line feed keeps the empty paragraph that taking an empty rest leaves behind
    for k, (t, e, s) in enumerate(zip(texts, edited, seams)):
        if e != t and s and (not gone[k] or not come[k]):
            d, g = vectors([e])
            changed[0][k], changed[1][k] = d[0], g[0]
    columns = [
        pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(pack(*base)), pa.array(pack(*changed)),
        pa.array(likeness(base, changed)), pa.array(likeness(base, ahead)),
    ]
    return pa.record_batch(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, held, size = None, [], 0
    for batch in batches:
        for part in common.pieces(batch, "text", SLICE):
            for place, ahead, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("range", "ahead", "doc_id", "text"))):
                if place != at:
                    at, held, size = place, [], 0
                if ahead:
                    if held:
                        yield _edited(held, text)
                        held, size = [], 0
                    continue
                if size > SLICE:
                    yield _edited(held, text)
                    held, size = [], 0
                held.append((doc_id, text))
                size += len(text)


def edited(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of the text whose last quarter the next document's beginning replaces, and likenesses."""
    return with_next(docs).mapInArrow(_edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(common.table(spark, sf_dir, "documents"))
