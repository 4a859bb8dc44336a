"""Operator 8: token counts that follow edits.

Each document keeps a segment tree over its pre-token chunks: leaves hold runs of chunks (their lengths and numbers
of ids), inner nodes the sums of their subtrees. An edit finds its place by descending the character sums, takes the
chunks it touches plus the one before and the one after (the boundary context: a chunk's end may join what is put
beside it), encodes that region alone, and adds the differences along the paths from the touched leaves to the root.
The count after every edit is the root's sum; the rest of the text is never encoded again.

Texts whose white space or special strings do not let them be cut are counted whole at each edit.

Defined cases: a null text is empty; null or empty lists of edits leave the count as it is; positions and lengths beyond
the text end at its end, negative ones and nulls count as 0; a null insertion inserts nothing. Rows stay one to one, with
nulls, ties and repeats; columns other than doc_id, text and edits are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge.llm import common, pretokens

#: Chunks in a leaf when the tree is built; a leaf that has grown to eight times as many has the tree built anew.
LEAF = 64
EDITS = "array<struct<at: long, removed: long, inserted: string>>"


class TokenTree:
    """The segment tree of one document's chunks: pairs of (characters, ids)."""

    def __init__(self, chunks: np.ndarray):
        """chunks: two columns, the chunks' lengths and numbers of ids."""
        self.build(chunks)

    def build(self, chunks: np.ndarray) -> None:
        self.leaves = [chunks[i : i + LEAF] for i in range(0, len(chunks), LEAF)] or [np.zeros((0, 2), np.int64)]
        level = np.add.reduceat(chunks, np.arange(0, len(chunks), LEAF), axis=0) if len(chunks) else np.zeros((1, 2), np.int64)
        self.levels = [level]
        while len(level) > 1:
            level = np.add.reduceat(level, np.arange(0, len(level), 2), axis=0)
            self.levels.append(level)

    @property
    def characters(self) -> int:
        return int(self.levels[-1][0, 0])

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][0, 1])

    def find(self, at: int) -> tuple[int, int, int]:
        """The leaf and chunk that hold the character ``at``, and where that chunk starts."""
        node, start = 0, 0
        for level in reversed(self.levels[:-1]):
            node *= 2
            if node + 1 < len(level) and at >= start + level[node, 0]:
                start += int(level[node, 0])
                node += 1
        ends = start + np.cumsum(self.leaves[node][:, 0])
        chunk = int(np.searchsorted(ends, at, side="right"))
        return node, chunk, start if chunk == 0 else int(ends[chunk - 1])

    def replace(self, first: tuple[int, int], last: tuple[int, int], chunks: np.ndarray) -> None:
        """Puts ``chunks`` in the place of those from ``first`` to ``last`` (both inclusive) and mends the sums above."""
        head, tail = self.leaves[first[0]][: first[1]], self.leaves[last[0]][last[1] + 1 :]
        for leaf in range(first[0], last[0] + 1):
            self._set(leaf, np.concatenate((head, chunks, tail)) if leaf == first[0] else chunks[:0])
        if len(self.leaves[first[0]]) > 8 * LEAF:
            self.build(np.concatenate(self.leaves))

    def _set(self, leaf: int, chunks: np.ndarray) -> None:
        self.leaves[leaf] = chunks
        change = chunks.sum(axis=0) - self.levels[0][leaf]
        for level in self.levels:
            level[leaf] += change
            leaf //= 2


class CountedText:
    """A text with its token count, kept up to date under edits. ``encoded`` counts the characters encoded for edits."""

    def __init__(self, text: str, coder: pretokens.Encoder, chunks: tuple[np.ndarray, np.ndarray] | None):
        self.text, self.coder, self.encoded = text, coder, 0
        self.tree = TokenTree(np.stack(chunks, axis=1)) if chunks is not None else None
        self.tokens = self.tree.tokens if self.tree else self._whole(text)

    def _whole(self, text: str) -> int:
        return len(self.coder.encode([text])[0]) // self.coder.dtype.itemsize

    def edit(self, at: int, removed: int, inserted: str) -> int:
        """Takes ``removed`` characters away at ``at`` and puts ``inserted`` there; returns the new count."""
        size = len(self.text)
        at = min(max(at, 0), size)
        end = min(at + max(removed, 0), size)
        if at == end and not inserted:
            return self.tokens
        after = self.text[:at] + inserted + self.text[end:]
        if self.tree is not None and size:
            leaf, chunk, begin = self.tree.find(max(at - 1, 0))
            last_leaf, last_chunk, last_begin = self.tree.find(min(end, size - 1))
            close = last_begin + int(self.tree.leaves[last_leaf][last_chunk, 0])
            region = self.text[begin:at] + inserted + self.text[end:close]
            # a special string may begin before the region and end after it
            if self.coder.way(after[max(0, begin - 64) : begin + len(region) + 64]) != "whole":
                self.encoded += len(region)
                parts = self.coder.chunks([region])[0]
                self.tree.replace((leaf, chunk), (last_leaf, last_chunk), np.stack(parts, axis=1))
                self.text, self.tokens = after, self.tree.tokens
                return self.tokens
        self.encoded += len(after)
        parts = self.coder.chunks([after])[0]
        self.tree = TokenTree(np.stack(parts, axis=1)) if parts is not None else None
        self.text, self.tokens = after, self.tree.tokens if self.tree else self._whole(after)
        return self.tokens


def _follow(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pretokens.encoder(path or pretokens.vocabulary())
        for batch in batches:
            for part in common.pieces(batch, "text", 1 << 20):
                texts = part.column("text").to_pylist()
                rows = []
                for text, chunks, edits in zip(texts, coder.chunks(texts), part.column("edits").to_pylist()):
                    own = CountedText(text, coder, chunks)
                    before = own.tokens
                    after = [own.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "") for e in edits or [] if e is not None]
                    rows.append((before, after, own.tokens, len(own.text), own.encoded))
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([part.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))],
                                      ["doc_id", "n_tokens", "after_each", "n_tokens_edited", "n_chars_edited", "n_chars_encoded"])

    return run


def count(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``docs(doc_id, text, edits)`` -> the token count before, after each edit and in the end; a narrow pass.

    ``edits`` is an array of (at, removed, inserted), applied in order, each to the text the one before left.
    ``n_chars_encoded`` is what the edits made it encode, against ``n_chars_edited``, the length of the final text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"), F.col("edits").cast(EDITS).alias("edits"))
    return docs.mapInArrow(_follow(tokenizer), "doc_id long, n_tokens long, after_each array<long>, n_tokens_edited long, n_chars_edited long, n_chars_encoded long")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Joins ``edits(doc_id, seq, at, removed, inserted)`` to the documents as the array that ``count`` takes, by seq."""
    lists = edits.groupBy(F.col("doc_id").alias("_doc_id")).agg(F.sort_array(F.collect_list(F.struct("seq", "at", "removed", "inserted"))).alias("_edits"))
    joined = docs.select("doc_id", "text").join(lists, F.col("doc_id") == F.col("_doc_id"), "left")
    return joined.select("doc_id", "text", F.transform("_edits", lambda e: F.struct(e["at"].alias("at"), e["removed"].alias("removed"), e["inserted"].alias("inserted"))).alias("edits"))


def sample_edits(text: Column) -> Column:
    """Four edits of every text, placed by its length: an insertion, a deletion over a tenth, a replaced word, an appended line."""
    size = F.length(text).cast("long")
    whole = lambda x: F.floor(x).cast("long")

    def edit(at: Column, removed: Column, inserted: Column) -> Column:
        return F.struct(at.alias("at"), removed.alias("removed"), inserted.alias("inserted"))

    zero = F.lit(0).cast("long")
    return F.array(
        edit(whole(size / 3), zero, F.substring(text, 1, 40)),
        edit(whole(size / 2), whole(size / 10), F.lit("")),
        edit(whole(size * 3 / 4), F.lit(7).cast("long"), F.lit("edited, ")),
        edit(size * 2, zero, F.lit("\nOne more line.")),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", common.whole_text().alias("text"))
    return count(docs.withColumn("edits", sample_edits(F.col("text"))))
