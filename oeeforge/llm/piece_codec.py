"""Operator 7: SentencePiece encoding and decoding with a forward pass shared by common prefixes.

A text is marked as the model wants it (a mark in front, a mark for each space) and cut into marked words; no
piece of the vocabulary crosses such a cut. The distinct words of a slice of rows are sorted, so that words with
a common prefix follow one another, and walked as a trie, depth first: the forward states of the shared prefix
stay on a stack and only the rest of a word is scored.

The forward state of a prefix is the last piece of its encoding, with its start. The vocabulary is a BPE one: its
encoding is what the merges leave, not the path with the largest sum of scores, so a plain Viterbi maximum would
give other ids than the library. What the recursion maximises here is therefore validity: a piece may
follow the best path of the prefix before it if the merges, run on the two neighbouring pieces alone, leave
exactly the two. One path of every prefix fulfils that, and it is the library's encoding (tests compare them).
Characters that the vocabulary lacks become byte pieces.

Defined cases: null and empty texts have no ids; decoding gives an empty text. A text's own mark characters
(U+2581) decode to spaces, as in the library. Rows are kept one to one, with nulls, ties and repeats; columns
other than doc_id and text are not read. Work is per row: no shuffle, no state beyond a bounded word memory.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge.llm import common
from oeeforge.llm.memory import Memory

#: The model format's word mark.
MARK = "▁"
#: Words in a generation of a worker's memory, and pairs of pieces whose validity it knows (the ids do not depend on them).
WORDS = 250_000
PAIRS = 1_000_000

_RUNS = re.compile(r"[ \n]{2}")


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.score: list[float] = [model.get_score(i) for i in range(n)]
        self.text: list[str] = [""] * n
        self.raw: list[bytes] = [b""] * n  # what an id decodes to
        self.byte_id = [0] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.raw[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[piece] = i
                self.text[i] = piece
                self.raw[i] = piece.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces of this model cross word marks")
        self.dtype = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.lines_apart = not any("\n" in p for p in self.ids)
        apart = "\n" if self.lines_apart else ""
        self.words = re.compile(f"{MARK}*[^{MARK}{apart}]+|{MARK}+" + (f"|{apart}" if apart else ""))
        self.follows: dict[tuple[int, int], bool] = {}
        self.marked, self.unmarked = Memory(self._learn, WORDS), Memory(self._learn_unmarked, WORDS)
        # every beginning of a piece; with its id where it is a whole piece that the merges reach
        self.begins: dict[str, int] = {p[:k]: -1 for p in self.ids for k in range(1, len(p))}
        self.begins.update((p, i if self.merged(p) == [p] else -1) for p, i in self.ids.items())

    def merged(self, text: str) -> list[str]:
        """The merges as defined: the best-scored neighbouring pair that forms a piece, leftmost first, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.score[found] > best):
                    best, at = self.score[found], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, left: int, right: int) -> bool:
        a, b = self.text[left], self.text[right]
        return self.merged(a + b) == [a, b]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, by one depth-first walk over their common prefixes."""
        out: dict[str, bytes] = {}
        # state i: (last piece of the prefix of i characters or -1 for a character out of the vocabulary, its start);
        # open i: the starts from which the prefix of i characters is the beginning of a piece
        states: list[tuple[int, int]] = [(-1, 0)]
        open_at: list[list[int]] = [[]]
        last = ""
        begins, follows = self.begins, self.follows
        for word in sorted(words):
            shared = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :], open_at[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                state, alive = None, []
                for start in (*open_at[-1], end - 1):
                    piece = begins.get(word[start:end])
                    if piece is None:
                        continue
                    alive.append(start)
                    if state is None and piece >= 0:
                        before = states[start][0]
                        if before >= 0:
                            pair = (before, piece)
                            if (valid := follows.get(pair)) is None:
                                valid = follows[pair] = self._follows(before, piece)
                            if not valid:
                                continue
                        state = (piece, start)
                states.append(state or (-1, end - 1))
                open_at.append(alive)
            last, end, found = word, len(word), []
            while end:
                piece, start = states[end]
                if piece < 0:
                    found += [self.byte_id[x] for x in reversed(word[start:end].encode())]
                else:
                    found.append(piece)
                end = start
            out[word] = np.array(found[::-1], self.dtype).tobytes()
        return out

    def _learn(self, marked: list[str]) -> list[bytes]:
        if len(self.follows) > PAIRS:
            self.follows.clear()
        ids = self.encode_words(list(set(marked)))
        return [ids[w] for w in marked]

    def _learn_unmarked(self, words: list[str]) -> list[bytes]:
        return self._learn([w if w[:1] == "\n" else MARK + w for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        out = [b""] * len(texts)
        # where the cuts are the single spaces and line feeds, the marks need not be written
        simple = [i for i, t in enumerate(texts) if t and self.lines_apart and t[0] != " " and MARK not in t and not _RUNS.search(t)]
        for i, ids in zip(simple, self.unmarked.joined([texts[i].replace("\n", " \n").split(" ") for i in simple])):
            out[i] = ids
        other = sorted(set(range(len(texts))).difference(simple))
        marked = [self.words.findall(MARK + texts[i].replace(" ", MARK)) if texts[i] else [] for i in other]
        for i, ids in zip(other, self.marked.joined(marked)):
            out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if text[:1] == " " else text


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def _encode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path or model_file())
        for batch in batches:
            for part in common.pieces(batch, "text", 1 << 20):
                texts = part.column("text").to_pylist()
                ids = [np.frombuffer(x, own.dtype) for x in own.encode(texts)]
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()),
                     pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                    ["doc_id", "text_crc32", "n_pieces", "ids"])

    return run


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, crc32 of the UTF-8 text, number of pieces, and the ids (32-bit, little-endian) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))
    return docs.mapInArrow(_encode(model), "doc_id long, text_crc32 long, n_pieces long, ids binary")


def _decode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path or model_file())
        for batch in batches:
            texts = [own.decode(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return run


_DECODED = "doc_id long, text_crc32 long, n_pieces long, ids binary, text string"


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """The rows of ``encode`` with their text again."""
    return encoded.mapInArrow(_decode(model), _DECODED)


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``decode(encode(docs))`` in one pass, by one worker per task."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))
    encoder, decoder = _encode(model), _decode(model)
    return docs.mapInArrow(lambda batches: decoder(encoder(batches)), _DECODED)


def digest(decoded: DataFrame) -> DataFrame:
    """Per row: number of pieces, crc32 of the ids, length of the decoded text, and whether it is the text that was encoded."""
    return decoded.select(
        "doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.length("text").cast("long").alias("n_chars"),
        (F.crc32(F.encode("text", "UTF-8")) == F.col("text_crc32")).alias("same_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(round_trip(common.table(spark, sf_dir, "documents")))
