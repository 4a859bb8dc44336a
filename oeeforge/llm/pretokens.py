"""Byte-level BPE over whole texts through the tokenizers library, with a bounded memory of distinct words.

The pre-tokenizer of a byte-level BPE never joins a character that is no white space with white space after it.
A text may therefore be cut before every run of white space and the chunks encoded alone: their ids, one after
the other, are those of the whole text. Distinct chunks are few against all chunks, so each is encoded once
per worker and looked up afterwards.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np

from oeeforge.llm.memory import Memory

_CHUNKS = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
#: White space, but for space, tab and line ends, that this module and the library could see differently.
_OTHER_SPACE = tuple("\x0b\x0c\x1c\x1d\x1e\x1f"), tuple(map(chr, (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _contains(text: str, strings: tuple[str, ...]) -> bool:
    return any(s in text for s in strings)


#: Byte-level BPE writes each byte as one visible character: itself where it is visible, else the next from U+0100.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(0x100 + k) for k, b in enumerate(sorted(set(range(256)).difference(_VISIBLE)))}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as little-endian unsigned integers in bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):  # words are remembered here
            self.model._resize_cache(0)
        self.end = {c: self.whole([c])[0] for c in ".,\n"}
        self.spaced = Memory(self._after_space, limit=450_000)  # a word after one space, or with the line feed before it
        self.plain = Memory(self.whole)  # a chunk as it stands

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.dtype.char, ids).tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _after_space(self, words: list[str]) -> list[bytes]:
        """Words of letters alone are one pre-token each: the library's BPE model takes them as they are."""
        out: list[bytes | None] = []
        known: dict[str, bytes] = {}
        tokenize, kind, space, line = self.model.tokenize, self.dtype.char, _BYTE_CHARS[32], self.end["\n"]

        def letters(word: str) -> bytes:
            mapped = word if word[0] == space or word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
            return array(kind, [t.id for t in tokenize(mapped)]).tobytes()

        for word in words:
            if word.isalpha():
                ids = known[word] = letters(space + word) if word.isascii() else letters(" " + word)
                out.append(ids)
                continue
            body, end = (word[:-1], self.end[word[-1]]) if word[-1:] in (".", ",") else (word, b"")
            if body.isalpha():
                ids = known.get(body) or self.spaced.get(body) or self.spaced.older.get(body)
                if ids is None:
                    ids = known[body] = letters(space + body) if body.isascii() else letters(" " + body)
                out.append(ids + end)
            elif body[:1] == "\n" and body[1:].isalpha():
                out.append(line + letters(body[1:]) + end)
            else:
                out.append(None)
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.whole([words[i] if words[i][:1] == "\n" else " " + words[i] for i in rest])):
            out[i] = ids
        return out

    def way(self, text: str) -> str:
        """How a text may be cut: not at all (whole), before runs of white space (plain), or at its single spaces and lines (spaced)."""
        if _contains(text, _OTHER_SPACE[0]) or (not text.isascii() and _contains(text, _OTHER_SPACE[1])) or _contains(text, self.special):
            return "whole"
        return "plain" if _contains(text, ("  ", "\n\n", " \n", "\n ", "\t", "\r")) else "spaced"

    def _dealt(self, texts: list[str]) -> dict[str, list[int]]:
        ways: dict[str, list[int]] = {"whole": [], "plain": [], "spaced": []}
        for i, text in enumerate(texts):
            if text:
                ways[self.way(text)].append(i)
        return ways

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the library gives them for the whole text."""
        out: list[bytes] = [b""] * len(texts)
        ways = self._dealt(texts)
        for i, ids in zip(ways["whole"], self.whole([texts[i] for i in ways["whole"]])):
            out[i] = ids
        for i, ids in zip(ways["plain"], self.plain.joined([_CHUNKS.findall(texts[i]) for i in ways["plain"]])):
            out[i] = ids
        words = [texts[i].replace("\n", " \n").split(" ") for i in ways["spaced"]]
        first = self.plain.joined([x[:1] if x[0] else [] for x in words])
        for i, begin, rest in zip(ways["spaced"], first, self.spaced.joined([x[1:] for x in words])):
            out[i] = begin + rest
        return out

    def chunks(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Lengths and numbers of ids of the chunks of each text; None where a text cannot be cut."""
        none = np.zeros(0, np.int64)
        out: list[tuple[np.ndarray, np.ndarray] | None] = [(none, none)] * len(texts)
        ways, width = self._dealt(texts), self.dtype.itemsize

        def lengths(parts: list) -> np.ndarray:
            return np.fromiter(map(len, parts), np.int64, len(parts))

        for i in ways["whole"]:
            out[i] = None
        cut = [_CHUNKS.findall(texts[i]) for i in ways["plain"]]
        for i, parts, ids in zip(ways["plain"], cut, self.plain.each(cut)):
            out[i] = lengths(parts), lengths(ids) // width
        words = [texts[i].replace("\n", " \n").split(" ") for i in ways["spaced"]]
        first = self.plain.joined([x[:1] if x[0] else [] for x in words])
        for i, parts, begin, ids in zip(ways["spaced"], words, first, self.spaced.each([x[1:] for x in words])):
            size = lengths(parts) + np.fromiter((w[:1] != "\n" for w in parts), bool, len(parts))
            size[0] -= 1
            count = np.concatenate(([len(begin)], lengths(ids))) // width
            out[i] = (size, count) if parts[0] else (size[1:], count[1:])
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
