"""What a worker remembers of distinct words: a bounded memory in two generations, for lookups a list at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Memory(dict):
    """Word -> bytes. The recent generation holds what was asked for last; when it is full it becomes the older one,
    and the one before is dropped. What is forgotten is worked out anew, so results do not depend on the bound."""

    def __init__(self, learn: Callable[[list[str]], Iterable[bytes]], limit: int = 300_000, longest: int = 80):
        self.learn, self.limit, self.longest = learn, limit, longest
        self.older: dict[str, bytes] = {}
        self.missing: list[str] = []

    def __missing__(self, word: str) -> bytes | None:
        found = self.older.get(word)
        if found is None:
            self.missing.append(word)
        else:
            self[word] = found
        return found

    def joined(self, lists: list[list[str]]) -> list[bytes]:
        """For each list of words, their bytes one after the other."""
        return [b"".join(x) for x in self.each(lists)]

    def each(self, lists: list[list[str]]) -> list[list[bytes]]:
        """For each list of words, the bytes of each."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        looked, gaps = [], []
        for words in lists:
            self.missing = []
            looked.append(list(map(self.__getitem__, words)))
            gaps.append(self.missing)
        new = list(set().union(*gaps)) if gaps else []
        learnt = dict(zip(new, self.learn(new))) if new else {}
        for i, gap in enumerate(gaps):
            if gap:
                at = iter(gap)
                looked[i] = [learnt[next(at)] if x is None else x for x in looked[i]]
        self.update(learnt)
        for w in [w for w in new if len(w) > self.longest]:
            del self[w]
        return looked
