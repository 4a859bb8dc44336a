"""Operator 4: benchmark decontamination by BM25 with block-max WAND.

The benchmark items are indexed (inverted lists over item numbers, cut into blocks with their largest weights); every
passage of every training text is a query. An item's passages are windows of words, twice as long as the item and half
overlapping, so an item that a text holds lies wholly in one of them. A passage's score for an item is its BM25 sum
divided by the item's own (an exact copy has 1). Passages are queried together: a stretch of three times the words of the shard's
longest item holds every passage that begins in its first third, and scores at least as much as each of them. So first
the sum of the lists' largest weights is taken for all stretches of a slice at once, stretches that reach the
threshold by it go through the block-max WAND search, and the items found there are scored on their own passages. An item counts
when one of these reaches ``threshold`` and holds enough of the word trigrams of its question and of its answer (its last
sentence). What is found depends on the item and the text, not on the other items of a shard.

Sizes: the index is built and sent out in shards of at most about ``SHARD_BYTES`` of item text, whatever the size
of the benchmark; each shard is one narrow pass over the texts. An item's text is written once; its terms carry its number.
Document frequencies are over all items. Texts are never shuffled; only matches are.

Defined cases: null and empty texts match nothing; items without words match nothing; equal texts are found under each of their item_ids,
repeated rows (same item_id and text) are one item; nulls in item_id are kept; repeated documents give one row per (doc_id, item_id) in ``matches`` and go (or stay) together in
``decontaminate``. Empty tables give no matches. Extra columns pass through ``decontaminate`` and are ignored elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge.llm import common

SHARD_BYTES = 4 << 20
BLOCK = 16
GROUPS = 64
K1, B = 1.2, 0.75
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.?!\n]+\s*")


@dataclass(frozen=True)
class Rules:
    #: Share of an item's own BM25 score that a passage must reach.
    threshold: float = 0.6
    #: Shares of the word trigrams of question and answer that it must hold.
    question: float = 0.5
    answer: float = 0.4


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's last sentence are its answer, those before its question (all of it, if it has one sentence)."""
    cut = max((m.end() for m in _SENTENCE.finditer(text.rstrip(" .?!\n\t\r"))), default=0)
    question, answer = words_of(text[:cut]), words_of(text[cut:])
    return (question, answer) if question else (answer, [])


def trigrams(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


@dataclass
class Index:
    """One shard: its items and, per term, the items that hold it with their weights, as shares of each item's whole score."""

    item_ids: list
    texts: list[str]
    terms: dict[str, tuple[np.ndarray, np.ndarray]]
    #: Words of each item, and of the longest.
    n_words: list[int]
    longest: int
    parts: dict[int, tuple[set, set]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.top = {t: float(w.max()) for t, (_, w) in self.terms.items()}
        # the largest weight of each term in each of at most GROUPS runs of items, for the bound of many passages at once
        self.number = {t: k for k, t in enumerate(self.terms)}
        groups = min(GROUPS, len(self.item_ids))
        self.group_top = np.zeros((len(self.terms), groups), np.float32)
        for k, (items, weights) in enumerate(self.terms.values()):
            np.maximum.at(self.group_top[k], items * groups // len(self.item_ids), weights.astype(np.float32))
        self.blocks = {}
        for t, (items, weights) in self.terms.items():
            starts = np.flatnonzero(np.concatenate(([True], items[1:] // BLOCK != items[:-1] // BLOCK)))
            self.blocks[t] = dict(zip((items[starts] // BLOCK).tolist(), np.maximum.reduceat(weights, starts).tolist()))
        self.weights: list[dict[str, float]] = [{} for _ in self.item_ids]
        for t, (items, weights) in self.terms.items():
            for i, w in zip(items.tolist(), weights.tolist()):
                self.weights[i][t] = w
        self.lists = {t: (items.tolist(), weights.tolist()) for t, (items, weights) in self.terms.items()}

    def search(self, words: set[str], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for a passage of these words reaches the threshold: block-max WAND."""
        found, slack = [], threshold - 1e-9
        cursors = [[self.lists[t][0][0], 0, t] for t in words if t in self.lists]
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += self.top[c[2]]
                if bound >= slack:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.blocks[c[2]].get(block, 0.0) for c in cursors[: pivot + 1]) >= slack:
                if cursors[0][0] == item:
                    score = sum(self.lists[c[2]][1][c[1]] for c in cursors[: pivot + 1])
                    if score >= slack:
                        found.append((item, score))
                    target, moved = item + 1, cursors[: pivot + 1]
                else:
                    target, moved = item, [c for c in cursors[:pivot] if c[0] < item]
            else:
                # nothing in this block can reach the threshold before another list comes in
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target, moved = max(target, item + 1), cursors[: pivot + 1]
            for c in moved:
                items, at = self.lists[c[2]][0], c[1]
                while at < len(items) and items[at] < target:
                    at += 1
                c[0], c[1] = (items[at] if at < len(items) else None), at
            cursors = [c for c in cursors if c[0] is not None]
        return found

    def overlap(self, item: int, words: list[str]) -> tuple[float, float]:
        """Shares of the trigrams of the item's question and answer that a passage holds; 1 for an answer too short for one."""
        if item not in self.parts:
            question, answer = question_and_answer(self.texts[item])
            self.parts[item] = trigrams(question), trigrams(answer) if len(answer) >= 3 else set()
        question, answer = self.parts[item]
        own = set(zip(words, words[1:], words[2:])) | {(w,) for w in words} | set(zip(words, words[1:]))
        return (len(question & own) / len(question) if question else 0.0), (len(answer & own) / len(answer) if answer else 1.0)

    def matches(self, texts: list[str], rules: Rules) -> list[dict[int, tuple[float, float, float, int]]]:
        """Per text: item -> best score, its question and answer overlaps, and the number of the item's passages that match."""
        out: list[dict[int, tuple[float, float, float, int]]] = [{} for _ in texts]
        for i, (text, thirds) in enumerate(zip(texts, self._promising(texts, rules.threshold))):
            if not len(thirds):
                continue
            words = words_of(text)
            for h in thirds.tolist():
                begin = h * self.longest
                for item, _ in self.search(set(words[begin : begin + 3 * self.longest]), rules.threshold):
                    step, weights = self.n_words[item], self.weights[item]
                    for at in range(-(-begin // step) * step, min(begin + self.longest, len(words)), step):
                        passage = words[at : at + 2 * step]
                        score = sum(weights.get(w, 0.0) for w in set(passage))
                        if score < rules.threshold - 1e-9:
                            continue
                        q, a = self.overlap(item, passage)
                        if q >= rules.question and a >= rules.answer:
                            best = out[i].get(item, (0.0, 0.0, 0.0, 0))
                            out[i][item] = (*max(best[:3], (score, q, a)), best[3] + 1)
        return out

    def _promising(self, texts: list[str], threshold: float) -> list[np.ndarray]:
        """Per text the numbers of the thirds where a stretch begins in which the largest weights of its terms
        for some group of items reach the threshold together."""
        third, number = self.longest, self.number
        place, term, ends = [], [], []
        for text in texts:
            words = words_of(text)
            distinct = {(k // third, number[t]) for k, t in enumerate(words) if t in number}
            begin = ends[-1] if ends else 0
            place += [begin + h for h, _ in distinct]
            term += [t for _, t in distinct]
            ends.append(begin + len(words) // third + 3)  # two rows more, so that a text's last stretch has nothing after it
        bound = np.zeros((ends[-1] if ends else 0, self.group_top.shape[1]), np.float32)
        if place:
            place = np.array(place)
            order = np.argsort(place, kind="stable")
            place, rows = place[order], self.group_top[np.array(term)[order]]
            starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            bound[place[starts]] = np.add.reduceat(rows, starts, axis=0)
        good = np.zeros(len(bound), bool)
        if len(bound):
            good[:-2] = (bound[:-2] + bound[1:-1] + bound[2:]).max(axis=1) >= threshold - 1e-4
        return [np.flatnonzero(good[a : b - 2]) for a, b in zip([0, *ends], ends)]


def shards(items: DataFrame) -> Iterator[Index]:
    """The index of ``items(item_id, text)``, shard by shard; one shard at a time is on the driver."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), common.whole_text().alias("text")).where(F.col("text") != "")
    # a repeated row is the same item: it counts once in the frequencies and stands once in every list
    items = items.dropDuplicates(["item_id", "text"])
    size = items.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not size["n"]:
        return
    many = -(-size["b"] // SHARD_BYTES)
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(many)).cast("int")).withColumn("number", F.monotonically_increasing_id())
    items = common.stage_table(items, "benchmark-items")
    terms = common.stage_table(items.mapInArrow(_item_terms, "shard int, number long, term string, tf int, n_words int"), "benchmark-terms")
    mean = terms.groupBy("number").agg(F.first("n_words").alias("n_words")).agg(F.avg("n_words")).first()[0]
    frequency = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    postings = common.stage_table(terms.join(frequency, "term"), "benchmark-postings")
    for shard in range(many):
        rows = postings.where(F.col("shard") == shard).orderBy("number", "term").collect()
        if rows:
            own = {r["number"]: (r["item_id"], r["text"]) for r in items.where(F.col("shard") == shard).select("number", "item_id", "text").collect()}
            yield _index(rows, own, size["n"], mean)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for shard, number, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "number", "text"))):
            words = words_of(text)
            counts: dict[str, int] = {}
            for w in words:
                counts[w] = counts.get(w, 0) + 1
            rows += [(shard, number, t, n, len(words)) for t, n in counts.items()]
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32())
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["shard", "number", "term", "tf", "n_words"])


def _index(rows: list, items: dict[int, tuple], n_items: int, mean: float) -> Index:
    places: dict[int, int] = {}
    own: list[tuple[int, str, float]] = []
    n_words: list[int] = []
    for r in rows:
        i = places.setdefault(r["number"], len(places))
        if i == len(n_words):
            n_words.append(r["n_words"])
        idf = np.log(1 + (n_items - r["df"] + 0.5) / (r["df"] + 0.5))
        own.append((i, r["term"], idf * r["tf"] * (K1 + 1) / (r["tf"] + K1 * (1 - B + B * r["n_words"] / mean))))
    whole = np.bincount([i for i, _, _ in own], weights=[max(w, 1e-12) for _, _, w in own])
    lists: dict[str, list] = {}
    for i, term, weight in own:
        lists.setdefault(term, []).append((i, max(weight, 1e-12) / whole[i]))
    terms = {t: (np.array([i for i, _ in x]), np.array([w for _, w in x])) for t, x in lists.items()}
    return Index([items[k][0] for k in places], [items[k][1] for k in places], terms, n_words, max(n_words))


def _search(index, rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            for part in common.pieces(batch, "text", 1 << 20):
                rows = []
                for doc_id, found in zip(part.column("doc_id").to_pylist(), own.matches(part.column("text").to_pylist(), rules)):
                    rows += [(doc_id, own.item_ids[i], *x) for i, x in found.items()]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                      ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "n_passages"])

    return run


def matches(docs: DataFrame, items: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """A row per document and benchmark item that it holds, with its best passage's score and overlaps."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, n_passages long"
    found = None
    for index in shards(items):
        own = docs.mapInArrow(_search(spark.sparkContext.broadcast(index), rules), schema)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best, F.max("n_passages").alias("n_passages")).select("doc_id", "item_id", "best.*", "n_passages")


def _clean(index, rules: Rules, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch, column, 1 << 20):
                texts = [t or "" for t in part.column(column).to_pylist()]
                yield part.filter(pa.array([not m for m in index.value.matches(texts, rules)], pa.bool_()))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; a narrow pass for each shard of the index."""
    for index in shards(items):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(index), rules, text), docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
