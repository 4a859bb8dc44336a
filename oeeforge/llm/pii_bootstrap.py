"""Operator 1: personal data by fixed patterns, extended by bootstrapped contexts. DataFrame functions only.

Base: e-mail addresses, IPv4 addresses, card and phone numbers by their patterns, leftmost and not overlapping, with
their checks (``BASE``). Positions are code points: the texts between the matches are got by splitting at the same
pattern, and lengths are summed up.

Bootstrapping: every base span and every digit-bearing token is a mention of an instance (its text) in lexical patterns: the
two words before it, and the word before with the word after (digits masked). Base spans are seeds, and tokens that overlap one
(a token that begins with a span is the span's mention). On the graph of patterns and instances, rounds alternate: a pattern's
score is the mean score of its distinct instances, if enough of them are sure (seeds, or found so in the rounds before); an
instance's score is the noisy-or of its patterns'. Tokens without digits are no candidates for ``id``. Mentions
of high-scoring instances, and all mentions in high-scoring patterns, that no base span covers are added as kind ``id``.

One narrow pass reads the texts; all else works on mentions. Edges are made distinct before any join, and sums are
built on the map side, so that a pattern or an instance on a third of all rows is one row per task in the shuffle.

Defined cases: a null text is empty and has no spans. Rows are told apart by an id of their own, so null and repeated
doc_ids and equal rows each get their result. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge.llm import common

#: Fixed by the contract: kind, pattern and, where it has one, the range of its number of digits. The patterns are written with
#: possessive repeats and starts at the beginning of a run (or the end of the match before): the same matches, in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a kind cannot occur.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_TOKEN = r"[^\s\"'<>|,;:=()\[\]{}]"
#: A token, from its beginning, with a digit in it.
MENTION = rf"(?<!{_TOKEN}){_TOKEN}*[0-9]{_TOKEN}*+"
ADDED = "id"
SPANS = "array<struct<start: int, end: int, kind: int, value: string>>"
#: Characters of context on either side that patterns are made of.
BEFORE, AFTER = 48, 24


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 3
    min_seeds: int = 3
    pattern_score: float = 0.8
    instance_score: float = 0.9
    min_length: int = 4


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, span: Column) -> Column:
    value = span["value"]
    n = F.length(_digits(value))
    if kind == "ip":
        # parts as digits without leading zeros: at most three digits, and 255
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3)
                        & (F.right(F.concat(F.lit("000"), F.regexp_replace(p, "^0+(?=[0-9])", "")), F.lit(3)) <= F.lit("255")))
    if kind == "card":
        return (n >= 12) & (n <= 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _found(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern with their places in code points."""
    values = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(values))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).cast(SPANS).alias("spans"))

    return F.aggregate(F.arrays_zip(values.alias("value"), gaps.alias("gap")), start, step, lambda acc: acc["spans"])


def base_spans(text: Column) -> Column:
    """The base spans of a text, ordered by start, then kind as listed."""
    none = F.array().cast(SPANS)
    kinds = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        found = F.filter(_found(text, pattern, k), partial(_valid, kind))
        kinds.append(F.when(F.contains(text, F.lit(_NEEDS[kind])), found).otherwise(none) if _NEEDS[kind] else found)
    order = lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"])), -1).when(
        (a["start"] == b["start"]) & (a["kind"] == b["kind"]), 0).otherwise(1)
    return F.array_sort(F.concat(*kinds), order)


def _contexts(text: Column, span: Column) -> Column:
    """The lexical patterns around a span."""
    before = F.lower(F.substring(text, F.greatest(span["start"] - BEFORE, F.lit(0)) + 1, F.least(span["start"], F.lit(BEFORE))))
    after = F.lower(F.substring(text, span["end"] + 1, F.lit(AFTER)))
    mask = lambda x: F.regexp_replace(F.regexp_replace(x, "[0-9]", "0"), r"\s+", " ")
    two = mask(F.regexp_extract(before, r"((?:\S+\s+){1,2}\S{0,16})$", 1))
    one = mask(F.regexp_extract(before, r"(\S+\s+\S{0,16})$", 1))
    then = mask(F.regexp_extract(after, r"^(\S{0,8}\s+\S+|\S{1,8})", 1))
    return F.filter(F.array(F.when(two != "", F.concat(two, F.lit("_"))), F.when((one != "") & (then != ""), F.concat(one, F.lit("_"), then))), lambda p: p.isNotNull())


def _scan(docs: DataFrame, rules: Bootstrap) -> DataFrame:
    """One narrow pass over the texts: per row an id, the base spans, and the mentions with their patterns."""
    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text")).withColumn("base", base_spans(F.col("text")))
    begins = lambda s: F.exists("base", lambda b: b["start"] == s["start"])
    tokens = F.filter(_found(F.col("text"), MENTION, len(BASE)), lambda s: (F.length(s["value"]) >= rules.min_length) & ~begins(s))
    mentions = F.concat("base", tokens)
    seeded = lambda s: F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    described = F.transform(mentions, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("instance"),
                                                         seeded(s).alias("seed"), _contexts(F.col("text"), s).alias("patterns")))
    return scanned.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", described.alias("mentions"))


def patterns(mentions: DataFrame, rules: Bootstrap) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns and of instances after the rounds, from ``mentions(instance, seed, patterns)``."""
    edges = common.stage_table(
        mentions.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    seeds = edges.where("seed").groupBy("instance").agg(F.lit(1.0).alias("score"))
    scores = seeds
    for _ in range(rules.rounds):
        known = edges.join(scores, "instance", "left")
        rated = (
            known.groupBy("pattern").agg(F.count_if(F.col("score") >= rules.instance_score).alias("n_sure"), F.avg(F.coalesce("score", F.lit(0.0))).alias("pattern_score"))
            .where((F.col("n_sure") >= rules.min_seeds) & (F.col("pattern_score") > 0))
        )
        rated = common.stage_table(rated, "pii-patterns")
        doubt = F.sum(F.log(F.greatest(1 - F.col("pattern_score"), F.lit(1e-9))))
        scores = common.stage_table(
            edges.join(rated, "pattern").groupBy("instance").agg(F.max("seed").alias("seed"), (1 - F.exp(doubt)).alias("score"))
            .select("instance", F.when(F.col("seed"), 1.0).otherwise(F.col("score")).alias("score"))
            .unionByName(seeds).groupBy("instance").agg(F.max("score").alias("score")), "pii-instances")
    return rated, scores


def find(docs: DataFrame, rules: Bootstrap = Bootstrap()) -> DataFrame:
    """doc_id, ``base`` and ``added`` spans (start, end, kind, value) of every row."""
    rows = common.stage_table(_scan(docs, rules), "pii-rows")
    mentions = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    rated, scores = patterns(mentions, rules)
    sure = rated.where(F.col("pattern_score") >= rules.pattern_score).select("pattern")
    unseen = mentions.where(~F.col("seed"))
    place = ["row", "start", "end", "instance"]
    by_pattern = unseen.select(*place, F.explode("patterns").alias("pattern")).join(sure, "pattern", "left_semi").select(*place)
    by_instance = unseen.select(*place).join(scores.where(F.col("score") >= rules.instance_score).select("instance"), "instance", "left_semi").select(*place)
    span = F.struct(F.col("start"), F.col("end"), F.lit(len(BASE)).alias("kind"), F.col("instance").alias("value"))
    added = by_pattern.unionByName(by_instance).groupBy("row").agg(F.sort_array(F.collect_set(span)).alias("added"))
    return rows.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", F.array().cast(SPANS)).alias("added"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined, in their order."""
    names = F.array(*[F.lit(k) for k in (*BASE, ADDED)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: int, span: Column) -> Column:
    return span["kind"] == kind


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"))
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    counts = [F.size(F.filter("base", partial(_is, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(every).alias("spans"),
                        F.size("added").cast("long").alias("n_added"))
