"""Operator 5: a quality classifier by co-training of two views.

View 1 is the text's content (the words, and beginnings of words, that tell the classes apart, and the make-up of its characters), view 2 the
page's metadata (source, language, sizes). For each of two heads, poor quality and toxicity, a logistic regression per view is fitted on
labelled rows. In every round each view scores all unlabelled rows, and of those it is confident about some become
labelled rows for the other view, which is fitted anew with them. At the end the two views' margins are calibrated and
combined on held-out labelled rows, and every document is scored.

On Spark: the labelled rows give the vocabulary; one narrow pass over whole texts then writes both views' vectors of every row,
and the rounds and the final scores are narrow passes over these. Bounds (parameters of ``Rules``): a fit takes about
``max_labelled`` labelled rows, one of each doc_id, and per class about ``max_taught`` confident rows, taken by a hash
of the row; all unlabelled rows are scored in every round. Only model coefficients and counts reach the driver.

Defined cases: a null text is empty, null source or language are values of their own; rows with a null or unknown doc_id in
``labels`` are not used, of several labels of one document the worst counts; of several rows of a labelled doc_id one teaches;
null labels are left out of their head. A head whose labelled rows are all of one class gives that class to every row; without any labelled row nothing is rejected. Equal rows get equal
scores; empty tables give empty results. Extra columns pass through ``classify`` whatever their names: the added columns p_poor,
p_toxic and keep take underscores where a name is taken (``added`` tells).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge.llm import common

HEADS = ("poor", "toxic")
VIEWS = ("words", "meta")
BEGINNINGS = (4, 5)
#: Numbers that tell the make-up of a text's characters.
SHAPES = 6


@dataclass(frozen=True)
class Rules:
    max_labelled: int = 10_000
    #: Confident rows that a view takes from the other per class and round.
    max_taught: int = 4_000
    rounds: int = 2
    #: The terms kept per head: those whose share differs most between its classes, with at least this z-score and this many rows.
    max_terms: int = 2_000
    min_z: float = 4.0
    min_rows: int = 5
    confident: float = 0.97
    held_out: float = 0.2
    reject_from: float = 0.5
    iterations: int = 15
    #: L2 penalties of the views.
    penalty: dict = field(default_factory=lambda: {"words": 0.001, "meta": 0.001})


def _buckets(column: str, n: int, docs: DataFrame) -> list[Column]:
    value = F.coalesce(F.col(column).cast("string"), F.lit("")) if column in docs.columns else F.lit("")
    place = F.pmod(F.xxhash64(value), F.lit(n))
    return [(place == k).cast("double") for k in range(n)]


def _longer(k: int, word: Column) -> Column:
    return F.length(word) > k


def _beginning(k: int, word: Column) -> Column:
    return F.concat(F.substring(word, 1, k), F.lit("*"))


def _terms() -> Column:
    """The distinct words of ``text``, and beginnings of words, which stand for words that are too rare to be learnt."""
    distinct = F.array_distinct(F.col("tokens"))
    begins = [F.transform(F.filter(distinct, partial(_longer, k)), partial(_beginning, k)) for k in BEGINNINGS]
    return F.array_distinct(F.concat(distinct, *begins))


def _with_shape(docs: DataFrame) -> DataFrame:
    """``docs(text, source, lang, ...)`` with its terms, and the vectors shape (of the text's characters) and view_meta."""
    text = F.col("text")
    docs = docs.withColumn("tokens", F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.greatest(F.size("tokens"), F.lit(1)).cast("double")
    share = lambda outside: F.length(F.regexp_replace(text, outside, "")) / n
    shape = [n / words, F.size(F.array_distinct("tokens")) / words,
             share(r"[^\p{Lu}]+"), share(r"[\p{L}\p{N}\s.,;:'\"()-]+"), share(r"[^0-9]+"), share(r"[^.,;:]+")]
    meta = [F.log1p(n), F.log1p(words), F.size(F.split(text, "\n")) / words, *_buckets("source", 32, docs), *_buckets("lang", 8, docs)]
    vector = lambda parts: array_to_vector(F.array(*[F.coalesce(m.cast("double"), F.lit(0.0)) for m in parts]))
    return docs.withColumns({"terms": _terms(), "shape": vector(shape), "view_meta": vector(meta)}).drop("tokens")


def _with_words(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The vector view_words, of the vocabulary's terms and the shape, in the place of these."""
    found = CountVectorizerModel.from_vocabulary(vocabulary, "terms", "found").setBinary(True).transform(docs)
    found = VectorSizeHint(inputCol="shape", size=SHAPES, handleInvalid="optimistic").transform(found)
    return VectorAssembler(inputCols=["found", "shape"], outputCol="view_words").transform(found).drop("terms", "found", "shape")


def telling_terms(rows: DataFrame, rules: Rules) -> list[str]:
    """The vocabulary: at most ``max_terms`` terms per head, from the labelled rows for fitting."""
    rows = rows.where(F.col("part") == 0)
    found: set[str] = set()
    for head in HEADS:
        own = rows.where(F.col(head).isNotNull())
        n = own.agg(F.count_if(F.col(head) == 1).alias("bad"), F.count_if(F.col(head) == 0).alias("good")).first()
        if not n["bad"] or not n["good"]:
            continue
        counts = own.select(head, F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum(head).alias("bad"))
        share = F.col("n") / (n["bad"] + n["good"])
        spread = F.sqrt(share * (1 - share) * (1 / n["bad"] + 1 / n["good"]))
        z = F.abs(F.col("bad") / n["bad"] - (F.col("n") - F.col("bad")) / n["good"]) / spread
        best = counts.where((F.col("n") >= rules.min_rows) & (share < 1)).withColumn("z", z).where(F.col("z") >= rules.min_z)
        found.update(r["term"] for r in best.orderBy(F.desc("z"), "term").limit(rules.max_terms).collect())
    return sorted(found) or ["*"]  # no term is a star alone


@dataclass
class Head:
    """Either a constant, or a model per view and the weights of their margins."""

    constant: float | None = None
    models: dict[str, LogisticRegressionModel] | None = None
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)


@dataclass
class CoTrained:
    heads: dict[str, Head]
    vocabulary: list[str]
    rules: Rules


def _regression(rules: Rules, view: str, target: str, penalty: float) -> LogisticRegression:
    return LogisticRegression(featuresCol=f"view_{view}", labelCol=target, regParam=penalty, maxIter=rules.iterations,
                              rawPredictionCol="raw", probabilityCol="probability", predictionCol="predicted")


def _margin(rows: DataFrame, model: LogisticRegressionModel, name: str) -> DataFrame:
    scored = model.transform(rows).withColumn(name, vector_to_array("raw")[1])
    return scored.drop("raw", "probability", "predicted")


def _sample(rows: DataFrame, most: int, seed: str) -> DataFrame:
    """About ``most`` rows (all, if there are fewer), by a hash of the id."""
    n = rows.count()
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return rows.where(part < min(1.0, most / max(n, 1)))


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, poor, toxic) of the labels, the worst of each document."""
    label = lambda c: F.max(F.col(c).cast("int"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((1 - F.min(F.col("quality").cast("int"))).alias("poor"), label("toxic").alias("toxic"))
    return known.where(F.col("poor").isNotNull() | F.col("toxic").isNotNull())


def _texts(docs: DataFrame, *more: Column) -> DataFrame:
    """The columns that the views read, under their own names."""
    given = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    return docs.select(F.col("doc_id").alias("doc_id"), common.whole_text().alias("text"), *given, *more)


def labelled_rows(docs: DataFrame, labels: DataFrame, rules: Rules) -> DataFrame:
    """The bounded set of labelled rows that models are fitted on: for fitting (part 0) or held out (1); one row per doc_id."""
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull())
    chosen = _sample(_known(labels).join(ids, "doc_id", "left_semi"), rules.max_labelled, "labelled")
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(1000)) < 1000 * rules.held_out
    # the chosen ids are bounded by the parameter, so they may be broadcast
    chosen = F.broadcast(chosen.withColumn("part", F.when(held, 1).otherwise(0)))
    rows = _texts(docs).join(chosen, "doc_id")
    one = F.min_by(F.struct("text", "source", "lang", "part", *HEADS), F.xxhash64("text", "source", "lang"))
    rows = rows.groupBy("doc_id").agg(one.alias("one")).select("doc_id", "one.*")
    rows = _with_shape(rows).select("doc_id", "part", *[F.col(h).cast("double").alias(h) for h in HEADS], "terms", "shape", "view_meta")
    return common.stage_table(rows.repartition(3), "training-rows")


def _taught(pool: DataFrame, model: LogisticRegressionModel, view: str, head: str, base: DataFrame, rules: Rules) -> DataFrame:
    """``base`` with confident rows of the pool (all of it is scored) as labelled ones, about ``max_taught`` of each class."""
    sure = model.transform(pool).withColumn("p", vector_to_array("probability")[1])
    sure = sure.withColumn(head, F.when(F.col("p") >= rules.confident, 1.0).when(F.col("p") <= 1 - rules.confident, 0.0)).where(F.col(head).isNotNull())
    many = {r[head]: r["n"] for r in sure.groupBy(head).agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.lit(view), "view_words", "view_meta", "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col(head) == 1.0, min(1.0, rules.max_taught / max(1, many.get(1.0, 0)))).otherwise(min(1.0, rules.max_taught / max(1, many.get(0.0, 0))))
    return base.unionByName(sure.where(place < share).select(*base.columns))


def _fit_head(rows: DataFrame, pool: DataFrame, head: str, rules: Rules) -> Head:
    counts = {(r["part"], r[head]): r["count"] for r in rows.where(F.col(head).isNotNull()).groupBy("part", head).count().collect()}
    if any(counts.get((0, y), 0) == 0 for y in (0.0, 1.0)):
        return Head(constant=1.0 if counts.get((0, 1.0), 0) else 0.0)
    columns = ["doc_id", head, "view_words", "view_meta"]
    base = rows.where((F.col("part") == 0) & F.col(head).isNotNull()).select(*columns)
    models = {v: _regression(rules, v, head, rules.penalty[v]).fit(base) for v in VIEWS}
    for k in range(rules.rounds):
        # what the one view is sure about becomes a label for the other
        taught = {other: common.staged(_taught(pool, models[view], f"{view}-{k}", head, base, rules).coalesce(3), "taught-rows") for view, other in (VIEWS, VIEWS[::-1])}
        models = {v: _regression(rules, v, head, rules.penalty[v]).fit(taught[v][0]) for v in VIEWS}
        common.discard(rows.sparkSession, *[path for _, path in taught.values()])
    held = rows.where((F.col("part") == 1) & F.col(head).isNotNull())
    if any(counts.get((1, y), 0) == 0 for y in (0.0, 1.0)):
        held = base
    for v in VIEWS:
        held = _margin(held, models[v], f"m_{v}")
    held = held.select(head, array_to_vector(F.array("m_words", "m_meta")).alias("view_both"))
    both = _regression(rules, "both", head, 0.001).fit(held)
    return Head(models=models, weights=(float(both.coefficients[0]), float(both.coefficients[1]), float(both.intercept)))


def _vocabulary(rows: DataFrame, rules: Rules) -> tuple[list[str], DataFrame]:
    """The terms, and the labelled rows as vectors."""
    vocabulary = telling_terms(rows, rules)
    return vocabulary, common.stage_table(_with_words(rows, vocabulary).coalesce(3), "training-vectors")


def _fit(rows: DataFrame, vocabulary: list[str], vectors: DataFrame, labels: DataFrame, rules: Rules) -> CoTrained:
    """Both heads; ``vectors(doc_id, view_words, view_meta)``: every row's views."""
    unlabelled = vectors.select("doc_id", "view_words", "view_meta").join(_known(labels).select("doc_id"), "doc_id", "left_anti")
    return CoTrained({h: _fit_head(rows, unlabelled, h, rules) for h in HEADS}, vocabulary, rules)


def _vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Every row of ``docs`` as the column ``row``, with its doc_id and both views: a narrow pass over whole texts."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return _with_words(_with_shape(_texts(docs, row)), vocabulary).drop("text", "source", "lang")


def fit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> CoTrained:
    """Fits both heads on ``docs`` and ``labels(doc_id, quality, toxic)``."""
    vocabulary, rows = _vocabulary(labelled_rows(docs, labels, rules), rules)
    vectors, path = common.staged(_vectors(docs.select("doc_id", *[c for c in ("text", "source", "lang") if c in docs.columns]), vocabulary).drop("row"), "document-vectors")
    model = _fit(rows, vocabulary, vectors, labels, rules)
    common.discard(docs.sparkSession, path)
    return model


def added(columns: list[str]) -> dict[str, str]:
    """The names of the columns that ``classify`` adds to a table with these columns."""
    return {c: common.fresh(c, columns) for c in (*[f"p_{h}" for h in HEADS], "keep")}


def _scored(vectors: DataFrame, model: CoTrained, columns: list[str]) -> DataFrame:
    out, names = vectors, added(columns)
    for head, own in model.heads.items():
        if own.constant is not None:
            out = out.withColumn(f"p_{head}", F.lit(own.constant))
            continue
        for v in VIEWS:
            out = _margin(out, own.models[v], f"m_{v}")
        a, b, c = own.weights
        out = out.withColumn(f"p_{head}", 1 / (1 + F.exp(-(a * F.col("m_words") + b * F.col("m_meta") + c)))).drop("m_words", "m_meta")
    bad = F.greatest(*[F.col(f"p_{h}") for h in model.heads]) >= model.rules.reject_from
    return out.select(*common.unpacked(columns), *[F.col(f"p_{h}").alias(names[f"p_{h}"]) for h in model.heads], (~bad).alias(names["keep"]))


def classify(docs: DataFrame, model: CoTrained) -> DataFrame:
    """``docs`` with p_poor, p_toxic and keep for every row: a narrow pass over whole texts."""
    return _scored(_vectors(docs, model.vocabulary), model, docs.columns)


def fit_and_classify(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``classify`` by a model of the same rows: their vectors, and the rows that are to be returned, are written once for both."""
    vocabulary, rows = _vocabulary(labelled_rows(docs, labels, rules), rules)
    vectors = common.stage_table(_vectors(docs, vocabulary), "document-vectors")
    return _scored(vectors, _fit(rows, vocabulary, vectors, labels, rules), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = common.table(spark, sf_dir, "labels")
    vocabulary, rows = _vocabulary(labelled_rows(docs, labels, Rules()), Rules())
    vectors = common.stage_table(_vectors(docs, vocabulary).withColumn("row", F.struct("doc_id")), "document-vectors")  # texts are not needed again
    return _scored(vectors, _fit(rows, vocabulary, vectors, labels, Rules()), ["doc_id"]).select("doc_id", "p_poor", "p_toxic", "keep")
