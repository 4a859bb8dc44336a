"""A corpus pipeline over ``documents``: each stage calls one operator of oeeforge.llm on all that the stage before kept.

Stage by stage: documents that the co-trained classifier finds poor or toxic go; boilerplate lines that spread
over many sites are taken out of the texts; of each component of near duplicates the document with the least
id stays; documents that hold a benchmark item go; the rest is encoded with the SentencePiece vocabulary. Each stage's
rows are written as Parquet in the shared folder and read by the next.

Defined cases: of rows with the same doc_id one stays in the near-duplicate stage; rows
of a null doc_id are no duplicates of others and stay; null and empty texts stay, and have no pieces; extra columns pass
through; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oeeforge.llm import bm25_decontaminate, common, cotrain_quality, line_spread, overlap_join, piece_codec


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = cotrain_quality.fit_and_classify(docs, common.table(spark, sf_dir, "labels"))
    return scored.where(F.col(cotrain_quality.added(docs.columns)["keep"])).select(*_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_spread.remove_spread_lines(docs).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps a component's least doc_id. Rows that share that id are few (their number does not grow with the component)."""
    key, place = (common.fresh(c, docs.columns) for c in ("kept_id", "place"))
    kept = overlap_join.join(docs).where("component_id = doc_id").select(F.col("doc_id").alias(key)).distinct()
    own = docs.where(F.col("doc_id").isNotNull()).join(kept, F.col("doc_id") == F.col(key), "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(common.whole_text()))
    own = own.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*_columns(docs))
    return own.unionByName(docs.where(F.col("doc_id").isNull()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bm25_decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.digest(piece_codec.round_trip(docs))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("sentencepiece encoding", encoding),
]

#: Classifier, joins by likeness and encoding are not expressed in SQL; tests hold the stages' results against plain Python on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
