"""Helpers shared by the operators: table access, Arrow batches, doc-order buckets, shared-folder files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oeeforge.functions.files import delete_path
from oeeforge.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The cluster's own shuffle width; operators that fix a number of partitions take it from there."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(name: str, taken: list[str]) -> str:
    """The name, with underscores added until no column (whatever its case) has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def packed(docs: DataFrame, *own) -> DataFrame:
    """A row as one column, ``row``, beside the named columns that an operator works with: no input column can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *own)


def unpacked(columns: list[str]) -> list[Column]:
    """The columns of ``row`` again."""
    return [F.col("row").getField(c).alias(c) for c in columns]


def whole_text(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under spark.checkpoint.dir and read it back (cuts the lineage)."""
    return staged(df, name)[0]


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As stage_table, with the table's path for ``discard``."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing reads any more."""
    for path in paths:
        delete_path(spark, path)


def pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of ``column`` each (a longer text is a slice of its own)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    if size.sum() <= limit:
        yield batch
        return
    start, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def id_cuts(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending cut points that deal the keys out about evenly.

    Bucket b holds the keys above cut b-1 and up to cut b. Only these cut points reach the driver; their number
    is the number of buckets, whatever the size of the table.
    """
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(F.col(key).cast("long"), at, 10_000)).first()[0]
    return sorted(set(found or []))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, as a URI."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it: local or mounted folders, HDFS, S3 or GCS."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(uri)
