"""Incremental folder load with Structured Streaming.

The stream carries file descriptors (path and length), not rows: new export files of any format are picked up
by the file source, whole files per micro-batch (so the per-file duplicate rule keeps its scope). Each micro-batch
probes its files as the batch load does, leaves damaged or foreign ones out (their status is kept in the status
table), reports missing columns per file (Q1), and loads the rest with the batch load job inside ``foreachBatch`` under
``batch_id = 'stream-<query name>-<query id>-<epoch id>'``. A file that cannot be read therefore never ends the query.

The query id is kept in the checkpoint: a restarted query resumes with it, and a new checkpoint folder, whose epochs begin at
0 again, has another. A re-run epoch reuses its batch id and overwrites its own partitions of history, log and
statuses, so they stay exactly-once. ``trigger(availableNow=True)`` processes what is there and stops (a scheduled
incremental load).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from oeeforge import sinks
from oeeforge.config import AppConfig, DEFAULT
from oeeforge.operators import quality as Q
from oeeforge.plans import load_job
from oeeforge.sources import exports as X

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The files of a folder as a stream of (name, path, length); their contents are not read here."""
    reader = spark.readStream.format("binaryFile").schema(_FILES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length")


def load_files(spark: SparkSession, files: DataFrame, fmt: str, history_path: str, log_path: str, batch_id: str,
               cfg: AppConfig = DEFAULT, status_path: str | None = None) -> DataFrame:
    """Probe, quarantine and load files given as (name, path, length); the status of each, as written."""
    probed = X.probe_paths(spark, files, fmt)
    staged, probed = X.load_exports(spark, fmt, probed)
    status = X.file_status(spark, "", fmt=fmt, probed=probed).withColumn("batch_id", F.lit(batch_id))
    if not probed.filter("status = 'OK'").isEmpty():
        structural = Q.structural_findings(X.file_columns(spark, "", fmt, probed))
        load_job.load(spark, staged, history_path, log_path, batch_id, cfg, structural)
    sinks.write_partition(status, status_path or f"{log_path.rstrip('/')}_files", value=batch_id)
    return status


def start_incremental_load(spark: SparkSession, folder: str, history_path: str, log_path: str,
                           checkpoint: str, name: str = "exports", cfg: AppConfig = DEFAULT,
                           max_files_per_trigger: int | None = None, available_now: bool = True, fmt: str = "parquet",
                           status_path: str | None = None) -> StreamingQuery:
    def each_batch(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        load_files(batch.sparkSession, batch, fmt, history_path, log_path, f"stream-{name}-{query_id}-{epoch_id}", cfg, status_path)

    writer = (stream_files(spark, folder, max_files_per_trigger).writeStream
              .queryName(name).option("checkpointLocation", checkpoint).foreachBatch(each_batch))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
