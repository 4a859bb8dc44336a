"""Files and folders through Spark's own file systems (driver) and Arrow's (tasks)."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder? Any other trouble with the file system is raised."""
    found, system = _hadoop_path(spark, path)
    return bool(system.exists(found))


def list_files(spark: SparkSession, folder: str) -> list[tuple[str, str, int]]:
    """(name, URI, bytes) of the files directly in a folder, by name; hidden ones are left out."""
    found, system = _hadoop_path(spark, folder)
    files = [(s.getPath().getName(), s.getPath().toString(), int(s.getLen())) for s in system.listStatus(found) if s.isFile()]
    return sorted(f for f in files if not f[0].startswith((".", "_")))


def data_version(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time of change) of a file, or of the files directly in a folder, by name."""
    found, system = _hadoop_path(spark, path)
    return sorted((s.getPath().getName(), int(s.getLen()), int(s.getModificationTime())) for s in system.listStatus(found) if s.isFile())


def delete_path(spark: SparkSession, path: str) -> None:
    found, system = _hadoop_path(spark, path)
    system.delete(found, True)


def open_input(uri: str):
    """A file opened for reading in a task."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri[len("file:"):].lstrip("/"))
    if "://" not in uri:
        return fs.LocalFileSystem().open_input_file(os.path.abspath(uri))
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
