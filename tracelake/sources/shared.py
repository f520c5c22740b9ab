"""Paths that the driver and all executors see, and the Arrow file system behind a path."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme: one without is of the default file system, as for Spark's own readers."""
    if not re.match(r"[A-Za-z][\w+.-]*:", path):
        path = _of_default(spark, path)
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def _of_default(spark: SparkSession, path: str) -> str:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    default = jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf)
    here = os.getcwd() if default.getScheme() in (None, "file") else "/"
    return jvm.org.apache.hadoop.fs.Path(path).makeQualified(default, jvm.org.apache.hadoop.fs.Path(here)).toString()


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+://", path) else (pafs.LocalFileSystem(), path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines see (spark.checkpoint.dir), or in a local one where none is set and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tracelake-')}"
    return f"{qualified(spark, folder).rstrip('/')}/waveforms/{uuid.uuid4().hex}-{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and still there when an executor is lost."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
