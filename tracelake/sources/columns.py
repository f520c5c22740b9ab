"""Evaluated columns kept as data: a table for each expression of a table of points, found again by later evaluations and sessions.

A table lies under a name made from the points' identity and the expression's canonical text, and holds the points' keys and the value. It is written to a folder of its own and appears by a rename,
so it is there whole or not at all; of two that are made at once the first stays.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tracelake.sources.shared import qualified


@dataclass
class ColumnStore:
    """``identity`` tells tables of points apart: other points, or other rows of a file, need another one. ``keys`` name the columns that tell points apart."""

    spark: SparkSession
    folder: str
    identity: str
    keys: tuple[str, ...]
    _read: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def path(self, text: str) -> str:
        name = hashlib.sha256("\0".join([self.identity, *self.keys, text]).encode()).hexdigest()
        return f"{qualified(self.spark, self.folder).rstrip('/')}/{name}"

    def _files(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def find(self, text: str) -> DataFrame | None:
        """keys and ``value``, if the column is stored."""
        path = self.path(text)
        if path not in self._read:
            fs, folder = self._files(path)
            if not fs.exists(folder):
                return None
            self._read[path] = self.spark.read.parquet(path)
        return self._read[path]

    def put(self, text: str, column: DataFrame) -> None:
        """Stores ``column`` (keys and ``value``)."""
        path = self.path(text)
        made = f"{path}.{uuid.uuid4().hex}"
        column.write.parquet(made)
        fs, folder = self._files(path)
        source = self._files(made)[1]
        if fs.exists(folder) or not fs.rename(source, folder):
            fs.delete(source, True)  # another session was first
