"""Helpers shared by the corpus operators.

Rules that hold for every operator unless its docstring says otherwise:

* a null text is an empty text;
* a null id is one more id value that sorts below all others;
* rows are told apart by their id; a repeated row gets the result of its twin, and results
  that count documents count distinct ids;
* an empty table gives an empty result with the same schema;
* input columns an operator doesn't name are ignored or passed through untouched.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch that goes to Python, and of a row group of a written table; either is held by each running task.
BATCH_BYTES = 8 << 20
ROW_GROUP_BYTES = 16 << 20

ASCII_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, on the default file system if it names none.

    Where it is unset, a local master gets a folder of its own; any other master is refused, as its machines share no local folder.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tracelake-"))
        path = context.getCheckpointDir()
    folder = _hadoop_path(spark, path)
    path = folder.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return path.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = _hadoop_path(spark, path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


_open_folders: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that operators write inside the block go to one folder, which is deleted at its end.

    Results are lazy and read those tables: write a result elsewhere (``written`` with a path) before the block ends.
    """
    path = f"{shared_dir(spark)}/tracelake/run-{uuid.uuid4().hex}"
    _open_folders.append(path)
    try:
        yield path
    finally:
        _open_folders.remove(path)
        _delete(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    root = _open_folders[-1] if _open_folders else f"{shared_dir(spark)}/tracelake"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and still there when an executor is lost."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    root = _hadoop_path(spark, f"{shared_dir(spark)}/tracelake/").toUri().getPath()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if _hadoop_path(spark, path).toUri().getPath().startswith(root):
            _delete(spark, path)


def text_bytes(text: str | Column = "text") -> Column:
    """UTF-8 bytes of a text column, null as empty: Python sees bytes and never fails on malformed text."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.cast("string").cast("binary"), F.lit(b""))


def id_value(column: str) -> Column:
    return F.col(f"`{column}`")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes: texts may be long, and both sides hold a batch."""
    conf = df.sparkSession.conf
    if _bytes(conf.get(_BATCH, "64m")) > BATCH_BYTES:
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    return df.mapInArrow(fn, schema)


def _bytes(size: str) -> int:
    number = int(size.rstrip("bkmgBKMG"))
    unit = size[len(str(number)) :].lower()[:1]
    return number << {"k": 10, "m": 20, "g": 30}.get(unit, 0) if number > 0 else 1 << 62


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose ``column`` holds about ``max_bytes``; one longer value is a piece of its own."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def without(columns: list[str], drop: set[str]) -> list[str]:
    low = {d.lower() for d in drop}
    return [c for c in columns if c.lower() not in low]
