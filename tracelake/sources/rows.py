"""The binary part of a waveform file: rows of fixed width, so any range of rows is read by a seek and written at its own place.

``read_jobs`` reads ranges that a table names, many a task, and decodes the columns that are asked for. ``edges`` finds a window of a sorted abscissa by binary search in the file.
``WaveformSource`` is the same reader, and a writer, as a format of Spark: ``spark.read.format("waveform").option("columns", "0,2").load(path)``.

A writing task makes a file of its attempt; only attempts that Spark commits are in the manifest, so a repeated attempt can't damage the result. The parts are then copied to their places by tasks where the
file system allows it (a local or mounted one), else by one task that streams them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tracelake.sources.shared import file_system

#: Bytes that one task reads or copies, and bytes that are read at once.
RANGE_BYTES, BLOCK_BYTES = 32 << 20, 4 << 20
#: Rows that leave a task at once: with their names of files and numbers they are several times as large as in the file, and idle workers keep what they needed once.
BATCH_ROWS = 1 << 13


@dataclass(frozen=True)
class Layout:
    """How rows of a file lie; ``offset`` and ``n_points`` are those of one file, the rest is common to all files of a schema."""

    n_variables: int
    is_complex: bool
    offset: int = 0
    n_points: int = 0

    @property
    def row_bytes(self) -> int:
        return 8 + 16 * (self.n_variables - 1) if self.is_complex else 8 * self.n_variables

    def kind(self, place: int) -> str:
        return "struct<re:double,im:double>" if self.is_complex and place else "double"

    def start(self, place: int) -> int:
        """Where a variable begins in a row."""
        return 8 + 16 * (place - 1) if self.is_complex and place else 8 * place


def fields(layout: Layout, places: Sequence[int]) -> list[str]:
    return [f"c{p} {layout.kind(p)}" for p in places]


def decode(raw: bytes, layout: Layout, places: Sequence[int]) -> list[pa.Array]:
    """The columns at ``places`` of whole rows; no other column is touched."""
    rows = len(raw) // layout.row_bytes

    def double(at: int) -> pa.Array:
        return pa.array(np.ascontiguousarray(np.ndarray(rows, "<f8", raw, at, (layout.row_bytes,))))

    def column(place: int) -> pa.Array:
        at = layout.start(place)
        return double(at) if layout.kind(place) == "double" else pa.StructArray.from_arrays([double(at), double(at + 8)], ["re", "im"])

    return [column(p) for p in places]


def encode(batch: pa.RecordBatch) -> bytes:
    """Rows of doubles: a struct is its two parts."""
    parts = []
    for column in batch.columns:
        pair = [column.field(0), column.field(1)] if pa.types.is_struct(column.type) else [column]
        parts += [c.to_numpy(zero_copy_only=False) for c in pair]
    return np.column_stack(parts).astype("<f8").tobytes() if parts else b""


def edges(handle, layout: Layout, place: int, start: int, stop: int, low: float, high: float, rising: bool) -> tuple[int, int]:
    """The rows from ``start`` to ``stop`` whose abscissa, sorted there, lies from ``low`` to ``high``: two binary searches of 8 bytes a look."""

    def first(beyond: Callable[[float], bool]) -> int:
        lo, hi = start, stop
        while lo < hi:
            mid = (lo + hi) // 2
            x = float(np.frombuffer(handle.read_at(8, layout.offset + mid * layout.row_bytes + layout.start(place)), "<f8")[0])
            lo, hi = (lo, mid) if beyond(x) else (mid + 1, hi)
        return lo

    if rising:
        return first(lambda x: x >= low), first(lambda x: x > high)
    return first(lambda x: x <= high), first(lambda x: x < low)


class Opened:
    """The file that was read last stays open: jobs of one file follow each other."""

    def __init__(self) -> None:
        self.path, self.handle = "", None

    def of(self, path: str):
        if path != self.path:
            self.close()
            fs, at = file_system(path)
            self.path, self.handle = path, fs.open_input_file(at)
        return self.handle

    def close(self) -> None:
        if self.handle is not None:
            self.handle.close()
        self.path, self.handle = "", None


def read_rows(handle, layout: Layout, places: Sequence[int], start: int, stop: int) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """(first row, rows, columns) of ``BATCH_ROWS`` rows or fewer, read in blocks."""
    step = max(1, BLOCK_BYTES // layout.row_bytes)
    for lo in range(start, stop, step):
        n = min(step, stop - lo)
        raw = handle.read_at(n * layout.row_bytes, layout.offset + lo * layout.row_bytes)
        if len(raw) < n * layout.row_bytes:
            raise ValueError(f"the file ends before row {stop}")
        for at in range(0, n, BATCH_ROWS):
            rows = min(BATCH_ROWS, n - at)
            yield lo + at, rows, decode(raw[at * layout.row_bytes : (at + rows) * layout.row_bytes], layout, places)


def _runs(jobs: list[dict]) -> Iterator[list[dict]]:
    """Jobs in the order of their rows, those that follow each other without a gap together."""
    run: list[dict] = []
    for job in sorted(jobs, key=lambda j: (j["file"], j["start"])):
        if run and (run[-1]["file"], run[-1]["stop"]) != (job["file"], job["start"]):
            yield run
            run = []
        run.append(job)
    if run:
        yield run


def read_jobs(jobs: DataFrame, layout: Layout, places: Sequence[int]) -> DataFrame:
    """file, point_idx, step, step_idx and a column c<place> for each of ``places``, of jobs (file, offset, step, first, start, stop): ``first`` is the step's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Opened()
        for batch in batches:
            for jobs in _runs(batch.to_pylist()):
                own = Layout(layout.n_variables, layout.is_complex, jobs[0]["offset"])
                starts, firsts = (np.array([j[c] for j in jobs], np.int64) for c in ("start", "first"))
                steps = np.array([j["step"] for j in jobs], np.int32)
                for lo, n, columns in read_rows(opened.of(jobs[0]["file"]), own, places, jobs[0]["start"], jobs[-1]["stop"]):
                    rows = np.arange(lo, lo + n)
                    at = np.searchsorted(starts, rows, side="right") - 1
                    named = pa.array([jobs[0]["file"]]).take(pa.array(np.zeros(len(rows), np.int32)))
                    yield pa.RecordBatch.from_arrays([named, pa.array(rows), pa.array(steps[at]), pa.array(rows - firsts[at]), *columns], ["file", "point_idx", "step", "step_idx", *(f"c{p}" for p in places)])
        opened.close()

    return jobs.mapInArrow(run, ", ".join(["file string", "point_idx bigint", "step int", "step_idx bigint", *fields(layout, places)]))


def cut_jobs(ranges: DataFrame, layout: Layout, total_bytes: int) -> DataFrame:
    """Ranges (file, offset, step, first, start, stop) in pieces that a task can read, dealt so that a task's pieces follow each other."""
    step = max(1, RANGE_BYTES // layout.row_bytes)
    pieces = ranges.filter("start < stop").withColumn("at", F.explode(F.expr(f"sequence(start, stop - 1, {step}L)")))
    pieces = pieces.select("file", "offset", "step", "first", F.col("at").alias("start"), F.least(F.col("at") + step, "stop").alias("stop"))
    n = max(1, -(-total_bytes // RANGE_BYTES))
    return pieces.coalesce(1) if n == 1 else pieces.repartitionByRange(n, "file", "start")


def window_ranges(ranges: DataFrame, layout: Layout, place: int, low: float, high: float) -> DataFrame:
    """Ranges narrowed to the rows with ``low`` <= abscissa <= ``high``; ``rising`` and ``falling`` say how a range is sorted, and one that is both stays whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Opened()
        for batch in batches:
            starts, stops = [], []
            for r in batch.to_pylist():
                span = (r["start"], r["stop"])
                if not (r["rising"] and r["falling"]):
                    span = edges(opened.of(r["file"]), Layout(layout.n_variables, layout.is_complex, r["offset"]), place, *span, low, high, not r["falling"])
                starts.append(span[0])
                stops.append(max(span))
            columns = [batch.column(c) for c in ("file", "offset", "step", "first")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], ["file", "offset", "step", "first", "start", "stop"])
        opened.close()

    return ranges.select("file", "offset", "step", "first", "start", "stop", "rising", "falling").mapInArrow(run, "file string, offset bigint, step int, first bigint, start bigint, stop bigint")


# A format of Spark


@dataclass
class Rows(InputPartition):
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, layout: Layout, places: list[int]):
        self.path, self.layout, self.places = path, layout, places

    def partitions(self) -> list[Rows]:
        step = max(1, RANGE_BYTES // self.layout.row_bytes)
        return [Rows(lo, min(lo + step, self.layout.n_points)) for lo in range(0, self.layout.n_points, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        opened = Opened()
        for lo, n, columns in read_rows(opened.of(self.path), self.layout, self.places, partition.start, partition.stop):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + n)), *columns], ["point_idx", *(f"c{p}" for p in self.places)])
        opened.close()


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """Parts of raw rows in a folder, and a manifest of those that Spark commits."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        fs, at = file_system(self.folder)
        fs.create_dir(at, recursive=True)
        name, rows = f"part-{number:08d}-{uuid.uuid4().hex}", 0
        with fs.open_output_stream(f"{at}/{name}") as out:
            for batch in iterator:
                out.write(encode(batch))
                rows += batch.num_rows
        return Part(number, f"{self.folder}/{name}", rows)

    def commit(self, messages: list[Part | None]) -> None:
        fs, at = file_system(self.folder)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/manifest.json") as out:
            out.write(json.dumps([[m.path, m.rows] for m in sorted((m for m in messages if m), key=lambda m: m.number)]).encode())

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m:
                fs, at = file_system(m.path)
                fs.delete_file(at)


class WaveformSource(DataSource):
    """Reads a waveform file: point_idx, and a column c<place> for each variable, or for those whose places ``columns`` names. Writes a folder of parts of raw rows."""

    @classmethod
    def name(cls) -> str:
        return "waveform"

    def _read(self) -> tuple[Layout, list[int]]:
        from tracelake.sources.waveform import read_header

        head = read_header(self.options["path"])
        if head is None:
            raise ValueError(f"not a waveform file: {self.options['path']}")
        wanted = self.options.get("columns")
        known = [p for p, _, _ in head.variables]
        places = known if wanted is None else [int(p) for p in wanted.split(",") if p.strip()]
        if unknown := set(places) - set(known):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        return head.layout, places

    def schema(self) -> str:
        layout, places = self._read()
        return ", ".join(["point_idx bigint", *fields(layout, places)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], *self._read())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


# Joining parts to a file


def _copy(part: str, path: str, to: int, start: int, size: int) -> None:
    fs, at = file_system(part)
    with fs.open_input_file(at) as source, open(file_system(path)[1], "r+b") as out:
        out.seek(to + start)
        for lo in range(start, start + size, BLOCK_BYTES):
            out.write(source.read_at(min(BLOCK_BYTES, start + size - lo), lo))


def join_parts(spark: SparkSession, folder: str, path: str, header: Callable[[int], bytes], row_bytes: int) -> int:
    """The manifest's parts after a header as the file ``path``, which appears whole or not at all; the number of rows."""
    fs, at = file_system(f"{folder}/manifest.json")
    with fs.open_input_stream(at) as f:
        parts = json.loads(f.read())
    n = sum(rows for _, rows in parts)
    head, target = header(n), f"{path}.{uuid.uuid4().hex}"
    fs, at = file_system(target)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    places = (len(head) + row_bytes * np.cumsum([0, *(rows for _, rows in parts)])).tolist()
    if isinstance(fs, pafs.LocalFileSystem):
        with open(at, "wb") as out:
            out.write(head)
            out.truncate(places[-1])
        jobs = [(p, to, lo, min(RANGE_BYTES, rows * row_bytes - lo)) for (p, rows), to in zip(parts, places, strict=False) for lo in range(0, rows * row_bytes, RANGE_BYTES)]

        def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for j in batch.to_pylist():
                    _copy(j["part"], target, j["to"], j["start"], j["size"])
            yield pa.RecordBatch.from_arrays([pa.array([1])], ["done"])

        if jobs:
            spark.createDataFrame(jobs, "part string, to bigint, start bigint, size bigint").repartition(min(len(jobs), 1000)).mapInArrow(copy, "done bigint").count()
    else:

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                attempt = f"{target}.{uuid.uuid4().hex}"
                fs, at = file_system(attempt)
                with fs.open_output_stream(at) as out:
                    out.write(head)
                    for p, _rows in parts:
                        own, place = file_system(p)
                        with own.open_input_stream(place) as source:
                            while block := source.read(BLOCK_BYTES):
                                out.write(block)
                yield pa.RecordBatch.from_arrays([pa.array([attempt])], ["attempt"])

        at = file_system(spark.range(1).coalesce(1).mapInArrow(stream, "attempt string").first()["attempt"])[1]
    fs.move(at, file_system(path)[1])
    fs.delete_dir(file_system(folder)[1])
    return n
