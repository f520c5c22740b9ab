"""Binary waveform files: a text header, then rows of little-endian doubles or, for complex data, a double and complex pairs.

``load`` reads one header on the driver; ``load_many`` reads the headers of a folder in tasks and puts files of equal schemas together. Steps are cut from the abscissa or the parameters alone. An
expression is evaluated over a scan of the variables that it uses: tasks read ranges of rows by seeking, number steps by the step table and decode those columns only. ``WaveformFile.window`` finds
the rows of a window by binary search in the file, so a narrow one reads little else.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import ieee
from tracelake.operators import steps
from tracelake.plans.compiler import Points, Variable
from tracelake.sources.rows import Layout, WaveformSource, cut_jobs, join_parts, read_jobs, window_ranges
from tracelake.sources.shared import file_system, qualified, shared_path, stored

__all__ = ["Header", "WaveformFile", "load", "load_many", "parse_header", "read_header", "shared_path", "write", "write_points"]

# Variable types and their units, and the kinds of abscissa scale.
UNITS = {"frequency": "Hz", "voltage": "V", "current": "A", "time": "s", "power": "W", "parameter": "", "phase": "°"}
SCALES = ("lin", "dec", "oct")
#: Different schemas of files that ``load_many`` takes: each is a plan of its own.
MAX_SCHEMAS = 1000


@dataclass
class Header:
    fields: dict[str, str]
    variables: list[tuple[int, str, str]]  # place on disk, name, type
    aliases: dict[str, str] = field(default_factory=dict)
    functions: list[str] = field(default_factory=list)
    offset: int = 0

    def _flag(self, word: str) -> bool:
        return word in self.fields.get("Flags", "").lower()

    @property
    def is_complex(self) -> bool:
        return self._flag("complex")

    @property
    def stepped(self) -> bool:
        return self._flag("stepped")

    @property
    def n_variables(self) -> int:
        return int(self.fields.get("No. Variables", 0))

    @property
    def n_points(self) -> int:
        return int(self.fields.get("No. Points", 0))

    @property
    def scale(self) -> str:
        parts = self.fields.get("Abscissa", "").split()
        scale = parts[2] if len(parts) > 2 else SCALES[0]
        if scale not in SCALES:
            raise ValueError(f"unknown scale of the abscissa: {scale}")
        return scale

    @property
    def layout(self) -> Layout:
        return Layout(self.n_variables, self.is_complex, self.offset, self.n_points)

    def schema(self) -> str:
        """What files have to share to be one table: variables, kinds of numbers, steps and scale, aliases and functions."""
        return json.dumps([self.n_variables, self.variables, self.is_complex, self.stepped, self.scale, "noise" in self.fields.get("Plotname", "").casefold(), self.aliases, self.functions])


def _lines(handle) -> Iterator[tuple[str, int]]:
    """Lines and where each ends, a block of bytes at a time."""
    rest, at = b"", 0
    while block := handle.read(1 << 16):
        rest += block
        while (cut := rest.find(b"\n")) >= 0:
            at += cut + 1
            yield rest[:cut].decode("cp1252").strip(), at
            rest = rest[cut + 1 :]


def parse_header(handle) -> Header | None:
    """None if no binary part follows the variables."""
    head, listing = Header({}, []), False
    for line, stop in _lines(handle):
        if listing and line == "Binary:":
            head.offset = stop
            return head
        parts = line.split("\t")
        if listing and len(parts) == 3:
            if parts[2] in UNITS:  # variables of other types are skipped, the rest keep their place
                head.variables.append((int(parts[0]), parts[1], parts[2]))
        elif line == "Variables:":
            listing = True
        else:
            key, colon, value = line.partition(":")
            if colon:
                head.fields[key.strip()] = value.strip()
            words = line.split()
            if line.startswith(".alias") and len(words) == 3:
                head.aliases[words[1]] = words[2]
            elif line.startswith(".func"):
                head.functions.append(line)
    return None


def read_header(path: str) -> Header | None:
    """None if there is no file or no binary part."""
    fs, at = file_system(path)
    if fs.get_file_info(at).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(at) as handle:
        return parse_header(handle)


def scaled(x, scale: str):
    """The working abscissa: the logarithm for decades or octaves."""
    return {"lin": lambda c: c, "dec": ieee.log10, "oct": ieee.log2}[scale](x)


def unscaled(x: float, scale: str) -> float:
    if scale == "lin":
        return x
    with np.errstate(over="ignore"):
        return float(np.float64(10.0 if scale == "dec" else 2.0) ** x)


def noise_aliases(plotname: str, names: list[str]) -> list[tuple[str, str]]:
    """For noise runs: (alias, name) of spectra that also answer to their name without the suffix; real names win."""
    if "noise" not in plotname.casefold():
        return []
    taken, out = {n.casefold() for n in names}, []
    for name in names:
        if name.casefold().endswith("_spectrum)"):
            alias = name[: -len("_spectrum)")] + ")"
            if alias.casefold() not in taken:
                taken.add(alias.casefold())
                out.append((alias, name))
    return out


@dataclass
class WaveformFile:
    """A file, or with ``files`` (a row for each) all files of one schema: then ``header`` is that of one of them, and ``file`` is a key of points and steps."""

    header: Header
    points: Points
    steps: DataFrame
    x_name: str
    failed: list[str]
    ranges: DataFrame
    size: int
    files: DataFrame | None = None
    _sorted: DataFrame | None = field(default=None, repr=False)

    @property
    def title(self) -> str:
        return self.header.fields.get("Title", "")

    @property
    def plotname(self) -> str:
        return self.header.fields.get("Plotname", "")

    def stored_in(self, folder: str) -> WaveformFile:
        """The file with a folder in which evaluated columns are kept. A file of another size, number of points or time of change has columns of its own."""
        info = [] if self.files is not None else [file_system(p)[0].get_file_info(file_system(p)[1]) for p in [self.ranges.first()["file"]]]
        identity = json.dumps([self.header.schema(), self.header.n_points, *[[i.path, i.size, str(i.mtime)] for i in info]])
        if self.files is not None:
            raise ValueError("columns of many files need an identity: use points.stored_in")
        return replace(self, points=self.points.stored_in(folder, identity, ("point_idx", "step", "step_idx")))

    def directions(self) -> DataFrame:
        """The ranges of rows with what x does in each: ``rising`` if it ever grows, ``falling`` if it ever shrinks or isn't a number. Computed once, from the abscissa alone."""
        if self._sorted is None:
            x = f"c{self.header.variables[0][0]}"
            scan = _scan(self.ranges, self.header, self.size, frozenset([x]))
            past = steps.with_previous(scan, {"__x": x}, ["file"])
            inside, odd = F.col("step_idx") > 0, F.isnan(x)
            moves = past.groupBy("file", "step").agg(F.max(inside & (F.col(x) > F.col("__x"))).alias("rising"), F.max(inside & (F.col(x) < F.col("__x")) | odd).alias("falling"), F.max(odd).alias("odd"))
            moves = moves.select("file", "step", (F.col("rising") | F.col("odd")).alias("rising"), "falling")
            self._sorted = stored(self.ranges.join(moves, ["file", "step"]), "directions")
        return self._sorted

    def window(self, left: float, right: float) -> Points:
        """The points whose x (the working abscissa) lies between the edges, in any order. Sorted steps are searched in the file, so other rows of theirs aren't read."""
        scale, (place, _, _) = self.header.scale, self.header.variables[0]
        low, high = sorted((left, right))
        # The edges in the file's own numbers may be off by rounding: a bit more is read, and the rows are judged by x.
        around = [unscaled(v, scale) for v in (low, high)]
        around = around[0] - 1e-9 * abs(around[0]), around[1] + 1e-9 * abs(around[1])
        found = window_ranges(self.directions(), self.header.layout, place, *around)

        def scan(columns: frozenset[str]) -> DataFrame:
            read = _scan(found, self.header, self.size, columns | {f"c{place}"})
            return read.filter(F.col("x").between(low, high))

        return replace(self.points, store=None).over(scan)


def _scan(ranges: DataFrame, head: Header, size: int, columns: frozenset[str]) -> DataFrame:
    """Rows of ``ranges`` with the wanted columns alone; x and x_raw come with the abscissa."""
    first = head.variables[0][0]
    places = [p for p, _, _ in head.variables if f"c{p}" in columns or p == first and columns & {"x", "x_raw"}]
    df = read_jobs(cut_jobs(ranges, head.layout, size), head.layout, places)
    if first in places:
        df = df.withColumn("x_raw", F.col(f"c{first}")).withColumn("x", scaled(F.col(f"c{first}"), head.scale))
    return df


def _opened(files: DataFrame, head: Header, size: int, keys: list[str]) -> WaveformFile:
    """The files (file, offset, n_points) of one schema, cut into steps."""
    whole = files.select("file", "offset", F.lit(0).alias("step"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("start"), F.col("n_points").alias("stop"))
    first = head.variables[0]
    variables = [Variable(name, f"c{p}", UNITS[kind], kind, head.is_complex and p > 0) for p, name, kind in head.variables]
    params = {v.name: v.column for v in variables if v.kind == "parameter"} if head.stepped else {}
    plain = {n: f"{c}.re" if head.is_complex and c != "c0" else c for n, c in params.items()}
    scan = _scan(whole, head, size, frozenset([f"c{first[0]}", *params.values()]))
    if head.stepped:
        _, table = steps.segment(scan.drop("step", "step_idx"), params=plain, stepped=True, keys=["file"])
        table = stored(table, "steps")
        ranges = table.join(files.select("file", "offset"), "file").select("file", "offset", "step", F.col("start").alias("first"), "start", "stop")
        n_steps = table.agg(F.max("step")).first()[0] or 0
    else:
        ranges, n_steps = whole, 0
        table = steps.describe(scan, {}, ["file"])
    table = table if keys else table.drop("file")
    narrow = lambda columns: _scan(ranges, head, size, columns) if keys else _scan(ranges, head, size, columns).drop("file")
    everything = frozenset(["x", *(v.column for v in variables)])
    points = Points.of(narrow(everything), variables, head.functions, keys=tuple(keys), n_steps=n_steps + 1 if n_steps else None, scan=narrow)
    for alias, name in noise_aliases(head.fields.get("Plotname", ""), [v.name for v in variables]):
        points = points.with_expression(name, alias) if name.casefold() not in points.variables else _named(points, alias, name)
    failed = []
    for alias, text in head.aliases.items():
        try:
            points = points.with_expression(text, alias)
        except ValueError:
            failed.append(alias)
    return WaveformFile(head, points, table, first[1], failed, ranges, size)


def load(spark: SparkSession, path: str) -> WaveformFile | None:
    """The file's points cut into steps, with its variables, functions and aliases; None if there is no file or no binary part.

    Aliases are evaluated in their order; those that fail are listed in ``failed``. The format "waveform" is registered for ``spark.read``.
    """
    spark.dataSource.register(WaveformSource)
    path = qualified(spark, path)
    head = read_header(path)
    if head is None:
        return None
    one = spark.createDataFrame([(path, head.offset, head.n_points)], "file string, offset bigint, n_points bigint")
    return _opened(one, head, head.n_points * head.layout.row_bytes, [])


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch.column("file").to_pylist():
            head = read_header(path)
            if head is None or not head.variables:
                rows.append({"file": path})
                continue
            text = head.schema()
            own = {"offset": head.offset, "n_points": head.n_points, "row_bytes": head.layout.row_bytes, "schema": hashlib.sha256(text.encode()).hexdigest(), "header": json.dumps(asdict(head))}
            rows.append({"file": path, "title": head.fields.get("Title", ""), "plotname": head.fields.get("Plotname", "")} | own)
        kinds = pa.schema([("file", pa.string()), ("title", pa.string()), ("plotname", pa.string()), ("offset", pa.int64()), ("n_points", pa.int64()), ("row_bytes", pa.int64()), ("schema", pa.string()), ("header", pa.string())])
        yield pa.RecordBatch.from_pylist(rows, kinds)


def load_many(spark: SparkSession, folder: str) -> tuple[DataFrame, list[WaveformFile]]:
    """(files, groups): a row for each file of the folder and those below it, and the points and steps of all files of each schema, with ``file`` as their key.

    Headers are parsed in tasks; ``files`` has file, title, plotname, offset, n_points, row_bytes and schema, all NULL but the file where it isn't a waveform file. Steps are cut for each file.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(qualified(spark, folder)).select(F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("file"))
    found = stored(listed.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_headers, "file string, title string, plotname string, offset bigint, n_points bigint, row_bytes bigint, schema string, header string"), "files")
    sizes = found.filter("schema IS NOT NULL").groupBy("schema").agg(F.min_by("header", "file").alias("header"), F.sum(F.col("n_points") * F.col("row_bytes")).alias("size"))
    schemas = sizes.orderBy("schema").limit(MAX_SCHEMAS + 1).collect()
    if len(schemas) > MAX_SCHEMAS:
        raise ValueError(f"the files have more than {MAX_SCHEMAS} different schemas")
    groups = []
    for row in schemas:
        values = json.loads(row["header"])
        head = Header(**values | {"variables": [tuple(v) for v in values["variables"]]})
        own = found.filter(F.col("schema") == row["schema"]).drop("header")
        groups.append(replace(_opened(own, head, row["size"], ["file"]), files=own))
    return found.drop("header"), groups


def _named(points: Points, alias: str, name: str) -> Points:
    v = points.variables[name.casefold()]
    return replace(points, variables=points.variables | {alias.casefold(): replace(v, name=alias)})


def write_points(df: DataFrame, path: str, header: str, order: list[str], columns: list[str], is_complex: bool = False) -> int:
    """Writes ``columns`` of ``df`` by ``order`` as one file and returns the number of points: ranges of the order are sorted and written by tasks, and the parts are joined by tasks.

    ``{points}`` in the header becomes this number. The first column is real; in a complex file all others are structs of re and im.
    """
    spark = df.sparkSession
    spark.dataSource.register(WaveformSource)
    kinds, path = dict(df.dtypes), qualified(spark, path)
    double = lambda c: F.col(f"`{c}`") if kinds[c].startswith("struct") else F.col(f"`{c}`").cast("double").alias(c)
    parts = f"{path}.parts"
    df.orderBy(*order).select(*[double(c) for c in columns]).write.format("waveform").mode("append").save(parts)
    layout = Layout(len(columns), is_complex)
    return join_parts(spark, parts, path, lambda n: header.format(points=n).encode("cp1252") + b"Binary:\n", layout.row_bytes)


def write(path: str, header: str, rows: np.ndarray, is_complex: bool = False) -> None:
    """A file with this header, for tests: ``rows`` is a float matrix, or a complex one whose first column is real."""
    with open(path, "wb") as f:
        f.write(header.encode("cp1252") + b"Binary:\n")
        if is_complex:
            for r in rows:
                f.write(np.float64(r[0].real).tobytes() + np.asarray(r[1:], "<c16").tobytes())
        else:
            f.write(np.ascontiguousarray(rows, "<f8").tobytes())
