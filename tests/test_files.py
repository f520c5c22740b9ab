"""The file source: which columns and rows are read, many files, and the writer's attempts."""

import json
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.sources import rows as R
from tracelake.sources import shared
from tracelake.sources import waveform as S
from tracelake.sources.rows import Layout, WaveformSource

HEADER = "Title: t\nPlotname: {plot}\nFlags: {flags}\nNo. Variables: {n}\nNo. Points: {points}\nAbscissa: 0 1 {scale}\n{more}Variables:\n{variables}\n"


def make(path, rows, variables, flags="real", scale="lin", plot="Transient Analysis", more=""):
    listed = "\n".join(f"{k}\t{n}\t{t}" for k, (n, t) in enumerate(variables))
    S.write(str(path), HEADER.format(plot=plot, flags=flags, n=len(variables), points=len(rows), scale=scale, variables=listed, more=more), rows, "complex" in flags)
    return str(path)


VARIABLES = [("Time", "time"), ("V(out)", "voltage"), ("V(in)", "voltage"), ("R1", "parameter")]


def decoded(df):
    """The columns that the scan's output has, from the plan."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return {c for line in plan.splitlines() if "MapInArrow" in line for c in ("c0", "c1", "c2", "c3") if f"{c}#" in line.split("MapInArrow")[1].split("],")[0].split(",", 1)[1]}


def test_only_used_columns_are_decoded(spark, tmp_path):
    n = 50
    matrix = np.stack([np.tile(np.arange(n / 2), 2), np.arange(n), np.arange(n) * 3, np.repeat([1.0, 2.0], n // 2)], axis=1).astype(float)
    f = S.load(spark, make(tmp_path / "w.bin", matrix, VARIABLES, "real stepped", more=".alias sum V(out)+V(in)\n.alias twice 2*sum\n"))
    out = f.points.evaluate("V(out)", keep=("point_idx",))
    assert decoded(out) == {"c1"}
    assert [r[1] for r in out.orderBy("point_idx").collect()] == matrix[:, 1].tolist()
    out = f.points.evaluate("twice", keep=("point_idx", "step", "step_idx"))
    assert decoded(out) == {"c1", "c2"}
    assert sorted(map(tuple, out.collect())) == [(k, k // 25, k % 25, 8.0 * k) for k in range(n)]
    assert decoded(f.points.evaluate("V(in)", keep=("x",))) == {"c0", "c2"}
    assert decoded(f.points.evaluate("V(in)@2", keep=("point_idx",))) == {"c2"}
    assert decoded(f.points.with_expression("V(in)*2", "w").evaluate("w+1")) == {"c2"}


def test_format_of_spark(spark, tmp_path, monkeypatch):
    """spark.read.format("waveform"): a schema from the header, wanted columns, a partition for each range of rows."""
    spark.dataSource.register(WaveformSource)
    z = np.array([[1, 2 + 1j, 3], [2, 4 - 1j, 5], [4, 6 + 2j, 7]])
    path = make(tmp_path / "z.bin", z, [("Frequency", "frequency"), ("V(a)", "voltage"), ("V(b)", "voltage")], "complex", "oct")
    df = spark.read.format("waveform").load(path)
    assert df.columns == ["point_idx", "c0", "c1", "c2"]
    assert [tuple(r) for r in df.select("point_idx", "c0", "c1.re", "c1.im").orderBy("point_idx").collect()] == [(0, 1.0, 2.0, 1.0), (1, 2.0, 4.0, -1.0), (2, 4.0, 6.0, 2.0)]
    some = spark.read.format("waveform").option("columns", "2").load(path)
    assert some.columns == ["point_idx", "c2"]
    assert sorted(r[1]["re"] for r in some.collect()) == [3.0, 5.0, 7.0]
    monkeypatch.setattr(R, "RANGE_BYTES", 40)
    reader = R._Reader(path, Layout(3, True, 0, 3), [0])
    assert [(p.start, p.stop) for p in reader.partitions()] == [(0, 1), (1, 2), (2, 3)]
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("waveform").option("columns", "7").load(path).collect()
    with pytest.raises(Exception, match="not a waveform file"):
        spark.read.format("waveform").load(str(tmp_path / "missing")).collect()


def test_evaluated_columns_are_kept(spark, tmp_path):
    """A second evaluation, here in a store of its own as in another session, reads the table: no file is decoded. A changed file has columns of its own."""
    matrix = np.stack([np.arange(20.0), np.arange(20) * 2.0], axis=1)
    path, folder = make(tmp_path / "w.bin", matrix, VARIABLES[:2]), str(tmp_path / "store")
    first = S.load(spark, path).stored_in(folder).points
    first.evaluate("V(out)*3", "Time")
    again = S.load(spark, path).stored_in(folder).points
    out = again.evaluate("3*V(out)/3", keep=("point_idx",))  # another text: made now
    assert sorted(r[1] for r in out.collect()) == matrix[:, 1].tolist()
    out = again.evaluate("V(out)*3", "Time", keep=("point_idx", "step"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("parquet") == 2
    assert out.columns == ["point_idx", "step", "(V(out)*3)", "Time"] and again.compile("V(out)").unit == out.schema["(V(out)*3)"].metadata["unit"] == "V"
    assert sorted(map(tuple, out.collect())) == [(k, 0, 6.0 * k, float(k)) for k in range(20)]
    assert sorted(map(tuple, again.evaluate("Time", keep=("x", "point_idx")).collect())) == [(float(k), k, float(k)) for k in range(20)]
    make(tmp_path / "w.bin", matrix[:10] + 1, VARIABLES[:2])
    changed = S.load(spark, path).stored_in(folder).points
    assert sorted(r[0] for r in changed.evaluate("V(out)*3").collect()) == [6.0 * k + 3 for k in range(10)]
    before = sorted(p.name for p in (tmp_path / "store").iterdir())
    first.store.put("(V(out)*3)", first.store.find("(V(out)*3)"))  # made twice at once: the first stays
    assert sorted(p.name for p in (tmp_path / "store").iterdir()) == before


class Counted:
    def __init__(self, path):
        self.handle, self.bytes = pa.OSFile(path), 0

    def read_at(self, n, at):
        self.bytes += n
        return self.handle.read_at(n, at)


@pytest.mark.parametrize("sign", [1, -1])
def test_narrow_window_reads_little(tmp_path, spark, sign):
    """A hundredth of a long sorted step costs less than 3 % of the file's bytes, rising or falling."""
    n = 40_000
    matrix = np.stack([sign * np.sort(np.random.default_rng(1).random(n)), np.arange(n) * 1.0], axis=1)
    path = make(tmp_path / "w.bin", matrix, VARIABLES[:2])
    head = S.read_header(path)
    handle = Counted(path)
    low, high = sorted((sign * 0.5, sign * 0.51))
    lo, hi = R.edges(handle, head.layout, 0, 0, n, low, high, sign > 0)
    inside = np.flatnonzero((matrix[:, 0] >= low) & (matrix[:, 0] <= high))
    assert (lo, hi) == (inside[0], inside[-1] + 1)
    for _ in R.read_rows(handle, head.layout, [0, 1], lo, hi):
        pass
    assert handle.bytes < 0.03 * n * head.layout.row_bytes
    f = S.load(spark, path)
    out = f.window(sign * 0.5, sign * 0.51).evaluate("V(out)", keep=("point_idx",))
    assert sorted(r[1] for r in out.collect()) == inside.astype(float).tolist()
    ranges = R.window_ranges(f.directions(), head.layout, 0, low, high).collect()
    assert [(r["start"], r["stop"]) for r in ranges] == [(lo, hi)]


def test_windows_of_odd_steps(spark, tmp_path):
    """Steps that rise, fall, turn, hold NaN or are constant; decades; edges beyond all rows; selectors count places of the window's rows."""
    steps = [[1, 2, 3, 4], [4, 3, 2, 1], [1, 3, 2, 4], [1, np.nan, 3, 2], [2, 2, 2, 2]]
    matrix = np.array([[x, 10 * k + i, 0, k] for k, own in enumerate(steps) for i, x in enumerate(own)], float)
    f = S.load(spark, make(tmp_path / "w.bin", matrix[:16], VARIABLES, "real"))
    expected = sorted(r[1] for r in matrix[:16] if 2 <= r[0] <= 3)
    assert sorted(r[0] for r in f.window(2, 3).evaluate("V(out)").collect()) == expected
    for k, own in enumerate(steps):
        g = S.load(spark, make(tmp_path / f"{k}.bin", matrix[4 * k : 4 * k + 4], VARIABLES, "real"))
        for edges in ((2, 3), (3, 2), (-5, 0), (9, 12), (0, 9)):
            want = sorted(10.0 * k + i for i, x in enumerate(own) if min(edges) <= x <= max(edges))
            assert sorted(r[0] for r in g.window(*edges).evaluate("V(out)").collect()) == want, (k, edges)
    decades = np.array([[10.0**k, k, 0, 0] for k in range(8)])
    g = S.load(spark, make(tmp_path / "dec.bin", decades, VARIABLES, "real", "dec"))
    assert sorted(r[0] for r in g.window(2, 5).evaluate("V(out)").collect()) == [2.0, 3.0, 4.0, 5.0]


def test_many_files(spark, tmp_path):
    """Files of two schemas, one without rows, and two that aren't waveform files; steps are numbered in each file."""
    (tmp_path / "below").mkdir()
    rows = lambda k, n: np.array([[i % 3, 100 * k + i, 0, 1 + i // 3] for i in range(n)], float)
    make(tmp_path / "a.bin", rows(1, 6), VARIABLES, "real stepped")
    make(tmp_path / "below" / "b.bin", rows(2, 9), VARIABLES, "real stepped")
    make(tmp_path / "c.bin", rows(3, 4)[:, :2], VARIABLES[:2], more=".alias twice 2*V(out)\n")
    make(tmp_path / "empty.bin", np.zeros((0, 2)), VARIABLES[:2], more=".alias twice 2*V(out)\n")
    (tmp_path / "none.txt").write_text("nothing here")
    (tmp_path / "head.txt").write_text("Title: x\nVariables:\n0\tTime\ttime\n")
    files, groups = S.load_many(spark, str(tmp_path))
    seen = {r["file"].rsplit("/", 1)[1]: (r["n_points"], r["schema"]) for r in files.collect()}
    assert {k: n for k, (n, _) in seen.items()} == {"a.bin": 6, "b.bin": 9, "c.bin": 4, "empty.bin": 0, "none.txt": None, "head.txt": None}
    assert seen["a.bin"][1] == seen["b.bin"][1] != seen["c.bin"][1] == seen["empty.bin"][1]
    assert len(groups) == 2
    both = next(g for g in groups if g.header.stepped)
    assert {(r["file"].rsplit("/", 1)[1], r["step"], r["start"], r["stop"]) for r in both.steps.collect()} == {("a.bin", 0, 0, 3), ("a.bin", 1, 3, 6), ("b.bin", 0, 0, 3), ("b.bin", 1, 3, 6), ("b.bin", 2, 6, 9)}
    out = both.points.evaluate("V(out)@2", keep=("file", "point_idx"))
    assert {(r[0].rsplit("/", 1)[1], r[1], r[2]) for r in out.collect()} == {("a.bin", i, 103.0 + i % 3) for i in range(6)} | {("b.bin", i, 203.0 + i % 3) for i in range(9)}
    assert sorted(r[0] for r in both.window(1, 1).evaluate("V(out)").collect()) == [101.0, 104.0, 201.0, 204.0, 207.0]
    other = next(g for g in groups if not g.header.stepped)
    assert sorted(r[0] for r in other.points.evaluate("twice").collect()) == [600.0, 602.0, 604.0, 606.0]


def test_written_in_order_by_many_tasks(spark, tmp_path, monkeypatch):
    """Ranges of the order are written by tasks of their own; more parts than ranges, and a file that is there is replaced whole."""
    monkeypatch.setattr(R, "RANGE_BYTES", 1 << 10)
    path = str(tmp_path / "out" / "w.bin")
    for n in (1000, 40, 0):
        df = spark.range(n, numPartitions=7).select((n - F.col("id")).cast("double").alias("x"), (F.col("id") * 2).alias("y"))
        header = HEADER.format(plot="p", flags="real", n=2, points="{points}", scale="lin", variables="0\tTime\ttime\n1\tV(a)\tvoltage", more="")
        assert S.write_points(df, path, header, ["x"], ["x", "y"]) == n
        head = S.read_header(path)
        assert head.n_points == n
        data = np.fromfile(path, "<f8", offset=head.offset).reshape(-1, 2)
        np.testing.assert_array_equal(data, [[k, 2.0 * (n - k)] for k in range(1, n + 1)] if n else np.zeros((0, 2)))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["w.bin"]


def test_attempts_that_spark_does_not_commit_are_left_out(tmp_path):
    """Two attempts of a task write files of their own; the manifest has the one whose message Spark commits."""
    writer = R._Writer(f"file://{tmp_path}/parts")
    parts = []
    for number, attempt in ((1, "x"), (0, "y"), (0, "z")):
        name = f"{tmp_path}/parts/part-{number}-{attempt}"
        (tmp_path / "parts").mkdir(exist_ok=True)
        open(name, "wb").write(b"12345678")
        parts.append(R.Part(number, f"file://{name}", 1))
    writer.commit([parts[0], None, parts[2]])
    manifest = json.loads((tmp_path / "parts" / "manifest.json").read_text())
    assert [p.rsplit("-", 1)[1] for p, _ in manifest] == ["z", "x"]
    writer.abort([parts[1], None])
    assert not (tmp_path / "parts" / "part-0-y").exists()


def test_paths_of_the_default_file_system(spark):
    """A folder without a scheme is one of the default file system, which need not be the local one."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "/shared/folder"), sparkContext=spark.sparkContext)
    try:
        conf.set("fs.defaultFS", "hdfs://names:8020")
        assert shared.shared_path(session, "x").startswith("hdfs://names:8020/shared/folder/waveforms/")
        assert shared.qualified(spark, "file:/local/x") == "file:///local/x"
        assert shared.qualified(spark, "s3a://bucket/x") == "s3a://bucket/x"
        conf.set("fs.defaultFS", "file:///")
        assert shared.shared_path(session, "x").startswith("file:///shared/folder/waveforms/")
    finally:
        conf.set("fs.defaultFS", before)


def test_rows_leave_a_task_in_small_batches(tmp_path):
    """A block of rows is given on in small batches: with names and numbers a block of 4 MB would be some 30 MB in each worker."""
    from tracelake.sources import rows as R

    n = 3 * R.BATCH_ROWS + 5
    data = np.arange(2.0 * n).reshape(n, 2)
    data.astype("<f8").tofile(tmp_path / "rows")
    opened = R.Opened()
    found = list(R.read_rows(opened.of(str(tmp_path / "rows")), R.Layout(2, False, 0, n), [1], 2, n))
    opened.close()
    assert max(k for _, k, _ in found) <= R.BATCH_ROWS and [lo for lo, _, _ in found] == [2 + k * R.BATCH_ROWS for k in range(4)]
    assert np.concatenate([c.to_numpy() for _, _, (c,) in found]).tolist() == data[2:, 1].tolist()
