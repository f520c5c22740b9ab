"""Steps, slices, decimation, spectra, files and charts against independent array formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import decimate as D
from tracelake.operators import smith, spectral, steps
from tracelake.operators import windowing as W
from tracelake.plans.charts import chart_type, fft_signals, suggestions
from tracelake.plans.compiler import Points, Variable
from tracelake.sources import rows as R
from tracelake.sources import waveform as S


def series(spark, x, y, step=0):
    return spark.createDataFrame([(step, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "step int, step_idx bigint, x double, y double")


def cut(spark, x, params=None, stepped=True, chunk=3):
    names = list(params or {})
    rows = [(k, float(v), *(float(params[n][k]) for n in names)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(["point_idx bigint", "x double", *(f"`{n}` double" for n in names)]))
    points, table = steps.segment(df, {n: f"`{n}`" for n in names}, stepped, chunk=chunk)
    found = [(r["step"], r["step_idx"]) for r in points.orderBy("point_idx").collect()]
    return found, table.orderBy("step").collect()


def test_steps(spark):
    found, table = cut(spark, [10, 20, 30, 10, 20, 30])
    assert found == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]
    assert [(r["start"], r["stop"], r["x_first"], r["x_last"]) for r in table] == [(0, 3, 10, 30), (3, 6, 10, 30)]
    assert len(cut(spark, [1, 2, 3, 3, 2, 1])[1]) == 1
    assert len(cut(spark, [10, 20, 30, 10, 20])[1]) == 1  # unequal lengths
    assert len(cut(spark, [30, 20, 10, 30, 20, 10])[1]) == 2
    assert len(cut(spark, [10, 20, 10, 20], stepped=False)[1]) == 1
    _, table = cut(spark, [1, 2, 3, 1, 2, 3], {"R1": [1, 1, 1, 2, 2, 2]})
    assert [r["params"] for r in table] == [{"R1": 1.0}, {"R1": 2.0}]
    _, table = cut(spark, [1, 2, 3, 3, 2, 1], {"R1": [1, 1, 1, 2, 2, 2]})
    assert [(r["start"], r["stop"], r["params"]) for r in table] == [(0, 6, {})]
    nan = float("nan")
    assert len(cut(spark, [1, 2, 1, 2], {"R1": [nan, nan, 1, 1]})[1]) == 3


def test_extent(spark):
    table = cut(spark, [10, 20, 30, 9, 100, 998, 11, 501, 1001], {"p": [1, 1, 1, 2, 2, 2, 3, 3, 3]})[1]
    df = spark.createDataFrame([(r["step"], r["x_first"], r["x_last"]) for r in table], "step int, x_first double, x_last double")
    assert tuple(steps.extent(df).first()) == (True, 9.0, 1001.0)
    assert steps.select_steps(df, {1}).count() == 1 and steps.select_steps(df, {1}, True).count() == 2 and steps.select_steps(df).count() == 3
    assert steps.step_table(spark.createDataFrame([(0, {"R": 1.0})], "step int, params map<string,double>")).first()["values"] == {"R": "1.0"}


def test_windowing(spark):
    df = series(spark, np.linspace(0, 10, 11), np.arange(11))
    assert W.zoom(df, 2, 4).count() == 3 and W.zoom(df, 4, 2, ascending=False).count() == 3 and W.zoom(df, 20, 30).count() == 0
    for at, value in ((5.0, 5.0), (-1, 0.0), (99, 10.0), (4.5, 4.0)):
        assert W.nearest(df, at, ["step"]).first()["value"] == value
    nan, inf = float("nan"), float("inf")
    odd = series(spark, range(4), [1, nan, inf, -inf])
    assert W.finite(odd).count() == 2
    assert all(np.isnan(v) for v in W.min_max(W.finite(odd), ["step"]).first()[1:])
    r = W.auto_range(spark.createDataFrame([("V", 0.0, 10.0), ("V", 5.0, 100.0)], "unit string, y_min double, y_max double")).first()
    assert (r["low"], r["high"]) == (-3.0, 103.0)
    view = W.View().zoomed((0.75, 0.25)).zoomed((0.5, 1.0), (0, 0.5))
    assert view.x == (0.5, 0.75) and view.y == (0.0, 0.5) and view.bounds(0, 100) == (50, 75) and view.reset(y=False).x == (0, 1)
    linked = W.link([W.View(), W.View()], 0, (0, 0.5), (0, 0.5))
    assert linked[1] == W.View((0.0, 0.5)) and linked[0].y == (0.0, 0.5)
    assert W.ticks(0, 10)[3] == 3 and W.ticks(0.5, 3.2, "dec") == [1.0, 2.0, 3.0]
    assert W.axes(list("abcdea")) == {"a": 0, "b": 1, "c": 2, "d": 3, "e": None}
    assert (W.draw_target(), W.draw_target(100, 7.5), W.draw_target(100)) == (9600, 700, 500)
    texts = [r[0] for r in spark.createDataFrame([(v,) for v in (1234.5, -2e6, 0.0, 5e-16, 3.2e-7, 1.0, 4.5e-3, 7e9)], "v double").select(W.si_text(F.col("v"), F.lit("V"))).collect()]
    assert texts == ["1.23 kV", "-2.00 MV", "0 V", "0 V", "320.00 nV", "1.00 V", "4.50 mV", "7.00 GV"]
    assert spark.range(1).select(W.si_list(F.lit("y"), F.array(F.lit(1.0), F.lit(2e3)), F.lit("A"))).first()[0] == "y = [1.00 A, 2.00 kA]"


def brute(y, target, ends):
    n, parts = len(y), max(1, target // (4 if ends else 2))
    size = -(-n // parts)
    keep = set()
    for b in range(n // size):
        part = y[b * size : (b + 1) * size]
        keep |= {b * size + int(np.argmin(part)), b * size + int(np.argmax(part))} | ({b * size, b * size + size - 1} if ends else set())
    return sorted(keep)


@pytest.mark.parametrize(("method", "ends"), [("m4", True), ("min_max", False)])
@pytest.mark.parametrize(("n", "target"), [(1000, 100), (1009, 100), (11, 8), (50, 4), (300, 17)])
def test_buckets(spark, method, ends, n, target):
    rng = np.random.default_rng(n)
    y = np.round(rng.normal(size=n), 1)
    y[n // 3] = np.nan
    out = D.decimate(series(spark, np.arange(n), y), target, method)
    assert sorted(r["step_idx"] for r in out.collect()) == brute(y, target, ends)


@pytest.mark.parametrize(("n", "target"), [(1000, 100), (17, 16), (5, 1), (9, 2), (7, 7), (100, 99)])
def test_nth_and_average(spark, n, target):
    df = series(spark, np.arange(n) * 2.0, np.sin(np.arange(n)))
    got = sorted(r["step_idx"] for r in D.decimate(df, target, "nth").collect())
    assert got == (list(range(n)) if n <= target else np.unique(np.linspace(0, n - 1, target, dtype=np.int64)).tolist())
    means = [r["y"] for r in D.decimate(df, target, "average").orderBy("step_idx").collect()]
    size = 1 if n <= target else -(-n // target)
    np.testing.assert_allclose(means, np.sin(np.arange(n // size * size)).reshape(-1, size).mean(axis=1))


def test_small_targets(spark):
    df = series(spark, range(10), [3, 1, 4, 1, 5, 9, 2, 6, 5, 3])
    for method in ("m4", "min_max", "lttb", "rdp"):
        assert sorted(r["step_idx"] for r in D.decimate(df, 1, method).collect()) == [0]
        assert sorted(r["step_idx"] for r in D.decimate(df, 2, method).collect()) == [0, 9]
        assert D.decimate(df, 10, method).count() == 10
    assert sorted(r["step_idx"] for r in D.decimate(df, 3, "m4").collect()) == [0, 1, 9]
    with pytest.raises(ValueError):
        D.decimate(df, 0)
    with pytest.raises(ValueError):
        D.decimate(df, 5, "best")
    assert D.decimate(df, 0, "none").count() == 10
    assert D.decimate(df.limit(0), 4).count() == 0


def test_simplification_level_by_level(spark):
    """The same rows as in one task: walks, plateaus with equal distances, closed lines, NaN-free constants, and a series that stays whole."""
    rng = np.random.default_rng(4)
    lines = [np.cumsum(rng.normal(size=300)), np.sign(np.sin(np.arange(200) / 7)), np.zeros(50), rng.normal(size=9), np.concatenate([np.arange(60.0), np.arange(60.0)[::-1]])]
    df = series(spark, np.arange(300.0), lines[0])
    for k, y in enumerate(lines[1:], 1):
        df = df.unionByName(series(spark, np.arange(len(y)) * 1.0, y, k))
    for target in (3, 10, 40):
        once, rounds = ({tuple(r) for r in D.decimate(df, target, "rdp", task_rows=n).collect()} for n in (1 << 22, 100))
        assert once == rounds
        assert D.decimate(df, target, "rdp", task_rows=0).count() == len(once)
    one = df.filter("step = 0").drop("step")
    assert {tuple(r) for r in D.decimate(one, 10, "rdp", by=[], task_rows=0).collect()} == {tuple(r)[1:] for r in D.decimate(df, 10, "rdp").filter("step = 0").collect()}


def test_simplification():
    x = np.arange(200.0)
    y = np.where(x < 100, 0.0, 50.0) + np.sin(x) * 0.01
    kept = D.rdp(x, y, 8)
    assert {0, 99, 100, 199} <= set(kept.tolist()) and len(kept) <= 8

    def keep(eps, a, b):
        if b - a < 2:
            return set()
        u, v = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        d = np.abs(u * (y[b] - y[a]) - v * (x[b] - x[a])) / np.hypot(x[b] - x[a], y[b] - y[a])
        k = a + 1 + int(np.argmax(d))
        return {k} | keep(eps, a, k) | keep(eps, k, b) if d.max() > eps else set()

    line = np.abs((x - x[0]) * (y[-1] - y[0]) - (y - y[0]) * (x[-1] - x[0])) / np.hypot(x[-1] - x[0], y[-1] - y[0])
    low, high = 0.0, line.max()
    for _ in range(24):
        middle = (low + high) / 2
        low, high = (middle, high) if 2 + len(keep(middle, 0, 199)) > 8 else (low, middle)
    assert set(kept.tolist()) == {0, 199} | keep(high, 0, 199)


def test_largest_triangles():
    x = np.logspace(1, 6, 10_000)
    y = np.sin(np.log10(x) * 9)
    kept = D.lttb(x, y, 100)
    assert len(kept) == 100 and kept[0] == 0 and kept[-1] == 9999 and (np.diff(kept) > 0).all()
    size = (len(x) - 2) / 98
    assert kept[-2] == int(97 * size) + 1  # the last inner bucket has no next one
    edge = lambda k: min(int(k * size) + 1, len(x) - 1)
    for k in range(97):
        lo, hi, after = edge(k), edge(k + 1), edge(k + 2)
        area = [abs((x[kept[k]] - x[hi:after].mean()) * (y[i] - y[kept[k]]) - (x[kept[k]] - x[i]) * (y[hi:after].mean() - y[kept[k]])) for i in range(lo, hi)]
        assert kept[k + 1] == lo + int(np.argmax(area))


@pytest.mark.parametrize("window", list(spectral.WINDOWS))
def test_single_tone(window):
    n = 1024
    t = np.arange(n) / n
    freq, out = spectral.spectrum(t, np.sin(2 * np.pi * 100 * t), window)
    assert freq[100] == pytest.approx(100) and out[0][100] == pytest.approx(1, abs=0.01)
    np.testing.assert_allclose(spectral.window(window, 9), {"rectangular": np.ones, "hamming": np.hamming, "hanning": np.hanning, "blackman": np.blackman}[window](9), atol=1e-15)


def test_spectra(spark):
    n = 4096
    t = np.arange(n) / 8192
    two = np.sin(2 * np.pi * 300 * t) + 0.5 * np.sin(2 * np.pi * 1200 * t)
    _, out = spectral.spectrum(t, two)
    assert out[0][150] == pytest.approx(1, abs=0.02) and out[0][600] == pytest.approx(0.5, abs=0.02)
    assert spectral.spectrum(t, two, output="db", normalise=True)[1].max() == pytest.approx(0)
    assert spectral.spectrum(t, two + 5, keep_dc=True, name="rectangular")[1][0][0] == pytest.approx(5, abs=1e-6)
    nyquist = spectral.spectrum(np.arange(8.0), np.array([1.0, -1] * 4), "rectangular")[1][0]
    assert nyquist[-1] == pytest.approx(1)
    for x, y, name in ((np.arange(1.0), np.ones(1), "hanning"), (np.arange(2.0), np.ones(2), "hanning"), (np.zeros(4), np.ones(4), "hanning"), (np.arange(3.0), np.ones(4), "hanning")):
        with pytest.raises(ValueError):
            spectral.spectrum(x, y, name)
    assert spectral.is_uniform(np.arange(5.0)) and not spectral.is_uniform(np.array([0, 1, 3.0])) and spectral.is_uniform(np.array([1.0]))
    df = series(spark, t[:256], two[:256]).unionByName(series(spark, [0.0], [1.0], 1))
    out = spectral.fft(df, ["y"], right=float(t[127]))
    assert out.count() == 65 and out.select("step").distinct().count() == 1
    assert spectral.fft_options("nope", "power of two", "x") == {"name": "rectangular", "pad": True, "output": "magnitude"}
    assert (spectral.fft_unit("phase", "V"), spectral.fft_unit("magnitude", "V"), spectral.fft_name("V(a, b)")) == ("°", "V", "FFT(V(a,b))")
    even = {r["step"]: r["uniform"] for r in spectral.uniform(series(spark, [0, 1, 2], [0, 0, 0]).unionByName(series(spark, [0, 1, 3], [0, 0, 0], 1)).unionByName(series(spark, [4], [0], 2)), ["step"]).collect()}
    assert even == {0: True, 1: False, 2: True}
    grid = spectral.resample(series(spark, [0, 1, 3], [0, 10, 30]), ["step"], 4).orderBy("step_idx").collect()
    assert [r["y"] for r in grid] == [0, 10, 20, 30]
    r = spectral.frequency_preview(series(spark, [0, 0.5, 1.0], [0, 0, 0]), ["step"]).first()
    assert (r["df"], r["nyquist"]) == (2 / 3, 1.0)


@pytest.mark.parametrize("options", [{"output": "db", "name": "hamming"}, {"output": "phase", "keep_dc": True}, {"normalise": True, "name": "blackman", "pad": True}])
def test_spectra_in_parts(spark, options):
    random = np.random.default_rng(3)
    n, parts = 60, 4
    rows = []
    for step, (jitter, rows_of) in enumerate(((0, n), (0.3, n), (0, n), (0, 1))):
        x = np.arange(rows_of) + (jitter * random.random(rows_of) if jitter else 0)
        rows += [(step, k, float(v), *map(float, random.normal(size=2) + 3)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "step int, step_idx bigint, x double, a double, `b c` double")
    whole = spectral.fft(df, ["a", "b c"], **options).orderBy("step", "bin").collect()
    split = spectral.fft_in_parts(df, ["a", "b c"], parts, **options).orderBy("step", "bin").collect()
    assert [r[:2] for r in whole] == [r[:2] for r in split] and {r["step"] for r in whole} == {0, 1, 2}
    for r, s in zip(whole, split, strict=True):
        off = np.abs(np.array(r[2:]) - np.array(s[2:]))
        if options.get("output") == "phase":
            off[1:] = np.minimum(off[1:], np.abs(360 - off[1:]))
        assert off.max() < 1e-7, (r, s)


def test_range_in_parts(spark):
    df = series(spark, range(40), np.random.default_rng(4).normal(size=40))
    expected = [r[1:] for r in spectral.fft(df, ["y"], left=10, right=30).orderBy("bin").collect()]
    found = [r[1:] for r in spectral.fft_in_parts(df, ["y"], 7, left=10, right=30).orderBy("bin").collect()]
    assert len(found) == 11 and np.allclose(expected, found)
    padded = [r[1:] for r in spectral.fft(df, ["y"], pad=True).orderBy("bin").collect()]
    assert np.allclose(padded, [r[1:] for r in spectral.fft_in_parts(df, ["y"], 64, pad=True).orderBy("bin").collect()])  # more parts than samples


def test_parts_that_do_not_fit(spark):
    df = series(spark, range(10), range(10))
    with pytest.raises(Exception, match="3 parts don't divide"):
        spectral.fft_in_parts(df, ["y"], 3).collect()
    with pytest.raises(Exception, match="x must rise"):
        spectral.fft_in_parts(series(spark, range(10, 0, -1), range(10)), ["y"], 2).collect()
    assert spectral.fft_in_parts(df.filter("step = 7"), ["y"], 2).count() == 0


@pytest.mark.parametrize("n", [None, 1, 2, 40])
def test_resampled_in_parts(spark, n):
    """Chunks of few points and spans in blocks give what arrays give: repeated x, one wide span, one point, a missing value, series apart and as one."""
    rng = np.random.default_rng(11)
    xs = [np.sort(np.round(rng.uniform(0, 9, 30), 1)), np.append(np.arange(20) * 1e-3, 50.0), np.array([4.0]), np.array([2.0, 2.0, 2.0]), np.arange(25) * 0.1 - 1]
    ys = [rng.normal(size=len(x)) for x in xs]
    ys[4][7] = np.inf
    df = None
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        df = series(spark, x, y, k) if df is None else df.unionByName(series(spark, x, y, k))
    found = {}
    for r in spectral.resample(df, ["step"], n, chunk=4, block=3).orderBy("step", "step_idx").collect():
        found.setdefault(r["step"], []).append((r["step_idx"], r["x"], r["y"]))
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        grid = np.linspace(x[0], x[-1], n or len(x))
        at, gx, gy = (np.array(c) for c in zip(*found[k], strict=True))
        assert at.tolist() == list(range(len(grid)))
        np.testing.assert_allclose(gx, grid, rtol=1e-14, atol=1e-14)
        near = np.interp(gx, x, y)
        ok = np.isfinite(near) & np.isfinite(gy)
        np.testing.assert_allclose(gy[ok], near[ok], rtol=1e-12, atol=1e-12)
        assert ok.sum() >= len(grid) - 4
    alone = spectral.resample(df.filter("step = 1").drop("step"), [], n, chunk=4).orderBy("step_idx").collect()
    assert [(r["step_idx"], r["x"], r["y"]) for r in alone] == found[1]
    missing = series(spark, [0, 1, 2], [0, 1, 2]).withColumn("y", F.when(F.col("step_idx") != 1, F.col("y")))
    assert np.isnan([r["y"] for r in spectral.resample(missing, ["step"]).collect()]).sum() == 1
    assert spectral.resample(missing.filter("false"), ["step"], n).count() == 0


def test_distortion(spark):
    n, fs = 2048, 8192
    t = np.arange(n) / fs

    def run(y, pad=False, **more):
        s = spectral.fft(series(spark, t, y), ["y"], pad=pad).withColumnRenamed("y", "value")
        return spectral.thd(s, ["step"], **more).first()["thd"]

    tone = lambda f, a: a * np.sin(2 * np.pi * f * t)
    assert run(tone(124, 1) + tone(248, 0.1), harmonics=2) == pytest.approx(0.1, abs=0.005)
    assert run(tone(48, 1) + tone(96, 0.2) + tone(144, 0.05)) == pytest.approx(np.hypot(0.2, 0.05), abs=0.01)
    assert run(tone(48, 1) + tone(96, 0.2), fundamental=49.0) == pytest.approx(0.2, abs=0.01)
    with pytest.raises(Exception, match="positive"):
        run(np.zeros(n))


def test_smith(spark):
    rows = [(0, 0, (0.5, 0.5)), (0, 1, (float("nan"), 0.0)), (0, 2, (float("inf"), 0.0)), (0, 3, (-1.0, 0.0))]
    df = spark.createDataFrame(rows, "step int, step_idx bigint, z struct<re:double,im:double>")
    out = smith.pixels(smith.project(df, "z"), 100, 100, 50).orderBy("step_idx").collect()
    assert [(r["px"], r["py"]) for r in out] == [(125, 75), (50, 100)]
    assert smith.trace(df, "z", 100, 100, 50).count() == 2
    assert smith.grid(spark).count() == 16
    assert smith.eligible(Variable("S11(x)", "c", "", "parameter")) and not smith.eligible(Variable("S21", "c", "", "parameter"))


HEADER = """Title: t
Date: today
Plotname: {plot}
Flags: {flags}
No. Variables: {n}
No. Points: {points}
Abscissa: 0 1 {scale}
Command: x
Plot Suggestion(s): «tran V(out) V(in) V(out)» «V(nothing)»
.alias sum V(out)+V(in)
.alias spaced V(out) + V(in)
.alias wrong nothing+1
.func half(x) {{x/2}}
.func broken(
Variables:
{variables}
"""


def make(tmp_path, rows, variables, flags="real", scale="lin", plot="Transient Analysis"):
    path = str(tmp_path / "w.bin")
    listed = "\n".join(f"{k}\t{n}\t{t}" for k, (n, t) in enumerate(variables))
    S.write(path, HEADER.format(plot=plot, flags=flags, n=len(variables), points=len(rows), scale=scale, variables=listed), rows, "complex" in flags)
    return path


def test_real_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "RANGE_BYTES", 96)
    x = np.tile(np.arange(5.0), 2)
    rows = np.stack([x, x * 2, x * 0 + 9, x + 1, np.repeat([1.0, 2.0], 5)], axis=1)
    path = make(tmp_path, rows, [("Time", "time"), ("V(out)", "voltage"), ("odd", "strange"), ("V(in)", "voltage"), ("R1", "parameter")], "real stepped")
    f = S.load(spark, path)
    assert (f.title, f.plotname, f.x_name, f.failed) == ("t", "Transient Analysis", "Time", ["wrong"])
    assert [v.name for v in f.points.variables.values()] == ["Time", "V(out)", "V(in)", "R1", "sum"]
    assert [r["params"] for r in f.steps.orderBy("step").collect()] == [{"R1": 1.0}, {"R1": 2.0}]
    out = f.points.evaluate("half(sum)", "V(out)@2", keep=("point_idx", "step")).toDF("i", "step", "v", "w").orderBy("i").collect()
    np.testing.assert_allclose([r["v"] for r in out], (rows[:, 1] + rows[:, 3]) / 2)
    assert [r["w"] for r in out] == list(rows[5:, 1]) * 2
    assert [(s.chart, s.expressions) for s in suggestions(f.header.fields["Plot Suggestion(s)"], f.points, "s")] == [("TRANSIENT", ("V(out)", "V(in)")), ("TRANSIENT", ())]
    assert [v.name for v in fft_signals(f.points, "Time")] == ["V(out)", "V(in)", "R1", "sum"]
    assert (chart_type("Hz"), chart_type("s"), chart_type("V"), chart_type("s", "FFT")) == ("AC", "TRANSIENT", "DC", "FFT")
    assert S.load(spark, str(tmp_path / "missing")) is None
    (tmp_path / "none").write_text("Title: x\nVariables:\n0\ta\ttime\n")
    assert S.load(spark, str(tmp_path / "none")) is None


def test_complex_file(spark, tmp_path):
    freq = np.array([1.0, 10, 100])
    rows = np.stack([freq + 0j, freq * (1 + 2j), freq * 3j], axis=1)
    path = make(tmp_path, rows, [("Frequency", "frequency"), ("V(onoise_spectrum)", "voltage"), ("V(in)", "voltage")], "complex", "dec", "Noise Spectral Density")
    f = S.load(spark, path)
    out = f.points.df.orderBy("point_idx").collect()
    assert [r["x"] for r in out] == [0, 1, 2] and [r["x_raw"] for r in out] == [1, 10, 100]
    v = f.points.evaluate("V(onoise)/V(in)", "abs(V(in))", keep=("point_idx",)).toDF("i", "v", "a").orderBy("i").collect()
    assert all(complex(r["v"]["re"], r["v"]["im"]) == pytest.approx((1 + 2j) / 3j) for r in v) and [r["a"] for r in v] == [3, 30, 300]
    assert S.noise_aliases("noise", ["a_spectrum)", "a)"]) == [] and S.unscaled(2, "dec") == 100 and S.unscaled(3, "oct") == 8
    with pytest.raises(ValueError):
        _ = S.Header({"Abscissa": "0 1 log"}, []).scale
    assert Points.of(f.points.df, []).search() == []


def test_spectrum_of_a_file_and_command_line(spark, tmp_path):
    from tracelake.__main__ import main
    from tracelake.plans.charts import fft_points

    t = np.tile(np.arange(64) / 64, 2)
    rows = np.stack([t, np.sin(2 * np.pi * 8 * t), t * 0], axis=1)
    path = make(tmp_path, rows, [("Time", "time"), ("V(out)", "voltage"), ("V(in)", "voltage")], "real stepped")
    f = S.load(spark, path)
    made = fft_points(f.points, ["V(out)"], name="rectangular", chosen={1})
    out = made.evaluate("Frequency", "fft(v(OUT))", keep=("step",)).toDF("step", "f", "a").collect()
    assert {r["step"] for r in out} == {1} and max((r["a"], r["f"]) for r in out)[1] == pytest.approx(8)
    two = f.points.evaluate("V(out)@1", "V(out)@2", keep=("point_idx",)).toDF("i", "a", "b").orderBy("i").collect()
    assert [r["a"] for r in two] == [r["b"] for r in two]
    assert main([path]) == 0 and main([str(tmp_path / "none")]) == 1 and main([]) == 1
    (tmp_path / "text").write_text("hello\n")
    assert main([str(tmp_path / "text")]) == 1


def test_linked_views():
    a, b = W.View((0.2, 0.4), (0.1, 0.3)), W.View((0.2, 0.4), (0.5, 0.6))
    assert W.fit([a, b]) == [W.View(), W.View()]
    assert W.fit([a, b], 1) == [W.View((0, 1), (0.1, 0.3)), W.View()]
    assert W.auto_ranged([a, b], 0) == [W.View((0.2, 0.4), (0, 1)), b]
    assert W.to_extent([a, b], 10, 20, 17, 15)[0] == W.View((0.5, 0.7), (0.1, 0.3))
    assert W.to_extent([a], 20, 10, 0, 15)[0].x == (0.5, 1.0)


def test_kept_ranks(spark):
    for m in range(1, 30):
        df = spark.createDataFrame([(0, k) for k in range(m)], "step int, step_idx long") if m % 7 == 0 else None
        for target in (1, 2, 3, 4, 7, 12):
            kept = D.even_ranks(m, target)
            assert len(kept) == min(m, target) and (np.diff(kept) > 0).all() and kept[0] == 0
            if m > target > 2:
                inner = np.rint(np.linspace(0, m - 3, target - 2)).astype(int) + 1
                assert kept.tolist() == [0, *inner, m - 1]
            if df is not None and target > 2:
                assert [r["step_idx"] for r in D.trim(df, target, ["step"], "step_idx").orderBy("step_idx").collect()] == kept.tolist()


def test_charts_expand_by_their_type(spark):
    from tracelake.plans.charts import chart_series
    from tracelake.plans.compiler import expand

    df = spark.createDataFrame([(0, k, float(k), (float(k), 1.0), float("inf") if k == 3 else 2.0) for k in range(6)], "step int, step_idx long, x double, z struct<re:double,im:double>, r double")
    points = Points.of(df, [Variable("z", "z", "V", "voltage", True), Variable("r", "r", "A", "current")])
    assert expand(points, "z", "AC") == ["db(z)", "phase(z)"] and expand(points, "z", "TRANSIENT") == [] and expand(points, "r", "AC") == ["r"]
    drawn = chart_series(points, ["z", "r", "r"], "AC", 1.0, 4.0).collect()
    assert {(r["series"], r["unit"], r["axis"]) for r in drawn} == {("db(z)", "dB", 0), ("phase(z)", "°", 1), ("r", "A", 2)}
    assert sorted((r["x"], r["step_idx"]) for r in drawn if r["series"] == "r") == [(1.0, 0), (2.0, 1), (4.0, 3)]
    with pytest.raises(ValueError):
        chart_series(points, ["z"], "DC")


def test_smith_views():
    v = [Variable("S11", "a", "", "parameter", True), Variable("S22", "b", "", "parameter", True), Variable("x", "c")]
    assert smith.suggested(["s11", "S22"], v) == ["s11"] and smith.suggested(["x", "S11"], v) == []
    assert [w.name for w in smith.selectable(v)] == ["S11", "S22"]
    assert smith.changed({("S11", 0), ("S11", 1)}, {("S11", 1), ("S22", 0)}) == ({("S11", 0)}, {("S22", 0)})


def test_thd_reads_its_spectra_once(spark):
    """The transform is made when the table of bins is written; what is left are aggregations over that table, without any list of a spectrum's bins."""
    n = 64
    s = spectral.fft(series(spark, np.arange(n) / n, np.sin(2 * np.pi * 4 * np.arange(n) / n)), ["y"], name="rectangular")
    out = spectral.thd(s.withColumnRenamed("y", "value"), ["step"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "FlatMapGroupsInArrow" not in plan and "collect_list" not in plan
