"""Uniformity, resampling, spectra and harmonic distortion of series.

A spectrum needs a series in one place: one grouped call transforms all signals of a step together. What comes before and after is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Window coefficients a0 - a1 cos + a2 cos of twice the angle.
WINDOWS = {"rectangular": (1.0, 0.0, 0.0), "hamming": (0.54, 0.46, 0.0), "hanning": (0.5, 0.5, 0.0), "blackman": (0.42, 0.5, 0.08)}
OUTPUTS = ("magnitude", "db", "phase")
LEAST = 1e-300
#: A window whose weights add up to less is refused: such a sum is rounding, as that of two Blackman weights.
LEAST_WEIGHT = 1e-12
#: A multiple of the fundamental is above the last bin if it is by more than this share, which rounding can't be.
_ABOVE = 1e-9
_EPS = float(np.finfo(float).eps)


def window(name: str, n: int) -> np.ndarray:
    a, b, c = WINDOWS[name]
    if n == 1:
        return np.ones(1)
    t = 2 * np.pi * np.arange(n) / (n - 1)
    return a - b * np.cos(t) + c * np.cos(2 * t)


def window_weight(name: str, at: Column, n: Column) -> Column:
    """The same weights as a column."""
    a, b, c = WINDOWS[name]
    t = 2 * np.pi * at / (n - 1)
    return F.when(n == 1, F.lit(1.0)).otherwise(a - b * F.cos(t) + c * F.cos(2 * t))


def _weights(name: str, n: Column) -> Column:
    """The sum of a window's ``n`` weights: the cosines of a whole turn add up to the one that is in it twice."""
    a, b, c = WINDOWS[name]
    return a * n - b * F.when(n == 2, 2).otherwise(1) + c * F.when(n <= 3, n).otherwise(1)


def uniform(df: DataFrame, by: list[str], order: str = "step_idx", x: str = "x", rtol: float = 1e-3, atol: float | None = None) -> DataFrame:
    """Whether each series has even steps: all as long as its first, within tolerances; fewer than two points are even."""
    return _steps(df, list(by), order, x, rtol, atol).select(*by, "uniform")


def _steps(df: DataFrame, by: list[str], order: str, x: str, rtol: float = 1e-3, atol: float | None = None) -> DataFrame:
    """by, uniform, and of each series d0 (its first step), count, first (its first place), a and b (its ends)."""
    from tracelake.operators.steps import with_previous

    past = with_previous(df.select(*by, order, x), {"__past": x}, by, order).withColumn("d", F.col(x) - F.col("__past"))
    ends = [F.count(F.lit(1)).alias("count"), F.min(order).alias("first"), F.min_by(x, order).alias("a"), F.max_by(x, order).alias("b")]
    facts = past.groupBy(*by).agg(F.min_by("d", F.when(F.col("d").isNotNull(), F.col(order))).alias("d0"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.max(F.abs("d")).alias("size"), *ends)
    near = F.lit(atol) if atol is not None else F.greatest(F.lit(1e-12), _EPS * F.greatest("size", F.lit(1.0)) * 10)
    off = F.greatest(F.col("hi") - F.col("d0"), F.col("d0") - F.col("lo"))
    return facts.select(*by, F.coalesce(off <= near + rtol * F.abs("d0"), F.lit(True)).alias("uniform"), "d0", "count", "first", "a", "b")


def is_uniform(x: np.ndarray, rtol: float = 1e-3, atol: float | None = None) -> bool:
    if len(x) < 2:
        return True
    d = np.diff(x)
    near = atol if atol is not None else max(1e-12, _EPS * max(float(np.abs(d).max()), 1.0) * 10)
    return bool((np.abs(d - d[0]) <= near + rtol * abs(d[0])).all())


def resample(df: DataFrame, by: list[str], n: int | None = None, order: str = "step_idx", x: str = "x", y: str = "y", chunk: int | None = None, block: int = 1 << 16) -> DataFrame:
    """Each series at even places from its first to its last x, linear between its points; as many as it has, or ``n``.

    x doesn't fall; of points with equal x the last counts, and a null y is NaN. Each point and the next give the places between them, so a series is never
    gathered: ``order`` numbers its rows without gaps, and neighbours are looked up in chunks. A wide span gives its places in blocks.
    """
    from tracelake.operators.steps import CHUNK, attach, grouped, with_previous

    by = list(by)
    rows = df.select(*by, F.col(order).cast("long").alias(order), F.col(x).cast("double").alias(x), F.coalesce(F.col(y).cast("double"), F.lit(float("nan"))).alias(y))
    many = F.count(F.lit(1)) if n is None else F.lit(n).cast("long")
    ends = grouped(rows, by).agg(F.min_by(x, order).alias("__a"), F.max_by(x, order).alias("__b"), F.max_by(y, order).alias("__end"), many.alias("__m"))
    ends = ends.withColumn("__step", (F.col("__b") - F.col("__a")) / F.greatest(F.col("__m") - 1, F.lit(1)))
    facts = [*by, "__a", "__b", "__m", "__step"]
    rising = with_previous(rows, {"__x1": x, "__y1": y}, by, order, chunk or CHUNK).filter(F.col("__x1") < F.col(x))
    spans = attach(rising.withColumnsRenamed({x: "__x2", y: "__y2"}).drop(order), ends, by).select(*facts, "__x1", "__y1", "__x2", "__y2")
    none = F.lit(None).cast("double")
    spans = spans.unionByName(ends.select(*facts, F.col("__b").alias("__x1"), F.col("__end").alias("__y1"), none.alias("__x2"), none.alias("__y2")))
    # Places that may be in a span; which are is told by the places themselves, as rounding may move them over an edge.
    size, k = F.nullif(F.col("__step"), F.lit(0.0)), F.col("__k")
    slack = F.ceil(4 * _EPS * F.greatest(F.abs("__a"), F.abs("__b")) / F.abs(size)) + 1
    place = lambda c: F.floor((F.col(c) - F.col("__a")) / size)
    low = F.greatest(F.coalesce(place("__x1") - slack, F.lit(0)), F.lit(0)).cast("long")
    high = F.least(F.coalesce(place("__x2") + slack, F.col("__m") - 1), F.col("__m") - 1).cast("long")
    spans = spans.withColumns({"__low": low, "__high": high}).filter("__low <= __high")
    spans = spans.withColumn("__from", F.explode(F.sequence("__low", "__high", F.lit(block).cast("long"))))
    spans = spans.withColumn("__k", F.explode(F.sequence("__from", F.least(F.col("__from") + (block - 1), F.col("__high")))))
    at = F.when((k == F.col("__m") - 1) & (k > 0), F.col("__b")).otherwise(F.col("__a") + k * F.col("__step"))
    inside = spans.withColumn("__at", at).filter((F.col("__at") >= F.col("__x1")) & (F.col("__x2").isNull() | (F.col("__at") < F.col("__x2"))))
    slope = (F.col("__y2") - F.col("__y1")) / (F.col("__x2") - F.col("__x1"))
    value = F.when(F.col("__x2").isNull() | (F.col("__at") == F.col("__x1")), F.col("__y1")).otherwise(F.col("__y1") + (F.col("__at") - F.col("__x1")) * slope)
    return inside.select(*by, k.alias(order), F.col("__at").alias(x), value.alias(y))


def spectrum(x: np.ndarray, signals: np.ndarray, name: str = "hanning", output: str = "magnitude", keep_dc: bool = False, pad: bool = False, normalise: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies, and a row for each signal (rows of ``signals``). Amplitudes are one-sided and corrected for the window."""
    signals = np.atleast_2d(signals).real.astype(float)
    n = len(x)
    if signals.ndim != 2 or signals.shape[1] != n:
        raise ValueError("signals are as long as x")
    if n < 2:
        raise ValueError("a spectrum needs two samples")
    if output not in OUTPUTS:
        raise ValueError(f"output is one of {', '.join(OUTPUTS)}")
    if not is_uniform(x):
        grid = np.linspace(x[0], x[-1], n)
        signals, x = np.stack([np.interp(grid, x, s) for s in signals]), grid
    dt = x[1] - x[0]  # the first step; the others agree within the tolerance of is_uniform
    if not dt > 0:
        raise ValueError("x must rise")
    weights = window(name, n)
    if abs(weights.sum()) < LEAST_WEIGHT:
        raise ValueError("the window's weights add up to 0")
    if not keep_dc:
        signals = signals - signals.mean(axis=1, keepdims=True)
    size = 1 << (n - 1).bit_length() if pad else n
    out = np.fft.rfft(signals * weights, n=size, axis=1) * (2 / weights.sum())
    freq = np.arange(out.shape[1]) / (size * dt)
    if output == "phase":
        return freq, np.degrees(np.angle(out))
    amount = np.abs(out)
    amount[:, 0] /= 2
    if size % 2 == 0:
        amount[:, -1] /= 2
    if normalise:
        peak = amount.max(axis=1, keepdims=True)
        amount /= np.where(peak == 0, 1, peak)
    return freq, 20 * np.log10(np.maximum(amount, LEAST)) if output == "db" else amount


def fft(df: DataFrame, signals: list[str], by: list[str] = ("step",), order: str = "step_idx", x: str = "x", left: float | None = None, right: float | None = None, **options) -> DataFrame:
    """by, bin, freq and a column for each signal; series of fewer than two samples in the range are left out."""
    by = list(by)
    rows = df.select(*by, F.col(order).cast("long").alias(order), F.col(x).cast("double").alias(x), *[F.col(f"`{s}`").cast("double").alias(s) for s in signals])
    for edge, keep in ((left, F.col(x) >= F.lit(left)), (right, F.col(x) <= F.lit(right))):
        if edge is not None:
            rows = rows.filter(keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema.fields), "bin bigint", "freq double", *(f"`{s}` double" for s in signals)])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        if table.num_rows < 2:
            freq, out = np.zeros(0), np.zeros((len(signals), 0))
        else:
            freq, out = spectrum(table.column(x).to_numpy(), np.stack([table.column(s).to_numpy() for s in signals]), **options)
        fixed = {k: pa.array([table.column(k)[0].as_py()] * len(freq), table.column(k).type) for k in by}
        return pa.table(fixed | {"bin": pa.array(np.arange(len(freq))), "freq": pa.array(freq)} | {s: pa.array(v) for s, v in zip(signals, out, strict=True)})

    return rows.groupBy(*by).applyInArrow(run, schema)


def _whole_groups(batches: Iterator[pa.RecordBatch], same: list[str], rising: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole groups, and where the groups begin, with the end of the last. A group has the same numbers in ``same`` and rises in ``rising``."""
    held, rows, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = [batch.column(c).to_numpy() for c in (*same, rising)]
        before = [np.concatenate([m[:1] if last is None else last[k], m[:-1]]) for k, m in enumerate(marks)]
        new = np.any([m != b for m, b in zip(marks[:-1], before[:-1], strict=True)], axis=0) | (marks[-1] <= before[-1])
        new[0] &= last is not None  # the first row of all has none before it
        last, begins = [m[-1:] for m in marks], np.flatnonzero(new)
        if len(begins):
            yield pa.Table.from_batches([*held, batch.slice(0, begins[-1])]), np.concatenate([np.zeros(1, np.int64), rows + begins])
            batch, held, rows = batch.slice(begins[-1]), [], 0
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held), np.array([0, rows])


def fft_in_parts(df: DataFrame, signals: list[str], parts: int, by: list[str] = ("step",), order: str = "step_idx", x: str = "x", left: float | None = None, right: float | None = None, name: str = "hanning", output: str = "magnitude", keep_dc: bool = False, pad: bool = False, normalise: bool = False) -> DataFrame:
    """``fft`` of series that are too long for one task: each is transformed in ``parts`` interleaved parts, and their bins are brought together in blocks.

    A task holds about one part of a series of one signal, so for n samples about sqrt(n) parts need the least memory. Raises where ``parts`` doesn't divide the
    length (``pad`` makes it a power of two). Parts of short series go to Python many at a time, sorted, so that their number costs little. ``order`` numbers a series' rows without gaps, also in the range.
    """
    from tracelake.operators.steps import attach

    if output not in OUTPUTS:
        raise ValueError(f"output is one of {', '.join(OUTPUTS)}")
    by, keys = list(by), [*by, "__s"]
    rows = df.select(*by, F.col(order).cast("long").alias("__place"), F.col(x).cast("double").alias("__time"), *[F.col(f"`{s}`").cast("double").alias(f"__y{k}") for k, s in enumerate(signals)])
    for edge, keep in ((left, F.col("__time") >= F.lit(left)), (right, F.col("__time") <= F.lit(right))):
        if edge is not None:
            rows = rows.filter(keep)
    n, a, b = F.col("count"), F.col("a"), F.col("b")
    refuse = lambda why: F.raise_error(F.lit(why)).cast("long")
    dt = F.when(F.col("uniform"), F.col("d0")).otherwise((b - a) / (n - 1))
    size = F.expr("shiftleft(1L, length(bin(count - 1)))") if pad else n
    checked = F.when(~(F.col("dt") > 0), refuse("x must rise")).when(F.abs("weights") < LEAST_WEIGHT, refuse("the window's weights add up to 0"))
    checked = checked.when(size % parts != 0, refuse(f"{parts} parts don't divide a series' length")).otherwise(size)
    facts = _steps(rows, by, "__place", "__time").filter(n > 1).withColumns({"dt": dt, "weights": _weights(name, n)}).withColumn("size", checked)
    fact = F.struct("uniform", "count", "first", "dt", "weights", "size").alias("__fact")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("__s"), F.col(f"__y{k}").alias("__value")) for k in range(len(signals))]))
    long = attach(rows, facts.select(*by, fact), by).select(*by, "__fact", "__place", "__time", each.alias("e")).select(*keys[:-1], "e.__s", "__fact", "__place", "__time", "e.__value")
    even, fixed = F.col("__fact.uniform"), [*keys, "__fact"]
    samples = long.filter(even).withColumn("__at", F.col("__place") - F.col("__fact.first")).select(*fixed, "__at", "__value")
    samples = samples.unionByName(resample(long.filter(~even), fixed, None, "__place", "__time", "__value").select(*fixed, F.col("__place").alias("__at"), "__value"))
    if not keep_dc:
        means = samples.groupBy(*keys).agg(F.avg("__value").alias("__mean"))
        samples = samples.join(means, keys).withColumn("__value", F.col("__value") - F.col("__mean"))
    value = F.col("__value") * window_weight(name, F.col("__at"), F.col("__fact.count"))
    inside = F.col("__at") % parts, F.floor(F.col("__at") / parts)
    dealt = samples.select(*keys, F.col("__fact.size").alias("__size"), F.col("__fact.dt").alias("__dt"), F.col("__fact.weights").alias("__weights"), inside[0].alias("__part"), inside[1].alias("__at"), value.alias("__v"))
    fixed = [*keys, "__size", "__dt", "__weights"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*fixed).schema.fields)
    width_of = lambda m: -(-m // parts)

    def one_each(table: pa.Table, bounds: np.ndarray, names: list[str]) -> list[list]:
        return [table.column(c).to_numpy()[bounds[:-1]].tolist() for c in names]

    def rows_of(table: pa.Table, bounds: np.ndarray, counts: list[int], columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        """As many rows of each group as it has results."""
        facts = table.select(fixed).take(pa.array(np.repeat(bounds[:-1], counts)))
        yield from pa.table(dict(zip(fixed, facts.columns, strict=True)) | columns).combine_chunks().to_batches()

    def each_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's transform, turned by its place, in blocks of bins."""
        for table, bounds in _whole_groups(batches, ["__hash", "__part"], "__at"):
            at, values = table.column("__at").to_numpy(), table.column("__v").to_numpy()
            sizes, places = one_each(table, bounds, ["__size", "__part"])
            turned, widths = [], []
            for lo, hi, size, part in zip(bounds[:-1], bounds[1:], sizes, places, strict=True):
                m = size // parts
                own = np.zeros(m)
                own[at[lo:hi]] = values[lo:hi]
                turned.append(np.fft.fft(own) * np.exp(-2j * np.pi * part / size * np.arange(m)))
                widths.append(np.diff(np.append(np.arange(0, m, width_of(m)), m)))
            counts, flat = list(map(len, widths)), np.concatenate(turned)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(widths))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v))) for v in (flat.real, flat.imag)]
            yield from rows_of(table, bounds, counts, {"__part": pa.array(np.repeat(places, counts)), "__block": pa.array(np.concatenate([np.arange(c) for c in counts])), "__re": lists[0], "__im": lists[1]})

    def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bins that lie a part's length apart, from the same bins of all parts."""
        for table, bounds in _whole_groups(batches, ["__hash", "__block"], "__part"):
            table = table.combine_chunks()
            re, im = (table.column(c).combine_chunks() for c in ("__re", "__im"))
            ends = np.concatenate([[0], np.cumsum(re.value_lengths().to_numpy())])
            flat, place = re.flatten().to_numpy() + 1j * im.flatten().to_numpy(), table.column("__part").to_numpy()
            found, kept = [], []
            for lo, hi, size, block in zip(bounds[:-1], bounds[1:], *one_each(table, bounds, ["__size", "__block"]), strict=True):
                m = size // parts
                low = block * width_of(m)
                cells = np.zeros((parts, min(width_of(m), m - low)), complex)
                cells[place[lo:hi]] = flat[ends[lo] : ends[hi]].reshape(hi - lo, -1)
                bins = (np.arange(parts)[:, None] * m + np.arange(low, low + cells.shape[1])).ravel()
                inside = bins <= size // 2
                found.append(np.fft.fft(cells, axis=0).ravel()[inside])
                kept.append(bins[inside])
            out = np.concatenate(found)
            yield from rows_of(table, bounds, list(map(len, kept)), {"bin": pa.array(np.concatenate(kept)), "__re": pa.array(np.ascontiguousarray(out.real)), "__im": pa.array(np.ascontiguousarray(out.imag))})

    def sorted_groups(df: DataFrame, key: str, rising: str) -> DataFrame:
        return df.repartition(*keys, key).sortWithinPartitions("__hash", *keys, key, rising)

    kinds += ", __hash bigint"
    fixed = [*fixed, "__hash"]
    dealt = dealt.withColumn("__hash", F.xxhash64(*keys))  # tells series apart in Python, whatever their keys' types
    turned = sorted_groups(dealt, "__part", "__at").mapInArrow(each_part, f"{kinds}, __part bigint, __block bigint, __re array<double>, __im array<double>")
    bins = sorted_groups(turned, "__block", "__part").mapInArrow(each_block, f"{kinds}, bin bigint, __re double, __im double")
    bins = bins.withColumn("freq", F.col("bin") / (F.col("__size") * F.col("__dt")))
    if output == "phase":
        shown = F.degrees(F.atan2("__im", "__re"))
    else:
        single = (F.col("bin") == 0) | (2 * F.col("bin") == F.col("__size"))
        shown = F.hypot("__re", "__im") * F.when(single, 1).otherwise(2) / F.col("__weights")
    bins = bins.select(*keys, "bin", "freq", shown.alias("__v"))
    if normalise and output != "phase":
        peaks = bins.groupBy(*keys).agg(F.max("__v").alias("__peak"))
        bins = bins.join(peaks, keys).withColumn("__v", F.col("__v") / F.when(F.col("__peak") == 0, 1.0).otherwise(F.col("__peak")))
    if output == "db":
        bins = bins.withColumn("__v", 20 * F.log10(F.greatest("__v", F.lit(LEAST))))
    if len(signals) == 1:
        return bins.select(*by, "bin", "freq", F.col("__v").alias(signals[0]))
    return bins.groupBy(*by, "bin").agg(F.min("freq").alias("freq"), *[F.max(F.when(F.col("__s") == k, F.col("__v"))).alias(s) for k, s in enumerate(signals)])


def fft_options(window: str = "Hanning", padding: str = "None", output: str = "Magnitude") -> dict:
    """Options from a dialog's texts; unknown ones fall back to no window, no padding and magnitude."""
    return {"name": window.casefold() if window.casefold() in WINDOWS else "rectangular", "pad": "pow" in padding.casefold() or "power" in padding.casefold(), "output": output.casefold() if output.casefold() in OUTPUTS else "magnitude"}


def fft_unit(output: str, unit: str) -> str:
    return {"phase": "°", "db": "dB"}.get(output, unit)


def fft_name(name: str) -> str:
    return f"FFT({name})".replace(" ", "")


def frequency_preview(df: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """Bin width and largest frequency from the mean spacing; 0 where there is none."""
    n, span = F.count(F.lit(1)), F.max(x) - F.min(x)
    rate = (n - 1) / span
    some = (n >= 2) & (span > 0)
    return df.groupBy(*by).agg(F.when(some, rate / n).otherwise(0.0).alias("df"), F.when(some, rate / 2).otherwise(0.0).alias("nyquist"))


def thd(spectra: DataFrame, by: list[str], value: str = "value", fundamental: float | None = None, harmonics: int = 5, tolerance: float | None = None) -> DataFrame:
    """Total harmonic distortion of each spectrum (bin, freq, value).

    The fundamental is the largest value besides bin 0, the first of equal ones, or the bin nearest to a given frequency. A harmonic
    is the largest value within the tolerance of its frequency, else the nearest bin within twice that, else left out, as are those above the last bin. Raises where the fundamental isn't positive.
    """
    from tracelake.operators.steps import attach, grouped
    from tracelake.sources.shared import stored

    by = list(by)
    # Two aggregations over bins with partial sums: the fundamental, then everything near its multiples. No task holds a spectrum; it is a table, so it is made once.
    bins = stored(spectra.select(*by, F.col("bin").alias("__bin"), F.col("freq").alias("__freq"), F.col(value).alias("__v")), "bins")
    spot = F.struct(F.col("__freq").alias("freq"), F.col("__v").alias("v"))
    if fundamental is None:
        first = F.max_by(F.when(F.col("__bin") > 0, spot), F.when(F.col("__bin") > 0, F.struct("__v", -F.col("__bin"))))
    else:
        first = F.min_by(spot, F.struct(F.abs(F.col("__freq") - F.lit(fundamental)), "__bin"))
    at = lambda k: F.max(F.when(F.col("__bin") == k, F.col("__freq")))
    tol = F.lit(tolerance).cast("double") if tolerance is not None else F.greatest(F.coalesce((at(1) - at(0)) / 2, F.lit(0.0)), F.lit(1e-12))
    facts = grouped(bins, by).agg(first.alias("__f"), F.max("__freq").alias("__top"), tol.alias("__tol"))
    off = lambda k: F.abs(F.col("__freq") - k * F.col("__f.freq"))
    near = attach(bins, facts, by)
    multiples = range(2, harmonics + 1)
    found = near.groupBy(*by, "__f", "__top").agg(
        *[F.max(F.when(off(k) <= F.col("__tol"), F.col("__v"))).alias(f"__in{k}") for k in multiples],
        *[F.min_by(F.when(off(k) <= 2 * F.col("__tol"), F.col("__v")), F.when(off(k) <= 2 * F.col("__tol"), F.struct(off(k), "__bin"))).alias(f"__by{k}") for k in multiples],
        F.count(F.lit(1)).alias("__n"),
    )
    squares = [F.when(k * F.col("__f.freq") <= F.col("__top") * (1 + _ABOVE), F.pow(F.coalesce(f"__in{k}", f"__by{k}", F.lit(0.0)), F.lit(2.0))).otherwise(0.0) for k in multiples]
    a1 = F.col("__f.v")
    return found.select(*by, F.when(a1 > 0, F.sqrt(sum(squares, F.lit(0.0))) / a1).otherwise(F.raise_error(F.lit("the fundamental's amplitude isn't positive")).cast("double")).alias("thd"))
