"""What to draw for a file: chart types, suggestions, and eligible signals."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import spectral, windowing
from tracelake.operators.decimate import decimate
from tracelake.plans.compiler import Points, Variable, expand

# Modes that a suggestion may name, and chart types by the abscissa's unit.
MODES = {"ac": "AC", "tran": "TRANSIENT", "dc": "DC", "op": "DC", "noise": "AC", "fft": "FFT"}
BY_UNIT = {"Hz": "AC", "s": "TRANSIENT"}


@dataclass(frozen=True)
class Suggestion:
    chart: str
    expressions: tuple[str, ...]


def chart_type(x_unit: str, override: str | None = None) -> str:
    return override or BY_UNIT.get(x_unit, "DC")


def suggested(text: str) -> list[tuple[str | None, list[str]]]:
    """The mode, if one is named, and the expressions of each group in guillemets."""
    words = [g.split() for g in re.findall("«(.*?)»", text)]
    modes = [MODES.get(w[0].lower()) if w else None for w in words]
    return [(mode, w[1:] if mode else w) for mode, w in zip(modes, words, strict=True)]


def suggestions(text: str, points: Points, x_unit: str) -> list[Suggestion]:
    """What a text suggests to draw; expressions that don't resolve are dropped, equal ones are drawn once."""
    own = chart_type(x_unit)
    return [Suggestion(mode or own, tuple(dict.fromkeys(c.text for c in points.resolved(tokens)))) for mode, tokens in suggested(text)]


def chart_series(points: Points, texts: list[str], chart: str, left: float | None = None, right: float | None = None, target: int | None = None, method: str = "m4", x: str = "x", ascending: bool = True) -> DataFrame:
    """What a chart draws for its expressions: series (text), unit, axis, colour, dash, the step and its place, x and y.

    Complex expressions are expanded over frequency and left out elsewhere. Every series and step is cut to the visible range, decimated to ``target`` points and
    rid of infinities. A unit's axis is its place in the order of first use; beyond the last axis it has none. To draw again after a zoom, a change of steps
    or of expressions is to ask again with other arguments.
    """
    names = list(dict.fromkeys(e for t in texts for e in expand(points, t, chart)))
    if not names:
        raise ValueError("nothing to draw")
    keep, by = [*points.keys, points.step, points.step_idx, x], ["series", *points.keys, points.step]
    values = points.evaluate(*names, keep=tuple(keep))
    values = values.toDF(*keep, *[f"__{k}" for k in range(len(names))])
    series = F.explode(F.array(*[F.struct(F.lit(k).alias("series"), F.col(f"__{k}").cast("double").alias("y")) for k in range(len(names))]))
    shown = values.select(*keep, series.alias("s")).select("s.series", *keep, "s.y")
    if left is not None and right is not None:
        shown = windowing.zoom(shown, left, right, x, ascending)
    # x goes one way in a step, so the rows in the range follow each other.
    first = shown.groupBy(*by).agg(F.min(points.step_idx).alias("__first"))
    placed = shown.join(first, by).withColumn(points.step_idx, F.col(points.step_idx) - F.col("__first"))
    drawn = windowing.finite(decimate(placed, target or windowing.draw_target(), method, by, points.step_idx, x, "y"))
    found = [points.compile(n) for n in names]
    axes = windowing.axes([c.unit for c in found])
    about = F.array(*[F.struct(F.lit(c.text).alias("name"), F.lit(c.unit).alias("unit"), F.lit(axes[c.unit]).cast("int").alias("axis")) for c in found])
    own, style = F.element_at(about, F.col("series") + 1), windowing.series_style(F.col("series"), F.col(points.step).cast("int"))
    return drawn.select(own["name"].alias("series"), own["unit"].alias("unit"), own["axis"].alias("axis"), style["colour"].alias("colour"), style["dash"].alias("dash"), *points.keys, points.step, points.step_idx, x, "y")


def chart_ranges(drawn: DataFrame) -> DataFrame:
    """The range of each unit's axis over all that is drawn."""
    return windowing.auto_range(windowing.min_max(drawn, ["unit", "series", "step"]))


def fft_signals(points: Points, x: str) -> list[Variable]:
    """Real variables other than the abscissa; none unless the abscissa is time."""
    base = points.variables[x.casefold()]
    return [v for v in points.variables.values() if not v.is_complex and v.name != base.name] if base.unit == "s" else []


def fft_points(points: Points, names: list[str], x: str = "x", chosen: set[int] | None = None, left: float | None = None, right: float | None = None, parts: int | None = None, **options) -> Points:
    """A table of points over frequency: a variable for each signal, named after it, for all or the chosen steps.

    Options are those of ``spectral.fft``. With ``parts`` no task holds a step: each is transformed in so many parts, which have to divide its (padded) length. Steps of fewer than two samples in the range are left out; step numbers stay.
    """
    signals = [points.variables[n.casefold()] for n in names]
    if not signals:
        raise ValueError("no signals")
    rows = points.df if chosen is None else points.df.filter(F.col(points.step).isin(sorted(chosen)))
    series = [v.column for v in signals], [*points.keys, points.step], points.step_idx, x, left, right
    made = spectral.fft(rows, *series, **options) if parts is None else spectral.fft_in_parts(rows, series[0], parts, *series[1:], **options)
    output = options.get("output", "magnitude")
    out = [Variable("Frequency", "freq", "Hz", "frequency"), *[Variable(spectral.fft_name(v.name), v.column, spectral.fft_unit(output, v.unit)) for v in signals]]
    return Points.of(made.withColumnRenamed("bin", points.step_idx), out, keys=points.keys, step=points.step, step_idx=points.step_idx, n_steps=points.n_steps)
