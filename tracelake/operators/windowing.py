"""Slices of the abscissa, values at a place, ranges of axes, and what a view shows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import ieee

PAD = 0.03
MAX_AXES = 4


def zoom(df: DataFrame, left: float, right: float, x: str = "x", ascending: bool = True) -> DataFrame:
    """Rows between the edges, both included; for falling x the left edge is the larger one."""
    return df.filter(F.col(x).between(left, right) if ascending else F.col(x).between(right, left))


def nearest(df: DataFrame, at: float, by: list[str], x: str = "x", y: str = "y", order: str = "step_idx") -> DataFrame:
    """For each group the y of the row whose x is nearest; of two equally near the earlier one."""
    return df.groupBy(*by).agg(F.min_by(y, F.struct(F.abs(F.col(x) - F.lit(at)), F.col(order))).alias("value"))


def values_at(df: DataFrame, at: float, x: str = "x", y: str = "y", order: str = "step_idx") -> DataFrame:
    """For each series (name, unit) its nearest values, in the order of steps."""
    found = nearest(df, at, ["name", "unit", "step"], x, y, order)
    return found.groupBy("name", "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "value"))), lambda s: s["value"]).alias("values"))


def finite(df: DataFrame, y: str = "y") -> DataFrame:
    """Without rows whose y is infinite; NaN stays."""
    return df.filter(~F.abs(F.col(y)).eqNullSafe(F.lit(ieee.INF)))


def min_max(df: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    """Smallest and largest y of each group; NaN if any is."""
    any_nan = F.max(F.isnan(y))
    return df.groupBy(*by).agg(F.when(any_nan, ieee.NAN).otherwise(F.min(y)).alias("y_min"), F.when(any_nan, ieee.NAN).otherwise(F.max(y)).alias("y_max"))


def auto_range(df: DataFrame, unit: str = "unit", y_min: str = "y_min", y_max: str = "y_max") -> DataFrame:
    """The range of each unit's axis: all its series and a margin on either side."""
    lo, hi = F.min(y_min), F.max(y_max)
    return df.groupBy(unit).agg((lo - PAD * (hi - lo)).alias("low"), (hi + PAD * (hi - lo)).alias("high"))


def axes(units: list[str]) -> dict[str, int | None]:
    """The axis of each unit in the order of first use; units beyond the last axis get none."""
    out: dict[str, int | None] = {}
    for u in units:
        out.setdefault(u, len(out) if len(out) < MAX_AXES else None)
    return out


@dataclass(frozen=True)
class View:
    """The part of the whole extent that is shown, as ratios from 0 to 1, for x and for y."""

    x: tuple[float, float] = (0.0, 1.0)
    y: tuple[float, float] = (0.0, 1.0)

    def zoomed(self, x: tuple[float, float] | None = None, y: tuple[float, float] | None = None) -> View:
        """New ratios are relative to what is shown now; their order doesn't matter."""

        def within(now: tuple[float, float], new: tuple[float, float] | None) -> tuple[float, float]:
            if new is None:
                return now
            lo, hi = sorted(min(max(r, 0.0), 1.0) for r in new)
            size = now[1] - now[0]
            return now[0] + lo * size, now[0] + hi * size

        return replace(self, x=within(self.x, x), y=within(self.y, y))

    def reset(self, x: bool = True, y: bool = True) -> View:
        return View((0.0, 1.0) if x else self.x, (0.0, 1.0) if y else self.y)

    def bounds(self, left: float, right: float) -> tuple[float, float]:
        return ratio_to_x(self.x[0], left, right), ratio_to_x(self.x[1], left, right)


def link(views: list[View], origin: int, x: tuple[float, float] | None = None, y: tuple[float, float] | None = None) -> list[View]:
    """A zoom in one chart: all charts follow in x, only its own moves in y."""
    return [v.zoomed(x, y if k == origin else None) for k, v in enumerate(views)]


def fit(views: list[View], origin: int | None = None) -> list[View]:
    """Back to the whole: every chart in x, and in y the one chart that asks, or all."""
    return [v.reset(y=origin in (None, k)) for k, v in enumerate(views)]


def auto_ranged(views: list[View], origin: int) -> list[View]:
    """The chart that asks shows its whole range of y again; nothing moves in x."""
    return [v.reset(x=False, y=k == origin) for k, v in enumerate(views)]


def to_extent(views: list[View], left: float, right: float, low: float, high: float) -> list[View]:
    """All charts show x from ``low`` to ``high`` of a whole from ``left`` to ``right``, in either order; y stays."""
    size = right - left
    edges = sorted(min(max((edge - left) / size, 0.0), 1.0) for edge in (low, high)) if size else [0.0, 1.0]
    return [replace(v, x=(edges[0], edges[1])) for v in views]


def ratio_to_x(ratio: float, left: float, right: float) -> float:
    return left + min(max(ratio, 0.0), 1.0) * (right - left)


def ticks(low: float, high: float, scale: str = "lin") -> list[float]:
    """Linear: eleven marks; logarithmic (already scaled values): each whole decade or octave inside."""
    if scale == "lin":
        return [low + k * (high - low) / 10 for k in range(11)]
    import math

    return [float(k) for k in range(math.ceil(min(low, high)), math.floor(max(low, high)) + 1)]


# SI prefixes with the least magnitude each is used from.
PREFIXES = [(1e9, 1e9, "G"), (1e6, 1e6, "M"), (1e3, 1e3, "k"), (1.0, 1.0, ""), (1e-3, 1e-3, "m"), (1e-6, 1e-6, "µ"), (1e-9, 1e-9, "n"), (1e-12, 1e-12, "p"), (1e-15, 1e-15, "f")]


def si_text(value: Column, unit: Column, digits: int = 2) -> Column:
    """A number with SI prefix and unit; below the smallest prefix it is 0."""
    out = F.concat(F.lit("0 "), unit)
    for least, size, prefix in reversed(PREFIXES):
        out = F.when(F.abs(value) >= least, F.concat(F.format_string(f"%.{digits}f {prefix}", value / size if size >= 1 else value * round(1 / size)), unit)).otherwise(out)
    return out


def si_list(name: Column, values: Column, unit: Column, digits: int = 2) -> Column:
    """``name = value``, several values in brackets."""
    texts = F.transform(values, lambda v: si_text(v, unit, digits))
    return F.concat(name, F.lit(" = "), F.when(F.size(values) == 1, F.element_at(texts, 1)).otherwise(F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]"))))


def series_style(colour: Column, step: Column, n_colours: int = 14) -> Column:
    """The place in the colour cycle, and the dash pattern that steps after the first have."""
    return F.struct((colour % n_colours).alias("colour"), F.when(step > 0, F.array(F.lit(3), step + 1)).otherwise(F.array().cast("array<int>")).alias("dash"))


def draw_target(width: int | None = None, pixel_ratio: float = 1.0) -> int:
    """Points that a drawn series may have."""
    return 9600 if not width else width * max(5, int(pixel_ratio))
