"""Reflection coefficients on a Smith chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import ieee
from tracelake.operators.decimate import decimate
from tracelake.plans.compiler import Variable

# Fixed values.
RESISTANCES = (0.0, 0.2, 0.5, 1.0, 2.0, 5.0)
REACTANCES = (0.2, 0.5, 1.0, 2.0, 5.0)
TRACE_POINTS = 2000


def eligible(v: Variable) -> bool:
    """Reflection parameters of either port."""
    return v.name.upper().startswith(("S11", "S22")) and v.kind == "parameter"


def suggested(suggestion: list[str], variables: list[Variable]) -> list[str]:
    """What a new chart shows: the first suggested expression, if it is complex."""
    known = {v.name.casefold(): v.is_complex for v in variables}
    return [e for e in suggestion[:1] if known.get(e.casefold())]


def selectable(variables: list[Variable]) -> list[Variable]:
    """Only complex variables can be chosen."""
    return [v for v in variables if v.is_complex]


def changed(shown: set, wanted: set) -> tuple[set, set]:
    """Traces (expression, step) to take away and to draw; the others stay as they are."""
    return shown - wanted, wanted - shown


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != ieee.INF)


def project(df: DataFrame, z: str, by: list[str] = ("step",), order: str = "step_idx", is_complex: bool = True) -> DataFrame:
    """by, order, re and im of the finite points; a real value has im 0."""
    re, im = (F.col(f"`{z}`.re"), F.col(f"`{z}`.im")) if is_complex else (F.col(f"`{z}`").cast("double"), F.lit(0.0))
    return df.select(*by, order, re.alias("re"), im.alias("im")).filter(_finite(F.col("re")) & _finite(F.col("im")))


def pixels(df: DataFrame, cx: float, cy: float, radius: float) -> DataFrame:
    """Places on a screen, where y grows downwards."""
    return df.withColumns({"px": cx + F.col("re") * radius, "py": cy - F.col("im") * radius})


def trace(df: DataFrame, z: str, cx: float, cy: float, radius: float, by: list[str] = ("step",), order: str = "step_idx", target: int = TRACE_POINTS) -> DataFrame:
    """What is drawn: projected, in pixels, with rows numbered anew and simplified."""
    from pyspark.sql import Window

    shown = pixels(project(df, z, by, order), cx, cy, radius)
    numbered = shown.withColumn(order, F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    return decimate(numbered, target, "rdp", by, order, "px", "py")


def grid(spark: SparkSession) -> DataFrame:
    """Circles of equal resistance and reactance: kind, value, cx, cy, radius; to be cut at the unit circle."""
    rows = [("r", r, r / (1 + r), 0.0, 1 / (1 + r)) for r in RESISTANCES]
    rows += [("x", s * x, 1.0, 1 / (s * x), 1 / x) for x in REACTANCES for s in (1, -1)]
    return spark.createDataFrame(rows, "kind string, value double, cx double, cy double, radius double")
