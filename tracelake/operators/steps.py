"""Cutting ordered points into steps.

Looking at the row before is done in chunks of consecutive points: the last row of a chunk is copied to the next one, so a file of any length is
worked on in parallel. Running numbers are sums within chunks plus the sums of the chunks before, a table with a row for each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import ieee

CHUNK = 1 << 20


def with_previous(df: DataFrame, columns: dict[str, str], keys: list[str], order: str = "point_idx", chunk: int = CHUNK) -> DataFrame:
    """``df`` with each ``columns`` value (an expression) of the row before under its name; NULL in the first row. ``order`` numbers rows from 0 without gaps."""
    here = F.floor(F.col(order) / chunk)
    copies = F.when((F.col(order) + 1) % chunk == 0, F.array(here, here + 1)).otherwise(F.array(here))
    spread = df.withColumn("__chunk", F.explode(copies))
    w = Window.partitionBy(*keys, "__chunk").orderBy(order)
    out = spread
    for name, expression in columns.items():
        out = out.withColumn(name, F.lag(F.expr(expression) if isinstance(expression, str) else expression).over(w))
    return out.filter(F.col("__chunk") == here).drop("__chunk")


def running_count(df: DataFrame, flag: Column, name: str, keys: list[str], order: str = "point_idx", chunk: int = CHUNK) -> DataFrame:
    """``df`` with the number of rows up to each, itself included, for which ``flag`` holds."""
    marked = df.withColumn("__flag", F.coalesce(flag, F.lit(False)).cast("long")).withColumn("__chunk", F.floor(F.col(order) / chunk))
    sums = marked.groupBy(*keys, "__chunk").agg(F.sum("__flag").alias("__n"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__n").over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    w = Window.partitionBy(*keys, "__chunk").orderBy(order)
    inside = marked.withColumn("__inside", F.sum("__flag").over(w))
    return inside.join(before, [*keys, "__chunk"]).withColumn(name, F.col("__inside") + F.col("__before")).drop("__flag", "__chunk", "__inside", "__before")


def grouped(df: DataFrame, keys: list[str]):
    """By ``keys``, or all rows as one group."""
    return df.groupBy(*keys) if keys else df.groupBy(F.lit(0).alias("__all"))


def attach(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of each file beside its points: a row for each file."""
    return df.join(table, keys) if keys else df.crossJoin(table.drop("__all"))  # one row


def segment(df: DataFrame, params: dict[str, str] | None = None, stepped: bool = True, keys: list[str] = (), order: str = "point_idx", x: str = "x", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(points with step and step_idx, steps).

    ``params`` are names and columns of parameters: a change of any starts a step. Without them a step starts where ``x`` moves against the direction from its first
    to its last value. A file goes back to one step if its steps have mixed directions (parameters) or unequal lengths (no parameters).
    """
    keys = list(keys)
    params = params or {}
    if not stepped:
        points = df.withColumn("step", F.lit(0)).withColumn("step_idx", F.col(order))
        return points, describe(points, {}, keys, order, x)
    past = with_previous(df, {"__x": x, **{f"__p{k}": c for k, c in enumerate(params.values())}}, keys, order, chunk)
    moved = F.col(x) - F.col("__x")
    if params:
        starts = F.lit(False)
        for k, c in enumerate(params.values()):
            starts = starts | (F.col(f"__p{k}").isNotNull() & ~ieee.equal(F.expr(c), F.col(f"__p{k}")))
    else:
        ends = grouped(df, keys).agg(F.min_by(x, order).alias("__first"), F.max_by(x, order).alias("__last"))
        past = attach(past, ends, keys)
        up = ieee.compare("<=", F.col("__first"), F.col("__last"))
        starts = F.col("__x").isNotNull() & F.when(up, ieee.compare("<", moved, F.lit(0.0))).otherwise(ieee.compare(">", moved, F.lit(0.0)))
    cut = running_count(past.withColumn("__starts", starts), F.col("__starts"), "__step", keys, order, chunk)
    # One pass over the points for what the steps are; the rest is worked out on a row for each step.
    inside = ~F.col("__starts") & F.col("__x").isNotNull()
    moves = lambda op: F.max(F.when(inside, ieee.compare(op, moved, F.lit(0.0))))
    facts = cut.groupBy(*keys, "__step").agg(F.min(order).alias("__start"), F.count(F.lit(1)).alias("__n"), moves(">").alias("__up"), moves("<").alias("__down"))
    mixed = F.coalesce(F.max("__up") & F.max("__down"), F.lit(False)) if params else F.min("__n") != F.max("__n")
    bad = grouped(facts, keys).agg(mixed.alias("__bad"))
    begins = attach(facts.select(*keys, "__step", "__start"), bad, keys)
    joined = cut.join(begins, [*keys, "__step"])
    whole = F.coalesce(F.col("__bad"), F.lit(False))
    points = joined.select(*[f"`{c}`" for c in df.columns], F.when(whole, 0).otherwise(F.col("__step")).cast("int").alias("step"), F.when(whole, F.col(order)).otherwise(F.col(order) - F.col("__start")).alias("step_idx"), whole.alias("__whole"))
    table = describe(points, params, keys, order, x)
    return points.drop("__whole"), table


def describe(points: DataFrame, params: dict[str, str], keys: list[str], order: str = "point_idx", x: str = "x") -> DataFrame:
    """A row for each step: start, stop, x_first, x_last, params (empty where a file went back to one step)."""
    values = F.map_from_arrays(F.array(*[F.lit(n) for n in params]), F.array(*[F.min_by(F.expr(c), order) for c in params.values()])) if params else F.create_map().cast("map<string,double>")
    none = F.create_map().cast("map<string,double>")
    whole = F.max("__whole") if "__whole" in points.columns else F.lit(False)
    return points.groupBy(*keys, "step").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("stop"), F.min_by(x, order).alias("x_first"), F.max_by(x, order).alias("x_last"), F.when(whole, none).otherwise(values).alias("params"))


def extent(steps: DataFrame, keys: list[str] = ()) -> DataFrame:
    """ascending, left and right of all steps: the smallest first and largest last value, or the other way round if x falls."""
    up = F.min_by("x_first", "step") <= F.min_by("x_last", "step")
    return steps.groupBy(*keys).agg(up.alias("ascending"), F.when(up, F.min("x_first")).otherwise(F.max("x_first")).alias("left"), F.when(up, F.max("x_last")).otherwise(F.min("x_last")).alias("right"))


def select_steps(df: DataFrame, chosen: set[int] | None = None, inverted: bool = False) -> DataFrame:
    """The rows of the chosen steps; None is all."""
    if chosen is None:
        return df.filter(F.lit(not inverted))
    inside = F.col("step").isin(sorted(chosen)) if chosen else F.lit(False)
    return df.filter(~inside if inverted else inside)


def step_table(steps: DataFrame) -> DataFrame:
    """step and its parameter values as text."""
    return steps.select("step", F.transform_values("params", lambda _, v: v.cast("string")).alias("values"))
