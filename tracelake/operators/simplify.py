"""Line simplification of series that are too long for one task, level by level.

Every level is an aggregation over points with partial maxima: each open segment's farthest point. That point splits the segment, at a level that is the least distance on its way from the whole series, as a point stays
at a tolerance only if all splits above it do. Segments whose level isn't among a series' ``target - 1`` largest can't change what stays and are closed. When none is open, bisection over
at most ``target`` levels of a series gives its tolerance. No task holds a series, and nothing but a number of segments goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.steps import grouped
from tracelake.sources.shared import stored

ROUNDS = 24


def _distance(x: str, y: str):
    """Of a point from the line through the ends of its segment, or from the one place where both are."""
    dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    u, v = F.col(x) - F.col("a.x"), F.col(y) - F.col("a.y")
    return F.when((dx == 0) & (dy == 0), F.hypot(u, v)).otherwise(F.abs(u * dy - v * dx) / F.hypot(dx, dy))


def simplify(rows: DataFrame, target: int, by: list[str], order: str, x: str, y: str) -> DataFrame:
    """by, order, x, y of at most ``target`` (3 or more) rows of each series that has more: the finest tolerance that bisection finds. Of equally far points the first one splits."""
    if target < 3:
        raise ValueError("target is at least 3")
    place = F.struct(F.col(order).alias("i"), F.col(x).alias("x"), F.col(y).alias("y"))
    ends = grouped(rows, by).agg(F.min_by(place, order).alias("a"), F.max_by(place, order).alias("b"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > target)
    ends = stored(ends.select(*by, "a", "b"), "ends")
    segments = ends.select(*by, F.col("a.i").alias("seg"), "a", "b", F.lit(float("inf")).alias("least"))
    keys = [*by, "seg"]
    points = rows.join(segments.select(*keys), by) if by else rows.crossJoin(segments.select("seg"))  # without keys there is one segment
    made = None
    while True:
        inside = points.join(segments, keys).filter((F.col(order) > F.col("a.i")) & (F.col(order) < F.col("b.i"))).withColumn("d", _distance(x, y))
        best = inside.groupBy(*keys).agg(F.max_by(place, F.struct("d", -F.col(order))).alias("far"), F.max("d").alias("d"))
        splits = best.join(segments, keys).withColumn("level", F.least("d", "least")).filter(F.col("level") > 0)
        splits = stored(splits.select(*keys, "a", "far", "b", "level"), "splits")
        new = splits.select(*by, "far", "level")
        made = stored(new if made is None else made.unionByName(new), "made")
        ranked = made.withColumn("r", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("level"))))
        floor = ranked.filter(F.col("r") == target - 1).select(*by, F.col("level").alias("floor"))
        open_ = splits.join(floor, by, "left") if by else splits.crossJoin(floor.groupBy().agg(F.max("floor").alias("floor")))
        open_ = stored(open_.filter(F.col("floor").isNull() | (F.col("level") > F.col("floor"))).drop("floor"), "open")
        if open_.isEmpty():
            break
        halves = F.explode(F.array(F.struct(F.col("a.i").alias("seg"), F.col("a").alias("a"), F.col("far").alias("b")), F.struct(F.col("far.i").alias("seg"), F.col("far").alias("a"), F.col("b").alias("b"))))
        segments = open_.select(*by, "level", halves.alias("h")).select(*by, "h.seg", "h.a", "h.b", F.col("level").alias("least"))
        at = F.when(F.col(order) < F.col("far.i"), F.col("seg")).otherwise(F.col("far.i"))
        points = stored(points.join(open_.select(*keys, "far"), keys).filter(F.col(order) != F.col("far.i")).withColumn("seg", at).drop("far"), "points")
    levels = ranked.filter(F.col("r") <= target)
    levels = grouped(levels, by).agg(F.collect_list("level").alias("levels"), F.max("level").alias("top"))

    def halved(span, _):
        middle = (span["low"] + span["high"]) / 2
        many = 2 + F.size(F.filter("levels", lambda v: v > middle)) > target
        return F.struct(F.when(many, middle).otherwise(span["low"]).alias("low"), F.when(many, span["high"]).otherwise(middle).alias("high"))

    tolerance = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.lit(0.0).alias("low"), F.col("top").alias("high")), halved)["high"]
    levels = levels.select(*by, tolerance.alias("tolerance"))
    kept = (made.join(levels, by) if by else made.crossJoin(levels)).filter(F.col("level") > F.col("tolerance")).select(*by, F.col("far").alias("p"))
    kept = kept.unionByName(ends.select(*by, F.explode(F.array("a", "b")).alias("p")))
    return kept.select(*by, F.col("p.i").alias(order), F.col("p.x").alias(x), F.col("p.y").alias(y))
