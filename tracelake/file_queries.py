"""Queries over waveform files that are written from ``events`` and read again: only the variables of an expression, only the rows of a window, files of several schemas, and what is known about a file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import windowing as W
from tracelake.plans.charts import chart_type, suggestions
from tracelake.sources import waveform as source
from tracelake.sources.shared import shared_path

_DIGITS = 6
#: Of the last significant digit: more than what the order of a sum changes.
_NUDGE = 1e-4


def _header(variables: list[tuple[str, str]], flags: str, plot: str = "Transient Analysis", scale: str = "lin", more: str = "") -> str:
    listed = "\n".join(f"{k}\t{n}\t{t}" for k, (n, t) in enumerate(variables))
    return f"Title: events\nPlotname: {plot}\nFlags: {flags}\nNo. Variables: {len(variables)}\nNo. Points: {{points}}\nAbscissa: 0 1 {scale}\n{more}Variables:\n{listed}\n"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 1e6
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", seconds.alias("x"), F.col("value").alias("y"), F.length("event_type").cast("double").alias("p"))


_SQL = "WITH e AS (SELECT user_id, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS x, value AS y, CAST(length(event_type) AS DOUBLE) AS p FROM events)"
_VARIABLES = [("Time", "time"), ("V(out)", "voltage"), ("I(R1)", "current"), ("V(in)", "voltage"), ("user", "parameter")]


def _by_user(spark: SparkSession, sf_dir: str, falling: bool = False) -> source.WaveformFile:
    """All events in one file with a step for each user, along growing or falling time."""
    path, sign = shared_path(spark, "users.bin"), -1 if falling else 1
    e = _events(spark, sf_dir).withColumn("in", F.col("y") / 2).withColumn("order", sign * F.col("x")).withColumn("tie", sign * F.col("event_id"))
    source.write_points(e, path, _header(_VARIABLES, "real stepped", more=".alias gain V(out)/V(in)\n"), ["user_id", "order", "tie"], ["x", "y", "p", "in", "user_id"])
    return source.load(spark, path)


def _pruned(spark, sf_dir):
    """Uses V(out) and an alias of V(out) and V(in): neither time nor current is decoded."""
    f = _by_user(spark, sf_dir)
    return f.points.evaluate("V(out)*gain", keep=("point_idx", "step")).toDF("point_idx", "step", "v").withColumn("v", F.round("v", _DIGITS))


def _kept(spark, sf_dir):
    """Evaluated twice with a store of columns: the second time both columns are read from their tables."""
    f = _by_user(spark, sf_dir).stored_in(shared_path(spark, "columns"))
    f.points.evaluate("V(out)*I(R1)", "Time")
    out = f.points.evaluate("Time", "V(out)*I(R1)", keep=("point_idx", "step")).toDF("point_idx", "step", "x", "v")
    return out.withColumns({c: F.round(c, _DIGITS) for c in ("x", "v")})


def _window(falling: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges = (1_100_000.0, 1_000_000.0) if falling else (1_000_000.0, 1_100_000.0)
        out = _by_user(spark, sf_dir, falling).window(*edges).evaluate("I(R1)*V(out)", keep=("point_idx", "step", "step_idx", "x")).toDF("point_idx", "step", "step_idx", "x", "v")
        return out.withColumns({c: F.round(c, _DIGITS) for c in ("x", "v")})

    return run


def _window_sql(sign: str) -> str:
    return f"""{_SQL}, w AS (SELECT *, row_number() OVER (ORDER BY user_id, {sign}x, {sign}event_id) - 1 AS point_idx, dense_rank() OVER (ORDER BY user_id) - 1 AS step, row_number() OVER (PARTITION BY user_id ORDER BY {sign}x, {sign}event_id) - 1 AS step_idx FROM e)
        SELECT point_idx, CAST(step AS INTEGER) AS step, step_idx, round(x, {_DIGITS}) AS x, round(p * y, {_DIGITS}) AS v FROM w WHERE x BETWEEN 1000000 AND 1100000"""


#: Four files: two of one schema, one of another, one of complex rows in octaves.
_KINDS = [
    ([("Time", "time"), ("V(out)", "voltage"), ("user", "parameter")], "real stepped", "Transient Analysis", "lin"),
    ([("Time", "time"), ("V(out)", "voltage"), ("odd", "strange"), ("I(R1)", "current")], "real", "Transient Analysis", "lin"),
    ([("Frequency", "frequency"), ("V(out)", "voltage")], "complex", "AC Analysis", "oct"),
    ([("Time", "time"), ("V(out)", "voltage"), ("user", "parameter")], "real stepped", "Transient Analysis", "lin"),
]


def _folder(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[source.WaveformFile]]:
    folder = shared_path(spark, "folder")
    e = _events(spark, sf_dir)
    for k, (variables, flags, plot, scale) in enumerate(_KINDS):
        own = e.filter(F.pmod("user_id", F.lit(len(_KINDS))) == k)
        if "complex" in flags:
            own = own.select((F.col("event_id") + 1).alias("x"), F.struct(F.col("y").alias("re"), F.col("p").alias("im")).alias("z"))
            source.write_points(own, f"{folder}/run{k}.bin", _header(variables, flags, plot, scale), ["x"], ["x", "z"], True)
        else:
            columns = ["x", "y", "user_id"] if "stepped" in flags else ["x", "y", "p", "y"]
            own = own.toDF("user_id", "event_id", *own.columns[2:])
            source.write_points(own, f"{folder}/run{k}.bin", _header(variables, flags, plot, scale), ["user_id", "x", "event_id"] if "stepped" in flags else ["x", "event_id"], columns)
    return source.load_many(spark, folder)


def _files(spark, sf_dir):
    """A row for each file of a folder: what its header says, how many steps it has and a sum over its rows."""
    files, groups = _folder(spark, sf_dir)
    per_file = []
    for g in groups:
        total = F.sum("v" if not g.header.is_complex else "v.re")
        values = g.points.evaluate("V(out)", keep=("file", "step")).toDF("file", "step", "v")
        per_file.append(values.groupBy("file").agg(F.countDistinct("step").alias("n_steps"), F.round(total, 3).alias("total")))
    sums = per_file[0]
    for more in per_file[1:]:
        sums = sums.unionByName(more)
    return files.join(sums, "file").select(F.regexp_extract("file", "([^/]*)$", 1).alias("file"), "plotname", "n_points", "row_bytes", "n_steps", "total")


def _files_steps(spark, sf_dir):
    """The steps of all files, each file's numbered from 0."""
    _, groups = _folder(spark, sf_dir)
    tables = [g.steps.select(F.regexp_extract("file", "([^/]*)$", 1).alias("file"), "step", "start", "stop", F.round("x_first", _DIGITS).alias("x_first"), F.round("x_last", _DIGITS).alias("x_last")) for g in groups]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _facts(spark, sf_dir):
    """What a chart of the file shows for the expressions that it suggests and some more: unit, axis (the fifth unit has none), chart, and the sum of the values over the file's points."""
    f = _by_user(spark, sf_dir)
    points, x_unit = f.points, f.points.variables[f.x_name.casefold()].unit
    groups = suggestions("«tran V(out) V(nowhere) V(out)» «I(R1)»", points, x_unit)
    shown = [(s.chart, t) for s in groups for t in s.expressions]
    shown += [(chart_type(x_unit), t) for t in ("V(out)*I(R1)", "V(out)/I(R1)", "gain", "Time", "1/Time", "I(R1)/V(out)", "db(V(out))", "V(out)-V(in)", "V(out)+I(R1)", "max(V(out),V(in))", *points.search("v(i"))]
    found = [points.compile(t) for _, t in shown]
    axis = W.axes([c.unit for c in found])
    rows = points.evaluate(*[t for _, t in shown], keep=("step",)).toDF("step", *[f"e{k}" for k in range(len(shown))])
    total = rows.agg(*[F.sum(f"e{k}").alias(f"e{k}") for k in range(len(shown))])
    facts = [F.struct(F.lit(c.text).alias("expression"), F.lit(chart).alias("chart"), F.lit(c.unit).alias("unit"), F.lit(axis[c.unit]).cast("int").alias("axis"), significant(F.col(f"e{k}")).alias("total")) for k, (c, (chart, _)) in enumerate(zip(found, shown, strict=True))]
    return total.select(F.explode(F.array(*facts)).alias("f")).select("f.*")


def significant(c: Column, digits: int = 9) -> Column:
    """Rounded to so many significant digits, halves away from 0 whatever the sum's last bits; infinities have none and give NaN."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    endless = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(endless, float("nan")).when(c == 0, c).otherwise(F.round(c * scale + F.signum(c) * _NUDGE) / scale)


def queries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    step = "row_number() OVER (ORDER BY user_id, x, event_id)"
    facts = [
        ("V(out)", "V", 0, "y"), ("I(R1)", "A", 1, "p"), ("(V(out)*I(R1))", "W", 2, "y * p"), ("(V(out)/I(R1))", "Ω", 3, "y / p"), ("gain", "", None, "y / (y / 2)"), ("Time", "s", None, "x"), ("(1/Time)", "Hz", None, "1 / x"),
        ("(I(R1)/V(out))", "S", None, "p / y"), ("db(V(out))", "dB", None, "20 * log10(abs(y))"), ("(V(out)-V(in))", "V", 0, "y - y / 2"), ("(V(out)+I(R1))", "", None, "y + p"), ("max(V(out),V(in))", "V", 0, "greatest(y, y / 2)"), ("V(in)", "V", 0, "y / 2"),
    ]
    one = " UNION ALL ".join(f"SELECT '{t}' AS expression, 'TRANSIENT' AS chart, '{u}' AS unit, CAST({'NULL' if a is None else a} AS INTEGER) AS axis, sum({v}) AS v FROM e" for t, u, a, v in facts)
    return {
        "file_facts": (_facts, f"{_SQL}, f AS ({one}) SELECT expression, chart, unit, axis, CASE WHEN v = 0 THEN v ELSE round(v * pow(10.0, 8 - floor(log10(abs(v))))) / pow(10.0, 8 - floor(log10(abs(v)))) END AS total FROM f"),
        "file_pruned": (_pruned, f"{_SQL} SELECT {step} - 1 AS point_idx, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS INTEGER) AS step, round(y * (y / (y / 2)), {_DIGITS}) AS v FROM e"),
        "file_kept": (_kept, f"{_SQL} SELECT {step} - 1 AS point_idx, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS INTEGER) AS step, round(x, {_DIGITS}) AS x, round(y * p, {_DIGITS}) AS v FROM e"),
        "file_window": (_window(False), _window_sql("")),
        "file_window_falling": (_window(True), _window_sql("-")),
        "files": (_files, f"""{_SQL} SELECT 'run' || CAST(user_id % 4 AS VARCHAR) || '.bin' AS file, CASE user_id % 4 WHEN 2 THEN 'AC Analysis' ELSE 'Transient Analysis' END AS plotname, count(*) AS n_points,
            CAST(CASE user_id % 4 WHEN 1 THEN 32 ELSE 24 END AS BIGINT) AS row_bytes, CASE WHEN user_id % 4 IN (0, 3) THEN count(DISTINCT user_id) ELSE 1 END AS n_steps, round(sum(y), 3) AS total FROM e GROUP BY user_id % 4"""),
        "files_steps": (_files_steps, f"""{_SQL}, w AS (SELECT user_id % 4 AS k, CASE WHEN user_id % 4 IN (0, 3) THEN user_id ELSE 0 END AS u, CASE user_id % 4 WHEN 2 THEN log2(event_id + 1) ELSE x END AS x, event_id FROM e),
            n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY u, x, event_id) - 1 AS i, dense_rank() OVER (PARTITION BY k ORDER BY u) - 1 AS step FROM w)
            SELECT 'run' || CAST(k AS VARCHAR) || '.bin' AS file, CAST(step AS INTEGER) AS step, min(i) AS start, max(i) + 1 AS stop, round(arg_min(x, i), {_DIGITS}) AS x_first, round(arg_max(x, i), {_DIGITS}) AS x_last FROM n GROUP BY k, step"""),
    }
