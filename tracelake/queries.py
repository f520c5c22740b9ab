"""A query for each operator of the waveform engine over the driver's tables, and the SQL that gives the same rows.

``events`` stand in for a stepped transient (a user is a step), ``lineitem`` for columns of numbers, and two of its columns for complex ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import file_queries
from tracelake.operators import decimate as D
from tracelake.operators import smith, spectral, steps
from tracelake.operators import windowing as W
from tracelake.plans.charts import chart_ranges, chart_series, chart_type, fft_points, suggestions
from tracelake.plans.compiler import Points, Variable, as_column, expand_ac
from tracelake.plans.syntax import canonical, parse
from tracelake.sources import waveform as source

Query = Callable[[SparkSession, str], DataFrame]

#: Line simplification of w (step, step_idx, x, y, n) to 16 points: every segment's farthest point, the level of each split, bisection over levels.
_SIMPLIFIED = """, seg AS (
        SELECT a.step, a.step_idx AS a, a.x AS ax, a.y AS ay, b.step_idx AS b, b.x AS bx, b.y AS b_y, CAST('Infinity' AS DOUBLE) AS least, FALSE AS first
        FROM w a JOIN w b ON a.step = b.step AND a.step_idx = 0 AND b.step_idx = b.n - 1 WHERE a.n > 16
        UNION ALL
        SELECT t.step, h.a, h.ax, h.ay, h.b, h.bx, h.b_y, least(t.d, t.least), h.first
        FROM (SELECT s.step, s.a, s.ax, s.ay, s.b, s.bx, s.b_y, s.least, max(v.d) AS d, arg_max({'i': w.step_idx, 'x': w.x, 'y': w.y}, {'d': v.d, 'i': -w.step_idx}) AS far
              FROM seg s JOIN w ON w.step = s.step AND w.step_idx > s.a AND w.step_idx < s.b,
                   LATERAL (SELECT CASE WHEN s.bx = s.ax AND s.b_y = s.ay THEN sqrt((w.x - s.ax) * (w.x - s.ax) + (w.y - s.ay) * (w.y - s.ay))
                                        ELSE abs((w.x - s.ax) * (s.b_y - s.ay) - (w.y - s.ay) * (s.bx - s.ax)) / sqrt((s.bx - s.ax) * (s.bx - s.ax) + (s.b_y - s.ay) * (s.b_y - s.ay)) END AS d) v
              GROUP BY ALL) t,
             LATERAL (SELECT t.a AS a, t.ax AS ax, t.ay AS ay, t.far.i AS b, t.far.x AS bx, t.far.y AS b_y, TRUE AS first UNION ALL SELECT t.far.i, t.far.x, t.far.y, t.b, t.bx, t.b_y, FALSE) h
        WHERE t.d > 0),
    split AS (SELECT step, b AS at, least AS level FROM seg WHERE first),
    levels AS (SELECT step, list(level) AS levels, max(level) AS top FROM split GROUP BY step),
    bisect AS (
        SELECT step, levels, 0 AS k, CAST(0 AS DOUBLE) AS low, top AS high FROM levels
        UNION ALL
        SELECT step, levels, k + 1, CASE WHEN many THEN (low + high) / 2 ELSE low END, CASE WHEN many THEN high ELSE (low + high) / 2 END
        FROM (SELECT *, 2 + len(list_filter(levels, lambda v: v > (low + high) / 2)) > 16 AS many FROM bisect WHERE k < 24)),
    kept AS (SELECT w.step, w.step_idx, w.x, w.y FROM w LEFT JOIN split ON split.step = w.step AND split.at = w.step_idx LEFT JOIN bisect ON bisect.step = w.step AND bisect.k = 24
             WHERE w.n <= 16 OR w.step_idx = 0 OR w.step_idx = w.n - 1 OR split.level > bisect.high)"""


# Tables as points


def numbers(spark: SparkSession, sf_dir: str) -> Points:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    variables = [Variable("qty", "l_quantity", "A"), Variable("price", "l_extendedprice", "V"), Variable("disc", "l_discount", "s"), Variable("tax", "l_tax", ""), Variable("V(out)", "l_extendedprice", "V"), Variable("V(in)", "l_quantity", "V"), Variable("V(a, b)", "l_tax", "V")]
    functions = [".func half(x) {x/2}", ".func gain(a,b) {20*log10(abs(a/b))}", ".func scaled(x) {half(x)*qty}"]
    return Points.of(df, variables, functions)


def complex_numbers(spark: SparkSession, sf_dir: str) -> Points:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.struct(((F.col("l_quantity") - 25) / 10).alias("re"), ((F.col("l_tax") * 100 - 4) / 5).alias("im")).alias("z"), F.struct((F.col("l_discount") * 10 + 0.5).alias("re"), (F.col("l_quantity") / 50).alias("im")).alias("w"))
    return Points.of(df, [Variable("z", "z", "V", "voltage", True), Variable("w", "w", "A", "current", True)])


def waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step, step_idx, x, y: the events of each user in order of time."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "event_type", "value")
    x = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 1e6
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("step"), i.cast("long").alias("step_idx"), x.alias("x"), F.col("value").alias("y"), F.length("event_type").cast("double").alias("p"))


_W = """WITH w AS (SELECT user_id AS step, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step_idx,
    (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS x, value AS y, CAST(length(event_type) AS DOUBLE) AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
_R = 6
#: Added before rounding where exact halves occur, so that they go the same way whatever the last bit.
_NUDGE = 3.3e-8


def _round(c, digits: int = _R):
    return F.round((F.col(c) if isinstance(c, str) else c) + _NUDGE, digits)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: _round(n) for n in names})


# Expressions: text in the engine's language, and the same in SQL

_Q, _P, _D, _T = "l_quantity", "l_extendedprice", "l_discount", "l_tax"
_NAN, _INF = "CAST('NaN' AS DOUBLE)", "CAST('Infinity' AS DOUBLE)"


def _sql_log(f: str, x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {f}(CASE WHEN {x} > 0 THEN {x} ELSE 1 END) WHEN {x} = 0 THEN -{_INF} ELSE {_NAN} END"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0 ELSE 0.0 END"


_C = f"({_Q} - 25)"
EXPRESSIONS: dict[str, tuple[str, str]] = {
    "fn_abs": ("abs(qty-25)", f"abs({_C})"),
    "fn_mag": ("mag(qty-25)", f"abs({_C})"),
    "fn_sqrt": ("sqrt(qty-25)", f"CASE WHEN {_C} < 0 THEN {_NAN} ELSE sqrt(greatest({_C}, 0)) END"),
    "fn_log": ("log(disc)", _sql_log("ln", _D)),
    "fn_ln": ("ln(qty-25)", _sql_log("ln", _C)),
    "fn_log10": ("log10(disc)", _sql_log("log10", _D)),
    "fn_db": ("db(qty-25)", f"CASE WHEN {_C} = 0 THEN -{_INF} ELSE 20 * log10(CASE WHEN {_C} = 0 THEN 1 ELSE abs({_C}) END) END"),
    "fn_real": ("real(qty)", _Q),
    "fn_imag": ("imag(qty)", "0.0"),
    "fn_conj": ("conj(qty)", _Q),
    "fn_angle": ("angle(qty-25)", f"CASE WHEN {_C} < 0 THEN 180.0 ELSE 0.0 END"),
    "fn_ph": ("ph(qty-25)", f"CASE WHEN {_C} < 0 THEN 180.0 ELSE 0.0 END"),
    "fn_phase": ("phase(qty-25)", f"CASE WHEN {_C} < 0 THEN 180.0 ELSE 0.0 END"),
    **{f"fn_{f}": (f"{f}(qty)", f"{f}({_Q})") for f in ("sin", "cos", "tan")},
    "fn_asin": ("asin(disc*20)", f"CASE WHEN {_D} * 20 > 1 THEN {_NAN} ELSE asin(least({_D} * 20, 1)) END"),
    "fn_arcsin": ("arcsin(disc)", f"asin({_D})"),
    "fn_acos": ("acos(disc*20)", f"CASE WHEN {_D} * 20 > 1 THEN {_NAN} ELSE acos(least({_D} * 20, 1)) END"),
    "fn_arccos": ("arccos(disc)", f"acos({_D})"),
    "fn_atan": ("atan(qty-25)", f"atan({_C})"),
    "fn_arctan": ("arctan(qty)", f"atan({_Q})"),
    "fn_atan2": ("atan2(qty-25, tax)", f"atan2({_C}, {_T})"),
    "fn_sinh": ("sinh(disc)", f"(exp({_D}) - exp(-{_D})) / 2"),
    "fn_cosh": ("cosh(disc)", f"(exp({_D}) + exp(-{_D})) / 2"),
    "fn_tanh": ("tanh(qty-25)", f"CASE WHEN abs({_C}) > 20 THEN sign({_C}) ELSE (exp(2 * {_C}) - 1) / (exp(2 * {_C}) + 1) END"),
    "fn_exp": ("exp(disc)", f"exp({_D})"),
    "fn_sqr": ("sqr(qty)", f"{_Q} * {_Q}"),
    "fn_sign": ("sign(qty-25)", f"CAST(sign({_C}) AS DOUBLE)"),
    "fn_sgn": ("sgn(25-qty)", f"CAST(sign(25 - {_Q}) AS DOUBLE)"),
    "fn_uramp": ("uramp(qty-25)", f"greatest({_C}, 0.0)"),
    "fn_round": ("round(qty/4)", f"CASE WHEN {_Q} / 4 - floor({_Q} / 4) = 0.5 THEN 2 * floor(({_Q} / 4 + 0.5) / 2) ELSE floor({_Q} / 4 + 0.5) END"),
    "fn_floor": ("floor(qty/4-6)", f"floor({_Q} / 4 - 6)"),
    "fn_ceil": ("ceil(qty/4-6)", f"ceil({_Q} / 4 - 6) + 0.0"),
    "fn_int": ("int(qty/4-6)", f"trunc({_Q} / 4 - 6) + 0.0"),
    "fn_pow": ("pow(qty, 2)", f"pow({_Q}, 2)"),
    "fn_pwr": ("pwr(qty-25, 0.5)", f"sqrt(abs({_C}))"),
    "fn_pwrs": ("pwrs(qty-25, 0.5)", f"sign({_C}) * sqrt(abs({_C}))"),
    "fn_min": ("min(qty, 25, price)", f"least({_Q}, 25, {_P})"),
    "fn_min_nan": ("min(qty, 0/(disc-disc))", _NAN),
    "fn_max": ("max(qty, 25)", f"greatest({_Q}, 25)"),
    "fn_limit": ("limit(qty, 10, 20)", f"least(greatest({_Q}, 10), 20)"),
    "op_number": ("1k + 2meg + 3m + qty*0", "2001000.003"),
    "op_constants": ("2*pi*qty + e", f"2 * pi() * {_Q} + exp(1)"),
    "op_plus": ("+qty", _Q),
    "op_minus": ("-qty", f"-{_Q}"),
    "op_not": ("!(qty-25)", _flag(f"{_C} = 0")),
    "op_add": ("qty + tax", f"{_Q} + {_T}"),
    "op_subtract": ("qty - tax", f"{_Q} - {_T}"),
    "op_multiply": ("qty * tax", f"{_Q} * {_T}"),
    "op_divide": ("(qty-25)/disc", f"CASE WHEN {_D} <> 0 THEN {_C} / CASE WHEN {_D} = 0 THEN 1 ELSE {_D} END WHEN {_C} > 0 THEN {_INF} WHEN {_C} < 0 THEN -{_INF} ELSE {_NAN} END"),
    "op_power": ("(qty-25)^2", f"{_C} * {_C}"),
    "op_power_nan": ("(qty-25)**0.5", f"CASE WHEN {_C} < 0 THEN {_NAN} ELSE sqrt(greatest({_C}, 0)) END"),
    "op_precedence": ("-qty^2 + 1/2qty", f"-({_Q} * {_Q}) + 0.5 * {_Q}"),
    "op_equal": ("qty == 25", _flag(f"{_Q} = 25")),
    "op_equal_nan": ("(tax-tax)/(qty-qty) == (tax-tax)/(qty-qty)", "0.0"),
    "op_unequal": ("qty != 25", _flag(f"{_Q} <> 25")),
    "op_less": ("qty < 25", _flag(f"{_Q} < 25")),
    "op_less_equal": ("qty <= 25", _flag(f"{_Q} <= 25")),
    "op_greater": ("qty > 25", _flag(f"{_Q} > 25")),
    "op_greater_equal": ("qty >= 25", _flag(f"{_Q} >= 25")),
    "op_and": ("(qty-25) && disc", _flag(f"{_C} <> 0 AND {_D} <> 0")),
    "op_and_short": ("0 && missing_is_never_read(1) || qty > 3", _flag(f"{_Q} > 3")),
    "op_or": ("(qty-25) || disc", _flag(f"{_C} <> 0 OR {_D} <> 0")),
    "op_ternary": ("qty > 25 ? price : disc", f"CASE WHEN {_Q} > 25 THEN {_P} ELSE {_D} END"),
    "op_ternary_scalar": ("1 ? qty : unknown_name", _Q),
    "op_probe": ("V(out)/V(in)", f"{_P} / {_Q}"),
    "op_probe_difference": ("V(out, in)", f"{_P} - {_Q}"),
    "op_probe_pair": ("V(a, b)", _T),
    "op_probe_ground": ("V(0, out) + V(in, 0)", f"{_Q} - {_P}"),
    "op_user_function": ("scaled(price)", f"{_P} / 2 * {_Q}"),
    "op_user_function_two": ("gain(price, qty)", f"20 * log10(abs({_P} / {_Q}))"),
}

# Complex expressions over z = x + iy (x, y) and w = u + iv; SQL for the real and the imaginary part
_M, _A = "sqrt(x*x + y*y)", "atan2(y, x)"
_NEAR_W, _FAR_W = (f"((sqrt((u+1)*(u+1) + v*v) {sign} sqrt((u-1)*(u-1) + v*v)) / 2)" for sign in "-+")
_HEIGHT_W = f"(CASE WHEN v < 0 THEN -1 ELSE 1 END * ln({_FAR_W} + sqrt(greatest({_FAR_W} * {_FAR_W} - 1, 0))))"
_CH, _SH = "(exp(y) + exp(-y)) / 2", "(exp(y) - exp(-y)) / 2"
_CHX, _SHX = "(exp(x) + exp(-x)) / 2", "(exp(x) - exp(-x)) / 2"
_QW = "(u*u + v*v)"
COMPLEX: dict[str, tuple[str, str, str]] = {
    "complex_add": ("z + w", "x + u", "y + v"),
    "complex_subtract": ("z - w", "x - u", "y - v"),
    "complex_multiply": ("z * w", "x*u - y*v", "x*v + y*u"),
    "complex_divide": ("z / w", f"(x*u + y*v) / {_QW}", f"(y*u - x*v) / {_QW}"),
    "complex_negate": ("-z", "-x + 0.0", "-y + 0.0"),
    "complex_conj": ("conj(z)", "x", "-y + 0.0"),
    "complex_exp": ("exp(z)", "exp(x) * cos(y)", "exp(x) * sin(y)"),
    "complex_log": ("log(w)", "ln(sqrt(u*u + v*v))", "atan2(v, u)"),
    "complex_sqrt": ("sqrt(w)", "sqrt((sqrt(u*u + v*v) + u) / 2)", "sqrt((sqrt(u*u + v*v) - u) / 2)"),
    "complex_sqr": ("sqr(z)", "x*x - y*y", "2*x*y"),
    "complex_sin": ("sin(z)", f"sin(x) * {_CH}", f"cos(x) * {_SH}"),
    "complex_cos": ("cos(z)", f"cos(x) * {_CH}", f"-sin(x) * {_SH}"),
    "complex_sinh": ("sinh(z)", f"{_SHX} * cos(y)", f"{_CHX} * sin(y)"),
    "complex_cosh": ("cosh(z)", f"{_CHX} * cos(y)", f"{_SHX} * sin(y)"),
    "complex_power": ("w ^ 2.5", "exp(2.5 * ln(sqrt(u*u + v*v))) * cos(2.5 * atan2(v, u))", "exp(2.5 * ln(sqrt(u*u + v*v))) * sin(2.5 * atan2(v, u))"),
    "complex_asin": ("asin(w)", f"asin(greatest(-1, least(1, {_NEAR_W})))", _HEIGHT_W),
    "complex_acos": ("acos(w)", f"acos(greatest(-1, least(1, {_NEAR_W})))", f"-{_HEIGHT_W}"),
    "complex_atan": ("atan(w)", "atan2(2 * u, 1 - u*u - v*v) / 2", "ln((u*u + (v+1)*(v+1)) / (u*u + (v-1)*(v-1))) / 4"),
    "complex_tan": ("tan(z)", "sin(2*x) / (cos(2*x) + (exp(2*y) + exp(-2*y)) / 2)", "(exp(2*y) - exp(-2*y)) / 2 / (cos(2*x) + (exp(2*y) + exp(-2*y)) / 2)"),
    "complex_tanh": ("tanh(z)", "(exp(2*x) - exp(-2*x)) / 2 / (cos(2*y) + (exp(2*x) + exp(-2*x)) / 2)", "sin(2*y) / (cos(2*y) + (exp(2*x) + exp(-2*x)) / 2)"),
    "complex_min": ("min(z, w)", "CASE WHEN x < u OR x = u AND y <= v THEN x ELSE u END", "CASE WHEN x < u OR x = u AND y <= v THEN y ELSE v END"),
    "complex_round": ("round(z*3)", "round_even(3 * x, 0) + 0.0", "round_even(3 * y, 0) + 0.0"),
    "complex_ternary": ("real(z) > 0 ? z : w", "CASE WHEN x > 0 THEN x ELSE u END", "CASE WHEN x > 0 THEN y ELSE v END"),
    "complex_max": ("max(z, w)", "CASE WHEN x > u OR x = u AND y >= v THEN x ELSE u END", "CASE WHEN x > u OR x = u AND y >= v THEN y ELSE v END"),
}
REAL_OF_COMPLEX: dict[str, tuple[str, str]] = {
    "complex_abs": ("abs(z)", _M),
    "complex_angle": ("angle(w)", "degrees(atan2(v, u))"),
    "complex_db": ("db(w)", "20 * log10(sqrt(u*u + v*v))"),
    "complex_real": ("real(z)", "x"),
    "complex_imag": ("imag(z)", "y"),
    "complex_equal": ("z == z", "1.0"),
    "complex_less": ("z < w", _flag("x < u")),
    "complex_atan2": ("atan2(z, w)", "atan2(x, u)"),
    "complex_pwr": ("pwr(w, 2)", "u*u + v*v"),
}
_Z = "WITH c AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 10 AS x, (l_tax * 100 - 4) / 5 AS y, l_discount * 10 + 0.5 AS u, l_quantity / 50 AS v FROM lineitem)"


def _expression(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = numbers(spark, sf_dir)
        return points.df.select("l_orderkey", "l_linenumber", _round(as_column(points, text)).alias("v"))

    return run


def _odd_name(text: str) -> Query:
    """Names with bullets and hashes, and network parameters, which are probes where the points have them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        more = [Variable("V(7•x1#2)", "l_quantity", "V"), Variable("S11(port)", "l_tax"), Variable("7•x1", "l_discount")]
        points = numbers(spark, sf_dir)
        points = Points.of(points.df, [*points.variables.values(), *more], [".func z22(x) {x*100}"])
        return points.df.select("l_orderkey", "l_linenumber", _round(as_column(points, text)).alias("v"))

    return run


def _complex(text: str, real: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = complex_numbers(spark, sf_dir)
        v = as_column(points, text)
        parts = [_round(v).alias("v")] if real else [_round(v["re"]).alias("re"), _round(v["im"]).alias("im")]
        return points.df.select("l_orderkey", "l_linenumber", *parts)

    return run


# Order-dependent operators


def _steps_by_parameter(spark, sf_dir):
    w = waveform(spark, sf_dir).withColumnRenamed("step", "file").withColumnRenamed("step_idx", "point_idx")
    points, _ = steps.segment(w, {"p": "p"}, True, ["file"])
    return points.select("file", "point_idx", "step", "step_idx")


def _steps_table(spark, sf_dir):
    w = waveform(spark, sf_dir).withColumnRenamed("step", "file").withColumnRenamed("step_idx", "point_idx")
    _, table = steps.segment(w, {"p": "p"}, True, ["file"])
    return table.select("file", "step", "start", "stop", _round("x_first").alias("x_first"), _round("x_last").alias("x_last"), F.element_at("params", "p").alias("p"))


def _steps_by_reset(spark, sf_dir):
    w = waveform(spark, sf_dir).withColumnRenamed("step", "file").withColumnRenamed("step_idx", "point_idx").withColumn("x", (F.col("point_idx") % 7).cast("double"))
    points, _ = steps.segment(w, None, True, ["file"])
    return points.select("file", "point_idx", "step", "step_idx")


def _unstepped(spark, sf_dir):
    w = waveform(spark, sf_dir).withColumnRenamed("step", "file").withColumnRenamed("step_idx", "point_idx")
    return steps.segment(w, None, False, ["file"])[1].select("file", "step", "start", "stop")


def _extent(spark, sf_dir):
    table = steps.describe(waveform(spark, sf_dir), {}, [], "step_idx")
    return _rounded(steps.extent(table), "left", "right")


def _chosen_steps(spark, sf_dir):
    return _rounded(steps.select_steps(waveform(spark, sf_dir), {1, 2, 3, 5, 8}, inverted=True).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total")), "total")


def _zoom(spark, sf_dir):
    return _rounded(W.zoom(waveform(spark, sf_dir), 86400.0, 864000.0).select("step", "step_idx", "x", "y"), "x", "y")


def _nearest(spark, sf_dir):
    return W.nearest(waveform(spark, sf_dir), 1e6, ["step"])


def _values_at(spark, sf_dir):
    w = waveform(spark, sf_dir)
    named = w.select(F.lit("y").alias("name"), F.lit("V").alias("unit"), "step", "step_idx", "x", "y").unionByName(w.select(F.lit("half").alias("name"), F.lit("A").alias("unit"), "step", "step_idx", "x", (F.col("y") / 2).alias("y")))
    return W.values_at(named, 1e6).select("name", "unit", F.size("values").cast("long").alias("n"), F.array_join(F.transform("values", lambda v: F.format_string("%.3f", v)), ",").alias("listed"))


def _auto_range(spark, sf_dir):
    ranges = W.min_max(waveform(spark, sf_dir), ["step"]).withColumn("unit", F.when(F.col("step") % 2 == 0, "V").otherwise("A"))
    return _rounded(W.auto_range(ranges), "low", "high")


def _min_max(spark, sf_dir):
    return W.min_max(W.finite(waveform(spark, sf_dir).withColumn("y", F.when(F.col("step_idx") == 3, float("inf")).otherwise(F.col("y")))), ["step"])


def _si_text(spark, sf_dir):
    p = numbers(spark, sf_dir)
    return p.df.select("l_orderkey", "l_linenumber", W.si_text(as_column(p, "(qty-25)*10^(round(tax*200)-10)"), F.lit("V")).alias("v"))


def _decimated(method: str, target: int = 16) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(D.decimate(waveform(spark, sf_dir), target, method), "x", "y")

    return run


def _simplified_in_rounds(spark, sf_dir):
    """Every series level by level, as one that is too long for a task."""
    return _rounded(D.decimate(waveform(spark, sf_dir), 16, "rdp", task_rows=0), "x", "y")


def _plot(spark, sf_dir):
    """What a chart shows: an expression from text over the visible range, decimated, without infinities."""
    points = Points.of(waveform(spark, sf_dir), [Variable("Time", "x", "s", "time"), Variable("V(out)", "y", "V", "voltage")])
    drawn = chart_series(points, ["20*log10(abs(V(out)))"], "TRANSIENT", 86400.0, 2e6, 16)
    return _rounded(drawn.select("step", "step_idx", "x", "y"), "x", "y")


def _charted(spark, sf_dir):
    points = Points.of(waveform(spark, sf_dir), [Variable("Time", "x", "s", "time"), Variable("V(out)", "y", "V", "voltage"), Variable("I(R1)", "p", "A", "current")])
    return chart_series(points, ["20*log10(abs(V(out)))", "V(out)", "I(R1)*V(out)"], "TRANSIENT", 86400.0, 2e6, 16)


def _chart(spark, sf_dir):
    return _rounded(_charted(spark, sf_dir).withColumn("dash", F.array_join(F.col("dash").cast("array<string>"), " ")), "x", "y")


def _chart_ranges(spark, sf_dir):
    """M4 keeps the extremes of each bucket; the ranges are those of all visible points where it drops no bucket."""
    points = Points.of(waveform(spark, sf_dir), [Variable("V(out)", "y", "V", "voltage"), Variable("I(R1)", "p", "A", "current")])
    return _rounded(chart_ranges(chart_series(points, ["20*log10(abs(V(out)))", "V(out)", "I(R1)*V(out)"], "TRANSIENT", 86400.0, 2e6)), "low", "high")


_HEADER = """Title: events
Plotname: {plot}
Flags: {flags}
No. Variables: {n}
No. Points: {{points}}
Abscissa: 0 1 {scale}
.alias sum V(out)+V(in)
.func half(x) {{{{x/2}}}}
Variables:
{variables}
"""


def _header(variables: list[tuple[str, str]], flags: str, scale: str = "lin", plot: str = "Transient Analysis") -> str:
    return _HEADER.format(plot=plot, flags=flags, n=len(variables), scale=scale, variables="\n".join(f"{k}\t{n}\t{t}" for k, (n, t) in enumerate(variables)))


def _stepped_file(spark: SparkSession, sf_dir: str) -> source.WaveformFile:
    """All events as one binary file of a step for each user, with a variable of a type that is skipped; then the file as it is loaded."""
    e = waveform(spark, sf_dir).select("step", "step_idx", "x", F.col("y").alias("out"), F.lit(1.0).alias("odd"), (F.col("y") / 2).alias("in"))
    path = source.shared_path(spark, "stepped.bin")
    variables = [("Time", "time"), ("V(out)", "voltage"), ("odd", "strange"), ("V(in)", "voltage"), ("R1", "parameter")]
    source.write_points(e, path, _header(variables, "real stepped"), ["step", "step_idx"], ["x", "out", "odd", "in", "step"])
    return source.load(spark, path)


def _file_stepped(spark, sf_dir):
    f = _stepped_file(spark, sf_dir)
    return _rounded(f.points.evaluate("Time", "half(sum)", keep=("point_idx", "step", "step_idx")).toDF("point_idx", "step", "step_idx", "x", "v"), "x", "v")


def _file_steps(spark, sf_dir):
    table = _stepped_file(spark, sf_dir).steps
    texts = steps.step_table(table).select("step", F.element_at("values", "R1").alias("r1"))
    return _rounded(table.join(texts, "step").select("step", "start", "stop", "x_first", "x_last", "r1"), "x_first", "x_last")


def _file_complex(spark, sf_dir):
    """Complex rows over decades, with the alias that noise runs give to a spectrum."""
    pair = lambda re, im: F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("event_id") + 1).alias("f"), pair(F.col("value"), F.col("event_id") % 7).alias("noise"), pair(1 + F.col("event_id") % 3, F.lit(1)).alias("in"))
    path = source.shared_path(spark, "noise.bin")
    variables = [("Frequency", "frequency"), ("V(onoise_spectrum)", "voltage"), ("V(in)", "voltage")]
    source.write_points(e, path, _header(variables, "complex", "dec", "Noise Spectral Density"), ["event_id"], ["f", "noise", "in"], True)
    out = source.load(spark, path).points.evaluate("V(onoise)/V(in)", keep=("point_idx", "x")).toDF("point_idx", "x", "v")
    return _rounded(out.select("point_idx", "x", "v.re", "v.im"), "x", "re", "im")


def _steps_mixed(spark, sf_dir):
    """Files of which every other one goes back and forth inside its steps, and so is one step."""
    w = waveform(spark, sf_dir).withColumnRenamed("step", "file").withColumnRenamed("step_idx", "point_idx")
    w = w.withColumn("x", F.when(F.col("file") % 2 == 0, F.col("point_idx") % 3).otherwise(F.col("point_idx")).cast("double"))
    points, _ = steps.segment(w, {"p": "p"}, True, ["file"])
    return points.select("file", "point_idx", "step", "step_idx")


def _extent_falling(spark, sf_dir):
    table = steps.describe(waveform(spark, sf_dir).withColumn("x", -F.col("x")), {}, [], "step_idx")
    return _rounded(steps.extent(table), "left", "right")


def _uniform(spark, sf_dir):
    w = waveform(spark, sf_dir).withColumn("x", F.when(F.col("step") % 2 == 0, F.col("step_idx") * 0.25).otherwise(F.col("x")))
    return spectral.uniform(w, ["step"])


def _preview(spark, sf_dir):
    out = spectral.frequency_preview(waveform(spark, sf_dir), ["step"])
    return out.select("step", F.round("df", 12).alias("df"), F.round("nyquist", 12).alias("nyquist"))


def _weights(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.sql import Window

        n = F.count(F.lit(1)).over(Window.partitionBy("step"))
        return waveform(spark, sf_dir).select("step", "step_idx", _round(spectral.window_weight(name, F.col("step_idx"), n)).alias("weight"))

    return run


def _even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waveform(spark, sf_dir).withColumn("x", F.col("step_idx") * 0.001)


def _fft(output: str, window: str = "hanning") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = spectral.fft(_even(spark, sf_dir), ["y"], name=window, output=output)
        return out.select("step", "bin", _round("freq").alias("freq"), _round("y", 5).alias("v"))

    return run


def _fft_waveform(spark, sf_dir):
    """Uneven samples: resampled, then transformed."""
    out = spectral.fft(waveform(spark, sf_dir), ["y"], name="hamming", pad=True, keep_dc=True)
    return out.select("step", "bin", F.round("freq", 9).alias("freq"), _round("y", 5).alias("v"))


def _fft_in_parts(spark, sf_dir):
    """The same, each series in two tasks."""
    out = spectral.fft_in_parts(waveform(spark, sf_dir), ["y"], 2, name="hamming", pad=True, keep_dc=True)
    return out.select("step", "bin", F.round("freq", 9).alias("freq"), _round("y", 5).alias("v"))


def _fft_points(spark, sf_dir):
    points = fft_points(Points.of(_even(spark, sf_dir), [Variable("V(out)", "y", "V")]), ["V(out)"], name="hanning")
    return points.evaluate("Frequency", "FFT(V(out))", keep=("step", "step_idx")).toDF("step", "bin", "freq", "v").select("step", "bin", _round("freq").alias("freq"), _round("v", 5).alias("v"))


def _fft_points_in_parts(spark, sf_dir):
    """The table of points over frequency, each step in four tasks."""
    points = fft_points(Points.of(waveform(spark, sf_dir), [Variable("Time", "x", "s", "time"), Variable("V(out)", "y", "V", "voltage")]), ["V(out)"], parts=4, name="hamming", pad=True, keep_dc=True)
    return points.evaluate("Frequency", "FFT(V(out))", keep=("step", "step_idx")).toDF("step", "bin", "freq", "v").select("step", "bin", F.round("freq", 9).alias("freq"), _round("v", 5).alias("v"))


def _fft_normalised(spark, sf_dir):
    """Amplitudes as shares of each step's largest."""
    out = spectral.fft(_even(spark, sf_dir), ["y"], normalise=True)
    return out.select("step", "bin", _round("freq").alias("freq"), _round("y", 5).alias("v"))


def _resample(spark, sf_dir):
    return _rounded(spectral.resample(waveform(spark, sf_dir), ["step"]).select("step", "step_idx", "x", "y"), "x", "y")


def _thd(spark, sf_dir):
    s = spectral.fft(_even(spark, sf_dir), ["y"], name="rectangular")
    return _rounded(spectral.thd(s.withColumnRenamed("y", "value"), ["step"]), "thd")


def _smith_project(spark, sf_dir):
    df = complex_numbers(spark, sf_dir).df.withColumn("z", F.when(F.col("l_linenumber") == 3, F.struct(F.lit(float("nan")).alias("re"), F.col("z.im").alias("im"))).otherwise(F.col("z")))
    return _rounded(smith.pixels(smith.project(df, "z", ["l_orderkey"], "l_linenumber"), 200.0, 200.0, 180.0), "re", "im", "px", "py")


def _smith_grid(spark, sf_dir):
    return _rounded(smith.grid(spark), "cx", "cy", "radius", "value")


def _smith_trace(spark, sf_dir):
    df = waveform(spark, sf_dir).withColumn("z", F.struct(F.cos("y").alias("re"), F.sin("x").alias("im")))
    return _rounded(smith.trace(df, "z", 200.0, 200.0, 180.0, target=20), "px", "py")


def _step_selector(spark, sf_dir):
    w = waveform(spark, sf_dir).withColumn("step", F.col("step") - 1)
    points = Points.of(w, [Variable("V(out)", "y", "V")], n_steps=1000)
    return _rounded(points.evaluate("V(out)@1 / V(out)@2", keep=("step", "step_idx")).toDF("step", "step_idx", "v"), "v")


def _units(spark, sf_dir):
    points = numbers(spark, sf_dir)
    rows = [(t, points.compile(t).unit) for t in ("qty*price", "price/qty", "qty/price", "price+price", "price+qty", "1/disc", "price^2", "db(price)", "phase(price)", "abs(price)", "min(price,1)", "V(out)", "half(price)", "V(out)-V(in)", "mho*price", "qty > 1 ? price : price")]
    return spark.createDataFrame(rows, "expression string, unit string")


def _canonical(spark, sf_dir):
    texts = ("1+2*3", "a?b:c?d:e", "-2^2", "1/2k", "V(out)@2-V(in)@1", "max(a,b,!c)", "2pi", "a&&b||c")
    return spark.createDataFrame([(t, canonical(parse(t))) for t in texts], "source string, formatted string")


def _suggestions(spark, sf_dir):
    points = numbers(spark, sf_dir)
    found = suggestions("«tran V(out) V(in) V(out)» «V(missing) qty»", points, "Hz")
    return spark.createDataFrame([(k, s.chart, ",".join(s.expressions)) for k, s in enumerate(found)], "k int, chart string, expressions string")


def _chart_types(spark, sf_dir):
    return spark.createDataFrame([(u, chart_type(u)) for u in ("Hz", "s", "V", "")] + [("x", chart_type("s", "FFT"))], "unit string, chart string")


def _expand_ac(spark, sf_dir):
    points = complex_numbers(spark, sf_dir)
    return _rounded(points.evaluate(*expand_ac(points, "w"), keep=("l_orderkey", "l_linenumber")).toDF("l_orderkey", "l_linenumber", "size", "angle"), "size", "angle")


def _search(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in numbers(spark, sf_dir).search("v(")], "name string")


def _axes(spark, sf_dir):
    return spark.createDataFrame(list(W.axes(["V", "A", "V", "W", "s", "Hz", "A"]).items()), "unit string, axis int")


def _style(spark, sf_dir):
    s = W.series_style(F.col("event_id").cast("int"), (F.col("user_id") % 3).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", s["colour"].alias("colour"), F.array_join(s["dash"].cast("array<string>"), " ").alias("dash"))


def _values(rows: list[tuple], names: str) -> str:
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) AS t({names})"


_BUCKETS = """, b AS (SELECT *, CASE WHEN n <= 16 THEN step_idx ELSE step_idx // ((n + {p} - 1) // {p}) END AS b, CASE WHEN n <= 16 THEN n ELSE n // ((n + {p} - 1) // {p}) END AS nb FROM w),
    k AS (SELECT * FROM b WHERE b < nb),
    r AS (SELECT *, row_number() OVER (PARTITION BY step, b ORDER BY y, step_idx) AS lo, row_number() OVER (PARTITION BY step, b ORDER BY y DESC, step_idx) AS hi,
                 row_number() OVER (PARTITION BY step, b ORDER BY step_idx) AS fi, row_number() OVER (PARTITION BY step, b ORDER BY step_idx DESC) AS la FROM k)"""
_DB_Y = f"20 * ({_sql_log('log10', 'abs(y)')})"


def _charted_sql(target: int) -> str:
    """What a chart of three expressions draws (k, step, step_idx, x, y): the visible range, decimated, without infinities."""
    return (
        _W
        + f""", v AS (SELECT step * 10 + k AS step, x, row_number() OVER (PARTITION BY step, k ORDER BY step_idx) - 1 AS step_idx, count(*) OVER (PARTITION BY step, k) AS n,
            CASE k WHEN 0 THEN {_DB_Y} WHEN 1 THEN y ELSE p * y END AS y FROM w, range(0, 3) AS t(k) WHERE x BETWEEN 86400 AND 2e6)"""
        + _BUCKETS.format(p=target // 4).replace("FROM w)", "FROM v)", 1).replace("n <= 16", f"n <= {target}")
        + ", d AS (SELECT step % 10 AS k, step // 10 AS step, step_idx, x, y FROM r WHERE (lo = 1 OR hi = 1 OR fi = 1 OR la = 1) AND NOT isinf(y))"
    )


_DFT = """, m AS (SELECT step, step_idx, n, {sample} AS y FROM w JOIN (SELECT step, avg(y) AS mean FROM w GROUP BY step) USING (step)),
    f AS (SELECT m.step, n, k AS bin, sum(y * {weight} * cos(2 * pi() * ((k * step_idx) % n) / n)) * 2 / sum({weight}) AS re, -sum(y * {weight} * sin(2 * pi() * ((k * step_idx) % n) / n)) * 2 / sum({weight}) AS im
          FROM m, LATERAL (SELECT unnest(range(0, n // 2 + 1)) AS k) GROUP BY m.step, n, k),
    a AS (SELECT *, bin / (n * 0.001) AS freq, sqrt(re * re + im * im) / CASE WHEN bin = 0 OR n % 2 = 0 AND bin = n // 2 THEN 2 ELSE 1 END AS amount FROM f)"""
_HANN = "(0.5 - 0.5 * cos(2 * pi() * step_idx / (n - 1)))"
_WEIGHTS = {"rectangular": "1.0", "hamming": "0.54 - 0.46 * cos(2 * pi() * step_idx / (n - 1))", "hanning": "0.5 - 0.5 * cos(2 * pi() * step_idx / (n - 1))", "blackman": "0.42 - 0.5 * cos(2 * pi() * step_idx / (n - 1)) + 0.08 * cos(4 * pi() * step_idx / (n - 1))"}
_PSTEPS = """, c AS (SELECT step AS file, step_idx AS point_idx, x, p, coalesce(p <> lag(p) OVER (PARTITION BY step ORDER BY step_idx), false) AS s FROM w),
    g AS (SELECT *, CAST(sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY point_idx) AS INTEGER) AS step FROM c)"""

_PHASE_SQL = _W + _DFT.format(sample="y - mean", weight=_HANN) + f" SELECT step, bin, round(freq + {_NUDGE}, {_R}) AS freq, round(CASE WHEN bin = 0 OR n % 2 = 0 AND bin = n // 2 THEN CASE WHEN re < 0 THEN 180 ELSE 0 END ELSE degrees(atan2(im, re)) END + {_NUDGE}, 5) AS v FROM a"
_RESAMPLED = """, e AS (SELECT step, min(x) AS a, max(x) AS b, max(n) AS n FROM w GROUP BY step),
        q AS (SELECT step, k AS step_idx, CASE WHEN k = n - 1 THEN b ELSE a + k * ((b - a) / (n - 1)) END AS x FROM e, LATERAL (SELECT unnest(range(0, n)) AS k)),
        s AS (SELECT step, x, y, lead(x) OVER o AS x2, lead(y) OVER o AS y2 FROM w WINDOW o AS (PARTITION BY step ORDER BY step_idx)),
        j AS (SELECT q.step, q.step_idx, q.x, s.x AS x1, s.y AS y1, s.x2, s.y2 FROM q ASOF JOIN s ON q.step = s.step AND q.x >= s.x)"""
_FILE_W = """WITH w AS (SELECT CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS INTEGER) AS step, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step_idx, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS point_idx,
    (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS x, value AS y, CAST(user_id AS DOUBLE) AS p FROM events)"""
_PADDED_SQL = _W + _RESAMPLED + f""", r AS (SELECT j.step, j.step_idx, n, a, b, CASE WHEN x2 IS NULL OR x = x1 THEN y1 ELSE y1 + (x - x1) * ((y2 - y1) / (x2 - x1)) END AS y FROM j JOIN e USING (step) WHERE n > 1),
        s2 AS (SELECT *, CAST(pow(2, ceil(log2(n))) AS BIGINT) AS size, 0.54 - 0.46 * cos(2 * pi() * step_idx / (n - 1)) AS weight FROM r),
        f AS (SELECT step, n, size, a, b, k AS bin, sum(y * weight * cos(2 * pi() * ((k * step_idx) % size) / size)) * 2 / sum(weight) AS re, -sum(y * weight * sin(2 * pi() * ((k * step_idx) % size) / size)) * 2 / sum(weight) AS im
              FROM s2, LATERAL (SELECT unnest(range(0, size // 2 + 1)) AS k) GROUP BY step, n, size, a, b, k)
        SELECT step, bin, round(bin / (size * ((b - a) / (n - 1))), 9) AS freq, round(sqrt(re * re + im * im) / CASE WHEN bin = 0 OR bin = size // 2 THEN 2 ELSE 1 END + {_NUDGE}, 5) AS v FROM f"""

OPERATORS: dict[str, tuple[Query, str | None]] = {
    "steps_by_parameter": (_steps_by_parameter, _W + _PSTEPS + " SELECT file, point_idx, step, point_idx - min(point_idx) OVER (PARTITION BY file, step) AS step_idx FROM g"),
    "steps_table": (_steps_table, _W + _PSTEPS + f" SELECT file, step, min(point_idx) AS start, max(point_idx) + 1 AS stop, round(arg_min(x, point_idx) + {_NUDGE}, {_R}) AS x_first, round(arg_max(x, point_idx) + {_NUDGE}, {_R}) AS x_last, arg_min(p, point_idx) AS p FROM g GROUP BY file, step"),
    "steps_by_reset": (_steps_by_reset, _W + """ SELECT step AS file, step_idx AS point_idx, CAST(CASE WHEN n % 7 = 0 AND (n - 1) % 7 >= 0 THEN step_idx // 7 ELSE 0 END AS INTEGER) AS step, CASE WHEN n % 7 = 0 THEN step_idx % 7 ELSE step_idx END AS step_idx FROM w"""),
    "steps_unstepped": (_unstepped, _W + " SELECT step AS file, CAST(0 AS INTEGER) AS step, min(step_idx) AS start, max(step_idx) + 1 AS stop FROM w GROUP BY step"),
    "steps_extent": (_extent, _W + f", s AS (SELECT step, arg_min(x, step_idx) AS a, arg_max(x, step_idx) AS b FROM w GROUP BY step) SELECT true AS ascending, round(min(a) + {_NUDGE}, {_R}) AS left, round(max(b) + {_NUDGE}, {_R}) AS right FROM s"),
    "steps_selected": (_chosen_steps, _W + f" SELECT step, count(*) AS n, round(sum(y) + {_NUDGE}, {_R}) AS total FROM w WHERE step NOT IN (1, 2, 3, 5, 8) GROUP BY step"),
    "zoom_slice": (_zoom, _W + f" SELECT step, step_idx, round(x + {_NUDGE}, {_R}) AS x, round(y + {_NUDGE}, {_R}) AS y FROM w WHERE x BETWEEN 86400 AND 864000"),
    "nearest_sample": (_nearest, _W + ", r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY abs(x - 1e6), step_idx) AS k FROM w) SELECT step, y AS value FROM r WHERE k = 1"),
    "values_at_x": (_values_at, _W + ", r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY abs(x - 1e6), step_idx) AS k FROM w), s AS (SELECT 'y' AS name, 'V' AS unit, step, y FROM r WHERE k = 1 UNION ALL SELECT 'half', 'A', step, y / 2 FROM r WHERE k = 1) SELECT name, unit, count(*) AS n, string_agg(format('{:.3f}', y), ',' ORDER BY step) AS listed FROM s GROUP BY name, unit"),
    "auto_range": (_auto_range, _W + f", u AS (SELECT CASE WHEN step % 2 = 0 THEN 'V' ELSE 'A' END AS unit, min(y) AS a, max(y) AS b FROM w GROUP BY ALL) SELECT unit, round(min(a) - 0.03 * (max(b) - min(a)) + {_NUDGE}, {_R}) AS low, round(max(b) + 0.03 * (max(b) - min(a)) + {_NUDGE}, {_R}) AS high FROM u GROUP BY unit"),
    "finite_min_max": (_min_max, _W + " SELECT step, min(y) AS y_min, max(y) AS y_max FROM w WHERE step_idx <> 3 GROUP BY step"),
    "decimate_none": (_decimated("none"), _W + f" SELECT step, step_idx, round(x + {_NUDGE}, {_R}) AS x, round(y + {_NUDGE}, {_R}) AS y FROM w"),
    "decimate_nth": (_decimated("nth"), _W + f", g AS (SELECT DISTINCT step, CASE WHEN k = 15 THEN n - 1 ELSE CAST(floor(k * ((n - 1) / 15)) AS BIGINT) END AS step_idx FROM (SELECT DISTINCT step, n FROM w WHERE n > 16), range(0, 16) AS t(k)) SELECT step, step_idx, round(x + {_NUDGE}, {_R}) AS x, round(y + {_NUDGE}, {_R}) AS y FROM w WHERE n <= 16 OR (step, step_idx) IN (SELECT step, step_idx FROM g)"),
    "decimate_min_max": (_decimated("min_max"), _W + _BUCKETS.format(p=8) + f" SELECT step, step_idx, round(x + {_NUDGE}, {_R}) AS x, round(y + {_NUDGE}, {_R}) AS y FROM r WHERE lo = 1 OR hi = 1"),
    "decimate_m4": (_decimated("m4"), _W + _BUCKETS.format(p=4) + f" SELECT step, step_idx, round(x + {_NUDGE}, {_R}) AS x, round(y + {_NUDGE}, {_R}) AS y FROM r WHERE lo = 1 OR hi = 1 OR fi = 1 OR la = 1"),
    "decimate_average": (_decimated("average"), _W + f", b AS (SELECT *, CASE WHEN n <= 16 THEN step_idx ELSE step_idx // ((n + 15) // 16) END AS b, CASE WHEN n <= 16 THEN n ELSE n // ((n + 15) // 16) END AS nb FROM w) SELECT step, b AS step_idx, round(avg(x) + {_NUDGE}, {_R}) AS x, round(avg(y) + {_NUDGE}, {_R}) AS y FROM b WHERE b < nb GROUP BY step, b"),
    "decimate_lttb": (_decimated("lttb"), _W.replace("WITH", "WITH RECURSIVE", 1) + f""", e AS (SELECT DISTINCT step, n, k, least(CAST(floor(k * ((n - 2) / 14)) AS BIGINT) + 1, n - 1) AS at FROM w, range(0, 16) AS t(k) WHERE n > 16),
        c AS (SELECT a.step, a.k, a.at AS lo, b.at AS hi, z.at AS after, avg(w.x) AS cx, avg(w.y) AS cy FROM e a JOIN e b ON b.step = a.step AND b.k = a.k + 1 JOIN e z ON z.step = a.step AND z.k = least(a.k + 2, 15)
              LEFT JOIN w ON w.step = a.step AND w.step_idx >= b.at AND w.step_idx < z.at WHERE a.k < 14 GROUP BY ALL),
        r AS (SELECT step, CAST(0 AS BIGINT) AS k, step_idx, x, y FROM w WHERE n > 16 AND step_idx = 0
              UNION ALL
              SELECT r.step, r.k + 1, arg_max(w.step_idx, rank), arg_max(w.x, rank), arg_max(w.y, rank)
              FROM r JOIN c ON c.step = r.step AND c.k = r.k JOIN w ON w.step = r.step AND w.step_idx >= c.lo AND w.step_idx < greatest(c.hi, c.lo + 1),
                   LATERAL (SELECT {{'a': CASE WHEN c.after <= c.hi THEN 0.0 ELSE abs((c.cx - r.x) * (w.y - r.y) - (c.cy - r.y) * (w.x - r.x)) END, 'i': -w.step_idx}} AS rank) GROUP BY r.step, r.k)
        SELECT step, step_idx, round(x + {_NUDGE}, {_R}) AS x, round(y + {_NUDGE}, {_R}) AS y FROM (SELECT step, step_idx, x, y FROM r UNION SELECT step, step_idx, x, y FROM w WHERE n <= 16 OR step_idx = n - 1)"""),
    "name_bullet": (_odd_name("2*V(7•x1#2) + 7•x1"), f"SELECT l_orderkey, l_linenumber, round(2 * l_quantity + l_discount + {_NUDGE}, {_R}) AS v FROM lineitem"),
    "network_probe": (_odd_name("s11(Port) + z22(qty)"), f"SELECT l_orderkey, l_linenumber, round(l_tax + l_quantity * 100 + {_NUDGE}, {_R}) AS v FROM lineitem"),
    "decimate_rdp": (_decimated("rdp"), _W.replace("WITH", "WITH RECURSIVE", 1) + _SIMPLIFIED + f" SELECT step, step_idx, round(x + {_NUDGE}, {_R}) AS x, round(y + {_NUDGE}, {_R}) AS y FROM kept"),
    "decimate_rdp_in_rounds": (_simplified_in_rounds, _W.replace("WITH", "WITH RECURSIVE", 1) + _SIMPLIFIED + f" SELECT step, step_idx, round(x + {_NUDGE}, {_R}) AS x, round(y + {_NUDGE}, {_R}) AS y FROM kept"),
    "decimate_m4_trimmed": (_decimated("m4", 3), _W + _BUCKETS.format(p=1).replace("16", "3") + f""", t AS (SELECT step, step_idx, x, y, row_number() OVER (PARTITION BY step ORDER BY step_idx) AS i, count(*) OVER (PARTITION BY step) AS m FROM r WHERE lo = 1 OR hi = 1 OR fi = 1 OR la = 1)
        SELECT step, step_idx, round(x + {_NUDGE}, {_R}) AS x, round(y + {_NUDGE}, {_R}) AS y FROM t WHERE m <= 3 OR i IN (1, 2, m)"""),
    "plot_series": (_plot, _W + f", v AS (SELECT step, x, {_DB_Y} AS y, row_number() OVER (PARTITION BY step ORDER BY step_idx) - 1 AS step_idx, count(*) OVER (PARTITION BY step) AS n FROM w WHERE x BETWEEN 86400 AND 2e6)" + _BUCKETS.format(p=4).replace("FROM w)", "FROM v)", 1) + f" SELECT step, step_idx, round(x + {_NUDGE}, {_R}) AS x, round(y + {_NUDGE}, {_R}) AS y FROM r WHERE (lo = 1 OR hi = 1 OR fi = 1 OR la = 1) AND NOT isinf(y)"),
    "plot_chart": (_chart, _charted_sql(16) + f"""
        SELECT CASE k WHEN 0 THEN '(20*log10(abs(V(out))))' WHEN 1 THEN 'V(out)' ELSE '(I(R1)*V(out))' END AS series, CASE k WHEN 0 THEN '' WHEN 1 THEN 'V' ELSE 'W' END AS unit, CAST(k AS INTEGER) AS axis, CAST(k AS INTEGER) AS colour,
               CASE WHEN step > 0 THEN '3 ' || CAST(step + 1 AS VARCHAR) ELSE '' END AS dash, step, step_idx, round(x + {_NUDGE}, {_R}) AS x, round(y + {_NUDGE}, {_R}) AS y FROM d"""),
    "plot_ranges": (_chart_ranges, _charted_sql(W.draw_target()) + f"""
        SELECT CASE k WHEN 0 THEN '' WHEN 1 THEN 'V' ELSE 'W' END AS unit, round(min(y) - 0.03 * (max(y) - min(y)) + {_NUDGE}, {_R}) AS low, round(max(y) + 0.03 * (max(y) - min(y)) + {_NUDGE}, {_R}) AS high FROM d GROUP BY k"""),
    "file_stepped": (_file_stepped, _FILE_W + f" SELECT point_idx, step, step_idx, round(x + {_NUDGE}, {_R}) AS x, round((y + y / 2) / 2 + {_NUDGE}, {_R}) AS v FROM w"),
    "file_steps": (_file_steps, _FILE_W + f" SELECT step, min(point_idx) AS start, max(point_idx) + 1 AS stop, round(min(x) + {_NUDGE}, {_R}) AS x_first, round(max(x) + {_NUDGE}, {_R}) AS x_last, CAST(min(p) AS VARCHAR) AS r1 FROM w GROUP BY step"),
    "file_complex": (_file_complex, f"""WITH w AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS point_idx, log10(event_id + 1) AS x, value AS a, CAST(event_id % 7 AS DOUBLE) AS b, 1.0 + event_id % 3 AS u, 1.0 AS v FROM events)
        SELECT point_idx, round(x + {_NUDGE}, {_R}) AS x, round((a * u + b * v) / (u * u + v * v) + {_NUDGE}, {_R}) AS re, round((b * u - a * v) / (u * u + v * v) + {_NUDGE}, {_R}) AS im FROM w"""),
    "steps_mixed": (_steps_mixed, _W + """, c AS (SELECT step AS file, step_idx AS point_idx, CASE WHEN step % 2 = 0 THEN step_idx % 3 ELSE step_idx END AS x, p FROM w),
        d AS (SELECT *, coalesce(p <> lag(p) OVER o, false) AS s, x - lag(x) OVER o AS m FROM c WINDOW o AS (PARTITION BY file ORDER BY point_idx)),
        g AS (SELECT *, CAST(sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY point_idx) AS INTEGER) AS g FROM d),
        b AS (SELECT file, coalesce(bool_or(NOT s AND m > 0), false) AND coalesce(bool_or(NOT s AND m < 0), false) AS bad FROM g GROUP BY file)
        SELECT file, point_idx, CASE WHEN bad THEN 0 ELSE g END AS step, CASE WHEN bad THEN point_idx ELSE point_idx - min(point_idx) OVER (PARTITION BY file, g) END AS step_idx FROM g JOIN b USING (file)"""),
    "steps_extent_falling": (_extent_falling, _W + f", s AS (SELECT step, arg_min(x, step_idx) AS a, arg_max(x, step_idx) AS b FROM w GROUP BY step) SELECT false AS ascending, round(max(-a) + {_NUDGE}, {_R}) AS left, round(min(-b) + {_NUDGE}, {_R}) AS right FROM s"),
    "is_uniform": (_uniform, _W + ", e AS (SELECT step, step_idx, CASE WHEN step % 2 = 0 THEN step_idx * 0.25 ELSE x END AS x FROM w), d AS (SELECT step, step_idx, x - lag(x) OVER (PARTITION BY step ORDER BY step_idx) AS d FROM e), g AS (SELECT step, d, first_value(d) OVER (PARTITION BY step ORDER BY step_idx) AS d0, max(abs(d)) OVER (PARTITION BY step) AS m FROM d WHERE d IS NOT NULL) SELECT step, bool_and(abs(d - d0) <= greatest(1e-12, 2.220446049250313e-16 * greatest(m, 1) * 10) + 1e-3 * abs(d0)) AS uniform FROM g GROUP BY step"),
    "frequency_preview": (_preview, _W + " SELECT step, round((count(*) - 1) / (max(x) - min(x)) / count(*), 12) AS df, round((count(*) - 1) / (max(x) - min(x)) / 2, 12) AS nyquist FROM w GROUP BY step"),
    **{f"window_{k}": (_weights(k), _W + f" SELECT step, step_idx, round({v} + {_NUDGE}, {_R}) AS weight FROM w") for k, v in _WEIGHTS.items()},
    "fft_magnitude": (_fft("magnitude"), _W + _DFT.format(sample="y - mean", weight=_HANN) + f" SELECT step, bin, round(freq + {_NUDGE}, {_R}) AS freq, round(amount + {_NUDGE}, 5) AS v FROM a"),
    "fft_rectangular": (_fft("magnitude", "rectangular"), _W + _DFT.format(sample="y - mean", weight="1.0") + f" SELECT step, bin, round(freq + {_NUDGE}, {_R}) AS freq, round(amount + {_NUDGE}, 5) AS v FROM a"),
    "fft_db": (_fft("db"), _W + _DFT.format(sample="y - mean", weight=_HANN) + f" SELECT step, bin, round(freq + {_NUDGE}, {_R}) AS freq, round(20 * log10(greatest(amount, 1e-300)) + {_NUDGE}, 5) AS v FROM a"),
    "fft_phase": (_fft("phase"), _PHASE_SQL),
    "fft_db_whole": (_fft("db"), _W + _DFT.format(sample="y - mean", weight=_HANN) + f" SELECT step, bin, round(freq + {_NUDGE}, {_R}) AS freq, round(20 * log10(greatest(amount, 1e-300)) + {_NUDGE}, 5) AS v FROM a"),
    "fft_phase_whole": (_fft("phase"), _PHASE_SQL),
    "fft_waveform": (_fft_waveform, _PADDED_SQL),
    "fft_in_parts": (_fft_in_parts, _PADDED_SQL),
    "fft_points_in_parts": (_fft_points_in_parts, _PADDED_SQL),
    "fft_normalised": (_fft_normalised, _W + _DFT.format(sample="y - mean", weight=_HANN) + f" SELECT step, bin, round(freq + {_NUDGE}, {_R}) AS freq, round(amount / max(amount) OVER (PARTITION BY step) + {_NUDGE}, 5) AS v FROM a"),
    "fft_points": (_fft_points, _W + _DFT.format(sample="y - mean", weight=_HANN) + f" SELECT step, bin, round(freq + {_NUDGE}, {_R}) AS freq, round(amount + {_NUDGE}, 5) AS v FROM a"),
    "fft_points_whole": (_fft_points, _W + _DFT.format(sample="y - mean", weight=_HANN) + f" SELECT step, bin, round(freq + {_NUDGE}, {_R}) AS freq, round(amount + {_NUDGE}, 5) AS v FROM a"),
    "resample_uniform": (_resample, _W + _RESAMPLED + f"""
        SELECT step, step_idx, round(x + {_NUDGE}, {_R}) AS x, round(CASE WHEN x2 IS NULL OR x = x1 THEN y1 ELSE y1 + (x - x1) * ((y2 - y1) / (x2 - x1)) END + {_NUDGE}, {_R}) AS y FROM j"""),
    "thd": (_thd, _W + _DFT.format(sample="y - mean", weight="1.0") + f""", t AS (SELECT step, arg_max(freq, {{'a': amount, 'i': -bin}}) AS f1, max(amount) AS a1 FROM a WHERE bin > 0 GROUP BY step),
        z AS (SELECT step, max(freq) AS top, max(freq) FILTER (WHERE bin = 1) / 2 AS tol FROM a GROUP BY step),
        h AS (SELECT t.step, f1, a1, k, tol FROM t JOIN z USING (step), range(2, 6) AS r(k) WHERE k * f1 <= top + 1e-9 * top),
        v AS (SELECT h.step, h.k, coalesce(max(amount) FILTER (WHERE abs(freq - k * f1) <= tol), arg_min(amount, {{'d': abs(freq - k * f1), 'b': bin}}) FILTER (WHERE abs(freq - k * f1) <= 2 * tol)) AS v FROM h JOIN a USING (step) GROUP BY h.step, h.k)
        SELECT t.step, round(sqrt(coalesce(sum(v * v), 0)) / a1 + {_NUDGE}, {_R}) AS thd FROM t LEFT JOIN v USING (step) GROUP BY t.step, a1"""),
    "smith_project": (_smith_project, _Z + f" SELECT l_orderkey, l_linenumber, round(x + {_NUDGE}, {_R}) AS re, round(y + {_NUDGE}, {_R}) AS im, round(200 + x * 180 + {_NUDGE}, {_R}) AS px, round(200 - y * 180 + {_NUDGE}, {_R}) AS py FROM c WHERE l_linenumber <> 3"),
    "smith_grid": (_smith_grid, f"SELECT 'r' AS kind, r AS value, round(r / (1 + r) + {_NUDGE}, {_R}) AS cx, 0.0 AS cy, round(1 / (1 + r) + {_NUDGE}, {_R}) AS radius FROM (VALUES (0.0::DOUBLE), (0.2), (0.5), (1.0), (2.0), (5.0)) AS t(r) UNION ALL SELECT 'x', s * x, 1.0, round(1 / (s * x) + {_NUDGE}, {_R}), round(1 / x + {_NUDGE}, {_R}) FROM (VALUES (0.2::DOUBLE), (0.5), (1.0), (2.0), (5.0)) AS t(x), (VALUES (1.0::DOUBLE), (-1.0)) AS u(s)"),
    "smith_trace": (_smith_trace, _W.replace("WITH w", "WITH RECURSIVE e", 1) + ", w AS (SELECT step, step_idx, 200 + cos(y) * 180 AS x, 200 - sin(x) * 180 AS y, n FROM e)" + _SIMPLIFIED.replace("16", "20") + f" SELECT step, step_idx, round(x + {_NUDGE}, {_R}) AS px, round(y + {_NUDGE}, {_R}) AS py FROM kept"),
    "step_selector": (_step_selector, _W + f" SELECT w.step - 1 AS step, w.step_idx, round(a.y / b.y + {_NUDGE}, {_R}) AS v FROM w LEFT JOIN w a ON a.step = 1 AND a.step_idx = w.step_idx LEFT JOIN w b ON b.step = 2 AND b.step_idx = w.step_idx"),
    "si_format": (_si_text, f"""WITH v AS (SELECT l_orderkey, l_linenumber, {_C} * pow(10.0, round_even({_T} * 200, 0) - 10) AS v FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN abs(v) >= 1e9 THEN format('{{:.2f}} GV', v / 1e9) WHEN abs(v) >= 1e6 THEN format('{{:.2f}} MV', v / 1e6) WHEN abs(v) >= 1e3 THEN format('{{:.2f}} kV', v / 1e3) WHEN abs(v) >= 1 THEN format('{{:.2f}} V', v)
        WHEN abs(v) >= 1e-3 THEN format('{{:.2f}} mV', v * 1e3) WHEN abs(v) >= 1e-6 THEN format('{{:.2f}} µV', v * 1e6) WHEN abs(v) >= 1e-9 THEN format('{{:.2f}} nV', v * 1e9) WHEN abs(v) >= 1e-12 THEN format('{{:.2f}} pV', v * 1e12) WHEN abs(v) >= 1e-15 THEN format('{{:.2f}} fV', v * 1e15) ELSE '0 V' END AS v FROM v"""),
    "units": (_units, _values([("qty*price", "W"), ("price/qty", "Ω"), ("qty/price", "S"), ("price+price", "V"), ("price+qty", ""), ("1/disc", "Hz"), ("price^2", ""), ("db(price)", "dB"), ("phase(price)", "°"), ("abs(price)", "V"), ("min(price,1)", "V"), ("V(out)", "V"), ("half(price)", "V"), ("V(out)-V(in)", "V"), ("mho*price", "A"), ("qty > 1 ? price : price", "V")], "expression, unit")),
    "canonical_text": (_canonical, _values([("1+2*3", "(1+(2*3))"), ("a?b:c?d:e", "(a?b:(c?d:e))"), ("-2^2", "-(2^2)"), ("1/2k", "((1/2)*k)"), ("V(out)@2-V(in)@1", "(V(out)@2-V(in)@1)"), ("max(a,b,!c)", "max(a,b,!c)"), ("2pi", "(2*pi)"), ("a&&b||c", "((a&&b)||c)")], "source, formatted")),
    "plot_suggestions": (_suggestions, _values([(0, "TRANSIENT", "V(out),V(in)"), (1, "AC", "qty")], "k, chart, expressions")),
    "chart_type": (_chart_types, _values([("Hz", "AC"), ("s", "TRANSIENT"), ("V", "DC"), ("", "DC"), ("x", "FFT")], "unit, chart")),
    "expand_ac": (_expand_ac, _Z + f" SELECT l_orderkey, l_linenumber, round(20 * log10(sqrt(u*u + v*v)) + {_NUDGE}, {_R}) AS size, round(degrees(atan2(v, u)) + {_NUDGE}, {_R}) AS angle FROM c"),
    "search_expressions": (_search, _values([("V(out)",), ("V(in)",), ("V(a, b)",)], "name")),
    "axes": (_axes, _values([("V", 0), ("A", 1), ("W", 2), ("s", 3), ("Hz", None)], "unit, axis")),
    "series_style": (_style, "SELECT event_id, CAST(event_id % 14 AS INTEGER) AS colour, CASE WHEN user_id % 3 > 0 THEN '3 ' || CAST(user_id % 3 + 1 AS VARCHAR) ELSE '' END AS dash FROM events"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plot(spark, sf_dir)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {k: _expression(t) for k, (t, _) in EXPRESSIONS.items()}
    out |= {k: _complex(t, False) for k, (t, *_) in COMPLEX.items()}
    out |= {k: _complex(t, True) for k, (t, _) in REAL_OF_COMPLEX.items()}
    return out | {k: q for k, (q, _) in OPERATORS.items()} | {k: q for k, (q, _) in file_queries.queries().items()}


def oracle_sql() -> dict[str, str]:
    out = {k: f"SELECT l_orderkey, l_linenumber, round(CAST({s} AS DOUBLE) + {_NUDGE}, {_R}) AS v FROM lineitem" for k, (_, s) in EXPRESSIONS.items()}
    out |= {k: f"{_Z} SELECT l_orderkey, l_linenumber, round({a} + {_NUDGE}, {_R}) AS re, round({b} + {_NUDGE}, {_R}) AS im FROM c" for k, (_, a, b) in COMPLEX.items()}
    out |= {k: f"{_Z} SELECT l_orderkey, l_linenumber, round({s} + {_NUDGE}, {_R}) AS v FROM c" for k, (_, s) in REAL_OF_COMPLEX.items()}
    return out | {k: s for k, (_, s) in [*OPERATORS.items(), *file_queries.queries().items()] if s}
