"""Queries over values whose logarithms and quotients aren't finite, and harmonics on the last bin."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake import file_queries
from tracelake import queries as Q
from tracelake.operators import spectral


def value(x):
    return f"{x + 0.0:.6f}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def with_zeros(sf_dir, tmp_path_factory):
    """The events table with a value of 0 in every seventh row."""
    folder = str(tmp_path_factory.mktemp("zeros"))
    duckdb.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END AS value) FROM '{sf_dir}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["file_facts", "plot_series", "plot_chart", "plot_ranges"])
def test_values_of_zero(spark, with_zeros, name):
    df = Q.queries()[name](spark, with_zeros)
    rows = df.collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{with_zeros}/events.parquet'")
    found = db.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(tuple(value(r[c]) for c in columns) for r in rows) == sorted(tuple(value(x) for x in r) for r in found.fetchall())
    if name != "file_facts":
        assert not any(isinstance(x, float) and np.isinf(x) for r in rows for x in r)


def test_significant_digits(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 2493415.4149999996), (2, 2493415.4150000005), (3, -2493415.4149999996), (4, float("inf")), (5, float("nan"))], "k int, v double")
    out = [r["v"] for r in df.select("k", file_queries.significant(F.col("v")).alias("v")).orderBy("k").collect()]
    assert out[:4] == [0.0, 2493415.42, 2493415.42, -2493415.42]
    assert np.isnan(out[4]) and np.isnan(out[5])


def test_a_harmonic_on_the_last_bin_counts(spark):
    """Whatever way its frequency is rounded."""
    for low in (0.0, 1e-13):
        freq = np.arange(37) / 0.072
        freq[36] -= low
        rows = [(0, k, float(f), {12: 1.0, 36: 0.5}.get(k, 0.0)) for k, f in enumerate(freq)]
        s = spark.createDataFrame(rows, "step int, bin bigint, freq double, value double")
        assert spectral.thd(s, ["step"]).first()["thd"] == pytest.approx(0.5)


@pytest.mark.parametrize("text", ["asin(w)", "acos(w)"])
def test_inverse_functions_of_variables_are_compiled(spark, sf_dir, text):
    """A formula inside a lambda would be interpreted for every row; composed arguments still are made once in one."""
    points = Q.complex_numbers(spark, sf_dir)
    plan = lambda t: points.evaluate(t)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan(text)
    assert "lambda" in plan(text.replace("w", "w+1"))
