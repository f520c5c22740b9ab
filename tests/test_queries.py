"""Every registered waveform query against its SQL on the smallest tables."""

import duckdb
import pytest

from tracelake import queries as Q

TABLES = "region nation customer supplier part orders lineitem events".split()


def value(x):
    return f"{x + 0.0:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, sf_dir, name):
    df = Q.queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = Q.oracle_sql().get(name)
    if not sql:
        assert rows
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = db.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(value(r[c]) for c in columns) for r in rows) == sorted(tuple(value(x) for x in r) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
