"""The registered corpus queries at the smallest scale, against their SQL where there is one, and the pipeline against its operators."""

import duckdb
import pytest

from tracelake.llm import queries as Q

TABLES = "documents pages benchmark labels conversations".split()


def normal(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, sf_dir, name):
    df = Q.queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = Q.oracle_sql().get(name)
    if sql:
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = db.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert normal([tuple(r[c] for c in columns) for r in rows]) == normal(found.fetchall())
    else:
        assert rows


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for k, (_, stage) in enumerate(P.STAGES):
        after = stage(spark, before, sf_dir)
        if k + 1 < len(P.STAGES):
            assert after.columns == docs.columns
            assert after.schema == docs.schema
            assert 0 < after.count() <= before.count()
        before = after
    assert normal(before.select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == normal(P.run(spark, sf_dir).select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    none = docs.limit(0)
    for k, (_, stage) in enumerate(P.STAGES):
        assert stage(spark, none, sf_dir).count() == 0


def test_stages_keep_other_columns(spark, sf_dir):
    """Columns named like an operator's own come back with their values; null ids, null texts and repeated rows are rows like others."""
    import corpus_pipeline as P

    clash = "score n_lines n_dropped n_words n_hit spans item_ids near_item_ids contaminated component_id label features stays id same node keys".split()
    texts = [None, "", "a few plain words", "a few plain words", "other words stand here in this row"]
    rows = [(k if k != 2 else None, t, *(f"{c}{k}" for c in clash)) for k, t in enumerate(texts)]
    schema = ", ".join(["doc_id long", "text string", *(f"{c} string" for c in clash)])
    df = spark.createDataFrame([*rows, rows[4]], schema)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.schema == df.schema
        found = normal(r[2:] for r in out.collect())
        # Of equal texts the near-duplicate stage leaves the one with the smallest id, and of repeated rows one.
        expected = [rows[k][2:] for k in (0, 1, 2, 4)] if name == "near_dedup" else [r[2:] for r in [*rows, rows[4]]]
        assert found == normal(expected), name
    assert P.STAGES[-1][1](spark, df, sf_dir).count() == 6


def test_stages_equal_brute_force(spark, tmp_path):
    """The stages one after the other on a small corpus, against plain Python: toxic words, a repeated line, edited copies, a benchmark passage."""
    import re

    import numpy as np

    import corpus_pipeline as P

    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    line = "this line stands at the end of many of the documents"
    passage = " ".join(f"exam{k}" for k in range(11))
    texts = {}
    for k in range(240):
        w = list(rng.choice(words, 80))
        if k % 4 == 0:
            w[3:3] = ["vile", "grubbing"]
        if k % 17 == 1:
            w[9:9] = passage.split()
        texts[k] = " ".join(w) + (f"\n{line}" if k % 3 == 0 else "")
    for k in range(240, 260):  # copies with one word changed, and longer ones that are too different
        w = texts[k - 235].split("\n")[0].split()
        w[40] = "changed"
        texts[k] = " ".join(w if k % 2 else w + list(rng.choice(words, 40)))
    spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(240)], "doc_id long, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, t, len(t)) for k, t in texts.items()], "doc_id long, text string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")

    left = {k: t for k, t in texts.items() if "vile" not in t}
    owners = [k for k, t in left.items() if line in t]
    assert len(owners) >= 5
    left = {k: t if k == max(owners) else t.replace(f"\n{line}", "") for k, t in left.items()}
    grams = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in left.items() if (w := t.split())}
    root = {k: k for k in left}
    for a in left:
        for b in left:
            if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert sum(k != r for k, r in root.items()) >= 5
    left = {k: t for k, t in left.items() if root[k] == k}
    left = {k: t for k, t in left.items() if not re.search(" ".join(passage.split()[:10]) + "|" + " ".join(passage.split()[1:]), t)}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == left
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    packed = P.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(left)
    total = sum(r["length"] for r in packed)
    assert len({r["sequence_id"] for r in packed}) == -(-total // 4096)
