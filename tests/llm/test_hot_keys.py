"""What one key, one segment or one long text may cost."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import decontaminate as D
from tracelake.llm import toxicity as T
from tracelake.llm.line_dedup import dedup_lines


def test_texts_meet_a_table_of_drops(spark):
    """Rows without an id are one key: what they lose is a table, so both sides of the join are plain exchanges that Spark can split."""
    line = "a line that is long enough to count for all of them"
    df = spark.createDataFrame([(None if k % 3 else k, f"{line}\nown {k}") for k in range(60)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dedup_lines(df)
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "Aggregate" not in plan and "Join" in plan
        assert out.agg(F.sum("n_dropped")).first()[0] == 59
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lists_by_segment(spark):
    """A segment's windows are cut by their own number, not by that of all windows: 4 segments, 1,000 windows of which one segment has 900."""
    places = spark.createDataFrame([(k % 10, 0 if k % 10 < 9 else 1 + k % 3) for k in range(30)], "term bigint, segment bigint").distinct()
    asked = spark.createDataFrame([(bytes([k % 256, k // 256]), [k], [0], k % 10) for k in range(1000)], "window binary, terms array<bigint>, order array<int>, term bigint")
    rows = D.lists_of(places, asked, 100).select("segment", F.size("asked").alias("n")).collect()
    by_segment = {}
    for r in rows:
        by_segment.setdefault(r["segment"], []).append(r["n"])
    assert {k: sum(v) for k, v in by_segment.items()} == {0: 900, 1: 100, 2: 100, 3: 100}
    assert len(by_segment[0]) == 9 and all(len(by_segment[k]) == 1 for k in (1, 2, 3))


@pytest.mark.parametrize("most", [7, 64, 1 << 20])
def test_long_texts_in_pieces(most, monkeypatch):
    """N-grams across the pieces of a text are found, and no others: the same features for any size of piece."""
    texts = ["", "a", "abc", "Some LONGER text, with ÜMLAUTS and ὈΔΥΣΣΕΎΣ. " * 5, "x" * 200, "\U0001f642 ok " * 9]
    raw = [t.encode() for t in texts]
    found = T.present(raw, 20, (4, 5)) if most == 1 << 20 else None
    pieces = list(T.together(raw, (4, 5), most))
    if most < 1 << 20:
        assert max(len(p) for _, held in pieces for p in held) <= most + 4
        monkeypatch.setattr(T.together, "__defaults__", (most,))
        found = T.present(raw, 20, (4, 5))
    want = set()
    for k, t in enumerate(texts):
        chars = f" {t.lower()} "
        for n in (4, 5):
            for lo in range(len(chars) - n + 1):
                h = n
                for c in chars[lo : lo + n]:
                    h = h * 16777619 % 2**32 ^ ord(c)
                want.add((k, (h * 2654435761 % 2**32) >> 12))
    assert set(zip(*(x.tolist() for x in found), strict=True)) == want


def test_a_very_long_text_needs_little_memory():
    """Ten megabytes: a few copies of the text and a piece's n-grams, not fifty bytes a byte."""
    import tracemalloc

    text = ("some words that come again and again " * 280_000).encode()
    model = T.Model(np.zeros(1 << 20, np.int32), np.ones(1), 0.0)
    tracemalloc.start()
    try:
        assert model.score([text])[0] > 0.5
        assert tracemalloc.get_traced_memory()[1] < 12 * len(text)
    finally:
        tracemalloc.stop()


def test_a_bound_in_bytes_on_what_is_learned(spark):
    df = spark.createDataFrame([(k, ("bad words here " if k % 2 else "kind words there ") * 20) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    whole, some, none = (T.train(df, labels, max_bytes=n) for n in (1 << 20, 20_000, 0))
    assert len(whole.weight) and len(some.weight) and not len(none.weight)
    assert T.score_toxicity(df, some).filter("(score >= 0.5) <> (doc_id % 2 = 1)").count() == 0


@pytest.mark.parametrize("query", ["op4", "near"])
def test_texts_join_their_drops_sorted_at_every_size(spark, query):
    """A broadcast of a small list alone would let disk jump where the list is larger."""
    import corpus_pipeline
    from tracelake.llm.line_dedup import dedup_lines

    docs = spark.createDataFrame([(k, f"{'a line that many documents share, long enough'}\nown {k} {k * 7} {k * 11} {k * 13}") for k in range(9)], "doc_id long, text string")
    out = dedup_lines(docs) if query == "op4" else corpus_pipeline.drop_near_duplicates(spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
