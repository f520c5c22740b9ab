"""The filter audit against plain Python, row by row, for every order and step."""

from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from tracelake.llm.filter_audit import ORDERS, audit, failures, first_failures


def fails(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }


def brute(rows, labels):
    least = -(2**63)
    number = lambda d: least if d is None else d
    first = {}
    for d, t, _ in rows:
        first[t or ""] = min(first.get(t or "", number(d)), number(d))
    out = {}
    for part in {s or "" for _, _, s in rows}:
        docs = []
        for d, t, s in rows:
            if (s or "") == part:
                docs.append((fails(t or "") | {"E": number(d) > first[t or ""]}, any(x == d and q == 1 for x, q, _ in labels if d is not None), any(x == d and y == 1 for x, _, y in labels if d is not None)))
        shapley = dict.fromkeys("ABCDE", 0)
        found = {}
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                alive = [x for x in docs if not any(x[0][g] for g in order[: step - 1])]
                removed = [x for x in alive if x[0][f]]
                shapley[f] += len(removed)
                unique = sum(x[0][f] and sum(x[0].values()) == 1 for x in docs)
                found[part, order, step] = (len(alive) - len(removed), len(removed), sum(x[0][f] for x in docs) - len(removed), unique, sum(x[1] for x in removed), sum(x[2] for x in removed))
        out |= {k: (*v, shapley[k[1][k[2] - 1]]) for k, v in found.items()}
    return out


LONG = " ".join(f"word{k}" for k in range(300))
ROWS = [
    (1, None, "a"),
    (2, "", "a"),
    (3, "short Text with # mark", None),
    (4, LONG, "b"),
    (5, LONG, "b"),
    (None, LONG, "b"),
    (6, "again " * 300, "b"),
    (7, "AGAIN  \x0b " * 300, "a"),
    (7, "AGAIN  \x0b " * 300, "a"),
    (8, "é" * 100 + " ÀB" + "x" * 60, "a"),
    (None, "short Text with # mark", "b"),
    (9, LONG + " | ünï", "c"),
]
LABELS = [(4, 1, 0), (5, 1, 1), (5, 0, 0), (3, 0, 1), (None, 1, 1), (7, 1, None), (99, 1, 1)]


def test_audit_equals_brute_force(spark):
    """Nulls, empty texts, copies, repeated rows and ids, several labels of an id; columns named like the results are ignored."""
    docs = spark.createDataFrame([(*r, 1, "z") for r in ROWS], "doc_id long, text string, source string, kept int, mask string")
    labels = spark.createDataFrame([(*r, 5) for r in LABELS], "doc_id long, quality int, toxic int, part int")
    got = audit(docs, labels)
    rows = got.collect()
    assert len(rows) == 4 * 600
    assert {tuple(r)[:3]: tuple(r)[3:] for r in rows} == brute(ROWS, LABELS)
    assert audit(docs.limit(0), labels).collect() == []
    assert audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_more_parts_than_are_held(spark):
    """A task with more parts than it holds gives some away; sums stay whole."""
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("few words").alias("text"), F.pmod("id", F.lit(700)).cast("string").alias("source")).repartition(2)
    got = audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).filter("step = 1 AND filter_order = 'ABCDE'")
    assert {(r["part"], r["removed"]) for r in got.collect()} == {(str(k), 3 if k < 100 else 2) for k in range(700)}


def test_first_failures_and_long_texts():
    table = first_failures()
    assert table.shape == (32, 120) and not table[0].any()
    for mask in range(32):
        for o, order in enumerate(ORDERS):
            steps = [k for k, f in enumerate(order, 1) if mask >> "ABCDE".index(f) & 1]
            assert table[mask, o] == (steps[0] if steps else 0)
    long = ("lorem ipsum " * 400_000).encode()  # several pieces
    assert failures(long) == 0b10
    assert failures(b"x" * 3_000_000) == 0b1
    assert isinstance(table, np.ndarray)
