"""Interaction audit of quality filters: what each filter removes at each place of every order of the filters.

A document's failures are a number of five bits. In a table of 32 failures by 120 orders, made once, stands the step at which an order removes such a document first. ``mapInArrow`` looks up
the rows of its documents in that table and counts steps by part, order and label with ``np.bincount``; tasks give a partial array for each part, and the arrays are summed.
Everything else follows from removals: the kept from those that no later step removes, a filter's failures from the orders that begin with it, and its unique failures
from the orders that end with it.

The filters: A fewer than 200 words; B fewer distinct words than half the words; C upper-case letters A-Z in over 2 % of the code points; D one of ``#$%&*|``; E a text that a smaller id
has as well, in the whole table. Words are runs of anything but ASCII white space.

Defined results: a null text is an empty one (no words: it fails A alone, and E where a smaller id's text is empty). A null id is smaller than all others. Rows that share an id and a text
are not each other's copies. A document is one of quality or toxic if any row of ``labels`` with its id says 1; a row of ``labels`` without an id labels nothing. A null part is the empty string.
Texts of any length are read in pieces. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import ASCII_SPACE, arrow_map, slices, text_bytes, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS, SPECIAL = 200, b"#$%&*|"
#: Parts whose arrays a task holds before it gives them away.
PARTS_HELD = 256
#: Rows whose 120 steps are counted at once.
ROWS = 4096
_NULL_ID = -(1 << 63)
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))
_PIECE = 1 << 20


def first_failures(filters: str = FILTERS, orders: list[str] = ORDERS) -> np.ndarray:
    """For each set of failed filters (a bit each) and each order, the step (from 1) at which a document is removed, 0 if never."""
    steps = np.zeros((1 << len(filters), len(orders)), np.uint8)
    for o, order in enumerate(orders):
        for step in range(len(order), 0, -1):  # earlier steps overwrite later ones
            failed = np.arange(len(steps)) >> filters.index(order[step - 1]) & 1 == 1
            steps[failed, o] = step
    return steps


def failures(text: bytes) -> int:
    """The filters A to D that a text fails, a bit each."""
    words, distinct, at = 0, set(), 0
    while at < len(text):
        stop = min(at + _PIECE, len(text))
        while stop < len(text) and text[stop] not in ASCII_SPACE:
            stop += 1
        found = text[at:stop].split()
        words += len(found)
        distinct.update(found)
        at = stop
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUED))
    special = len(text.translate(None, SPECIAL)) < len(text)
    return (words < MIN_WORDS) | (100 * len(distinct) < 50 * words) << 1 | (100 * upper > 2 * points) << 2 | special << 3


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column("text").to_pylist()
            masks = pa.array([failures(t) for t in texts], pa.int32())
            keys = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("part"), keys, masks], ["id", "part", "key", "mask"])


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, order, step, removed, good, toxic); step 0 is what an order keeps."""
    steps, n, m = first_failures().astype(np.int64), len(ORDERS), len(FILTERS) + 1
    place = np.arange(n) * m
    held: dict[str, np.ndarray] = {}

    def given() -> pa.RecordBatch:
        names = np.repeat(np.array(list(held), object), n * m)
        order = np.tile(np.repeat(np.arange(n, dtype=np.int32), m), len(held))
        step = np.tile(np.arange(m, dtype=np.int32), n * len(held))
        counts = np.concatenate([x.reshape(3, -1) for x in held.values()], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(order), pa.array(step), *map(pa.array, counts)], ["part", "order", "step", "removed", "good", "toxic"])

    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        names, code = parts.dictionary.to_pylist(), parts.indices.to_numpy(zero_copy_only=False)
        mask, good, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "good", "toxic"))
        by_part = np.argsort(code, kind="stable")
        bounds = np.searchsorted(code[by_part], np.arange(len(names) + 1))
        for k, name in enumerate(names):
            if name not in held and len(held) == PARTS_HELD:
                yield given()
                held.clear()
            own = held.setdefault(name, np.zeros((3, n * m), np.int64))
            for lo in range(bounds[k], bounds[k + 1], ROWS):
                rows = by_part[lo : min(lo + ROWS, bounds[k + 1])]
                at = steps[mask[rows]] + place
                for j, some in enumerate((slice(None), good[rows] == 1, toxic[rows] == 1)):
                    own[j] += np.bincount(at[some].ravel(), minlength=n * m)
    if held:
        yield given()


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    number = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID))
    read = docs.select(number.alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    facts = written(arrow_map(read, _facts, "id bigint, part string, key binary, mask int"), "facts")
    # Tables, so that the joins can split a text that very many documents have, and the rows without an id.
    copies = written(facts.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("key", "first"), "copies")
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    marks = written(labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")), "marks")
    copied = F.when(F.col("id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    rows = facts.join(copies, "key", "left").select("id", "part", (F.col("mask") + copied).alias("mask")).join(marks, "id", "left")
    rows = rows.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    partial = arrow_map(rows, _removals, "part string, order int, step int, removed bigint, good bigint, toxic bigint")
    sums = written(partial.groupBy("part", "order", "step").agg(*[F.sum(c).alias(c) for c in ("removed", "good", "toxic")]), "removals")

    order = F.get(F.array(*[F.lit(o) for o in ORDERS]), F.col("order"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    whole = Window.partitionBy("part", "order")
    later = whole.orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    kept = F.first(F.when(F.col("step") == 0, F.col("removed")), ignorenulls=True).over(whole) + F.coalesce(F.sum("removed").over(later), F.lit(0))
    same = Window.partitionBy("part", "letter")
    of = lambda step: F.max(F.when(F.col("step") == step, F.col("removed"))).over(same)
    out = sums.withColumn("kept", kept).filter("step > 0").withColumn("filter_order", order).withColumn("letter", letter)
    return out.select(
        "part",
        "filter_order",
        "step",
        "kept",
        "removed",
        (of(1) - F.col("removed")).alias("redundant"),
        of(len(FILTERS)).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("removed").over(same).alias("shapley"),
    )
