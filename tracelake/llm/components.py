"""Connected components of an edge table, by alternating star operations until all are stars.

First every task replaces the edges it holds by stars around their smallest nodes, which keeps the components and shortens long chains. Then each round attaches
neighbours to the smallest node a node knows of, first its larger neighbours, then its smaller ones. The number of rounds grows with
the logarithm of a component's width. Minima are partial sums before a shuffle and edges are joined to them from tables, so a
node with very many edges is split. Every round is a table in the shared folder, in as many files as its rows need; nothing but
two numbers goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import arrow_map, remove, written

#: Edges in a file of a round's table, and edges that a task replaces by stars at once.
FILE_EDGES, STAR_EDGES = 200_000, 1 << 20


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the same components: every node of a chunk of edges to the least node that the chunk connects it to."""
    held: list[np.ndarray] = []
    count = 0
    for batch in batches:
        held.append(np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()]))
        count += batch.num_rows
        if count >= STAR_EDGES:
            yield _star_of(held)
            held, count = [], 0
    if count:
        yield _star_of(held)


def _star_of(held: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(held, axis=1)
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    least = np.arange(len(names))
    while True:  # hooks and jumps: both ends of an edge take the smaller of their least nodes
        low = np.minimum(least[i], least[j])
        new = least.copy()
        for end in (least[i], least[j], i, j):
            np.minimum.at(new, end, low)
        while (jumped := new[new] != new).any():
            new[jumped] = new[new[jumped]]
        if (new == least).all():
            break
        least = new
    far = np.flatnonzero(least != np.arange(len(names)))
    return pa.RecordBatch.from_arrays([pa.array(names[least[far]]), pa.array(names[far])], ["a", "b"])


def _table(df: DataFrame, rows: int, name: str) -> DataFrame:
    """Small tables in few files: a file for each shuffle partition would cost more than its rows."""
    return written(df.coalesce(max(1, -(-rows // FILE_EDGES))), name)


def _star(edges: DataFrame, rows: int, large: bool, name: str) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = _table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), rows, f"{name}-least")
    moved = both.filter("v > u") if large else both
    joined = moved.join(least, "u")
    # Large: a larger neighbour hangs on the least. Small: all smaller neighbours and the node itself do.
    out = joined.select(F.col("m").alias("a"), F.col("v").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    result = _table(out.filter("a < b").distinct(), rows, name)
    remove(least)
    return result


def _unsettled(edges: DataFrame) -> tuple[int, int]:
    """How many nodes hang on several others, or hang on one and have nodes on them; and how many edges there are."""
    ends = edges.select(F.col("b").alias("u"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(edges.select(F.col("a").alias("u"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    nodes = ends.groupBy("u").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
    open_ = F.count(F.when((F.col("below") > 1) | (F.col("below") == 1) & (F.col("above") > 0), 1))
    found = nodes.agg(open_, F.coalesce(F.sum("below"), F.lit(0))).first()
    return found[0], found[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint); root is the smallest node that it reaches."""
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    now = written(arrow_map(ordered, _stars, "a bigint, b bigint").distinct(), "edges")
    while True:
        wrong, rows = _unsettled(now)
        if not wrong:
            break
        large = _star(now, rows, True, "large")
        small = _star(large, rows, False, "small")
        remove(now)
        remove(large)
        now = small
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
