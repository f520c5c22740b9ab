"""Packing documents into fixed-length sequences by best-two-fit.

Documents are encoded once into pieces of at most ``capacity`` tokens. Pieces of one length are interchangeable to the packer, so it works
on the histogram of lengths alone: at most ``capacity`` numbers, whatever the corpus. It fills a bin greedily from the largest length
that fits; then, if a gap is left, it replaces the bin's smallest piece by the two unpacked pieces that fill the enlarged gap
most tightly. A filled bin is a pattern, used as often as the counts allow before the next is made, so the plan is a short list of
(length, run of ranks) with their sequences and offsets. Every piece finds its place by the rank it has
among the pieces of its length: its task's share plus its place in the task, with no sort of the corpus and no group of pieces in one task.

Nulls: a null text is an empty one, which is a piece with the end token alone; a null id is kept. Repeated rows are separate
documents. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import arrow_map, slices, text_bytes, written

CAPACITY = 4096
END_ID = 1


def fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """Lengths and copies of the next bin: greedy from the largest that fits, then the exchange for the best two."""
    largest = np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))  # the largest free length up to each
    free, bin_ = capacity, {}
    left = {}
    at = int(largest[min(free, capacity)])
    while at:
        n = min(int(counts[at]), free // at)
        bin_[at] = n
        left[at] = int(counts[at]) - n
        free -= n * at
        at = int(largest[min(free, at - 1)])
    if free and sum(bin_.values()) > 1:
        small = min(bin_)
        open_ = counts.copy()
        for k, n in left.items():
            open_[k] = n
        target = small + free
        below = np.maximum.accumulate(np.where(open_ > 0, np.arange(len(open_)), 0))
        first = np.flatnonzero(open_[: target + 1] > 0)
        first = first[first > 0]
        if len(first):
            second = below[np.minimum(target - first, first)]  # the smaller of the two
            same = (second == first) & (open_[first] < 2)
            if same.any():
                second[same] = below[first[same] - 1]
            total = np.where(second > 0, first + second, 0)
            best = int(np.argmax(total))
            if total[best] > small:
                bin_[small] -= 1
                for k in (int(first[best]), int(second[best])):
                    bin_[k] = bin_.get(k, 0) + 1
    return {k: n for k, n in bin_.items() if n}


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, first offset), by length and rank.

    The pieces of a length with ranks from ``first rank`` on, up to the next row of that length, lie ``copies`` to a sequence.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for k, n in histogram.items():
        counts[k] = n
    rank = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    while counts.any():
        bin_ = fill(counts, capacity)
        times = min(int(counts[k]) // n for k, n in bin_.items())
        offset = 0
        for k in sorted(bin_, reverse=True):
            n = bin_[k]
            rows.append((k, rank[k], n, sequence, offset))
            rank[k] += n * times
            counts[k] -= n * times
            offset += n * k
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tracelake.llm.tokens import word_bpe

        coder, part = word_bpe(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in slices(batch, "text"):
                ids, ends = coder.encode(some.column("text").to_pylist())
                n = len(some)
                sizes = np.diff(ends) + 1
                whole = np.insert(ids, ends[1:], end_id).astype("<u4")  # each document, then its end token
                begin = np.cumsum(sizes) - sizes
                cuts = -(-sizes // capacity)
                doc = np.repeat(np.arange(n), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                at = begin[doc] + start
                data = whole.tobytes()
                crc = [zlib.crc32(data[a:b]) for a, b in zip((4 * at).tolist(), (4 * (at + length)).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                first = np.searchsorted(sorted_, sorted_)
                rank = np.empty(len(doc), np.int64)
                rank[order] = seen[sorted_] + np.arange(len(doc)) - first
                seen += np.bincount(length, minlength=capacity + 1)
                lists = pa.ListArray.from_arrays(np.concatenate([at, [len(whole)]]).astype(np.int32), pa.array(whole.view("<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), lists, pa.array(np.full(len(doc), part), pa.int32()), pa.array(rank, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "rank"],
                )

    return run


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        width = np.int64(1) << 48
        keys = rows[:, 0] * width + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * width + rank, side="right") - 1
            within = rank - rows[at, 1]
            columns = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
            columns["sequence_id"] = pa.array(rows[at, 3] + within // rows[at, 2], pa.int64())
            columns["offset"] = pa.array(rows[at, 4] + within % rows[at, 2] * length, pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    ``tokenizer`` is the file of a word vocabulary on every machine. ``with_ids`` False leaves out the column of ids.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    pieces = arrow_map(read, _pieces(tokenizer, capacity, end_id), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>, part int, rank bigint")
    pieces = written(pieces if with_ids else pieces.drop("ids"), "pieces")
    shares = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # Rows of a window: at most one for each task of the encoding pass.
    shares = written(shares.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))), "shares")
    histogram = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = spark.sparkContext.broadcast(plan(histogram, capacity))
    # The shares grow with the number of tasks: never broadcast, whatever their file's size.
    ranked = pieces.join(shares.drop("n").hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in names)
    return arrow_map(ranked.select(*names, "rank"), _place(rows), f"{schema}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order: groups of at most ``capacity`` tokens."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
