"""Exact deduplication through counting quotient filters.

Every input partition folds the 64-bit fingerprints of its normalised texts into counting quotient
filters, one per slice of the fingerprint space. The slices are shuffled, merged without loss by their
sorted remainders, and the fingerprints whose merged count exceeds one send their documents to byte
verification. Texts that occur once never leave their partition.

Nulls: a null text is an empty text, a null id sorts below all others. Repeated rows: of rows that agree in
text length and id, one stays. An empty table gives no rows. Length of a text is only bounded by memory
for one row. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import ASCII_SPACE, arrow_map, slices, text_bytes, written

#: Duplicate fingerprints up to this many bytes are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


class QuotientFilter:
    """A counting quotient filter over 64-bit fingerprints.

    A fingerprint is split into ``qbits`` of quotient, which chooses a run, and the rest, the remainder, which
    is stored in the run in ascending order. ``occupied`` has a bit for each quotient with a run, ``ends`` one
    for each slot that ends a run; ``counts`` belongs to the slots. The three together give back every fingerprint
    and its count, so filters with different numbers of quotient bits merge exactly.
    """

    def __init__(self, qbits: int, occupied: np.ndarray, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.qbits, self.occupied, self.ends, self.remainders, self.counts = qbits, occupied, ends, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> QuotientFilter:
        keys, where = np.unique(fingerprints.astype(np.uint64), return_inverse=True)
        total = np.bincount(where, weights=None if counts is None else counts, minlength=len(keys)).astype(np.int64)
        return cls._of_sorted(keys, total)

    @classmethod
    def _of_sorted(cls, keys: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        qbits = min(max(int(len(keys)).bit_length(), 1), 28)
        shift = np.uint64(64 - qbits)
        quotients = (keys >> shift).astype(np.int64)
        occupied = np.zeros(1 << qbits, dtype=bool)
        occupied[quotients] = True
        ends = np.ones(len(keys), dtype=bool)
        ends[:-1] = quotients[1:] != quotients[:-1]
        return cls(qbits, occupied, ends, keys & ((np.uint64(1) << shift) - np.uint64(1)), counts)

    def fingerprints(self) -> np.ndarray:
        """All stored fingerprints in ascending order, from runs and remainders."""
        run = np.cumsum(self.ends) - self.ends
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)[run] if len(self.ends) else np.zeros(0, np.uint64)
        return (quotients << np.uint64(64 - self.qbits)) | self.remainders

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """Both filters' fingerprints with added counts: one pass over the sorted remainders of either."""
        keys = np.concatenate([self.fingerprints(), other.fingerprints()])
        counts = np.concatenate([self.counts, other.counts])
        order = np.argsort(keys, kind="stable")  # two sorted runs: a merge
        keys, counts = keys[order], counts[order]
        first = np.ones(len(keys), dtype=bool)
        first[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(first)
        return self._of_sorted(keys[at], np.add.reduceat(counts, at) if len(at) else counts)

    def slice(self, bits: int) -> Iterator[tuple[int, QuotientFilter]]:
        """A filter for each non-empty slice of the space by the leading ``bits``."""
        keys = self.fingerprints()
        part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if hi > lo:
                yield int(part[lo]), self._of_sorted(keys[lo:hi], self.counts[lo:hi])

    def to_bytes(self) -> bytes:
        rest = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)
        width = (64 - self.qbits + 7) // 8
        many = np.flatnonzero(self.counts > 1)
        head = np.array([self.qbits, len(self.ends), len(many)], dtype="<i8").tobytes()
        return b"".join([head, np.packbits(self.occupied).tobytes(), np.packbits(self.ends).tobytes(), rest[:, :width].tobytes(), many.astype("<u4").tobytes(), self.counts[many].astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        qbits, n, many = (int(x) for x in np.frombuffer(data, "<i8", 3))
        at = 24
        occupied = np.unpackbits(np.frombuffer(data, np.uint8, max(1, (1 << qbits) // 8), at))[: 1 << qbits].astype(bool)
        at += max(1, (1 << qbits) // 8)
        ends = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at))[:n].astype(bool)
        at += (n + 7) // 8
        width = (64 - qbits + 7) // 8
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        counts = np.ones(n, np.int64)
        counts[np.frombuffer(data, "<u4", many, at)] = np.frombuffer(data, "<i8", many, at + 4 * many)
        return cls(qbits, occupied, ends, rest.reshape(-1).view("<u8").astype(np.uint64), counts)


def normalise(text: bytes) -> bytes:
    return text.translate(None, ASCII_SPACE)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [normalise(t) for t in part.column("text").to_pylist()]
            fps = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], dtype=np.uint64).view(np.int64)
            sha = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("uid"), part.column("n_chars"), pa.array(fps), sha], ["doc_id", "uid", "n_chars", "fp", "sha"])


def _filters(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            one = QuotientFilter.build(batch.column("fp").to_numpy().view(np.uint64))
            whole = one if whole is None else whole.merge(one)
            if len(whole.counts) >= 4_000_000:  # bounded memory; slices of one range may come from several filters
                yield from _blobs(whole, bits)
                whole = None
        if whole is not None:
            yield from _blobs(whole, bits)

    return run


def _blobs(whole: QuotientFilter, bits: int) -> Iterator[pa.RecordBatch]:
    parts = list(whole.slice(bits))
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([f.to_bytes() for _, f in parts], pa.binary())], ["part", "filter"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices sorted by range: merges those of one range, gives the fingerprints with a count above one."""
    at, stack = None, []

    def result():
        while len(stack) > 1:
            a = stack.pop()
            stack.append(stack.pop().merge(a))
        whole = stack.pop()
        many = whole.counts > 1
        return pa.RecordBatch.from_arrays([pa.array(whole.fingerprints()[many].view(np.int64)), pa.array(whole.counts[many])], ["fp", "n"])

    for batch in batches:
        for part, data in zip(batch.column("part").to_pylist(), batch.column("filter").to_pylist(), strict=True):
            if at is not None and part != at:
                yield result()
            at = part
            stack.append(QuotientFilter.from_bytes(data))
            while len(stack) > 1 and len(stack[-1].counts) >= len(stack[-2].counts) // 2:  # sizes fall geometrically: n log n in all
                a = stack.pop()
                stack.append(stack.pop().merge(a))
    if at is not None:
        yield result()


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [normalise(t) for t in part.column("text").to_pylist()]
            fps = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(texts, pa.binary())], ["fp", "norm"])


def duplicate_fingerprints(digests: DataFrame) -> DataFrame:
    """Fingerprints that occur more than once over all partitions, by merged counting quotient filters."""
    spark = digests.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(parts - 1, 1).bit_length()
    blobs = arrow_map(digests.select("fp"), _filters(bits), "part int, filter binary")
    dealt = blobs.repartition(parts, "part").sortWithinPartitions("part")
    return arrow_map(dealt, _merge, "fp bigint, n bigint")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when their bytes are, after the six ASCII white-space characters are deleted. Of equal
    texts the one with the most code points before that stays, then the smallest id.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.coalesce(F.char_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).alias("n_chars"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    digests = written(arrow_map(read, _digest, f"doc_id {id_type}, uid bigint, n_chars int, fp bigint, sha binary"), "digests")
    found = written(duplicate_fingerprints(digests), "duplicates")
    small = found.count() * 16 <= broadcast_bytes
    routed = F.broadcast(found.select("fp")) if small else found.select("fp")

    # Byte verification: the normalised texts themselves are the grouping key, and copies collapse before they are shuffled.
    texts = arrow_map(source.select("text"), _normalised, "fp bigint, norm binary").join(routed, "fp", "left_semi")
    verified = texts.groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("group_size")).select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size")
    # The row that stays, from the digests of the routed rows only.
    keepers = digests.join(routed, "fp", "left_semi").groupBy("fp", "sha").agg(F.min(F.struct(-F.col("n_chars"), F.col("doc_id"), F.col("uid"))).alias("first"))
    groups = verified.join(keepers, ["fp", "sha"]).select("fp", "sha", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.uid").alias("keep_uid"))
    # A table of its own, so that a key with very many rows is split in the last join instead of sharing a task with the aggregate.
    groups = written(groups, "groups")
    found_group = F.col("keep_uid").isNotNull()
    return digests.join(groups, ["fp", "sha"], "left").select(
        "doc_id",
        F.when(found_group, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "n_chars",
    )
