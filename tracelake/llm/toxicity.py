"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are n-grams of the code points of the lower-cased text, hashed into ``1 << bits`` buckets, present or absent. Over the labelled texts each
bucket gets the log of the ratio of its smoothed document frequencies among toxic and other texts. Buckets with a clear
ratio are features, with the ratio as their value; a logistic regression with an L2 penalty on ratio-scaled features gives the score.

What is fitted on and sent around has a bound that doesn't grow with the corpus, by parameters: training reads at most ``max_labels`` labelled rows, chosen by a hash
of their id, with texts of at most ``max_bytes`` in all; a bucket needs ``min_docs`` of their texts and a ratio of ``min_ratio`` either way, and the ``max_features`` with the clearest ratios are used. Scoring
reads whole texts, of any length, and no other column.

Nulls: a null text is empty; a label row with a null id or label is ignored; a null id is scored and counts as held out. Several
labels of one id: the mean decides, a tie is toxic. Repeated rows get equal scores; rows that share a labelled id are all learned from. Bytes that aren't UTF-8 count as U+FFFD.
An empty table gives no rows. Other columns pass, but for one named score. Without both labels every score is nearly the label there is, or nearly 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import arrow_map, slices, text_bytes, written

MAX_LABELS, MAX_BYTES = 20_000, 256 << 20
BITS = 20
SIZES = (4, 5)
MAX_FEATURES = 1 << 16
MIN_DOCS = 5
MIN_RATIO = 1.0
PENALTY = 3.0
#: Bytes of text whose n-grams a task holds at once: about fifty bytes for each.
SLICE_BYTES = 1 << 20
_SEED = np.uint32(2654435761)


def code_points(text: bytes, most: int, overlap: int) -> Iterator[np.ndarray]:
    """The code points of a text with a space at either end, ``most`` at a time; each piece begins with the last ``overlap`` of the one before."""
    chars = f" {text.decode('utf-8', 'replace').lower()} "
    for lo in range(0, max(len(chars) - overlap, 1), most):
        yield np.frombuffer(chars[lo : lo + most + overlap].encode("utf-32-le"), np.uint32)


def together(texts: list[bytes], sizes: tuple[int, ...], most: int = SLICE_BYTES) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The code points of all texts (numbers of texts, pieces), about ``most`` at a time: a long text is several pieces, which share what an n-gram across them needs."""
    docs: list[int] = []
    held: list[np.ndarray] = []
    for k, text in enumerate(texts):
        for piece in code_points(text, most, max(sizes) - 1):
            docs.append(k)
            held.append(piece)
            if sum(map(len, held)) >= most:
                yield docs, held
                docs, held = [], []
    if held:
        yield docs, held


def buckets(docs: list[int], pieces: list[np.ndarray], bits: int, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every n-gram of the pieces, for each n."""
    data = np.concatenate(pieces)
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(c) for c in pieces])
    doc = np.array(docs, np.int32)
    for n in sizes:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint32)
        for k in range(n):
            h *= np.uint32(16777619)
            h ^= data[k : len(data) - n + 1 + k]
        h *= _SEED
        inside = piece[: len(h)] == piece[n - 1 :]
        yield doc[piece[: len(h)][inside]], (h >> np.uint32(32 - bits))[inside].astype(np.int64)


def present(texts: list[bytes], bits: int, sizes: tuple[int, ...], feature: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs in order; ``feature`` maps buckets to features, -1 to none."""
    pairs = np.zeros(0, np.int64)
    for docs, pieces in together(texts, sizes):
        found = [pairs]
        for doc, bucket in buckets(docs, pieces, bits, sizes):
            f = bucket if feature is None else feature[bucket]
            ok = f >= 0
            found.append(doc[ok].astype(np.int64) << 32 | f[ok])
        pairs = np.unique(np.concatenate(found))
    return pairs >> 32, pairs & 0xFFFFFFFF


@dataclass
class Model:
    """``feature``: of each bucket, or -1. ``weight``: the regression's weight times the ratio."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS
    sizes: tuple[int, ...] = SIZES

    def score(self, texts: list[bytes]) -> np.ndarray:
        doc, f = present(texts, self.bits, self.sizes, self.feature)
        z = self.bias + np.bincount(doc, weights=self.weight[f], minlength=len(texts)) if len(self.weight) else np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def regress(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, penalty: float, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Weights on features with the values ``value[feature]``, by accelerated gradient steps on the penalised log loss."""
    n, x = len(label), value[feature]
    w, b = np.zeros(len(value)), float(np.log((label.mean() + 1e-9) / (1 - label.mean() + 1e-9)))
    vw, vb, last = w.copy(), b, 1.0
    # A bound on the curvature: rows' squared norms are at most the largest one, after scaling features by 1/sqrt of their own mass.
    mass = np.bincount(feature, weights=x * x, minlength=len(value))
    share = np.bincount(doc, minlength=n)
    bound = 0.25 * np.bincount(feature, weights=x * x * (share[doc] + 1), minlength=len(value)) + penalty
    step, step_b = 1 / np.maximum(bound, 1e-12), 4 / (n + np.sum(share) + 1)
    del mass
    for _ in range(rounds):
        z = vb + np.bincount(doc, weights=x * vw[feature], minlength=n)
        r = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - label
        new_w = vw - step * (np.bincount(feature, weights=x * r[doc], minlength=len(value)) + penalty * vw)
        new_b = vb - step_b * r.sum()
        now = (1 + np.sqrt(1 + 4 * last * last)) / 2
        vw, vb = new_w + (last - 1) / now * (new_w - w), new_b + (last - 1) / now * (new_b - b)
        w, b, last = new_w, new_b, now
    return w, b


def ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    return np.log((toxic + 1) / (n_toxic + 2)) - np.log((other + 1) / (n_other + 2))


def held_out(id_col: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _frequencies(bits: int, sizes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), np.int64)
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                for docs, pieces in together([text], sizes):
                    for _, bucket in buckets(docs, pieces, bits, sizes):
                        seen[bucket] = True
                at = np.flatnonzero(seen)  # cheaper than sorting the n-grams of a document
                counts[label][at] += 1
                seen[at] = False
        at = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[1][at]), pa.array(counts[0][at])], ["bucket", "toxic", "other"])

    return run


def _chosen(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, bits, sizes = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                doc, f = present(part.column("text").to_pylist(), bits, sizes, feature)
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.ListArray.from_arrays(ends, pa.array(f, pa.int32()))], ["label", "features"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labels: int = MAX_LABELS, max_bytes: int = MAX_BYTES, bits: int = BITS, sizes: tuple[int, ...] = SIZES, penalty: float = PENALTY, min_docs: int = MIN_DOCS, min_ratio: float = MIN_RATIO, max_features: int = MAX_FEATURES) -> Model:
    """Fits on the labelled rows that aren't held out, at most ``max_labels`` of them and as many as have ``max_bytes`` of text, in the order of a hash of their ids."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("label")).dropna().filter(~held_out(F.col("id")))
    known = known.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_labels)
    read = docs.select(F.col(f"`{id_col}`").alias("id"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    texts = written(read.join(F.broadcast(sample), "id").select("id", "text", "label"), "labelled")
    # Sizes alone are put in order: a row for each labelled id.
    order = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    small = texts.groupBy("id").agg(F.sum(F.octet_length("text")).alias("size")).withColumn("all", F.sum("size").over(order)).filter(F.col("all") <= max_bytes)
    texts = texts.join(F.broadcast(small.select("id")), "id").select("text", "label")
    sizes_by = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = sizes_by.get(1, 0), sizes_by.get(0, 0)
    none = np.full(1 << bits, -1, np.int32)
    if not n_toxic or not n_other:
        return Model(none, np.zeros(0), 30.0 if n_toxic else -30.0, bits, sizes)
    # At most 1 << bits rows, whatever the corpus.
    counts = arrow_map(texts, _frequencies(bits, sizes), "bucket bigint, toxic bigint, other bigint").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter(F.col("toxic") + F.col("other") >= min_docs).toPandas().sort_values("bucket")
    value = ratios(counts["toxic"].to_numpy(), counts["other"].to_numpy(), n_toxic, n_other)
    strong = np.flatnonzero(np.abs(value) >= min_ratio)
    strong = np.sort(strong[np.argsort(-np.abs(value[strong]), kind="stable")][:max_features])
    feature = none.copy()
    feature[counts["bucket"].to_numpy()[strong]] = np.arange(len(strong))
    rows = arrow_map(texts, _chosen(spark.sparkContext.broadcast((feature, bits, sizes))), "label int, features array<int>").toArrow()
    lists = rows.column("features").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    label = rows.column("label").to_numpy().astype(float)
    doc = np.repeat(np.arange(len(label)), np.diff(lists.offsets.to_numpy()))
    w, b = regress(doc, lists.flatten().to_numpy(), value[strong], label, penalty)
    return Model(feature, w * value[strong], b, bits, sizes)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "__text", SLICE_BYTES):
                columns = {n: part.column(n) for n in part.schema.names if n != "__text"}
                columns["score"] = pa.array(model.score(part.column("__text").to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1)."""
    keep = [c for c in docs.columns if c.lower() != "score"]
    work = docs.select(*[F.col(f"`{c}`") for c in keep], text_bytes(F.col(f"`{text_col}`")).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields if f.name != "__text"), "score double"])
    return arrow_map(work, _score(docs.sparkSession.sparkContext.broadcast(model)), schema)
