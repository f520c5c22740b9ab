"""SimHash near-duplicates by the generalised pigeonhole principle.

If ``m`` groups of bits have thresholds that add up to ``tau - m + 1``, two fingerprints within ``tau`` bits are within the threshold of at least
one group; a threshold of -1 leaves a group out. Bits that agree more often than independent ones do are put into one group, so that skew gathers
where it can be left out. Collisions of each group's value are estimated from sketches of all fingerprints, and dynamic programming picks the thresholds, and the
number of groups, with the least estimated work. A group with threshold t gives a key for each choice of t bits left out; rows that share a key are
compared, in blocks where they are many, and only a spanning forest of their links is kept, never all pairs of a group. Keys of very many rows
are found by a count with partial sums and keyed anew by the bits that they leave open, before any row is dealt, so no task gets an unbounded group of
different fingerprints.

Nulls: a null text has no words and the fingerprint zero; a null id sorts below all others. Equal fingerprints are one point, so repeated rows cost
nothing. Texts are read in pieces and may be of any length. An empty table gives no rows. Other columns are ignored or pass through.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import ASCII_SPACE, arrow_map, slices, text_bytes, written
from tracelake.llm.components import _star_of, components

SEED = 42
BITS = 64
#: Buckets up to this size emit their links themselves: at most half of it for each row.
SMALL = 16
#: Buckets above this size are split again by the bits they don't share: in the task, and above the second size before rows are dealt to tasks.
LARGE = 4096
HOT = 1 << 16
#: Estimated cost of an emitted row, in compared pairs.
ROW_COST = 100
#: Buckets of the sketches that estimate collisions: an error of about one hundredth of the number of points.
SKETCH_BITS = 14
#: Places apart up to which the rows of a band are verified against each other before all that are still separate are.
REACH = 2
#: Rows of a band that are put in order in one task; a larger band is put in order by parts.
ORDER_ROWS = 1 << 16
#: Rows and shingles of a band that are compared at once; a larger band is cut into parts, of which every two are compared.
UNIT_ROWS, UNIT_SHINGLES = 2048, 4 << 20
_NULL_ID = -(1 << 63)
_PIECE = 1 << 22
_KEY = ("l", "mask", "key")


# Fingerprints


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included, a piece of the text at a time; a text of fewer words than a shingle is one."""
    at, tail, given = 0, [], False
    while True:
        stop = len(text)
        if stop - at > _PIECE:
            stop = at + _PIECE
            while stop < len(text) and text[stop : stop + 1] not in _SPACES:
                stop += 1
        words = tail + text[at:stop].lower().split()
        at = stop
        last = at >= len(text)
        if len(words) >= size or last and words and not given:
            joined = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            n = max(len(words) - size + 1, 1)
            begins = (ends - sizes)[:n].tolist()
            digest = xxhash.xxh64_intdigest
            yield np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends[min(size, len(words)) - 1 :].tolist(), strict=True)], dtype=np.uint64)
            tail, given = words[n:], True
        else:
            tail = words
        if last:
            return


_SPACES = {bytes([b]) for b in ASCII_SPACE}


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash made from a hash; the first is the hash itself."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def majority(hashes: list[np.ndarray], k: int = 0) -> int:
    """The fingerprint with the bits that are set in over half the hashes."""
    n, ones = 0, np.zeros(BITS, np.int64)
    for part in hashes:
        for lo in range(0, len(part), 1 << 16):
            h = _mixed(part[lo : lo + (1 << 16)], k).astype("<u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = np.array([majority(list(shingle_hashes(t, shingle))) for t in part.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    return arrow_map(read, _fingerprints(shingle), f"doc_id {read.schema['doc_id'].dataType.simpleString()}, fp bigint")


# Groups of bits and their thresholds


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        h = batch.column("fp").to_numpy().astype("<i8")
        for lo in range(0, len(h), 1 << 15):
            part = h[lo : lo + (1 << 15)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(part)
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *(i * BITS + j)], pa.int32()), pa.array([float(n), *total[i, j]])], ["at", "n"])


def correlations(points: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Correlation of every two bits, the share of ones of each, and the number of points: sums over all of them."""
    sums = {r["at"]: r["n"] for r in arrow_map(points.select("fp"), _gram, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()}  # 2081 rows
    n = sums.get(-1, 0.0)
    if not n:
        return np.eye(BITS), np.full(BITS, 0.5), 0
    both = np.zeros((BITS, BITS))
    i, j = np.triu_indices(BITS)
    both[i, j] = both[j, i] = [sums[a * BITS + b] / n for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    p = np.diag(both)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return (both - np.outer(p, p)) / np.outer(sd, sd), p.copy(), int(n)


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """``m`` groups of nearly equal size; each starts from the free bit with the strongest ties and takes those most tied to it."""
    tie = np.abs(correlation) - np.eye(BITS)
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        rest = sorted(free)
        group = [rest[int(np.argmax(tie[np.ix_(rest, rest)].sum(axis=1)))]]
        while len(group) < size:
            rest = sorted(free - set(group))
            group.append(rest[int(np.argmax(tie[np.ix_(rest, group)].sum(axis=1)))])
        groups.append(sorted(group))
        free -= set(group)
    return groups


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def sub_masks(used: int, tau: int) -> list[int]:
    """The bits that ``used`` leaves open in ``tau + 1`` parts: two fingerprints within ``tau`` bits agree in one of them. Empty where too few are left."""
    rest = [b for b in range(BITS) if not used >> b & 1]
    return [_mask(rest[k :: tau + 1]) for k in range(tau + 1)] if len(rest) > tau else []


def keys_of(group: list[int], threshold: int) -> list[int]:
    """The masks of a group's keys: all its bits but ``threshold`` of them, for every choice."""
    if threshold < 0:
        return []
    return [_mask(set(group) - set(gone)) for gone in itertools.combinations(group, min(threshold, len(group)))]


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The thresholds with the least cost that add up to ``total``: dynamic programming over groups and partial sums."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for t, own in group.items():
                if s + t not in step or c + own < step[s + t][0]:
                    step[s + t] = (c + own, [*chosen, t])
        best = step
    return best.get(total, (float("inf"), []))


def _collisions(masks: list[int]):
    """Sketches of the second moment of each group's values: signed sums in buckets, which add up over tasks and need no shuffle of points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(masks), 1 << SKETCH_BITS))
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            salt = batch.column("l").to_numpy().astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for k, mask in enumerate(masks):
                h = _mixed((fp & np.uint64(mask)) ^ salt, 1)
                sums[k] += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), weights=np.where(h & np.uint64(1), 1.0, -1.0), minlength=1 << SKETCH_BITS)
        k, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(bucket, pa.int32()), pa.array(sums[k, bucket])], ["k", "bucket", "n"])

    return run


def choose_keys(points: DataFrame, tau: int) -> list[int]:
    """The masks whose equal values make candidates, for the number of groups and the thresholds with the least estimated work."""
    correlation, p, n = correlations(points)
    options = {m: group_bits(correlation, m) for m in range(max(2, tau - 1), tau + 2)}
    masks = sorted({_mask(g) for groups in options.values() for g in groups})
    sketched = arrow_map(points.select("l", "fp"), _collisions(masks), "k int, bucket int, n double").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    squares = sketched.groupBy("k").agg(F.sum(F.col("n") * F.col("n")).alias("f2"))
    pairs = {masks[r["k"]]: max(r["f2"] - n, 0.0) / 2 for r in squares.collect()}
    agree = p * p + (1 - p) * (1 - p)  # of a bit in two points
    best = (float("inf"), [], [])
    for m, groups in options.items():
        costs = []
        for g in groups:
            own = {-1: 0.0, 0: pairs.get(_mask(g), 0.0) + ROW_COST * n}
            for t in (1, 2):
                left_out = [np.prod(1 / agree[list(c)]) for c in itertools.combinations(g, t)]
                own[t] = pairs.get(_mask(g), 0.0) * float(np.sum(left_out)) + ROW_COST * n * len(left_out)
            costs.append(own)
        cost, chosen = allocate(costs, tau - m + 1)
        if cost < best[0]:
            best = (cost, groups, chosen)
    return [mask for g, t in zip(best[1], best[2], strict=True) for mask in keys_of(g, t)]


# Comparing the rows of a key


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int32)


class Rows:
    """Points that may be compared: id, fingerprint, and for verified links a size and a sketch (two words)."""

    def __init__(self, node, fp, size=None, sketch=None, tau: int = 2, similarity: float | None = None, sketch_tau: int = 128):
        self.node, self.fp, self.size, self.sketch, self.tau, self.similarity, self.sketch_tau = node, fp, size, sketch, tau, similarity, sketch_tau

    def weight(self, i, j) -> np.ndarray:
        """The distance of links, and a large number where there is none."""
        d = _popcount(self.fp[i] ^ self.fp[j])
        ok = d <= self.tau
        if self.sketch is None:
            return np.where(ok, d, 9999)
        a, b = self.size[i], self.size[j]
        ok &= np.minimum(a, b) >= self.similarity * np.maximum(a, b)
        s = _popcount(self.sketch[i, 0] ^ self.sketch[j, 0]) + _popcount(self.sketch[i, 1] ^ self.sketch[j, 1])
        return np.where(ok & (s <= self.sketch_tau), s, 9999)


def small_links(rows: Rows, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All links inside runs that begin at ``first``: row i against row i + d, for all runs at once."""
    left, right = [], []
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(first, size) + place
    room = np.repeat(size, size) - place  # rows from here to the end of the run
    for d in range(1, int(size.max()) if len(size) else 1):
        i = at[room > d]
        ok = rows.weight(i, i + d) < 9999
        left.append(i[ok])
        right.append(i[ok] + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest(rows: Rows, members: np.ndarray, used: int) -> tuple[list[int], list[int]]:
    """A shortest spanning forest of the members' links. ``used``: the bits in which they agree by their key.

    Very many members are split by the pigeonhole principle in the bits that are left, and the forests of the parts are given together.
    """
    left, right = [], []
    parts, pairs = [], 0
    for mask in sub_masks(used, rows.tau) if len(members) > LARGE else ():
        order = members[np.argsort(rows.fp[members] & np.uint64(mask), kind="stable")]
        value = rows.fp[order] & np.uint64(mask)
        cuts = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(order)]])
        parts.append((mask, order, cuts))
        pairs += int(np.sum(np.diff(cuts) ** 2))
    if parts and pairs < len(members) ** 2:  # only where it saves comparisons: rows that agree in nearly all bits can't be split
        for mask, order, cuts in parts:
            for lo, hi in itertools.pairwise(cuts.tolist()):
                if hi - lo > 1:
                    a, b = forest(rows, order[lo:hi], used | mask)
                    left += a
                    right += b
        return left, right
    far = np.full(len(members), 9999, np.int32)
    near = np.zeros(len(members), np.int64)
    open_ = np.ones(len(members), bool)
    at = 0
    for _ in range(len(members) - 1):
        open_[at] = False
        w = rows.weight(members[at], members)
        better = open_ & (w < far)
        far[better] = w[better]
        near[better] = at
        at = int(np.argmin(np.where(open_, far, 10000)))
        if far[at] < 9999:
            left.append(int(members[near[at]]))
            right.append(int(members[at]))
    return left, right


def _links(tau: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            get = lambda n, kind=np.int64: t.column(n).to_numpy().astype(kind, copy=False)
            node, fp = get("node"), get("fp").view(np.uint64)
            rows = Rows(node, fp, tau=tau)
            key, l, mask = get("key"), get("l", np.int32), get("mask").view(np.uint64)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (mask[1:] != mask[:-1]) | (l[1:] != l[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(key)))
            few = (size > 1) & (size <= SMALL)
            a, b = small_links(rows, first[few], size[few])
            left, right = [a], [b]
            for f, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
                x, y = forest(rows, np.arange(f, f + n), int(mask[f]))
                left.append(np.array(x, np.int64))
                right.append(np.array(y, np.int64))
            i, j = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [batch.column(n)[-1].as_py() for n in _KEY]
            same = np.logical_and.reduce([batch.column(n).to_numpy(zero_copy_only=False) == e for n, e in zip(_KEY, ends, strict=True)])
            other = np.flatnonzero(~same)
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut or held and [held[0].column(n)[-1].as_py() for n in _KEY] != ends:
                yield from done([*held, batch.slice(0, cut)] if cut else held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from done(held)

    return run


def without_hot_keys(rows: DataFrame, tau: int) -> DataFrame:
    """``rows`` (l, mask, key, fp, ...) with keys of more than ``HOT`` rows replaced by finer ones, where that saves comparisons.

    A finer key adds a part of the open bits to the mask; each row of a hot key gets one for every part, and links are neither lost nor added.
    Keys that stay hot hold rows that agree in nearly all bits: at most a few if all fingerprints differ.
    """
    settled: list[DataFrame] = []
    while True:
        hot = written(rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT), "hot")
        masks = [r["mask"] for r in hot.select("mask").distinct().collect()]  # masks, not keys
        finer = [F.struct(F.lit(m).cast("long").alias("mask"), F.lit(_signed(x)).cast("long").alias("open")) for m in masks for x in sub_masks(m % (1 << 64), tau)]
        if not finer:
            break
        by_mask = F.filter(F.array(*finer), lambda x: x["mask"] == F.col("mask"))
        again = rows.join(hot, list(_KEY)).withColumn("open", F.explode(F.transform(by_mask, lambda x: x["open"])))
        sizes = again.groupBy(*_KEY, "n", "open", F.col("fp").bitwiseAND(F.col("open")).alias("value")).agg(F.count(F.lit(1)).cast("double").alias("part"))
        pairs = sizes.groupBy(*_KEY, "n").agg(F.sum(F.col("part") * F.col("part")).alias("pairs"))
        saved = written(pairs.filter(F.col("pairs") < F.col("n").cast("double") * F.col("n")).select(*_KEY), "split")
        if saved.isEmpty():
            break
        settled.append(rows.join(saved, list(_KEY), "left_anti"))
        names = rows.columns
        again = again.join(saved, list(_KEY), "left_semi").withColumn("mask", F.col("mask").bitwiseOR(F.col("open")))
        rows = written(again.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).select(names), "finer")
    for part in settled:
        rows = rows.unionByName(part)
    return rows


def candidate_links(points: DataFrame, tau: int) -> DataFrame:
    """Links (a, b) of ``points`` (l, node, fp, ...): for every key a spanning forest of the links of its rows.

    ``l`` tells independent fingerprints of a node apart. Rows of one key are points that differ; of their links those of a shortest forest are enough
    for the components, and small keys give all.
    """
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in choose_keys(points, tau)])
    rows = points.select("l", "node", "fp", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = without_hot_keys(rows, tau).repartition(n, *_KEY).sortWithinPartitions(*_KEY)
    return arrow_map(dealt, _links(tau), "a bigint, b bigint").distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, tau: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: fingerprints link at ``tau`` or fewer differing bits, and the id is the smallest that a document reaches."""
    signed = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    points = written(signed.groupBy("fp").agg(F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))).alias("node")).withColumn("l", F.lit(0)), "points")
    roots = components(candidate_links(points, tau))
    named = written(points.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")), "named")
    return signed.join(named, "fp").select("doc_id", "fp", F.nullif(F.col("component_id"), F.lit(_NULL_ID)).alias("component_id"))


# Near-duplicates verified by the shingles themselves


def bands_for(missed: float, similarity: float, rows: int) -> int:
    """So many bands that two sets of at least ``similarity`` share none with a chance of at most ``missed``, whatever way they differ."""
    return max(1, math.ceil(math.log(missed) / math.log1p(-(similarity**rows)))) if similarity < 1 else 1


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band: ``rows`` minima of the hashes under independent multiplications. Two sets share a band with the chance similarity ** rows."""
    random = np.random.default_rng(SEED)
    factor = random.integers(0, 1 << 64, bands * rows, np.uint64) | np.uint64(1)
    shift = random.integers(0, 1 << 64, bands * rows, np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(shingles), 512):
            np.minimum(least, (shingles[lo : lo + 512, None] * factor + shift).min(axis=0), out=least)
    key = np.arange(bands, dtype=np.uint64)
    for k, part in enumerate(least.reshape(bands, rows).T):
        key = _mixed(key ^ part, k + 1)
    return key


def _shingle_set(text: bytes, shingle: int) -> np.ndarray:
    own = [np.unique(h) for h in shingle_hashes(text, shingle)]
    return np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)


def _signatures(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names, sizes, keys, fps = [], [], [], []
                for t in part.column("text").to_pylist():
                    own = _shingle_set(t, shingle)
                    names.append(xxhash.xxh3_128_digest(own.tobytes()))
                    sizes.append(len(own))
                    keys.append(band_keys(own, bands, rows))
                    fps.append(majority([own]))
                flat = np.concatenate(keys).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, bands, dtype=np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), lists, pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "same", "size", "keys", "fp"])

    return run


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [_shingle_set(t, shingle).tobytes() for t in part.column("text").to_pylist()]
                names = [xxhash.xxh3_128_digest(x) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["same", "shingles"])

    return run


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(shared >= similarity * (len(x) + len(y) - shared))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def neighbours(rows: DataFrame, similarity: float, reach: int, salt: int) -> DataFrame:
    """Pairs (a, b) of each key's rows (key, node, size, n, root) up to ``reach`` places apart in a random order, of other roots and of sizes that allow the similarity.

    ``n`` is the number of a key's rows: those of a very large key are put in order by parts, so none has to be held by one task.
    """
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / ORDER_ROWS))
    order = Window.partitionBy("key", part).orderBy(F.xxhash64("node", F.lit(salt)), "node")
    before = F.array(*[F.lag(F.struct("node", "size", "root"), d).over(order) for d in range(1, reach + 1)])
    both = rows.withColumn("before", before).select("node", "size", "root", F.explode("before").alias("o"))
    return _pairs(both, F.col("o.node"), F.col("o.size"), F.col("o.root"), similarity)


def open_keys(keyed: DataFrame, roots: DataFrame, done: int) -> DataFrame:
    """The rows of keys with more than ``done`` rows and more than one root, their roots, and into how many parts a key has to be cut."""
    rows = keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter((F.col("n") > done) & (F.col("lo") < F.col("hi")))
    parts = F.greatest(F.ceil(F.col("n") / UNIT_ROWS), F.ceil(F.col("shingles") / UNIT_SHINGLES))
    return rows.join(several.select("key", parts.alias("parts")), "key").select("key", "node", "root", "parts")


def units(rows: DataFrame) -> DataFrame:
    """A row of ``open_keys`` for each two parts that are compared, its own among them: key, lo, hi, part, node, root."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return dealt.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "root")


def alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float, width: int = 4096) -> np.ndarray:
    """Which of the rows ``left`` and ``right`` of ``sets`` are at least so similar: shared shingles are counted by products of blocks of zeros and ones."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, several = np.repeat(np.arange(len(sets)), sizes), (seen > 1)[code]
    row, code = row[several], (np.cumsum(seen > 1) - 1)[code[several]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    shared = np.zeros((len(left), len(right)), np.float32)  # whole numbers, exact below 2 ** 24
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, (lo, lo + width))
        block = np.zeros((len(sets), width), np.float32)
        block[row[a:b], code[a:b] - lo] = 1
        shared += block[left] @ block[right].T
    return shared >= similarity * (sizes[left][:, None] + sizes[right][None, :] - shared.astype(np.float64))


def _unit_links(similarity: float):
    """Links of units (sorted): of each a star for every component that it joins, never all pairs."""
    same = ("key", "lo", "hi")

    def links(rows: list[dict]) -> pa.RecordBatch | None:
        node, root, part = (np.array([r[c] for r in rows]) for c in ("node", "root", "part"))
        left, right = (np.flatnonzero(part == rows[0][c]) for c in ("lo", "hi"))
        if not len(left) or not len(right):
            return None
        ok = alike([np.frombuffer(r["shingles"], np.uint64) for r in rows], left, right, similarity)
        i, j = np.nonzero(ok & (root[left][:, None] != root[right][None, :]))
        return _star_of([np.stack([node[left[i]], node[right[j]]])]) if len(i) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(row[c] != held[0][c] for c in same):
                    if found := links(held):
                        yield found
                    held = []
                held.append(row)
        if held and (found := links(held)):
            yield found

    return run


def _pairs(both: DataFrame, node, size, root, similarity: float) -> DataFrame:
    near = (F.col("root") != root) & (F.least("size", size) >= F.lit(similarity) * F.greatest("size", size))
    return both.filter(near).select(F.least("node", node).alias("a"), F.greatest("node", node).alias("b")).distinct()


def fingerprint_links(nodes: DataFrame, tau: int) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp) by the pigeonhole search: one of each fingerprint stands for it, and the others are paired with that one."""
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("node")).withColumn("l", F.lit(0)), "fingerprints")
    same = nodes.select("node", "fp").join(first.select("fp", F.col("node").alias("a")), "fp").filter(F.col("node") != F.col("a"))
    return candidate_links(first, tau).select("a", "b").union(same.select("a", F.col("node").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, missed: float = 1e-6, rows: int = 5, id_col: str = "doc_id", text_col: str = "text", tau: int = 2) -> DataFrame:
    """doc_id and component_id, the smallest id that a document reaches over links.

    A link is a Jaccard similarity of the sets of ``shingle``-word shingles of at least ``similarity``, computed exactly. Candidates are documents whose fingerprints of
    these sets differ in at most ``tau`` bits, found by the pigeonhole search, and, as links may lie further apart than any such search reaches, documents that share a
    band of ``rows`` MinHashes of these sets; there are so many bands that a link is overlooked with a chance of at most ``missed`` however the
    texts differ, and far less above the threshold. Documents without words are not duplicates.

    A null id sorts below all others and comes back as null. Rows are told apart by their texts, so rows that share an id get the component of their own text; rows
    with equal shingles are one node, and repeated rows cost nothing more. Texts of any length are read whole. An empty table gives no rows; other columns are ignored.
    """
    bands = bands_for(missed, similarity, rows)
    read = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    signed = written(arrow_map(read, _signatures(shingle, bands, rows), "doc_id bigint, same binary, size bigint, keys array<bigint>, fp bigint"), "signatures")
    # Documents with the same shingles are one node; texts that share an id are not.
    nodes = signed.filter("size > 0").groupBy("same").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    keyed = written(keyed.join(shared, "key").select("key", "node", "size", "n"), "keys")
    close = written(fingerprint_links(nodes, tau), "close")
    compared = keyed.select("node").union(close.select("a")).union(close.select("b")).distinct()
    wanted = written(nodes.join(compared, "node").select("same", "node", "least"), "wanted")
    texts = read.join(wanted.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
    sets = arrow_map(texts, _shingle_sets(shingle), "same binary, shingles binary").join(wanted.select("same", "node"), "same")
    sets = written(sets.dropDuplicates(["node"]).select("node", "shingles"), "sets")

    def verified(links: DataFrame) -> DataFrame:
        both = links.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        return written(arrow_map(both, _verify(similarity), "a bigint, b bigint"), "verified")

    # Fingerprints and neighbours in a random order join most components. Where a key still holds rows of several ones, all its rows of different ones are compared.
    first = verified(neighbours(keyed.withColumn("root", F.col("node")), similarity, REACH, 0).union(close).distinct())
    roots = components(first)
    left = written(open_keys(keyed, roots, REACH + 1), "left")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units(left).join(sets, "node").repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    more = arrow_map(dealt.select("key", "lo", "hi", "part", "node", "root", "shingles"), _unit_links(similarity), "a bigint, b bigint")
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = nodes.select("node", "same", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(least, "root").select("same", "component_id"), "named")
    null = lambda c: F.nullif(c, F.lit(_NULL_ID))
    return signed.join(named, "same", "left").select(null(F.col("doc_id")).alias("doc_id"), null(F.coalesce("component_id", "doc_id")).alias("component_id"))
