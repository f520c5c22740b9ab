"""Jaccard join of documents' sets of word n-grams by T-occurrence search.

Two sets of similarity ``percent`` share at least T of their grams. A query's inverted lists are divided into short and long ones (DivideSkip): with L long lists, a document that is on T of the
lists is on T - L of the short ones, so short lists are merged by a heap that skips what can't get there, and candidates are looked up in the long lists by binary search. Candidates that reach the overlap
their size requires are retained.

The lists of the whole corpus are too many for a task, so the division is made twice. Between tasks, with L = T - 1: every set gives its ``n - T + 1`` rarest grams, which are its short lists, to a shuffle, and sets
that have one in common are candidates. Rare is a level of a sketch of all grams' document counts (a fixed number of counters, summed over tasks), ties in the order of hashes; any order of all grams
gives right results, and this one keeps lists short. Within a task the candidates' whole sets make an inverted index that is searched with the best L.

Lists of the shuffle may hold very many copies of a text. Each of their rows is a candidate for the next ``REACH`` ones in the order of sizes, by sizes and places, and by the bits of both sets: a gram turns one bit over, so sets
differ in no more bits than grams. This leaves out nearly all that share a gram by chance, which in a large corpus would connect most of it. What candidates connect is dealt to units, in parts
where it is large, so a set is sent once, as its compressed text, and each unit is searched as a whole. Sets are made from texts where they are needed; only ids, places and bits are kept. Similar sets are of one level or of two levels that follow each
other, if a level is a range of sizes as wide as the similarity allows. So all is compared but rows of such two levels of a list where these are more than ``REACH + 1``, or of what was cut in parts, which is one more list. Where they are of several
components, they are dealt anew in a random order, while links are found, ``ROUNDS`` times at most. Then each row outside the largest component is searched for among all rows of the two levels, in blocks.
So no link between components is missed, links inside a component aren't all made, and only the largest component's rows are sent once a block of queries.

Equal sets are one node: copies of a text cost nothing after the first in a task. Grams are 64-bit hashes of their words, so sets are equal, and shingles the same, but for collisions.

Defined results: words are runs of anything but ASCII white space, A-Z in lower case. Fewer words than a gram has are one gram; a text without words, null or empty, has an empty set and is linked with
nothing. A null id sorts below all others and comes back as null. Rows that share an id get the component of their own text. Texts of any length are read whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import arrow_map, remove, slices, text_bytes, written
from tracelake.llm.components import _star_of, components

SEED = 42
#: Counters of the sketch, and of one of its blocks.
SKETCH_BITS, BLOCK_BITS = 22, 16
#: Places apart up to which rows of a list are candidates in a round, and rounds.
REACH, ROUNDS = 63, 3
#: Rows of a list that are put in order in one task; a larger list is put in order by parts.
ORDER_ROWS = 1 << 16
#: Rows of units up to which they are broadcast to the texts: 40 bytes each.
BROADCAST_ROWS = 1 << 20
#: Rows and grams of an index in a task.
UNIT_ROWS, UNIT_GRAMS = 4096, 2 << 20
#: Postings of short lists up to which a heap merges them; more are merged by one stable sort of the sorted lists.
HEAP_POSTINGS = 4096
#: The weight of a binary search in DivideSkip's number of long lists.
MU = 0.0085
#: Names of sets whose grams a task has given already.
SEEN = 200_000
#: Bytes of compressed texts that are read at once.
READ_BYTES = 4 << 20
_NULL_ID = -(1 << 63)


# Sets of grams


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's grams of ``size`` words (``texts``: binary, no nulls). Each distinct word is hashed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    coded = lists.flatten().dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.view(pa.binary()).to_pylist()], np.uint64)
    code, bounds = coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    blank = pc.index_in(pa.array([""]), coded.dictionary)[0].as_py()
    word = code != (-1 if blank is None else blank)  # white space at an end makes an empty word
    ends = np.concatenate([[0], np.cumsum(word)])[bounds]
    words = hashes[code[word]] if len(hashes) else np.zeros(0, np.uint64)
    factor = np.random.default_rng(SEED).integers(0, 1 << 64, size, np.uint64) | np.uint64(1)
    n = max(len(words) - size + 1, 0)
    grams = np.zeros(n, np.uint64)
    for k in range(size):
        grams += words[k : k + n] * factor[k]
    grams = _mixed(grams)
    out = []
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        if hi - lo >= size:
            out.append(np.unique(grams[lo : hi - size + 1]))
        elif hi > lo:
            out.append(_mixed((words[lo:hi] * factor[: hi - lo]).sum(keepdims=True) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _name(grams: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), "<i8")


def parity(grams: np.ndarray) -> np.ndarray:
    """Bits that a set's grams turn over, a power of two of them and at least half as many as grams, in words of 64."""
    words = 1 << max(0, -(-len(grams) // 128) - 1).bit_length()
    odd = np.bincount((grams & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _signed(size: int, sketch_bits: int):
    """Rows (doc_id, name, rest, size, bits) of documents, and (block, counts) of the task's share of the sketch."""
    block = min(BLOCK_BITS, sketch_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << sketch_bits, np.uint32)
        names, words = ["doc_id", "name", "rest", "size", "bits", "block", "counts"], pa.list_(pa.int64())
        for batch in batches:
            for part in slices(batch, "text"):
                sets = gram_sets(part.column("text"), size)
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - sketch_bits)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
                both = np.array([_name(s) for s in sets])
                n, none = len(sets), pa.nulls(len(sets), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], words), none, pa.nulls(n, pa.binary())], names)
        for k, own in enumerate(counts.reshape(-1, 1 << block)):
            if own.any():
                small = next(t for t in (np.uint8, np.uint16, np.uint32) if own.max() <= np.iinfo(t).max)
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, words), pa.array([k], pa.int32()), pa.array([zlib.compress(own.astype(small).tobytes(), 1)], pa.binary())], names)

    return run


def _levels(block_bits: int):
    """A block's counts, of which each task gave some, as levels of half a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = held.setdefault(k, np.zeros(1 << block_bits, np.int64))
                plain = zlib.decompress(raw)
                own += np.frombuffer(plain, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(plain) >> block_bits])
        for k, own in held.items():
            level = (2 * np.log2(np.maximum(own, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "levels"])

    return run


def _least(share: int, of: int, n: int) -> int:
    return -(-share * n // of)


def _short_lists(size: int, percent: int, levels, sketch_bits: int):
    """Rows (gram, name, place) of each set's rarest grams, so many that two similar sets share one; sets that the task has seen are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                grams, names, places = [np.zeros(0, np.uint64)], [], []
                for own in gram_sets(part.column("text"), size):
                    name = _name(own)
                    if not len(own) or name.tobytes() in seen:
                        continue
                    if len(seen) == SEEN:
                        seen.clear()
                    seen.add(name.tobytes())
                    k = len(own) - _least(percent, 100, len(own)) + 1
                    rare = level[(own >> np.uint64(64 - sketch_bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | own & np.uint64((1 << 56) - 1)
                    first = np.argpartition(rare, k - 1)[:k] if k < len(own) else np.arange(len(own))
                    grams.append(own[first[np.argsort(rare[first])]])
                    names.append(np.full(k, name[0]))
                    places.append(np.arange(k, dtype=np.int32))
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(names)), pa.array(np.concatenate(places))], ["gram", "name", "place"])

    return run


def _whole_texts(size: int):
    """(name, text) of each different set of a task: a compressed text is a third of its grams' hashes or less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                own, texts = {}, part.column("text")
                for k, grams in enumerate(gram_sets(texts, size)):
                    name = int(_name(grams)[0])
                    if name not in seen and name not in own:
                        own[name] = zlib.compress(texts[k].as_py(), 1)
                seen = seen | own.keys() if len(seen) < SEEN else set(own)
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.binary())], ["name", "text"])

    return run


def _sets_of(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sets of compressed texts, of which a few megabytes are read at once."""
    some, held = [], 0
    for text in texts:
        some.append(zlib.decompress(text))
        held += len(some[-1])
        if held > READ_BYTES:
            yield from gram_sets(pa.array(some, pa.binary()), size)
            some, held = [], 0
    if some:
        yield from gram_sets(pa.array(some, pa.binary()), size)


# Search in a task


class Index:
    """Inverted lists of some sets, which are numbered by size. A list's place and a number are one code, so a search for a number on many lists is one search in all codes."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.order = np.argsort([len(s) for s in sets], kind="stable")
        self.sizes = np.array([len(sets[k]) for k in self.order])
        self.percent, self.rows = percent, len(sets)
        flat = np.concatenate([sets[k] for k in self.order])
        number = np.repeat(np.arange(self.rows), self.sizes)
        by_gram = np.argsort(flat, kind="stable")
        self.grams, first, place = np.unique(flat[by_gram], return_index=True, return_inverse=True)
        self.numbers = number[by_gram]
        self.codes = place * self.rows + self.numbers
        self.bounds = np.append(first, len(flat))

    def search(self, query: np.ndarray) -> np.ndarray:
        """Which sets are at least so similar to the query."""
        n, p = len(query), self.percent
        lo, hi = np.searchsorted(self.sizes, (_least(p, 100, n), 100 * n // p + 1))
        at = np.searchsorted(self.grams, query)
        at = at[at < len(self.grams)] if len(at) and at[-1] == len(self.grams) else at
        lists = at[self.grams[at] == query[: len(at)]]
        least = _least(p, 100, n)
        if lo == hi or len(lists) < least:
            return np.zeros(0, np.int64)
        lengths = self.bounds[lists + 1] - self.bounds[lists]
        lists = lists[np.argsort(lengths, kind="stable")]
        n_long = min(least - 1, int(least / (MU * np.log2(lengths.max()) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        found, counts = self._merged(short, least - n_long)
        inside = (found >= lo) & (found < hi)
        found, counts = found[inside], counts[inside]
        need = -(-p * (n + self.sizes[found]) // (100 + p))
        step = max(1, (1 << 20) // max(1, len(found)))
        for a in range(0, len(long), step):
            some = long[a : a + step]
            left = counts + len(long) - a >= need
            found, counts, need = found[left], counts[left], need[left]
            code = some[:, None] * self.rows + found[None, :]
            place = np.searchsorted(self.codes, code.ravel()).clip(max=len(self.codes) - 1)
            counts = counts + (self.codes[place] == code.ravel()).reshape(code.shape).sum(axis=0)
        return self.order[found[counts >= need]]

    def _merged(self, lists: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers that are on at least ``least`` of the lists, and on how many."""
        starts, stops = self.bounds[lists], self.bounds[lists + 1]
        if (stops - starts).sum() > HEAP_POSTINGS:
            merged = np.sort(np.concatenate([self.numbers[a:b] for a, b in zip(starts, stops, strict=True)]), kind="stable")
            first = np.flatnonzero(np.append(True, merged[1:] != merged[:-1]))
            counts = np.diff(np.append(first, len(merged)))
            return merged[first][counts >= least], counts[counts >= least]
        stops, numbers = stops.tolist(), self.numbers
        heap = [(int(numbers[a]), a, j) for j, a in enumerate(starts.tolist())]
        heapq.heapify(heap)
        found, counts = [], []
        while len(heap) >= least:
            top, taken = heap[0][0], []
            while heap and heap[0][0] == top:
                taken.append(heapq.heappop(heap))
            if len(taken) >= least:
                found.append(top)
                counts.append(len(taken))
                to = top + 1
            else:
                # Numbers before the least-th head can't be on enough lists.
                taken += [heapq.heappop(heap) for _ in range(min(least - 1 - len(taken), len(heap)))]
                if not heap:
                    break
                to = heap[0][0]
            for _, a, j in taken:
                a = bisect_left(numbers, to, a, stops[j])
                if a < stops[j]:
                    heapq.heappush(heap, (int(numbers[a]), a, j))
        return np.array(found, np.int64), np.array(counts, np.int64)


def _unit_links(size: int, percent: int):
    """Links between roots of units (sorted): rows that ask are searched for among those that are held. Of each unit a star for every component that it joins, never all pairs."""

    def links(rows: list[tuple]) -> pa.RecordBatch | None:
        held, asks = [r for r in rows if r[3]], [r for r in rows if r[2]]
        if not held or not asks or all(r[1] == rows[0][1] for r in rows):
            return None
        index = Index([r[4] for r in held], percent)
        pairs = [(q[0], held[k][0]) for q in asks for k in index.search(q[4]).tolist() if q[1] != held[k][1]]
        return _star_of([np.array(pairs, np.int64).T]) if pairs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("unit", "node", "root", "asks", "held")]
            for u, node, root, asks, held, grams in zip(*columns, _sets_of(batch.column("text").to_pylist(), size), strict=True):
                if u != unit:
                    if rows and (star := links(rows)):
                        yield star
                    unit, rows = u, []
                if not rows or (rows[-1][0], rows[-1][2:4]) != (node, (asks, held)):  # several tasks may have made the set
                    rows.append((node, root, asks, held, grams))
        if rows and (star := links(rows)):
            yield star

    return run


# Links between tasks


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Each row's bits as if there were so many words."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def _few_bits_apart(percent: int):
    """Pairs (a, b) whose sets may be so similar: each gram of one set alone turns one bit over. The longer one's words are folded to as many as the shorter one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(c).to_numpy() for c in ("a_size", "b_size")]
            bits = [batch.column(c) for c in ("a_bits", "b_bits")]
            words = np.stack([pc.list_value_length(x).to_numpy() for x in bits])
            first = [x.offsets.to_numpy()[:-1] for x in bits]
            flat = [x.values.to_numpy() for x in bits]
            apart = np.abs(sizes[0] - sizes[1])
            for n, m in np.unique(words, axis=1).T.tolist():
                at = np.flatnonzero((words[0] == n) & (words[1] == m))
                least = min(n, m)
                x, y = (_folded(flat[k][first[k][at][:, None] + np.arange(w)], least) for k, w in enumerate((n, m)))
                apart[at] = np.maximum(apart[at], np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=1, dtype=np.int64))  # of signed numbers it would count the absolute value's
            near = np.flatnonzero((100 + percent) * apart <= (100 - percent) * (sizes[0] + sizes[1]))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(near)), batch.column("b").take(pa.array(near))], ["a", "b"])

    return run


def alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that the bits of ``nodes`` don't rule out."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("bits").alias(f"{c}_bits"))
    return arrow_map(pairs.join(of("a"), "a").join(of("b"), "b"), _few_bits_apart(percent), "a bigint, b bigint")


def neighbours(rows: DataFrame, possible: Callable[[Column, Column], Column], salt: int) -> DataFrame:
    """Pairs (a, b) of each list's rows (key, node, root, n and what ``possible`` takes) up to ``REACH`` places apart, of other roots, that are ``possible``: by size, later by chance."""
    first = [F.col("size")] if salt == 0 else []
    part = F.when(F.col("n") > ORDER_ROWS, F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(F.col("n") / ORDER_ROWS))).otherwise(0)
    order = Window.partitionBy("key", part).orderBy(*first, F.xxhash64("node", F.lit(salt)), "node")
    row = F.struct("node", "root", "size", "place")
    before = F.array(*[F.lag(row, d).over(order) for d in range(1, REACH + 1)])
    both = rows.select(row.alias("x"), before.alias("before")).select("x", F.explode(F.filter("before", lambda y: y.isNotNull() & (F.col("x.root") != y["root"]) & possible(F.col("x"), y))).alias("y"))
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def candidate_units(pairs: DataFrame, nodes: DataFrame, salt: int) -> DataFrame:
    """Units of what the pairs connect (``near``): every row asks all rows of its unit. ``parts`` is over 1 where something is too large for a unit and was dealt to several."""
    near = components(pairs)
    work = written(near.withColumnRenamed("root", "near").join(nodes.select("node", "size", "root"), "node"), "near")
    parts = work.groupBy("near").agg(F.greatest(F.ceil(F.count(F.lit(1)) / UNIT_ROWS), F.ceil(F.sum("size") / UNIT_GRAMS)).alias("parts"))
    dealt = work.join(written(parts, "parts"), "near")
    return dealt.select(F.xxhash64("near", F.pmod(F.xxhash64("node", F.lit(salt)), "parts")).alias("unit"), "node", "root", F.lit(True).alias("asks"), F.lit(True).alias("held"), "near", "size", "parts")


def cut_lists(units: DataFrame) -> DataFrame:
    """What was dealt to several units, as lists."""
    large = units.filter("parts > 1")
    n = large.groupBy("near").agg(F.count(F.lit(1)).alias("n"))
    return large.join(n, "near").select(F.xxhash64("near").alias("key"), "node", "size", F.lit(0).alias("place"), "n")


def open_rows(rows: DataFrame, roots: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """What may hold links that weren't searched for: rows of a list and of two levels of size, if they are of several roots and more than ``REACH + 1``, or some were ``cut``.

    ``key`` is that list's now; with the number of its rows and grams, the root that most of them have, and the number of others.
    """
    # No other list has that many rows of two levels, so the short ones, nearly all, are left out at once. A list that was put in order by parts is open at any number.
    some, short = rows.filter(F.col("n") > REACH + 1), rows.filter(F.col("n") <= REACH + 1)
    if not cut.isEmpty():
        inside = written(short.join(cut.select("node").distinct(), "node", "left_semi").select("key").distinct(), "inside")
        some = some.unionByName(short.join(inside, "key", "left_semi"))
    level = F.floor(F.log(F.col("size").cast("double")) / (math.log(100 / percent) * (1 + 1e-9))) if percent < 100 else F.col("size")
    rooted = some.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted.join(cut.select("node").distinct().withColumn("cut", F.lit(1)), "node", "left").withColumn("level", level.cast("long")), "rooted")
    lower = F.explode(F.array(F.col("level") - 1, F.col("level"))).alias("lower")
    by_parts = F.when(F.max("n") > ORDER_ROWS, 1)
    own = rooted.groupBy("key", "level", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"), F.coalesce(F.max("cut"), by_parts).alias("cut"))
    own = own.select("key", lower, "root", "n", "grams", "cut").groupBy("key", "lower", "root").agg(F.sum("n").alias("n"), F.sum("grams").alias("grams"), F.max("cut").alias("cut"))
    lists = own.groupBy("key", "lower").agg(F.sum("n").alias("n"), F.sum("grams").alias("grams"), F.max(F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("roots"), F.max("cut").alias("cut"))
    several = lists.filter(((F.col("n") > REACH + 1) | F.col("cut").isNotNull()) & (F.col("roots") > 1))
    several = written(several.select("key", "lower", "n", "grams", F.col("most.root").alias("largest"), (F.col("n") - F.col("most.n")).alias("others")), "several")
    found = rooted.drop("n", "cut").select("*", lower).join(several, ["key", "lower"])
    return written(found.withColumn("key", F.xxhash64("key", "lower")).drop("level", "lower"), "open")


def whole_units(rows: DataFrame) -> DataFrame:
    """Units of ``open_rows``: each row outside a list's largest root asks all rows of its list; both are dealt in parts, and each part of the one meets each of the other."""
    size = F.greatest(F.ceil(F.col("n") / UNIT_ROWS), F.ceil(F.col("grams") / UNIT_GRAMS))
    cut = rows.withColumn("parts", size).withColumn("asking", F.ceil(size * F.col("others") / F.col("n")))
    spread = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    share = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    held = cut.select("key", share("parts").alias("i"), spread("asking").alias("j"), "node", "root", F.lit(False).alias("asks"), F.lit(True).alias("held"))
    asks = cut.filter("root != largest").select("key", spread("parts").alias("i"), share("asking").alias("j"), "node", "root", F.lit(True).alias("asks"), F.lit(False).alias("held"))
    return held.unionByName(asks).select(F.xxhash64("key", "i", "j").alias("unit"), "node", "root", "asks", "held")


def _asked_alike(percent: int):
    """(unit, node, asks) of those rows of units (sorted) whose bits don't rule out a link between a row that asks and one that is held, of different roots."""

    def kept(rows: list[tuple]) -> list[tuple]:
        out, held = set(), {}
        for r in rows:
            if r[4]:
                held.setdefault(len(r[6]), []).append(r)
        for words, own in held.items():
            node, root, size = (np.array([r[k] for r in own]) for k in (1, 2, 5))
            bits, folded = np.array([r[6] for r in own], np.int64).view(np.uint64), {}
            for q in rows:
                if q[3]:
                    least = min(words, len(q[6]))
                    if least not in folded:
                        folded[least] = _folded(bits, least)
                    apart = np.bitwise_count(folded[least] ^ _folded(np.array([q[6]], np.int64).view(np.uint64), least)).sum(axis=1, dtype=np.int64)
                    apart = np.maximum(apart, np.abs(size - q[5]))
                    near = ((100 + percent) * apart <= (100 - percent) * (size + q[5])) & (root != q[2])
                    if near.any():
                        out.add((q[0], q[1], True))
                        out.update((q[0], k, False) for k in node[near].tolist())
        return sorted(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        schema = pa.schema([("unit", pa.int64()), ("node", pa.int64()), ("asks", pa.bool_())])
        made = lambda some: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)  # noqa: B905, E731
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("unit", "node", "root", "asks", "held", "size", "bits")), strict=True):
                if rows and rows[-1][0] != row[0]:
                    if some := kept(rows):
                        yield made(some)
                    rows = []
                rows.append(row)
        if rows and (some := kept(rows)):
            yield made(some)

    return run


def asked_alike(units: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The rows of ``whole_units`` whose texts have to be read: bits, a twentieth of a text, are sent before."""
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = units.join(nodes.select("node", "size", "bits"), "node").repartition(n, "unit").sortWithinPartitions("unit")
    near = arrow_map(both.select("unit", "node", "root", "asks", "held", "size", "bits"), _asked_alike(percent), "unit bigint, node bigint, asks boolean")
    return units.join(near, ["unit", "node", "asks"])


def linked_components(rows: DataFrame, nodes: DataFrame, search: Callable[[DataFrame], DataFrame], possible: Callable[[Column, Column], Column], percent: int) -> DataFrame:
    """(node, root) over all links between nodes of the same list; ``rows``: key, node, size, place, n (rows of the key), a table; ``nodes``: node, size, bits; ``search`` gives the links that units hold."""
    now, rooted, roots = rows.withColumn("root", F.col("node")), nodes.withColumn("root", F.col("node")), None
    for k in range(ROUNDS):
        units = written(candidate_units(alike(neighbours(now, possible, k), nodes, percent), rooted, k), "units")
        found = search(units.select("unit", "node", "root", "asks", "held"))
        if k == 0:  # what is cut later is of lists that stay open
            lists, cut = rows.filter(F.col("n") > REACH + 1), written(cut_lists(units), "cut")
            lists = lists.unionByName(cut)
        known = found if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
        roots = components(known)
        now = open_rows(lists, roots, cut, percent)
        if now.isEmpty():
            return roots
        if k and found.isEmpty():
            break
        rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = search(written(asked_alike(written(whole_units(now), "whole"), nodes, percent), "units"))
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))


def similar_sets(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles (distinct grams) and component_id, the smallest id that a document reaches over links of at least ``percent`` similarity."""
    spark = docs.sparkSession
    read = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    both = written(arrow_map(read, _signed(size, sketch_bits), "doc_id bigint, name bigint, rest bigint, size bigint, bits array<bigint>, block int, counts binary"), "signed")
    signed = both.filter("block IS NULL").select("doc_id", "name", "rest", "size", "bits")
    block_bits = min(BLOCK_BITS, sketch_bits)
    blocks = both.filter("block IS NOT NULL").select("block", "counts").repartition(8, "block")  # of 8 blocks each: 4 MB
    levels = np.zeros((1 << (sketch_bits - block_bits), 1 << block_bits), np.uint8)
    for row in arrow_map(blocks, _levels(block_bits), "block int, levels binary").collect():  # one byte a counter
        levels[row["block"]] = np.frombuffer(row["levels"], np.uint8)
    shared_levels = spark.sparkContext.broadcast(levels.tobytes())

    nodes = signed.filter("size > 0").groupBy("name", "rest").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("bits").alias("bits"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    short = written(arrow_map(read, _short_lists(size, percent, shared_levels, sketch_bits), "gram bigint, name bigint, place int"), "short")
    # Sorted by gram once: a set that several tasks have seen counts once, and grams of one set alone are left out.
    own = short.repartition(F.col("gram")).groupBy("gram", "name").agg(F.first("place").alias("place"))
    several = own.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("gram"))).filter("n > 1")
    rows = written(several.join(nodes.select("name", "node", "size"), "name").select(F.col("gram").alias("key"), "node", "size", "place", "n"), "lists")
    remove(short)

    def possible(x: Column, y: Column) -> Column:
        """By their sizes, and by what can follow a first common gram at these places."""
        a, b = x["size"], y["size"]
        most = F.least(a - x["place"], b - y["place"])
        return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * most >= percent * (a + b))

    def search(units: DataFrame) -> DataFrame:
        own = written(units.join(nodes.select("node", "name", "least"), "node"), "asked")
        known = F.broadcast if own.count() <= BROADCAST_ROWS else lambda df: df
        texts = read.join(known(own.select(F.col("least").alias("doc_id")).distinct()), "doc_id", "left_semi").select("text")
        dealt = arrow_map(texts, _whole_texts(size), "name bigint, text binary").join(known(own.drop("least")), "name")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = dealt.select("unit", "node", "root", "asks", "held", "text").repartition(n, "unit").sortWithinPartitions("unit", "node", "asks")
        return written(arrow_map(dealt, _unit_links(size, percent), "a bigint, b bigint"), "links")

    roots = linked_components(rows, nodes, search, possible, percent)
    named = nodes.select("node", "name", "rest", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(least, "root").select("name", "rest", "component_id"), "named")
    null = lambda c: F.nullif(c, F.lit(_NULL_ID))
    return signed.join(named, ["name", "rest"], "left").select(null(F.col("doc_id")).alias("doc_id"), F.col("size").alias("n_shingles"), null(F.coalesce("component_id", "doc_id")).alias("component_id"))
