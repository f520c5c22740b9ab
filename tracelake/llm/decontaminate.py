"""Benchmark decontamination by a distributed positional inverted index of the training text.

``build_index`` cuts the documents into segments of a few megabytes and stores a row for each: its term dictionary (hashes in ascending order),
how often each term occurs, and the positions of every term, ascending, as steps of a byte or two. A segment holds whole documents. Nothing of the benchmark is
needed for it, so one index serves many benchmarks. Terms are told apart by 64 bits, so a match is wrong only if all words of a window collide.

``search`` never sends the benchmark through the driver. The dictionaries of the segments are joined with the benchmark's terms, which gives how often each term
occurs in all training text. Every distinct window is keyed by the rarest of its terms and joined with the segments that hold this term;
a segment takes its windows in lists of bounded size, starts from the postings of the rarest term, and intersects them with the offset-adjusted postings
of the others, from rare to frequent.

An exact match is a window word for word. A near match is a window for which some place exists such that every word stands at most ``slop`` words off its
own place from there, inside one document; documents don't influence each other.

Nulls: a null text has no words, a null benchmark text has no windows, a null item id is not listed although its
windows count. Empty tables give empty, or clean, results. Repeated items count once, repeated rows get equal results. Texts of any length are indexed whole; a longer one than a
segment is a segment of its own. Extra columns pass, but for those named like the results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import arrow_map, slices, text_bytes, without, written

WINDOW = 10
#: Windows that a segment takes at once, and bytes of text in a segment.
BLOCK_WINDOWS = 100_000
SEGMENT_BYTES = 4 << 20
#: Free places between the documents of a segment: more than a window and twice the slop.
GAP = 4096

#: Bytes outside words become a space; A-Z become a-z; bytes of other scripts stay.
_WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_INDEX = "segment bigint, docs array<binary>, n_words array<bigint>, terms array<bigint>, counts array<int>, positions binary"
_PASSAGE, _EXACT, _NEAR = range(3)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def term_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(term_hash, terms), np.uint64, len(terms)).view(np.int64)


# The index


def document_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart by id and text; rows that agree in both have equal results."""
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{id_col}`").cast("string")), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.encode(name, "UTF-8"), F.lit(b"\n"), text_bytes(F.col(f"`{text_col}`"))), 256))


def _places(n_words: np.ndarray) -> np.ndarray:
    """Where each document of a segment begins."""
    return np.cumsum(n_words + GAP) - n_words


def pack(positions: np.ndarray, counts: np.ndarray) -> bytes:
    """Every term's positions as steps from the one before, seven bits a byte; the last byte of a number is below 128."""
    steps = np.diff(positions, prepend=0)
    first = (np.cumsum(counts) - counts)[counts > 0]
    steps[first] = positions[first]
    size = 1 + sum((steps >= 1 << (7 * k)).astype(np.int64) for k in range(1, 6))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(6):
        own = size > k
        out[at[own] + k] = (steps[own] >> (7 * k)) & 127 | np.where(size[own] > k + 1, 128, 0)
    return out.tobytes()


def unpack(data: bytes, counts: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    stop = np.flatnonzero(raw < 128) + 1
    size = np.diff(stop, prepend=0)
    at = stop - size
    steps = np.zeros(len(stop), np.int64)
    for k in range(int(size.max()) if len(size) else 0):
        own = size > k
        steps[own] |= (raw[at[own] + k] & 127) << (7 * k)
    sums, first = np.cumsum(steps), (np.cumsum(counts) - counts)[counts > 0]
    return sums - np.repeat(sums[first] - steps[first], counts[counts > 0])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, "text", SEGMENT_BYTES):
            texts = [t.translate(_WORD_BYTES).strip() for t in part.column("text").to_pylist()]
            split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
            empty = np.array([not t for t in texts])
            n_words = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64) - empty
            flat = split.flatten()
            coded = (flat.filter(pc.not_equal(flat, "")) if empty.any() else flat).dictionary_encode()
            terms = _hashes([t.as_buffer().to_pybytes() for t in coded.dictionary.view(pa.binary())])
            rank = np.argsort(terms, kind="stable")
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            code = place[coded.indices.to_numpy()] if len(terms) else np.zeros(0, np.int64)
            at = np.arange(n_words.sum()) + np.repeat(_places(n_words) - (np.cumsum(n_words) - n_words), n_words)
            counts = np.bincount(code, minlength=len(terms))
            columns = [(n_words, pa.int64()), (terms[rank], pa.int64()), (counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([part.column("doc").to_pylist()], pa.list_(pa.binary())), *(pa.ListArray.from_arrays(np.array([0, len(c)], np.int32), pa.array(c, kind)) for c, kind in columns), pa.array([pack(at[np.argsort(code, kind="stable")], counts)], pa.binary())],
                ["segment", "docs", "n_words", "terms", "counts", "positions"],
            )
            number += 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: a row for each segment."""
    read = docs.select(document_key(id_col, text_col).alias("doc"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    return written(arrow_map(read, _build, _INDEX), "index")


# The benchmark


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                terms = _hashes(words(text))
                size = min(window, len(terms))
                if not size:
                    continue
                rows = np.lib.stride_tricks.sliding_window_view(terms, size)
                for lo in range(0, len(rows), 10_000):
                    some = np.ascontiguousarray(rows[lo : lo + 10_000])
                    names = [xxhash.xxh3_128_digest(r.tobytes()) for r in some]
                    lists = pa.ListArray.from_arrays(np.arange(0, some.size + 1, size, dtype=np.int32), pa.array(some.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(some), pa.string()), pa.array(names, pa.binary()), lists], ["item", "window", "terms"])

    return run


def windows_of(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item, window (a hash of its terms) and terms, of every place of every item."""
    read = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    return written(arrow_map(read, _windows(window), "item string, window binary, terms array<bigint>").distinct(), "windows")


# The search


class Segment:
    """A row of the index in memory."""

    def __init__(self, n_words: np.ndarray, terms: np.ndarray, counts: np.ndarray, packed: bytes):
        self.begin, self.terms, self.counts = _places(n_words), terms, counts.astype(np.int64)
        self.positions = unpack(packed, self.counts)
        self.first = np.cumsum(self.counts) - self.counts
        self.size = int(n_words.sum() + GAP * (len(n_words) + 2))
        self.keys = np.repeat(np.arange(len(terms)), counts) * self.size + self.positions  # ascending

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, position, side="right") - 1

    def within(self, term: np.ndarray, position: np.ndarray, off: int) -> np.ndarray:
        """Does the term occur at most ``off`` words from the position?"""
        key = term * self.size + position
        at = np.searchsorted(self.keys, key - off)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= key + off)

    def find(self, terms: np.ndarray, order: np.ndarray, slop: int, step: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """(window, document, place, exact) of every exact match, and of a first near match for each window and document if there is a slop.

        ``order``: the places of a window's terms from rare to frequent.
        """
        if not len(self.keys) or not len(terms):
            return
        code = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        alive = np.flatnonzero((self.terms[code] == terms).all(axis=1))
        code, order = code[alive], order[alive]
        rare = code[np.arange(len(code)), order[:, 0]]
        lists = self.counts[rare]
        ends = np.cumsum(lists)
        lo = 0
        while lo < len(alive):  # about so many postings at a time
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, side="right")))
            n = lists[lo:hi]
            w = np.repeat(np.arange(lo, hi), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            for cut in range(0, len(w), step):
                v, i = w[cut : cut + step], inside[cut : cut + step]
                posting = self.positions[self.first[rare[v]] + i]
                start = posting - order[v, 0]
                # With a slop the place may be up to ``slop`` from where the rarest term puts it, and each term as far from its own.
                v, start, posting = self._intersect(code, order, v, start, posting, 2 * slop)
                yield from self._exact(alive, code, order, v, start, posting)
                if slop:
                    yield from self._near(alive, code, order, v, start, posting, slop)
            lo = hi

    def _intersect(self, code, order, v, start, posting, off: int):
        for j in range(1, code.shape[1]):
            place = order[v, j]
            ok = self.within(code[v, place], start + place, off)
            v, start, posting = v[ok], start[ok], posting[ok]
        return v, start, posting

    def _exact(self, alive, code, order, v, start, posting):
        v, start, posting = self._intersect(code, order, v, start, posting, 0)
        if len(v):
            doc = self.document(posting)
            yield alive[v], doc, start - self.begin[doc], True

    def _near(self, alive, code, order, v, start, posting, slop: int):
        found = []
        for shift in range(-slop, slop + 1):
            at, place, own = self._intersect(code, order, v, start + shift, posting, slop)
            found.append((alive[at], self.document(own), place))
        w, doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(w):
            first = np.lexsort((place, doc, w))
            w, doc, place = w[first], doc[first], place[first]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
            yield w[new], doc[new], np.maximum(place[new] - self.begin[doc[new]], 0), False


def passages(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching matches of a document as one passage."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    new = np.ones(len(doc), bool)
    base = doc.astype(np.int64) << 33  # a running maximum that never reaches back over a document
    reach = np.maximum.accumulate(base + stop)
    new[1:] = base[1:] + start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - base[last]


def _numbers(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def _match(slop: int):
    names = ["doc", "kind", "start", "stop", "window"]
    kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(*(_numbers(batch.column(c), row) for c in ("n_words", "terms", "counts")), batch.column("positions")[row].as_py())
                docs = batch.column("docs")[row].values
                asked = batch.column("asked")[row].values
                window, terms, order = (asked.field(c) for c in ("window", "terms", "order"))
                sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
                spans: list[tuple] = []
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    take = lambda x: x.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)  # noqa: E731, B023
                    seen = {True: set(), False: set()}
                    for w, doc, start, exact in segment.find(take(terms), take(order), slop):
                        seen[exact] |= set((own[w] * len(docs) + doc).tolist())
                        if exact:
                            spans.append(passages(doc, start, start + size))
                    for exact, found in seen.items():
                        pairs = np.array(sorted(found), np.int64)
                        none = pa.nulls(len(pairs), pa.int64())
                        if len(pairs):
                            yield pa.RecordBatch.from_arrays([docs.take(pa.array(pairs % len(docs))), pa.array(np.full(len(pairs), _EXACT if exact else _NEAR), pa.int32()), none, none, window.take(pa.array(pairs // len(docs)))], names)
                if spans:
                    doc, start, stop = passages(*(np.concatenate(x) for x in zip(*spans, strict=True)))
                    yield pa.RecordBatch.from_arrays([docs.take(pa.array(doc)), pa.array(np.full(len(doc), _PASSAGE), kinds[1]), pa.array(start, kinds[2]), pa.array(stop, kinds[3]), pa.nulls(len(doc), kinds[4])], names)

    return run


def lists_of(places: DataFrame, asked: DataFrame, block_windows: int) -> DataFrame:
    """(segment, list, asked): the windows whose rarest term a segment holds, in as many lists of about ``block_windows`` as that segment's own windows need."""
    # Counted by term: a few numbers a segment, before any window is sent.
    number = places.join(asked.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term").groupBy("segment").agg(F.ceil(F.sum("n") / block_windows).alias("lists"))
    pairs = places.join(written(number, "lists"), "segment").join(asked, "term")
    return pairs.groupBy("segment", F.pmod(F.xxhash64("window"), F.col("lists")).alias("list")).agg(F.collect_list(F.struct("window", "terms", "order")).alias("asked"))


def search(index: DataFrame, windows: DataFrame, slop: int = 0, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc, kind, start, stop, window: passages (word positions, end exclusive) under exact matches, and a row for each document and window that it matches exactly, or nearly."""
    if not 0 <= 4 * slop < GAP:
        raise ValueError(f"slop is from 0 to {GAP // 4 - 1}")
    distinct = windows.dropDuplicates(["window"]).select("window", "terms")
    terms = distinct.select(F.explode("terms").alias("term")).distinct()
    lexicon = index.select("segment", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("segment", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    lexicon = written(lexicon.join(terms, "term"), "lexicon")
    frequency = lexicon.groupBy("term").agg(F.sum("n").alias("n"))
    placed = distinct.select("window", F.posexplode("terms").alias("place", "term")).join(frequency, "term")
    order = placed.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("n", "place"))).alias("o"))  # at most a window's words
    asked = distinct.join(order, "window").filter(F.size("o") == F.size("terms"))  # the others have a term that no document holds
    asked = asked.select("window", "terms", F.transform("o", lambda x: x["place"]).alias("order"))
    asked = written(asked.withColumn("term", F.element_at("terms", F.element_at("order", 1) + 1)), "asked")
    dealt = lists_of(lexicon.select("term", "segment"), asked, block_windows)
    both = index.join(dealt, "segment").select("docs", "n_words", "terms", "counts", "positions", "asked")
    return arrow_map(both, _match(slop), "doc binary, kind int, start bigint, stop bigint, window binary")


def _merged(found: DataFrame) -> DataFrame:
    """n_hit and spans of each document from its passages, which several lists of windows may have given."""
    own = Window.partitionBy("doc").orderBy("start", "stop")
    rows = found.filter(F.col("kind") == _PASSAGE).select("doc", "start", "stop").distinct()
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("passage", F.sum("new").over(own))
    rows = rows.groupBy("doc", "passage").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return rows.groupBy("doc").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = 0, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_hit, spans, item_ids, near_item_ids and contaminated.

    ``spans`` are the passages (word positions, end exclusive) covered by windows of items; ``item_ids`` the items of these windows, in the order of strings;
    ``near_item_ids`` those with near matches, exact ones among them (empty for slop 0). A document is contaminated if a window occurs in it word for word.
    """
    keep = without(docs.columns, {"n_words", "n_hit", "spans", "item_ids", "near_item_ids", "contaminated"})
    index = build_index(docs, id_col, text_col)
    windows = windows_of(benchmark, item_col, item_text_col, window)
    found = written(search(index, windows, slop, block_windows), "found")
    owners = windows.filter(F.col("item").isNotNull()).select("window", "item").distinct()
    items = found.filter(F.col("kind") != _PASSAGE).select("doc", "kind", "window").join(owners, "window")
    listed = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("item"))))
    items = items.groupBy("doc").agg(listed(_EXACT).alias("item_ids"), listed(_NEAR).alias("near_item_ids"))
    sizes = index.select(F.explode(F.arrays_zip("docs", "n_words")).alias("d")).groupBy(F.col("d.docs").alias("doc")).agg(F.max("d.n_words").alias("n_words"))
    # A table, so that the join can split a document that very many rows repeat.
    facts = written(sizes.join(_merged(found), "doc", "left").join(items, "doc", "left"), "facts")
    none = F.array().cast("array<string>")
    return docs.select(*[F.col(f"`{c}`") for c in keep], document_key(id_col, text_col).alias("__doc")).join(facts, F.col("__doc") == F.col("doc"), "left").select(
        *[F.col(f"`{c}`") for c in keep],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("near_item_ids", none).alias("near_item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs. Only the keys of the others are joined, so texts aren't shuffled where these are few."""
    found = search(build_index(docs, id_col, text_col), windows_of(benchmark, item_col, item_text_col, window))
    hit = written(found.filter(F.col("kind") == _PASSAGE).select(F.col("doc").alias("__doc")).distinct(), "hit")
    return docs.withColumn("__doc", document_key(id_col, text_col)).join(hit, "__doc", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
