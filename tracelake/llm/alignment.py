"""Alignment of two tokenizers' tokens, and how often each pair of their ids is linked in the corpus.

Python only tokenises: it gives the byte at which each token of either tokenizer ends, alone and with the token's id in one number. All else is Spark's own functions on arrays. The ends that both lists have
cut the tokens into groups, and those of one list alone (``array_except``), which are few, lie inside groups: sorted among its side's tokens, each ties two tokens together, and the two sides' groups are put side by side, each as ``a1,a2|b1``. Ends come as
numbers that sort right after a token with this end, and ids are what a cast to int keeps, so that all but the last step is compiled: no lambda function runs for each token.
The links of a group are all pairs of its two sides. They depend on the group's ids alone, so they are made once for each distinct group of the corpus (``sequence`` and
``transform``); a document's distinct groups are found once (``kinds``), and of them only groups of more than one token a side are taken apart, to count each pair once.

A text is cut at single spaces between ASCII letters into pieces of about ``PIECE`` bytes, and each piece is a row. Neither tokenizer has a token across such a space, so the pieces'
tokens are those of the whole text, every cut of pieces is a cut of groups, and a text of any length is worked on in bounded memory; a stretch of text without such a space is one piece.

The table of distinct groups grows with the vocabulary in use, not with the corpus. It is broadcast after its rows are counted, up to ``BROADCAST_GROUPS``, and joined by a shuffle beyond.

Defined results: a null or empty text, and one whose tokens don't spell it (such as bytes that aren't UTF-8, or U+2581 in it), has no tokens and zeros. Rows are documents: rows that share an
id, or have none, are counted one by one. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import arrow_map, slices, text_bytes, written
from tracelake.llm.tokens import byte_alphabet

#: Bytes of a text that are tokenised and aligned at once.
PIECE = 1 << 20
#: Rows of the table of distinct groups up to which it is broadcast: about 60 bytes each.
BROADCAST_GROUPS = 1 << 20
#: A token on its way is its end, shifted by this, plus its id; an end alone has all bits below set. The lower half is an int: the id, or -1.
SHIFT = 32
_END = (1 << SHIFT) - 1
_SPACE = "▁"
_CUT = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")
_FIRST_SPACE = re.compile(" (?<!  )")


class ByteLevel:
    """A byte-level vocabulary. Merges are those of the file; ids are in the order of merges, so ranks are ids."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        model = json.load(open(path, encoding="utf-8"))
        special = {t["id"] for t in model["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): k for token, k in model["model"]["vocab"].items() if k not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.bytes[k] = token
        self.length = np.array([len(x) for x in self.bytes], np.int64)

    def encode(self, text: str, size: int) -> np.ndarray | None:
        """Ids of space and text; None if they don't spell its ``size`` bytes."""
        ids = np.array(self.encoding.encode_ordinary(" " + text), np.int64)
        return ids if self.length[ids].sum() == size + 1 else None


    def encode_words(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each with a space before it and then ``sizes`` bytes, and how many each has. No word is empty or has a space at an end, so that no token crosses words; none has ids if they don't spell them."""
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(words)) if words else [], np.int64)
        ends, bounds = np.cumsum(self.length[ids]), np.cumsum(sizes)
        cuts = np.searchsorted(ends, bounds)
        if not words or ends[-1] != bounds[-1] or not np.array_equal(ends[cuts], bounds):
            return ids[:0], np.zeros(len(words), np.int64)
        return ids, np.diff(cuts, prepend=-1)


class Spans:
    """Numbered lists of ids in one pool."""

    def __init__(self) -> None:
        self.pool, self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes.astype(np.int32)])
        self.pool = np.concatenate([self.pool, ids.astype(np.int32)])

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these lists, one after another, and where each list begins, with the end of the last."""
        sizes = self.size[numbers]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
        return self.pool[np.repeat(self.first[numbers] - ends[:-1], sizes) + np.arange(ends[-1])], ends


class Pieces:
    """A sentence-piece vocabulary. No piece has a space mark after another character, so words are encoded on their own, each distinct one once.

    With a vocabulary ``beside`` it, words are known in both. That one has no token across a space between other characters, so its words are those without a space of any kind at an end.
    """

    MEMO = 400_000

    def __init__(self, path: str, beside: ByteLevel | None = None):
        import sentencepiece

        self.beside = beside
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("this vocabulary has pieces across spaces")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        self._forget()

    def _forget(self) -> None:
        """Known words are numbers of lists; an empty list is a word that its ids don't spell, or that isn't encoded on its own."""
        self.memo: dict[str, int] = {}
        self.own, self.other = Spans(), Spans()

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        # The model gives nothing for an empty text, but it stands for the space that ends a text.
        found = [ids if w else [self.model.piece_to_id(_SPACE)] for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True)]
        ids = list(chain.from_iterable(found))
        sizes, flat = np.fromiter(map(len, found), np.int64, len(found)), np.array(ids, np.int64)
        spelled, joined = b"".join(map(self.bytes.__getitem__, ids)), (" " + " ".join(words)).encode()
        bytes_of = pc.binary_length(pa.array(words, pa.string())).to_numpy().astype(np.int64) + 1
        if spelled != joined or not np.array_equal(np.cumsum(self.length[flat])[np.cumsum(sizes) - 1], np.cumsum(bytes_of)):
            found = [ids if b"".join(map(self.bytes.__getitem__, ids)) == b" " + w.encode() else [] for w, ids in zip(words, found, strict=True)]
            sizes, flat = np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), np.int64)
        self.own.add(flat, sizes)
        if self.beside:
            alone = [k for k, w in enumerate(words) if w and not w[0].isspace() and not w[-1].isspace()]
            ids, sizes = self.beside.encode_words([words[k] for k in alone], bytes_of[alone])
            each = np.zeros(len(words), np.int64)
            each[alone] = sizes
            self.other.add(ids, each)
        self.memo.update(zip(words, range(len(self.memo), len(self.memo) + len(words)), strict=True))

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words, and where each text's begin."""
        # Of several spaces the first is the one that the model adds to the word.
        odd = ["  " in t or t[:1] == " " for t in texts]
        lists = pc.split_pattern(pa.array(["" if o else t for t, o in zip(texts, odd, strict=True)], pa.string()), " ")
        if any(odd):
            lists = pa.array([_FIRST_SPACE.split(" " + t)[1:] if o else w for t, o, w in zip(texts, odd, lists.to_pylist(), strict=True)], pa.list_(pa.string()))
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist
        if len(self.memo) + len(names) > self.MEMO:
            self._forget()
        self._learn([w for w in names if w not in self.memo])
        word = np.fromiter(map(self.memo.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy(zero_copy_only=False)]
        return word, lists.offsets.to_numpy()

    @staticmethod
    def _of_texts(spans: Spans, word: np.ndarray, bounds: np.ndarray) -> list[np.ndarray | None]:
        ids, ends = spans.take(word)
        gaps = np.concatenate([np.zeros(1, np.int64), np.cumsum(spans.size[word] == 0)])[bounds]
        at = ends[bounds].tolist()
        return [ids[lo:hi] if whole else None for lo, hi, whole in zip(at[:-1], at[1:], (gaps[1:] == gaps[:-1]).tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text, to which the model adds a space; None where they don't spell it."""
        found = self._numbers(texts)
        return [None if _SPACE in t else x for t, x in zip(texts, self._of_texts(self.own, *found), strict=True)]

    def encode_both(self, texts: list[str]) -> tuple[list[np.ndarray | None], list[np.ndarray | None]]:
        """Ids of each text after a space in the vocabulary beside this one, and in this one."""
        found = self._numbers(texts)
        other, own = self._of_texts(self.other, *found), self._of_texts(self.own, *found)
        return [self.beside.encode(t, len(t.encode())) if x is None else x for t, x in zip(texts, other, strict=True)], [None if _SPACE in t else x for t, x in zip(texts, own, strict=True)]


@cache
def _encoders(a_path: str, pattern: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    a = ByteLevel(a_path, pattern)
    return a, Pieces(b_path, a)


def pieces(text: bytes, size: int = PIECE) -> list[bytes]:
    """The text cut at spaces between letters, which are left out."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


def _tokenise(a_path: str, pattern: str, b_path: str, size: int):
    none = np.zeros(0, np.int64)

    def lists(side: list[np.ndarray], length: np.ndarray) -> list[pa.Array]:
        """Ends, and ends with ids."""
        ids = np.concatenate([*side, none])
        at = np.cumsum([0, *map(len, side)])
        total = np.concatenate([none, [0], np.cumsum(length[ids])])
        ends = total[1:] - np.repeat(total[at[:-1]], np.diff(at)) << SHIFT
        return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v)) for v in (ends | _END, ends | ids)]

    def decoded(text: bytes) -> list[str]:
        try:
            return [p.decode() for p in pieces(text, size)]
        except UnicodeDecodeError:
            return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _encoders(a_path, pattern, b_path)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                parts = [decoded(t) if t else [] for t in part.column("text").to_pylist()]
                found_a, found_b = b.encode_both([p for own in parts for p in own])
                pairs = zip(found_a, found_b, strict=True)
                rows, seg, segs, left, right = [], [], [], [], []
                for k, own in enumerate(parts):
                    found = [next(pairs) for _ in own]
                    if not found or any(x is None or y is None for x, y in found):
                        found = [(none, none)]
                    rows += [k] * len(found)
                    seg += range(len(found))
                    segs += [len(found)] * len(found)
                    left += [x for x, _ in found]
                    right += [y for _, y in found]
                taken = pa.array(rows, pa.int32())
                columns = [part.column("row").take(taken), part.column("doc_id").take(taken), pa.array(seg, pa.int32()), pa.array(segs, pa.int32())]
                columns += lists(left, a.length) + lists(right, b.length)
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "seg", "segs", "a_ends", "a", "b_ends", "b"])

    return run


@contextmanager
def separate_steps(spark: SparkSession) -> Iterator[None]:
    """While a plan is made: keeps projections apart, as merged, all that a higher-order function is given would be interpreted with it; and lets a cast to int cut off the upper half."""
    rules = "spark.sql.optimizer.excludedRules"
    before = {k: spark.conf.get(k, None) for k in (rules, "spark.sql.ansi.enabled")}
    spark.conf.set(rules, ",".join(filter(None, [before[rules], "org.apache.spark.sql.catalyst.optimizer.CollapseProject"])))
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def grouped(tokens: DataFrame) -> DataFrame:
    """``tokens`` (a_ends, a, b_ends, b: the ends of both sides' tokens, and ends with ids) with ``groups``: the ids ``a1,a2|b1`` between each two ends that both sides have. To be written within ``separate_steps``."""
    work = tokens.withColumns({"a_inner": F.array_except("a_ends", "b_ends"), "b_inner": F.array_except("b_ends", "a_ends")})
    # Sorted together, an inner end follows the token that ends at it; its lower half is -1. The last end is one that both sides have.
    work = work.withColumns({f"{s}_ids": F.sort_array(F.concat(s, f"{s}_inner")).cast("array<int>") for s in "ab"})
    work = work.withColumns({f"{s}_text": F.replace(F.array_join(F.col(f"{s}_ids").cast("array<string>"), "|"), F.lit("|-1|"), F.lit(",")) for s in "ab"})
    work = work.withColumns({f"{s}_parts": F.split(f"{s}_text", r"\|") for s in "ab"})  # a pattern that needs no regular expression
    groups = F.zip_with("a_parts", "b_parts", lambda a, b: F.concat(a, F.lit("|"), b))
    return work.withColumn("groups", F.when(F.size("a") > 0, groups).otherwise(F.array().cast("array<string>"))).select(*tokens.columns, "groups")


def links(group: Column) -> Column:
    """The pairs ``a|b`` of all ids of a group's two sides."""
    side = lambda k: F.split(F.get(F.split(group, r"\|"), F.lit(k)), ",")
    return F.flatten(F.transform(side(0), lambda a: F.transform(side(1), lambda b: F.concat(a, F.lit("|"), b))))


def alignments(docs: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """A table with a row for each piece of a document: row, doc_id, seg, segs, n_a, n_b, n_groups, digest, groups, and kinds, its distinct groups. A document of one piece has its digest, and none without tokens."""
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    tokens = arrow_map(read, _tokenise(a_path, pattern, b_path, piece), "row bigint, doc_id bigint, seg int, segs int, a_ends array<bigint>, a array<bigint>, b_ends array<bigint>, b array<bigint>")
    with separate_steps(docs.sparkSession):
        found = grouped(tokens).select("row", "doc_id", "seg", "segs", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), F.size("groups").cast("long").alias("n_groups"), "groups")
        digest = F.when(F.col("n_groups") == 0, "").when(F.col("segs") == 1, F.sha2(F.array_join("groups", ";").cast("binary"), 256))
        return written(found.withColumns({"digest": digest, "kinds": F.array_distinct("groups")}), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """A table (pair, n, best): in how many documents a pair of ids is linked, and whether no pair of the same first id is in more."""
    several = F.flatten(F.transform(F.filter("kinds", lambda g: F.contains(g, F.lit(","))), links))
    pairs = F.array_union(F.filter("kinds", lambda g: ~F.contains(g, F.lit(","))), several)
    # A long document's pieces are counted as one; each piece has its pairs once already.
    once = aligned.filter("segs = 1").select(F.explode(pairs).alias("pair")).unionByName(aligned.filter("segs > 1").select("row", F.explode(pairs).alias("pair")).distinct().select("pair"))
    counts = written(once.groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "counts").withColumn("a", F.substring_index("pair", "|", 1))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return written(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pairs")


def group_counts(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """A table (group, links, best, n) of the distinct groups: how many links each has, how many of them are best, and the sum of their counts."""
    distinct = aligned.select(F.explode("kinds").alias("group")).distinct()
    linked = distinct.select("group", F.explode(links(F.col("group"))).alias("pair")).join(pairs, "pair")
    return written(linked.groupBy("group").agg(F.count(F.lit(1)).alias("links"), F.sum("best").alias("best"), F.sum("n").alias("n")), "kinds")


def align(docs: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    aligned = alignments(docs, a_path, pattern, b_path, id_col, text_col, piece)
    kinds = group_counts(aligned, pair_counts(aligned))
    kinds = F.broadcast(kinds) if kinds.count() <= broadcast_groups else kinds
    # Groups are rated with nothing but their row beside them, as what goes with each of them is copied for each.
    at = ["row", "seg"]
    sums = aligned.select(*at, F.explode("groups").alias("group")).join(kinds, "group").groupBy(*at).agg(F.sum("links").alias("n_links"), F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    rated = aligned.drop("groups", "kinds").join(sums, at, "left").fillna(0, ["n_links", "n_best", "count_sum"])
    totals = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", F.array_join("groups", ";").alias("spelled")))), lambda s: s["spelled"]), ";")
    several = written(aligned.filter("segs > 1").groupBy("row").agg(F.sha2(whole.cast("binary"), 256).alias("whole")), "several")
    long = rated.filter("segs > 1").groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in totals]).join(several, "row").select("doc_id", *totals, F.col("whole").alias("groups_sha256"))
    return rated.filter("segs = 1").select("doc_id", *totals, F.col("digest").alias("groups_sha256")).unionByName(long)
