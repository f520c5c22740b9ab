"""Fast exact encoders over two public vocabularies, one per Python worker.

``WordBpe`` gives the ids that ``tokenizers`` gives for a lower-casing word vocabulary. Merges never cross white space, so a batch is
split into words once, each distinct word is encoded once, and the ids are gathered per text. Words of printable ASCII and Latin-1
letters are merged by ``tiktoken`` over the same merges; all other words go to ``tokenizers`` itself.

``ByteBpe`` encodes whole texts and gives the byte length of each token, from which its place in the text follows.
"""

from __future__ import annotations

import base64
import json
import re
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MARK, _BREAK = "\x00", "\n"
_PLAIN = r"[!-~À-ÖØ-öø-ÿ]+"
_LETTER = "a-zß-öø-ÿ"
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+")


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def text_array(texts: list[bytes]) -> pa.Array:
    """A string array; bytes that aren't UTF-8 are replaced."""
    raw = pa.array(texts, pa.binary())
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())


class WordBpe:
    MEMO = 400_000

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        suffix, alphabet = model["end_of_word_suffix"], byte_alphabet()
        ranks: dict[bytes, int] = {}
        for token, k in model["vocab"].items():
            body = token.removesuffix(suffix)
            if all(c in alphabet for c in body) and not token.startswith("<|"):
                ranks[bytes(alphabet[c] for c in body) + (_MARK.encode() if token != body else b"")] = k
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        in_order = [model["vocab"][a + b] for a, b in merges]
        if in_order != sorted(in_order) or in_order[0] < 512:
            raise ValueError("this vocabulary's ids don't follow its merges")
        # The mark is the end of a word; the byte it stands on has its own id, which words of the plain alphabet never need.
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{_MARK}{_BREAK}]+{_MARK}|{_BREAK}", mergeable_ranks=ranks, special_tokens={})
        self.stop = ranks[_BREAK.encode()]
        self._forget()

    def _forget(self) -> None:
        """Known words are numbers of spans in one pool of ids: no objects but the words themselves."""
        self.memo: dict[str, int] = {}
        self.pool, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.memo.update(zip(names, range(len(self.size), len(self.size) + len(names)), strict=True))
        self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.pool = np.concatenate([self.pool, ids.astype(np.uint32)])

    def _learn_plain(self, names: list[str]) -> None:
        marked = _PARTS.sub(rf"\g<0>{_MARK}", (_BREAK.join(names) + _BREAK).lower())
        ids = self.fast.encode_to_numpy(marked)
        stops = np.flatnonzero(ids == self.stop)
        self._learn(names, np.delete(ids, stops), np.diff(stops, prepend=-1) - 1)

    def _learn_exact(self, names: list[str]) -> None:
        found = [e.ids for e in self.exact.encode_batch(names, add_special_tokens=False)]
        self._learn(names, np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64))

    def _numbers(self, distinct: pa.Array) -> np.ndarray:
        if len(self.memo) > self.MEMO:
            self._forget()
        names = distinct.to_pylist()
        known = np.fromiter(map(self.memo.get, names, repeat(-1)), np.int64, len(names))
        miss = np.flatnonzero(known < 0)
        if len(miss):
            plain = pc.and_not(pc.match_substring_regex(distinct.take(pa.array(miss)), f"^{_PLAIN}$"), pc.match_substring(distinct.take(pa.array(miss)), "<|")).to_numpy(zero_copy_only=False)
            for some, learn in ((miss[plain], self._learn_plain), (miss[~plain], self._learn_exact)):
                for at in range(0, len(some), 50_000):
                    learn([names[k] for k in some[at : at + 50_000].tolist()])
            known[miss] = np.fromiter((self.memo[names[k]] for k in miss.tolist()), np.int64, len(miss))
        return known

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the n+1 offsets of the texts."""
        lists = pc.ascii_split_whitespace(text_array(texts))
        coded = lists.flatten().dictionary_encode()
        at = self._numbers(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        n = self.size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.first[at] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


class ByteBpe:
    LARGE = 1 << 20

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            self.sizes[k] = len(token)

    def lengths(self, text: str) -> np.ndarray:
        """The byte length of every token of the text, in order; they add up to the text's."""
        ids = self.encoding.encode_to_numpy(text) if len(text) > self.LARGE else np.array(self.encoding.encode_ordinary(text), dtype=np.int64)
        return self.sizes[ids] if len(ids) else np.zeros(0, np.int64)


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@cache
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)
