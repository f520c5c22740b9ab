"""Token counts by offset-mapped attribution.

A whole document is encoded once. The vocabulary works on bytes, so the running sum of token sizes gives every token's span. The
spans are joined with the document's sections, both in ascending order, and each token is counted for exactly one section. Tokens that
cross a boundary go by ``rule``: ``first`` (the section of its first character), ``last``, or ``most`` (the section with
most of its bytes, the earlier on a tie).

A section ends after a ``section_break`` and includes it; what follows the last break is a section if it isn't empty, and an empty
document is one empty section.

Nulls: a null text is an empty document, a null id is kept. Repeated rows are counted each. An empty table gives no rows. Texts of any length are
encoded whole, a text at a time; bytes that aren't UTF-8 count as U+FFFD. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import arrow_map, slices, text_bytes

RULES = ("first", "last", "most")


def sections(data: np.ndarray, break_: bytes) -> np.ndarray:
    """The ascending byte offsets at which sections begin, then the size of the text."""
    mark = np.frombuffer(break_, np.uint8)
    at = np.flatnonzero(data[: len(data) - len(mark) + 1] == mark[0]) if len(data) >= len(mark) else np.zeros(0, np.int64)
    for k in range(1, len(mark)):
        at = at[data[at + k] == mark[k]]
    if len(mark) > 1 and len(at):  # breaks don't overlap
        kept, last = [], -len(mark)
        for x in at.tolist():
            if x >= last + len(mark):
                kept.append(x)
                last = x
        at = np.array(kept)
    ends = at + len(mark)
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends])


def attribute(sizes: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section."""
    stop = np.cumsum(sizes)
    start = stop - sizes
    n = len(bounds) - 1
    first = np.searchsorted(bounds[1:], start, side="right")
    if rule == "first":
        return np.bincount(first, minlength=n)[:n]
    last = np.searchsorted(bounds[1:], stop - 1, side="right")
    if rule == "last":
        return np.bincount(last, minlength=n)[:n]
    best, share = first.copy(), np.minimum(bounds[first + 1], stop) - start
    for k in np.flatnonzero(last > first):
        for s in range(first[k] + 1, last[k] + 1):
            own = min(bounds[s + 1], stop[k]) - bounds[s]
            if own > share[k]:
                best[k], share[k] = s, own
    return np.bincount(best, minlength=n)[:n]


def _count(path: str, pattern: str, break_: bytes, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tracelake.llm.tokens import byte_bpe

        coder = byte_bpe(path, pattern)
        for batch in batches:
            for some in slices(batch, "text"):
                rows, counts, begins, ends, n_sections = [], [], [], [], []
                for text in some.column("text").to_pylist():
                    said = text.decode("utf-8", "replace")
                    data = np.frombuffer(said.encode(), np.uint8)
                    bounds = sections(data, break_)
                    counts.append(attribute(coder.lengths(said), bounds, rule))
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
                    begins.append(chars[:-1])
                    ends.append(chars[1:])
                    n_sections.append(len(bounds) - 1)
                    rows.append(np.arange(len(bounds) - 1))
                doc = np.repeat(np.arange(len(some)), n_sections)
                columns = [some.column("doc_id").take(pa.array(doc)), pa.array(np.concatenate(rows), pa.int32()), *(pa.array(np.concatenate(c), pa.int64()) for c in (begins, ends, counts))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "section", "start", "stop", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", section_break: str = "\n", rule: str = "first") -> DataFrame:
    """A row for each section: doc_id, section (from 0), start, stop (code points, end exclusive), n_tokens.

    ``vocabulary`` is a file of byte-level ranks on every machine, ``pattern`` the one that splits texts before merges.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return arrow_map(read, _count(vocabulary, pattern, section_break.encode(), rule), f"doc_id {kind}, section int, start bigint, stop bigint, n_tokens bigint")
