"""Line deduplication over the corpus.

Every text is split into lines; a line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys that
are long enough are hashed to 128 bits, and the distinct documents of each hash are counted with partial sums before
any shuffle, so a line that a third of all documents share arrives as one row a task. Hashes found in enough documents are dropped from every document
except the one with the largest id; each text is put together again from its remaining lines in their order.

Nulls: a null text is one empty line; a null id sorts below all others and counts as one document. Repeated rows of one id are one
document for the counts and all get the same treatment. Lines of any length are hashed whole; bytes that aren't UTF-8 stay as they are. Extra
columns pass through, but for two named like the results. An empty table gives no rows.

Lines are exploded as (document, hash). Positions aren't shuffled: a text is split again when it is put together, and the order of its lines is their position.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import ASCII_SPACE, arrow_map, slices, text_bytes, without, written

MIN_CHARS = 40
MIN_DOCS = 5
_NULL_ID = -(1 << 63)


def _long_enough(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars:
        return False
    return len(key) >= 4 * min_chars or key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars


def _keys(text: bytes, min_chars: int) -> list[bytes | None]:
    return [xxhash.xxh3_128_digest(k.lower()) if _long_enough(k, min_chars) else None for k in (x.strip(ASCII_SPACE) for x in text.split(b"\n"))]


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, hashes = [], []
                for d, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found = {h for h in _keys(t, min_chars) if h}
                    hashes += found
                    ids += [d] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], ["id", "hash"])

    return run


def _rebuild(min_chars: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                texts, before, gone = [], [], []
                for t, drop in zip(part.column("__text").to_pylist(), part.column("__drop").to_pylist(), strict=True):
                    n = t.count(b"\n") + 1
                    if drop:
                        drop = set(drop)
                        lines = t.split(b"\n")
                        left = [x for x, h in zip(lines, _keys(t, min_chars), strict=True) if h not in drop]
                        t = b"\n".join(left)
                        gone.append(n - len(left))
                    else:
                        gone.append(0)
                    texts.append(t)
                    before.append(n)
                columns = {n: part.column(n) for n in part.schema.names if n not in ("__text", "__drop", "__key")}
                columns[text_col] = pa.array(texts, pa.binary())
                columns["n_lines"] = pa.array(before, pa.int64())
                columns["n_dropped"] = pa.array(gone, pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(id, hash) of every line long enough, and (hash, keeper) of those in at least ``min_docs`` documents."""
    read = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)).alias("id"), text_bytes(F.col(f"`{text_col}`")).alias("text"))
    lines = written(arrow_map(read, _hash_lines(min_chars), "id bigint, hash binary"), "lines")
    counted = lines.groupBy("hash").agg(F.countDistinct("id").alias("n"), F.max("id").alias("keeper"))
    # A table, so that the join with the lines can split a line that very many documents share.
    return lines, written(counted.filter(F.col("n") >= min_docs).select("hash", "keeper"), "frequent")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with their text rebuilt, and n_lines (before) and n_dropped."""
    lines, frequent = repeated_lines(docs, id_col, text_col, min_chars, min_docs)
    # A table, so that the join with the texts can split rows that share an id, or have none.
    drops = lines.join(frequent, "hash").filter(F.col("id") != F.col("keeper")).groupBy(F.col("id").alias("__key")).agg(F.collect_set("hash").alias("__drop"))
    keep = without(docs.columns, {"n_lines", "n_dropped", text_col})
    work = docs.select(*[F.col(f"`{c}`") for c in keep], text_bytes(F.col(f"`{text_col}`")).alias("__text"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)).alias("__key"))
    # Sorted at every size: a small list of drops would be broadcast, a larger one not, and disk would jump with the input.
    joined = work.join(written(drops, "drops").hint("merge"), "__key", "left")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields if f.name in keep]
    out = arrow_map(joined.select(*[F.col(f"`{c}`") for c in keep], "__text", "__drop"), _rebuild(min_chars, text_col), ", ".join([*fields, f"`{text_col}` binary", "n_lines bigint", "n_dropped bigint"]))
    own = {text_col.lower(): F.col(f"`{text_col}`").cast("string").alias(text_col)}  # Spark's own cast keeps bytes that aren't UTF-8
    return out.select(*[own.get(c.lower(), F.col(f"`{c}`")) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
