"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of documents, in their order and with
their types; columns other than doc_id, text and n_chars pass untouched, whatever their names.

A null text is an empty one and is kept by every stage that finds nothing in it. Rows are judged one by one: repeated rows and rows that share an id or have none
are neither lost nor joined, but for near-duplicates, of which one stays. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import new_path, scratch, table, written
from tracelake.llm.decontaminate import uncontaminated
from tracelake.llm.line_dedup import dedup_lines
from tracelake.llm.packing import pack_documents
from tracelake.llm.simhash import near_duplicates
from tracelake.llm.toxicity import score_toxicity, train


def _apart(docs: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns numbered, but for ``own``, so that no operator's column clashes with one of them; and the columns under their old names."""
    names = [c if c in own else f"__{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives less than one half; it is trained on labelled documents of this stage's input. A null or empty text is scored like any other."""
    docs, named = _apart(docs, "doc_id", "text")
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).filter("score < 0.5").select(named)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that many documents share. n_chars follows the text; documents of which nothing is left stay as empty ones, and a null text becomes one."""
    sized, kind = "n_chars" in docs.columns, dict(docs.dtypes).get("n_chars")
    docs, named = _apart(docs, "doc_id", "text", "n_chars")
    out = dedup_lines(docs)
    if sized:
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out.select(named)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8 or more): one with the smallest id, a null id being smallest.

    Groups come from SimHash fingerprints by the pigeonhole search and from bands of MinHashes for links beyond its reach; both are checked on the shingles themselves.

    Rows are numbered, so rows that share an id, or have none, are told apart. Rows without words are nobody's duplicates.
    """
    docs, named = _apart(docs, "doc_id", "text")
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    found = written(found.join(numbered.select("__row", F.col("doc_id").alias("id")), "__row"), "groups")
    stays = found.groupBy("component_id").agg(F.min(F.struct("id", "__row"))["__row"].alias("stays"))
    dropped = written(found.join(stays, "component_id").filter(F.col("__row") != F.col("stays")).select("__row"), "dropped")
    # Sorted at every size, as the lists of dropped lines: disk grows with the input.
    return numbered.join(dropped.hint("merge"), "__row", "left_anti").select(named)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    docs, named = _apart(docs, "doc_id", "text")
    return uncontaminated(docs, table(spark, sf_dir, "benchmark")).select(named)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 4096 tokens. A null or empty text is a piece with the end token alone."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier, SimHash and the tokenizer can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is a table in the shared folder; what the stage wrote on its way is deleted, but for the last one, whose result is lazy."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
