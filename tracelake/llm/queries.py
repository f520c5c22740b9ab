"""One query for each corpus operator, with production parameters, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chars")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    from tracelake.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    from tracelake.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.chat_format import format_conversations, read_back

    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn int, role string, text string")
    return read_back(format_conversations(rows.unionByName(extra)))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.warc import read_warc, write_warc

    return read_warc(write_warc(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=2)
    items = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated", F.array_join("near_item_ids", ",").alias("near_items"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.secrets import find_secrets, listed

    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.toxicity import held_out, score_toxicity, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_token_alignment(spark: SparkSession, sf_dir: str, a: str | None = None, b: str | None = None) -> DataFrame:
    import public_tokenizers as files

    from tracelake.llm.alignment import align

    return align(table(spark, sf_dir, "documents"), a or files.path("byte_bpe_50k.json"), files.PATTERN, b or files.path("piece_bpe_32k.model"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.llm.set_join import similar_sets

    return similar_sets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_simhash, op3_best_fit_packing, op4_line_dedup, op5_token_counts, op6_chat_formatting, op7_warc, op8_decontamination, op9_secrets, op10_toxicity, op11_token_alignment, op12_filter_audit, op13_ngram_join)}


def oracle_sql() -> dict[str, str]:
    from tracelake.llm.sql import SQL

    return {k: v for k, v in SQL.items() if k in queries()}
