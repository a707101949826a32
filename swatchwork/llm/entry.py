"""Queries of this folder, for the driver's contract, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from swatchwork.llm.oracle import SQL as SQL  # noqa: PLC0414
from swatchwork.runtime import united


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatchwork.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatchwork.llm.toxicity import score_toxicity, train_toxicity

    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, _table(spark, sf_dir, "labels")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from swatchwork.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatchwork.llm.linequality import line_quality

    return line_quality(_table(spark, sf_dir, "documents"))


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatchwork.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatchwork.llm.urlrules import judge_urls, rule_table

    return judge_urls(_table(spark, sf_dir, "pages"), rule_table(spark))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from swatchwork.llm.tokencount import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatchwork.llm.decontam import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatchwork.llm.chat import chat_digests

    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digests(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").transform(united, more))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatchwork.llm.pii import personal_data, span_strings

    return span_strings(personal_data(_table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatchwork.llm.prefixtrie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatchwork.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatchwork.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).drop("taken_at")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_OPERATORS = (
    op1_license_scan, op2_toxicity, op3_best_fit_packing, op4_line_quality, op5_minhash_near_dup, op6_url_rules,
    op7_token_counts, op8_decontamination, op9_chat_format, op10_personal_data, op11_prefix_trie, op12_whitening,
    op13_source_mix, pipeline,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _OPERATORS}
