"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swatchwork.llm.decontam import decontaminate
from swatchwork.llm.neardup import near_duplicates
from swatchwork.llm.packing import pack
from swatchwork.llm.pii import personal_data, redacted
from swatchwork.llm.toxicity import score_toxicity, train_toxicity
from swatchwork.runtime import small_enough, united, written


def _without(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not in the written one-column frame ``ids``, which is broadcast
    only when its counted size allows it."""
    return docs.join(F.broadcast(ids) if small_enough(ids.count(), 16) else ids, key, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out every row that the classifier calls toxic.

    Rows are judged by their own text, also those with a null or repeated doc_id; a null or empty
    text gets the score of the intercept. An empty table stays empty.
    """
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, keep_row=True).filter("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest doc_id of each group of near duplicates.

    A row without an id takes part under one made from its text, above all others, and keeps its
    null. Of rows with one id, one stays: that with the smallest text. Null and empty texts, and
    texts without words, are like no other and stay. Rows of one id and text with other differences go by
    the first of them as JSON. An empty table stays empty.
    """
    no_id = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)
    named = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), no_id))
    found = written(near_duplicates(named.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "kept"))
    kept = _without(named, "_key", written(found.filter("not kept").select("_key").distinct()))
    again = written(found.filter("kept").groupBy("_key").count().filter("count > 1").select("_key"))
    if again.isEmpty():
        return kept.select(docs.columns)
    order = F.struct(F.coalesce(F.col("text").cast("string"), F.lit("")), F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}))
    first = F.min_by(F.struct(*docs.columns), order)
    one = kept.join(again, "_key", "left_semi").groupBy("_key").agg(first.alias("row")).select("row.*")
    return _without(kept, "_key", again).select(docs.columns).transform(united, one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out every row that holds a window of a benchmark item.

    Rows are judged by their own text, also those with a null or repeated doc_id; null and empty
    texts hold none and stay. An empty table stays empty.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_row=True).filter("not contaminated").select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind; ``n_chars`` follows the text.

    Every row stays, repeated ones and those without an id too; a null text stays null.
    """
    found = redacted(personal_data(docs, keep_row=True), "row.text")
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 4096 tokens.

    A null or empty text is the end id alone; repeated rows are packed each, and a null doc_id stays
    null. An empty table gives no rows.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: The classifier, the tokenizer and the packing are no SQL; tests/llm holds the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
