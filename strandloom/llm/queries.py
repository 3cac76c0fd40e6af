"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.llm import (
    bpe, fixity, jaccard, langid, links, packing, private, quality, spelling, substrings, tokencount, vptree,
    whitening,
)
from strandloom.llm.common import table


def op1_byte_pair_coding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return bpe.encode_documents(
        docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
        emit=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_private_spans(spark: SparkSession, folder: str) -> DataFrame:
    found, name = private.annotated(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.col(f"{name}_base")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in private.KINDS
    ]
    return found.select(
        "doc_id", *counts, F.sha2(private.span_text(base), 256).alias("base_sha256"),
        private.span_text(F.col(name)).alias("spans"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return links.judged(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    languages, model = langid.fit(docs)
    rows = langid.from_pages(table(spark, folder, "pages"), languages).unionByName(langid.from_documents(docs))
    return langid.identified(rows, languages, model)


def op5_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    cut, total, removed = substrings.without_repeats(
        table(spark, folder, "documents").select("doc_id", "text"), respace=True)
    return cut.select("doc_id", F.col(total).alias("n_words"), F.col(removed).alias("n_removed"),
                      F.sha2(F.col("text"), 256).alias("kept_sha256"))


def replica_with_damage(records: DataFrame) -> DataFrame:
    """A second replica derived from the first: some records changed, cut short, lost or added."""
    n, text = F.col("record_id"), F.col("record")
    damaged = (
        F.when(n % 101 == 7, F.overlay(text, F.lit("X"), F.lit(12)))
        .when(n % 211 == 3, F.substring(text, F.lit(1), F.length(text) - 40)).otherwise(text))
    stays = records.where(n.isNull() | (n % 307 != 5)).select("record_id", damaged.alias("record"))
    return stays.unionByName(records.where(n % 409 == 11).select((-n - 1).alias("record_id"), "record"))


def op6_fixity_audit(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    records = pages.select(
        F.col("page_id").alias("record_id"),
        fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    return fixity.audit(records, replica_with_damage(records)).withColumnRenamed("record_id", "page_id")


def op7_near_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.linked(table(spark, folder, "documents"))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.packed(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
        added=True)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return vptree.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op11_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.grouped(spelling.vocabulary(table(spark, folder, "documents"), noise=31))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = tokencount.counted(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("over_limit", F.col("n_tokens") > 4096)


QUERIES = {f.__name__: f for f in (
    op1_byte_pair_coding, op2_private_spans, op3_url_filter, op4_language, op5_repeated_passages,
    op6_fixity_audit, op7_near_join, op8_quality_rules, op9_packing, op10_nearest,
    op11_spelling_groups, op12_whitening, op13_token_counts,
)}
