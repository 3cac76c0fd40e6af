"""From raw documents to packed token sequences: five stages, each written before the next one starts.

Quality rules drop documents, the near-duplicate join leaves one document of each class, repeated
passages leave the later documents, personal data is replaced, and what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.llm import jaccard, packing, private, quality, substrings
from strandloom.llm.common import free_name, scratch_of, table
from strandloom.session import materialize


def _counted(docs: DataFrame, changed) -> DataFrame:
    """``n_chars`` anew where the text has changed."""
    if "n_chars" not in docs.columns:
        return docs
    count = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return docs.withColumn("n_chars", F.when(changed, count).otherwise(F.col("n_chars")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table. A null text fails."""
    with scratch_of("pipeline", 0):
        judged = quality.judged(docs)
        return judged.where(F.col(judged.columns[-1])).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document by id of each class of near duplicates; documents without words all stay."""
    with scratch_of("pipeline", 1):
        return jaccard.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages an earlier one has; those that lose every word go."""
    with scratch_of("pipeline", 2):
        cut, total, removed = substrings.without_repeats(docs)
        left = cut.where((F.col(removed) == 0) | (F.col(removed) < F.col(total)))
        return _counted(left, F.col(removed) > 0).select(*docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    with scratch_of("pipeline", 3):
        before = free_name(docs, "_before")
        hidden = private.redacted(docs.withColumn(before, F.xxhash64("text")))
        return _counted(hidden, F.xxhash64("text") != F.col(before)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; see ``packing.packed``."""
    with scratch_of("pipeline", 4):
        return packing.packed(
            docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", keep_one_of_each),
    ("repeated passages", cut_repeats),
    ("personal data", hide_private),
    ("packing", pack),
]

#: Tokens and redacted texts have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
