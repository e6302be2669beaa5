"""A corpus pipeline: each stage applies one operator of ``cloakframe.llm`` and is written before the next one reads it.

Every stage takes all rows that the one before has kept and returns the columns of
``documents``; only the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.llm.base import materialize, read
from cloakframe.llm.jaccard_join import jaccard_join
from cloakframe.llm.kk_packing import kk_packing
from cloakframe.llm.quality_svm import fit_quality, score_quality
from cloakframe.llm.source_mix import mixed_texts
from cloakframe.llm.suffix_dedup import suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_QUALITY = 0.7


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier does not reject; it learns from the labelled rows of ``documents``, not from ``docs``."""
    model = fit_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return score_quality(docs.select(*COLUMNS), model).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of five-word shingle sets at 0.8 or more; one row of each id."""
    found = jaccard_join(docs, n=5, per_cent=80)
    stay = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi")
    kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where("_n = 1")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes or more that an earlier document holds."""
    return _sized(suffix_dedup(docs.select(*COLUMNS), with_text=True))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; parts taken more than once stand in its text as often."""
    return _sized(mixed_texts(docs.select(*COLUMNS)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kk_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("mix_sources", mix_sources),
    ("packing", packing),
]

#: SQL can express none of the first three stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
