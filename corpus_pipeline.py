"""From raw documents to a mixed corpus: five stages, each written as Parquet and read by the next.

Every stage keeps all columns of its input, whatever their names, and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lustra.llm import jaccard, lines, mixing, quality, wumanber
from lustra.llm.queries import table
from lustra.session import stage

# Hash orders and error diffusion have no counterpart in SQL; tests compare with plain versions.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep.

    Null, empty and very short texts go; repeated rows are judged each; a null id is like any other.
    """
    return quality.kept_documents(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of repeated lines; n_chars follows the text.

    Null texts stay null; rows equal in id and text are one occurrence and keep the same lines.
    """
    out = lines.without_repeated_lines(docs)
    return out.withColumn("n_chars", F.expr("CAST(length(text) AS BIGINT)")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id (null last).

    Texts without words, null ones included, are near nothing and all stay; of rows equal in id and text one stays.
    """
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; texts without words have none and stay."""
    return wumanber.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their number of copies.

    Texts without words have no size and go; null sources are a source; repeated rows are documents each.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage but the last is written in the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
