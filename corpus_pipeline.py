"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.decontamination import without_benchmark
from muster.llm.frames import table
from muster.llm.lines import without_repeated_lines
from muster.llm.packing import pack_documents
from muster.llm.quality import learned_quality, quality_score
from muster.llm.shingles import without_near_duplicates
from muster.plans.scratch import scratch_location

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score is at least 0.5, learned from all their labels."""
    model = learned_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_score(F.col("text"), model) >= 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that repeat earlier ones, but those that had no others.

    Exact repeats count from one word on, near ones from four: three words of four alike are the
    share of which the n-gram join makes near duplicates. `n_chars` is that of the text as it now is.
    """
    kept = without_repeated_lines(docs, "doc_id", "text", min_words=1, min_near_words=4)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    return without_near_duplicates(docs, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of a benchmark item."""
    return without_benchmark(docs, "text", table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the documents' texts."""
    return pack_documents(docs, "doc_id", "text").withColumnRenamed("keys", "doc_ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A classifier and packing have no form in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_location(spark, f"pipeline-{name}").uri
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
