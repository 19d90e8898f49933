"""The registered queries of this package and, where SQL can state it, their results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import oracle
from muster.llm.chat import dealt_events, format_log, read_back
from muster.llm.decontamination import find_benchmark
from muster.llm.fingerprints import fingerprint_documents
from muster.llm.frames import held_out, table
from muster.llm.language import fit_languages, identify_languages
from muster.llm.licences import known_notices, scan_licenses
from muster.llm.lines import repeated_lines
from muster.llm.packing import pack_documents
from muster.llm.passages import with_kept_words
from muster.llm.phrases import collocations
from muster.llm.quality import learned_quality, quality_score
from muster.llm.sharding import shard_by_bytes
from muster.llm.shingles import near_duplicates
from muster.llm.spelling import count_words, spelling_variants

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose remainder is not 2."""
    documents = table(spark, sf_dir, "documents")
    is_out = held_out("doc_id", 4, 2)
    model = fit_languages(documents.where(~is_out), "text", "lang")
    found = identify_languages(documents.select("doc_id", "text", is_out.alias("held_out")), "text", model)
    return found.select(
        "doc_id", "held_out", F.col("lang").alias("lang_pred"), "score", "margin", "accepted"
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document as a whole, and licences whose notice is a line of it."""
    return scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text", known_notices(spark))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document are inside benchmark windows, and of which items."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(documents, "text", table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted conversations say, read back from them. They come from a log of deltas,
    edits and regenerations."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    return read_back(format_log(dealt_events(rows.unionByName(extra))))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part of every document is in which sequence, and where: one row for each piece."""
    packed = pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text")
    pieces = F.arrays_zip("keys", "starts", "texts")
    return packed.select(
        "sequence_id", "capacity", "used", F.posexplode(pieces).alias("place", "piece")
    ).select(
        F.col("piece.keys").alias("doc_id"),
        F.col("piece.starts").alias("start"),
        F.octet_length("piece.texts").cast("long").alias("n_bytes"),
        "sequence_id",
        "place",
        "capacity",
        "used",
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels whose remainder is not 1."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    is_out = held_out("doc_id", 3, 1)
    labels = table(spark, sf_dir, "labels").where(~is_out)
    model = learned_quality(documents, labels)
    return documents.select(
        "doc_id", is_out.alias("held_out"), quality_score(F.col("text"), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, of 24 shards of near equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), "doc_id", "text", 24)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, and those of four words or more that are near one: one
    row for each line to drop."""
    return repeated_lines(table(spark, sf_dir, "documents"), "doc_id", "text").select(
        F.col("key").alias("doc_id"), F.col("line").cast("long").alias("line"), "near"
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprint_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many shingles every document has and the least document its links reach."""
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text").select(
        F.col("key").alias("doc_id"),
        F.col("size").alias("n_shingles"),
        F.col("component").alias("component_id"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of seven letters or more, how many are one edit away, and their usual form."""
    words = count_words(table(spark, sf_dir, "documents"), "doc_id", "text")
    return spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 50 words that an earlier one has."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_kept_words(documents, "doc_id", "text").select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language."""
    return collocations(table(spark, sf_dir, "documents"), "text", "lang")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_license_scan,
        op3_decontamination,
        op4_chat_format,
        op5_packing,
        op6_quality,
        op7_sharding,
        op8_line_dedup,
        op9_fingerprints,
        op10_ngram_join,
        op11_spelling_variants,
        op12_substring_dedup,
        op13_collocations,
    )
}

SQL: dict[str, str] = {
    "op2_license_scan": oracle.LICENSES,
    "op3_decontamination": oracle.DECONTAMINATION,
    "op4_chat_format": oracle.CHAT,
    "op7_sharding": oracle.SHARDS,
    "op8_line_dedup": oracle.LINES,
    "op10_ngram_join": oracle.COMPONENTS,
    "op11_spelling_variants": oracle.SPELLING,
    "op12_substring_dedup": oracle.PASSAGES,
    "op13_collocations": oracle.COLLOCATIONS,
}
