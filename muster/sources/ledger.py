"""Usage ledgers: JSON lines of reports, as files."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.json import computed_once, read_again, with_object
from muster.sources.locations import OPEN_POLICY, AccessPolicy, Location, scan

# Fixed value: the names of a ledger's files.
LEDGER_FILES = "report.*.jsonl"

MissingParams = Literal["fail", "route"]

_FIELDS = "params: struct<sequence: variant, clusters: array<struct<stopped_at: variant>>>"

# Any character that is not white space, Unicode separators included.
_INK = r"(?U)[^\s\x1c-\x1f]"


def ledger_lines(
    spark: SparkSession,
    ledger: Location,
    files: str = LEDGER_FILES,
    policy: AccessPolicy = OPEN_POLICY,
) -> DataFrame:
    """The raw lines of the files directly in a ledger's folder, as `value`."""
    options = {"pathGlobFilter": files}
    return scan(spark, ledger, "text", options=options, policy=policy).select("value")


def parse_reports(
    lines: DataFrame, text: str = "value", missing_params: MissingParams = "fail"
) -> DataFrame:
    """Classify and read report lines; works on streams too.

    Blank lines are dropped. Every other line gives a row with `line`, `sequence`, `clusters` and
    `reason`, which is null for a report. `bad_json` is a line that is not one whole JSON document (it
    is still being written), `no_params` a document without an object of params. The last kind
    fails the job unless it is to be routed. A report's sequence must be a JSON integer of 64 bits
    and its clusters a list of objects that have `stopped_at`; `mistyped_reason` names what else
    there is. What is not read here is of any size and depth and may repeat its keys. `line` keeps it.
    """
    if missing_params not in ("fail", "route"):
        raise ValueError(f"missing_params is 'fail' or 'route', got {missing_params!r}")
    inked = lines.where(F.col(text).rlike(_INK)).select(F.col(text).alias("line"))
    params = F.col("__read.object.params")
    typed = computed_once(
        with_object(inked, "line", _FIELDS, "__read"),
        F.struct(params.alias("params"), F.schema_of_variant(params["sequence"]).alias("kind")),
        "__typed",
    )
    no_params = (
        F.lit("no_params")
        if missing_params == "route"
        else F.raise_error(F.concat(F.lit("a report has no params: "), F.col("line")))
    )
    sequence, clusters = F.col("__typed.params.sequence"), F.col("__typed.params.clusters")
    reason = (
        F.when(~F.col("__read.whole"), F.lit("bad_json"))
        .when(F.col("__typed.params").isNull(), no_params)
        .otherwise(mistyped_reason(F.col("__typed.kind"), clusters))
    )
    judged = computed_once(typed, F.struct(reason.alias("reason")), "__judged")
    good = F.col("__judged.reason").isNull()
    stops = F.transform(
        clusters, lambda c: F.struct(F.try_variant_get(c["stopped_at"], "$", "string").alias("stopped_at"))
    )
    return judged.select(
        "line",
        F.when(good, F.try_variant_get(sequence, "$", "bigint")).alias("sequence"),
        F.when(good, stops).alias("clusters"),
        "__judged.reason",
    )


def mistyped_reason(kind: Column, clusters: Column) -> Column:
    """Why the params of a `line` make no report, null if they do: by the JSON type of the sequence
    as variants name it, and by the clusters, which are null where they are no list of objects.

    The first of: `sequence_missing` (or null), `_text`, `_boolean`, `_oversized`, `_fraction` (any
    other number, `2.0` and `2e0` too), `_nested`; `clusters_missing` (or null), `_not_list`, and
    `_malformed` for elements that are not objects or have no `stopped_at`. A number of more than
    38 digits is not told from a fraction.
    """
    digits = F.regexp_extract(kind, r"^DECIMAL\(([0-9]+),0\)$", 1).try_cast("int")
    again = read_again("line", "params: struct<clusters: string>")["params"]["clusters"]
    listed = read_again("line", "params: struct<clusters: array<string>>")["params"]["clusters"]
    return (
        F.when(kind.isNull() | (kind == "VOID"), F.lit("sequence_missing"))
        .when(kind == "STRING", F.lit("sequence_text"))
        .when(kind == "BOOLEAN", F.lit("sequence_boolean"))
        .when(digits >= 19, F.lit("sequence_oversized"))
        .when((kind == "DOUBLE") | kind.startswith("DECIMAL"), F.lit("sequence_fraction"))
        .when(kind != "BIGINT", F.lit("sequence_nested"))
        .when(clusters.isNull() & listed.isNotNull(), F.lit("clusters_malformed"))
        .when(clusters.isNull() & again.isNull(), F.lit("clusters_missing"))
        .when(clusters.isNull(), F.lit("clusters_not_list"))
        .when(F.exists(clusters, lambda c: c["stopped_at"].isNull()), F.lit("clusters_malformed"))
    )


def good_reports(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def dead_letters(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select("line", "reason")


def read_reports(
    spark: SparkSession,
    ledger: Location,
    files: str = LEDGER_FILES,
    missing_params: MissingParams = "fail",
    policy: AccessPolicy = OPEN_POLICY,
) -> DataFrame:
    """The reports of a ledger, in no order; `sequence` orders them."""
    lines = ledger_lines(spark, ledger, files, policy)
    return good_reports(parse_reports(lines, missing_params=missing_params))
