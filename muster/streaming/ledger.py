"""Incremental ingest of ledgers."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from muster.operators.ledger import latest_report
from muster.sources.ledger import LEDGER_FILES, MissingParams, good_reports, parse_reports
from muster.sources.locations import OPEN_POLICY, AccessPolicy, Location, scan, scan_stream, sink

_GOOD = "good"
_TABLE = (
    "line string, sequence bigint, clusters array<struct<stopped_at: string>>, reason string"
)


def ingest_reports(
    spark: SparkSession,
    ledger: Location,
    table: Location,
    checkpoint: Location,
    *,
    files: str = LEDGER_FILES,
    missing_params: MissingParams = "fail",
    files_per_trigger: int | None = None,
    interval: str | None = None,
    archive: Location | None = None,
    policy: AccessPolicy = OPEN_POLICY,
) -> StreamingQuery:
    """Append a ledger's new files to a table, each line once, and start the query doing so.

    Reports and dead letters go to one table partitioned by `reason`, so every batch is read and
    written once. The query stops when it has taken in all present files, in batches of
    `files_per_trigger`; with an `interval` it goes on looking for new ones. A file is read when
    it is first seen and lines appended later are not: ledgers must be closed before they appear
    here, or be read in batch. A file is read however old it is. With an `archive`, files that were
    read are moved there, so that what is listed does not grow. Streams keep their logs with the session's own file-system settings,
    so object stores have to be set up there.
    """
    policy.check_sink(table)
    policy.check_sink(checkpoint)
    lines = _new_lines(spark, ledger, files, files_per_trigger, archive, policy)
    parsed = parse_reports(lines, missing_params=missing_params)
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return (
        parsed.withColumn("reason", F.coalesce("reason", F.lit(_GOOD)))
        .writeStream.format("parquet")
        .options(**table.options)
        .option("checkpointLocation", checkpoint.uri)
        .partitionBy("reason")
        .outputMode("append")
        .trigger(**trigger)
        .start(table.uri)
    )


def _new_lines(
    spark: SparkSession,
    ledger: Location,
    files: str,
    files_per_trigger: int | None,
    archive: Location | None,
    policy: AccessPolicy,
) -> DataFrame:
    # Spark forgets files older than the newest by `maxFileAge`, seven days if not set
    options: dict[str, object] = {"pathGlobFilter": files, "maxFileAge": "36500d"}
    if archive is not None:
        policy.check_sink(archive)
        options |= {"cleanSource": "archive", "sourceArchiveDir": archive.uri}
    if files_per_trigger is not None:
        options["maxFilesPerTrigger"] = files_per_trigger
    return scan_stream(spark, ledger, "text", options=options, policy=policy)


@dataclass(frozen=True)
class Ingest:
    """How far an ingest came: whether the wanted report is there, and in which batch it came.

    `latest` is the report with the highest sequence so far, or no row.
    """

    found: bool
    batch: int | None
    latest: DataFrame


_BATCHED = f"{_TABLE}, batch bigint"


def ingest_until(
    spark: SparkSession,
    ledger: Location,
    table: Location,
    checkpoint: Location,
    *,
    sequence: int,
    files: str = LEDGER_FILES,
    missing_params: MissingParams = "fail",
    files_per_trigger: int | None = None,
    interval: str = "5 seconds",
    seconds: float | None = None,
    archive: Location | None = None,
    policy: AccessPolicy = OPEN_POLICY,
) -> Ingest:
    """Take in a ledger's new files, batch by batch, until a report of at least this sequence is there.

    Every batch is written to its own folder of `table`, `lines/batch=<id>`, and overwrites what an
    attempt that died had left there, so a batch that runs again adds nothing. The latest report
    of all batches so far is the state: each batch hands it on in `latest/batch=<id>`, from the
    one before it and its own reports. Once that report's sequence is reached no further batch is
    begun: files behind it stay for the next ingest, which begins with a look at the state. The
    query looks for new files at an `interval` and gives up after so many `seconds`, if given.
    Reports without a sequence of their own type are dead letters; see `parse_reports`.
    """
    policy.check_sink(table)
    policy.check_sink(checkpoint)
    held = _state(spark, table, None)
    if held is not None and _reached(held[1], sequence):
        return Ingest(True, held[0], held[1])
    lines = _new_lines(spark, ledger, files, files_per_trigger, archive, policy)
    parsed = parse_reports(lines, missing_params=missing_params)
    reached: list[int] = []

    def take(rows: DataFrame, batch: int) -> None:
        if reached:
            raise _Reached
        sink(
            rows.withColumn("reason", F.coalesce("reason", F.lit(_GOOD))),
            table.child("lines", f"batch={batch}"),
            mode="overwrite",
        )
        own = scan(spark, table.child("lines", f"batch={batch}"), schema=_TABLE).where(F.col("reason") == _GOOD)
        before = _state(spark, table, batch)
        own = own.drop("reason")
        newest = latest_report(own if before is None else own.unionByName(before[1]))
        place = table.child("latest", f"batch={batch}")
        sink(newest.coalesce(1), place, mode="overwrite")
        if _reached(scan(spark, place, schema=newest.schema), sequence):
            reached.append(batch)

    query = (
        parsed.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint.uri)
        .trigger(processingTime=interval)
        .start()
    )
    began = time.monotonic()
    try:
        while query.isActive and (seconds is None or time.monotonic() - began < seconds):
            done = query.lastProgress
            # the batch that holds the report is done with when Spark has committed it
            if reached and done is not None and done["batchId"] >= reached[0]:
                break
            query.awaitTermination(0.2)
    except Exception:
        if not reached:
            raise
    finally:
        query.stop()
    failed = query.exception()
    if failed is not None and not reached:
        raise failed
    held = _state(spark, table, None)
    if held is None:
        return Ingest(False, None, spark.createDataFrame([], f"{_TABLE}").drop("reason"))
    return Ingest(bool(reached), reached[0] if reached else None, held[1])


class _Reached(Exception):
    """The wanted report came with an earlier batch: this one is left for the next ingest."""


def _reached(latest: DataFrame, sequence: int) -> bool:
    return not latest.where(F.col("sequence") >= sequence).isEmpty()


def _state(spark: SparkSession, table: Location, before: int | None) -> tuple[int, DataFrame] | None:
    """The last batch with a state, of those before a number if given, and the latest report by then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table.child("latest").uri)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    numbers = [
        int(folder.getPath().getName().removeprefix("batch="))
        for folder in system.listStatus(path)
        if system.exists(spark._jvm.org.apache.hadoop.fs.Path(folder.getPath(), "_SUCCESS"))
    ]
    numbers = [n for n in numbers if before is None or n < before]
    if not numbers:
        return None
    schema = "line string, sequence bigint, clusters array<struct<stopped_at: string>>"
    return max(numbers), scan(spark, table.child("latest", f"batch={max(numbers)}"), schema=schema)


def ingested_batches(
    spark: SparkSession, table: Location, policy: AccessPolicy = OPEN_POLICY
) -> DataFrame:
    """The lines that `ingest_until` took in, in the form `parse_reports` gives them, with their batch."""
    stored = scan(spark, table.child("lines"), schema=_BATCHED, policy=policy)
    return stored.withColumn("reason", F.nullif(F.col("reason"), F.lit(_GOOD)))


def ingested(
    spark: SparkSession, table: Location, policy: AccessPolicy = OPEN_POLICY
) -> DataFrame:
    """The ingested lines in the form `parse_reports` gives them."""
    stored = scan(spark, table, schema=_TABLE, policy=policy)
    return stored.withColumn("reason", F.nullif(F.col("reason"), F.lit(_GOOD)))


def ingested_reports(
    spark: SparkSession, table: Location, policy: AccessPolicy = OPEN_POLICY
) -> DataFrame:
    return good_reports(ingested(spark, table, policy))
