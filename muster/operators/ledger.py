"""Questions asked of a ledger's reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_report(reports: DataFrame) -> DataFrame:
    """The report with the highest sequence, or no row while only the first, empty tick exists.

    Of several lines with that sequence the greatest text is taken, so that reruns agree.
    """
    others = [name for name in reports.columns if name not in ("sequence", "line")]
    newest = F.max_by(F.struct("line", *others), F.struct("sequence", "line"))
    return (
        reports.where(F.col("sequence") > 1)
        .agg(F.max("sequence").alias("sequence"), newest.alias("__newest"))
        .where(F.col("sequence").isNotNull())
        .select("sequence", "__newest.*")
        .select(*reports.columns)
    )


def duplicate_sequences(reports: DataFrame) -> DataFrame:
    """Sequences that more than one line carries, with their number of lines."""
    counts = reports.groupBy("sequence").agg(F.count("*").alias("lines"))
    return counts.where((F.col("lines") > 1) & F.col("sequence").isNotNull())


def open_clusters(reports: DataFrame) -> DataFrame:
    """Add each report's number of clusters and of those that have not stopped."""
    running = F.filter("clusters", lambda cluster: cluster["stopped_at"].isNull())
    return reports.withColumns(
        {"cluster_count": F.size("clusters"), "open_count": F.size(running)}
    )


def cluster_rows(reports: DataFrame) -> DataFrame:
    """One row for each cluster of a report; a report without clusters gives one null row."""
    others = [name for name in reports.columns if name != "clusters"]
    return reports.select(*others, F.posexplode_outer("clusters").alias("position", "cluster"))
