"""Every registered query: its frame and, where SQL can state it, its result in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.requests import validate_requests
from muster.functions.scaling import added_names, clamp_requests, plan_changes
from muster.operators import pool
from muster.operators.changes import plan_pool_changes
from muster.operators.compare import bag_difference, bag_difference_by_digest
from muster.operators.ledger import (
    cluster_rows,
    duplicate_sequences,
    latest_report,
    open_clusters,
)
from muster.operators.paths import covering_paths
from muster.operators.timeline import live_counts_at
from muster.operators.windows import with_max_over
from muster.plans.run import execute, with_partitions
from muster.plans.scratch import scratch_location
from muster.plans.staged import run_staged
from muster.sources.ledger import dead_letters, good_reports, parse_reports, read_reports
from muster.sources.locations import AccessPolicy, Location, scan, sink
from muster.streaming.ledger import ingest_reports, ingest_until, ingested_batches, ingested_reports
from queries import tables
from queries.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def _text(name: str) -> Column:
    """A number that may be missing, as text: data frames of other engines turn it into a float."""
    return F.col(name).cast("string").alias(name)


# --- queries, runs and comparison ---------------------------------------------------------------

_ORDER_PEAKS = """
    SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS customer_max
    FROM orders
"""


def _order_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_max_over(table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey"], "customer_max")


@query(_ORDER_PEAKS)
def window_max_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_peaks(spark, sf_dir)


@query(
    """
    SELECT *, max(l_shipdate) OVER (PARTITION BY l_returnflag, l_linestatus) AS last_shipdate
    FROM lineitem
    """
)
def window_max_over_few_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few keys hold all rows: the case a window would bring into a handful of tasks."""
    keys = ["l_returnflag", "l_linestatus"]
    return with_max_over(table(spark, sf_dir, "lineitem"), "l_shipdate", keys, "last_shipdate")


@query(
    """
    SELECT o_orderstatus, count(*) AS orders, max(o_totalprice) AS highest_price
    FROM orders GROUP BY o_orderstatus
    """
)
def run_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored result of few rows: its preview is all of it."""
    by_status = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("orders"), F.max("o_totalprice").alias("highest_price")
    )
    return execute(by_status, results=scratch_location(spark, "results")).head


@query(
    """
    SELECT status, meaning, count(o_orderkey) AS orders
    FROM (VALUES ('O', 'open'), ('F', 'filled'), ('X', 'unknown')) AS t(status, meaning)
    LEFT JOIN orders ON o_orderstatus = status GROUP BY ALL
    """
)
def literal_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of literals joined to a table."""
    meanings = spark.createDataFrame(
        [("O", "open"), ("F", "filled"), ("X", "unknown")], "status string, meaning string"
    )
    orders = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    joined = meanings.join(orders, F.col("status") == F.col("o_orderstatus"), "left")
    return joined.select("status", "meaning", F.coalesce("n", F.lit(0)).alias("orders"))


@query(
    """
    SELECT 'cached' AS frame, false AS allowed, count(*) AS rows FROM orders
    UNION ALL SELECT 'joined', false, count(*) FROM orders
    UNION ALL SELECT 'plain', false, count(*) FROM orders
    UNION ALL SELECT 'literal', true, 1
    UNION ALL SELECT 'in', false, count(*) FROM range(1000) t(id) WHERE id IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'exists', false, count(*) FROM range(1000) t(id)
        WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = id)
    UNION ALL SELECT 'scalar', false, count(*) FROM range(1000) t(id) WHERE id > (SELECT min(o_custkey) FROM orders)
    """
)
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which frames a policy without local scans lets through, and how many rows they have."""
    source = Location(sf_dir) if ":" in sf_dir else Location.local(sf_dir)
    orders = scan(spark, source.child("orders.parquet"))
    customers = orders.select(F.col("o_custkey").alias("key")).distinct()
    cached = orders.select("*").cache()
    frames = {
        "plain": orders,
        "joined": orders.join(customers, F.col("o_custkey") == F.col("key")),
        "cached": cached,
        "literal": spark.range(1),
    }
    wheres = {
        "in": "id IN (SELECT o_custkey FROM {orders})",
        "exists": "EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = id)",
        "scalar": "id > (SELECT min(o_custkey) FROM {orders})",
    }
    for name, where in wheres.items():
        frames[name] = spark.sql(f"SELECT id FROM {{ids}} WHERE {where}", ids=spark.range(1000), orders=orders)
    policy = AccessPolicy(allow_local_scans=False)
    found = None
    for name, frame in frames.items():
        try:
            policy.check_frame(frame)
            allowed = True
        except PermissionError:
            allowed = False
        row = frame.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("frame"), F.lit(allowed).alias("allowed"), "rows"
        )
        found = row if found is None else found.unionByName(row)
    cached.unpersist()
    return found


@query(_ORDER_PEAKS)
def run_stored_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = execute(_order_peaks(spark, sf_dir), results=scratch_location(spark, "results"))
    return scan(spark, run.location)


_NET_PRICES = """
    SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net_price
    FROM lineitem
"""


@query(_NET_PRICES)
def python_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Defined here, so that it travels to the executors by value.
    @F.pandas_udf("double")
    def net_price(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1 - discount)

    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        net_price("l_extendedprice", "l_discount").alias("net_price"),
    )


@query(_NET_PRICES)
def python_arrow_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    def net_prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            rest = pc.subtract(1.0, batch["l_discount"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["l_orderkey"],
                    batch["l_linenumber"],
                    pc.multiply(batch["l_extendedprice"], rest),
                ],
                ["l_orderkey", "l_linenumber", "net_price"],
            )

    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"
    )
    return lines.mapInArrow(net_prices, "l_orderkey long, l_linenumber int, net_price double")


_LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@query(
    f"""
    WITH edited AS (
        SELECT * REPLACE (CASE WHEN l_tax = 0 THEN l_quantity + 1
                               ELSE l_quantity END AS l_quantity)
        FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_quantity = 50)
        UNION ALL
        SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50
    ),
    counts AS (
        SELECT {", ".join(_LINE_COLUMNS)}, sum(a) AS left_count, sum(b) AS right_count
        FROM (SELECT *, 1 AS a, 0 AS b FROM lineitem UNION ALL SELECT *, 0, 1 FROM edited)
        GROUP BY {", ".join(_LINE_COLUMNS)}
    )
    SELECT * REPLACE (CAST(left_count AS BIGINT) AS left_count,
                      CAST(right_count AS BIGINT) AS right_count)
    FROM counts WHERE left_count <> right_count
    """
)
def bag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table against a copy with lines changed, dropped and doubled."""
    lines = table(spark, sf_dir, "lineitem")
    quantity = F.col("l_quantity")
    largest = (quantity == 50) & (F.col("l_returnflag") == F.lit("A"))
    returned = (quantity == 50) & (F.col("l_returnflag") == F.lit("R"))
    edited = (
        lines.where(~largest)
        .withColumn("l_quantity", F.when(F.col("l_tax") == 0, quantity + 1).otherwise(quantity))
        .unionAll(lines.where(returned))
    )
    return bag_difference(lines, edited)


@query(
    f"""
    WITH edited AS (
        SELECT * FROM lineitem WHERE l_orderkey % 1000 <> 7
        UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 1000 = 8 AND l_linenumber = 1
    ),
    counts AS (
        SELECT {", ".join(_LINE_COLUMNS)}, sum(a) AS left_count, sum(b) AS right_count
        FROM (SELECT *, 1 AS a, 0 AS b FROM lineitem UNION ALL SELECT *, 0, 1 FROM edited)
        GROUP BY {", ".join(_LINE_COLUMNS)}
    )
    SELECT * REPLACE (CAST(left_count AS BIGINT) AS left_count,
                      CAST(right_count AS BIGINT) AS right_count)
    FROM counts WHERE left_count <> right_count
    """
)
def bag_diff_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table against a copy with few orders dropped and few lines doubled, by digests of buckets."""
    lines = table(spark, sf_dir, "lineitem")
    part = F.col("l_orderkey") % 1000
    edited = lines.where(part != 7).unionAll(lines.where((part == 8) & (F.col("l_linenumber") == 1)))
    return bag_difference_by_digest(lines, edited)


# --- locations, partitions and resume -----------------------------------------------------------


@query("SELECT * FROM orders")
def local_scan_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = Location(sf_dir) if ":" in sf_dir else Location.local(sf_dir)
    orders = scan(spark, source.child("orders.parquet"))
    copy = scratch_location(spark, "copies")
    sink(orders, copy, format="orc")
    return scan(spark, copy, format="orc", schema=orders.schema)


@query(
    """
    SELECT 7 AS partitions, count(DISTINCT o_custkey) AS customers, count(*) AS orders FROM orders
    """
)
def run_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many partitions a run had that asked for seven behind its shuffle."""
    by_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    numbered = by_customer.withColumn("part", F.spark_partition_id())
    run = execute(numbered, results=scratch_location(spark, "results"), partitions=7)
    return scan(spark, run.location).agg(
        F.count_distinct("part").alias("partitions"), F.count("*").alias("customers"), F.sum("n").alias("orders")
    )


@query("SELECT * FROM orders")
def partitioned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_partitions(table(spark, sf_dir, "orders"), 4)


@query(
    """
    SELECT o_custkey, count(DISTINCT o_orderkey) AS orders,
           CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    GROUP BY o_custkey
    """
)
def staged_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages with every stage checkpointed, then a second run that resumes after the last."""

    def order_totals(spark: SparkSession, _: DataFrame | None) -> DataFrame:
        lines = table(spark, sf_dir, "lineitem")
        return lines.groupBy("l_orderkey").agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"),
            F.count("*").alias("lines"),
        )

    def customer_totals(spark: SparkSession, totals: DataFrame) -> DataFrame:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        joined = totals.join(orders, totals["l_orderkey"] == orders["o_orderkey"])
        return joined.groupBy("o_custkey").agg(
            F.count("*").alias("orders"),
            F.sum("quantity").alias("quantity"),
            F.sum("lines").alias("lines"),
        )

    stages = [("order_totals", order_totals), ("customer_totals", customer_totals)]
    root = scratch_location(spark, "staged")
    for _ in range(2):
        run = run_staged(spark, stages, run_id="totals", checkpoints=root, period_seconds=0)
    return run.result


# --- ledgers ------------------------------------------------------------------------------------

# The reports among the events, with their clusters as a list of stop times.
_REPORTS = """
    reports AS (
        SELECT event_id + 1 AS sequence, CAST(event_id % 4 AS INTEGER) AS cluster_count,
               list_transform(range(event_id % 4), lambda i:
                   CASE WHEN (event_id + i) % 3 <> 0
                        THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END) AS stops
        FROM events
        WHERE event_id % 101 <> 0 AND event_id % 97 <> 0 AND event_id % 89 <> 0
    )
"""

_REPORT_ROWS = f"""
    WITH {_REPORTS}
    SELECT sequence, cluster_count,
           array_to_string(list_transform(stops, lambda s: coalesce(s, 'open')), ',') AS stops
    FROM reports
"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_reports(tables.ledger_lines(spark, sf_dir), missing_params="route")


def _report_rows(reports: DataFrame) -> DataFrame:
    stops = F.transform("clusters", lambda c: F.coalesce(c["stopped_at"], F.lit("open")))
    return reports.select(
        "sequence",
        F.size("clusters").alias("cluster_count"),
        F.array_join(stops, ",").alias("stops"),
    )


# Spark chooses the names of the files it writes.
_WRITTEN_FILES = "part-*.txt"


def _written_ledger(spark: SparkSession, sf_dir: str) -> Location:
    ledger = scratch_location(spark, "ledger")
    sink(tables.ledger_lines(spark, sf_dir), ledger, format="text")
    return ledger


@query(_REPORT_ROWS)
def ledger_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _written_ledger(spark, sf_dir)
    reports = read_reports(spark, ledger, _WRITTEN_FILES, missing_params="route")
    return _report_rows(reports)


@query(
    f"""
    SELECT CASE WHEN event_id % 97 = 0 THEN 'bad_json' WHEN event_id % 89 = 0 THEN 'no_params'
                ELSE {list(tables.MISTYPED)}[event_id // 83 % {len(tables.MISTYPED)} + 1] END AS reason,
           count(*) AS lines
    FROM events
    WHERE event_id % 101 <> 0 AND (event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0)
    GROUP BY 1
    """
)
def ledger_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no reports, by the reason, with mistyped ones among them."""
    lines = tables.ledger_lines(spark, sf_dir, mistyped=True)
    letters = dead_letters(parse_reports(lines, missing_params="route"))
    return letters.groupBy("reason").agg(F.count("*").alias("lines"))


@query(
    f"""
    WITH {_REPORTS}
    SELECT sequence, cluster_count,
           array_to_string(list_transform(stops, lambda s: coalesce(s, 'open')), ',') AS stops
    FROM reports WHERE sequence > 1 ORDER BY sequence DESC LIMIT 1
    """
)
def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_rows(latest_report(good_reports(_parsed(spark, sf_dir))))


@query(
    f"""
    WITH {_REPORTS}
    SELECT sequence, cluster_count,
           CAST(len(list_filter(stops, lambda s: s IS NULL)) AS INTEGER) AS open_count
    FROM reports
    """
)
def ledger_open_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = open_clusters(good_reports(_parsed(spark, sf_dir)))
    return reports.select("sequence", "cluster_count", "open_count")


@query(
    f"""
    WITH {_REPORTS},
    shown AS (
        SELECT sequence, unnest(CASE WHEN cluster_count = 0 THEN [NULL]
                                     ELSE range(cluster_count) END) AS position, stops
        FROM reports
    )
    SELECT sequence, CAST(position AS VARCHAR) AS position,
           stops[CAST(position AS INTEGER) + 1] AS stopped_at
    FROM shown
    """
)
def ledger_cluster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster_rows(good_reports(_parsed(spark, sf_dir)))
    return rows.select(
        "sequence", _text("position"), F.col("cluster.stopped_at").alias("stopped_at")
    )


@query(
    f"""
    WITH {_REPORTS}
    SELECT sequence // 2 AS sequence, count(*) AS lines
    FROM reports GROUP BY 1 HAVING count(*) > 1
    """
)
def ledger_duplicate_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halving the sequences makes most of them occur twice."""
    reports = good_reports(_parsed(spark, sf_dir))
    return duplicate_sequences(reports.withColumn("sequence", F.expr("sequence div 2")))


@query(_REPORT_ROWS)
def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _written_ledger(spark, sf_dir)
    target = scratch_location(spark, "ingested")
    stream = ingest_reports(
        spark,
        ledger,
        target.child("table"),
        target.child("progress"),
        files=_WRITTEN_FILES,
        missing_params="route",
        files_per_trigger=1000,
    )
    stream.awaitTermination()
    return _report_rows(ingested_reports(spark, target.child("table")))


@query(
    """
    WITH numbered AS (
        SELECT event_id, event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS file,
               event_id % 101 <> 0 AND event_id % 97 <> 0 AND event_id % 89 <> 0 AS good
        FROM events
    ),
    wanted AS (SELECT (max(event_id) + 1) // 2 AS sequence FROM events),
    last AS (
        SELECT min(file) AS file FROM numbered, wanted WHERE good AND event_id + 1 >= sequence
    )
    SELECT n.file AS batch, CAST(count(*) FILTER (good) AS BIGINT) AS reports,
           max(event_id + 1) FILTER (good) AS highest, n.file = (SELECT file FROM last) AS stopped
    FROM numbered n WHERE n.file <= (SELECT file FROM last) GROUP BY n.file
    """
)
def ledger_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of four files in order of time, taken in file by file until the middle sequence is
    there; what each batch held. The third file stays unless it holds that sequence, and so on."""
    lines = tables.numbered_ledger_lines(spark, sf_dir)
    top = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] + 1
    place = scratch_location(spark, "until")
    for number in range(4):
        part = lines.where(F.floor(F.col("event_id") * 4 / top) == number).select("value")
        sink(part.coalesce(1), place.child("ledger", f"part-{number}"), format="text")
        tables.settle(spark, place.child("ledger", f"part-{number}"), place.child("closed"), f"report.{number}.jsonl")
    terms = {"sequence": top // 2, "missing_params": "route", "files_per_trigger": 1, "interval": "0 seconds"}
    ingest = ingest_until(spark, place.child("closed"), place.child("table"), place.child("progress"), **terms)
    # a second call has nothing to do
    again = ingest_until(spark, place.child("closed"), place.child("table"), place.child("progress"), **terms)
    stored = ingested_batches(spark, place.child("table"))
    good = F.col("reason").isNull()
    return stored.groupBy("batch").agg(
        F.count(F.when(good, 1)).alias("reports"),
        F.max(F.when(good, F.col("sequence"))).alias("highest"),
    ).withColumn("stopped", F.col("batch") == F.lit(ingest.batch if ingest.batch == again.batch else None))


# --- worker pools -------------------------------------------------------------------------------

# The live workers among the events, and the pools of their users.
_LIVE = """
    named AS (
        SELECT 'c' || user_id AS cluster_id, event_type,
               CASE WHEN event_id % 7 < 4 THEN 'worker-' || (event_id % 53)
                    WHEN event_id % 7 = 4 THEN 'workerX' || (event_id % 53)
                    WHEN event_id % 7 = 5 THEN 'scheduler' END AS name
        FROM events
    ),
    live AS (
        SELECT cluster_id, name FROM named
        WHERE event_type <> 'error' AND starts_with(name, 'worker')
    )
"""

_POOLS = """
    users AS (SELECT DISTINCT user_id FROM events),
    pools AS (
        SELECT prefix || user_id AS cluster_id, user_id % 9 AS desired, user_id % 3 AS min,
               CASE WHEN user_id % 4 <> 0 THEN user_id % 4 + 5 END AS max
        FROM (SELECT user_id, 'c' AS prefix FROM users
              UNION ALL SELECT user_id, 'idle' FROM users WHERE user_id % 2 = 0)
    )
"""


@query(f"WITH {_LIVE} SELECT DISTINCT cluster_id, name FROM live")
def live_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.live_names(tables.actor_records(spark, sf_dir))


@query(
    f"""
    WITH {_LIVE}, {_POOLS}
    SELECT p.cluster_id,
           coalesce(max(TRY_CAST(nullif(regexp_extract(name, '^worker-([0-9]+)$', 1), '')
                                 AS BIGINT)), -1) + 1 AS next_number
    FROM pools p LEFT JOIN live l ON p.cluster_id = l.cluster_id
    GROUP BY p.cluster_id
    """
)
def next_worker_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.next_worker_number(
        tables.pools(spark, sf_dir), tables.actor_records(spark, sf_dir)
    )


@query(
    f"""
    WITH {_LIVE}, {_POOLS}
    SELECT p.cluster_id, count(DISTINCT l.name) AS available, any_value(desired) AS desired,
           any_value(min) AS min, CAST(any_value(max) AS VARCHAR) AS max
    FROM pools p LEFT JOIN live l ON p.cluster_id = l.cluster_id
    GROUP BY p.cluster_id
    """
)
def scaling_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = pool.scaling_status(tables.pools(spark, sf_dir), tables.actor_records(spark, sf_dir))
    return status.select("cluster_id", "available", "desired", "min", _text("max"))


@query(
    """
    WITH log AS (
        SELECT CASE WHEN event_id % 3 = 0 THEN 'busy' ELSE 'c' || user_id END AS cluster_id,
               'worker-' || (event_id % 17) AS name, event_type <> 'error' AS live,
               date_trunc('hour', ts) AS ts, event_id
        FROM events
    ),
    spans AS (
        SELECT cluster_id, name, live, ts AS first,
               lead(ts) OVER (PARTITION BY cluster_id, name ORDER BY ts, event_id) AS after
        FROM log
    )
    SELECT r.event_id, r.cluster_id, count(s.name) AS available
    FROM (SELECT event_id, ts, cluster_id FROM log
          UNION ALL SELECT event_id, date_trunc('hour', ts), 'none' FROM events WHERE event_id % 50 = 0) r
    LEFT JOIN spans s ON r.cluster_id = s.cluster_id AND s.live AND s.first <= r.ts
                         AND (s.after IS NULL OR s.after > r.ts)
    GROUP BY ALL
    """
)
def pool_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many workers were live in each event's pool at its time; some ask about a pool that is not."""
    log = tables.actor_log(spark, sf_dir)
    idle = log.where(F.col("place") % 50 == 0).withColumn("cluster_id", F.lit("none"))
    asked = log.unionByName(idle).select(F.col("place").alias("event_id"), "cluster_id", "ts")
    return live_counts_at(asked, log).select("event_id", "cluster_id", "available")


@query(
    """
    SELECT event_id,
           CASE WHEN event_id % 11 IN (0, 9, 10) THEN CAST(user_id AS VARCHAR) END AS amount,
           CASE WHEN event_id % 11 NOT IN (0, 9, 10) THEN NULL
                WHEN user_id = 1 THEN 'worker-1'
                ELSE 'worker-' || user_id || ',worker-1' END AS workers_to_keep,
           CASE event_id % 11
               WHEN 1 THEN 'amount:greater_than_equal'
               WHEN 2 THEN 'amount:int_type'
               WHEN 3 THEN 'amount:int_type'
               WHEN 4 THEN 'amount:int_type,workers_to_delete:set_type'
               WHEN 5 THEN 'amount:missing'
               WHEN 6 THEN 'workers_to_keep:string_type'
               WHEN 7 THEN 'json_invalid'
               WHEN 8 THEN 'model_type'
               ELSE '' END AS reasons
    FROM events
    """
)
def scale_request_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = validate_requests(tables.request_bodies(spark, sf_dir))
    return requests.select(
        "event_id",
        _text("amount"),
        F.array_join("workers_to_keep", ",").alias("workers_to_keep"),
        F.array_join("reasons", ",").alias("reasons"),
    )


@query(
    """
    SELECT event_id AS snapshot_id, event_id % 10 AS amount, desired,
           desired <> event_id % 10 AS changed
    FROM (SELECT event_id, least(CASE WHEN event_id % 4 <> 0 THEN event_id % 5 + 1 END,
                                 greatest(event_id % 3, event_id % 10)) AS desired
          FROM events)
    """
)
def scale_request_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = clamp_requests(tables.scale_requests(spark, sf_dir))
    return requests.select("snapshot_id", "amount", "desired", "changed")


# The five rules of a change plan, over the pool at the moment of each event.
_PLANS = """
    pools AS (
        SELECT event_id, user_id,
               least(CASE WHEN event_id % 4 <> 0 THEN event_id % 5 + 1 END,
                     greatest(event_id % 3, event_id % 10)) AS desired,
               list_transform(range(least(event_id % 8, 7)), lambda i:
                   CASE WHEN i = 6 THEN 'workerX'
                        ELSE 'worker-' || ((event_id + i * 3) % 23) END) AS live,
               CASE WHEN event_id % 3 = 0
                    THEN ['worker-' || (event_id % 23), 'nope'] ELSE [] END AS del,
               CASE WHEN event_id % 5 < 2
                    THEN ['worker-' || ((event_id + 3) % 23), 'worker-' || (event_id % 23)]
                    ELSE [] END AS keep
        FROM events
    ),
    given AS (
        SELECT event_id, user_id, desired, live, len(live) AS available,
               list_filter(live, lambda n: list_contains(del, n)) AS d,
               list_filter(live, lambda n: list_contains(keep, n)) AS k,
               coalesce(list_max(list_transform(live, lambda n:
                   TRY_CAST(nullif(regexp_extract(n, '^worker-([0-9]+)$', 1), '') AS BIGINT))),
                   -1) + 1 AS next_number
        FROM pools
    ),
    plans AS (
        SELECT event_id, user_id, desired, available,
               CASE WHEN available < desired THEN next_number END AS add_first,
               greatest(desired - available, 0) AS add_count,
               CASE WHEN available <= desired THEN []
                    WHEN desired = 0 THEN list_sort(live)
                    WHEN len(d) = 0 AND len(k) = 0
                    THEN list_sort(live)[1:available - desired]
                    ELSE list_sort(list_filter(live, lambda n: list_contains(d, n)
                             OR (len(k) > 0 AND NOT list_contains(k, n)))) END AS removed
        FROM given
    )
"""


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = tables.scale_requests(spark, sf_dir)
    snapshots = tables.pool_snapshots(spark, sf_dir)
    return plan_changes(requests.join(snapshots, ["cluster_id", "snapshot_id"], "left"))


@query(
    f"""
    WITH {_PLANS}
    SELECT user_id AS cluster_id, event_id AS snapshot_id, desired, available,
           CAST(add_first AS VARCHAR) AS add_first, add_count, array_to_string(removed, ',') AS removed,
           available + add_count - len(removed) AS planned_size
    FROM plans
    """
)
def scale_request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir).select(
        "cluster_id",
        "snapshot_id",
        "desired",
        "available",
        _text("add_first"),
        "add_count",
        F.array_join("remove", ",").alias("removed"),
        "planned_size",
    )


@query(
    f"""
    WITH {_PLANS}
    SELECT event_id AS snapshot_id, 'worker-' || unnest(range(add_first, add_first + add_count))
           AS name
    FROM plans WHERE add_count > 0
    """
)
def scale_request_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return added_names(_plans(spark, sf_dir), "snapshot_id")


@query(
    f"""
    WITH {_PLANS}
    SELECT event_id AS request, desired, available, CAST(add_first AS VARCHAR) AS add_first, add_count,
           len(removed) AS remove_count, available + add_count - len(removed) AS planned_size
    FROM plans
    UNION ALL
    SELECT -1, 10, count(*), CASE WHEN count(*) < 10 THEN CAST(max(event_id) + 1 AS VARCHAR) END,
           greatest(10 - count(*), 0), greatest(count(*) - 10, 0), 10
    FROM events
    """
)
def pool_change_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans for pools whose names are rows; one pool has as many as there are events."""
    plans = plan_pool_changes(*tables.pools_of_requests(spark, sf_dir)).plans
    return plans.select(
        "request", "desired", "available", _text("add_first"), "add_count", "remove_count", "planned_size"
    )


@query(
    f"""
    WITH {_PLANS}
    SELECT event_id AS request, unnest(removed) AS name FROM plans
    UNION ALL
    SELECT -1, name FROM (
        SELECT 'worker-' || event_id AS name, count(*) OVER () AS names,
               row_number() OVER (ORDER BY 'worker-' || event_id) AS place
        FROM events
    ) WHERE place <= names - 10
    """
)
def pool_change_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names to remove, of the large pool the first in sorted order."""
    return plan_pool_changes(*tables.pools_of_requests(spark, sf_dir)).removals


# --- paths --------------------------------------------------------------------------------------


@query(
    r"""
    WITH found AS (
        SELECT regexp_extract(url, '^[a-z]+:/(/[^?#]*)', 1) AS bare FROM pages
    ),
    paths AS (
        SELECT regexp_replace(bare, '/+$', '') AS path FROM found
        UNION
        SELECT '/' || split_part(bare, '/', 2) FROM found WHERE ends_with(bare, '/')
    )
    SELECT path, CAST(len(string_split(path, '/')) AS INTEGER) AS depth
    FROM paths p
    WHERE NOT EXISTS (SELECT 1 FROM paths q WHERE starts_with(p.path, q.path || '/'))
    """
)
def path_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering_paths(tables.page_paths(spark, sf_dir))
