"""The given tables, and the ledgers, records and requests Spark derives from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.json import computed_once
from muster.sources.locations import Location


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_of(number: Column, values: list[str | None]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (number % len(values) + 1).cast("int"))


#: Params that make no report, by the reason.
MISTYPED = {
    "sequence_text": '"sequence":"3","clusters":[]',
    "sequence_fraction": '"sequence":1.9,"clusters":[]',
    "sequence_boolean": '"sequence":true,"clusters":[]',
    "sequence_missing": '"clusters":[]',
    "sequence_oversized": '"sequence":99999999999999999999,"clusters":[]',
    "sequence_nested": '"sequence":[3],"clusters":[]',
    "clusters_missing": '"sequence":3',
    "clusters_not_list": '"sequence":3,"clusters":7',
    "clusters_malformed": '"sequence":3,"clusters":[7,null,{}]',
}


def ledger_lines(spark: SparkSession, sf_dir: str, mistyped: bool = False) -> DataFrame:
    """One ledger line for each event: most are reports, some blank, cut short or without params,
    and some `mistyped` where asked for."""
    return numbered_ledger_lines(spark, sf_dir, mistyped).select("value")


def settle(spark: SparkSession, written: Location, folder: Location, name: str) -> None:
    """Give the one file of a written folder its name in another folder, as a ledger closes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(written.uri).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(folder.uri))
    parts = [f.getPath() for f in system.globStatus(path(f"{written.uri}/part-*"))]
    if len(parts) != 1 or not system.rename(parts[0], path(f"{folder.uri}/{name}")):
        raise OSError(f"not one file to settle in {written.uri}")


def numbered_ledger_lines(spark: SparkSession, sf_dir: str, mistyped: bool = False) -> DataFrame:
    """event_id and value, a ledger line."""
    event = F.col("event_id")
    stop = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    clusters = []
    for i in range(3):
        stopped_at = F.when((event + i) % 3 == 0, "null").otherwise(
            F.concat(F.lit('"'), stop, F.lit('"'))
        )
        cluster = F.concat(F.lit(f'{{"id":"c{i}","stopped_at":'), stopped_at, F.lit("}"))
        clusters.append(F.when(event % 4 > i, cluster))
    text = F.concat(
        F.lit('{"params":{"sequence":'),
        (event + 1).cast("string"),
        F.lit(',"clusters":['),
        F.concat_ws(",", *clusters),
        F.lit("]}}"),
    )
    report = F.col("report")
    events = table(spark, sf_dir, "events")
    return computed_once(events, text, "report").select(
        "event_id",
        F.when(event % 101 == 0, F.lit("   "))
        .when(event % 97 == 0, F.substr(report, F.lit(1), (F.length(report) / 2).cast("int")))
        .when(event % 89 == 0, _one_of(event, ['{"nope":1}', "[1]"]))
        .when(
            F.lit(mistyped) & (event % 83 == 0),
            _one_of(F.floor(event / 83), [f'{{"params":{{{odd}}}}}' for odd in MISTYPED.values()]),
        )
        .otherwise(report)
        .alias("value")
    )


def actor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One actor record for each event: the user's pool, a name by the event, a state by its type."""
    event = F.col("event_id")
    number = (event % 53).cast("string")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("cluster_id"),
        F.when(event % 7 < 4, F.concat(F.lit("worker-"), number))
        .when(event % 7 == 4, F.concat(F.lit("workerX"), number))
        .when(event % 7 == 5, F.lit("scheduler"))
        .alias("name"),
        F.when(F.col("event_type") == "error", F.lit("DEAD"))
        .when(F.col("event_type") == "signup", F.lit("RESTARTING"))
        .otherwise(F.lit("ALIVE"))
        .alias("state"),
        event.alias("pid"),
    )


def actor_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of states: each event tells one about a worker of its user's pool. A third of the
    events are about one pool."""
    event = F.col("event_id")
    pool = F.when(event % 3 == 0, F.lit("busy")).otherwise(F.concat(F.lit("c"), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select(
        pool.alias("cluster_id"),
        F.concat(F.lit("worker-"), (event % 17).cast("string")).alias("name"),
        F.when(F.col("event_type") == "error", F.lit("DEAD")).otherwise(F.lit("ALIVE")).alias("state"),
        F.date_trunc("hour", "ts").alias("ts"),
        event.alias("place"),
    )


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pool for each user, and an idle one without actors for every user with an even number."""
    user = F.col("user_id")
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    prefixes = F.when(user % 2 == 0, F.array(F.lit("c"), F.lit("idle"))).otherwise(
        F.array(F.lit("c"))
    )
    return users.select("user_id", F.explode(prefixes).alias("prefix")).select(
        F.concat("prefix", user.cast("string")).alias("cluster_id"),
        (user % 9).alias("desired"),
        (user % 3).alias("min"),
        F.when(user % 4 != 0, user % 4 + 5).alias("max"),
    )


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request body for each event, most kinds of them to be rejected."""
    event, user = F.col("event_id"), F.col("user_id").cast("string")
    fixed = {
        1: '{"amount":-1}',
        2: '{"amount":"3"}',
        3: '{"amount":1.0}',
        4: '{"amount":true,"workers_to_delete":"w"}',
        5: '{"workers_to_keep":[]}',
        6: '{"amount":2,"workers_to_keep":["a",null]}',
        7: '{"amount":2} {"amount":3}',
        8: "[1]",
    }
    body = F.concat(
        F.lit('{"amount":'), user, F.lit(',"workers_to_keep":["worker-'), user,
        F.lit('","worker-1","worker-'), user, F.lit('"],"x":{}}'),
    )
    for kind, text in fixed.items():
        body = F.when(event % 11 == kind, F.lit(text)).otherwise(body)
    return table(spark, sf_dir, "events").select("event_id", body.alias("body"))


def scale_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each event, with bounds and names to delete or keep."""
    event = F.col("event_id")

    def worker(number: Column) -> Column:
        return F.concat(F.lit("worker-"), number.cast("string"))

    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("cluster_id"),
        event.alias("snapshot_id"),
        (event % 10).alias("amount"),
        (event % 3).alias("min"),
        F.when(event % 4 != 0, event % 5 + 1).alias("max"),
        F.when(event % 3 == 0, F.array(worker(event % 23), F.lit("nope"))).alias(
            "workers_to_delete"
        ),
        F.when(event % 5 < 2, F.array(worker((event + 3) % 23), worker(event % 23))).alias(
            "workers_to_keep"
        ),
    )


def pool_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live names at the moment of each request; an empty pool has no snapshot."""
    event = F.col("event_id")
    workers = [
        F.concat(F.lit("worker-"), ((event + i * 3) % 23).cast("string")) for i in range(6)
    ]
    count = F.least(event % 8, F.lit(7)).cast("int")
    names = F.slice(F.array(*workers, F.lit("workerX")), F.lit(1), count)
    return (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("cluster_id"),
            event.alias("snapshot_id"),
            names.alias("live"),
        )
        .where(F.size("live") > 0)
    )


def pools_of_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests, the names of their pools and the names they give, as rows. Request -1 is about one
    pool that has a worker for every event."""
    number = F.col("event_id").cast("string")
    worker = F.concat(F.lit("worker-"), number).alias("name")
    asked = scale_requests(spark, sf_dir)
    one = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("request"), F.lit(10).cast("bigint").alias("amount"),
        F.lit(0).cast("bigint").alias("min"), F.lit(None).cast("bigint").alias("max"),
    )
    requests = asked.select(F.col("snapshot_id").alias("request"), "amount", "min", "max").unionByName(one)
    live = pool_snapshots(spark, sf_dir).select(
        F.col("snapshot_id").alias("request"), F.explode("live").alias("name")
    )
    crowd = table(spark, sf_dir, "events").select(F.lit(-1).cast("bigint").alias("request"), worker)
    wishes = F.explode(
        F.concat(
            F.transform(F.coalesce("workers_to_delete", F.array()), lambda n: F.struct(n.alias("name"), F.lit("delete").alias("wish"))),
            F.transform(F.coalesce("workers_to_keep", F.array()), lambda n: F.struct(n.alias("name"), F.lit("keep").alias("wish"))),
        )
    )
    given = asked.select(F.col("snapshot_id").alias("request"), wishes.alias("w")).select("request", "w.name", "w.wish")
    return requests, live.unionByName(crowd), given


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and path of every page's address; one closed by a slash also gives its host alone."""
    bare = F.regexp_extract("url", "^[a-z]+:/(/[^?#]*)", 1)
    path = F.regexp_replace("bare", "/+$", "")
    paths = F.when(
        F.col("bare").endswith("/"), F.array(path, F.substring_index("bare", "/", 2))
    ).otherwise(F.array(path))
    found = table(spark, sf_dir, "pages").select(bare.alias("bare"))
    return found.select(F.explode(paths).alias("path"))
