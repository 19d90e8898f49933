from __future__ import annotations

import pytest

from muster.operators.compare import same_rows
from muster.sources.locations import AccessPolicy, Location, scan, scan_stream, sink


def test_kinds():
    assert Location.s3("s3://bucket/a").uri == "s3a://bucket/a"
    assert Location.gcs("gs://bucket/a").uri == "gs://bucket/a"
    assert Location.abs("abfss://box@host/a").uri == "abfss://box@host/a"
    assert Location.local("/a/b").uri == "file:/a/b"
    assert Location.shared_filesystem("/mnt/x").is_local
    assert not Location.s3("s3a://bucket/a").is_local
    assert Location("hdfs://names/a").child("b", "c").uri == "hdfs://names/a/b/c"


@pytest.mark.parametrize("make", [Location.s3, Location.gcs, Location.abs])
@pytest.mark.parametrize("url", ["file:/etc/passwd", "/etc/passwd", "http://host/x"])
def test_object_stores_reject_other_schemes(make, url):
    with pytest.raises(ValueError):
        make(url)


@pytest.mark.parametrize("uri", ["a/b", "/a/b", "", "{s3a:/x,file:/y}"])
def test_a_scheme_is_needed(uri):
    with pytest.raises(ValueError):
        Location(uri)


def test_local_paths_are_absolute():
    with pytest.raises(ValueError):
        Location.local("a/b")


def test_options_become_file_system_settings():
    location = Location.s3(
        "s3://bucket/a",
        {"aws_access_key_id": "k", "aws_secret_access_key": "s", "fs.s3a.path.style.access": "true"},
    )
    assert location.options == {
        "fs.s3a.access.key": "k",
        "fs.s3a.secret.key": "s",
        "fs.s3a.path.style.access": "true",
    }
    azure = Location.abs("abfss://box@acc.dfs.core.windows.net/a", {"azure_storage_account_key": "k"})
    assert azure.options == {"fs.azure.account.key.acc.dfs.core.windows.net": "k"}
    with pytest.raises(ValueError):
        Location.gcs("gs://bucket/a", {"colour": "red"})


def test_secrets_are_not_shown():
    assert "topsecret" not in repr(Location.s3("s3://b/a", {"aws_secret_access_key": "topsecret"}))


def test_from_config():
    assert Location.from_config({"storage_type": "local", "path": "/a"}) == Location.local("/a")
    shared = {"storage_type": "shared_filesystem", "path": "/a"}
    assert Location.from_config(shared).is_local
    s3 = {
        "storage_type": "s3",
        "url": "s3://b/a",
        "options": {"aws_region": "r"},
        "external_endpoint": "http://store",
        "presign_duration": "PT5S",
    }
    assert Location.from_config(s3) == Location(
        "s3a://b/a", {"fs.s3a.endpoint.region": "r", "fs.s3a.endpoint": "http://store"}
    )
    gcs = {"storage_type": "gcs", "url": "gs://b/a", "allow_deletes": False}
    assert Location.from_config(gcs) == Location.gcs("gs://b/a")
    with pytest.raises(ValueError):
        Location.from_config({"storage_type": "ftp", "url": "ftp://x/y"})


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_written_rows_are_read_back(spark, tmp_path, format):
    df = spark.range(100).selectExpr("id", "cast(id as string) as s")
    place = Location.local(str(tmp_path)).child("t")
    sink(df, place, format)
    assert same_rows(df, scan(spark, place, format, df.schema))
    with pytest.raises(Exception, match="(?i)already exists"):
        sink(df, place, format)


def test_policy(spark, tmp_path):
    place = Location.local(str(tmp_path)).child("t")
    sink(spark.range(3), place, policy=AccessPolicy(allow_local_scans=False))
    closed = AccessPolicy(allow_local_scans=False, allow_local_sinks=False)
    for read in (scan, scan_stream):
        with pytest.raises(PermissionError):
            read(spark, place, policy=closed)
    with pytest.raises(PermissionError):
        sink(spark.range(3), place.child("u"), policy=closed)
    assert not (tmp_path / "t" / "u").exists()
    assert scan(spark, place, policy=AccessPolicy(allow_local_sinks=False)).count() == 3
    closed.check_scan(Location.s3("s3://bucket/a"))
    closed.check_sink(Location.gcs("gs://bucket/a"))


def test_options_cannot_redirect(spark, tmp_path):
    place = Location.local(str(tmp_path))
    for name in ("path", "PATHS"):
        with pytest.raises(ValueError):
            scan(spark, place, options={name: "file:/etc"})
        with pytest.raises(ValueError):
            sink(spark.range(1), place.child("x"), options={name: "file:/etc"})
        with pytest.raises(ValueError):
            Location("s3a://b/a", {name: "file:/etc"})


def test_cached_and_joined_frames_are_refused(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    frame = spark.read.parquet(f"{tmp_path}/t")
    policy = AccessPolicy(allow_local_scans=False)
    cached = frame.select("*").cache()
    for tried in (frame, cached, spark.range(2).join(frame, "id")):
        with pytest.raises(PermissionError):
            policy.check_frame(tried)
    policy.check_frame(spark.range(2))
    cached.unpersist()


@pytest.mark.parametrize("name", ["a*", "a?", "{a,b}", "[ab]"])
def test_paths_are_not_patterns(spark, tmp_path, name):
    root = Location.local(str(tmp_path))
    for other in ("ab", "a", "b"):
        sink(spark.range(5), root.child(other))
    sink(spark.range(3), root.child(name))
    assert scan(spark, root.child(name)).count() == 3


@pytest.mark.parametrize(
    "where",
    [
        "id IN (SELECT id FROM {t})",
        "EXISTS (SELECT 1 FROM {t} AS u WHERE u.id = ids.id)",
        "id > (SELECT min(id) FROM {t} WHERE id IN (SELECT 1))",
        "id IN (SELECT 1 WHERE 1 = (SELECT max(id) FROM {t}))",
    ],
)
def test_subqueries_are_refused(spark, tmp_path, where):
    place = Location.local(str(tmp_path / "t"))
    sink(spark.range(3), place)
    policy = AccessPolicy(allow_local_scans=False)
    text = f"SELECT id FROM {{ids}} AS ids WHERE {where}"
    with pytest.raises(PermissionError):
        policy.check_frame(spark.sql(text, ids=spark.range(9), t=spark.read.parquet(place.uri)))
    policy.check_frame(spark.sql(text, ids=spark.range(9), t=spark.range(3)))


def test_streams_and_second_version_scans_are_refused(spark, tmp_path, settings):
    place = Location.local(str(tmp_path / "t"))
    sink(spark.range(3), place)
    policy = AccessPolicy(allow_local_scans=False)
    with pytest.raises(PermissionError):
        policy.check_frame(spark.readStream.schema("id long").parquet(place.uri).where("id > 1"))
    policy.check_frame(spark.readStream.format("rate").load())
    settings(spark__sql__sources__useV1SourceList="")
    frame = spark.read.parquet(place.uri)
    assert frame._jdf.queryExecution().analyzed().getClass().getSimpleName() == "DataSourceV2Relation"
    with pytest.raises(PermissionError):
        policy.check_frame(frame.where("id > 1"))
