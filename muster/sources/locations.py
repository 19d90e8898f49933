"""Storage locations and the policy on local disks.

A location is a URI with an explicit scheme plus the options of its file system. Options go to
the reader or writer, which merges them into the Hadoop configuration of that one operation, so
credentials never become session-wide state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.types import StructType

# The URI schemes each kind of object store is addressed by.
_SCHEMES = {
    "abs": ("abfs", "abfss", "wasb", "wasbs"),
    "gcs": ("gs",),
    "s3": ("s3", "s3a", "s3n"),
}

# Object-store option names and the Hadoop setting each one stands for.
_HADOOP_NAMES = {
    "s3": {
        "aws_access_key_id": "fs.s3a.access.key",
        "aws_secret_access_key": "fs.s3a.secret.key",
        "aws_session_token": "fs.s3a.session.token",
        "aws_endpoint_url": "fs.s3a.endpoint",
        "aws_region": "fs.s3a.endpoint.region",
    },
    "gcs": {"google_service_account_path": "fs.gs.auth.service.account.json.keyfile"},
    "abs": {"azure_storage_account_key": "fs.azure.account.key"},
}

_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(/.*)", re.DOTALL)
_RESERVED_OPTIONS = {"path", "paths"}
_GLOB = re.compile(r"[\\{}\[\]*?]")


@dataclass(frozen=True)
class Location:
    """A place files are read from or written to.

    Build one with `s3`, `gcs`, `abs`, `local`, `shared_filesystem` or `from_config`. A plain
    `Location(uri)` serves any other Hadoop file system; its URI needs a scheme.
    """

    uri: str
    options: Mapping[str, str] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        if _URI.fullmatch(self.uri) is None:
            raise ValueError(f"a location needs a URI with a scheme and a path, got {self.uri!r}")
        clash = _RESERVED_OPTIONS & {name.lower() for name in self.options}
        if clash:
            raise ValueError(f"options may not redirect the location: {sorted(clash)}")

    @property
    def scheme(self) -> str:
        return _URI.fullmatch(self.uri)[1].lower()

    @property
    def is_local(self) -> bool:
        """Whether the files lie on a disk or mount of the machines themselves."""
        return self.scheme == "file"

    def child(self, *names: str) -> Location:
        return Location("/".join((self.uri.rstrip("/"), *names)), self.options)

    @classmethod
    def s3(cls, url: str, options: Mapping[str, str] | None = None) -> Location:
        location = cls._object_store("s3", url, options)
        return cls("s3a:" + location.uri.partition(":")[2], location.options)

    @classmethod
    def gcs(cls, url: str, options: Mapping[str, str] | None = None) -> Location:
        return cls._object_store("gcs", url, options)

    @classmethod
    def abs(cls, url: str, options: Mapping[str, str] | None = None) -> Location:
        return cls._object_store("abs", url, options)

    @classmethod
    def local(cls, path: str) -> Location:
        """An absolute path on the local disk."""
        if not path.startswith("/"):
            raise ValueError(f"a local path must be absolute, got {path!r}")
        return cls("file:" + path)

    @classmethod
    def shared_filesystem(cls, path: str) -> Location:
        """An absolute path mounted at the same place on every node; local to the policy."""
        return cls.local(path)

    @classmethod
    def from_config(cls, config: Mapping[str, object]) -> Location:
        """Build a location from a mapping tagged by `storage_type`.

        Settings about presigned URLs and delete requests have no meaning for Spark's file
        systems and are ignored.
        """
        kind = config.get("storage_type")
        if kind in ("local", "shared_filesystem"):
            return cls.local(str(config["path"]))
        if kind not in _SCHEMES:
            raise ValueError(f"unknown storage type {kind!r}")
        options = dict(config.get("options") or {})
        endpoint = config.get("external_endpoint")
        if kind == "s3" and endpoint is not None:
            options["fs.s3a.endpoint"] = str(endpoint)
        return {"s3": cls.s3, "gcs": cls.gcs, "abs": cls.abs}[kind](str(config["url"]), options)

    @classmethod
    def _object_store(cls, kind: str, url: str, options: Mapping[str, str] | None) -> Location:
        location = cls(url)
        if location.scheme not in _SCHEMES[kind]:
            raise ValueError(f"{kind} locations use {_SCHEMES[kind]}, got {url!r}")
        return cls(url, _hadoop_options(kind, url, options or {}))


def _hadoop_options(kind: str, url: str, options: Mapping[str, str]) -> dict[str, str]:
    renamed = {}
    for name, value in options.items():
        if name.startswith("fs."):
            renamed[name] = value
        elif name in _HADOOP_NAMES[kind]:
            setting = _HADOOP_NAMES[kind][name]
            if kind == "abs":  # account keys are set per storage host
                host = url.partition("://")[2].partition("/")[0].rpartition("@")[2]
                setting = f"{setting}.{host}"
            renamed[setting] = value
        else:
            raise ValueError(f"unknown {kind} option {name!r}; use its fs.* setting")
    return renamed


@dataclass(frozen=True)
class AccessPolicy:
    """Whether local disks may be read and written.

    Every file below a location belongs to the location's file system, so its scheme decides and
    no file has to be listed to check a location. Frames that were not read through `scan` are
    checked by the root paths in their plan, cached frames, subqueries and streams of files too. Frames
    of an RDD or a checkpoint have no paths in their plan and pass.
    """

    allow_local_scans: bool = True
    allow_local_sinks: bool = True

    def check_scan(self, location: Location) -> None:
        if location.is_local and not self.allow_local_scans:
            raise PermissionError(f"local scans are disabled: {location.uri}")

    def check_frame(self, df: DataFrame) -> None:
        if self.allow_local_scans:
            return
        local = next((path for path in _root_paths(df) if path.startswith("file:")), None)
        if local is not None:
            raise PermissionError(f"local scans are disabled: {local}")

    def check_sink(self, location: Location) -> None:
        if location.is_local and not self.allow_local_sinks:
            raise PermissionError(f"local sinks are disabled: {location.uri}")


def _root_paths(df: DataFrame) -> Iterator[str]:
    """Where the files that a frame's plan reads begin, those of its subqueries and streams too."""
    conf = df.sparkSession._jsc.hadoopConfiguration()
    top = df._jdf.queryExecution().analyzed()
    plans = [top, *_items(top.subqueriesAll())]
    for leaf in (leaf for plan in plans for leaf in _items(plan.collectLeaves())):
        for path in _paths_of(leaf, df.sparkSession._jvm.org.apache.hadoop.fs.Path):
            yield path.getFileSystem(conf).makeQualified(path).toString()


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _paths_of(leaf, to_path) -> list:
    """Root paths of a plan's leaf: a relation of files, of a table's location, or a stream of files."""
    kind = leaf.getClass().getSimpleName()
    if kind == "LogicalRelation":
        relation = leaf.relation()
        if relation.getClass().getSimpleName() == "HadoopFsRelation":
            return _items(relation.location().rootPaths())
    elif kind == "DataSourceV2Relation":
        table = leaf.table()
        if any(m.getName() == "fileIndex" for m in table.getClass().getMethods()):
            return _items(table.fileIndex().rootPaths())
    elif kind == "HiveTableRelation":
        return [to_path(leaf.tableMeta().location())]
    elif kind == "StreamingRelation":
        source = leaf.dataSource()
        named = source.options().get("path")
        return [to_path(p) for p in [*_items(source.paths()), *([named.get()] if named.isDefined() else [])]]
    return []


OPEN_POLICY = AccessPolicy()


_Reader = TypeVar("_Reader", DataFrameReader, DataStreamReader)


def _prepared(
    reader: _Reader,
    location: Location,
    format: str,
    schema: StructType | str | None,
    options: Mapping[str, object] | None,
) -> _Reader:
    _check_options(options)
    reader = reader.format(format).options(**{**(options or {}), **location.options})
    return reader if schema is None else reader.schema(schema)


def _check_options(options: Mapping[str, object] | None) -> None:
    clash = _RESERVED_OPTIONS & {name.lower() for name in options or {}}
    if clash:
        raise ValueError(f"options may not redirect the location: {sorted(clash)}")


def _literal(uri: str) -> str:
    """A URI that readers, who take paths as patterns, match with itself alone."""
    return _GLOB.sub(r"\\\g<0>", uri)


def scan(
    spark: SparkSession,
    location: Location,
    format: str = "parquet",
    schema: StructType | str | None = None,
    options: Mapping[str, object] | None = None,
    policy: AccessPolicy = OPEN_POLICY,
) -> DataFrame:
    """Read the files of a location. Its path is taken as it is, not as a pattern."""
    policy.check_scan(location)
    return _prepared(spark.read, location, format, schema, options).load(_literal(location.uri))


def scan_stream(
    spark: SparkSession,
    location: Location,
    format: str = "parquet",
    schema: StructType | str | None = None,
    options: Mapping[str, object] | None = None,
    policy: AccessPolicy = OPEN_POLICY,
) -> DataFrame:
    """Read the files of a location, and those added later, as a stream."""
    policy.check_scan(location)
    return _prepared(spark.readStream, location, format, schema, options).load(location.uri)


def sink(
    df: DataFrame,
    location: Location,
    format: str = "parquet",
    mode: str = "errorifexists",
    options: Mapping[str, object] | None = None,
    policy: AccessPolicy = OPEN_POLICY,
) -> None:
    """Write a frame to a location."""
    policy.check_sink(location)
    _check_options(options)
    writer = df.write.format(format).mode(mode).options(**{**(options or {}), **location.options})
    writer.save(location.uri)
