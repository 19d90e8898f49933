"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from muster.sources.locations import Location

_own_folder: str | None = None


def scratch_location(spark: SparkSession, purpose: str) -> Location:
    """A fresh folder below the shared one the cluster names in `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of this process, removed at exit:
    on a cluster other machines could neither see it nor outlive its owner.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _process_folder()
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    file_system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    qualified = file_system.makeQualified(path).toString()
    return Location(qualified).child(f"{purpose}-{uuid.uuid4().hex}")


def _process_folder() -> str:
    global _own_folder
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="muster-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder
