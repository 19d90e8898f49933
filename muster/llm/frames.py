"""What several operators share: reading tables, the share of rows held out, durable frames."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from muster.functions.columns import own_columns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str, parts: int, part: int) -> Column:
    """Whether crc32 of a key's text leaves this remainder; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def durable(df: DataFrame) -> DataFrame:
    """The frame, run once and kept as a checkpoint that outlives any executor.

    It goes to the folder the cluster names in `spark.checkpoint.dir`. Only a local session
    without one gets a folder of this process.
    """
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="muster-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def durable_step(df: DataFrame) -> DataFrame:
    """A durable frame for a loop that joins its own results.

    A checkpoint keeps the planner's guess of its size, which is a product over joins. From round
    to round such guesses become numbers of megabytes, and planning with them fills the driver.
    Read as a frame of its own, the checkpoint has the session's default size again.
    """
    kept, spark = durable(df)._jdf, df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(kept.toJavaRDD(), kept.schema()), spark)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles and checkpoints that no frame needs any more.

    Its cleaner goes by the driver's garbage collection, which comes seldom while a driver only plans,
    so shuffles of steps long kept as checkpoints stay on the executors' disks. Checkpoints go only
    where `spark.cleaner.referenceTracking.cleanCheckpoints` is set.
    """
    time.sleep(1.2)  # frames dropped in Python reach the JVM within a second
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name not in the frame, ignoring case."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def with_fields(df: DataFrame, packed: Column, *names: str) -> DataFrame:
    """The frame with the named fields of a struct as columns, replacing columns of these names.

    The struct is computed once: a one-element `explode` keeps the optimizer from repeating it
    for each field.
    """
    lowered = {name.lower() for name in names}
    held = free_name(df, "packed")
    kept = [c for c, name in zip(own_columns(df), df.columns, strict=True) if name.lower() not in lowered]
    return df.select(*kept, F.explode(F.array(packed)).alias(held)).select(
        *kept, *[F.col(held)[name].alias(name) for name in names]
    )


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row holds: texts and arrays by what is in them."""
    total = F.lit(16)
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, StringType | BinaryType):
            size = F.octet_length(column) + 8
        elif isinstance(field.dataType, ArrayType):
            each = 8 if not isinstance(field.dataType.elementType, StringType | BinaryType | StructType) else 48
            size = F.size(column) * each + 8
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(8))
    return total.cast("long")


def sent_if_small(df: DataFrame, most_bytes: int = 24 << 20) -> DataFrame:
    """A durable frame, marked for broadcast only if its rows were measured to have at most so many
    bytes (see `row_bytes`).

    A larger one is left as it is, for a join by shuffle.
    """
    held = df.agg(F.sum(row_bytes(df)).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(df) if held <= most_bytes else df


def give_back() -> None:
    """Give memory that is free in this process back to the machine.

    Python workers stay for later tasks, and several are kept for each core where a stage has more than one
    Python step, so what they hold on to after a task adds up.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def tidied(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives free memory back at the end of each task."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        give_back()

    return run


def over_texts(prepare: Callable[[], Callable[[pa.Array], list]], result: str) -> Callable[[Column], Column]:
    """A column function over texts: `prepare` is called once in a task and gives what turns an
    array of texts into results.

    Texts stay in the Arrow buffer they came in and are taken from it one at a time, so a task
    holds one batch, not its texts as Python strings as well.
    """
    kind = to_arrow_type(DataType.fromDDL(result))

    @F.arrow_udf(result)
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = prepare()
        for batch in batches:
            yield pa.array(work(batch), kind)
        del work
        give_back()

    return compute
