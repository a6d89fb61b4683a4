"""Small helpers that every training-data operator uses: shared folders, staged tables, hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``.

    Where a session on one machine (tests) names none, a temporary folder of this process is set once. A
    cluster's other machines could not read such a folder, so there a missing setting is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Has Spark delete the shuffle files of each write or action as it ends; else they stay until the driver collects its old garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def staged(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the jobs before. Also fixes the
    rows, so that a plan that reads the table twice sees the same ones. ``drop_shuffles`` deletes what
    the write has shuffled as soon as it ends.
    """
    path = f"{shared_dir(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(df.sparkSession) if drop_shuffles else contextlib.nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    _goes_with_the_session(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _goes_with_the_session(spark: SparkSession, path: str) -> None:
    """Has the file system delete a folder when the driver ends; until then every table read from it stands."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``staged``, in buckets by a column: grouping or joining the table by it later moves none of its rows."""
    spark = df.sparkSession
    unique = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tidemark/{unique}"
    df.write.option("path", path).option("compression", "zstd").format("parquet").bucketBy(shuffle_width(spark), key).saveAsTable(f"tidemark_{unique}")
    _goes_with_the_session(spark, path)
    return spark.table(f"tidemark_{unique}")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Returns the memory that this Python worker has freed to the machine: workers outlive tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def crc_of_id(doc_id: Column) -> Column:
    """Unsigned crc32 of the id's decimal text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key from two, order-sensitive (a multiply-xorshift finaliser over their sum)."""
    with np.errstate(over="ignore"):
        z = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD1B54A32D192ED03))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array, lowest bytes first: the high ones, mostly zero, stand together and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()
