"""Streams that read all there is and stop: their folders, their runs, and what they leave in their state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Keyed state with timers wants a state store that keeps it outside the heap."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def stretches(rows: DataFrame, at: str, slices: int) -> Iterator[DataFrame]:
    """Rows as ``slices`` stretches of equal time, one after the other."""
    least, most = rows.selectExpr(f"min({at})", f"max({at})").first()
    if least is None:
        yield rows
        return
    step = (most - least) / slices
    for k in range(slices):
        some = rows.where(rows[at] >= least + k * step) if k else rows
        yield some.where(some[at] < least + (k + 1) * step) if k + 1 < slices else some


def in_slices(rows: DataFrame, at: str, slices: int, folder: str) -> None:
    """Writes the stretches of small tables, one file each: a stream over the folder reads them in order."""
    for some in stretches(rows, at, slices):
        some.coalesce(1).write.mode("append").parquet(folder)


def finished(spark: SparkSession, source: str, schema: str, of: Callable[[DataFrame], DataFrame], folder: str, files: int | None = 1) -> DataFrame:
    """All rows that a stream over the files of ``source`` gives, by as many micro-batches as it needs, of ``files`` files each (None: all there are).

    Offsets and state are in ``folder``/state, rows in ``folder``/out; run again over a source with more files, it goes on from
    there.
    """
    with rocksdb(spark):
        read = spark.readStream.schema(schema)
        read = read if files is None else read.option("maxFilesPerTrigger", files)
        stream = of(read.parquet(source))
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def one_by_one(spark: SparkSession, parts: Iterable[DataFrame], schema: str, of: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """All rows that a stream over ``parts`` gives: each comes to a run of its own, in as many files as tasks have written it."""
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/rows")
        out = finished(spark, f"{folder}/rows", schema, of, folder, None)
    return out


def state_of(spark: SparkSession, folder: str, variable: str) -> DataFrame:
    """What the stream's last run left in one of its state variables."""
    return spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", variable).load()
