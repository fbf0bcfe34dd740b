"""Running a stream over what is there."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Later than any row: the time of the mark that ends an input.
END = datetime(2200, 1, 1)


#: Shuffle files go with the job or batch that made them, not when the driver's JVM next collects its garbage.
RELEASE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Versions of the state, and entries of the logs, that a restart can go back to.
VERSIONS = 2


def milliseconds(interval: str) -> int:
    """Length of an interval such as ``7 days``."""
    return int(pd.Timedelta(interval) / pd.Timedelta("1ms"))


def mark_end(spark: SparkSession, schema: T.StructType, path: str, clock: str) -> None:
    """Adds the mark that ends a stream's input: a row with nothing but a time later than all.

    The watermark follows it, so that everything still open is closed; rows that come after
    it are late.
    """
    fields = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    spark.createDataFrame([tuple(END if f.name == clock else None for f in fields)], fields).write.mode("append").parquet(path)


def before_end(df: DataFrame, clock: str) -> DataFrame:
    """Rows of a watermarked stream without the mark.

    The condition names the clock, so Spark keeps it above the watermark, which has to see the mark.
    """
    return df.where(F.col(clock) < F.lit(END))


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for a while."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def drain(
    spark: SparkSession, stream: DataFrame, path: str, mode: str = "append", partitions: int | None = None, compact: bool = False
) -> DataFrame:
    """Process all available input into ``path`` and return what was written.

    Progress and state live under ``path`` too, in the shared folder, so a restart
    after a lost executor or driver goes on where it stopped. The number of state
    partitions is fixed at the first start; by default one per core of the cluster.
    Disk holds one batch's shuffle files and the last versions of the state, however many
    batches there are; with ``compact``, for state that each batch writes anew, without the
    values that were replaced, which else wait to be dropped a few batches at a time.
    In ``update`` mode each batch writes its own folder, so a repeated batch replaces
    its output.
    """
    wanted = RELEASE | {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.minBatchesToRetain": str(VERSIONS),
        "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
        "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism),
    }
    if compact:
        wanted["spark.sql.streaming.stateStore.rocksdb.compactOnCommit"] = "true"
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{path}/out")
    else:

        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

        writer = writer.foreachBatch(write)
    with settings(spark, wanted):
        query = writer.outputMode(mode).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)
