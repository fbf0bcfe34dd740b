"""File transfers: manifests, chunk plans, progress and reconciliation.

``manifest(transfer_id, path, size)`` is unique per ``(transfer_id, path)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentlake.functions.numbers import padding, rate_gbps
from agentlake.operators import scans

# Fixed value: bytes per chunk.
CHUNK_SIZE = 64 * 1024 * 1024


def traversal_order(manifest: DataFrame) -> DataFrame:
    """Depth-first order: siblings by name, files and directories mixed.

    Compares paths part by part, so ``a/b`` comes before ``a.b``. A range-partitioned
    sort; ``sort_key`` orders the same way as plain text.
    """
    return manifest.withColumn("sort_key", sort_key(F.col("path"))).orderBy("transfer_id", "sort_key")


def sort_key(path: Column) -> Column:
    """Text that orders paths part by part."""
    return F.array_join(F.split(path, "/"), "\x01")


def manifest_order(manifest: DataFrame, keys: Sequence[str] = ("transfer_id",)) -> DataFrame:
    """A manifest with ``ord``, each file's 0-based position in its transfer's depth-first order."""
    return scans.dense_order(manifest.withColumn("_key", sort_key(F.col("path"))), "_key", "ord", keys).drop("_key")


def chunk_plan(manifest: DataFrame, chunk: int = CHUNK_SIZE) -> DataFrame:
    """One row per chunk with offset, actual and padded size, then an end marker.

    The marker closes every file and is all an empty file has.
    """
    chunks = F.ceil(F.col("size") / chunk).cast("bigint")
    rows = manifest.withColumn("_n", chunks).withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n"))))
    end = F.col("chunk_no") == F.col("_n")
    offset = F.col("chunk_no") * F.lit(chunk)
    actual = F.when(end, F.lit(0)).otherwise(F.least(F.lit(chunk), F.col("size") - offset)).cast("bigint")
    return (
        rows.withColumn("is_end", end)
        .withColumn("offset", F.when(end, F.col("size")).otherwise(offset).cast("bigint"))
        .withColumn("actual_size", actual)
        .withColumn("padded_size", F.col("actual_size") + padding(F.col("actual_size")))
        .drop("_n", "size")
    )


def transfer_progress(chunks: DataFrame, block: int = scans.BLOCK, parts: int | None = None) -> DataFrame:
    """Bytes and rate so far after each data chunk.

    ``chunks(transfer_id, path, chunk_no, actual_size, start_ts, ts)``; time runs from
    the file's start, so the first chunk is timed too. ``parts`` as in ``scans.running``.
    """
    keys = ["transfer_id", "path"]
    data = chunks.where(F.col("actual_size") > 0)
    done = scans.running(data, keys, "chunk_no", "actual_size", "sent", block=block, parts=parts)
    elapsed = F.col("ts").cast("double") - F.col("start_ts").cast("double")
    return done.withColumn("elapsed", elapsed).withColumn("gbps", rate_gbps(F.col("sent"), F.col("elapsed")))


def reconcile_manifests(sent: DataFrame, received: DataFrame) -> DataFrame:
    """Every path of either side with a status: ok, missing, extra or size_mismatch."""
    keys = ["transfer_id", "path"]
    both = sent.select(*keys, F.col("size").alias("expected")).join(
        received.select(*keys, F.col("size").alias("received")), keys, "full_outer"
    )
    status = (
        F.when(F.col("received").isNull(), "missing")
        .when(F.col("expected").isNull(), "extra")
        .when(F.col("expected") != F.col("received"), "size_mismatch")
        .otherwise("ok")
    )
    return both.withColumn("status", status)


def manifest_totals(chunks: DataFrame) -> DataFrame:
    """Files, bytes, elapsed time and average rate per transfer."""
    started, ended = F.min("start_ts").cast("double"), F.max("ts").cast("double")
    totals = (
        chunks.groupBy("transfer_id", "path")
        .agg(F.sum("actual_size").alias("bytes"), F.min("start_ts").alias("start_ts"), F.max("ts").alias("ts"))
        .groupBy("transfer_id")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum("bytes").cast("bigint").alias("bytes"),
            (ended - started).alias("elapsed"),
        )
    )
    return totals.withColumn("gbps", rate_gbps(F.col("bytes"), F.col("elapsed")))


def attach_host(requests: DataFrame, hosts: DataFrame, columns: Sequence[str] = ("source", "dest")) -> DataFrame:
    """Rank and IP of the named hosts, NULL for unknown ones.

    ``hosts(host, rank, ip)``; whether it is broadcast is left to its measured size.
    """
    out = requests
    for column in columns:
        named = hosts.select(
            F.col("host").alias(column), F.col("rank").alias(f"{column}_rank"), F.col("ip").alias(f"{column}_ip")
        )
        out = out.join(named, column, "left")
    return out


def check_requests(requests: DataFrame, hosts: DataFrame) -> DataFrame:
    """Requests with ``error``: the first rule broken, NULL for a sound request."""
    joined = attach_host(requests, hosts)
    error = (
        F.when(F.col("source_rank").isNull(), F.concat(F.lit("Unknown local host '"), F.coalesce("source", F.lit("")), F.lit("'")))
        .when(F.col("dest_rank").isNull(), F.concat(F.lit("Unknown dest node '"), F.coalesce("dest", F.lit("")), F.lit("'")))
        .when(F.col("source_rank") == F.col("dest_rank"), F.lit("Source and destination are the same node"))
    )
    return joined.withColumn("error", error)


def write_requests(checked: DataFrame, path: str) -> None:
    """Sound requests and rejected ones into a table each below ``path``, in one pass.

    ``checked`` is ``check_requests``; the rejected table has the first rule broken as ``error``.
    """
    checked.withColumn("verdict", F.when(F.col("error").isNull(), "accepted").otherwise("rejected")).write.partitionBy("verdict").parquet(path)


def read_requests(spark: SparkSession, path: str, schema: T.StructType, verdict: str) -> DataFrame:
    """The ``accepted`` or the ``rejected`` requests, of which there may be none.

    ``schema`` is that of the checked requests; accepted ones come without ``error``.
    """
    both = spark.read.schema(T.StructType([*schema.fields, T.StructField("verdict", T.StringType())])).parquet(path)
    found = both.where(F.col("verdict") == verdict).drop("verdict")
    return found.drop("error") if verdict == "accepted" else found


def capacity_check(requests: DataFrame, volumes: DataFrame) -> DataFrame:
    """Requests with ``fits``: false only if more is needed than known to be free."""
    joined = requests.join(volumes, "node", "left")
    return joined.withColumn("fits", F.coalesce(F.col("needed_kb") <= F.col("available_kb"), F.lit(True)))
