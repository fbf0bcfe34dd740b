"""Transfer progress over a stream of chunk rows."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.functions.numbers import rate_gbps
from agentlake.streaming.buckets import BucketProcessor, bucket, columns
from agentlake.streaming.run import before_end, milliseconds

_KEYS = ["transfer_id", "path", "start_ts"]
_PART = "transfer_id bigint, path string, start_ts timestamp, ts timestamp, chunks bigint, bytes bigint, end_no bigint"
_CLOSED = "transfer_id bigint, path string, start_us bigint, chunks bigint, bytes bigint, ended double"


def _combined(batches):
    """Chunk rows of a batch added up per file, so a file with most of the rows costs no more than others."""
    for batch in batches:
        data = pc.greater(batch.column("actual_size"), 0)
        rows = pa.table({
            **{k: batch.column(k) for k in _KEYS}, "ts": batch.column("ts"), "bytes": batch.column("actual_size"),
            "chunks": pc.cast(data, pa.int64()), "end_no": pc.if_else(data, pa.scalar(None, pa.int64()), batch.column("chunk_no")),
        })
        sums = rows.group_by(_KEYS).aggregate([("ts", "max"), ("chunks", "sum"), ("bytes", "sum"), ("end_no", "max")])
        sums = sums.rename_columns([c.removesuffix("_max").removesuffix("_sum") for c in sums.column_names])
        yield from sums.select([c.split()[0] for c in _PART.split(", ")]).combine_chunks().to_batches()


class FileProcessor(BucketProcessor):
    """Adds up a file's chunks until it is complete, reports it once, and forgets it.

    A reported file leaves a mark, the time it is due alone, until the watermark has passed its last chunk; from then
    on Spark itself drops its rows as late. So rows that repeat never open it again, and
    nothing stays. A file that never completes is forgotten ``idle`` after its last chunk.
    """

    name, out = "file", [c.split()[0] for c in _CLOSED.split(", ")]

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def freeze(self, held):
        """Files in order, as columns: what is alike is compressed together."""
        rows = [(*key, *kept, *[None] * (5 - len(kept))) for key, kept in sorted(held.items(), key=lambda file: str(file[0]))]
        return list(map(list, zip(*rows)))  # noqa: B905

    def thaw(self, frozen):
        return {
            (transfer, path, start): [due] if chunks is None else [due, chunks, *sums]
            for transfer, path, start, due, chunks, *sums in zip(*frozen)  # noqa: B905
        }

    def take(self, held, pdf, timerValues):
        for *file, newest, n, size, mark in columns(pdf, ["transfer_id", "path", "start_us", "ts_us", "chunks", "bytes", "end_no"]):
            key = tuple(file)
            kept = held.get(key) or [None, 0, 0, None, None]
            if len(kept) == 1:
                kept[0] = max(kept[0], newest // 1000 + 1)
                continue
            _, chunks, total, last, end_no = kept
            last = newest if last is None else max(last, newest)
            if mark is not None:
                end_no = int(mark) if end_no is None else max(end_no, int(mark))
            held[key] = [last // 1000 + self.idle_ms, chunks + int(n), total + int(size), last, end_no]
        # Judged on all rows of the batch, so that what comes with the last chunk counts.
        for key in dict.fromkeys(columns(pdf, ["transfer_id", "path", "start_us"])):
            if len(held[key]) == 1:
                continue
            _, chunks, total, last, end_no = held[key]
            if end_no is not None and chunks >= end_no:
                held[key] = [last // 1000 + 1]
                yield (*key, chunks, total, last / 1e6)


def stream_transfer_progress(chunks: DataFrame, manifest: DataFrame, late: str = "1 hour", idle: str = "7 days") -> DataFrame:
    """One row per completed file: chunks, bytes, time, rate and whether the size is right. For append mode.

    ``chunks`` is a stream of ``(transfer_id, path, chunk_no, actual_size, start_ts,
    ts)`` in any order, up to ``late`` behind the newest ``ts``, with a zero-size row as end
    marker; ``manifest`` a static table of expected sizes. A chunk comes once; whatever
    comes after a file is complete is ignored.

    Chunk rows are combined before the shuffle, and the state holds, in buckets, the files that
    are open or were completed within ``late``.
    """
    slim = chunks.selectExpr("CAST(transfer_id AS BIGINT) AS transfer_id", "path", "start_ts", "ts", "CAST(chunk_no AS BIGINT) AS chunk_no", "CAST(actual_size AS BIGINT) AS actual_size")
    parts = before_end(slim.mapInArrow(_combined, _PART).withWatermark("ts", late), "ts")
    times = F.unix_micros("start_ts").alias("start_us"), F.unix_micros("ts").alias("ts_us")
    files = parts.select(bucket(*_KEYS), "*", *times).drop("start_ts").groupBy("bucket")
    closed = files.transformWithStateInPandas(FileProcessor(milliseconds(idle)), _CLOSED, "append", "EventTime")
    expected = manifest.select("transfer_id", "path", F.col("size").alias("expected"))
    elapsed = F.col("ended") - F.timestamp_micros("start_us").cast("double")
    return closed.join(expected, ["transfer_id", "path"], "left").select(
        "transfer_id",
        "path",
        "chunks",
        "bytes",
        elapsed.alias("elapsed"),
        "expected",
        rate_gbps(F.col("bytes"), elapsed).alias("gbps"),
        F.coalesce(F.col("bytes") == F.col("expected"), F.lit(False)).alias("size_ok"),
    )
