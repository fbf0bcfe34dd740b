"""What the operators of this subpackage share: tables, written intermediate tables, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back.

    Cuts the lineage: a lost executor costs the tasks that ran on it, not the plan before.
    The driver lets go of what the plan before left behind, so its memory does not grow with
    the number of tables that an operator writes.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    settle(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of text that one step of a Python task holds as Python or numpy objects.
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts hold at most ``most`` bytes (one row at least).

    Nulls in ``column`` become empty strings. Python workers live on from task to task, so
    memory that the task before has freed is given back first, and this task's at its end.
    """
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        texts = batch.column(at).fill_null("")
        batch = batch.set_column(at, column, texts)
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(ends, ends[row] + most, side="right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop
    batch = texts = ends = None
    give_back()


def give_back() -> None:
    """Returns memory that is free, but held by the allocators, to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim:
        trim(0)


#: Bytes of an Arrow batch on its way to a Python task.
ARROW_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as by rows, unless the session says how: long texts come by the thousand."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ARROW_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores behind it as no column of ``df`` has, letter case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(names: list[str]) -> Column:
    """Columns as one struct, so that a task can carry them whatever their names; one null field if there are none."""
    return F.struct(*[F.col(f"`{n}`") for n in names]) if names else F.struct(F.lit(None).cast("int").alias("none"))


def settle(spark: SparkSession) -> None:
    """Lets the driver drop what earlier jobs left behind, between the parts of a long operator.

    Spark removes the shuffle files and broadcasts of finished jobs when the driver's JVM
    collects its references to them, which by itself happens every half hour only.
    """
    give_back()
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None:
        jvm.java.lang.System.gc()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column, and the offsets of its rows in them."""
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def list_array(flat, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its values and the cumulated lengths."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    values = flat if isinstance(flat, pa.Array) else pa.array(flat, kind)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[0] .. starts[0]+lengths[0]-1, starts[1] ..`` as one index array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


#: Bits of the largest filter, which bound its size whatever the number of keys.
FILTER_BITS = 1 << 26
#: Share of a filter's bits that may be set, if a larger one can avoid it: what passes by chance.
FILTER_SHARE = 1 / 64


def bit_filter(df: DataFrame, key: str) -> np.ndarray:
    """A bitmap that lets all values of a BIGINT column through, and others by chance only.

    Its size is a power of two that follows the number of keys, up to ``FILTER_BITS``. The
    more keys beyond that, the more chance; what it lets through has to be joined exactly
    later, so it only saves work.
    """
    at = df.selectExpr(f"pmod(`{key}`, {FILTER_BITS}L) AS at")
    words = at.selectExpr("at div 32 AS word", "shiftleft(1L, CAST(at % 32 AS INT)) AS bits")
    got = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    # The upper half laid on the lower one is the filter of half the size.
    while len(out) > 32 and int(np.bitwise_count(out).sum()) <= FILTER_SHARE / 2 * 32 * len(out):
        out = out[: len(out) // 2] | out[len(out) // 2 :]
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys % (32 * len(bits))
    return (bits[at // 32] >> (at % 32).astype(np.uint32)) & 1 > 0
