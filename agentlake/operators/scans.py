"""Running values over ordered groups of any length, without one task per group.

A plain window puts a whole group (or, unpartitioned, the whole table) in one task.
Here every group is cut into blocks of ``block`` consecutive order values, so a block
holds at most that many rows because the order value is a unique integer within its
group. Each block is scanned on its own; what precedes it comes from the same scan over
the table of block totals, one level up.

With the default block of 2**20, ``levels=2`` keeps every window at or below a million
rows for order values up to 2**60, ``levels=3`` for all of 63 bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentlake.functions.binding import let

BLOCK = 1 << 20


# Rows that a task sorts or groups at a time, about, where a table's size is known.
PART_ROWS = 1 << 20


def parts_for(spark: SparkSession, rows: int, most: int = PART_ROWS) -> int | None:
    """Partitions of about ``most`` rows, no fewer than the session's; None for tables of few of them.

    Left to itself Spark fixes the number whatever the size, and puts small partitions together.
    """
    if rows <= 8 * most:
        return None
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def _window(keys: Sequence[str], order: str, end: int):
    window = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return window.orderBy(order).rowsBetween(Window.unboundedPreceding, end)


def _before(keys: Sequence[str], order: str):
    return _window(keys, order, -1)


def _upto(keys: Sequence[str], order: str):
    return _window(keys, order, 0)


def _cut(df: DataFrame, order: str, blk: str, block: int) -> DataFrame:
    """Rows with their block number."""
    return df.withColumn(blk, F.floor(F.col(order) / block).cast("bigint"))


def _join_blocks(df: DataFrame, blocks: DataFrame, keys: Sequence[str], blk: str, carry: str) -> DataFrame:
    """Rows with their block's carry.

    Plain equality on (keys, block) lets the window that follows reuse the join's
    partitioning, so the rows themselves are shuffled once.
    """
    by = [*keys, blk]
    named = blocks.select(*[F.col(c).alias(f"_of_{c}") for c in by], carry)
    on = [F.col(c) == F.col(f"_of_{c}") for c in by]
    return df.join(named, on, "left").drop(*[f"_of_{c}" for c in by])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    out: str,
    inclusive: bool = True,
    levels: int = 2,
    block: int = BLOCK,
    parts: int | None = None,
) -> DataFrame:
    """Running sum of ``value`` per key in the order of ``order``.

    ``order`` is a non-negative integer, unique within its key; keys are not NULL.
    With ``inclusive=False`` the row's own value is left out. Blocks are dealt to
    ``parts`` partitions (``parts_for``), or to as many as Spark takes.
    """
    blk, carry, total = f"_blk{levels}", f"_carry{levels}", f"_total{levels}"
    blocked = _cut(df, order, blk, block)
    totals = blocked.groupBy(*keys, blk).agg(F.sum(value).alias(total))
    if levels > 1:
        totals = running(totals, keys, blk, total, carry, False, levels - 1, block, parts)
    else:
        totals = totals.withColumn(carry, F.sum(total).over(_before(keys, blk)))
    if parts:
        blocked = blocked.repartition(parts, *keys, blk)
    carried = _join_blocks(blocked, totals.select(*keys, blk, carry), keys, blk, carry)
    inside = F.sum(value).over((_upto if inclusive else _before)([*keys, blk], order))
    filled = F.coalesce(inside, F.lit(0)) + F.coalesce(F.col(carry), F.lit(0))
    return carried.withColumn(out, filled).drop(blk, carry)


def running_since_reset(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    reset: str,
    out: str,
    levels: int = 2,
    block: int = BLOCK,
) -> DataFrame:
    """Running sum per key that starts over at every row where ``reset`` is true.

    The resetting row opens the new run with its own value. A block that holds a
    reset passes on only what follows its last one, so block totals form the same
    kind of scan one level up.
    """
    blk, carry, run = f"_blk{levels}", f"_carry{levels}", f"_run{levels}"
    sum_, start, has = f"_sum{levels}", f"_start{levels}", f"_has{levels}"

    def scan(frame, by, position, amount, resets):
        window = _upto(by, position)
        opening = F.when(F.coalesce(F.col(resets), F.lit(False)), F.col(sum_) - F.col(amount))
        return frame.withColumn(sum_, F.sum(amount).over(window)).withColumn(
            start, F.last(opening, ignorenulls=True).over(window)
        )

    current = F.col(sum_) - F.coalesce(F.col(start), F.lit(0))
    scanned = scan(_cut(df, order, blk, block), [*keys, blk], order, value, reset)
    totals = scanned.groupBy(*keys, blk).agg(
        F.max_by(current, F.col(order)).alias(run), F.max(F.col(start).isNotNull()).alias(has)
    )
    if levels > 1:
        totals = running_since_reset(totals, keys, blk, run, has, "_whole", levels - 1, block)
        totals = previous(totals, keys, blk, "_whole", carry, levels - 1, block)
    else:
        totals = scan(totals, keys, blk, run, has).withColumn("_whole", current)
        totals = totals.withColumn(carry, F.last("_whole").over(_before(keys, blk)))
    carried = _join_blocks(scanned, totals.select(*keys, blk, carry), keys, blk, carry)
    entering = F.when(F.col(start).isNull(), F.coalesce(F.col(carry), F.lit(0))).otherwise(F.lit(0))
    return carried.withColumn(out, current + entering).drop(blk, carry, sum_, start)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    out: str,
    levels: int = 2,
    block: int = BLOCK,
) -> DataFrame:
    """The preceding row's ``value`` per key, NULL for the first row."""
    blk, carry, last = f"_pblk{levels}", f"_pcarry{levels}", f"_plast{levels}"
    blocked = _cut(df, order, blk, block)
    lasts = blocked.groupBy(*keys, blk).agg(F.max_by(F.col(value), F.col(order)).alias(last))
    if levels > 1:
        lasts = previous(lasts, keys, blk, last, carry, levels - 1, block)
    else:
        lasts = lasts.withColumn(carry, F.last(last).over(_before(keys, blk)))
    carried = _join_blocks(blocked, lasts.select(*keys, blk, carry), keys, blk, carry)
    window = Window.partitionBy(*keys, blk).orderBy(order)
    inside = F.when(F.row_number().over(window) == 1, F.col(carry)).otherwise(F.lag(value).over(window))
    return carried.withColumn(out, inside).drop(blk, carry)


def dense_index(
    df: DataFrame, order: str, out: str = "idx", keys: Sequence[str] = (), levels: int = 2, block: int = BLOCK
) -> DataFrame:
    """0-based position of each row by a unique non-negative integer column."""
    counted = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running(counted, keys, order, "_one", out, False, levels, block).drop("_one")


def _bound_index(key: Column, bounds: Column, bits: int) -> Column:
    """How many of at most ``2^bits - 1`` ascending ``bounds`` are not above ``key``, by binary search."""

    def search(keyed):
        def step(low, width):
            if width == 0:
                return low
            at = low + F.lit(width)
            return let(F.when(F.get(keyed["b"], at - 1) <= keyed["k"], at).otherwise(low), lambda now: step(now, width // 2))

        return step(F.lit(0), 1 << (bits - 1))

    return let(F.struct(key.alias("k"), bounds.alias("b")), search)


def dense_order(df: DataFrame, order: str, out: str = "ord", keys: Sequence[str] = (), bits: int = 8, sample: int = 32) -> DataFrame:
    """0-based position of each row in the order of a string column, per ``keys``, without one task for all.

    ``2^bits - 1`` bounds are read off a sample of the rows with the smallest hashes; they
    cut the table into ranges. Each range is numbered on its own, after as many positions as
    the ranges before it hold. Rows with equal strings fall into one range. ``order`` is not
    NULL; equal values within a key are numbered in no certain order.
    """
    parts = 1 << bits
    picked = df.select(F.col(order).alias("_o")).distinct().orderBy(F.xxhash64("_o"), "_o").limit(parts * sample)
    # Bounded by ``parts * sample`` values.
    ranked = picked.agg(F.array_sort(F.collect_list("_o")).alias("all")).select(
        F.expr(f"transform(sequence(1, {parts - 1}), i -> get(all, CAST(i * size(all) div {parts} AS INT)))").alias("bounds")
    )
    cut = df.withColumn("_bounds", ranked.scalar()).withColumn("_part", _bound_index(F.col(order), F.col("_bounds"), bits)).drop("_bounds")
    by = [*keys, "_part"]
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per key and range.
    counts = cut.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = _join_blocks(cut, counts.select(*by, "_before"), list(keys), "_part", "_before")
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return placed.withColumn(out, (F.col("_before") + inside).cast("bigint")).drop("_part", "_before")
