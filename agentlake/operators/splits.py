"""Splitting numbered items over the nodes of a cluster.

``nodes(cluster_id, rank, capacity)`` with ranks 0..n-1, ``loads(cluster_id,
n_items, total_bytes)`` and ``items(cluster_id, idx, ...)`` with a dense 0-based
``idx``. Windows run over the nodes of one cluster only, never over items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bytes set aside per item and once per node.
ITEM_OVERHEAD = 1.5 * 1024**3
NODE_OVERHEAD = 2.5 * 1024**3
#: Bits of a level of aligned intervals, and of the widest interval: 16^4 = 65536 positions.
RADIX_BITS, TOP_BITS = 4, 16


def equal_bucket(idx: Column, total: Column, buckets: int) -> Column:
    """0-based bucket of an item when the first ``total % buckets`` get one more.

    The same buckets as ``ntile`` but computed from the position, without putting all
    items in one ordered window.
    """
    base = F.floor(total / buckets)
    extra = total % buckets
    wide = extra * (base + 1)
    return (
        F.when(idx < wide, F.floor(idx / (base + 1)))
        .otherwise(extra + F.floor((idx - wide) / F.greatest(base, F.lit(1))))
        .cast("bigint")
    )


def equal_split(items: DataFrame, buckets: int, total: Column | None = None) -> DataFrame:
    """Items (one cluster, dense ``idx``) with their ``bucket``.

    ``total`` is the number of items, counted here when not at hand.
    """
    if total is None:
        total = items.select((F.max("idx") + 1).alias("n")).scalar()
    return items.withColumn("bucket", equal_bucket(F.col("idx"), total, buckets))


def _whole(value: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(value).cast("bigint"))


def proportional_split(
    nodes: DataFrame, loads: DataFrame, item_overhead: float = ITEM_OVERHEAD, node_overhead: float = NODE_OVERHEAD
) -> DataFrame:
    """Items per node in proportion to what each can hold: ``(cluster_id, rank, items)``.

    Every node but the last gets its floored share, at least one and at most its
    maximum; the last takes the rest and hands what it cannot hold to the largest
    node. A cluster with an unknown capacity is split equally. A last node left with
    fewer than zero items gets zero, marked ``clamped``.
    """
    cluster = Window.partitionBy("cluster_id")
    per_item = F.when(F.col("n_items") > 0, F.col("total_bytes") / F.col("n_items")).otherwise(F.lit(1.0))
    most = _whole((F.col("capacity") - node_overhead) / (F.col("_b") + item_overhead))
    room = F.col("_cap") + node_overhead + _whole(F.col("_cap") / F.col("_b")) * item_overhead
    share = F.least(_whole(F.col("n_items") * F.col("_cap") / F.sum("_cap").over(cluster)), F.col("_max"))
    sized = (
        nodes.join(loads, "cluster_id")
        .withColumn("_b", per_item.cast("double"))
        .withColumn("_cap", F.greatest(most * F.col("_b"), F.col("_b")))
        .withColumn("_max", _whole((room - node_overhead) / (F.col("_b") + item_overhead)))
        .withColumn("_size", F.count(F.lit(1)).over(cluster))
        .withColumn("_known", F.count("capacity").over(cluster) == F.col("_size"))
        .withColumn("_last", F.col("rank") == F.max("rank").over(cluster))
        .withColumn("_share", F.when(~F.col("_last"), share))
        .withColumn("_rest", F.col("n_items") - F.coalesce(F.sum("_share").over(cluster), F.lit(0)))
        .withColumn("_excess", F.max(F.when(F.col("_last"), F.greatest(F.lit(0), F.col("_rest") - F.col("_max")))).over(cluster))
        .withColumn("_largest", F.max_by("rank", F.struct("_cap", -F.col("rank"))).over(cluster) == F.col("rank"))
    )
    own = F.when(F.col("_last"), F.col("_rest") - F.col("_excess")).otherwise(F.col("_share"))
    split = own + F.when(F.col("_largest"), F.col("_excess")).otherwise(F.lit(0))
    even = F.floor(F.col("n_items") / F.col("_size")) + (F.col("rank") < F.col("n_items") % F.col("_size")).cast("int")
    count = F.when(F.col("_known"), split).otherwise(even)
    return sized.select(
        "cluster_id",
        "rank",
        F.greatest(count, F.lit(0)).cast("bigint").alias("items"),
        (count < 0).alias("clamped"),
    )


def reverse_offsets(counts: DataFrame) -> DataFrame:
    """Ranges ``[start_idx, end_idx)``: a rank starts after all higher ranks."""
    above = Window.partitionBy("cluster_id").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("items").over(above), F.lit(0)).cast("bigint")
    return counts.withColumn("start_idx", start).withColumn("end_idx", (F.col("start_idx") + F.col("items")).cast("bigint"))


def aligned_intervals(bounds: DataFrame, top: int = TOP_BITS, bits: int = RADIX_BITS) -> DataFrame:
    """Ranges ``[start_idx, end_idx)`` cut into aligned intervals: ``(cluster_id, rank, shift, slot)``.

    An interval holds the positions whose bits above ``shift`` are ``slot``. Below the widest
    level a range takes at most ``2 * (2^bits - 1)`` intervals a level, whatever its length;
    on the widest level one per ``2^top`` positions. The intervals of a range do not overlap.
    """
    shifts = F.sequence(F.lit(0), F.lit(top), F.lit(bits))
    level = bounds.where("end_idx > start_idx").select(
        "cluster_id", "rank", F.col("start_idx").cast("bigint").alias("s"), F.col("end_idx").cast("bigint").alias("e"), F.explode(shifts).alias("shift")
    )
    # Whole intervals of a level inside the range, less those that fill one of the next level.
    fan = 1 << bits
    level = level.selectExpr(
        "cluster_id", "rank", "shift", "shiftright(s + shiftleft(1L, shift) - 1, shift) AS a", "shiftright(e, shift) AS b"
    ).where("a < b").selectExpr(
        "*", f"IF(shift = {top}, b, shiftright(a + {fan - 1}L, {bits}) * {fan}L) AS c", f"IF(shift = {top}, b, shiftright(b, {bits}) * {fan}L) AS d"
    )
    none = "CAST(array() AS ARRAY<BIGINT>)"
    slots = f"IF(c >= d, sequence(a, b - 1), concat(IF(a < c, sequence(a, c - 1), {none}), IF(d < b, sequence(d, b - 1), {none})))"
    return level.selectExpr("cluster_id", "rank", "shift", f"explode({slots}) AS slot")


def assign_ranges(items: DataFrame, bounds: DataFrame, top: int = TOP_BITS, bits: int = RADIX_BITS) -> DataFrame:
    """Items with the rank whose range holds their ``idx``; with several such ranges, once for each.

    Ranges become aligned intervals, and an item looks up the one interval of each level
    that holds it, so it meets its own ranges and no others: an equality join on (cluster,
    level, interval). Only levels that occur are looked up, and no key has more than
    ``2^top`` items of a cluster.
    """
    pieces = aligned_intervals(bounds, top, bits)
    # A short list for any input: (top / bits) + 1 levels at most.
    used = pieces.agg(F.array_sort(F.collect_set("shift")).alias("shifts")).scalar()
    looked_up = items.withColumn("_shift", F.explode(used)).withColumn("_slot", F.expr("shiftright(CAST(idx AS BIGINT), _shift)"))
    named = pieces.select(F.col("cluster_id").alias("_cluster"), "rank", F.col("shift").alias("_level"), F.col("slot").alias("_at"))
    on = (F.col("cluster_id") == F.col("_cluster")) & (F.col("_shift") == F.col("_level")) & (F.col("_slot") == F.col("_at"))
    return looked_up.join(named, on).select(*items.columns, "rank")
