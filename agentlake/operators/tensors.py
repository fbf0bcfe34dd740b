"""Checkpoint catalogs: ``tensors(checkpoint_id, name, nbytes)``, names unique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Expert tensor names, their projections, and the tied head.
EXPERT_PATTERN = r"^model\.layers\.(\d+)\.(block_sparse_moe|mlp)\.experts\.(\d+)\.(\w+)\.weight$"
PROJECTIONS = {"w1": "gate_proj", "w2": "down_proj", "w3": "up_proj"}
GATES = ["model.layers.0.block_sparse_moe.experts.0.w1.weight", "model.layers.0.mlp.experts.0.up_proj.weight"]
TIED_HEAD = "lm_head.weight"
SCALE_SUFFIX = "_scale_inv"


def bytes_per_group(tensors: DataFrame) -> DataFrame:
    """Total bytes per checkpoint and per layer (1 where there are no layers)."""
    layer = F.regexp_extract("name", r"layers\.(\d+)\.", 1)
    per_layer = tensors.groupBy("checkpoint_id", F.nullif(layer, F.lit("")).alias("layer")).agg(F.sum("nbytes").alias("nbytes"))
    totals = per_layer.groupBy("checkpoint_id").agg(
        F.sum("nbytes").cast("bigint").alias("total_bytes"), F.count("layer").alias("layers")
    )
    share = F.when(F.col("layers") > 0, F.col("total_bytes") / F.col("layers")).otherwise(F.lit(1.0))
    return totals.withColumn("bytes_per_layer", share)


def pair_scale_rows(tensors: DataFrame) -> DataFrame:
    """Weights with ``dequantised``; scale rows disappear into their weight.

    A scale without a weight is kept as an error row. Weight and scale meet in one
    aggregation on the weight's name, so the catalog is read and shuffled once.
    """
    is_scale = F.col("name").contains("weight" + SCALE_SUFFIX)
    weight_name = F.when(is_scale, F.replace("name", F.lit(SCALE_SUFFIX), F.lit(""))).otherwise(F.col("name"))
    return (
        tensors.groupBy("checkpoint_id", weight_name.alias("name"))
        .agg(
            F.max(F.when(~is_scale, F.col("nbytes"))).alias("nbytes"),
            F.bool_or(is_scale).alias("dequantised"),
            F.bool_or(~is_scale).alias("_weight"),
        )
        .withColumn("error", F.when(~F.col("_weight"), F.lit("scale without weight")))
        .withColumn("dequantised", F.col("dequantised") & F.col("_weight"))
        .drop("_weight")
    )


def stack_experts(tensors: DataFrame, n_experts: int, tied: bool = False) -> DataFrame:
    """The catalog with expert weights regrouped to one row per layer and projection.

    A checkpoint is touched only if layer 0 holds expert 0. Rows are
    ``(checkpoint_id, name, nbytes, experts, error)``: ``experts`` are the byte sizes
    by expert for a stacked row, ``error`` names a gap among the experts, and all other
    tensors pass through. The head is dropped when it is ``tied``.
    """
    if tied:
        tensors = tensors.where(F.col("name") != TIED_HEAD)
    gated = tensors.where(F.col("name").isin(GATES)).select("checkpoint_id").distinct().withColumn("_gated", F.lit(True))

    def part(group):
        return F.regexp_extract("name", EXPERT_PATTERN, group)

    projection = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for pair in PROJECTIONS.items() for x in pair]), part(4)), part(4)
    )
    stacked_name = F.concat(
        F.lit("model.layers."), part(1), F.lit("."), part(2), F.lit(".switch_mlp."), projection, F.lit(".weight")
    )
    is_expert = F.coalesce(F.col("_gated"), F.lit(False)) & F.col("name").rlike(EXPERT_PATTERN)
    keyed = tensors.join(gated, "checkpoint_id", "left").select(
        "checkpoint_id",
        F.when(is_expert, stacked_name).otherwise(F.col("name")).alias("name"),
        F.when(is_expert, part(3).cast("int")).alias("expert"),
        F.col("name").alias("_own"),
        "nbytes",
    )
    # One group is the experts of one projection, or a single tensor. The shuffle keeps
    # the grouping off the join's partitions, which hold whole checkpoints.
    grouped = keyed.repartition("checkpoint_id", "name").groupBy("checkpoint_id", "name").agg(
        F.array_sort(F.collect_list(F.when(F.col("expert").isNotNull(), F.struct("expert", "nbytes", "_own")))).alias("e"),
        F.sum("nbytes").cast("bigint").alias("nbytes"),
    )
    has_first = F.exists("e", lambda x: x["expert"] == 0)
    full = F.size(F.filter("e", lambda x: x["expert"] < n_experts)) == n_experts
    stacked = F.array(
        F.struct(
            "name",
            "nbytes",
            F.when(F.size("e") > 0, F.transform("e", lambda x: x["nbytes"])).alias("experts"),
            F.when((F.size("e") > 0) & ~full, F.lit("missing expert")).alias("error"),
        )
    )
    # Without expert 0 the projection is left alone and its tensors keep their names.
    loose = F.transform(
        "e",
        lambda x: F.struct(
            x["_own"].alias("name"),
            x["nbytes"].alias("nbytes"),
            F.lit(None).cast("array<bigint>").alias("experts"),
            F.lit(None).cast("string").alias("error"),
        ),
    )
    rows = F.when((F.size("e") == 0) | has_first, stacked).otherwise(loose)
    return grouped.select("checkpoint_id", F.inline(rows))
