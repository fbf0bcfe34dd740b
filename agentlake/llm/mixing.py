"""Temperature mixing of sources, with DataFrame and SQL functions only.

Weights are the sources' token shares raised to an exponent and normalised. The exponent is
bisected on a grid of 2^20 steps between 0 (all sources alike) and 1 (as they are). The
weights are realised as block permutations: each source is cut into 4096 blocks by a hash
of the key, an epoch of a source reads its blocks in an order of its own, and a source's
token budget buys whole epochs and then blocks as long as they fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agentlake.llm.common import whole_row, written

STEPS = 1 << 20
WORDS = r"[^\x20\x09-\x0D]+"


def with_tokens(docs: DataFrame, columns: list[str], key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``row, source, block, tokens``: ``columns`` of ``docs`` as one struct, and words (a null text has none)."""
    return docs.select(
        whole_row(columns).alias("row"),
        F.col(source).alias("source"),
        F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 3).alias("block"),
        F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint").alias("tokens"),
    )


def weights(sizes: DataFrame, budget: int, repetition: float | None = None, entropy: float | None = None) -> DataFrame:
    """``source, tokens, weight, target`` for every source with tokens; ``sizes``: ``source, tokens``.

    Give one goal. ``repetition``: the smallest exponent at which no source is read more
    than that often for ``budget`` tokens; 1 if none is small enough. ``entropy``: the largest
    exponent at which the weights' entropy in nats is at least that; 0 if none is.
    A null source is a source of its own.
    """
    if (repetition is None) == (entropy is None):
        raise ValueError("give a repetition limit or an entropy")
    some = sizes.where("tokens > 0")
    total = some.agg(F.sum("tokens").cast("bigint")).first()[0]
    if not total:
        return some.selectExpr("source", "tokens", "0D AS weight", "0L AS target")

    def power(step: int):
        return F.pow(F.col("tokens") / F.lit(total), F.lit(step / STEPS))

    def reached(step: int) -> bool:
        p = power(step)
        if repetition is not None:
            # weight * budget / tokens, with the sum of the powers taken out of the maximum
            goal = F.round(F.max(p / F.col("tokens")) / F.sum(p) * budget, 9) <= repetition
        else:
            goal = F.round(F.log(F.sum(p)) - F.sum(p * F.log(p)) / F.sum(p), 9) < entropy
        return some.agg(goal).first()[0]

    # The smallest step where ``reached`` holds; it holds from there on.
    low, high = -1, STEPS if repetition is not None else STEPS + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if reached(middle) else (middle, high)
    step = high if repetition is not None else max(0, high - 1)
    norm = some.agg(F.sum(power(step))).first()[0]
    weight = power(step) / F.lit(norm)
    return some.select("source", "tokens", weight.alias("weight"), F.floor(F.round(weight * budget, 3)).cast("bigint").alias("target"))


def mix(
    docs: DataFrame, budget: int | None = None, repetition: float | None = None, entropy: float | None = None,
    key: str = "doc_id", source: str = "source", text: str = "text", columns: list[str] | None = None,
) -> DataFrame:
    """A row for every time a document is read: ``columns`` of ``docs`` (all by default), and
    ``epoch, block, block_rank, tokens``.

    ``budget`` is in words, by default those of ``docs``. In epoch ``epoch`` (from 0) a source's
    blocks are read by ``block_rank`` (from 1). Whole epochs take every document of the
    source; the last one takes blocks while they fit into what is left. A source without
    words takes no part. Documents with null texts are read with their blocks. Repeated rows
    are read each. Columns of ``docs`` with the names of the results are replaced.
    """
    columns = [c for c in (docs.columns if columns is None else columns) if c not in ("epoch", "block", "block_rank", "tokens")]
    rows = with_tokens(docs, columns, key, source, text)
    blocks = written(rows.groupBy("source", "block").agg(F.sum("tokens").cast("bigint").alias("tokens")), "blocks")
    sizes = written(blocks.groupBy("source").agg(F.sum("tokens").cast("bigint").alias("tokens")), "sources")
    if budget is None:
        budget = sizes.agg(F.sum("tokens")).first()[0] or 0
    aims = weights(sizes, budget, repetition, entropy).selectExpr("source", "target div tokens AS whole", "target % tokens AS rest")
    # One row per source, block and epoch: at most 4096 rows of a source in a window.
    plan = (
        blocks.alias("b").join(aims.alias("a"), F.col("b.source").eqNullSafe(F.col("a.source")))
        .select("b.source", "block", "tokens", "whole", "rest", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole"))).alias("epoch"))
        .withColumn("order", F.md5(F.concat_ws("|", F.coalesce("source", F.lit("")), F.col("epoch").cast("string"), "block").cast("binary")))
    )
    turn = Window.partitionBy("source", "epoch").orderBy("order", "block")
    ranked = plan.withColumn("block_rank", F.row_number().over(turn)).withColumn(
        "sum", F.sum("tokens").over(turn.rowsBetween(Window.unboundedPreceding, 0))
    ).where("epoch < whole OR sum <= rest")
    picked = ranked.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("epoch").cast("int").alias("epoch"), "block_rank")
    joined = rows.join(picked, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return joined.select(*[F.col("row").getField(c).alias(c) for c in columns], "epoch", "block", "block_rank", "tokens")
