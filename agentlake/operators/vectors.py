"""Vector statistics over ``(key columns, vec ARRAY<FLOAT>)`` tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from agentlake.functions import vectors as V

# Fixed value: contrast vectors this short carry no direction.
MIN_NORM = 0.01


def class_mean_vector(df: DataFrame, keys: Sequence[str], vec: str, out: str = "mean") -> DataFrame:
    """Elementwise mean per class.

    Sums and counts per (class, position) are combined before the shuffle, so only
    classes x dimensions rows per task travel, however large a class is. The last
    step gathers one array of the vectors' own length.
    """
    cells = df.select(*keys, F.posexplode(vec).alias("_pos", "_x"))
    means = cells.groupBy(*keys, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_mean"))
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_mean")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda c: c["_mean"]).alias(out))


def contrast_direction(
    df: DataFrame, keys: Sequence[str], group: Column, vec: str, min_norm: float = MIN_NORM
) -> DataFrame:
    """Unit vector of mean(A) - mean(B) per key, where long enough: ``(keys, norm, direction)``.

    ``group`` is true for A and false for B. Both means come from one pass; keys
    lacking a side are left out.
    """
    cells = df.select(*keys, group.alias("_a"), F.posexplode(vec).alias("_pos", "_x"))
    x = F.col("_x").cast("double")
    gaps = cells.groupBy(*keys, "_pos").agg(
        (F.avg(F.when(F.col("_a"), x)) - F.avg(F.when(~F.col("_a"), x))).alias("_gap")
    )
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_gap")))
    raw = gaps.where("_gap IS NOT NULL").groupBy(*keys).agg(F.transform(ordered, lambda c: c["_gap"]).alias("_diff"))
    return min_norm_filter(raw.withColumn("norm", V.norm(F.col("_diff"))), min_norm).select(
        *keys, "norm", V.scale(F.col("_diff"), F.lit(1.0) / F.col("norm")).alias("direction")
    )


def min_norm_filter(df: DataFrame, min_norm: float = MIN_NORM, norm: str = "norm") -> DataFrame:
    return df.where(F.col(norm) > min_norm)


def inner_keys(df: DataFrame, key: str, n: int, margin: int = 2) -> DataFrame:
    """Rows whose key index lies in ``[margin, n - margin)``."""
    return df.where((F.col(key) >= margin) & (F.col(key) < n - margin))


def reject_direction(df: DataFrame, directions: DataFrame, keys: Sequence[str], vec: str, strength: float = 1.0) -> DataFrame:
    """Vectors with their projection on the key's unit direction and without it.

    Adds ``projection`` and ``rejected``. Keys without a direction keep their vector.
    The directions hold one row per key; Spark broadcasts them if they measure small.
    """
    joined = df.join(directions.select(*keys, "direction"), list(keys), "left")
    projection = V.dot(F.col(vec), F.col("direction"))
    rejected = V.reject(F.col(vec), F.col("direction"), strength)
    return joined.withColumn("projection", F.coalesce(projection, F.lit(0.0))).withColumn(
        "rejected", F.coalesce(rejected, F.col(vec).cast("array<double>"))
    ).drop("direction")


def rms_normalize_sharded(shards: DataFrame, eps: float) -> DataFrame:
    """RMS normalisation of vectors stored in pieces: ``shards(vec_id, shard, part, weight)``.

    Only one partial sum of squares per piece is combined; the pieces themselves stay
    apart, as ``normalized``.
    """
    squares = shards.select(
        "vec_id", (V.mean_square(F.col("part")) * F.size("part")).alias("_sq"), F.size("part").alias("_n")
    )
    sums = squares.groupBy("vec_id").agg((F.sum("_sq") / F.sum("_n")).alias("_ms"))
    factor = F.lit(1.0) / F.sqrt(F.col("_ms") + F.lit(eps))
    scaled = V.multiply(V.scale(F.col("part"), factor), F.col("weight"))
    return shards.join(sums, "vec_id").withColumn("normalized", scaled).drop("_ms")


def vector_topk(
    df: DataFrame, scores: str, k: int, mode: str = "softmax", renormalize: bool = True, bias: Column | None = None
) -> DataFrame:
    """The ``k`` best positions per row with their weights, as ``(rank, idx, weight)`` rows.

    ``softmax`` optionally renormalises the chosen weights. ``sigmoid`` adds ``bias``
    for the choice only and always renormalises. Ties go to the lower position.
    """
    gates = V.softmax(F.col(scores)) if mode == "softmax" else V.sigmoid(F.col(scores))
    with_gates = df.withColumn("_g", gates)
    ranked = F.col("_g") if bias is None else F.zip_with("_g", bias.cast("array<double>"), lambda g, b: g + b)
    chosen = with_gates.withColumn("_i", V.top_indices(ranked, k)).withColumn("_w", V.pick(F.col("_g"), F.col("_i")))
    if mode == "sigmoid":
        chosen = chosen.withColumn("_w", V.scale(F.col("_w"), F.lit(1.0) / (V.total(F.col("_w")) + F.lit(1e-20))))
    elif renormalize:
        chosen = chosen.withColumn("_w", V.scale(F.col("_w"), F.lit(1.0) / V.total(F.col("_w"))))
    return chosen.select(*df.columns, F.posexplode(F.arrays_zip("_i", "_w")).alias("rank", "_c")).select(
        *df.columns, "rank", F.col("_c._i").alias("idx"), F.col("_c._w").alias("weight")
    )


def phrase_rate(responses: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    """Flagged and total responses per group, and their ratio."""
    return responses.groupBy(*keys).agg(
        F.count_if(flag).alias("flagged"),
        F.count(F.lit(1)).alias("responses"),
        F.avg(flag.cast("double")).alias("rate"),
    )


def trial_scores(trials: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Trials with ``score``, the weighted sum of the given metric columns."""
    score = F.lit(0.0)
    for metric, weight in weights.items():
        score = score + F.col(metric) * F.lit(weight)
    return trials.withColumn("score", score)


def best_trial(scored: DataFrame) -> DataFrame:
    """The lowest-scoring trial of each study, ties to the lowest trial number."""
    best = F.min(F.struct("score", "trial", *[c for c in scored.columns if c not in ("study", "score", "trial")]))
    return scored.groupBy("study").agg(best.alias("_best")).select("study", "_best.*")


def _front(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points that no other point equals or beats in both, by ascending ``a``."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    best = np.minimum.accumulate(b) if len(b) else b
    keep = np.r_[True, b[1:] < best[:-1]] if len(b) else np.zeros(0, bool)
    return a[keep], b[keep]


def dominated_area(trials: DataFrame, a: str, b: str, reference: tuple[float, float], key: str = "study") -> DataFrame:
    """``(key, trials, front, area)``: how far the trials of a study push two metrics down.

    ``front`` counts the trials' distinct best trade-offs, ``area`` is what they dominate up
    to ``reference``. Lower is better; trials with a NULL or NaN metric, or one not below the
    reference, only count as trials.

    Each Arrow batch is first reduced to its own fronts, so fronts are all that is shuffled; a
    study's fronts are then merged batch by batch, never held as a whole group.
    """
    ra, rb = reference
    given = trials.select(F.col(key).alias("key"), F.lit(1).cast("bigint").alias("n"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    schema = to_arrow_schema(given.schema)

    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Groups by number, so that keys of any type keep it.
            codes = pc.dictionary_encode(batch.column("key"), null_encoding="encode")
            code = codes.indices.to_numpy(zero_copy_only=False)
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            good = (x < ra) & (y < rb)
            group, n, fa, fb = [], [], [], []
            for g in range(len(codes.dictionary)):
                own = code == g
                front = _front(x[own & good], y[own & good])
                # A first row with the count, which holds no point.
                group.append(np.full(len(front[0]) + 1, g))
                n.append(np.r_[int(own.sum()), np.zeros(len(front[0]), np.int64)])
                fa.append(np.r_[np.inf, front[0]])
                fb.append(np.r_[np.inf, front[1]])
            if group:
                cells = [codes.dictionary.take(pa.array(np.concatenate(group))), *(pa.array(np.concatenate(c)) for c in (n, fa, fb))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, x, y, name = 0, np.zeros(0), np.zeros(0), None
        for batch in batches:
            name = batch.column("key").slice(0, 1)
            n += pc.sum(batch.column("n")).as_py()
            more = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]
            x, y = _front(*(np.r_[old, new[more[0] < ra]] for old, new in zip((x, y), more, strict=True)))
        right = np.r_[x[1:], ra] if len(x) else x
        cells = [name, pa.array([n]), pa.array([len(x)]), pa.array([float(((right - x) * (rb - y)).sum())])]
        yield pa.RecordBatch.from_arrays(cells, [key, "trials", "front", "area"])

    kind = trials.schema[key].dataType.simpleString()
    return given.mapInArrow(fronts, given.schema).groupBy("key").applyInArrow(merged, f"{key} {kind}, trials bigint, front bigint, area double")
