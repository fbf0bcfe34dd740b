"""Exact top-k search by distributed histogram selection.

All scores of a query are integers. They are counted in histograms of ever finer bins: each
round locates, for every query, the bin that holds its kth highest score, and the next
round divides that bin, until bins are one score wide and the kth value is known. A last
round keeps the scores above that value and, of those equal to it, the smallest ids.

Scores are computed anew in every round, a block of queries against a block of vectors; what
is shuffled are the blocks, never pairs of them, and, per query and block, the few bins from
the block's highest score down to its own kth one, below which the query's kth value cannot lie.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agentlake.llm.common import bound_batches, written

QUERIES, VECTORS = 512, 2048
#: Groups of blocks of vectors for every core: enough that cores share them evenly.
SEATS = 8
#: Bins a round divides a bin into.
FAN = 128


def quantised(vectors: DataFrame, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, q``: floor(scale * x) of every component.

    Left out are rows with a null id, with a null vector or with a null or non-finite
    component. A repeated id counts once, with its smallest vector.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    usable = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(
        F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    )
    q = usable.select(F.col(key).cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("q"))
    return q.groupBy("vec_id").agg(F.min("q").alias("q"))


def _packed(df: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of about ``size`` rows of one dimension: ``dim, {name}, ids, body`` with packed arrays."""
    blocks = df.select(
        F.size("q").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("bigint")).alias(name), "vec_id", "q", "state"
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        body = np.array(pdf["q"].to_list(), np.int64)
        small = np.abs(body).max(initial=0) < 2**15
        return pd.DataFrame({
            "dim": [pdf["dim"].iloc[0]], name: [pdf[name].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "body": [body.astype(np.int16 if small else np.int64).tobytes()],
            "state": [np.array(pdf["state"].to_list(), np.int64).tobytes()],
        })

    return blocks.groupBy("dim", name).applyInPandas(pack, f"dim int, {name} bigint, ids binary, body binary, state binary")


def _opened(ids: bytes, body: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    kind = np.int16 if len(body) == 2 * len(ids) * dim else np.int64
    return ids, np.frombuffer(body, kind).reshape(len(ids), dim).astype(np.int64)


def _rows(batch: pa.RecordBatch):
    """The rows of a batch one by one, so that only one is held as Python objects."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point while all partial sums are exact, else in int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _pairs(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every block of queries beside every block of vectors of its dimension.

    Blocks of vectors are dealt to as many seats as keep the cluster busy, and blocks of queries
    go to every seat, so what is shuffled is the vectors once and the queries a fixed number of
    times. Pairs arise in the join and are used where they arise. The broadcast has one row per
    dimension.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    seats = SEATS * spark.sparkContext.defaultParallelism
    of_v = vectors.select("dim", "vb", F.pmod("vb", F.lit(seats)).alias("seat"), F.col("ids").alias("v_ids"), F.col("body").alias("v_body"))
    taken = vectors.groupBy("dim").agg(F.least(F.max("vb"), F.lit(seats - 1)).alias("last"))
    of_q = queries.select("dim", "qb", F.col("ids").alias("q_ids"), F.col("body").alias("q_body"), F.col("state").alias("q_state"))
    dealt = of_q.join(F.broadcast(taken), "dim").withColumn("seat", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last")))).drop("last")
    # A fixed count: bytes are few for the work they make, so adaptive coalescing would put them in one task.
    return dealt.repartition(seats, "dim", "seat").join(of_v.repartition(seats, "dim", "seat"), ["dim", "seat"])


def _counts(scores: np.ndarray, state: np.ndarray, width: int) -> np.ndarray:
    """Per query, how many open scores fall into each bin."""
    low, high = state[:, :1], state[:, 1:2]
    open_ = (scores >= low) & (scores <= high)
    if 4 * np.count_nonzero(open_) < open_.size:
        r, c = np.nonzero(open_)
        bins = (scores[r, c] - state[r, 0]) // width
        size = int(bins.max(initial=0)) + 1
        return np.bincount(r * size + bins, minlength=len(scores) * size).reshape(len(scores), size)
    # Most are open: all are counted, the others in a bin of their own.
    bins = (scores - low) // width + 1
    bins[~open_] = 0
    size = int(bins.max(initial=0)) + 1
    bins += np.arange(len(scores))[:, None] * size
    return np.bincount(bins.ravel(), minlength=len(scores) * size).reshape(len(scores), size)[:, 1:]


def _tops(pairs: DataFrame, width: int) -> DataFrame:
    """``vec_id, bin, n``: per query and block, counts of its bins down to the block's kth score.

    The state of a query is the lowest and highest score still open; scores above the
    highest are settled, scores below the lowest are out.
    """

    def run(batches):
        for row in (row for batch in batches for row in _rows(batch)):
            q_ids, q = _opened(row["q_ids"], row["q_body"], row["dim"])
            v_ids, v = _opened(row["v_ids"], row["v_body"], row["dim"])
            state = np.frombuffer(row["q_state"], np.int64).reshape(-1, 3)
            scores = _product(q, v)
            if np.intersect1d(q_ids, v_ids).size:
                # A query's own row is out: lower than anything open.
                scores[q_ids[:, None] == v_ids[None, :]] = state[:, 0].min() - 1
            counts = _counts(scores, state, width)
            above = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts
            qi, b = np.nonzero((counts > 0) & (above < state[:, 2:3]))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[qi]), pa.array(b.astype(np.int64)), pa.array(counts[qi, b].astype(np.int64))], ["vec_id", "bin", "n"])

    return pairs.mapInArrow(run, "vec_id bigint, bin bigint, n bigint")


def _last(pairs: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: scores above the query's kth value, and of the equal ones a block's ``k`` smallest ids."""

    def run(batches):
        for row in (row for batch in batches for row in _rows(batch)):
            q_ids, q = _opened(row["q_ids"], row["q_body"], row["dim"])
            v_ids, v = _opened(row["v_ids"], row["v_body"], row["dim"])
            kth = np.frombuffer(row["q_state"], np.int64).reshape(-1, 3)[:, :1]
            scores = _product(q, v)
            good = scores >= kth
            if np.intersect1d(q_ids, v_ids).size:
                good &= q_ids[:, None] != v_ids[None, :]
            r, c = np.nonzero(good)
            # A block's ids ascend, so a row's ties do.
            tie = scores[r, c] == kth[r, 0]
            upto = np.cumsum(tie)
            first = np.searchsorted(r, np.arange(len(q_ids)))
            rank = upto - (upto - tie)[np.minimum(first, max(len(r) - 1, 0))][r] if len(r) else upto
            few = ~tie | (rank <= k)
            r, c = r[few], c[few]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(v_ids[c]), pa.array(scores[r, c])], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: every query's ``k`` highest inner products with other rows.

    Both inputs are ``vec_id, q`` as ``quantised`` gives them, ids unique. Ties go to the
    smaller id; a query with fewer than ``k`` other vectors of its dimension gets all. No
    queries or no vectors: no rows.
    """
    def blocked(df, size, name):
        n = df.groupBy(F.size("q").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
        return written(_packed(df.join(n, F.size("q") == F.col("dim")).drop("dim"), size, name), name)

    def asked():
        return blocked(state.select("vec_id", "q", F.array("low", "high", "left").alias("state")), QUERIES, "qb")

    square = lambda: F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    blocks = blocked(vectors.withColumn("state", F.array().cast("array<bigint>")), VECTORS, "vb")
    longest = vectors.agg(F.max(F.sqrt(square()))).first()[0] or 0.0
    most = queries.agg(F.max(F.sqrt(square()))).first()[0]
    if most is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    # No score lies outside the product of the lengths.
    bound = int(most * longest * (1 + 1e-9)) + 1
    state = written(queries.selectExpr("vec_id", "q", f"{-bound}L AS low", f"{bound}L AS high", f"{k}L AS left"), "queries")
    width = 1
    while width * FAN < 2 * bound + 1:
        width *= FAN
    while width:
        tops = _tops(_pairs(asked(), blocks), width).groupBy("vec_id", "bin").agg(F.sum("n").alias("n"))
        # The bin where the count from above reaches what is left to find: at most FAN bins a query.
        bins = tops.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct(F.col("bin"), F.col("n"))), asc=False).alias("bins"))
        found = bins.join(state.select("vec_id", "left"), "vec_id").select(
            "vec_id",
            F.aggregate(
                "bins",
                F.struct(F.lit(-1).cast("bigint").alias("bin"), F.col("left").alias("left"), F.lit(False).alias("done")),
                lambda s, b: F.when(s["done"], s).otherwise(
                    F.struct(
                        b["bin"].alias("bin"),
                        F.when(b["n"] >= s["left"], s["left"]).otherwise(s["left"] - b["n"]).alias("left"),
                        (b["n"] >= s["left"]).alias("done"),
                    )
                ),
            ).alias("at"),
        )
        # Fewer vectors than k: the lowest bin, with the whole rest still to find.
        after = state.drop("left").join(found, "vec_id").select(
            "vec_id", "q", (F.col("low") + F.col("at.bin") * width).alias("low"),
            F.least("high", F.col("low") + (F.col("at.bin") + 1) * width - 1).alias("high"),
            F.when(F.col("at.done"), F.col("at.left")).otherwise(F.lit(k).cast("bigint")).alias("left"),
        )
        state = written(after, "queries")
        width //= FAN
    kept = _last(_pairs(asked(), blocks), k)
    # A limit per query that Spark also applies below the shuffle.
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
