"""Centroid clustering of integer vectors, filtered in a PCA-rotated space.

Every vector is stored once, beside its leading coordinates along the principal axes of the
whole table and the norm of what these leave out. For a vector x and a centroid c,

    |lead(x) - lead(c)|^2 + (rest(x) - rest(c))^2  <=  |x - c|^2,

so the leading coordinates alone rule most centroids out. The centroids that survive are
compared in integers, so results do not depend on the rotation or on rounding.

The principal axes come from sums over all vectors. What reaches the driver is bounded by
parameters: ``dim^2`` sums for the axes, and ``k * dim`` for the centroids of each round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.common import give_back, written

#: Leading coordinates stored of every vector.
LEAD = 12
#: Components beyond this could overflow a 64-bit squared distance.
MOST = 1 << 27
#: Rows that a task compares at a time.
ROWS = 4096


def quantised(vectors: DataFrame, dim: int = 64, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, q``: floor(scale * x) of the vectors with exactly ``dim`` components, none null or non-finite.

    Rows are kept as they are: repeated ids and rows without an id are vectors of their own.
    A component beyond ``MOST`` fails the query, as distances would leave 64 bits.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    usable = vectors.where(F.size(vector) == dim).where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    whole = F.transform(x, lambda v: F.when(F.abs(v * scale) < MOST, F.floor(v * scale)).otherwise(F.raise_error("component too large for exact distances")))
    return usable.select(F.col(key).cast("bigint").alias("vec_id"), whole.cast("array<bigint>").alias("q"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _pieces(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """``group, n, sums`` rows added up; the sums of a group cross as one row per position."""
    flat = parts.select("group", "n", F.posexplode("sums").alias("at", "s")).groupBy("group", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = {}
    for r in flat.orderBy("group", "at").toLocalIterator():
        out.setdefault(r.group, []).append((r.n, r.s))
    return out


_SUMS = "group int, n bigint, sums array<decimal(38,0)>"


def _rows_of(sums: dict[int, tuple[int, list[int]]]):
    groups = list(sums)
    from decimal import Decimal

    return pa.RecordBatch.from_arrays(
        [
            pa.array(groups, pa.int32()),
            pa.array([sums[g][0] for g in groups], pa.int64()),
            pa.array([[Decimal(v) for v in sums[g][1]] for g in groups], pa.list_(pa.decimal128(38, 0))),
        ],
        ["group", "n", "sums"],
    )


def principal_axes(q: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes (columns, strongest first) over all rows of ``q``.

    Each task adds up its vectors and their outer products. The axes only steer the filter,
    so double precision will do; the identity where there is no row.
    """

    def add(batches):
        give_back()
        n, total = 0, np.zeros(dim * (dim + 1))
        for part in _pieces(batches):
            x = _matrix(part, dim).astype(np.float64)
            n += len(x)
            total += np.concatenate([x.sum(0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([list(total)], pa.list_(pa.float64()))], ["n", "sums"])

    parts = q.select("q").mapInArrow(add, "n bigint, sums array<double>")
    rows = parts.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    if not rows or not rows[0].n:
        return np.zeros(dim), np.eye(dim)
    n, sums = rows[0].n, np.array([r.s for r in rows])
    mean = sums[:dim] / n
    spread = sums[dim:].reshape(dim, dim) / n - np.outer(mean, mean)
    _, axes = np.linalg.eigh((spread + spread.T) / 2)
    return mean, axes[:, ::-1]


def rotated(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates of the rows of ``x``, and the norm of their other coordinates."""
    z = (x - mean) @ axes
    return z[:, :lead], np.sqrt((z[:, lead:] ** 2).sum(1))


def stored(q: DataFrame, mean: np.ndarray, axes: np.ndarray, lead: int = LEAD) -> DataFrame:
    """``vec_id, q, lead, rest``: every vector with its leading rotated coordinates and residual norm."""
    dim = len(mean)

    def turn(batches):
        for part in _pieces(batches):
            leading, rest = rotated(_matrix(part, dim).astype(np.float64), mean, axes, lead)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rest) + 1) * leading.shape[1], pa.int32()), pa.array(leading.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("q"), flat, pa.array(rest)], ["vec_id", "q", "lead", "rest"])

    return q.mapInArrow(turn, "vec_id bigint, q array<bigint>, lead array<double>, rest double")


def nearest(x: np.ndarray, leading: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest row of ``centroids`` (ties: the smaller number), and how many pairs were verified.

    The lower bounds are reduced by more than rounding can have raised them. A centroid is
    verified in integers if its bound does not exceed the exact distance to the one with the
    least bound, so every nearest centroid is among them.
    """
    squares = (leading**2).sum(1)[:, None] + (c_lead**2).sum(1)[None, :]
    bound = squares - 2 * leading @ c_lead.T + (rest[:, None] - c_rest[None, :]) ** 2
    scale = squares + rest[:, None] ** 2 + c_rest[None, :] ** 2
    bound -= 1e-9 * scale + 1e-6
    guess = bound.argmin(1)
    best = ((x - centroids[guess]) ** 2).sum(1)
    # A 64-bit distance may round up to a double, never below what it has to be compared with.
    i, j = np.nonzero(bound <= best[:, None].astype(np.float64))
    exact = ((x[i] - centroids[j]) ** 2).sum(1)
    order = np.lexsort((j, exact, i))
    first = order[np.flatnonzero(np.r_[True, i[order][1:] != i[order][:-1]])] if len(order) else order
    return j[first].astype(np.int32), exact[first], len(i)


def _assigner(mean, axes, centroids, lead):
    """A function from a batch of ``stored`` to its clusters and distances."""
    c_lead, c_rest = rotated(centroids.astype(np.float64), mean, axes, lead)

    def assign(part: pa.RecordBatch):
        x = _matrix(part, len(mean))
        leading = part.column("lead").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        cluster, distance, _ = nearest(x, leading, part.column("rest").to_numpy(zero_copy_only=False), centroids, c_lead, c_rest)
        return x, cluster, distance

    return assign


def start(q: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, in that order (equal ids: by components).

    Rows without an id never start a cluster. Spark keeps ``k`` rows per task.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.q for r in q.where("vec_id IS NOT NULL").orderBy(digest, "q").limit(k).select("q").collect()]


def cluster(q: DataFrame, k: int = 16, rounds: int = 3, lead: int = LEAD, dim: int = 64) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` for every row of ``q``.

    ``rounds`` times, every vector goes to its nearest centroid, and every centroid that has
    vectors moves to the floor of their exact mean; then vectors are assigned once more.
    Fewer than ``k`` vectors give fewer clusters; repeated rows count each time; an empty
    table, or one without ids, gives no rows.
    """
    mean, axes = principal_axes(q, dim)
    vectors = written(stored(q, mean, axes, lead), "rotated")
    centroids = np.array(start(vectors.select("vec_id", "q"), k), np.int64).reshape(-1, dim)
    if not len(centroids):
        return _result(vectors.limit(0).selectExpr("vec_id", "0 AS cluster", "0L AS distance"), centroids)
    for _ in range(rounds):
        assign = _assigner(mean, axes, centroids, lead)

        def add(batches, assign=assign):
            sums: dict[int, list] = {}
            for part in _pieces(batches):
                x, own, _ = assign(part)
                for c in np.unique(own):
                    rows = x[own == c]  # ROWS * MOST is far inside 64 bits
                    n, total = sums.get(int(c), (0, [0] * x.shape[1]))
                    sums[int(c)] = (n + len(rows), [a + int(b) for a, b in zip(total, rows.sum(0), strict=True)])
            if sums:
                yield _rows_of(sums)

        centroids = centroids.copy()
        for c, cells in _summed(vectors.select("q", "lead", "rest").mapInArrow(add, _SUMS)).items():
            centroids[c] = [int(s) // n for n, s in cells]
    assign = _assigner(mean, axes, centroids, lead)

    def label(batches):
        for part in _pieces(batches):
            _, own, distance = assign(part)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(own), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return _result(written(vectors.mapInArrow(label, "vec_id bigint, cluster int, distance bigint"), "clusters"), centroids)


def _result(labelled: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Labelled vectors with the sums of their cluster and of all; one small row per centroid is joined."""
    spark = labelled.sparkSession
    of = spark.createDataFrame([(c, [int(v) for v in row]) for c, row in enumerate(centroids)], "cluster int, centroid array<bigint>")
    sums = labelled.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    small = sums.join(of, "cluster").withColumn("inertia", total.scalar())
    # At most one row per centroid.
    return labelled.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: list[int]) -> str:
    """SHA-256 of the components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
