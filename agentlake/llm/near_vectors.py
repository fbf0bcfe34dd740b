"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

Rotations are learnt on a bounded sample so that the signs of the rotated vector are
balanced bits that keep angles (principal axes, then alternating between signs and the
best rotation for them). Every vector gets one code per rotation. Each code is cut into
substrings; a table per substring brings together the vectors that agree on it, which by
the pigeonhole principle are all pairs within a Hamming distance below the number of
substrings, and most pairs beyond. What meets is compared by the cosine of the original
vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.common import written
from agentlake.llm.graph import components

#: Rotations, and the substrings that each code of up to 64 bits is cut into.
ROTATIONS, PARTS = 3, 5
#: Vectors of a table's bucket that one task compares with as many others.
BUCKET = 1024
SAMPLE = 4096


def learn_rotations(sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = 30) -> list[np.ndarray]:
    """Projections of unit vectors to codes of up to 64 bits."""
    dim = sample.shape[1]
    bits = min(64, dim)
    _, _, axes = np.linalg.svd(sample, full_matrices=True)
    axes = axes[:bits].T
    z = sample @ axes
    out = []
    for seed in range(rotations):
        rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(z @ rotation).T @ z)
            rotation = (u @ v).T
        out.append(axes @ rotation)
    return out


def substrings(vectors: np.ndarray, projections: list[np.ndarray], parts: int = PARTS) -> np.ndarray:
    """One row per vector: the substrings of its codes as integers, a column per table."""
    columns = []
    for p in projections:
        bits = (vectors @ p > 0).astype(np.int64)
        for piece in np.array_split(np.arange(bits.shape[1]), min(parts, bits.shape[1])):
            columns.append(bits[:, piece] @ (1 << np.arange(len(piece))))
    return np.stack(columns, 1)


def unit_vectors(body: list, dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(body), np.float64).reshape(-1, dim)
    # Scaled first, so that squares neither overflow nor vanish.
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _hits(left, right, least: float):
    """Pairs ``(i, j, first table)`` of two blocks with cosine of at least ``least``; i < j within one block."""
    (ids_a, v_a, s_a), (ids_b, v_b, s_b) = left, right
    i, j = np.nonzero(v_a @ v_b.T >= least)
    keep = ids_a[i] < ids_b[j] if left is right else np.ones(len(i), bool)
    i, j = i[keep], j[keep]
    first = np.full(len(i), s_a.shape[1])
    todo = np.arange(len(i))
    for t in range(s_a.shape[1]):
        same = s_a[i[todo], t] == s_b[j[todo], t]
        first[todo[same]] = t
        todo = todo[~same]
    return i, j, first


def near_links(vectors: DataFrame, least: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Links between distinct vectors with cosine of at least ``least``.

    ``vectors``: ``vec_id, body, weight``; ``body`` is the packed double-precision vector,
    ``weight`` the number of rows that share it. Returns ``vec_id, n`` (weights of the linked
    vectors, to be summed) and links ``a, b`` that connect what is linked, a spanning part of
    all of them.
    """
    dims = [r.dim for r in vectors.select((F.octet_length("body") / 8).cast("int").alias("dim")).distinct().collect()]
    projections = {}
    for dim in dims:
        rows = vectors.where(F.octet_length("body") == 8 * dim).orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("body").collect()
        projections[dim] = learn_rotations(unit_vectors([bytes(r.body) for r in rows], dim))

    def place(batches):
        for batch in batches:
            bodies = [bytes(b) for b in batch.column("body").to_pylist()]
            ids, weights = batch.column("vec_id"), batch.column("weight")
            sizes = np.array([len(b) // 8 for b in bodies], np.int64)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                codes = substrings(unit_vectors([bodies[r] for r in rows], int(dim)), projections[int(dim)])
                take = pa.array(rows)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), weights.take(take), batch.column("body").take(take), packed, pa.array(np.full(len(rows), dim), pa.int32()), pa.array(list(codes), pa.list_(pa.int64()))],
                    ["vec_id", "weight", "body", "codes", "dim", "buckets"],
                )

    coded = written(vectors.select("vec_id", "body", "weight").mapInArrow(place, "vec_id bigint, weight bigint, body binary, codes binary, dim int, buckets array<bigint>"), "codes")
    seats = coded.select("vec_id", "weight", "body", "codes", "dim", F.posexplode("buckets").alias("tab", "bucket"))
    # A bucket above BUCKET vectors is cut into parts, and every pair of parts is a group of its own.
    many = coded.select("dim", F.posexplode("buckets").alias("tab", "bucket")).groupBy("dim", "tab", "bucket").agg(F.count(F.lit(1)).alias("n"))
    many = many.where("n > 1").withColumn("parts", F.ceil(F.col("n") / BUCKET).cast("bigint")).drop("n")
    part = seats.join(many, ["dim", "tab", "bucket"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))
    pair = part.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    keyed = pair.select(
        "dim", "tab", "bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "vec_id", "weight", "body", "codes",
    )
    sorted_ = keyed.repartition("dim", "tab", "bucket", "p", "q").sortWithinPartitions("dim", "tab", "bucket", "p", "q", "vec_id")

    def compare(batches):
        held = None
        for batch in batches:
            got = batch.to_pandas()
            held = got if held is None else pd.concat([held, got], ignore_index=True)
            k = held[["dim", "tab", "bucket", "p", "q"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1)])) if len(k) else np.zeros(1, np.int64)
            yield from _groups(held.iloc[: starts[-1]], starts, least)
            held = held.iloc[starts[-1] :]
        if held is not None and len(held):
            yield from _groups(held, np.zeros(1, np.int64), least)

    found = written(sorted_.mapInArrow(compare, "vec_id bigint, n bigint, root bigint"), "found")
    return found.select("vec_id", "n"), found.where("root <> vec_id").select(F.col("vec_id").alias("a"), F.col("root").alias("b")).distinct()


def _groups(rows: pd.DataFrame, starts: np.ndarray, least: float):
    """Compares the rows of each group; one row per vector with links: sum of weights, smallest vector met."""
    ids_out, n_out, root_out = [], [], []
    ends = np.append(starts[1:], len(rows)) if len(rows) > starts[-1] else starts[1:]
    ids, weights = rows["vec_id"].to_numpy(np.int64), rows["weight"].to_numpy(np.int64)
    dims, tabs, part, p, q = (rows[c].to_numpy(np.int64) for c in ("dim", "tab", "part", "p", "q"))
    bodies, codes = rows["body"].to_list(), rows["codes"].to_list()
    for s, e in zip(starts, ends, strict=False):
        if e - s < 2:
            continue
        own = slice(s, e)
        v = unit_vectors(bodies[own], int(dims[s]))
        sub = np.frombuffer(b"".join(codes[own]), np.int64).reshape(e - s, -1)
        if p[s] == q[s]:
            one = (ids[own], v, sub)
            i, j, first = _hits(one, one, least)
        else:
            a, b = np.flatnonzero(part[own] == p[s]), np.flatnonzero(part[own] == q[s])
            i, j, first = _hits((ids[own][a], v[a], sub[a]), (ids[own][b], v[b], sub[b]), least)
            i, j = a[i], b[j]
        if not len(i):
            continue
        n = np.zeros(e - s, np.int64)
        new = first == tabs[s]  # a pair counts in the first table where it meets
        np.add.at(n, i[new], weights[own][j[new]])
        np.add.at(n, j[new], weights[own][i[new]])
        root = ids[own].copy()
        while True:
            before = root.copy()
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            if (before == root).all():
                break
        touched = np.unique(np.concatenate([i, j]))
        ids_out.append(ids[own][touched])
        n_out.append(n[touched])
        root_out.append(root[touched])
    if ids_out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids_out, n_out, root_out)], ["vec_id", "n", "root"])


def near_duplicates(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every vector.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different dimensions. A repeated id counts once, with its
    smallest vector; rows without an id come back each with no links and a null component.
    Equal vectors are compared once and count with their number of rows.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("vec_id"), x.alias("x")).groupBy("vec_id").agg(F.min("x").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = rows.where(F.col("x").isNotNull() & finite & F.exists("x", lambda v: v != 0))

    def pack(batches):
        for batch in batches:
            column = batch.column("x")
            values, sizes = column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy()
            ends = np.cumsum(sizes)
            bodies = [values[e - n : e].astype(np.float64).tobytes() for e, n in zip(ends, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(bodies, pa.binary())], ["vec_id", "body"])

    packed = written(usable.mapInArrow(pack, "vec_id bigint, body binary"), "vectors")
    same = packed.groupBy("body").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    reps = written(same.select(F.col("rep").alias("vec_id"), "body", "weight"), "distinct")
    counts, links = near_links(reps, least)
    joined = components(links)
    member = packed.join(reps.select("body", F.col("vec_id").alias("rep"), "weight"), "body").select("vec_id", "rep", "weight")
    linked = (
        member.join(counts.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("n").alias("n")), "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = rows.select("vec_id").join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    none = vectors.where(F.col(key).isNull()).select(
        F.col(key).cast("bigint").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("component_id")
    )
    return out.unionAll(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
