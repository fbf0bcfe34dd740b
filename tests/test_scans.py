"""Blocked scans against pandas, with blocks small enough to matter."""

import random
import re

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from agentlake.operators import scans, splits
from agentlake.operators import sessions as S
from agentlake.plans import tables


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for key in range(4):
        orders = rng.sample(range(3000), [300, 20, 17, 9][key])
        data += [(key, o, rng.randint(0, 9), rng.random() < 0.1) for o in orders]
    rng.shuffle(data)
    return pd.DataFrame(data, columns=["k", "o", "v", "r"])


def frame(spark, rows):
    return spark.createDataFrame(rows, "k bigint, o bigint, v bigint, r boolean")


def sorted_rows(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("levels", [1, 2, 3])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum(spark, rows, levels, inclusive):
    want = rows.sort_values(["k", "o"])
    want["s"] = want.groupby("k")["v"].cumsum() - (0 if inclusive else want["v"])
    got = scans.running(frame(spark, rows), ["k"], "o", "v", "s", inclusive, levels, block=16)
    assert sorted_rows(got, ["k", "o", "s"]) == sorted(map(tuple, want[["k", "o", "s"]].values.tolist()))


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_running_since_reset(spark, rows, levels):
    want = []
    for key, group in rows.sort_values(["k", "o"]).groupby("k"):
        total = 0
        for row in group.itertuples():
            total = row.v if row.r else total + row.v
            want.append((key, row.o, total))
    got = scans.running_since_reset(frame(spark, rows), ["k"], "o", "v", "r", "s", levels, block=16)
    assert sorted_rows(got, ["k", "o", "s"]) == sorted(want)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_previous(spark, rows, levels):
    want = rows.sort_values(["k", "o"])
    want["p"] = want.groupby("k")["v"].shift().fillna(-1).astype(int)
    got = scans.previous(frame(spark, rows), ["k"], "o", "v", "p", levels, block=16).fillna({"p": -1})
    assert sorted_rows(got, ["k", "o", "p"]) == sorted(map(tuple, want[["k", "o", "p"]].values.tolist()))


def test_dense_index_without_keys(spark, rows):
    unique = rows.drop_duplicates("o")
    got = scans.dense_index(frame(spark, unique), "o", levels=3, block=16)
    orders = sorted(unique["o"])
    assert {r.o: r.idx for r in got.collect()} == {o: i for i, o in enumerate(orders)}


@pytest.mark.parametrize("n, buckets, sizes", [(7, 3, [3, 2, 2]), (2, 5, [1, 1]), (10, 5, [2] * 5), (1, 1, [1])])
def test_equal_split(spark, n, buckets, sizes):
    items = spark.range(n).withColumnRenamed("id", "idx")
    got = splits.equal_split(items, buckets).groupBy("bucket").count().orderBy("bucket").collect()
    assert [r["count"] for r in got] == sizes
    tiles = {r.idx: r.bucket for r in splits.equal_split(items, buckets).collect()}
    assert [tiles[i] for i in range(n)] == sorted(tiles.values())


def reference_split(capacities, n, total, item_overhead, node_overhead):
    """Plain restatement of the documented rules for one cluster."""
    b = total / n if n else 1.0
    fit = [max(1, int((c - node_overhead) / (b + item_overhead))) for c in capacities]
    cap = [max(f * b, b) for f in fit]
    most = [max(1, int((c + max(1, int(c / b)) * item_overhead) / (b + item_overhead))) for c in cap]
    counts = [min(max(1, int(n * c / sum(cap))), m) for c, m in zip(cap, most)][:-1]
    counts.append(n - sum(counts))
    if counts[-1] > most[-1]:
        excess, counts[-1] = counts[-1] - most[-1], most[-1]
        counts[cap.index(max(cap))] += excess
    return counts


def test_proportional_split(spark):
    rng = random.Random(11)
    nodes, loads, want = [], [], {}
    gb = 1024**3
    for cluster in range(40):
        size, n = rng.randint(1, 5), rng.choice([1, 2, 5, 48, 94, 200])
        total = rng.randint(1, 300) * gb
        capacities = [float(rng.choice([2, 8, 48, 64, 256]) * gb) for _ in range(size)]
        nodes += [(cluster, rank, c) for rank, c in enumerate(capacities)]
        loads.append((cluster, n, float(total)))
        want[cluster] = reference_split(capacities, n, total, splits.ITEM_OVERHEAD, splits.NODE_OVERHEAD)
    nodes += [(99, 0, 1.0), (99, 1, None), (99, 2, 3.0)]
    loads.append((99, 7, 7.0))
    want[99] = [3, 2, 2]
    got = splits.proportional_split(
        spark.createDataFrame(nodes, "cluster_id int, rank int, capacity double"),
        spark.createDataFrame(loads, "cluster_id int, n_items bigint, total_bytes double"),
    )
    counts = {(r.cluster_id, r.rank): (r["items"], r.clamped) for r in got.collect()}
    for cluster, values in want.items():
        for rank, value in enumerate(values):
            assert counts[cluster, rank] == (max(value, 0), value < 0), (cluster, values)
    ranges = splits.reverse_offsets(got).where("cluster_id = 99").orderBy("rank").collect()
    assert [(r.start_idx, r.end_idx) for r in ranges] == [(4, 7), (2, 4), (0, 2)]


def test_assign_ranges_with_small_blocks(spark):
    bounds = spark.createDataFrame(
        [(1, 0, 50, 100), (1, 1, 20, 50), (1, 2, 0, 20), (1, 3, 20, 20), (2, 0, 0, 7)],
        "cluster_id int, rank int, start_idx bigint, end_idx bigint",
    )
    items = spark.range(100).selectExpr("1 AS cluster_id", "id AS idx").unionByName(spark.range(7).selectExpr("2 AS cluster_id", "id AS idx"))
    got = splits.assign_ranges(items, bounds, top=4, bits=2)
    assert got.count() == 107
    wrong = got.where("rank <> CASE WHEN cluster_id = 2 OR idx >= 50 THEN 0 WHEN idx >= 20 THEN 1 ELSE 2 END")
    assert wrong.count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 200)), min_size=1, max_size=6), st.sampled_from([(16, 4), (4, 2), (6, 3), (2, 1), (0, 4)]))
def test_aligned_intervals_cover_each_range_once(spark, ranges, shape):
    top, bits = shape
    bounds = spark.createDataFrame([(1, i, a, a + n) for i, (a, n) in enumerate(ranges)], "cluster_id int, rank int, start_idx bigint, end_idx bigint")
    held, pieces = {}, {}
    for r in splits.aligned_intervals(bounds, top, bits).collect():
        for p in range(r.slot << r["shift"], (r.slot + 1) << r["shift"]):
            assert p not in held.setdefault(r["rank"], set())
            held[r["rank"]].add(p)
        pieces[r["rank"], r["shift"]] = pieces.get((r["rank"], r["shift"]), 0) + 1
    assert held == {i: set(range(a, a + n)) for i, (a, n) in enumerate(ranges) if n}
    assert all(n <= 2 * ((1 << bits) - 1) for (_, shift), n in pieces.items() if shift < top)


def test_narrow_and_overlapping_ranges(spark):
    """Rows in proportion to the items, however many ranges a block of positions holds."""
    one = spark.range(1 << 16).selectExpr("1 AS cluster_id", "CAST(id AS INT) AS rank", "id AS start_idx", "id + 1 AS end_idx")
    assert splits.aligned_intervals(one).count() == 1 << 16
    items = spark.range(0, 1 << 16, 7).selectExpr("1 AS cluster_id", "id AS idx")
    got = splits.assign_ranges(items, one)
    assert got.count() == items.count() and got.where("idx <> rank").count() == 0
    wide = spark.createDataFrame([(1, 0, 0, 10**7), (1, 1, 5, 9), (1, 2, 8, 70_000)], "cluster_id int, rank int, start_idx bigint, end_idx bigint")
    found = splits.assign_ranges(spark.createDataFrame([(1, 8), (1, 4), (1, 9_999_999), (1, 10**7), (1, 69_999)], "cluster_id int, idx bigint"), wide)
    assert sorted((r.idx, r["rank"]) for r in found.collect()) == [(4, 0), (8, 0), (8, 1), (8, 2), (69_999, 0), (69_999, 2), (9_999_999, 0)]


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_dense_order_of_strings(spark, bits):
    rng = random.Random(bits)
    rows = sorted({(rng.randint(0, 2), rng.choice(["a", "é", "Z", "zz"]) * rng.randint(0, 3) + str(rng.randint(0, 10**6))) for _ in range(3000)})
    df = spark.createDataFrame(rows, "k int, s string").repartition(7)
    got = {(r.k, r.s): r.ord for r in scans.dense_order(df, "s", "ord", ["k"], bits=bits, sample=4).collect()}
    for k in range(3):
        own = sorted((s for key, s in rows if key == k), key=str.encode)
        assert [got[k, s] for s in own] == list(range(len(own)))
    same = spark.createDataFrame([("x",)] * 50 + [("a",), ("z",)], "s string")
    both = sorted((r.s, r.ord) for r in scans.dense_order(same, "s", bits=bits).collect())
    assert both == [("a", 0), *[("x", i) for i in range(1, 51)], ("z", 51)]
    assert scans.dense_order(same.limit(0), "s", bits=bits).count() == 0



def test_cumulative_tokens_of_one_hot_session(spark):
    turns = spark.range(5000).selectExpr("1L AS session_id", "id AS seq", "id % 7 AS tokens", "id % 900 = 0 AS fresh")
    got = S.cumulative_tokens(turns, 100, reset="fresh", block=64).orderBy("seq").collect()
    total = 0
    for row in got:
        total = row.tokens if row.fresh else total + row.tokens
        assert (row.cached_tokens, row.over_limit) == (total, total > 100)


@pytest.mark.parametrize("levels", [2, 3])
def test_large_order_values_of_one_key(spark, levels):
    """Values near 2^60, all of one key, far apart and close together."""
    orders = sorted({(1 << 60) - 1 - (i * i << (i % 40)) for i in range(300)})
    df = spark.createDataFrame([("k", o, i, i % 7 == 0) for i, o in enumerate(orders)], "k string, o bigint, v bigint, r boolean")
    total = scans.running(df, ["k"], "o", "v", "s", levels=levels)
    both = scans.previous(scans.running_since_reset(total, ["k"], "o", "v", "r", "t", levels=levels), ["k"], "o", "v", "p", levels=levels)
    for i, row in enumerate(both.orderBy("o").collect()):
        assert (row.s, row.t, row.p) == (sum(range(i + 1)), sum(range(i - i % 7, i + 1)), i - 1 if i else None)


def test_running_in_bounded_parts(spark):
    """Large tables are dealt to partitions that follow their size, with the same sums."""
    most = scans.PART_ROWS
    assert scans.parts_for(spark, 8 * most) is None
    assert [scans.parts_for(spark, n * most) for n in (100, 1000)] == [100, 1000]
    rows = [(k, i, (i * 7 + k) % 5) for k in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "k bigint, i bigint, v bigint")
    got, plain = (scans.running(df, ["k"], "i", "v", "s", block=4, parts=p) for p in (11, None))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert any("hashpartitioning(k, _blk2, 11)" in re.sub(r"#\d+L?", "", line) for line in plan_of(got))


def test_large_manifests_are_dealt_before_they_are_summed(spark, sf_dir, monkeypatch):
    small = tables.manifest(spark, sf_dir)
    assert tables.chunk_parts(spark, sf_dir) is None
    monkeypatch.setattr(tables, "PART_ROWS", 128)
    large = tables.manifest(spark, sf_dir)
    plan = plan_of(large)
    dealt = next(i for i, line in enumerate(plan) if "REPARTITION_BY_NUM" in line)
    assert not any("Aggregate" in line for line in plan[dealt:])
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, small.collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")
