"""Small goldens: chunks, links, tensors, lookups, vectors."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from agentlake.functions import vectors as V
from agentlake.operators import links as L
from agentlake.operators import lookups, tensors, transfers
from agentlake.operators import tokens as K
from agentlake.operators import vectors as Q


def test_chunk_plan(spark):
    manifest = spark.createDataFrame([(1, "a", 10), (1, "e", 0)], "transfer_id bigint, path string, size bigint")
    rows = transfers.chunk_plan(manifest, 4).orderBy("path", "chunk_no").collect()
    assert [(r.path, r.chunk_no, r.offset, r.actual_size, r.padded_size, r.is_end) for r in rows] == [
        ("a", 0, 0, 4, 4, False), ("a", 1, 4, 4, 4, False), ("a", 2, 8, 2, 4, False), ("a", 3, 10, 0, 0, True),
        ("e", 0, 0, 0, 0, True),
    ]


def test_first_valid(spark):
    rows = [("u", 10, 1, False), ("u", 20, 2, True), ("u", 30, 3, True), ("u", 40, 0, True),
            ("v", 11, 1, False), ("v", 41, 0, False), ("w", 12, 1, True), ("x", 13, 2, False)]
    df = spark.createDataFrame(rows, "k string, candidate int, priority int, valid boolean")
    assert {r.k: r.candidate for r in L.first_valid(df, "k").collect()} == {"u": 20, "v": 41, "w": 12}


def test_links(spark):
    up, down = "PORT_ACTIVE", "PORT_DOWN"
    rows = [(1, 0, 1, up), (1, 1, 0, up), (2, 0, 1, up), (2, 1, 0, down), (3, 0, 1, up),
            (4, 0, 1, up), (4, 1, 0, up), (4, 0, 2, up), (4, 2, 0, up), (4, 1, 2, up), (4, 2, 1, up), (4, 2, 2, down)]
    df = spark.createDataFrame(rows, "cluster_id int, src int, dst int, state string")
    usable = {(r.cluster_id, r.a, r.b): r.usable for r in L.mutual_links(df).collect()}
    assert usable == {(1, 0, 1): True, (2, 0, 1): False, (3, 0, 1): False, (4, 0, 1): True, (4, 0, 2): True, (4, 1, 2): True}
    aborts = {r.cluster_id: (r.nodes, r.links, r.abort) for r in L.all_links_active(df).collect()}
    assert aborts == {1: (2, 2, False), 2: (2, 2, True), 3: (2, 1, True), 4: (3, 6, False)}


def test_node_tier(spark):
    rows = [(1, 0, True), (1, 1, True), (1, 2, True), (2, 1, True), (2, 2, False), (3, 1, False), (3, 2, True), (4, 0, True)]
    df = spark.createDataFrame(rows, "cluster_id int, rank int, up boolean")
    assert {r.cluster_id: r.tier for r in L.node_tier(df).collect()} == {1: 3, 2: 2, 3: 1, 4: 1}


def test_device_matrix(spark):
    matrix = '[[null,"rdma_en3","rdma_en4"],["rdma_en4",null,"rdma_en3"],["rdma_en4","rdma_en3",null]]'
    edges = L.matrix_to_links(spark.createDataFrame([(1, matrix)], "cluster_id int, matrix string"))
    assert edges.count() == 6
    assert json.loads(L.links_to_matrix(edges).first().matrix) == json.loads(matrix)
    assert json.loads(L.links_to_matrix(edges.unionAll(edges)).first().matrix) == json.loads(matrix)


def catalog(spark, names):
    return spark.createDataFrame([(c, n, 8 + i) for i, (c, n) in enumerate(names)], "checkpoint_id int, name string, nbytes bigint")


def test_stack_experts(spark):
    moe = "model.layers.{}.block_sparse_moe.experts.{}.{}.weight"
    names = [(1, moe.format(0, e, w)) for e in (0, 1) for w in ("w1", "w2")] + [(1, moe.format(1, 0, "w3")), (1, moe.format(2, 1, "w1"))]
    names += [(1, "lm_head.weight"), (2, moe.format(1, 0, "w1")), (3, "model.layers.0.mlp.experts.0.up_proj.weight")]
    rows = tensors.stack_experts(catalog(spark, names), 2, tied=True).collect()
    got = {(r.checkpoint_id, r.name): (r.experts, r.error) for r in rows}
    stacked = "model.layers.{}.block_sparse_moe.switch_mlp.{}.weight"
    assert got == {
        (1, stacked.format(0, "gate_proj")): ([8, 10], None),
        (1, stacked.format(0, "down_proj")): ([9, 11], None),
        (1, stacked.format(1, "up_proj")): ([12], "missing expert"),
        (1, moe.format(2, 1, "w1")): (None, None),
        (2, moe.format(1, 0, "w1")): (None, None),
        (3, "model.layers.0.mlp.switch_mlp.up_proj.weight"): ([16], "missing expert"),
    }


def test_pair_scale_rows(spark):
    rows = tensors.pair_scale_rows(catalog(spark, [(1, "a.weight"), (1, "a.weight_scale_inv"), (1, "b.weight"), (1, "c.weight_scale_inv")])).collect()
    assert {r.name: (r.nbytes, r.dequantised, r.error) for r in rows} == {
        "a.weight": (8, True, None), "b.weight": (10, False, None), "c.weight": (None, False, "scale without weight"),
    }


def test_bytes_without_layers(spark):
    assert tensors.bytes_per_group(catalog(spark, [(1, "embed.weight")])).first().bytes_per_layer == 1.0


def test_contained_in_equals_brute_force(spark):
    rng = random.Random(2)
    vocab = ["ab", "abc", "b", "xyz", "the", "of", "zz"]

    def prose(n):
        return "".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "  "]) for _ in range(n))

    texts = [(i, prose(rng.choice([0, 3, 40]))) for i in range(60)]
    patterns = []
    for size in (1, 2, 3, 5, 7, 20, 40, 70):
        for _ in range(6):
            source = rng.choice([t for _, t in texts if len(t) > size])
            start = rng.randrange(len(source) - size)
            patterns.append(source[start : start + size])
    patterns += ["nowhere", "q", "the the the the the the the the the the the the"]
    ids = list(enumerate(patterns))
    got = lookups.contained_in(
        spark.createDataFrame(ids, "pid int, passage string"), spark.createDataFrame(texts, "tid int, body string"),
        "passage", "body", "pid", "tid",
    )
    want = sorted((p, t) for p, pattern in ids for t, text in texts if pattern in text)
    assert sorted((r.pid, r.tid) for r in got.collect()) == want


def test_lookup_docs(spark):
    requests = spark.createDataFrame([(i, "lib", "q") for i in range(5)], "id int, library string, topic string")
    primary = spark.createDataFrame([(0, "P"), (1, "call FAILED"), (2, "P2"), (4, "")], "id int, text string")
    secondary = spark.createDataFrame([(1, "S"), (2, "S2"), (3, "has failed")], "id int, text string")
    answers = {r.id: r.answer for r in lookups.lookup_docs(requests, primary, secondary, "id").collect()}
    nothing = "No documentation found for 'lib' - 'q'"
    assert answers == {0: "P", 1: "[Context7]\nS", 2: "P2\n\n[Context7]\nS2", 3: nothing, 4: nothing}


def test_reconcile(spark):
    schema = "transfer_id int, path string, size bigint"
    sent = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", 7)], schema)
    received = spark.createDataFrame([(1, "a", 5), (1, "c", 1), (2, "a", 6)], schema)
    rows = transfers.reconcile_manifests(sent, received).collect()
    assert {(r.transfer_id, r.path): r.status for r in rows} == {(1, "a"): "ok", (1, "b"): "missing", (1, "c"): "extra", (2, "a"): "size_mismatch"}


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "v array<float>, d array<double>")
    row = df.select(
        V.norm(F.col("v")).alias("n"), V.reject(F.col("v"), F.col("d")).alias("r"), V.softmax(F.col("v")).alias("s"),
        V.block_scale(F.array(*[F.lit(float(i)) for i in range(5)]), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 2).alias("b"),
    ).first()
    assert (row.n, row.r, row.b) == (5.0, [0.0, 4.0], [0.0, 1.0, 4.0, 6.0, 12.0])
    assert math.isclose(sum(row.s), 1.0) and math.isclose(row.s[1] / row.s[0], math.e)


def test_topk_ties_and_bias(spark):
    df = spark.createDataFrame([(1, [0.0, 2.0, 2.0, 1.0])], "id int, v array<double>")
    assert [r.idx for r in Q.vector_topk(df, "v", 3).orderBy("rank").collect()] == [1, 2, 3]
    bias = F.array(*[F.lit(x) for x in (9.0, 0.0, 0.0, 0.0)])
    rows = Q.vector_topk(df, "v", 2, mode="sigmoid", bias=bias).orderBy("rank").collect()
    assert [r.idx for r in rows] == [0, 1]
    sigmoids = [0.5, 1 / (1 + math.exp(-2.0))]
    assert [round(r.weight, 9) for r in rows] == [round(s / sum(sigmoids), 9) for s in sigmoids]


def test_best_trial_tie(spark):
    trials = spark.createDataFrame([("s", 2, 0.5, 0.1), ("s", 1, 0.5, 0.1), ("s", 3, 0.9, 0.0)], "study string, trial int, a double, b double")
    best = Q.best_trial(Q.trial_scores(trials, {"a": 0.7, "b": 0.3})).first()
    assert (best.trial, best.a) == (1, 0.5)


def test_reject_without_direction(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "k int, vec array<double>")
    directions = spark.createDataFrame([(1, [1.0, 0.0])], "k int, direction array<double>")
    got = {r.k: (r.projection, r.rejected) for r in Q.reject_direction(rows, directions, ["k"], "vec").collect()}
    assert got == {1: (1.0, [0.0, 2.0]), 2: (0.0, [3.0, 4.0])}


@pytest.mark.parametrize("block", [2, 1 << 16])
def test_last_segment(spark, block):
    reads = spark.createDataFrame([("a", 1, "he"), ("a", 3, "hello"), ("a", 2, "he"), ("b", 1, "")], "k string, n bigint, text string")
    rows = K.last_segment(reads, "k", "n").orderBy("k", "n").collect()
    assert [(r.k, r.n, r.segment) for r in rows] == [("a", 1, "he"), ("a", 2, ""), ("a", 3, "llo"), ("b", 1, "")]


def test_requests_are_split_in_one_pass(spark):
    from agentlake.session import shared_dir

    hosts = spark.createDataFrame([("a", 0, "10.0.0.1"), ("b", 1, "10.0.0.2"), ("also-a", 0, "10.0.0.1")], "host string, rank int, ip string")
    asked = [(1, "a", "b"), (2, "a", "x"), (3, "y", "x"), (4, "a", "also-a"), (5, "b", "a"), (6, None, "a")]
    checked = transfers.check_requests(spark.createDataFrame(asked, "request_id int, source string, dest string"), hosts)
    path = shared_dir(spark, "requests")
    transfers.write_requests(checked, path)
    good = transfers.read_requests(spark, path, checked.schema, "accepted")
    bad = transfers.read_requests(spark, path, checked.schema, "rejected")
    assert sorted(r.request_id for r in good.collect()) == [1, 5] and "error" not in good.columns and "verdict" not in bad.columns
    assert {r.request_id: (r.error or "").split(" ")[0] for r in bad.collect()} == {2: "Unknown", 3: "Unknown", 4: "Source", 6: "Unknown"}
    only = shared_dir(spark, "requests")
    transfers.write_requests(checked.where("request_id = 1"), only)
    assert transfers.read_requests(spark, only, checked.schema, "rejected").count() == 0


def test_dominated_area_against_brute_force(spark):
    from agentlake.operators import vectors

    rng = random.Random(4)
    rows = [(rng.choice("xyz"), float(rng.randint(0, 12)), float(rng.randint(0, 12))) for _ in range(400)] + [("x", None, 1.0), ("y", float("nan"), 2.0), ("z", 1.0, None), ("far", 11.0, 3.0), (None, 1.0, 9.0), (None, 2.0, 2.0)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "study string, a double, b double, n int").repartition(6)
    got = {r.study: (r.trials, r.front, r.area) for r in vectors.dominated_area(df, "a", "b", (10.0, 10.0)).collect()}
    for study in {r[0] for r in rows}:
        own = [(a, b) for s, a, b in rows if s == study]
        good = {(a, b) for a, b in own if a is not None and b is not None and a < 10 and b < 10}
        front = {p for p in good if not any(q != p and q[0] <= p[0] and q[1] <= p[1] for q in good)}
        area = sum(any(a <= i and b <= j for a, b in good) for i in range(10) for j in range(10))
        assert got[study] == (len(own), len(front), float(area))
    assert vectors.dominated_area(df.limit(0), "a", "b", (10.0, 10.0)).count() == 0
