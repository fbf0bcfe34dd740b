"""Archive, clustering and ranked search against brute force, and on nulls, ties, repeats, empty and odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlake.llm import centroids, lexical, warc
from agentlake.session import shared_dir


def fixed(values):
    return hashlib.sha256(values.encode()).hexdigest()


# -- archive ------------------------------------------------------------------------------

LONG, BLANKS = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 20, "x" * 100
PAGES = [
    (5, "http://a/5", LONG), (3, "http://a/3\r\nWARC-Type: fake", LONG), (9, None, LONG), (None, "http://n", LONG),
    (4, "u", BLANKS), (4, "u", BLANKS), (2, "u", "y" * 99), (1, "u", "y" * 99), (7, "u", None), (8, "u", ""),
    (None, "u", "only without id " * 10), (-6, "u", "z" * 101), (10, "u", "z" * 101),
]


def pages(spark, rows=PAGES):
    data = [(*r, "sha", "first", b"\x00") for r in rows]
    return spark.createDataFrame(data, "page_id bigint, url string, html string, digest string, first string, payload binary")


def archive(spark, df, **kw):
    path = shared_dir(spark, "archive")
    warc.write_archive(df, path, **kw)
    return path


def test_archive_keeps_every_record(spark):
    path = archive(spark, pages(spark))
    got = warc.parse_records(warc.read_archive(spark, path)).collect()
    texts = Counter((r[2] or "").encode() for r in PAGES)
    low = {t: min((r[0] for r in PAGES if (r[2] or "").encode() == t and r[0] is not None), default=None) for t in texts}
    want = Counter()
    for page, _, html in PAGES:
        raw = (html or "").encode()
        again = len(raw) >= 100 and low[raw] is not None and page != low[raw]
        want[page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", low[raw] if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.digest == r.payload_digest for r in got)
    uris = {r.page_id: r.target_uri for r in got if r.page_id is not None}
    assert uris[9] is None and uris[3] == "http://a/3%0D%0AWARC-Type: fake"
    # Every payload once, and responses carry it to the byte.
    assert spark.read.parquet(f"{path}/payloads").count() == len(texts)
    records = {r.page_id: bytes(r.record) for r in warc.read_archive(spark, path).collect() if r.page_id in (3, 5)}
    assert records[3].endswith(b"\r\n\r\n" + LONG.encode() + b"\r\n\r\n") and LONG.encode() not in records[5]


def test_archive_through_files(spark):
    path = archive(spark, pages(spark))
    files = shared_dir(spark, "warc-files")
    back = warc.read_archive(spark, path)
    warc.export_files(back, files, per_file=2)
    assert len(spark.read.format("binaryFile").load(files).select("path").collect()) >= 7
    again = warc.import_files(spark, files).collect()
    want = Counter(bytes(r.record) for r in back.collect())
    assert Counter(bytes(r.header) + bytes(r.payload) + b"\r\n\r\n" for r in again) == want
    assert all(hashlib.sha256(bytes(r.payload)).hexdigest() == r.digest for r in again if r.record_type == "response")


def test_archive_refuses_damage(spark):
    path = archive(spark, pages(spark))
    stored = spark.read.parquet(f"{path}/payloads")
    bad = shared_dir(spark, "bad")
    spark.read.parquet(f"{path}/records").write.parquet(f"{bad}/records")
    stored.withColumn("payload", warc.packed(F.concat(warc.unpacked("payload"), F.lit(b"!")))).write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archive(spark, bad).collect()
    gone = shared_dir(spark, "gone")
    spark.read.parquet(f"{path}/records").write.parquet(f"{gone}/records")
    stored.where(F.octet_length(warc.unpacked("payload")) > 0).write.parquet(f"{gone}/payloads")
    with pytest.raises(Exception, match="no payload for digest"):
        warc.read_archive(spark, gone).collect()
    cut = warc.read_archive(spark, path).withColumn("record", F.expr("substring(record, 1, octet_length(record) - 1)"))
    with pytest.raises(Exception, match="cut record"):
        warc.parse_records(cut).collect()
    files = shared_dir(spark, "cut-files")
    warc.export_files(warc.read_archive(spark, path).where("page_id = 2"), files)
    content = spark.read.format("binaryFile").load(files).select(F.expr("CAST(substring(content, 1, octet_length(content) - 6) AS STRING) AS value"))
    content.write.option("lineSep", "\n").text(f"{files}-short")
    with pytest.raises(Exception, match="cut off"):
        warc.import_files(spark, f"{files}-short").collect()


def test_archive_empty_and_hot(spark, monkeypatch):
    empty = archive(spark, pages(spark).limit(0))
    assert warc.parse_records(warc.read_archive(spark, empty)).count() == 0
    monkeypatch.setattr(warc, "SHARE", 8)
    monkeypatch.setattr(warc, "HEAVY", 16)
    many = [(i, f"u{i}", "h" * 200 if i % 3 == 0 else "t" if i % 3 == 1 else f"own {i} " * 20) for i in range(600)]
    path = archive(spark, pages(spark, many))
    got = warc.parse_records(warc.read_archive(spark, path))
    assert got.count() == 600 and got.where("record_type = 'revisit' AND refers_to = 0").count() == 199
    assert spark.read.parquet(f"{path}/records").select("digest", "share").distinct().count() > 200 + 2 * 20
    assert spark.read.parquet(f"{path}/payloads").count() == 202


# -- clusters -----------------------------------------------------------------------------


def brute_clusters(rows, k=16, rounds=3):
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in rows if i is not None)[:k]
    cents = [list(q) for _, q in order]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cents)) for _, q in rows]

    for _ in range(rounds):
        own = assign()
        for j in range(len(cents)):
            mine = [q for (_, q), (_, c) in zip(rows, own, strict=True) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return assign(), cents


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, [9], 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, cluster int, q array<int>, rest double")


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 64))
    rows = [(i, (centres[rng.integers(20)] + 0.4 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(120)]  # a hot copy
    rows += [(7, rows[9][1]), (7, rows[7][1]), (None, rows[3][1])]  # repeated ids, and none
    odd = [(1000, None), (1001, [1.0] * 63), (1002, [float("nan")] * 64), (1003, [float("inf")] + [0.0] * 63), (1004, [None] + [0.0] * 63), (1005, [])]
    q = centroids.quantised(vectors(spark, rows + odd))
    got = centroids.cluster(q).collect()
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    own, cents = brute_clusters(ints)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter((i, c, d) for (i, _), (d, c) in zip(ints, own, strict=True))
    inertia = Counter()
    for d, c in own:
        inertia[c] += d
    assert all(r.cluster_inertia == inertia[r.cluster] and r.inertia == sum(inertia.values()) and list(r.centroid) == cents[r.cluster] for r in got)
    assert centroids.digest(got[0].centroid) == fixed(",".join(map(str, cents[got[0].cluster])))


def test_clusters_of_few_and_equal_vectors(spark):
    assert centroids.cluster(centroids.quantised(vectors(spark, [(1, None)]))).collect() == []
    assert centroids.cluster(centroids.quantised(vectors(spark, [(None, [0.5] * 64)]))).collect() == []
    got = centroids.cluster(centroids.quantised(vectors(spark, [(i, [0.5] * 64) for i in range(40)]))).collect()
    # All centroids are equal: the smallest number wins, others stay empty.
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 40
    three = centroids.cluster(centroids.quantised(vectors(spark, [(i, [float(i)] * 64) for i in range(3)]))).collect()
    assert len({r.cluster for r in three}) == 3 and all(r.distance == 0 for r in three)
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(centroids.quantised(vectors(spark, [(1, [1e30] * 64)]))).collect()


def test_filter_is_sound_and_saves_work():
    rng = np.random.default_rng(5)
    for scale, dim in ((1, 64), (1000, 64), (2**20, 8)):
        x = np.floor(scale * 64 * (rng.normal(size=(500, dim)) * np.geomspace(3, 0.01, dim))).astype(np.int64)
        cents = x[rng.integers(0, 500, 16)]
        cents[5] = cents[2]
        mean = x.mean(0)
        _, axes = np.linalg.eigh(np.cov(x.T.astype(float)))
        axes = axes[:, ::-1]
        lead, rest = centroids.rotated(x.astype(float), mean, axes, 6)
        c_lead, c_rest = centroids.rotated(cents.astype(float), mean, axes, 6)
        own, distance, verified = centroids.nearest(x, lead, rest, cents, c_lead, c_rest)
        exact = ((x[:, None, :] - cents[None]) ** 2).sum(2)
        assert (own == exact.argmin(1)).all() and (distance == exact.min(1)).all()
        assert verified < x.shape[0] * 8


# -- search -------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def brute_search(docs, items, k=20):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    texts = {}
    for i, t in items:
        if i is not None and t is not None:
            texts[i] = min(texts.get(i, t), t)
    out = set()
    for item, text in texts.items():
        scores = []
        for doc, bag in bags:
            if doc is None or not bag:
                continue
            m = 75 + 25 * sum(bag.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms_of(text) if t in bag)
            if s > 0:
                scores.append((-s, doc))
        out |= {(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])}
    return out


def some_docs(seed, n, words=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "naïve", "x9", "日本"]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    texts = [rng.choice([" ", ", ", "-", "\n"]).join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, words, 3 * words]))) for _ in range(n)]
    texts += [texts[3]] * 30 + [None, "", "!!! ...", "ÉTÉ W3 w3", "w59 " * 3000]
    return list(enumerate(texts))


def search(spark, docs, items, k=20):
    d = spark.createDataFrame([(*r, "t", 1, b"") for r in docs], "doc_id bigint, text string, term string, block bigint, ids binary").repartition(5)
    q = spark.createDataFrame([(*r, 5, "x") for r in items], "item_id bigint, text string, kth int, qb string")
    return {tuple(r) for r in lexical.search(d, q, k).collect()}


@pytest.mark.parametrize(("seed", "block_docs", "group"), [(1, 8192, 256), (2, 16, 4), (3, 50, 1)])
def test_search_equals_brute_force(spark, monkeypatch, seed, block_docs, group):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr("agentlake.llm.common.SLICE_BYTES", 500)
    monkeypatch.setattr(lexical, "QUERIES", group)
    monkeypatch.setattr(lexical, "SHARE", 3)
    docs = [*some_docs(seed, 150), (None, "w1 w2 w50 w51"), (None, None)]
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices([t for _, t in docs if t], k=1)[0].split()[:60]) + " w1 w1 été") for i in range(12)]
    items += [(50, None), (51, ""), (52, "absent unknown"), (53, "w1"), (None, "w1 w2"), (54, "w40 w41"), (54, "w2 w2 w3 w4"), (55, "W59, w59")]
    for k in (20, 3):
        assert search(spark, docs, items, k) == brute_search(docs, items, k)


def test_search_of_empty_tables(spark):
    docs = some_docs(4, 20)
    assert search(spark, [], [(1, "w1")]) == set() and search(spark, docs, []) == set()
    assert search(spark, [(1, None), (2, " ")], [(1, "w1")]) == set()
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a"), (3, "c")], "doc_id bigint, text string")
    got = lexical.search(twice, spark.createDataFrame([(1, "b")], "item_id bigint, text string")).collect()
    assert [(r.rank, r.doc_id) for r in sorted(got)] == [(1, 1), (2, 1)]


def test_pair_bounds_hold_and_are_tighter():
    rng = np.random.default_rng(0)
    for _ in range(50):
        gains = rng.integers(0, 100, (6, 40)) * (rng.random((6, 40)) < 0.3)
        singles = gains.max(1)
        pairs = {i: max(int((gains[i] + gains[i + 1]).max()), 0) for i in (0, 2, 4)}
        bounds, plain = lexical.rest_bounds(singles, pairs), lexical.rest_bounds(singles, {})
        for i in range(7):
            assert gains[i:].sum(0).max(initial=0) <= bounds[i] <= plain[i]
        assert bounds[0] < plain[0] or (singles == 0).sum() > 3
