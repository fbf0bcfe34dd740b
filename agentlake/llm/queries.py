"""Registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.llm import bpe, centroids, jaccard, lexical, licenses, mixing, near_vectors, pii, repeats, token_counts, topk, toxicity, warc
from agentlake.llm.common import table
from agentlake.session import shared_dir

QUERIES, ORACLES = {}, {}

#: Words a mix reads from a source at most this often, for as many words as there are.
REPETITION = 1.25


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of a document in a mix of its sources."""
    return mixing.mix(table(spark, sf_dir, "documents"), repetition=REPETITION, columns=["doc_id", "source"])


ORACLES["op1_mixing"] = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, substr(md5(CAST(doc_id AS VARCHAR)), 1, 3) AS block,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
blocks AS (SELECT source, block, CAST(sum(tokens) AS BIGINT) AS tokens FROM docs GROUP BY ALL),
sizes AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM blocks GROUP BY ALL HAVING sum(tokens) > 0),
grid AS (SELECT CAST(sum(tokens) AS BIGINT) AS total FROM sizes),
coarse AS (
  SELECT coalesce(min(k), 1048576) AS k FROM (
    SELECT k, round(max(pow(tokens / total, k / 1048576.0::DOUBLE) / tokens) / sum(pow(tokens / total, k / 1048576.0::DOUBLE)) * any_value(total), 9) AS most
    FROM sizes, grid, (SELECT unnest(range(0, 1048577, 1024)) AS k) GROUP BY k) WHERE most <= {REPETITION}),
fine AS (
  SELECT coalesce(min(k), (SELECT k FROM coarse)) AS k FROM (
    SELECT s.k, round(max(pow(tokens / total, s.k / 1048576.0::DOUBLE) / tokens) / sum(pow(tokens / total, s.k / 1048576.0::DOUBLE)) * any_value(total), 9) AS most
    FROM sizes, grid, (SELECT unnest(range(greatest(0, k - 1024), k + 1)) AS k FROM coarse) s GROUP BY s.k) WHERE most <= {REPETITION}),
powers AS (SELECT source, tokens, total, pow(tokens / total, (SELECT k FROM fine) / 1048576.0::DOUBLE) AS power FROM sizes, grid),
aims AS (
  SELECT source, target // tokens AS whole, target % tokens AS rest FROM (
    SELECT source, tokens, CAST(floor(round(power / (SELECT sum(power) FROM powers) * total, 3)) AS BIGINT) AS target FROM powers)),
plan AS (
  SELECT b.source, block, tokens, whole, rest, unnest(range(0, whole + 1)) AS epoch
  FROM blocks b JOIN aims a ON b.source IS NOT DISTINCT FROM a.source),
ranked AS (
  SELECT *, row_number() OVER turn AS block_rank, sum(tokens) OVER (turn ROWS UNBOUNDED PRECEDING) AS total FROM plan
  WINDOW turn AS (PARTITION BY source, epoch ORDER BY md5(concat_ws('|', coalesce(source, ''), CAST(epoch AS VARCHAR), block)), block))
SELECT d.doc_id, d.source, CAST(r.epoch AS INTEGER) AS epoch, d.block, CAST(block_rank AS INTEGER) AS block_rank, d.tokens
FROM docs d JOIN ranked r ON d.source IS NOT DISTINCT FROM r.source AND d.block = r.block
WHERE r.epoch < whole OR r.total <= rest"""


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.encode(docs, path, decoded_sha256="decoded_sha256")
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "decoded_sha256",
    )


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, network)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard.near_duplicate_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op4_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
pieces AS (SELECT doc_id, len(s) AS n, unnest(s) AS p FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM pieces a JOIN pieces b ON a.p = b.p AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c)),
reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
part AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN part USING (doc_id)"""


@query
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector."""
    q = topk.written(topk.quantised(table(spark, sf_dir, "embeddings")), "quantised")
    return topk.top_k(q, q.where("vec_id % 20 = 0"))


ORACLES["op5_topk"] = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


def _spans(column: str):
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.fit_field(docs))
    base = F.filter("spans", lambda s: s["base"])
    def of(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.withColumn("base", base).select("doc_id", *map(of, pii.KINDS), F.sha2(_spans("base"), 256).alias("base_sha256"), _spans("spans").alias("spans"))


@query
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages of documents before it."""
    left = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op7_repeats"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM w WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low FROM windows) WHERE doc_id > low),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hits),
lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(coalesce(g, []), k)), lambda k: w[k]), ' '), '')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id)"""


@query
def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all vectors."""
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLES["op8_near_vectors"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
part AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN part USING (vec_id) LEFT JOIN n USING (vec_id)"""


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate license notices in every document, with the template that compresses them best."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, through a cache that is new for this run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "token-cache"))


@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, from the records read back out of an archive."""
    path = shared_dir(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    records = warc.parse_records(warc.read_archive(spark, path))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op11_warc"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p),
r AS (SELECT *, n >= {warc.LEAST} AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r"""


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster among 16."""
    found = centroids.cluster(centroids.quantised(table(spark, sf_dir, "embeddings")))
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256).alias("centroid_sha256")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)


def _rounds(rounds: int) -> str:
    """SQL of ``rounds`` rounds over ``q`` (vec_id, q) from centroids ``c0`` (c, v); the last assignment is ``a{rounds}``."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""a{i} AS (
  SELECT rid, vec_id, q, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (
    SELECT rid, vec_id, q, c, CAST(list_sum(list_transform(range(1, 65), lambda i: (q[i] - v[i]) * (q[i] - v[i]))) AS BIGINT) AS d FROM q, c{i})
  GROUP BY ALL)""")
        if i < rounds:
            out.append(f"""s{i} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY ALL),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))""")
    return ",\n".join(out)


ORACLES["op12_centroids"] = f"""
WITH q AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q AS v FROM (
    SELECT q, sha256(concat('1:', CAST(vec_id AS VARCHAR))) AS h FROM q WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT 16)),
{_rounds(3)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (c)"""


@query
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that rank highest for every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLES["op13_lexical"] = r"""
WITH words AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
tf AS (SELECT rid, doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
lens AS (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY rid),
whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM lens),
df AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY t),
f AS (
  SELECT rid, doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)) AS f FROM tf JOIN lens USING (rid), whole),
items AS (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id),
asked AS (
  SELECT item_id, t, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM items)
  GROUP BY ALL),
scores AS (SELECT item_id, rid, doc_id, CAST(sum(q * w * f) AS BIGINT) AS score FROM asked JOIN df USING (t) JOIN f USING (t) WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 20"""
