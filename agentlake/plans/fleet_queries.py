"""Queries over transfers, clusters, links and checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentlake.operators import links as L
from agentlake.operators import scans, splits, tensors, tokens, transfers
from agentlake.plans.registry import query
from agentlake.plans.tables import (
    CHUNK,
    CHUNKS_SQL,
    LINKS_SQL,
    MANIFEST_SQL,
    NODES_SQL,
    RECEIVED_SQL,
    TENSORS_SQL,
    chunk_parts,
    chunks,
    links,
    manifest,
    nodes,
    received,
    table,
)
from agentlake.plans.tables import tensors as tensor_table
from agentlake.session import shared_dir


@query(f"WITH {MANIFEST_SQL} SELECT transfer_id, path, size, replace(path, '/', chr(1)) AS sort_key FROM manifest")
def traversal_order(spark, sf_dir):
    return transfers.traversal_order(manifest(spark, sf_dir))


@query(f"""WITH {CHUNKS_SQL} SELECT transfer_id, path, chunk_no, is_end, "offset", actual_size,
  actual_size + (4 - actual_size % 4) % 4 AS padded_size FROM chunks""")
def chunk_plan(spark, sf_dir):
    return transfers.chunk_plan(manifest(spark, sf_dir), CHUNK)


@query(f"""WITH {CHUNKS_SQL}, run AS (
  SELECT transfer_id, path, chunk_no, CAST(sum(actual_size) OVER (PARTITION BY transfer_id, path ORDER BY chunk_no) AS BIGINT) AS sent
  FROM chunks WHERE actual_size > 0)
SELECT transfer_id, path, chunk_no, sent, sent / (chunk_no + 1)::DOUBLE / 1e9 AS gbps FROM run""")
def transfer_progress(spark, sf_dir):
    progress = transfers.transfer_progress(chunks(spark, sf_dir), parts=chunk_parts(spark, sf_dir))
    return progress.select("transfer_id", "path", "chunk_no", "sent", "gbps")


@query(f"""WITH {MANIFEST_SQL}, {RECEIVED_SQL}
SELECT transfer_id, path, m.size AS expected, r.size AS received,
  CASE WHEN r.size IS NULL THEN 'missing' WHEN m.size IS NULL THEN 'extra' WHEN m.size <> r.size THEN 'size_mismatch' ELSE 'ok' END AS status
FROM manifest m FULL JOIN received r USING (transfer_id, path)""")
def reconcile_manifests(spark, sf_dir):
    sent = manifest(spark, sf_dir)
    return transfers.reconcile_manifests(sent, received(sent))


MANIFEST_TOTALS_SQL = f"""WITH {CHUNKS_SQL}
SELECT transfer_id, count(DISTINCT path) AS files, CAST(sum(actual_size) AS BIGINT) AS bytes,
  CAST(max(chunk_no) + 1 AS DOUBLE) AS elapsed, CAST(sum(actual_size) AS BIGINT) / (max(chunk_no) + 1)::DOUBLE / 1e9 AS gbps
FROM chunks GROUP BY transfer_id"""


@query(MANIFEST_TOTALS_SQL)
def manifest_totals(spark, sf_dir):
    return transfers.manifest_totals(chunks(spark, sf_dir))


def hosts(spark, sf_dir):
    return table(spark, sf_dir, "nation").selectExpr(
        "n_name AS host", "n_nationkey AS rank", "concat('10.0.', n_regionkey, '.', n_nationkey) AS ip"
    )


def requests(spark, sf_dir):
    """Orders as transfer requests between nations; numbers above 24 name no host."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS request_id", "concat('NATION_', o_custkey % 27) AS source", "concat('NATION_', o_orderkey % 26) AS dest"
    )


REQUESTS_SQL = """requests AS (
  SELECT o_orderkey AS request_id, concat('NATION_', o_custkey % 27) AS source, concat('NATION_', o_orderkey % 26) AS dest FROM orders),
hosts AS (SELECT n_name AS host, n_nationkey AS rank, concat('10.0.', n_regionkey, '.', n_nationkey) AS ip FROM nation)"""


@query(f"""WITH {REQUESTS_SQL} SELECT request_id, s.rank AS source_rank, s.ip AS source_ip, d.rank AS dest_rank, d.ip AS dest_ip
FROM requests LEFT JOIN hosts s ON s.host = source LEFT JOIN hosts d ON d.host = dest""")
def attach_host(spark, sf_dir):
    return transfers.attach_host(requests(spark, sf_dir), hosts(spark, sf_dir)).drop("source", "dest")


@query(f"""WITH {REQUESTS_SQL} SELECT request_id, CASE WHEN s.rank IS NULL THEN concat('Unknown local host ''', source, '''')
  WHEN d.rank IS NULL THEN concat('Unknown dest node ''', dest, '''') WHEN s.rank = d.rank THEN 'Source and destination are the same node' END AS error
FROM requests LEFT JOIN hosts s ON s.host = source LEFT JOIN hosts d ON d.host = dest""")
def check_requests(spark, sf_dir):
    return transfers.check_requests(requests(spark, sf_dir), hosts(spark, sf_dir)).select("request_id", "error")


@query(f"""WITH {REQUESTS_SQL} SELECT request_id, s.rank AS source_rank, d.rank AS dest_rank, CASE WHEN s.rank IS NULL THEN concat('Unknown local host ''', source, '''')
  WHEN d.rank IS NULL THEN concat('Unknown dest node ''', dest, '''') WHEN s.rank = d.rank THEN 'Source and destination are the same node' END AS error
FROM requests LEFT JOIN hosts s ON s.host = source LEFT JOIN hosts d ON d.host = dest""")
def quarantine_requests(spark, sf_dir):
    """Sound and rejected requests, written to a table each in one pass and read back from both."""
    path = shared_dir(spark, "requests")
    checked = transfers.check_requests(requests(spark, sf_dir), hosts(spark, sf_dir)).select("request_id", "source_rank", "dest_rank", "error")
    transfers.write_requests(checked, path)
    accepted, rejected = (transfers.read_requests(spark, path, checked.schema, verdict) for verdict in ("accepted", "rejected"))
    return accepted.withColumn("error", F.lit(None).cast("string")).unionByName(rejected)


@query("""WITH volumes AS (SELECT s_suppkey AS node, CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal * 10) AS BIGINT) END AS available_kb
  FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT l_orderkey, l_partkey, l_suppkey AS node, needed_kb, available_kb, coalesce(needed_kb <= available_kb, true) AS fits FROM (
  SELECT *, CASE WHEN l_linenumber < 7 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS needed_kb FROM lineitem) l
LEFT JOIN volumes ON node = l_suppkey""")
def capacity_check(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey AS node", "CASE WHEN l_linenumber < 7 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS needed_kb"
    )
    volumes = table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0").selectExpr(
        "s_suppkey AS node", "CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal * 10) AS BIGINT) END AS available_kb"
    )
    return transfers.capacity_check(wanted, volumes)


def items(spark, sf_dir):
    """Orders as numbered items."""
    return scans.dense_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders")
def dense_index(spark, sf_dir):
    return items(spark, sf_dir)


@query("SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) - 1 AS bucket FROM orders")
def equal_split(spark, sf_dir):
    total = table(spark, sf_dir, "orders").select(F.count(F.lit(1)).alias("n")).scalar()
    return splits.equal_split(items(spark, sf_dir), 7, total).select("o_orderkey", "bucket")


def cluster_items(spark, sf_dir):
    """Orders as items of one cluster per region, numbered within it."""
    keyed = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 5 AS cluster_id", "o_orderkey")
    return scans.dense_index(keyed, "o_orderkey", keys=["cluster_id"])


def loads(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey % 5").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("n_items"), (F.count(F.lit(1)) * 2000.5).alias("total_bytes")
    )


OVERHEADS = {"item_overhead": 1e6, "node_overhead": 2e9}
SPLIT_SQL = f"""{NODES_SQL}, loads AS (
  SELECT o_orderkey % 5 AS cluster_id, count(*) AS n_items, count(*) * 2000.5::DOUBLE AS total_bytes FROM orders GROUP BY ALL),
p0 AS (SELECT *, total_bytes / n_items AS b FROM nodes JOIN loads USING (cluster_id)),
p1 AS (SELECT *, greatest(greatest(1, floor((capacity - 2e9::DOUBLE) / (b + 1e6::DOUBLE))) * b, b) AS cap FROM p0),
p2 AS (SELECT *, greatest(1, CAST(floor((cap + greatest(1, floor(cap / b)) * 1e6::DOUBLE) / (b + 1e6::DOUBLE)) AS BIGINT)) AS most,
         count(*) OVER c AS size, count(capacity) OVER c AS known, rank = max(rank) OVER c AS is_last,
         sum(cap) OVER c AS total_cap, row_number() OVER (PARTITION BY cluster_id ORDER BY cap DESC, rank) = 1 AS largest
       FROM p1 WINDOW c AS (PARTITION BY cluster_id)),
p3 AS (SELECT *, CASE WHEN NOT is_last THEN least(greatest(1, CAST(floor(n_items * cap / total_cap) AS BIGINT)), most) END AS share FROM p2),
p4 AS (SELECT *, CAST(n_items - coalesce(sum(share) OVER (PARTITION BY cluster_id), 0) AS BIGINT) AS rest FROM p3),
p5 AS (SELECT *, max(CASE WHEN is_last THEN greatest(0, rest - most) END) OVER (PARTITION BY cluster_id) AS excess FROM p4),
counts AS (SELECT cluster_id, rank, CASE WHEN known = size THEN CASE WHEN is_last THEN rest - excess ELSE share END + CASE WHEN largest THEN excess ELSE 0 END
             ELSE n_items // size + CASE WHEN rank < n_items % size THEN 1 ELSE 0 END END AS n FROM p5),
split AS (SELECT cluster_id, rank, CAST(greatest(n, 0) AS BIGINT) AS items, n < 0 AS clamped FROM counts),
bounds AS (SELECT *, CAST(coalesce(sum(items) OVER (PARTITION BY cluster_id ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_idx FROM split)"""


def split(spark, sf_dir):
    return splits.proportional_split(nodes(spark, sf_dir), loads(spark, sf_dir), **OVERHEADS)


@query(f"WITH {SPLIT_SQL} SELECT * FROM split")
def proportional_split(spark, sf_dir):
    return split(spark, sf_dir)


@query(f"WITH {SPLIT_SQL} SELECT cluster_id, rank, items, start_idx, start_idx + items AS end_idx FROM bounds")
def reverse_offsets(spark, sf_dir):
    return splits.reverse_offsets(split(spark, sf_dir)).drop("clamped")


@query(f"""WITH {SPLIT_SQL}, items AS (SELECT o_orderkey % 5 AS cluster_id, o_orderkey, row_number() OVER (PARTITION BY o_orderkey % 5 ORDER BY o_orderkey) - 1 AS idx FROM orders)
SELECT i.cluster_id, o_orderkey, idx, rank FROM items i JOIN bounds b ON b.cluster_id = i.cluster_id AND idx >= start_idx AND idx < start_idx + items""")
def assign_ranges(spark, sf_dir):
    bounds = splits.reverse_offsets(split(spark, sf_dir))
    return splits.assign_ranges(cluster_items(spark, sf_dir), bounds)


@query("""WITH c AS (SELECT event_id, user_id, event_type, props, value,
    CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS prio, value > 5 AS valid FROM events),
w AS (SELECT user_id, arg_min(event_id, prio * 100000000000 + event_id) FILTER (WHERE valid AND prio > 0) AS best,
  arg_min(event_id, event_id) FILTER (WHERE prio = 0) AS fallback FROM c GROUP BY user_id)
SELECT user_id, coalesce(best, fallback) AS candidate FROM w WHERE coalesce(best, fallback) IS NOT NULL""")
def first_valid(spark, sf_dir):
    candidates = table(spark, sf_dir, "events").selectExpr(
        "user_id", "event_id AS candidate", "value > 5 AS valid",
        "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS priority",
    )
    return L.first_valid(candidates, "user_id")


@query("SELECT doc_id, n AS read_no, substr(text, CAST((n - 1) * length(text) // 4 AS INT) + 1, CAST(n * length(text) // 4 - (n - 1) * length(text) // 4 AS INT)) AS segment FROM documents, (SELECT unnest([1, 2, 3, 4]) AS n)")
def last_segment(spark, sf_dir):
    """Each document read four times while it grows; the segments make the whole text."""
    reads = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("read_no"))
    grown = reads.selectExpr("doc_id", "read_no", "left(text, CAST(read_no * length(text) div 4 AS INT)) AS text")
    return tokens.last_segment(grown, "doc_id", "read_no")


@query(f"""WITH {LINKS_SQL} SELECT cluster_id, least(src, dst) AS a, greatest(src, dst) AS b,
  count(*) = 2 AND bool_and(state = 'PORT_ACTIVE') AS usable FROM links WHERE src <> dst GROUP BY ALL""")
def mutual_links(spark, sf_dir):
    return L.mutual_links(links(spark, sf_dir))


@query(f"""WITH {LINKS_SQL}, n AS (SELECT cluster_id, count(DISTINCT x) AS nodes FROM (
    SELECT cluster_id, src AS x FROM links WHERE src <> dst UNION ALL SELECT cluster_id, dst FROM links WHERE src <> dst) GROUP BY ALL)
SELECT cluster_id, nodes, count(*) AS links, bool_and(state = 'PORT_ACTIVE') AS all_active, count(*) = nodes * (nodes - 1) AS complete,
  NOT bool_and(state = 'PORT_ACTIVE') OR count(*) < nodes * (nodes - 1) AS abort
FROM links JOIN n USING (cluster_id) WHERE src <> dst GROUP BY cluster_id, nodes""")
def all_links_active(spark, sf_dir):
    return L.all_links_active(links(spark, sf_dir))


@query("""SELECT s_nationkey AS cluster_id, CAST(CASE WHEN bool_or(s_acctbal > 5000 AND s_suppkey % 3 = 1) AND bool_or(s_acctbal > 5000 AND s_suppkey % 3 = 2) THEN 3
  WHEN bool_or(s_acctbal > 5000 AND s_suppkey % 3 = 1) THEN 2 ELSE 1 END AS INT) AS tier FROM supplier GROUP BY s_nationkey""")
def node_tier(spark, sf_dir):
    peers = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS cluster_id", "s_suppkey % 3 AS rank", "s_acctbal > 5000 AS up")
    return L.node_tier(peers)


def devices(spark, sf_dir):
    return links(spark, sf_dir).where("src <> dst").selectExpr("cluster_id", "src", "dst", "concat('en', n) AS device")


@query(f"""WITH {LINKS_SQL}, d AS (SELECT cluster_id, src, dst, concat('en', n) AS device FROM links WHERE src <> dst),
top AS (SELECT cluster_id, greatest(max(src), max(dst)) AS last FROM d GROUP BY cluster_id),
cells AS (SELECT cluster_id, i, j FROM (SELECT cluster_id, last, unnest(range(last + 1)) AS i FROM top), LATERAL (SELECT unnest(range(last + 1)) AS j))
SELECT cluster_id, '[' || string_agg(line, ',' ORDER BY i) || ']' AS matrix FROM (
  SELECT c.cluster_id, i, '[' || string_agg(CASE WHEN device IS NULL THEN 'null' ELSE '"' || device || '"' END, ',' ORDER BY j) || ']' AS line
  FROM cells c LEFT JOIN d ON d.cluster_id = c.cluster_id AND src = i AND dst = j GROUP BY c.cluster_id, i) GROUP BY cluster_id""")
def links_to_matrix(spark, sf_dir):
    return L.links_to_matrix(devices(spark, sf_dir))


@query(f"WITH {LINKS_SQL} SELECT cluster_id, src, dst, concat('en', n) AS device FROM links WHERE src <> dst")
def matrix_to_links(spark, sf_dir):
    return L.matrix_to_links(L.links_to_matrix(devices(spark, sf_dir)))


@query(f"""WITH {TENSORS_SQL} SELECT checkpoint_id, CAST(sum(nbytes) AS BIGINT) AS total_bytes, count(DISTINCT split_part(name, '.', 3)) AS layers,
  round(sum(nbytes)::DOUBLE / count(DISTINCT split_part(name, '.', 3)), 4) AS bytes_per_layer FROM tensors GROUP BY checkpoint_id""")
def bytes_per_group(spark, sf_dir):
    grouped = tensors.bytes_per_group(tensor_table(spark, sf_dir))
    return grouped.withColumn("bytes_per_layer", F.round("bytes_per_layer", 4))


@query(f"""WITH {TENSORS_SQL}
SELECT checkpoint_id, name, nbytes, nbytes % 5 = 0 AS dequantised, CAST(NULL AS VARCHAR) AS error FROM tensors
UNION ALL SELECT checkpoint_id, concat('extra.', name), NULL, false, 'scale without weight' FROM tensors WHERE nbytes % 35 = 0""")
def pair_scale_rows(spark, sf_dir):
    weights = tensor_table(spark, sf_dir)
    scales = weights.where("nbytes % 5 = 0").selectExpr("checkpoint_id", "concat(name, '_scale_inv') AS name", "nbytes")
    orphans = weights.where("nbytes % 35 = 0").selectExpr("checkpoint_id", "concat('extra.', name, '_scale_inv') AS name", "nbytes")
    return tensors.pair_scale_rows(weights.unionByName(scales).unionByName(orphans))


@query(f"""WITH {TENSORS_SQL}, parts AS (
  SELECT *, split_part(name, '.', 3) AS layer, CAST(split_part(name, '.', 6) AS INT) AS expert, split_part(name, '.', 7) AS p FROM tensors),
gated AS (SELECT checkpoint_id FROM tensors WHERE name = 'model.layers.0.block_sparse_moe.experts.0.w1.weight'),
grouped AS (SELECT checkpoint_id, layer, p, min(expert) AS first, count(*) AS n, CAST(sum(nbytes) AS BIGINT) AS nbytes,
    string_agg(nbytes::VARCHAR, ',' ORDER BY expert) AS experts
  FROM parts WHERE checkpoint_id IN (SELECT checkpoint_id FROM gated) GROUP BY checkpoint_id, layer, p)
SELECT checkpoint_id, concat('model.layers.', layer, '.block_sparse_moe.switch_mlp.', CASE p WHEN 'w1' THEN 'gate_proj' WHEN 'w2' THEN 'down_proj' ELSE 'up_proj' END, '.weight') AS name,
  nbytes, experts, CASE WHEN n < 4 THEN 'missing expert' END AS error FROM grouped WHERE first = 0
UNION ALL SELECT t.checkpoint_id, name, t.nbytes, NULL, NULL FROM parts t LEFT JOIN grouped g USING (checkpoint_id, layer, p) WHERE g.first IS NULL OR g.first > 0""")
def stack_experts(spark, sf_dir):
    stacked = tensors.stack_experts(tensor_table(spark, sf_dir), 4)
    return stacked.withColumn("experts", F.array_join("experts", ","))
