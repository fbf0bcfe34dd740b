"""Link telemetry: ``links(cluster_id, src, dst, state)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mutual_links(links: DataFrame) -> DataFrame:
    """Each cable once, usable only if reported active from both ends.

    One aggregation over the unordered pair replaces a self-join.
    """
    cables = links.where("src <> dst").withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    active = F.col("state") == "PORT_ACTIVE"
    return (
        cables.groupBy("cluster_id", "a", "b")
        .agg(
            F.bool_or((F.col("src") == F.col("a"))).alias("_from_a"),
            F.bool_or((F.col("src") == F.col("b"))).alias("_from_b"),
            F.bool_and(active).alias("_active"),
        )
        .select("cluster_id", "a", "b", (F.col("_from_a") & F.col("_from_b") & F.col("_active")).alias("usable"))
    )


def all_links_active(links: DataFrame) -> DataFrame:
    """Per cluster: are all links active, and are there as many as its nodes need?

    Two nodes need 2 directed links, three need 6. ``abort`` tells a launch to stop.
    """
    real = links.where("src <> dst")
    ends = real.select("cluster_id", F.explode(F.array("src", "dst")).alias("node"))
    nodes = ends.groupBy("cluster_id", "node").agg(F.lit(1).alias("_one")).groupBy("cluster_id").agg(F.count("_one").alias("nodes"))
    pairs = real.groupBy("cluster_id", "src", "dst").agg(F.bool_and(F.col("state") == "PORT_ACTIVE").alias("_active"))
    per_cluster = pairs.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("links"), F.bool_and("_active").alias("all_active")
    )
    needed = F.col("nodes") * (F.col("nodes") - 1)
    return per_cluster.join(nodes, "cluster_id").select(
        "cluster_id",
        "nodes",
        "links",
        "all_active",
        (F.col("links") == needed).alias("complete"),
        (~F.col("all_active") | (F.col("links") < needed)).alias("abort"),
    )


def node_tier(nodes: DataFrame) -> DataFrame:
    """Nodes to start per cluster from ``nodes(cluster_id, rank, up)``.

    Both peers up: 3; only the first: 2; otherwise 1, the second peer alone included.
    """
    def peer(rank):
        return F.coalesce(F.bool_or(F.col("up") & (F.col("rank") == rank)), F.lit(False))

    tier = F.when(peer(1) & peer(2), 3).when(peer(1), 2).otherwise(1)
    return nodes.groupBy("cluster_id").agg(tier.alias("tier"))


def matrix_to_links(matrices: DataFrame) -> DataFrame:
    """Edges of a JSON device matrix: entry [i][j] is the device on node i towards j."""
    rows = matrices.select(
        "cluster_id", F.posexplode(F.from_json("matrix", "array<array<string>>")).alias("src", "row")
    )
    cells = rows.select("cluster_id", "src", F.posexplode("row").alias("dst", "device"))
    return cells.where("device IS NOT NULL")


def links_to_matrix(links: DataFrame) -> DataFrame:
    """The JSON device matrix of each cluster, ``null`` where there is no device.

    An array holds the nodes of one cluster, each at most once; of a repeated link the
    smallest device stands.
    """
    cells = links.groupBy("cluster_id", "src", "dst").agg(F.min("device").alias("device"))
    rows = cells.groupBy("cluster_id", "src").agg(
        F.map_from_entries(F.collect_list(F.struct("dst", "device"))).alias("row"), F.max("dst").alias("last")
    )
    grids = rows.groupBy("cluster_id").agg(
        F.map_from_entries(F.collect_list(F.struct("src", "row"))).alias("grid"),
        F.greatest(F.max("src"), F.max("last")).alias("last"),
    )
    nodes = F.sequence(F.lit(0), F.col("last"))
    matrix = F.transform(nodes, lambda i: F.transform(nodes, lambda j: F.col("grid")[i][j]))
    return grids.select("cluster_id", F.to_json(matrix).alias("matrix"))


def first_valid(candidates: DataFrame, key: str) -> DataFrame:
    """The candidate to use per key from ``(key, candidate, priority, valid)``.

    The first valid one by priority, from 1 on; without any, the candidate of
    priority 0. A combining minimum, so no group is ever gathered.
    """
    usable = F.col("valid") & (F.col("priority") > 0)
    rank = F.when(usable, F.col("priority")).when(F.col("priority") == 0, F.lit(2147483647))
    best = F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "candidate")))
    return candidates.groupBy(key).agg(best["candidate"].alias("candidate")).where("candidate IS NOT NULL")
