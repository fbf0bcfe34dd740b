"""Session construction and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "agentlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Everything here is a default; a cluster's own configuration wins for keys it
    sets through ``conf`` or ``spark-defaults``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written tables, on storage every executor can reach.

    The cluster names the parent in ``spark.checkpoint.dir``. A session without that setting
    uses its warehouse, which executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/agentlake-shared"
    return f"{root.rstrip('/')}/agentlake-{purpose}-{uuid.uuid4().hex}"
