"""Session settings that hold from a laptop to a large cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Only settings whose value does not depend on the size of the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "cellweave", **conf: str) -> SparkSession:
    """A session with SETTINGS; keyword names use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
