"""Session settings that every plan of the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Applied at build time only where the caller (or the cluster) has not decided.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", app: str = "inkwell", **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` (dots as ``__``) wins over them."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
