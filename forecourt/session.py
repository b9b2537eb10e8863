"""Recommended session settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings the operators rely on or profit from. AQE picks join strategies from
# measured sizes, splits skewed join partitions and coalesces small ones; UTC keeps
# dates independent of the host.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(
    app_name: str = "forecourt", master: str | None = None, **settings: object
) -> SparkSession:
    """Get or create a session with the recommended settings.

    ``settings`` are further Spark properties with dots written as double
    underscores, e.g. ``spark__sql__shuffle__partitions=2000``; they win over the
    recommended ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    wanted = dict(RECOMMENDED)
    wanted.update({k.replace("__", "."): str(v) for k, v in settings.items()})
    for key, value in wanted.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
