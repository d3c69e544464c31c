"""Session settings that the operators are written for."""

from pyspark.sql import SparkSession


def session(name: str = "ablatrix", **options: str) -> SparkSession:
    """ANSI arithmetic, UTC, adaptive execution with skew handling; options override or add settings."""
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | options
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()
