"""Resuming: what is done isn't done again.  The reference streams nothing; incremental landing is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def pending_tasks(plan: DataFrame, markers: DataFrame, configuration_sha256: str, compatibility_sha256: str) -> DataFrame:
    """Tasks without a commit marker of this configuration and version."""
    same = (F.col("configuration_sha256") == configuration_sha256) & (F.col("compatibility_sha256") == compatibility_sha256)
    done = markers.filter(same).select(F.col("task").alias("id")).distinct()
    return plan.join(done, "id", "left_anti")


def changed_payloads(markers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Committed tasks whose rows no longer have the digest that their marker binds."""
    now = payloads.select("task", F.col("payload_sha256").alias("found"))
    return markers.join(now, "task", "left").filter(~F.col("payload_sha256").eqNullSafe(F.col("found"))).select("task", "payload_sha256", "found")


def retries(journal: DataFrame) -> DataFrame:
    """By task: attempts, and how many of them were retries."""
    return journal.groupBy("task").agg(F.countDistinct("attempt").alias("attempts"), (F.countDistinct("attempt") - 1).alias("retries"))


def land(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, partitions: tuple[str, ...] = ()) -> StreamingQuery:
    """Land the JSON lines that are new since the last call as Parquet, exactly once, then stop."""
    rows = spark.readStream.schema(schema).option("mode", "FAILFAST").json(source)
    writer = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.partitionBy(*partitions) if partitions else writer).start()


def windowed_counts(events: DataFrame, time: str, keys: tuple[str, ...], length: str, late: str) -> DataFrame:
    """Counts by tumbling window over a stream or a table; rows later than ``late`` no longer count in a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"))
