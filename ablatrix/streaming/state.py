"""Resuming as a stream: what is known of each task is state, and each batch of results is committed once, whatever is repeated."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ablatrix.operators.rank import latest

#: What a stream of attempts has, and what is told of a task after each batch that has rows of it.
ATTEMPTS = "task string, attempt long, status string, payload_sha256 string"
KNOWN = "task string, attempts long, last_attempt long, done boolean, payload_sha256 string, conflict boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TaskState(StatefulProcessor):
    """Attempts seen, the highest of them, and the digest of the payload that completed a task.

    An attempt that was seen is passed over, so a repeated batch changes nothing; another digest for a task that is done is a
    conflict, which stays.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "attempt long", "status string")
        self.known = handle.getValueState("known", "attempts long, last_attempt long, done boolean, payload_sha256 string, conflict boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        attempts, last, done, digest, conflict = self.known.get() if self.known.exists() else (0, -1, False, None, False)
        for some in rows:
            for attempt, status, payload in zip(some["attempt"].tolist(), some["status"].tolist(), some["payload_sha256"].tolist()):
                if not self.seen.containsKey((attempt,)):
                    self.seen.updateValue((attempt,), (status,))
                    attempts, last = attempts + 1, max(last, attempt)
                if status == "complete":
                    conflict = conflict or (done and payload != digest)
                    done, digest = True, digest if done else payload
        self.known.update((attempts, last, done, digest, conflict))
        yield pd.DataFrame({"task": [key[0]], "attempts": [attempts], "last_attempt": [last], "done": [done], "payload_sha256": [digest], "conflict": [conflict]})

    def close(self) -> None:
        pass


def task_states(attempts: DataFrame) -> DataFrame:
    """A stream of attempts as a stream of KNOWN, a row for each task of a batch; needs the RocksDB state store."""
    spark = attempts.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = attempts.select("task", "attempt", "status", "payload_sha256")
    return rows.groupBy("task").transformWithStateInPandas(statefulProcessor=TaskState(), outputStructType=KNOWN, outputMode="Update", timeMode="None")


def committed(path: str) -> Callable[[DataFrame, int], None]:
    """A writer of batches for foreachBatch: each batch is a folder of its number, which a repetition of it replaces."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def follow(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Take in the attempts, JSON lines, that are new since the last call, commit what is then known, and stop."""
    rows = spark.readStream.schema(ATTEMPTS).option("mode", "FAILFAST").json(source)
    return task_states(rows).writeStream.outputMode("update").foreachBatch(committed(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def known_tasks(spark: SparkSession, target: str) -> DataFrame:
    """The last that was told of each task, in whichever batch."""
    rows = spark.read.option("basePath", target).parquet(f"{target}/batch=*")
    return latest(rows.withColumn("batch", F.col("batch").cast("long")), ["task"], "batch").drop("batch")


def unfinished(plan: DataFrame, known: DataFrame) -> DataFrame:
    """Planned tasks that aren't done, or whose payload differs between attempts, with the attempts so far."""
    told = known.select(F.col("task").alias("id"), "attempts", "done", "conflict")
    both = plan.join(told, "id", "left").filter(~F.coalesce("done", F.lit(False)) | F.coalesce("conflict", F.lit(False)))
    return both.select(*plan.columns, F.coalesce("attempts", F.lit(0).cast("long")).alias("attempts"), F.coalesce("conflict", F.lit(False)).alias("conflict"))
