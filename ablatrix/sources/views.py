"""Views that bind general tables to the evidence model, for queries over any data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TARGETS = ("y1", "y2", "y3")
METRICS = (("tool_selection", "target", "higher_is_better"), ("full_call", "target", "higher_is_better"), ("perplexity", "collateral", "lower_is_better"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metric_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METRICS), "metric string, role string, direction string").coalesce(1)


def _condition() -> Column:
    kind, i = F.col("event_type"), F.col("event_id")
    position = F.element_at(F.array(F.lit("beginning"), F.lit("middle"), F.lit("end")), (i % 3 + 1).cast("int"))
    return (
        F.when(kind == "view", F.concat(F.lit("baseline."), position)).when(kind == "signup", "control.no-op").when(kind == "click", "scan.block.a")
        .when(kind == "error", "scan.block.b").when(i % 4 == 0, "control.random.block.c").otherwise("scan.block.c")
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an observation, from events."""
    rows = table(spark, sf_dir, "events").select(
        _condition().alias("cond"), F.col("user_id").alias("example_id"), (F.col("user_id") % 50).alias("group_id"),
        F.when(F.col("user_id") % 2 == 0, "discovery").otherwise("validation").alias("split"), "event_id", "value",
        F.when(F.col("event_id") % 97 == 0, "error").otherwise("complete").alias("status"), (F.col("value") / 100).alias("elapsed_seconds"),
        (F.col("event_id") * 1024).alias("memory_observation_bytes"), ((F.col("event_id") * 7) % 100).alias("input_tokens"), ((F.col("event_id") * 3) % 50).alias("output_tokens"),
    )
    place = F.row_number().over(Window.partitionBy("cond", "split", "example_id").orderBy("event_id")) - 1
    component = F.when(F.col("cond").startswith("scan."), F.substring("cond", 6, 100)).when(F.col("cond").startswith("control.random."), F.substring("cond", 16, 100))
    return rows.withColumn("repetition", place).withColumn("component_id", F.coalesce(component, F.lit("baseline")))


def obs_scores(observations: DataFrame) -> DataFrame:
    """One row an observation and metric: one pass, exploding an array."""
    flag = lambda most: (F.col("value") <= most).cast("double")
    nothing = F.lit(None).cast("double")

    def score(metric: str, value: Column, fraction: bool) -> Column:
        parts = (value, F.lit(1).cast("long")) if fraction else (nothing, F.lit(None).cast("long"))
        return F.struct(F.lit(metric).alias("metric"), value.alias("value"), parts[0].alias("numerator"), parts[1].alias("denominator"))

    scores = F.array(score("tool_selection", flag(60), True), score("full_call", flag(30), True), score("perplexity", F.col("value") + 1, False))
    return observations.withColumn("score", F.explode(scores)).drop("value").select("*", "score.*").drop("score")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model x layer x item matrix under two arms, from lineitem and part."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("layer"))
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("N", "R")).join(part, "l_partkey")
    return rows.select(
        F.col("l_linestatus").alias("model"), "layer", (F.col("l_suppkey") % 20).alias("item"), (F.col("l_suppkey") % 5).alias("doc"), F.col("l_returnflag").alias("arm"),
        (F.col("l_quantity") <= 25).cast("double").alias("y1"), (F.col("l_discount") <= 0.05).cast("double").alias("y2"), (F.col("l_tax") <= 0.04).cast("double").alias("y3"),
        F.col("l_extendedprice").alias("ppl"),
    )
