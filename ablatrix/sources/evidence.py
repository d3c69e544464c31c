"""Readers of evidence: typed, bounded, refusing what they don't know."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ablatrix import limits, schemas
from ablatrix.errors import InvalidConfiguration
from ablatrix.functions.strict_json import admitted


def observations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of durable observations; a line that doesn't fit the schema fails the read."""
    return spark.read.schema(schemas.OBSERVATION).option("mode", "FAILFAST").json(path)


def refused_lines(spark: SparkSession, path: str, size: int = limits.ARTIFACT) -> DataFrame:
    """Lines that strict JSON refuses: file, line, reason.  Blank lines are passed over."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line")).filter(F.trim("line") != "")
    return lines.select("file", "line", admitted(F.col("line"), F.lit(limits.nodes(size))).alias("reason")).filter("reason IS NOT NULL")


def documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document a file, whose root is an object."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def refused_documents(spark: SparkSession, path: str, size: int = limits.ARTIFACT) -> DataFrame:
    """Whole files that are too large, or that strict JSON refuses."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"), "value")
    reason = F.when(F.col("bytes") > size, "artifact_too_large").otherwise(admitted(F.col("value"), (F.col("bytes") / limits.BYTES_PER_NODE).cast("long") + 1))
    return files.select("file", "bytes", reason.alias("reason")).filter("reason IS NOT NULL")


def authored(path: str, size: int = 8 * limits.MIB) -> dict:
    """A configuration of at most ``size`` bytes, JSON or YAML, as a mapping of string keys; read on the driver."""
    file = Path(path)
    if file.is_symlink() or not file.is_file() or file.stat().st_size > size:
        raise InvalidConfiguration("authored_input_invalid", path)
    text = file.read_text()
    if file.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise InvalidConfiguration("yaml_not_available", path) from e
        value = yaml.safe_load(text)
    else:
        value = json.loads(text, object_pairs_hook=_no_repeats)
    if not isinstance(value, dict) or not all(isinstance(k, str) for k in value):
        raise InvalidConfiguration("authored_input_not_a_mapping", path)
    return value


def _no_repeats(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise InvalidConfiguration("authored_input_duplicate_key")
    return out


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV table with a header, its columns typed by the schema."""
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Every file below path: path (relative), bytes, sha256."""
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace("path", "^[a-z]+:/*" + root.removeprefix("file:").lstrip("/").replace(".", "\\.") + "/", "")
    return files.select(relative.alias("path"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def bundle_violations(files: DataFrame) -> DataFrame:
    """Limits that an inventory passes: rule, key, expected, actual."""
    large = files.filter(F.col("bytes") > limits.ARTIFACT).select(F.lit("artifact_too_large").alias("rule"), F.col("path").alias("key"), F.lit(str(limits.ARTIFACT)).alias("expected"), F.col("bytes").cast("string").alias("actual"))
    total = files.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    heavy = total.filter(F.col("bytes") > limits.BUNDLE).select(F.lit("bundle_too_large"), F.lit(""), F.lit(str(limits.BUNDLE)), F.col("bytes").cast("string"))
    many = total.filter(F.col("n") > limits.ENTRIES).select(F.lit("bundle_too_many_entries"), F.lit(""), F.lit(str(limits.ENTRIES)), F.col("n").cast("string"))
    return large.union(heavy).union(many)


def dataset_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a dataset manifest, one row each, with the split that lists them."""
    listed = documents(spark, path, schemas.DATASET).select(F.explode("partitions").alias("split", "records"))
    return listed.select("split", F.explode("records").alias("r")).select("split", "r.*")


def example_records(spark: SparkSession) -> DataFrame:
    """A small dataset: two discovery records and one for validation."""
    rows = [("d-1", "discovery", "alpha", "alpha"), ("d-2", "discovery", "beta", "beta"), ("v-1", "validation", "gamma", "gamma")]
    return spark.createDataFrame(rows, "id string, split string, text string, expected string")
