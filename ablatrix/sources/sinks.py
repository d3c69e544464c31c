"""Writers: canonical JSON, tables with a manifest written last, commit markers, an append-only failure journal."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ablatrix.errors import InvalidEvidence
from ablatrix.operators.rank import latest

FORBIDDEN = frozenset({"prompt", "raw_output", "output_text"})


def canonical_bytes(value: object) -> bytes:
    """Sorted keys, no spaces, UTF-8, finite numbers only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def canonical_sha256(value: object) -> str:
    return hashlib.sha256(canonical_bytes(value)).hexdigest()


def sensitive_columns(schema: T.DataType, prefix: str = "") -> list[str]:
    """Fields, at any depth, that may not be published."""
    if isinstance(schema, T.StructType):
        found = [prefix + f.name for f in schema if f.name in FORBIDDEN]
        return found + [x for f in schema for x in sensitive_columns(f.dataType, f"{prefix}{f.name}.")]
    if isinstance(schema, T.ArrayType):
        return sensitive_columns(schema.elementType, prefix)
    if isinstance(schema, T.MapType):
        return sensitive_columns(schema.valueType, prefix)
    return []


def retained(observations: DataFrame, raw: bool = False) -> DataFrame:
    """Raw output and prompt as digests only, unless raw output is retained."""
    out = observations
    for name, digest in (("raw_output", "output_sha256"), ("prompt", "prompt_sha256")):
        if name in out.columns:
            out = out.withColumn(digest, F.sha2(name, 256))
            out = out if raw and name == "raw_output" else out.drop(name)
    return out


def publish(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write a table once; one that exists is never replaced."""
    if found := sensitive_columns(df.schema):
        raise InvalidEvidence("evidence_contains_sensitive_key", ", ".join(found))
    df.write.mode("errorifexists").option("header", form == "csv").format(form).save(path)


def publish_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a global order, range-partitioned, so that part files follow each other."""
    publish(df.repartitionByRange(*order).sortWithinPartitions(*order), path, "json")


def publish_bundle(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Check all tables, write all, then the manifest as the commit marker; gives the manifest."""
    for df in tables.values():
        if found := sensitive_columns(df.schema):
            raise InvalidEvidence("evidence_contains_sensitive_key", ", ".join(found))
    for name, df in tables.items():
        publish(df, f"{path}/{name}")
    from ablatrix.sources.evidence import inventory

    manifest = inventory(spark, path).filter("NOT path LIKE '%.crc' AND NOT path LIKE '%\\_SUCCESS'")
    manifest.write.mode("errorifexists").parquet(f"{path}.manifest")
    return spark.read.parquet(f"{path}.manifest")


def payload_digest(df: DataFrame, buckets: int = 4096) -> DataFrame:
    """One row, payload_sha256: a digest of the rows as a multiset.

    Rows' digests are put in order and digested by bucket, by their first characters, and the buckets' digests again:
    no task holds more than a bucket, and the last one ``buckets`` digests at most.
    """
    rows = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("d"))
    bucket = F.pmod(F.conv(F.substring("d", 1, 8), 16, 10).cast("long"), F.lit(buckets))
    combined = lambda c: F.sha2(F.concat_ws("", F.array_sort(F.collect_list(c))), 256)
    parts = rows.groupBy(bucket.alias("bucket")).agg(combined("d").alias("d"))
    return parts.agg(combined(F.concat_ws(":", F.lpad(F.col("bucket").cast("string"), 8, "0"), "d")).alias("payload_sha256"))


def commit_task(df: DataFrame, path: str, task: str, configuration_sha256: str, compatibility_sha256: str) -> None:
    """A task's rows, then its marker, which binds their digest, the configuration and the compatible version."""
    df.write.mode("overwrite").parquet(f"{path}/payload/task={task}")
    digest = payload_digest(df)
    marker = digest.withColumns({"task": F.lit(task), "configuration_sha256": F.lit(configuration_sha256), "compatibility_sha256": F.lit(compatibility_sha256)})
    marker.write.mode("append").parquet(f"{path}/markers")


def journal(df: DataFrame, path: str) -> None:
    """Append failures: task, attempt, and whatever else they say."""
    df.write.mode("append").parquet(path)


def latest_failures(spark: SparkSession, path: str) -> DataFrame:
    return latest(spark.read.parquet(path), ["task"], "attempt")


def create_once(path: str, content: bytes) -> None:
    """Create a small file on the driver; the same content again is accepted, other content refused."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile(dir=target.parent, delete=False) as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(f.name, target)
    except FileExistsError:
        if target.read_bytes() != content:
            raise InvalidEvidence("artifact_already_published", path) from None
    finally:
        os.unlink(f.name)


def replace(path: str, content: bytes) -> None:
    """Replace a small file on the driver in one step."""
    target = Path(path)
    with tempfile.NamedTemporaryFile(dir=target.parent, delete=False) as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, target)


def freeze_sequence(path: str, ids: list[str]) -> list[str]:
    """The first order written stays; a later one must have the same members, and gets the first back."""
    file = Path(path)
    if file.exists():
        kept = json.loads(file.read_text())
        if sorted(kept) != sorted(ids):
            raise InvalidEvidence("frozen_sequence_differs", path)
        return kept
    create_once(path, canonical_bytes(ids))
    return ids


def freeze_payload(path: str, value: object) -> None:
    create_once(path, canonical_bytes(value))
