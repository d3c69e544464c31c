"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ablatrix.checkpoints import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space as the contracts have it: space and U+0009 to U+000D.
BLANKS = "[\\x20\\x09-\\x0D]+"

__all__ = ["BLANKS", "LOWER", "UPPER", "ascii_lower", "checkpointed", "components", "look_up", "parts", "ship", "table"]

_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Null as empty, A-Z in lower case, all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


#: Texts of a batch that become Python objects at a time.
TEXTS = 512


def parts(column: pa.Array) -> Iterator[list]:
    """A column's values as Python objects, TEXTS at a time: a task never holds a whole batch of texts twice."""
    for at in range(0, len(column), TEXTS):
        yield column.slice(at, TEXTS).to_pylist()


#: At most so many keys can each hold rows / HOT_SLOTS rows or more; that bounds what look_up broadcasts.
HOT_SLOTS = 10_000


def look_up(rows: DataFrame, found: DataFrame, key: str, n: str, total: int, spread: Column) -> DataFrame:
    """Left join of rows with found, which has one row a key and in n the key's number of rows.

    Keys with total / HOT_SLOTS rows or more, HOT_SLOTS at most, are broadcast; the others are shuffled.  Rows settled
    by the broadcast go through the shuffle under a key of their own, dealt out by spread.  The result also has that
    key as join_key: rows alike in key and spread are in one partition.
    """
    least = max(total // HOT_SLOTS, 64)
    values = [c for c in found.columns if c != key]
    hot = found.filter(F.col(n) >= least).select(F.col(key).alias("hot_key"), *(F.col(c).alias(f"hot_{c}") for c in values))
    cold = found.filter(F.col(n) < least).select(F.col(key).cast("string").alias("cold_key"), *(F.col(c).alias(f"cold_{c}") for c in values))
    settled = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left").withColumn(
        "join_key",
        F.when(F.col("hot_key").isNull(), F.col(key).cast("string")).otherwise(
            F.concat(F.col(key).cast("string"), F.lit("#"), F.pmod(F.xxhash64(spread), F.lit(4096)).cast("string"))
        ),
    )
    joined = settled.join(cold, F.col("join_key") == F.col("cold_key"), "left")
    return joined.select(
        *(rows[c] for c in rows.columns), "join_key", *(F.coalesce(f"hot_{c}", f"cold_{c}").alias(c) for c in values)
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(u, v) as (v, root), root the smallest id; ids without an edge are left out.

    Alternates large-star and small-star steps (Kiveris et al., 2014).  Every step takes each node's least neighbour with a
    map-side minimum.  The large-star step looks that up, nodes of very many edges by broadcast, so that a node of any
    degree is spread over tasks; in the small-star step a node has an edge for each root that it may join.  Each round is
    checkpointed.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = checkpointed(edges), None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = look_up(both, least, "u", "n", 2 * now[0], F.col("v")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node")
        small = large.join(lower, F.col("u") == F.col("node")).select(F.col("v").alias("a"), "m")
        small = small.filter("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(lower.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("v"), "root").distinct())
