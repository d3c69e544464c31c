"""Sets of keys: equality, disjointness, membership, overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second)


def union_of_ids(rows: DataFrame, keys: Sequence[str], ids: str) -> DataFrame:
    """The sorted union of arrays of ids."""
    return rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(ids)))).alias(ids))


def difference(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows of one side alone, with their multiplicity: side is missing or unexpected.  Empty if both are equal multisets."""
    columns = expected.columns
    both = expected.withColumn("_n", F.lit(1)).unionByName(observed.select(*columns).withColumn("_n", F.lit(-1)))
    net = both.groupBy(*columns).agg(F.sum("_n").alias("_net")).filter("_net <> 0")
    return net.select(*columns, F.when(F.col("_net") > 0, "missing").otherwise("unexpected").alias("side"), F.abs("_net").alias("rows"))


def overlap(rows: DataFrame, value: str, split: str) -> DataFrame:
    """Values that stand in more than one split."""
    return rows.groupBy(value).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


def not_members(required: DataFrame, available: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required keys that aren't available."""
    return required.select(*keys).distinct().join(available.select(*keys).distinct(), list(keys), "left_anti")


def in_all(rows: DataFrame, keys: Sequence[str], of: str, count: int) -> DataFrame:
    """Keys present for ``count`` distinct values of ``of``."""
    return rows.groupBy(*keys).agg(F.countDistinct(of).alias("n")).filter(F.col("n") == count).select(*keys)


def jaccard(first: Column, second: Column) -> Column:
    """Null where both are empty."""
    return F.try_divide(F.size(F.array_intersect(first, second)), F.size(F.array_union(first, second)))


def last_segments(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row a key, the last in order winning."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")
