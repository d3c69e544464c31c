"""Ranks, windows and limits."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ablatrix.checkpoints import checkpointed


def average_rank(rows: DataFrame, keys: Sequence[str], value: str, name: str = "rank", descending: bool = False) -> DataFrame:
    """Rank from 1, equal values sharing the mean of their places."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    place = F.rank().over(Window.partitionBy(*keys).orderBy(order))
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return rows.withColumn(name, place + (ties - 1) / F.lit(2.0))


def anchors(values: Sequence[float], tolerance: float, strict: bool) -> list[float]:
    """The first value of each one's run, of values in order: a run goes on while they are within the tolerance of its first."""
    out: list[float] = []
    for v in values:
        near = out and (v - out[-1] < tolerance if strict else v - out[-1] <= tolerance)
        out.append(out[-1] if near else v)
    return out


def average_rank_within(rows: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-12, strict: bool = False, name: str = "rank") -> DataFrame:
    """average_rank() where values tie with the first of their run within a tolerance (strict: below it).

    A run's first value anchors it, which no window frame can say.  A group's distinct values, one metric's layers, are in
    one task, which goes over them once; the anchors are joined back by value.
    """
    distinct = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema)

    def anchored(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(value)
        return group.assign(anchor=[float(a) for a in anchors(group[value].tolist(), tolerance, strict)])

    folded = distinct.groupBy(*keys).applyInPandas(anchored, f"{kinds}, anchor double")
    runs = folded.groupBy(*keys, "anchor").agg(F.sum("n").alias("run"))
    before = F.coalesce(F.sum("run").over(Window.partitionBy(*keys).orderBy("anchor").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = runs.withColumn(name, before + (F.col("run") + 1) / F.lit(2.0)).select(*keys, "anchor", name)
    return rows.join(folded.join(ranked, [*keys, "anchor"]).select(*keys, value, name), [*keys, value])


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Number each group's rows from 1 in order, without a group in one task; without keys, all rows.

    Rows are dealt into ranges of keys and order, which are checkpointed so that they stay as they are.  Each range numbers
    its own part of a group, and adds the rows of that group in the ranges before.  Only a group that goes on from an earlier
    range has such rows: one a range at most, so that table is broadcast.
    """
    keys, order = list(keys), list(order)
    dealt = checkpointed(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.sum("_n").over(earlier)).filter("_before > 0")
    starts = starts.select(F.col("_range").alias("_in"), "_before", *(F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)))
    same = F.col("_range") == F.col("_in")
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_key{i}"))
    local = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    out = dealt.withColumn("_local", local).join(F.broadcast(starts), same, "left")
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long").alias(name))


def first_n(rows: DataFrame, keys: Sequence[str], order: Sequence[str], counts: Column, most: int | None = None) -> DataFrame:
    """The first rows of each group in order; counts gives how many, by the group's columns.

    With ``most``, which no count passes, each partition hands on that many rows a group at most (a group limit before the
    shuffle), so that a group's task sees some rows of each partition instead of the group.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    wanted = F.col("ordinal") <= counts
    return rows.withColumn("ordinal", place).filter(wanted if most is None else wanted & (F.col("ordinal") <= F.lit(most)))


def shortfalls(rows: DataFrame, keys: Sequence[str], counts: Column) -> DataFrame:
    """Groups with fewer rows than they should give."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") < counts)


def top_k(rows: DataFrame, value: str, ties: Sequence[str], k: int = 5) -> DataFrame:
    """The k largest, equal ones in the order of ties."""
    return rows.orderBy(F.col(value).desc(), *ties).limit(k)


def top_k_with_ties(rows: DataFrame, keys: Sequence[str], value: str, k: int = 5, tolerance: float = 1e-12) -> DataFrame:
    """All rows at least as large as the group's k-th largest, within the tolerance; perhaps more than k."""
    window = Window.partitionBy(*keys).orderBy(F.col(value).desc())
    marked = rows.withColumn("_place", F.row_number().over(window))
    bound = F.min(F.when(F.col("_place") <= k, F.col(value))).over(Window.partitionBy(*keys))
    return marked.withColumn("_bound", bound).filter(F.col(value) >= F.col("_bound") - tolerance).drop("_place", "_bound")


def centred(rows: DataFrame, keys: Sequence[str], value: str, name: str = "centred") -> DataFrame:
    return rows.withColumn(name, F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))


def middle_place(count: Column, fraction: float) -> Column:
    """Where the middle control goes: min(n - 1, max(1, ceil(n * fraction)))."""
    return F.least(count - 1, F.greatest(F.lit(1).cast("long"), F.ceil(count * fraction)))


def latest(rows: DataFrame, keys: Sequence[str], attempt: str) -> DataFrame:
    """Each key's row of the highest attempt."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), attempt).alias("r")).select(*keys, "r.*")


def equal_within(rows: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-12, name: str = "equal_rows") -> DataFrame:
    """How many rows of the group lie within the tolerance of this one, itself included: a range frame over the value."""
    parts = ", ".join(f"`{k}`" for k in keys)
    frame = f"RANGE BETWEEN {tolerance!r}D PRECEDING AND {tolerance!r}D FOLLOWING"  # the DataFrame API takes whole bounds only
    return rows.withColumn(name, F.expr(f"count(*) OVER (PARTITION BY {parts} ORDER BY `{value}` {frame})"))
