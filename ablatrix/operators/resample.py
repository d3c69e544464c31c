"""Resampling.  Randomness is data: a table of draws, each with its items and how often it took them."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ablatrix.checkpoints import checkpointed
from ablatrix.operators.estimate import ols_points, spearman
from ablatrix.operators.rank import average_rank, top_k_with_ties

PUBLISHED_SEED, PUBLISHED_BLOCK = 20260916, 250


def congruential(spark: SparkSession, draws: int, slots: int, items: int, shift: int = 0) -> DataFrame:
    """(draw, item, times) of a linear congruential generator, which SQL can repeat."""
    grid = spark.range(draws * slots).select((F.col("id") / slots).cast("long").alias("draw"), (F.col("id") % slots).alias("slot"))
    number = (F.lit(1103515245).cast("long") * (F.col("draw") * 31 + F.col("slot") + shift) + 12345) % 2147483648
    return grid.groupBy("draw", (number % items).alias("item")).agg(F.count("*").alias("times"))


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "draw long, item long, times long")


def published_bootstrap(spark: SparkSession, draws: int, items: int = 20, docs: int = 5, seed: int = PUBLISHED_SEED, block: int = PUBLISHED_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Draws of items and of documents from one PCG64 stream, blocks of both in turn; the block's size is part of it."""
    import numpy as np

    rng, found = np.random.default_rng(seed), ([], [])
    for start in range(0, draws, block):
        n = min(block, draws - start)
        for out, size in zip(found, (items, docs)):
            for i, picks in enumerate(rng.integers(0, size, (n, size))):
                numbers, times = np.unique(picks, return_counts=True)
                out += [(start + i, int(a), int(b)) for a, b in zip(numbers, times)]
    return _table(spark, found[0]), _table(spark, found[1])


def published_clusters(spark: SparkSession, draws: int, groups: Sequence[int], seed: int = PUBLISHED_SEED) -> tuple[DataFrame, DataFrame]:
    """(draws with replacement, permutations) of the groups, each draw of both in turn from one Mersenne twister."""
    rng, picked, orders = random.Random(seed), [], []
    for draw in range(draws):
        sample = rng.choices(list(groups), k=len(groups))
        picked += [(draw, g, sample.count(g)) for g in sorted(set(sample))]
        orders += [(draw, g, place) for place, g in enumerate(rng.sample(list(groups), len(groups)))]
    return _table(spark, picked), _table(spark, orders).withColumnRenamed("times", "place")


def resampled_mean(rows: DataFrame, draws: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """The mean of value in each draw by keys, an item weighing as often as it was drawn."""
    met = rows.join(draws.withColumnRenamed("item", item), item)
    return met.groupBy("draw", *keys).agg((F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias(value))


def interval(rows: DataFrame, keys: Sequence[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Median and interval by linear interpolation, nulls left out and counted."""
    return rows.groupBy(*keys).agg(
        F.percentile(value, 0.5).alias("median"), F.percentile(value, low).alias("low"), F.percentile(value, high).alias("high"),
        F.count_if(F.col(value).isNull()).alias("undefined"),
    )


def rank_intervals(damages: DataFrame, keys: Sequence[str], layer: str, value: str, k: int = 5) -> DataFrame:
    """By layer: the interval of its descending rank over the draws, and how often it is among the k largest with ties."""
    ranked = average_rank(damages, ["draw", *keys], value, "rank", descending=True)
    spans = interval(ranked, [*keys, layer], "rank").drop("undefined")
    total = damages.groupBy(*keys).agg(F.countDistinct("draw").alias("draws"))
    top = top_k_with_ties(damages, ["draw", *keys], value, k).groupBy(*keys, layer).agg(F.count("*").alias("hits"))
    out = spans.join(top, [*keys, layer], "left").join(total, list(keys))
    return out.withColumn("top_fraction", F.coalesce("hits", F.lit(0)) / F.col("draws")).drop("hits", "draws")


def ols_by_draw(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Residuals of y on x within each draw and keys, from centred sums, in one shuffle."""
    return ols_points(points, ["draw", *keys], x, y).drop("fitted", "leverage", "loo_residual")


def simultaneous_band(boot: DataFrame, point: DataFrame, cells: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """By cell: the point, its bootstrap standard error, and a band that holds for all cells at once.

    The critical number is the level's quantile, over draws, of the largest standardised deviation of any cell.  Cells
    whose standard error is not above 1e-12 have none and take no part; see flat_cells().  The draws are read twice and
    so checkpointed first.
    """
    cells, boot = list(cells), checkpointed(boot.select("draw", *cells, value))
    se = boot.groupBy(*cells).agg(F.stddev_samp(value).alias("se"))
    known = point.select(*cells, F.col(value).alias("point")).join(se, cells)
    deviations = boot.join(known.filter("se > 1e-12"), cells).groupBy("draw").agg(F.max(F.abs((F.col(value) - F.col("point")) / F.col("se"))).alias("d"))
    critical = deviations.agg(F.percentile("d", level).alias("critical"))
    banded = known.crossJoin(F.broadcast(critical))  # one row
    width = F.when(F.col("se") > 1e-12, F.col("critical") * F.col("se"))
    return banded.select(*cells, "point", "se", "critical", (F.col("point") - width).alias("low"), (F.col("point") + width).alias("high"))


def largest_deviations(boot: DataFrame, point: DataFrame, cells: Sequence[str], value: str) -> DataFrame:
    """(draw, d): the largest standardised deviation of a draw from the point, of any cell that has a spread."""
    cells = list(cells)
    se = boot.groupBy(*cells).agg(F.stddev_samp(value).alias("_se")).filter("_se > 1e-12")
    known = point.select(*cells, F.col(value).alias("_point")).join(se, cells)
    return boot.join(known, cells).groupBy("draw").agg(F.max(F.abs((F.col(value) - F.col("_point")) / F.col("_se"))).alias("d"))


def flat_cells(boot: DataFrame, cells: Sequence[str], value: str) -> DataFrame:
    return boot.groupBy(*cells).agg(F.stddev_samp(value).alias("se")).filter("se <= 1e-12").select(*cells, F.lit("bootstrap_without_spread").alias("reason"))


def split_half(rows: DataFrame, orders: DataFrame, keys: Sequence[str], group: str, layer: str, value: str, n: Column) -> DataFrame:
    """By draw, keys and layer: the mean of value over either half of the permuted groups; the left half has n div 2."""
    met = rows.join(orders.withColumnRenamed("item", group), group)
    left = F.col("place") < F.floor(n / 2)
    return met.groupBy("draw", *keys, layer).agg(F.avg(F.when(left, F.col(value))).alias("left"), F.avg(F.when(~left, F.col(value))).alias("right"))


def relative_or_absolute(base: Column, value: Column, relative: bool) -> Column:
    """Damage of a mean against the baseline's: relative to it, or absolute with a higher value the better one."""
    return F.try_divide(value - base, base) if relative else base - value


def cluster_damage(records: DataFrame, draws: DataFrame, keys: Sequence[str], layer: str, group: str, relative: bool = False) -> DataFrame:
    """(draw, keys, layer, damage): records (base, value) of the groups that a draw took, each as often as it took its group."""
    met = records.join(draws.withColumnRenamed("item", group), group)
    mean = lambda c: F.sum(F.col(c) * F.col("times")) / F.sum("times")
    out = met.groupBy("draw", *keys, layer).agg(mean("base").alias("_b"), mean("value").alias("_v"))
    return out.select("draw", *keys, layer, relative_or_absolute(F.col("_b"), F.col("_v"), relative).alias("damage"))


def split_half_statistics(records: DataFrame, draws: DataFrame, orders: DataFrame, keys: Sequence[str], layer: str, group: str, relative: bool = False, k: int = 5, digits: int = 12) -> tuple[DataFrame, DataFrame]:
    """(by layer: damage, its interval, its rank's interval, share among the k largest; by keys: the split-half correlation's).

    records: keys, layer, group, base, value, a row a record.  draws takes groups with replacement, orders permutes them;
    the first half of an order is one half of the groups, whose records weigh alike.  Damages are compared and ranked to
    ``digits`` decimals.
    """
    records = checkpointed(records.select(*keys, layer, group, "base", "value"))
    even = F.round("damage", digits)
    boot = checkpointed(cluster_damage(records, draws, keys, layer, group, relative).withColumn("damage", even))
    spread = interval(boot, [*keys, layer], "damage").drop("undefined", "median")
    ranks = rank_intervals(boot, keys, layer, "damage", k)
    whole = records.groupBy(*keys, layer).agg(F.avg("base").alias("_b"), F.avg("value").alias("_v")).select(*keys, layer, relative_or_absolute(F.col("_b"), F.col("_v"), relative).alias("damage"))
    layers = whole.join(spread, [*keys, layer]).join(ranks.select(*keys, layer, F.col("low").alias("rank_low"), F.col("high").alias("rank_high"), "top_fraction"), [*keys, layer])
    groups = records.select(group).distinct().count()
    half = orders.withColumn("half", F.when(F.col("place") < groups // 2, "left").otherwise("right")).select("draw", "half", F.col("item").alias(group), F.lit(1).cast("long").alias("times"))
    met = records.join(half, group)
    sides = met.groupBy("draw", "half", *keys, layer).agg(F.avg("base").alias("_b"), F.avg("value").alias("_v")).withColumn("damage", relative_or_absolute(F.col("_b"), F.col("_v"), relative))
    side = lambda name: F.round(F.max(F.when(F.col("half") == name, F.col("damage"))), digits).alias(name)
    rho = spearman(sides.groupBy("draw", *keys, layer).agg(side("left"), side("right")), ["draw", *keys], "left", "right")
    return layers, interval(rho, keys, "rho")
