"""Estimators over points: one row a key with x and y."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ablatrix.operators.rank import average_rank
from ablatrix.operators.sets import jaccard


def ols(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Intercept, slope and r2 of y on x by group; null where x, or for r2 y, doesn't vary."""
    out = points.groupBy(*keys).agg(
        F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"),
        F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"),
    )
    varies = F.col("vx") > 0
    return out.select(
        *keys, "n", F.when(varies, F.col("intercept")).alias("intercept"), F.when(varies, F.col("slope")).alias("slope"),
        F.when(varies & (F.col("vy") > 0), F.col("r2")).alias("r2"),
    )


def degenerate(points: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """Groups in which x doesn't vary."""
    return points.groupBy(*keys).agg(F.var_pop(x).alias("v")).filter("v = 0").select(*keys, F.lit("predictor_without_variance").alias("reason"))


def ols_points(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """points with fitted, residual, leverage and the leave-one-out residual, residual / (1 - leverage)."""
    whole = Window.partitionBy(*keys)
    mx, my = F.avg(x).over(whole), F.avg(y).over(whole)
    wide = points.withColumn("_dx", F.col(x) - mx).withColumn("_dy", F.col(y) - my).withColumn("_n", F.count("*").over(whole))
    wide = wide.withColumn("_sxx", F.sum(F.col("_dx") * F.col("_dx")).over(whole)).withColumn("_sxy", F.sum(F.col("_dx") * F.col("_dy")).over(whole))
    slope = F.try_divide("_sxy", "_sxx")
    out = wide.withColumn("residual", F.col("_dy") - slope * F.col("_dx"))
    out = out.withColumn("fitted", F.col(y) - F.col("residual")).withColumn("leverage", 1 / F.col("_n") + F.try_divide(F.col("_dx") * F.col("_dx"), F.col("_sxx")))
    out = out.withColumn("loo_residual", F.try_divide(F.col("residual"), 1 - F.col("leverage")))
    return out.drop("_dx", "_dy", "_n", "_sxx", "_sxy")


def fit_summary(points: DataFrame, keys: Sequence[str], base: str, x: str = "x", y: str = "y") -> DataFrame:
    """Largest leverage, and fitted damages that no baseline of ``base`` could suffer."""
    fitted = ols_points(points, keys, x, y)
    impossible = (F.col("fitted") < F.col(base) - 1) | (F.col("fitted") > F.col(base))
    return fitted.groupBy(*keys).agg(F.max("leverage").alias("max_leverage"), F.count_if(impossible).alias("predictions_outside_possible_damage_bounds"))


def pooled(values: Sequence[float], weights: Sequence[float]) -> list[float]:
    """The nondecreasing least-squares fit: adjacent violators are pooled, each value once."""
    blocks: list[tuple[float, float, int]] = []  # (sum, weight, values)
    for total, weight in zip(values, weights):
        size = 1
        while blocks and blocks[-1][0] * weight >= total * blocks[-1][1]:
            total, weight, size = total + blocks[-1][0], weight + blocks[-1][1], size + blocks[-1][2]
            blocks.pop()
        blocks.append((total, weight, size))
    return [total / weight for total, weight, size in blocks for _ in range(size)]


def isotonic(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", tolerance: float = 1e-12) -> DataFrame:
    """points with fitted, the nondecreasing least-squares fit, and isotonic_residual.

    Points whose x lies within the tolerance of the one before are one point of their mean.  A group's distinct x, one
    metric's layers, are in one task, which goes over them once.
    """
    by_x = Window.partitionBy(*keys).orderBy(x)
    new = F.coalesce(F.col(x) - F.lag(x).over(by_x) > tolerance, F.lit(True))
    tied = points.withColumn("_step", F.sum(new.cast("int")).over(by_x.rangeBetween(Window.unboundedPreceding, 0)))
    steps = tied.groupBy(*keys, "_step").agg(F.sum(y).cast("double").alias("_y"), F.count("*").cast("double").alias("_w"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.schema if f.name in {*keys, "_step"})

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_step")
        return group[[*keys, "_step"]].assign(fitted=pooled(group["_y"].tolist(), group["_w"].tolist()))

    fitted = steps.groupBy(*keys).applyInPandas(fit, f"{kinds}, fitted double")
    return tied.join(fitted, [*keys, "_step"]).drop("_step").withColumn("isotonic_residual", F.col(y) - F.col("fitted"))


def pearson(rows: DataFrame, keys: Sequence[str], a: str, b: str, name: str = "r") -> DataFrame:
    """Null where either doesn't vary."""
    out = rows.groupBy(*keys).agg(F.covar_pop(a, b).alias("c"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.count("*").alias("n"))
    return out.select(*keys, "n", F.when((F.col("va") > 0) & (F.col("vb") > 0), F.col("c") / (F.sqrt("va") * F.sqrt("vb"))).alias(name))


def spearman(rows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Pearson of average ranks."""
    ranked = average_rank(average_rank(rows, keys, a, "_ra"), keys, b, "_rb")
    return pearson(ranked, keys, "_ra", "_rb", "rho")


def across(points: DataFrame, keys: Sequence[str], layer: str, model: str, first: object, second: object, value: str) -> DataFrame:
    """The two models' values side by side, layer by layer."""
    side = lambda m, name: points.filter(F.col(model) == m).select(*keys, layer, F.col(value).alias(name))
    return side(first, "first").join(side(second, "second"), [*keys, layer])


def rank_correlation_across(points: DataFrame, keys: Sequence[str], layer: str, model: str, first: object, second: object, value: str) -> DataFrame:
    return spearman(across(points, keys, layer, model, first, second, value), keys, "first", "second")


def material_sets(points: DataFrame, keys: Sequence[str], layer: str, model: str, first: object, second: object, chosen: Column) -> DataFrame:
    """Either model's chosen layers, the common ones, and their Jaccard index (null if both are empty)."""
    ids = lambda m: F.array_sort(F.array_compact(F.collect_list(F.when(chosen & (F.col(model) == m), F.col(layer)))))
    out = points.groupBy(*keys).agg(ids(first).alias("a"), ids(second).alias("b"))
    text = lambda c: F.array_join(c.cast("array<string>"), ";")
    common = F.array_sort(F.array_intersect("a", "b"))
    return out.select(*keys, text(F.col("a")).alias("first_layers"), text(F.col("b")).alias("second_layers"), text(common).alias("common_layers"), jaccard(F.col("a"), F.col("b")).alias("jaccard"))


def perplexity(rows: DataFrame, keys: Sequence[str], loss: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.exp(F.avg(loss)).alias("perplexity"))
