"""The reference's own streams, against plain arithmetic over the same draws."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ablatrix import queries
from ablatrix.operators import estimate, resample, sets, trace, verify
from ablatrix.operators.rank import middle_place

DATA, DRAWS = "/root/testdata/sf0.01", 500


def ranks(values):
    """Average ranks from 1, the largest first."""
    v = np.asarray(values)
    return np.array([(v > x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def correlation(a, b):
    x, y = ranks(a), ranks(b)
    return np.corrcoef(x, y)[0, 1] if x.std() > 0 and y.std() > 0 else None


@pytest.fixture(scope="module")
def grid(spark):
    """(items, documents) as arrays: items[model, target, layer] of 20 damages, documents[model, layer] of five pairs of prices."""
    items, documents = defaultdict(dict), defaultdict(dict)
    for r in queries._items(spark, DATA).collect():
        items[r.model, r.target, r.layer][r.item] = r.paired_damage
    for r in queries._documents(spark, DATA).collect():
        documents[r.model, r.layer][r.doc] = (r.ppl, r.base_ppl)
    return {k: np.array([v[i] for i in range(20)]) for k, v in items.items()}, {k: np.array([v[i] for i in range(5)]) for k, v in documents.items()}


@pytest.fixture(scope="module")
def picks():
    rng, items, docs = np.random.default_rng(resample.PUBLISHED_SEED), [], []
    for _ in range(DRAWS // 250):
        items.append(rng.integers(0, 20, (250, 20)))
        docs.append(rng.integers(0, 5, (250, 5)))
    return np.concatenate(items), np.concatenate(docs)


def test_rank_intervals(spark, grid, picks):
    items, _ = grid
    found = {(r.model, r.target, r.layer): (r.median, r.low, r.high, r.top_fraction) for r in queries.published_rank_ci(spark, DATA, DRAWS).collect()}
    assert set(found) == set(items)
    for model, target in {k[:2] for k in items}:
        layers = sorted(k[2] for k in items if k[:2] == (model, target))
        means = np.stack([items[model, target, layer][picks[0]].mean(axis=1) for layer in layers], axis=1).round(6)
        placed = np.array([ranks(row) for row in means])
        fifth = np.sort(means, axis=1)[:, -5]
        for i, layer in enumerate(layers):
            wanted = [*np.quantile(placed[:, i], [0.5, 0.025, 0.975]), (means[:, i] >= fifth - 1e-12).mean()]
            assert np.allclose(found[model, target, layer], wanted, atol=0.011), (model, target, layer)  # means at a rounding's edge may fall either way


def bands(grid, picks):
    """(model, target, spec, layer) -> (point, low, high), and the leave-one-out residuals."""
    items, documents = grid
    point, boot, loo = {}, {}, {}
    for model, target in sorted({k[:2] for k in items}):
        layers = sorted(k[2] for k in items if k[:2] == (model, target) and (model, k[2]) in documents)
        y = np.array([items[model, target, layer].mean() for layer in layers])
        ys = np.stack([items[model, target, layer][picks[0]].mean(axis=1) for layer in layers], axis=1)
        price = np.stack([documents[model, layer] for layer in layers])
        ratio = price[:, :, 0].mean(axis=1) / price[:, :, 1].mean(axis=1)
        ratios = np.stack([p[:, 0][picks[1]].sum(axis=1) / p[:, 1][picks[1]].sum(axis=1) for p in price], axis=1)
        for spec, form in (("log", np.log), ("relative", lambda r: r - 1)):
            for x, v, out in ((form(ratio)[None], y[None], point), (form(ratios), ys, boot)):
                dx, dv = x - x.mean(axis=1, keepdims=True), v - v.mean(axis=1, keepdims=True)
                slope = (dx * dv).sum(axis=1, keepdims=True) / (dx * dx).sum(axis=1, keepdims=True)
                residual = dv - slope * dx
                for i, layer in enumerate(layers):
                    out[model, target, spec, layer] = residual[:, i]
                if out is point:
                    leverage = 1 / len(layers) + dx[0] ** 2 / (dx[0] ** 2).sum()
                    loo.update({(model, target, spec, layer): residual[0, i] / (1 - leverage[i]) for i, layer in enumerate(layers)})
    se = {k: v.std(ddof=1) for k, v in boot.items()}
    critical = np.quantile(np.max([np.abs(boot[k] - point[k][0]) / se[k] for k in boot if se[k] > 1e-12], axis=0), 0.95)
    return {k: (v[0], se[k], critical, v[0] - critical * se[k], v[0] + critical * se[k]) for k, v in point.items()}, loo


def test_band(spark, grid, picks):
    wanted, _ = bands(grid, picks)
    found = {(r.model, r.target, r.spec, r.layer): (r.point, r.se, r.critical, r.low, r.high) for r in queries.published_band(spark, DATA, DRAWS).collect()}
    assert set(found) == set(wanted)
    for k, v in wanted.items():
        assert np.allclose(found[k], v, atol=2e-6), k


def test_selection(spark, grid, picks):
    items, documents = grid
    wanted, loo = bands(grid, picks)
    chosen = defaultdict(set)
    for model, target in {k[:2] for k in wanted}:
        layers = sorted({k[3] for k in wanted if k[:2] == (model, target)})
        x = {layer: np.log(documents[model, layer][:, 0].mean() / documents[model, layer][:, 1].mean()) for layer in layers}
        order = sorted(layers, key=x.get)
        y = [items[model, target, layer].mean() for layer in order]
        fitted = dict(zip(order, estimate.pooled(y, [1.0] * len(y))))
        for layer, value in zip(order, y):
            specs = ("log", "relative")
            if min(wanted[model, target, s, layer][3] for s in specs) > -0.2 and min(loo[model, target, s, layer] for s in specs) >= -0.05 and value - fitted[layer] >= -0.05:
                chosen[model, layer].add(target)
    found = {(r.model, r.layer) for r in queries.published_selection(spark, DATA, DRAWS).collect()}
    assert found == {k for k, targets in chosen.items() if len(targets) == 3} and found


@pytest.mark.parametrize("relative", [False, True])
def test_split_half_statistics_by_clusters(spark, relative):
    """Clusters of one to four records, which weigh by their records; ties, and layers that don't differ."""
    rng, groups, layers, draws = random.Random(4), list(range(6)), list(range(7)), 500
    rows = [("m", layer, g, rng.randint(4, 9) / 8, rng.randint(4, 9) / 8 if layer else 0.5) for g in groups for _ in range(1 + g % 4) for layer in layers]
    records = spark.createDataFrame(rows, "model string, layer int, cluster long, base double, value double")
    by_layer, halves = resample.split_half_statistics(records, *resample.published_clusters(spark, draws, groups), ["model"], "layer", "cluster", relative)
    stream, boots, rhos = random.Random(resample.PUBLISHED_SEED), [], []

    def damage(layer, sample):
        taken = [(b, v) for g in sample for m, i, c, b, v in rows if i == layer and c == g]
        base, value = (np.mean([t[k] for t in taken]) for k in (0, 1))
        return round((value - base) / base if relative else base - value, 12)

    for _ in range(draws):
        sample = stream.choices(groups, k=len(groups))
        boots.append([damage(layer, sample) for layer in layers])
        order = stream.sample(groups, len(groups))
        rhos.append(correlation(*([damage(layer, part) for layer in layers] for part in (order[:3], order[3:]))))
    boots = np.array(boots)
    placed = np.array([ranks(b) for b in boots])
    found = {r.layer: r for r in by_layer.collect()}
    for i, layer in enumerate(layers):
        r = found[layer]
        wanted = [damage(layer, groups), *np.quantile(boots[:, i], [0.025, 0.975]), *np.quantile(placed[:, i], [0.025, 0.975]), (boots[:, i] >= np.sort(boots, axis=1)[:, -5] - 1e-12).mean()]
        assert np.allclose([r.damage, r.low, r.high, r.rank_low, r.rank_high, r.top_fraction], wanted, atol=1e-9)
    defined = [r for r in rhos if r is not None]
    r = halves.first()
    assert np.allclose([r.median, r.low, r.high], np.quantile(defined, [0.5, 0.025, 0.975]), atol=1e-9) and r.undefined == len(rhos) - len(defined)


def test_published_split_half_queries(spark):
    layers = queries.published_split_half(spark, DATA, 20)
    assert layers.count() == queries._items(spark, DATA).select("model", "target", "layer").distinct().count()
    assert layers.filter("NOT (low <= high AND rank_low <= rank_high AND top_fraction BETWEEN 0 AND 1)").count() == 0
    assert queries.published_split_half_rho(spark, DATA, 20).filter("low <= median AND median <= high").count() == 6


def test_band_reconstruction_names_what_was_altered(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(40, 3))
    boot = spark.createDataFrame([(d, f"c{i}", float(values[d, i])) for d in range(40) for i in range(3)] + [(d, "flat", 1.0) for d in range(40)], "draw long, cell string, v double")
    point = spark.createDataFrame([(f"c{i}", 0.1 * i) for i in range(3)] + [("flat", 1.0)], "cell string, v double")
    band, deviations = resample.simultaneous_band(boot, point, ["cell"], "v").drop("point"), resample.largest_deviations(boot, point, ["cell"], "v")
    se = values.std(axis=0, ddof=1)
    assert np.allclose(sorted(r.d for r in deviations.collect()), np.sort(np.max(np.abs(values - 0.1 * np.arange(3)) / se, axis=1)))
    check = lambda b, d: sorted((r.rule, r.key) for r in verify.band_reconstruction(boot, point, b, d, ["cell"], "v").collect())
    assert check(band, deviations) == []
    assert check(band.withColumn("low", F.col("low") + 1e-9), deviations) == [("band_low", f"c{i}") for i in range(3)]
    assert check(band.withColumn("critical", F.col("critical") * 1.01), deviations) == [("band_critical", c) for c in ("c0", "c1", "c2", "flat")]
    assert check(band.filter("cell <> 'c1'"), deviations.filter("draw <> 3")) == [("band_critical", "c1"), ("band_deviation", "3"), ("band_high", "c1"), ("band_low", "c1"), ("band_se", "c1")]


def test_headline_sets(spark):
    table = lambda rows: spark.createDataFrame(rows, "headline string, member long")
    found = verify.headline_sets(table([("a", 1), ("a", 2), ("b", 1), ("b", 1)]), table([("a", 2), ("a", 3), ("b", 1), ("c", 5)])).collect()
    assert sorted((r.rule, r.key) for r in found) == [("member_missing", "a/1"), ("member_unrecorded", "a/3"), ("member_unrecorded", "c/5")]


def test_decisions_segments_unions_and_places(spark):
    asked, told = spark.createDataFrame([("t", 1), ("t", 2), ("t", 2)], "task string, n int"), spark.createDataFrame([("t", 1, "x"), ("t", 1, "y"), ("u", 2, "x")], "task string, n int, more string")
    assert [tuple(r) for r in trace.missing_decisions(asked, told).distinct().collect()] == [("t", 2)]
    segments = spark.createDataFrame([("a", 1, "first"), ("a", 3, "last"), ("a", 2, "middle"), ("b", 1, None)], "id string, at int, v string")
    assert sorted(tuple(r) for r in sets.last_segments(segments, "id", F.col("at")).collect()) == [("a", 3, "last"), ("b", 1, None)]
    assert sorted(tuple(r) for r in sets.union_rows(asked.select("n", "task"), asked).collect()) == [(1, "t"), (1, "t"), (2, "t"), (2, "t"), (2, "t"), (2, "t")]
    places = spark.createDataFrame([(n, f) for n in (2, 3, 7, 28) for f in (0.01, 0.5, 0.99)], "n long, f double")
    import math

    for r in places.collect():
        assert spark.range(1).select(middle_place(F.lit(r.n), r.f)).first()[0] == min(r.n - 1, max(1, math.ceil(r.n * r.f)))
