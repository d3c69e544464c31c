"""Verification: every check is a table of violations (rule, key, expected, actual), empty if all is well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ablatrix.checkpoints import checkpointed
from ablatrix.errors import InvalidEvidence
from ablatrix.functions.expressions import HEX_DIGEST, close, matches
from ablatrix.operators.sets import difference, overlap


def violation(rows: DataFrame, rule: str, key: Column, expected: Column, actual: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"))


def enforce(violations: DataFrame) -> None:
    """Raise the first violation, by rule and key; the library's one action for checks."""
    first = violations.orderBy("rule", "key").limit(1).collect()
    if first:
        raise InvalidEvidence(first[0]["rule"], f"{first[0]['key']}: expected {first[0]['expected']}, found {first[0]['actual']}")


def table_difference(rule: str, recorded: DataFrame, computed: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-10) -> DataFrame:
    """Full comparison by key: numbers within the tolerance, relative or absolute, all else equal, nulls equal to nulls."""
    a = recorded.select(*keys, F.struct(*values).alias("a"))
    b = computed.select(*keys, F.struct(*values).alias("b"))
    kinds = dict(recorded.dtypes)
    both = a.join(b, list(keys), "full")
    key = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    found = []
    for v in values:
        x, y = F.col(f"a.{v}"), F.col(f"b.{v}")
        same = x.eqNullSafe(y)
        if kinds[v] in ("double", "float"):
            same = same | F.coalesce(close(x, y, tolerance, tolerance), F.lit(False))
        found.append(F.when(F.col("a").isNull() | F.col("b").isNull() | ~same, F.struct(F.lit(v).alias("f"), x.cast("string").alias("x"), y.cast("string").alias("y"))))
    return both.select(key.alias("key"), F.explode(F.array_compact(F.array(*found))).alias("d")).select(
        F.lit(rule).alias("rule"), F.concat_ws(".", "key", "d.f").alias("key"), F.col("d.x").alias("expected"), F.col("d.y").alias("actual")
    )


#: Leaves of a digest tree, and how many of them have one node above.
LEAVES, FAN = 4096, 64


def leaf(keys: Sequence[str], leaves: int = LEAVES) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(leaves)).cast("int")


def leaf_digests(rows: DataFrame, keys: Sequence[str], values: Sequence[str], leaves: int = LEAVES, by: Column | None = None) -> DataFrame:
    """(leaf, n, low, high): of each leaf's rows, as a multiset, the sum of the digests of keys and values.

    Doubles count with twelve digits, so that leaves which agree hold numbers that are equal within 1e-10.  The sums are of
    two parts of each row's SHA-256; they combine before the shuffle, whatever a leaf's size.
    """
    kinds = dict(rows.dtypes)
    shown = [F.coalesce((F.format_string("%.11e", F.col(c).cast("double")) if kinds[c] in ("double", "float") else F.col(c).cast("string")), F.lit("\x00")) for c in (*keys, *values)]
    text = F.concat(*(F.concat(F.length(x).cast("string"), F.lit(":"), x) for x in shown))
    digest = F.sha2(text, 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")
    return rows.groupBy((leaf(keys, leaves) if by is None else by).alias("leaf")).agg(F.count("*").alias("n"), F.sum(part(1)).alias("low"), F.sum(part(16)).alias("high"))


def unequal_leaves(a: DataFrame, b: DataFrame, fan: int = FAN) -> list[int]:
    """Leaves whose digests differ: first the nodes above, then the leaves of those that differ; LEAVES numbers at most."""
    digest = ("n", "low", "high")

    def unequal(x: DataFrame, y: DataFrame, key: str) -> list[int]:
        both = x.select(key, F.struct(*digest).alias("x")).join(y.select(key, F.struct(*digest).alias("y")), key, "full")
        return sorted(r[key] for r in both.filter(~F.col("x").eqNullSafe(F.col("y"))).select(key).collect())

    above = lambda d: d.groupBy(F.floor(F.col("leaf") / fan).cast("int").alias("node")).agg(*(F.sum(c).alias(c) for c in digest))
    nodes = unequal(above(a), above(b), "node")
    under = F.floor(F.col("leaf") / fan).cast("int").isin(nodes)
    return unequal(a.filter(under), b.filter(under), "leaf") if nodes else []


def merkle_difference(rule: str, recorded: DataFrame, computed: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-10, leaves: int = LEAVES) -> DataFrame:
    """table_difference() of the rows in leaves that differ; where all agree nothing is joined."""
    digests = [checkpointed(leaf_digests(t, keys, values, leaves)) for t in (recorded, computed)]
    there = leaf(keys, leaves).isin(unequal_leaves(*digests))
    return table_difference(rule, recorded.filter(there), computed.filter(there), keys, values, tolerance)


def publish_leaves(rows: DataFrame, path: str, keys: Sequence[str], values: Sequence[str], leaves: int = LEAVES) -> None:
    """A table by leaf, and its digests beside it, for stored_difference()."""
    held = rows.withColumn("leaf", leaf(keys, leaves))
    held.repartition("leaf").write.mode("errorifexists").partitionBy("leaf").parquet(f"{path}/rows")
    leaf_digests(rows, keys, values, leaves).coalesce(1).write.mode("errorifexists").parquet(f"{path}/digests")


def stored_difference(rule: str, spark: SparkSession, recorded: str, computed: str, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-10) -> DataFrame:
    """table_difference() of two tables of publish_leaves(): the digests are read, and of the rows only leaves that differ."""
    differ = unequal_leaves(*(spark.read.parquet(f"{p}/digests") for p in (recorded, computed)))
    a, b = (spark.read.parquet(f"{p}/rows").filter(F.col("leaf").isin(differ)) for p in (recorded, computed))
    return table_difference(rule, a, b, keys, values, tolerance)


def coverage(rule: str, expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Multisets that should be equal."""
    key = F.concat_ws("/", *(F.col(c).cast("string") for c in expected.columns))
    rows = F.col("rows").cast("string")
    missing = F.col("side") == "missing"
    return violation(difference(expected, observed), rule, key, F.when(missing, rows).otherwise("0"), F.when(missing, "0").otherwise(rows))


def plan_coverage(plan: DataFrame, repetitions: int, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every planned row has each repetition, and nothing else was observed."""
    numbers = F.sequence(F.lit(0), F.lit(repetitions - 1))
    return difference(plan.select(*keys, F.explode(numbers).alias("repetition")), observed.select(*keys, F.col("repetition").cast("int").alias("repetition")))


def observation_gaps(rows: DataFrame, cells: Sequence[str], item: str, values: Sequence[str], status: str = "status") -> DataFrame:
    """Why observations are no full grid of cells and items: not complete, repeats that differ, items that a cell lacks."""
    cell = F.concat_ws("/", *(F.col(c).cast("string") for c in cells))
    key = F.concat_ws("/", cell, F.col(item).cast("string"))
    broken = violation(rows.filter(~F.col(status).eqNullSafe("complete")), "observation_incomplete", key, F.lit("complete"), F.coalesce(status, F.lit("")))
    shown = F.concat_ws(",", *(F.coalesce(F.col(v).cast("string"), F.lit("null")) for v in values))
    ends = rows.groupBy(*cells, item).agg(F.min(shown).alias("low"), F.max(shown).alias("high")).filter("low <> high")
    held = rows.groupBy(*cells).agg(F.countDistinct(item).alias("n"))
    total = rows.agg(F.countDistinct(item).alias("total"))
    short = held.crossJoin(F.broadcast(total)).filter("n < total")  # one row
    return union_violations(broken, violation(ends, "repeats_differ", key, F.col("low"), F.col("high")), violation(short, "items_missing", cell, F.col("total"), F.col("n")))


def full_grid(rows: DataFrame, cells: Sequence[str], item: str, values: Sequence[str], status: str = "status") -> DataFrame:
    """One row a cell and item, repeats collapsed; refused unless the grid is full, complete and the same in each repeat."""
    enforce(observation_gaps(rows, cells, item, values, status))
    return rows.groupBy(*cells, item).agg(*(F.max(v).alias(v) for v in values))


def disjoint(rule: str, rows: DataFrame, value: str, split: str) -> DataFrame:
    return violation(overlap(rows, value, split), rule, F.col(value), F.lit("1"), F.col("splits"))


def manifest_difference(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest against files, both path, bytes, sha256: unbound, absent, of another size or digest, listed twice, ill-formed."""
    listed = manifest.groupBy("path").agg(F.first("bytes").alias("eb"), F.first("sha256").alias("es"), F.count("*").alias("n"))
    both = listed.join(files.select("path", F.col("bytes").alias("ab"), F.col("sha256").alias("as_")), "path", "full")
    rule = (
        F.when(F.col("es").isNull() & F.col("eb").isNull(), "artifact_unbound").when(F.col("as_").isNull(), "artifact_missing").when(F.col("n") > 1, "artifact_listed_twice")
        .when(~matches(F.col("es"), HEX_DIGEST), "digest_malformed").when(F.col("eb") != F.col("ab"), "artifact_size").when(F.col("es") != F.col("as_"), "artifact_digest")
    )
    marked = both.withColumn("rule", rule).filter("rule IS NOT NULL")
    size = F.col("rule") == "artifact_size"
    return marked.select("rule", F.col("path").alias("key"), F.when(size, F.col("eb").cast("string")).otherwise(F.col("es")).alias("expected"), F.when(size, F.col("ab").cast("string")).otherwise(F.col("as_")).alias("actual"))


def unsafe_paths(manifest: DataFrame) -> DataFrame:
    """Absolute paths and those that leave the bundle."""
    bad = F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)") | F.col("path").contains("\\")
    return violation(manifest.filter(bad), "artifact_path", F.col("path"), F.lit("relative"), F.col("path"))


def order_difference(stored: DataFrame, derived: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Keys whose place in the stored order isn't the derived one."""
    both = stored.select(key, F.col(ordinal).alias("a")).join(derived.select(key, F.col(ordinal).alias("b")), key, "full")
    return violation(both.filter(~F.col("a").eqNullSafe(F.col("b"))), "execution_order", F.col(key), F.col("b"), F.col("a"))


def headlines(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Recorded headline numbers, each with its own tolerance, against those found: (headline, value, tolerance) and (headline, value).

    A headline that wasn't found, or was never recorded, is a violation too.
    """
    both = recorded.select("headline", F.struct("value", "tolerance").alias("a")).join(found.select("headline", F.struct("value").alias("b")), "headline", "full")
    near = F.abs(F.col("a.value") - F.col("b.value")) <= F.col("a.tolerance")
    rule = F.when(F.col("a").isNull(), "headline_unrecorded").when(F.col("b").isNull(), "headline_missing").when(~F.coalesce(near, F.lit(False)), "headline_differs")
    marked = both.withColumn("rule", rule).filter("rule IS NOT NULL")
    return marked.select("rule", F.col("headline").alias("key"), F.col("a.value").cast("string").alias("expected"), F.col("b.value").cast("string").alias("actual"))


def band_violations(stored: DataFrame, cells: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Cells of a stored band (point, se, critical, low, high) whose ends aren't point -+ critical * se."""
    key = F.concat_ws("/", *(F.col(c).cast("string") for c in cells))
    found = []
    for end, sign in (("low", -1), ("high", 1)):
        wanted = F.col("point") + sign * F.col("critical") * F.col("se")
        off = ~F.coalesce(close(F.col(end), wanted, 0.0, tolerance), F.lit(False))
        found.append(F.when(off, F.struct(F.lit(f"band_{end}").alias("rule"), wanted.alias("wanted"), F.col(end).alias("stored"))))
    rows = stored.select(key.alias("key"), F.explode(F.array_compact(F.array(*found))).alias("v"))
    return rows.select("v.rule", "key", F.col("v.wanted").cast("string").alias("expected"), F.col("v.stored").cast("string").alias("actual"))


def headline_sets(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Recorded sets against those found, both (headline, member): members that are missing, and those that nobody recorded."""
    out = difference(recorded.select("headline", "member").distinct(), found.select("headline", "member").distinct())
    key = F.concat_ws("/", "headline", F.col("member").cast("string"))
    missing = F.col("side") == "missing"
    return out.select(F.when(missing, "member_missing").otherwise("member_unrecorded").alias("rule"), key.alias("key"), missing.cast("string").alias("expected"), (~missing).cast("string").alias("actual"))


def band_reconstruction(boot: DataFrame, point: DataFrame, band: DataFrame, deviations: DataFrame, cells: Sequence[str], value: str, level: float = 0.95, tolerance: float = 1e-12) -> DataFrame:
    """What of a stored band doesn't follow from its draws: draws' deviations, the critical number, standard errors, ends.

    boot (draw, cells, value) and point (cells, value) are recomputed from; band (cells, se, critical, low, high) and
    deviations (draw, d) are what was stored.  Standard errors are worked out from sums about the point, apart from the
    aggregate that made the band.
    """
    cells, boot = list(cells), checkpointed(boot.select("draw", *cells, value))
    off = boot.join(point.select(*cells, F.col(value).alias("_point")), cells).withColumn("_off", F.col(value) - F.col("_point"))
    sums = off.groupBy(*cells).agg(F.count("*").alias("_n"), F.sum("_off").alias("_s"), F.sum(F.col("_off") * F.col("_off")).alias("_q"), F.first("_point").alias("_point"))
    spread = sums.withColumn("_se", F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n"), F.col("_n") - 1))))
    spread = checkpointed(spread.select(*cells, "_point", "_se"))
    drawn = off.select("draw", *cells, "_off").join(spread.filter(F.col("_se") > 1e-12), cells).groupBy("draw").agg(F.max(F.abs(F.col("_off")) / F.col("_se")).alias("_d"))
    drawn = checkpointed(drawn)
    critical = drawn.agg(F.percentile("_d", level).alias("_critical"))
    near = lambda x, y: F.coalesce(close(x, y, tolerance, tolerance), x.isNull() & y.isNull())
    told = deviations.select("draw", "d").join(drawn, "draw", "full")
    found = [violation(told.filter(~near(F.col("d"), F.col("_d"))), "band_deviation", F.col("draw"), F.col("_d"), F.col("d"))]
    both = band.join(spread, cells, "full").crossJoin(F.broadcast(critical))  # one row
    key = F.concat_ws("/", *(F.col(c).cast("string") for c in cells))
    width = F.when(F.col("_se") > 1e-12, F.col("_critical") * F.col("_se"))
    wanted = {"se": F.col("_se"), "critical": F.col("_critical"), "low": F.col("_point") - width, "high": F.col("_point") + width}
    wrong = F.array_compact(F.array(*(F.when(~near(F.col(c), w), F.struct(F.lit(f"band_{c}").alias("rule"), w.alias("w"), F.col(c).cast("double").alias("s"))) for c, w in wanted.items())))
    rows = both.select(key.alias("key"), F.explode(wrong).alias("v"))
    found.append(rows.select("v.rule", "key", F.col("v.w").cast("string").alias("expected"), F.col("v.s").cast("string").alias("actual")))
    return union_violations(*found)


def union_violations(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
