"""Numbering, first rows, digest trees and cycles: results by hand, and what plans and files show."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from ablatrix.operators import rank, trace, verify


def test_numbering_by_ranges(spark):
    """One group over many ranges, others inside one, null keys, ties told apart by a second column."""
    rng = random.Random(2)
    rows = [("hot" if i < 700 else rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(1000)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, v int, id int").repartition(7)
        found = {r.id: r.place for r in rank.numbered(df, ["k"], ["v", "id"], "place").collect()}
        over_all = {r.id: r.ordinal for r in rank.numbered(df, [], ["v", "id"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = {}
    for k, v, i in rows:
        groups.setdefault(k, []).append((v, i))
    assert found == {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1)}
    assert over_all == {i: n for n, (_, i) in enumerate(sorted((v, i) for _, v, i in rows), 1)}
    assert rank.numbered(df.filter("id < 0"), ["k"], ["v"]).count() == 0


def test_first_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(0, 4000, 1, 4).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 4000).alias("v"))
    counts = F.when(F.col("k") == 0, 5).when(F.col("k") == 1, 2).otherwise(0)
    found = rank.first_n(df, ["k"], ["v"], counts, 5)
    assert "WindowGroupLimit [k" in found._jdf.queryExecution().toString() and "Partial" in found._jdf.queryExecution().toString()
    wanted = sorted(tuple(r) for r in rank.first_n(df, ["k"], ["v"], counts).collect())
    assert sorted(tuple(r) for r in found.collect()) == wanted and len(wanted) == 7


def tables(spark):
    rows = spark.range(2000).select(F.col("id"), (F.col("id") / 7).alias("x"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("s"))
    k = F.col("id")
    other = rows.filter("id <> 17").withColumn("x", F.col("x") * F.when(k == 40, 1 + 1e-6).otherwise(1 + 1e-14)).withColumn("s", F.when(k == 55, "other").otherwise(F.col("s")))
    return rows, other.unionByName(rows.filter("id = 3").withColumn("id", F.lit(5000).cast("long")))


def test_digest_tree_finds_what_differs(spark):
    a, b = tables(spark)
    show = lambda df: sorted((r.key, str(r.expected), str(r.actual)) for r in df.collect())
    found = verify.merkle_difference("r", a, b, ["id"], ["x", "s"], leaves=256)
    assert show(found) == show(verify.table_difference("r", a, b, ["id"], ["x", "s"])) and {k.split(".")[0] for k, *_ in show(found)} == {"17", "40", "55", "5000"}
    assert verify.merkle_difference("r", a, a.repartition(9), ["id"], ["x", "s"]).count() == 0
    digests = [verify.leaf_digests(t, ["id"], ["x", "s"], 256) for t in (a, b)]
    k = verify.leaf(["id"], 256)
    wanted = {r[0] for r in spark.createDataFrame([(i,) for i in (17, 40, 55, 5000)], "id long").select(k).collect()}
    assert wanted <= set(verify.unequal_leaves(*digests)) and len(verify.unequal_leaves(*digests)) < 40
    twice = spark.createDataFrame([(1, "a"), (1, "a")], "id long, s string"), spark.createDataFrame([(1, "b"), (1, "b")], "id long, s string")
    assert len(verify.unequal_leaves(*(verify.leaf_digests(t, ["id"], ["s"]) for t in twice))) == 1
    split = spark.createDataFrame([("a", "b1:")], "k string, s string"), spark.createDataFrame([("a", "b1")], "k string, s string")
    assert len(verify.unequal_leaves(*(verify.leaf_digests(t, ["k"], ["s"]) for t in split))) == 1


def test_leaves_that_agree_are_not_read(spark, tmp_path):
    a, b = (t.filter("id < 300 OR id = 5000") for t in tables(spark))
    paths = [str(tmp_path / n) for n in "ab"]
    for t, path in zip((a, b), paths):
        verify.publish_leaves(t, path, ["id"], ["x", "s"], 32)
    differ = verify.unequal_leaves(*(spark.read.parquet(f"{p}/digests") for p in paths))
    assert 0 < len(differ) < 32
    for path in paths:  # without the files of all other leaves
        for leaf in range(32):
            if leaf not in differ:
                shutil.rmtree(f"{path}/rows/leaf={leaf}", ignore_errors=True)
    found = verify.stored_difference("r", spark, *paths, ["id"], ["x", "s"]).collect()
    assert {r.key.split(".")[0] for r in found} == {"17", "40", "55", "5000"}


@pytest.mark.parametrize("seed", range(2))
def test_cycles_are_told_from_what_hangs_below(spark, seed):
    rng = random.Random(seed)
    up = {i: rng.choice([i - 1, rng.randrange(120), None if i % 9 == 0 else i // 2, 999]) for i in range(1, 120)} | {0: None}
    up |= {200: 200, 201: 200, 300: 301, 301: 302, 302: 300} | {303 + i: 302 + i for i in range(20)}

    def goes_round(i):
        at = up.get(i)
        for _ in range(len(up)):
            if at is None or at == i:
                break
            at = up.get(at)
        return at == i

    df = spark.createDataFrame(list(up.items()), "id long, p long")
    found = sorted(r.id for r in trace.on_cycles(df, "id", "p").collect())
    assert found == sorted(i for i in up if goes_round(i)) and {200, 300, 301, 302} <= set(found)
    assert trace.on_cycles(df.filter("id <> p AND id < 20 AND p < id"), "id", "p").count() == 0
