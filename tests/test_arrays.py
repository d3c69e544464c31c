"""Arrays of several dimensions: what NumPy wrote is read by ranges, blocks go round, and what doesn't fit is refused."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ablatrix.sources import arrays

SHAPE = (6, 2, 3, 5)


def back(df, shape):
    out = np.full(shape, np.nan)
    rows = df.collect()
    for r in rows:
        out[tuple(r[:-1])] = r[-1]
    return len(rows), out


@pytest.fixture
def archive(tmp_path):
    values = np.random.default_rng(1).normal(size=SHAPE)
    np.savez(tmp_path / "a.npz", other=np.arange(9), residuals=values, columns=np.asfortranarray(values), counts=np.arange(12, dtype=np.int32).reshape(3, 4), flags=np.array([True, False, True]), big=values.astype(">f4"))
    return str(tmp_path), values


def test_members_are_read_by_ranges(spark, archive, monkeypatch):
    root, values = archive
    for name in ("residuals", "columns", "big"):
        for parts in (1, 2, 7):
            df = arrays.read_array(spark, root, "a.npz", name, SHAPE, parts)
            assert df.rdd.getNumPartitions() == parts
            n, found = back(df, SHAPE)
            assert n == values.size and np.allclose(found, values, atol=1e-6 if name == "big" else 0)
    assert back(arrays.read_array(spark, root, "a.npz", "counts"), (3, 4))[1].tolist() == np.arange(12).reshape(3, 4).tolist()
    assert [tuple(r) for r in arrays.read_array(spark, root, "a.npz", "flags").orderBy("i0").collect()] == [(0, True), (1, False), (2, True)]
    np.save(f"{root}/plain.npy", values)
    assert np.array_equal(back(arrays.read_array(spark, root, "plain.npy", shape=SHAPE), SHAPE)[1], values)


def test_arrays_that_are_refused(spark, archive, tmp_path):
    root, values = archive
    np.savez_compressed(tmp_path / "c.npz", residuals=values)
    np.save(tmp_path / "o.npy", np.array([{}]), allow_pickle=True)
    np.save(tmp_path / "s.npy", np.array(["x"]))
    (tmp_path / "t.npy").write_bytes(b"\x93NUMPY")
    np.save(tmp_path / "cut.npy", values)
    (tmp_path / "cut.npy").write_bytes((tmp_path / "cut.npy").read_bytes()[:-8])
    (tmp_path / "z.npz").write_bytes(b"no archive")
    for args, reason in (
        (("a.npz", "residuals", (6, 2, 3, 4)), "array_shape"), (("a.npz", "none"), "array_missing"), (("c.npz", "residuals"), "array_compressed"), (("o.npy",), "array_kind"), (("s.npy",), "array_kind"),
        (("t.npy",), "array_header_malformed"), (("cut.npy",), "array_truncated"), (("z.npz", "x"), "array_archive_malformed"),
    ):
        with pytest.raises(Exception, match=reason):
            arrays.read_array(spark, root, *args)


def test_blocks_go_round(spark, archive, tmp_path):
    root, values = archive
    rows = arrays.read_array(spark, root, "a.npz", "residuals", parts=3)
    path = str(tmp_path / "blocks")
    listed = arrays.write_array(rows.repartition(5), path, SHAPE, [f"i{k}" for k in range(4)], block=50)
    assert [b["path"] for b in listed] == [f"block-{i:08}.npy" for i in range(4)]
    df = arrays.read_blocks(spark, path, SHAPE)
    assert df.rdd.getNumPartitions() >= 2 and np.array_equal(back(df, SHAPE)[1], values)
    with pytest.raises(Exception, match="array_shape"):
        arrays.read_blocks(spark, path, (6, 2, 3, 4))
    with pytest.raises(Exception, match="evidence_already_published"):
        arrays.write_array(rows, path, SHAPE, [f"i{k}" for k in range(4)])
    content = bytearray(open(f"{path}/{listed[2]['path']}", "rb").read())
    content[-1] ^= 1
    open(f"{path}/{listed[2]['path']}", "wb").write(content)
    with pytest.raises(Exception, match="artifact_digest"):
        arrays.read_blocks(spark, path).collect()


def test_writes_that_are_refused_leave_no_index(spark, tmp_path):
    rows = spark.range(12).select((F.col("id") / 4).cast("long").alias("a"), (F.col("id") % 4).alias("b"), F.col("id").cast("double").alias("value"))
    for i, (bad, reason) in enumerate((
        (rows.filter("NOT (a = 1 AND b = 2)"), "array_places"), (rows.unionByName(rows.limit(1)), "array_places"), (rows.filter("a < 2"), "array_places|block is missing"),
        (rows.withColumn("b", F.col("b") + 1), "array_place_outside"), (rows.withColumn("value", F.when(F.col("a") != 1, F.col("value"))), "array_value_missing"),
    )):
        path = tmp_path / str(i)
        with pytest.raises(Exception, match=reason):
            arrays.write_array(bad, str(path), (3, 4), ["a", "b"], block=4)
        assert not (path / arrays.INDEX).exists()
    arrays.write_array(rows, str(tmp_path / "good"), (3, 4), ["a", "b"], block=5)
    assert json.loads((tmp_path / "good" / arrays.INDEX).read_text())["shape"] == [3, 4]
