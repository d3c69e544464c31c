"""The evidence data source: what a manifest doesn't bind is refused, filters choose files, and a bundle is published once and whole."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ablatrix.errors import InvalidEvidence
from ablatrix.sources import bundle

SCHEMA = "id long, split string, kind string, tags map<string,string>, scores array<struct<m:string,v:double>>"


@pytest.fixture
def published(spark, tmp_path):
    rows = [(i, "discovery" if i % 3 else "validation", "simple" if i % 2 else "format", {"k": str(i)}, [("m", i / 2)]) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "bundle")
    bundle.publish_evidence(df.repartition(3), path)
    return path, df


def manifest_of(path):
    return json.loads(open(f"{path}/{bundle.MANIFEST}").read())


def rewrite(path, manifest):
    with open(f"{path}/{bundle.MANIFEST}", "w") as f:
        json.dump(manifest, f)


def test_round_trip(spark, published):
    path, df = published
    back = bundle.evidence(spark, path)
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())
    listed = manifest_of(path)["artifacts"]
    assert len(listed) == 12 and {(e["split"], e["kind"]) for e in listed} == {(s, k) for s in ("discovery", "validation") for k in ("simple", "format")}


def test_roles_choose_files(spark, published):
    """Files of other splits and kinds are not opened: an altered one there is no matter; filters stay with Spark."""
    path, df = published
    for e in manifest_of(path)["artifacts"]:
        if (e["split"], e["kind"]) != ("discovery", "simple"):
            with open(f"{path}/{e['path']}", "ab") as f:
                f.write(b"x")
    found = bundle.evidence(spark, path, split=["discovery"], kind=["simple", "other"])
    assert found.rdd.getNumPartitions() == 3
    for more in ("id > 50", "id <= 50", "true"):
        assert sorted(found.filter(more).collect()) == sorted(df.filter(f"split = 'discovery' AND kind = 'simple' AND {more}").collect())
    assert bundle.evidence(spark, path, split=["nowhere"]).count() == 0
    with pytest.raises(Exception, match="artifact_size"):
        bundle.evidence(spark, path, kind=["format"]).collect()


def test_a_table_may_be_filtered_more_than_once(spark, published):
    path, df = published
    rows = bundle.evidence(spark, path)
    for wanted in ("split = 'validation'", "split = 'discovery'", "kind = 'simple'", "true"):
        assert rows.filter(wanted).count() == df.filter(wanted).count()


def test_a_role_that_files_lack_cannot_choose(spark, tmp_path):
    bundle.publish_evidence(spark.range(5), str(tmp_path / "b"))
    with pytest.raises(Exception, match="role_unknown"):
        bundle.evidence(spark, str(tmp_path / "b"), split=["discovery"]).collect()


@pytest.mark.parametrize("reason,change", [
    ("artifact_size", lambda p, e, m: open(f"{p}/{e['path']}", "ab").write(b"x")),
    ("artifact_size", lambda p, e, m: rewrite(p, m | {"artifacts": [x | {"bytes": x["bytes"] - 1} for x in m["artifacts"]]})),
    ("artifact_digest", lambda p, e, m: open(f"{p}/{e['path']}", "r+b").write(b"X")),
    ("artifact_missing", lambda p, e, m: __import__("os").unlink(f"{p}/{e['path']}")),
    ("artifact_unbound", lambda p, e, m: rewrite(p, m | {"artifacts": m["artifacts"][1:]})),
    ("artifact_unbound", lambda p, e, m: open(f"{p}/stray.json", "w").write("{}")),
    ("artifact_listed_twice", lambda p, e, m: rewrite(p, m | {"artifacts": [*m["artifacts"], e]})),
    ("artifact_path", lambda p, e, m: rewrite(p, m | {"artifacts": [e | {"path": "../x"}]})),
    ("artifact_path", lambda p, e, m: rewrite(p, m | {"artifacts": [e | {"path": "/etc/x"}]})),
    ("digest_malformed", lambda p, e, m: rewrite(p, m | {"artifacts": [e | {"sha256": "ABC"}]})),
    ("artifact_too_large", lambda p, e, m: rewrite(p, m | {"artifacts": [e | {"bytes": 1 << 40}]})),
    ("manifest_malformed", lambda p, e, m: rewrite(p, m | {"artifacts": {}})),
    ("json_duplicate_key", lambda p, e, m: open(f"{p}/{bundle.MANIFEST}", "w").write('{"artifacts": [], "artifacts": []}')),
    ("artifact_is_link", lambda p, e, m: __import__("os").symlink(f"{p}/{e['path']}", f"{p}/link.parquet")),
    ("role_differs", lambda p, e, m: rewrite(p, m | {"artifacts": [x | {"split": "other"} for x in m["artifacts"]]})),
])
def test_what_differs_from_the_manifest_is_refused(spark, published, reason, change):
    path, df = published
    manifest = manifest_of(path)
    change(path, manifest["artifacts"][0], manifest)
    with pytest.raises(Exception, match=reason):
        bundle.evidence(spark, path, df.schema).collect()


def test_limits_are_options(spark, published):
    path, _ = published
    for option, reason in (("maxEntries", "bundle_too_many_entries"), ("maxBundleBytes", "bundle_too_large"), ("maxArtifactBytes", "artifact_too_large")):
        with pytest.raises(Exception, match=reason):
            bundle.evidence(spark, path, **{option: 5}).collect()


def test_json_lines_are_read_strictly(spark, tmp_path):
    root = tmp_path / "b"
    root.mkdir()

    def bound(text):
        (root / "a.jsonl").write_text(text)
        content = text.encode()
        rewrite(str(root), {"artifacts": [{"path": "a.jsonl", "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest(), "split": "d"}]})
        return bundle.evidence(spark, str(root), SCHEMA)

    rows = bound('{"id": 1, "split": "d", "tags": {"a": "b"}, "scores": [{"m": "x", "v": 1.5}]}\n\n{"id": 2, "split": "d"}\n').collect()
    assert [(r.id, r.tags, r.scores) for r in rows] == [(1, {"a": "b"}, [("x", 1.5)]), (2, None, None)]
    for text, reason in (('{"id": 1, "id": 2}', "json_duplicate_key"), ('{"id": NaN}', "json_number_not_finite"), ('{"id": 1} x', "json_malformed"), ('{"id": "x"}', "record_malformed"), ('{"extra": 1}', "field_unknown")):
        with pytest.raises(Exception, match=reason):
            bound(text).collect()
    with pytest.raises(Exception, match="manifest_without_schema"):
        bundle.evidence(spark, str(root)).collect()


def test_a_second_write_is_refused(spark, published):
    path, df = published
    before = manifest_of(path)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="evidence_already_published"):
            df.write.format(bundle.FORMAT).mode(mode).save(path)
    assert manifest_of(path) == before and bundle.evidence(spark, path).count() == 200
    store = bundle.Store(path)
    with pytest.raises(InvalidEvidence, match="already"):
        store.write_once(bundle.MANIFEST, b"{}")
    assert manifest_of(path) == before


def test_a_failed_task_leaves_no_manifest_and_no_file(spark, tmp_path):
    path = tmp_path / "failed"
    broken = spark.range(0, 400, 1, 4).withColumn("x", F.when(F.col("id") == 399, F.raise_error(F.lit("lost"))).otherwise(F.lit("a")))
    with pytest.raises(Exception, match="lost"):
        bundle.publish_evidence(broken, str(path))
    assert not (path / bundle.MANIFEST).exists()
    left = list(path.glob("part-*")) if path.exists() else []
    bundle.publish_evidence(spark.range(10), str(path))  # takes away what tasks may have left
    assert bundle.evidence(spark, str(path)).count() == 10 and len(list(path.glob("part-*"))) <= len(left) + 8


def test_sensitive_columns_and_large_rows_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="sensitive"):
        bundle.publish_evidence(spark.createDataFrame([("p",)], "prompt string"), str(tmp_path / "s"))
    assert not (tmp_path / "s").exists()
    rows = spark.range(0, 300, 1, 1).withColumn("t", F.sha2(F.col("id").cast("string"), 256))
    bundle.publish_evidence(rows, str(tmp_path / "split"), maxArtifactBytes=4000)
    listed = manifest_of(str(tmp_path / "split"))["artifacts"]
    assert len(listed) >= 4 and all(e["bytes"] <= 4000 for e in listed) and bundle.evidence(spark, str(tmp_path / "split")).count() == 300
    with pytest.raises(Exception, match="artifact_too_large"):
        bundle.publish_evidence(rows, str(tmp_path / "large"), maxArtifactBytes=100)
    assert not list((tmp_path / "large").glob("*"))
