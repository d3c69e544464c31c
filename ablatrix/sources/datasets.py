"""Dataset providers: records by split, what they are, and tables of what is wrong with them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ablatrix.errors import InvalidConfiguration
from ablatrix.functions.json_schema import problems
from ablatrix.operators.verify import enforce, union_violations, violation
from ablatrix.sources import evidence as documents
from ablatrix.sources.bundle import evidence
from ablatrix.sources.sinks import payload_digest

ROLES = ("discovery", "validation")
#: What a record plan and records have in common.
PLANNED = ("id", "group_id", "kind", "split")


def repeated(rows: DataFrame, column: str, rule: str) -> DataFrame:
    """Values that more rows than one have."""
    return violation(rows.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1"), rule, F.col(column), F.lit(1), F.col("n"))


def crossing(rows: DataFrame, column: str, rule: str) -> DataFrame:
    """Values that rows of more splits than one have; two splits are counted without holding all."""
    ends = rows.groupBy(column).agg(F.min("split").alias("low"), F.max("split").alias("high")).filter("low <> high")
    return violation(ends, rule, F.col(column), F.col("low"), F.col("high"))


def membership(records: DataFrame, plan: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """Violations of a frozen plan: records (id, group_id, kind, split) must be its rows, each once, and no others.

    Ids occur once, groups stay in one split, splits are the roles.  One shuffle by id compares both sides as multisets.
    """
    key = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PLANNED))
    sides = records.select(key.alias("key"), F.lit(1).alias("found"), F.lit(0).alias("planned")).unionByName(plan.select(key.alias("key"), F.lit(0).alias("found"), F.lit(1).alias("planned")))
    counts = sides.groupBy("key").agg(F.sum("found").alias("found"), F.sum("planned").alias("planned"))
    rule = F.when(F.col("planned") == 0, "record_unplanned").when(F.col("found") < F.col("planned"), "record_missing").when(F.col("found") > F.col("planned"), "record_repeated")
    differ = counts.withColumn("rule", rule).filter("rule IS NOT NULL").select("rule", "key", F.col("planned").cast("string").alias("expected"), F.col("found").cast("string").alias("actual"))
    strange = records.filter(~F.coalesce(F.col("split").isin(*roles), F.lit(False)))
    return union_violations(
        differ, repeated(records, "id", "record_id_repeated"), crossing(records, "group_id", "group_crosses_splits"),
        violation(strange, "split_unknown", F.col("id"), F.lit(",".join(roles)), F.coalesce("split", F.lit(""))),
    )


def plan_identity(plan: DataFrame, recorded_sha256: str | None = None) -> DataFrame:
    """Violations of a record plan itself: ids that repeat, groups that cross splits, places in a split and kind that aren't 1 to n, another digest than recorded."""
    places = plan.groupBy("split", "kind").agg(F.count("*").alias("n"), F.countDistinct("ordinal").alias("distinct"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"))
    gaps = places.filter("distinct <> n OR low <> 1 OR high <> n")
    found = [repeated(plan, "id", "plan_id_repeated"), crossing(plan, "group_id", "plan_group_crosses_splits"), violation(gaps, "plan_ordinals", F.concat_ws("/", "split", "kind"), F.concat_ws("-", F.lit(1), "n"), F.concat_ws("-", "low", "high"))]
    if recorded_sha256 is not None:
        digest = payload_digest(plan).filter(F.col("payload_sha256") != recorded_sha256)
        found.append(violation(digest, "plan_digest", F.lit("plan"), F.lit(recorded_sha256), F.col("payload_sha256")))
    return union_violations(*found)


def schema_violations(rows: DataFrame, key: Column, text: Column, schema: Mapping) -> DataFrame:
    """(rule, key, expected, actual): what a JSON Schema finds wrong with each row's JSON; actual is the path."""
    out = rows.select(key.cast("string").alias("key"), F.explode(problems(text, schema)).alias("p"))
    return out.select(F.concat(F.lit("schema_"), F.col("p.rule")).alias("rule"), "key", F.lit("").alias("expected"), F.col("p.path").alias("actual"))


class DatasetProvider(ABC):
    """Records in splits.  A provider never hands out records before enforce() has found nothing wrong with them."""

    name: str
    version = "1"

    @abstractmethod
    def all_records(self) -> DataFrame:
        """Every record, with columns id and split."""

    def violations(self) -> DataFrame:
        return repeated(self.all_records(), "id", "record_id_repeated")

    def splits(self) -> list[str]:
        return sorted(r.split for r in self.all_records().select("split").distinct().collect())

    def records(self, split: str) -> DataFrame:
        found = self.all_records().filter(F.col("split") == split)
        if found.isEmpty():
            raise InvalidConfiguration("dataset_split_unavailable", split)
        return found

    def validate_for(self, schema: Mapping) -> DataFrame:
        """Violations of the record schema that a suite asks for."""
        rows = self.all_records()
        return schema_violations(rows, F.col("id"), F.to_json(F.struct(*(F.col(c) for c in rows.columns if c != "split")), {"ignoreNullFields": "false"}), schema)

    def metadata(self) -> dict[str, object]:
        """Name, version, digest of all records as a multiset, and the splits."""
        return {"provider": self.name, "version": self.version, "sha256": payload_digest(self.all_records()).first().payload_sha256, "splits": self.splits()}

    def checked(self) -> DatasetProvider:
        enforce(self.violations())
        return self


class ManifestDataset(DatasetProvider):
    """Records that a JSON document lists by split; a record's own partition has to be the one that lists it."""

    name = "manifest-records"

    def __init__(self, spark: SparkSession, path: str):
        self.rows = documents.dataset_records(spark, path)

    def all_records(self) -> DataFrame:
        return self.rows

    def violations(self) -> DataFrame:
        other = self.rows.filter(~F.col("partition").eqNullSafe(F.col("split")))
        return union_violations(super().violations(), violation(other, "partition_differs", F.col("id"), F.col("split"), F.coalesce("partition", F.lit(""))))


class EvidenceDataset(DatasetProvider):
    """Records of an evidence bundle: a split's files alone are opened, each against its digest."""

    name = "evidence-records"

    def __init__(self, spark: SparkSession, path: str, **options: int):
        self.read = lambda **roles: evidence(spark, path, **roles, **options)

    def all_records(self) -> DataFrame:
        return self.read()

    def records(self, split: str) -> DataFrame:
        found = self.read(split=[split])
        if found.isEmpty():
            raise InvalidConfiguration("dataset_split_unavailable", split)
        return found


class FrozenDataset(DatasetProvider):
    """Records whose roles a plan has frozen: those of the plan and no others, groups apart."""

    name = "frozen-roles"

    def __init__(self, rows: DataFrame, plan: DataFrame, recorded_sha256: str | None = None):
        self.rows, self.plan, self.recorded = rows, plan, recorded_sha256

    def all_records(self) -> DataFrame:
        return self.rows

    def violations(self) -> DataFrame:
        return union_violations(membership(self.rows, self.plan), plan_identity(self.plan, self.recorded))
