"""The plan of a campaign: which conditions run, in which order, over which records."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ablatrix import schemas
from ablatrix.errors import InvalidConfiguration, InvalidEvidence
from ablatrix.operators.rank import first_n, numbered, shortfalls

#: Records of each kind that the published protocol takes from each split.
PUBLISHED_COUNTS = {"simple": 20, "abstention": 10, "reasoning": 10, "perplexity": 5, "format": 5}


def shuffled(ids: Sequence[str], seed: int) -> list[str]:
    """A Mersenne-twister shuffle; Spark's own shuffles follow another stream."""
    out = list(ids)
    random.Random(seed).shuffle(out)
    return out


def matched_random(ids: Sequence[str], count: int, seed: int) -> list[str]:
    return random.Random(seed).sample(list(ids), count)


#: Fixed values of the published protocol: what surrounds the scans, as (section, id, stage, condition, position).
SURROUND = (
    (0, "baseline.beginning", "baseline", "baseline", "beginning"),
    (1, "control.no-op", "control", "no_op", None),
    (5, "baseline.end", "baseline", "baseline", "end"),
)
SCANS, CONTROLS = 2, 4


def campaign_tasks(components: Sequence[str], seed: int, *, matched: int, middle: float = 0.5, no_op: bool = True) -> list[tuple]:
    """(section, place, id, stage, condition, component, position) of each task, in no order: section and place tell it.

    Scans have the odd places of their section, by component, so that the middle baseline one finds an even place between
    two of them; matched controls come in a section of their own, as drawn.
    """
    n = len(components)
    for refused, error in (
        (n == 0 or n != len(set(components)), InvalidEvidence("component_plan_invalid")),
        (not 0.0 < middle < 1.0, InvalidConfiguration("middle_control_placement_invalid")),
        (matched not in range(n + 1), InvalidConfiguration("matched_control_count_invalid")),
    ):
        if refused:
            raise error
    between = min(max(math.ceil(n * middle), 1), n - 1)
    tasks = {id: (section, 0, id, stage, condition, None, at) for section, id, stage, condition, at in SURROUND if no_op or condition != "no_op"}
    tasks["baseline.middle"] = (SCANS, 2 * between, "baseline.middle", "baseline", "baseline", None, "middle")
    tasks |= {f"scan.{c}": (SCANS, 2 * i + 1, f"scan.{c}", "scan", "bypass", c, None) for i, c in enumerate(components)}
    drawn = matched_random(components, matched, seed)
    tasks |= {f"control.random.{c}": (CONTROLS, i, f"control.random.{c}", "control", "matched_random", c, None) for i, c in enumerate(drawn)}
    return list(tasks.values())


def campaign_plan(spark: SparkSession, components: Sequence[str], seed: int, **options) -> DataFrame:
    """The campaign's tasks as schemas.TASK, numbered by section and place."""
    fields = [f for f in schemas.TASK.fields if f.name != "ordinal"]
    rows = spark.createDataFrame(campaign_tasks(components, seed, **options), T.StructType([T.StructField("section", schemas.INT), T.StructField("place", schemas.INT), *fields]))
    ordered = numbered(rows, [], ["section", "place"])
    return ordered.select((F.col("ordinal") - 1).cast("int").alias("ordinal"), *(f.name for f in fields))


def generic_plan(spark: SparkSession, components: Sequence[str]) -> DataFrame:
    """A baseline, then a scan of each component."""
    rows = [("baseline", "baseline", "baseline", None, None), *((f"scan.{c.replace('.', '-')}", "scan", "bypass", c, None) for c in components)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schemas.TASK)


def record_counts(counts: dict[str, int], kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in counts.items() for x in pair)), kind), F.lit(0))


def record_plan(records: DataFrame, counts: dict[str, int], order: Sequence[str]) -> DataFrame:
    """The first records of each split and kind, in source order."""
    return first_n(records, ["split", "kind"], order, record_counts(counts, F.col("kind")), max(counts.values(), default=0))


def record_shortfalls(records: DataFrame, counts: dict[str, int]) -> DataFrame:
    return shortfalls(records, ["split", "kind"], record_counts(counts, F.col("kind")))


def observation_grid(plan: DataFrame, records: DataFrame, repetitions: int) -> DataFrame:
    """Every task over every record and repetition: the campaign's work list, which is its plan's full product."""
    tasks = plan.select(F.col("id").alias("cond"), "component_id", F.col("ordinal").alias("task_ordinal"))
    numbers = F.sequence(F.lit(0), F.lit(repetitions - 1))
    return records.crossJoin(tasks).withColumn("repetition", F.explode(numbers))
