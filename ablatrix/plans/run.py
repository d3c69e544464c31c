"""Execution of a plan: models as per-partition functions, evaluation suites as column functions."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ablatrix.errors import InvalidConfiguration
from ablatrix.functions.scoring import text_match
from ablatrix.schemas import REAL, TEXT, struct

DAMAGED = "damaged"


class Model(Protocol):
    """Loaded once a task: run(text, component) with that component bypassed, none if it is None."""

    def run(self, text: str, component: str | None) -> str: ...


class Suite(Protocol):
    """score(output, expected) gives a map of scores as a column."""

    name: str

    def score(self, output: Column, expected: Column) -> Column: ...


class ExactMatch:
    """The output is the expected text, outer white space aside."""

    name = "exact_match"

    def score(self, output: Column, expected: Column) -> Column:
        value = text_match(output, expected)
        score = F.struct(value.alias("value"), value.alias("numerator"), F.lit(1).cast("long").alias("denominator"), F.lit(None).cast("string").alias("reason"))
        return F.create_map(F.lit("exact_match"), score)


class Registry:
    """Extensions by kind and name; a name is taken once."""

    kinds = ("dataset", "model", "suite", "intervention", "runtime")

    def __init__(self):
        self._found: dict[tuple[str, str], object] = {}

    def register(self, kind: str, name: str, extension: object, needs: Sequence[str] = ()) -> None:
        if kind not in self.kinds:
            raise InvalidConfiguration("plugin_kind_unknown", kind)
        if (kind, name) in self._found:
            raise InvalidConfiguration("plugin_ambiguous", name)
        if missing := [m for m in needs if not callable(getattr(extension, m, None))]:
            raise InvalidConfiguration("plugin_method_missing", missing[0])
        self._found[kind, name] = extension

    def resolve(self, kind: str, name: str) -> object:
        if (kind, name) not in self._found:
            raise InvalidConfiguration("plugin_not_found", name)
        return self._found[kind, name]


def synthetic_output(text: Column, component: Column, damaging: str = "component.damage") -> Column:
    """The synthetic model, as an expression: it echoes, unless its one component that matters is bypassed."""
    return F.when(component == damaging, DAMAGED).otherwise(text)


def measure(grid: DataFrame, load: Callable[[], Model], warmups: int = 0) -> DataFrame:
    """Run a model over the grid (text, component_id, and any other columns): adds raw_output, status, error_type, elapsed_seconds.

    The model is loaded once a task and warmed up on the task's first text.  A row on which it fails is an error
    observation; nothing raises.
    """
    schema = T.StructType([*grid.schema.fields, *struct(raw_output=TEXT, status=TEXT, error_type=TEXT, elapsed_seconds=REAL).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, warm = load(), warmups
        for pdf in batches:
            out: list[tuple] = []
            for text, component in zip(pdf["text"], pdf["component_id"]):
                component = component if isinstance(component, str) else None
                for _ in range(warm):
                    with contextlib.suppress(Exception):
                        model.run(text, None)
                warm, began = 0, time.monotonic()
                try:
                    out.append((model.run(text, component), "complete", None, time.monotonic() - began))
                except Exception as e:  # an error observation
                    out.append((None, "error", type(e).__name__, time.monotonic() - began))
            for i, name in enumerate(("raw_output", "status", "error_type", "elapsed_seconds")):
                pdf[name] = pd.Series([o[i] for o in out], index=pdf.index, dtype=object if i < 3 else float)
            yield pdf

    return grid.mapInPandas(run, schema)


def evaluate(outputs: DataFrame, suite: Suite) -> DataFrame:
    """Add scores, and the metrics that were expected; an error has none."""
    scores = F.when(F.col("status") == "complete", suite.score(F.col("raw_output"), F.col("expected")))
    return outputs.withColumn("scores", scores).withColumn("expected_metric_ids", F.coalesce(F.map_keys("scores"), F.array().cast("array<string>")))


def synthetic_scan(records: DataFrame, tasks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every record under every task with the synthetic model: records have id and text, tasks id and component_id.

    Both the output and its score are expressions, so the whole scan is one stage.
    """
    grid = records.crossJoin(tasks.select(F.col("id").alias("cond"), "component_id"))  # a plan's full product
    output = synthetic_output(F.col("text"), F.col("component_id"))
    return grid.select(*keep, "cond", "component_id", output.alias("raw_output"), text_match(output, F.col("expected")).alias("value"))
