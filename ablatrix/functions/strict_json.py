"""Strict JSON, which Spark's parsers are not: they take trailing text, repeated keys and numbers that aren't finite."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F

from ablatrix.errors import InvalidEvidence
from ablatrix.limits import DEPTH
from ablatrix.schemas import TEXT


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("json_duplicate_key")
    return out


def _not_finite(name: str) -> float:
    raise ValueError("json_number_not_finite")


def _finite(text: str) -> float:
    value = float(text)
    return value if math.isfinite(value) else _not_finite(text)


def _measure(value: object) -> tuple[int, int]:
    """(nodes, depth); the keys of an object are nodes too."""
    nodes, deepest, stack = 0, 0, [(value, 1)]
    while stack:
        x, depth = stack.pop()
        nodes, deepest = nodes + 1, max(deepest, depth)
        if isinstance(x, dict):
            nodes += len(x)
            stack += [(v, depth + 1) for v in x.values()]
        elif isinstance(x, list):
            stack += [(v, depth + 1) for v in x]
    return nodes, deepest


def refusal(text: str | None, most: int, depth: int = DEPTH) -> str | None:
    """Why evidence refuses a document, or None."""
    if text is None:
        return "json_missing"
    if text.count("[") + text.count("{") > most:
        return "json_too_many_nodes"
    try:
        value = json.loads(text, object_pairs_hook=_unique, parse_constant=_not_finite, parse_float=_finite)
    except RecursionError:
        return "json_too_deep"
    except ValueError as e:
        return str(e) if str(e).startswith("json_") else "json_malformed"
    nodes, deepest = _measure(value)
    return "json_too_deep" if deepest > depth else "json_too_many_nodes" if nodes > most else None


def strict_loads(text: str, most: int, depth: int = DEPTH) -> object:
    """The value of a document that evidence doesn't refuse."""
    if reason := refusal(text, most, depth):
        raise InvalidEvidence(reason)
    return json.loads(text)


@F.pandas_udf(TEXT)
def admitted(text: pd.Series, most: pd.Series) -> pd.Series:
    """refusal() of a column; most is the number of nodes that each document may have."""
    return pd.Series([refusal(t, int(m)) for t, m in zip(text, most)], dtype=object)
