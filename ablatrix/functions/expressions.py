"""Scalar expressions on columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the decision rules.
TIE = 1e-9
MATERIAL, MATERIAL_TIE = 0.10, 1e-12


def exceeds(damage: Column, threshold: Column, semantics: str = "2") -> Column:
    """Damage above its threshold; version 2 forgives TIE, version 1 nothing."""
    return damage > (threshold + F.lit(TIE) if semantics == "2" else threshold)


def material(value: Column, at: float = MATERIAL) -> Column:
    return value >= F.lit(at) - F.lit(MATERIAL_TIE)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def close(a: Column, b: Column, relative: float, absolute: float = 0.0) -> Column:
    """Within either tolerance, the relative one of the larger magnitude; equal infinities are close."""
    return (a == b) | (F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * relative, F.lit(absolute)))


def strip(text: Column) -> Column:
    """Outer white space removed, as Unicode has it."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def layer_of(component: Column) -> Column:
    """The last dotted part as a number."""
    return F.element_at(F.split(component, "[.]"), -1).cast("int")


def block_id(layer: Column) -> Column:
    return F.format_string("transformer.block.%03d", layer)


def joined_ids(ids: Column) -> Column:
    """Distinct ids in order, joined by semicolons."""
    return F.array_join(F.array_sort(F.array_distinct(ids)), ";")


def threshold_for(direction: Column, role: Column, rule: dict[str, float]) -> Column:
    """Direction is asked before role."""
    return (
        F.when(direction == "lower_is_better", F.lit(rule["perplexity_relative_damage_max"]))
        .when(role == "target", F.lit(rule["target_absolute_damage_max"]))
        .otherwise(F.lit(rule["collateral_absolute_damage_max"]))
    )


def derived_seed(seed: int, domain: str) -> int:
    """The first eight bytes of sha256("seed:domain"), unsigned, high byte first."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{domain}".encode()).digest()[:8], "big")


def derived_seed_column(seed: Column, domain: Column) -> Column:
    """derived_seed() of columns, as decimal(20,0)."""
    digest = F.sha2(F.concat_ws(":", seed.cast("string"), domain), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


HEX_DIGEST = "^[0-9a-f]{64}$"
SPAN_ID = "^[0-9a-f]{16}$"
TRACE_ID = "^[0-9a-f]{32}$"
TASK_ID = "^[a-z0-9]+([._-][a-z0-9]+)*$"


def matches(column: Column, pattern: str) -> Column:
    return F.coalesce(column.rlike(pattern), F.lit(False))
