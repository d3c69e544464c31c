"""Validation of configurations and protocols on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ablatrix.errors import InvalidConfiguration

MUTABLE_REVISIONS = frozenset({"main", "master", "head", "latest", "trunk"})
DIRECTIONS, ROLES = ("higher_is_better", "lower_is_better"), ("target", "collateral")
FORMULAS = {"higher_is_better": "baseline_minus_condition", "lower_is_better": "relative_increase"}


@dataclass(frozen=True)
class Metric:
    id: str
    role: str
    direction: str

    def __post_init__(self):
        if self.role not in ROLES or self.direction not in DIRECTIONS:
            raise InvalidConfiguration("metric_protocol_invalid", self.id)


@dataclass(frozen=True)
class Experiment:
    """One experiment, checked as it is made; anything unknown is refused by from_mapping()."""

    revision: str
    discovery: str
    validation: str
    metrics: tuple[Metric, ...]
    seed: int = 0
    repetitions: int = 1
    warmups: int = 0
    parameters: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.revision.lower() in MUTABLE_REVISIONS or self.revision.startswith("refs/heads/"):
            raise InvalidConfiguration("model_revision_mutable", self.revision)
        if self.discovery == self.validation:
            raise InvalidConfiguration("partitions_not_distinct", self.discovery)
        if not self.metrics or len({m.id for m in self.metrics}) < len(self.metrics):
            raise InvalidConfiguration("metrics_missing_or_duplicated")
        if not 0 <= self.seed < 2**32 or self.repetitions < 1 or self.warmups < 0:
            raise InvalidConfiguration("measurement_controls_invalid")

    @classmethod
    def from_mapping(cls, value: dict) -> Experiment:
        known = set(cls.__dataclass_fields__)
        if unknown := sorted(set(value) - known):
            raise InvalidConfiguration("configuration_key_unknown", unknown[0])
        try:
            return cls(**{k: tuple(Metric(**m) for m in v) if k == "metrics" else v for k, v in value.items()})
        except TypeError as e:
            raise InvalidConfiguration("configuration_invalid", str(e)) from e


def validate_rule(rule: dict) -> None:
    for name in ("target_absolute_damage_max", "collateral_absolute_damage_max", "perplexity_relative_damage_max", "minimum_drift_margin"):
        if not isinstance(rule.get(name), (int, float)) or isinstance(rule[name], bool) or not 0 <= rule[name] < 1:
            raise InvalidConfiguration("decision_rule_invalid", name)


def validate_protocol(protocol: dict) -> None:
    """Digests, seeds, metrics with their formulas, the rule, and the artifacts that a bundle must have."""
    for name in ("records_sha256", "dataset_sha256"):
        if not re.fullmatch("[0-9a-f]{64}", str(protocol.get(name, ""))):
            raise InvalidConfiguration("protocol_digest_invalid", name)
    seed = protocol.get("seed")
    if not isinstance(seed, int) or isinstance(seed, bool) or not 0 <= seed < 2**32:
        raise InvalidConfiguration("protocol_seed_invalid")
    metrics = protocol.get("metrics")
    if not isinstance(metrics, dict) or not metrics:
        raise InvalidConfiguration("protocol_metrics_invalid")
    for name, m in metrics.items():
        Metric(name, m.get("role", ""), m.get("direction", ""))
        if m.get("damage_formula", FORMULAS[m["direction"]]) != FORMULAS[m["direction"]]:
            raise InvalidConfiguration("protocol_damage_formula_invalid", name)
    validate_rule(protocol.get("decision_rule", {}))
    artifacts = protocol.get("required_artifacts", [])
    if len(set(artifacts)) < len(artifacts):
        raise InvalidConfiguration("protocol_artifacts_duplicated")
