"""Matcher settings and verticals: parsed once, validated, and passed on as literals."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

_CODE = re.compile(r"[0-9]{2,6}")


def _unit(owner: object, *names: str) -> None:
    for name in names:
        if not 0 <= getattr(owner, name) <= 1:
            raise ValueError(f"{type(owner).__name__}.{name} must lie between 0 and 1")


# Defaults that results depend on.
@dataclass(frozen=True)
class Candidates:
    months_before: int = 6
    months_after: int = 18
    award_types: tuple[str, ...] = ("A", "B", "C", "D", "IDV_B", "IDV_B_A", "IDV_B_B", "IDV_B_C", "IDV_E")
    vehicle_award_types: tuple[str, ...] = ("IDV_A", "IDV_C", "IDV_D")
    min_total_value: float = 25_000
    max_per_notice: int = 200

    def __post_init__(self) -> None:
        if self.months_before < 0 or self.months_after <= 0 or self.max_per_notice < 1 or self.min_total_value < 0:
            raise ValueError("candidate limits must be positive")
        if set(self.award_types) & set(self.vehicle_award_types):
            raise ValueError("an award type is either a candidate or a vehicle")


@dataclass(frozen=True)
class Weights:
    office: float = 0.20
    text: float = 0.35
    naics: float = 0.10
    end_date: float = 0.15
    psc: float = 0.10
    set_aside: float = 0.04
    value: float = 0.03
    vehicle: float = 0.03

    def __post_init__(self) -> None:
        _unit(self, *(f.name for f in fields(self)))
        if not math.isclose(sum(getattr(self, f.name) for f in fields(self)), 1.0, abs_tol=1e-9):
            raise ValueError("weights must sum to 1")


@dataclass(frozen=True)
class Features:
    office_same_subtier_only: float = 0.4
    naics_same_group: float = 0.6
    psc_same_prefix2: float = 0.6
    psc_same_prefix1: float = 0.3
    psc_missing: float = 0.5
    value_missing: float = 0.5
    vehicle_missing: float = 0.5
    text_full_at: float = 0.5
    end_date_ideal_from_days: int = -30
    end_date_ideal_to_days: int = 270

    def __post_init__(self) -> None:
        _unit(self, *(f.name for f in fields(self) if not f.name.startswith("end_date")))
        if self.text_full_at == 0 or self.end_date_ideal_from_days > self.end_date_ideal_to_days:
            raise ValueError("text_full_at must be positive and the ideal range in order")


@dataclass(frozen=True)
class ExplicitReference:
    score: float = 0.97
    context_words: tuple[str, ...] = (
        "incumbent", "follow-on", "follow on", "bridge", "recompete", "re-compete", "successor",
        "predecessor", "current contract", "currently performed", "extension",
    )
    context_chars: int = 120

    def __post_init__(self) -> None:
        _unit(self, "score")


@dataclass(frozen=True)
class Decision:
    incumbent_threshold: float = 0.8
    margin: float = 0.15
    possible_floor: float = 0.35
    max_possible: int = 3
    store_floor: float = 0.2
    store_max: int = 10

    def __post_init__(self) -> None:
        _unit(self, "incumbent_threshold", "margin", "possible_floor", "store_floor")
        if self.max_possible < 1 or self.store_max < self.max_possible:
            raise ValueError("store_max must hold all possible incumbents")
        if not self.store_floor <= self.possible_floor <= self.incumbent_threshold:
            raise ValueError("floors must rise to the threshold")


@dataclass(frozen=True)
class MatchingConfig:
    matcher_version: str = "2026-10-06.1"
    notice_types: tuple[str, ...] = (
        "Solicitation", "Combined Synopsis/Solicitation", "Presolicitation", "Sources Sought", "Special Notice",
    )
    days_after_posting_without_deadline: int = 30
    candidates: Candidates = field(default_factory=Candidates)
    weights: Weights = field(default_factory=Weights)
    features: Features = field(default_factory=Features)
    explicit_reference: ExplicitReference = field(default_factory=ExplicitReference)
    decision: Decision = field(default_factory=Decision)


def _build(kind: type, value: Mapping[str, Any]) -> Any:
    hints = get_type_hints(kind)
    unknown = set(value) - set(hints)
    if unknown:
        raise ValueError(f"unknown settings of {kind.__name__}: {', '.join(sorted(unknown))}")
    parts = {}
    for name, part in value.items():
        if is_dataclass(hints[name]):
            part = _build(hints[name], part)
        elif isinstance(part, list):
            part = tuple(part)
        parts[name] = part
    return kind(**parts)


def _load(path: str) -> Any:
    with open(path, encoding="utf-8") as lines:
        text = lines.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML settings need PyYAML; JSON works without it") from e
    return yaml.safe_load(text)


def load_matching_config(path: str) -> MatchingConfig:
    """Settings from a JSON or YAML file; unknown names and values out of range raise ValueError."""
    return _build(MatchingConfig, _load(path))


@dataclass(frozen=True)
class Vertical:
    key: str
    name: str
    naics: tuple[str, ...]

    def __post_init__(self) -> None:
        wrong = [c for c in self.naics if not _CODE.fullmatch(c)]
        if not self.naics or wrong:
            raise ValueError(f"vertical {self.key}: industry codes have 2 to 6 digits, not {wrong}")


#: The industry codes covered.
IT_PROFESSIONAL_SERVICES = Vertical(
    "it_professional_services",
    "IT and professional services",
    ("541511", "541512", "541513", "541519", "518210", "541611", "541612", "541618", "541690", "541330", "541990"),
)


def load_verticals(path: str) -> list[Vertical]:
    """Verticals from a JSON or YAML file; keys are unique."""
    found = [_build(Vertical, v) for v in _load(path)["verticals"]]
    if len({v.key for v in found}) != len(found):
        raise ValueError("vertical keys repeat")
    return found


def vertical_naics(verticals: list[Vertical] | None = None) -> tuple[str, ...]:
    """All codes, sorted and distinct."""
    return tuple(sorted({c for v in verticals or [IT_PROFESSIONAL_SERVICES] for c in v.naics}))
