"""Requests a user sends: derived columns, cleaning actions, and the run context."""

from __future__ import annotations

from dataclasses import dataclass, field

# The request vocabulary.
FEATURE_TYPES = ("revenue", "margin", "margin_pct", "ratio", "discount", "derived_feature", "unknown")
PROBLEM_TYPES = ("classification", "regression")


@dataclass(frozen=True)
class AcceptedFeature:
    name: str | None
    type: str = "unknown"
    source_columns: tuple[str, ...] = ()
    formula: str | None = None
    status: str | None = "accepted"


@dataclass(frozen=True)
class CleaningAction:
    type: str
    column: str | None = None
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class AnalysisContext:
    target: str | None = None
    problem_type: str | None = None
    semantic_overrides: dict[str, str] = field(default_factory=dict)
    selected_features: tuple[str, ...] = ()
    accepted_features: tuple[AcceptedFeature, ...] = ()
    cleaning_actions: tuple[CleaningAction, ...] = ()
    #: Limits of the hypothesis tests and of the series; None takes all.
    max_groupings: int | None = None
    max_levels: int | None = None
    max_series: int | None = None
