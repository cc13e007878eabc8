"""Validated values, criteria, options and reason names."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from enum import Enum


class SpecError(ValueError):
    """A value is out of its range."""


def _whole(value: object, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{what} must be an int, not {type(value).__name__}")
    return value


@dataclass(frozen=True, order=True)
class MatchRatio:
    """Comparators per anchor, at least 1."""

    value: int

    def __post_init__(self) -> None:
        if _whole(self.value, "ratio") < 1:
            raise SpecError("ratio must be at least 1")


@dataclass(frozen=True)
class BirthWindowDays:
    """Days by which birth dates may differ, at least 0."""

    value: int

    def __post_init__(self) -> None:
        if _whole(self.value, "window") < 0:
            raise SpecError("window must not be negative")


@dataclass(frozen=True)
class AgeLimitYears:
    """Age in years, 1 to 255."""

    value: int

    def __post_init__(self) -> None:
        if not 1 <= _whole(self.value, "age limit") <= 255:
            raise SpecError("age limit must be 1 to 255")


@dataclass(frozen=True)
class DistanceCaliper:
    """Largest distance that is accepted, finite and at least 0."""

    value: float

    def __post_init__(self) -> None:
        if isinstance(self.value, bool) or not isinstance(self.value, (int, float)):
            raise TypeError("caliper must be a number")
        if not math.isfinite(self.value) or self.value < 0:
            raise SpecError("caliper must be finite and not negative")


class Estimand(Enum):
    ATT = "Att"
    ATC = "Atc"
    ATE = "Ate"
    ATM = "Atm"


class CommonSupport(Enum):
    TREATED = "Treated"
    CONTROL = "Control"
    BOTH = "Both"


@dataclass(frozen=True)
class MatchingCriteria:
    """What pairs must satisfy. Plain numbers are checked by invalid_reason, so that a bad value gives an outcome with a reason."""

    birth_window_days: int = 30
    ratio: int = 1
    required_strata: tuple[str, ...] = ()
    unique_by_key: str | None = None
    allow_replacement: bool = False
    estimand: Estimand = Estimand.ATT
    common_support: CommonSupport | None = None

    def invalid_reason(self) -> str | None:
        if self.birth_window_days < 0:
            return "negative_birth_date_window"
        if self.ratio < 1:
            return "zero_match_ratio"
        return None

    def with_(self, **changes: object) -> MatchingCriteria:
        return replace(self, **changes)


@dataclass(frozen=True)
class RatioPolicy:
    """How many comparators an anchor takes from those available.

    Without a fallback: as many as there are, up to the ratio. With one: the largest listed ratio that is
    available, else none; the primary ratio then plays no part.
    """

    steps: tuple[int, ...]
    strict: bool

    @classmethod
    def of(cls, ratio: int, fallback: Sequence[MatchRatio] = ()) -> RatioPolicy:
        for r in fallback:
            if not isinstance(r, MatchRatio):
                raise TypeError("fallback ratios must be MatchRatio")
        if fallback:
            return cls(tuple(sorted({r.value for r in fallback}, reverse=True)), True)
        return cls((ratio,), False)

    def target(self, available: int) -> int | None:
        if available <= 0:
            return None
        if not self.strict:
            return min(available, self.steps[0])
        return next((s for s in self.steps if s <= available), None)

    def is_shortfall(self, available: int) -> bool:
        return not self.strict and available < self.steps[0]


@dataclass(frozen=True)
class TransitionOptions:
    """Who may become a case, and how many comparators a case takes."""

    age_limit: AgeLimitYears = field(default_factory=lambda: AgeLimitYears(6))
    ratio_fallback: tuple[MatchRatio, ...] = ()

    def __post_init__(self) -> None:
        if not isinstance(self.age_limit, AgeLimitYears):
            raise TypeError("the age limit must be AgeLimitYears")


@dataclass(frozen=True)
class BalanceThresholds:
    """Limits for numeric balance after matching; None switches a check, or one side of the variance ratio's, off."""

    smd: float | None = 0.1
    var_ratio_min: float | None = 0.8
    var_ratio_max: float | None = 1.25
    ecdf_max: float | None = 0.1
    eqq_max: float | None = None

    # The limits of the three profiles, the defaults being the moderate one.
    @classmethod
    def strict(cls) -> BalanceThresholds:
        return cls(0.05, 0.9, 1.11, 0.05)

    @classmethod
    def moderate(cls) -> BalanceThresholds:
        return cls()

    @classmethod
    def lenient(cls) -> BalanceThresholds:
        return cls(0.15, 0.67, 1.5, 0.15)


class Transform(Enum):
    NONE = "none"
    SQUARES = "squares"
    SQUARES_AND_INTERACTIONS = "squares_and_pairwise_interactions"


#: Reason names that are typed; all others are custom.
TYPED_CONSTRAINT_REASONS = (
    "replacement_disallowed",
    "no_self_match",
    "missing_required_strata",
    "unique_key_reused",
    "distance_caliper",
    "gender_mismatch",
    "caliper_exceeded",
    "date_window_exceeded",
    "parent_date_mismatch",
    "same_family",
    "control_already_used_in_primary_tier",
    "not_alive_at_index",
    "not_resident_at_index",
)
#: Categories in the order in which reasons are reported.
CATEGORIES = ("additional_filter", "constraint", "distance_caliper", "invalid_criteria", "common_support_failure")
#: Why the realized estimand differs from the requested one.
DRIFT_REASONS = ("common_support_trimming", "unmatched_anchors", "ratio_shortfall", "distance_caliper_exclusion", "common_support_caliper_interaction")


@dataclass(frozen=True)
class Reason:
    """Why pairs were excluded, or a whole run was refused."""

    category: str
    name: str = ""

    @property
    def typed(self) -> bool:
        known = {"constraint": TYPED_CONSTRAINT_REASONS, "distance_caliper": ("distance_caliper",)}
        return self.category not in known or self.name in known[self.category]

    def __str__(self) -> str:
        if self.category in ("invalid_criteria", "common_support_failure"):
            return f"{self.category}:{self.name}"
        return self.name or self.category

    def order(self) -> tuple:
        """Categories in their order; within one, typed reasons in theirs, then custom ones by name."""
        place = TYPED_CONSTRAINT_REASONS.index(self.name) if self.category == "constraint" and self.typed else len(TYPED_CONSTRAINT_REASONS)
        return CATEGORIES.index(self.category), place, self.name
