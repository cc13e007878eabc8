"""Pairwise constraints: a reason, and a condition over the two sides of an edge.

A side is a function from a column's name to that side's column; role columns have the names of
pairwell.sources.cohort. The first constraint that fails names the exclusion.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwell.sources.cohort import finite

Side = Callable[[str], Column]


@dataclass(frozen=True)
class Constraint:
    """allows(anchor side, candidate side) is a boolean column; null counts as not allowed.

    until: if given, allows says that the candidate's until is missing or later than the anchor's event date.
    """

    reason: str
    allows: Callable[[Side, Side], Column]
    until: Callable[[Side], Column] | None = None

    def with_reason(self, reason: str) -> Constraint:
        return Constraint(reason, self.allows, self.until)


def side(alias: str) -> Side:
    return lambda name: F.col(f"{alias}.`{name}`")


def first_blocking(constraints: Sequence[Constraint], a: Side, c: Side) -> Column:
    """Reason of the first constraint that does not allow the pair, or null."""
    tests = [F.when(~F.coalesce(k.allows(a, c), F.lit(False)), F.lit(k.reason)) for k in constraints]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def no_self_match() -> Constraint:
    return Constraint("self_match", lambda a, c: a("__id") != c("__id"))


def exact_strata(count: int) -> Constraint:
    """All required strata are equal; missing equals missing."""

    def allows(a: Side, c: Side) -> Column:
        out = F.lit(True)
        for k in range(count):
            out = out & a(f"__s{k}").eqNullSafe(c(f"__s{k}"))
        return out

    return Constraint("strata_mismatch", allows)


def gender_match(column: str = "gender", allow_unknown: bool = False) -> Constraint:
    """Equal values; if either is missing, allow_unknown decides."""
    return Constraint("gender_mismatch", lambda a, c: F.coalesce(a(column) == c(column), F.lit(allow_unknown)))


def caliper(column: str | Callable[[Side], Column], window: float) -> Constraint:
    """Both values are there and differ by at most window."""
    get = column if callable(column) else (lambda s: s(column))
    return Constraint("caliper_mismatch", lambda a, c: F.coalesce(F.abs(finite(get(a)) - finite(get(c))) <= window, F.lit(False)))


def date_window(column: str | Callable[[Side], Column], days: int) -> Constraint:
    """Both dates are there and differ by at most days."""
    get = column if callable(column) else (lambda s: s(column))
    return Constraint("date_window_mismatch", lambda a, c: F.coalesce(F.abs(F.datediff(get(a), get(c))) <= days, F.lit(False)))


def must_be_alive(event: str | Callable[[Side], Column] = "__event", death: str | Callable[[Side], Column] = "__death") -> Constraint:
    """The candidate has not died by the anchor's event date; anchors without one pass."""
    get = event if callable(event) else (lambda s: s(event))
    died = death if callable(death) else (lambda s: s(death))
    return Constraint("control_not_alive_at_index_date", lambda a, c: get(a).isNull() | died(c).isNull() | (died(c) > get(a)), died if event == "__event" else None)


def must_be_resident(check: Callable[[Side, Column], Column], event: str | Callable[[Side], Column] = "__event", until: Callable[[Side], Column] | None = None) -> Constraint:
    """check(candidate side, the anchor's event date) holds; anchors without one pass. until: if that is all check looks at."""
    get = event if callable(event) else (lambda s: s(event))
    return Constraint("control_non_resident_at_index_date", lambda a, c: get(a).isNull() | check(c, get(a)), until if event == "__event" else None)


@dataclass(frozen=True)
class RiskSetPolicy:
    """Who becomes a case, and who is at risk when a case is served."""

    is_case_eligible: Callable[[Side, int], Column]
    is_at_risk: Callable[[Side, Side], Column]


def before_age_limit(row: Side, years: int) -> Column:
    """An event, before the birthday at which the limit is reached (month ends are clamped)."""
    return F.coalesce(row("__event") < F.add_months(row("__birth"), 12 * years), F.lit(False))


def at_risk(a: Side, c: Side) -> Column:
    """No event of its own yet at the case's event."""
    return c("__event").isNull() | (c("__event") > a("__event"))


DEFAULT_RISK_SET = RiskSetPolicy(before_age_limit, at_risk)
