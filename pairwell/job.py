"""MatchJob: an immutable builder over the matching operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame

from pairwell.functions.distance import DistanceConfig
from pairwell.operators.balance import BalanceOptions, BalanceReport, balance_report
from pairwell.operators.constraints import DEFAULT_RISK_SET, Constraint, RiskSetPolicy, Side, gender_match, must_be_alive, must_be_resident
from pairwell.operators.matching import Outcome, Strategy, match_standard, random_order
from pairwell.operators.transition import match_transition
from pairwell.plans.spec import AgeLimitYears, BirthWindowDays, Estimand, MatchingCriteria, MatchRatio, TransitionOptions
from pairwell.sources.cohort import CohortSchema


def _typed(value: object, kind: type) -> object:
    if not isinstance(value, kind):
        raise TypeError(f"{kind.__name__} expected, not {type(value).__name__}")
    return value


@dataclass(frozen=True)
class MatchJob:
    """What to match and how; each with_ method gives a new job.

    Build with standard or transition. Values that have a range are typed: MatchRatio, BirthWindowDays,
    AgeLimitYears. Candidates are drawn at random by the seed unless a strategy is given.
    """

    schema: CohortSchema
    strategy: Strategy
    anchors: DataFrame | None = None
    candidates: DataFrame | None = None
    members: DataFrame | None = None
    criteria: MatchingCriteria = MatchingCriteria()
    options: TransitionOptions = TransitionOptions()
    fallback: tuple[MatchRatio, ...] = ()
    config: DistanceConfig | None = None
    constraints: tuple[Constraint, ...] = ()
    risk_set: RiskSetPolicy = DEFAULT_RISK_SET

    @classmethod
    def standard(cls, anchors: DataFrame, candidates: DataFrame, schema: CohortSchema, seed: int) -> MatchJob:
        return cls(schema, random_order(seed), anchors, candidates)

    @classmethod
    def transition(cls, members: DataFrame, schema: CohortSchema, seed: int) -> MatchJob:
        return cls(schema, random_order(seed), members=members)

    def _criteria(self, **changes: object) -> MatchJob:
        return replace(self, criteria=self.criteria.with_(**changes))

    def with_ratio(self, ratio: MatchRatio) -> MatchJob:
        return self._criteria(ratio=_typed(ratio, MatchRatio).value)

    def with_birth_window(self, days: BirthWindowDays) -> MatchJob:
        return self._criteria(birth_window_days=_typed(days, BirthWindowDays).value)

    def with_exact_match(self, key: str) -> MatchJob:
        return self.with_exact_matches([key])

    def with_exact_matches(self, keys: Iterable[str]) -> MatchJob:
        return self._criteria(required_strata=(*self.criteria.required_strata, *keys))

    def with_replacement(self, allow: bool = True) -> MatchJob:
        return self._criteria(allow_replacement=allow)

    def with_unique_by_key(self, key: str | None) -> MatchJob:
        return self._criteria(unique_by_key=key)

    def with_estimand(self, estimand: Estimand) -> MatchJob:
        return self._criteria(estimand=_typed(estimand, Estimand))

    def with_strategy(self, strategy: Strategy) -> MatchJob:
        return replace(self, strategy=strategy)

    def with_constraint(self, constraint: Constraint) -> MatchJob:
        return replace(self, constraints=(*self.constraints, _typed(constraint, Constraint)))

    def with_gender_match(self, column: str = "sex") -> MatchJob:
        return self.with_constraint(gender_match(column))

    def with_alive_check(self) -> MatchJob:
        """Candidates have not died by the anchor's event date."""
        return self.with_constraint(must_be_alive())

    def with_alive_check_by(self, death: Callable[[Side], Column]) -> MatchJob:
        return self.with_constraint(must_be_alive(death=death))

    def with_resident_check(self, until: str = "resident_until") -> MatchJob:
        """Candidates are resident at the anchor's event date, by the column of their last day (null: still)."""
        return self.with_constraint(must_be_resident(lambda c, day: c(until).isNull() | (c(until) > day), until=lambda c: c(until)))

    def with_resident_check_by(self, check: Callable[[Side, Column], Column]) -> MatchJob:
        return self.with_constraint(must_be_resident(check))

    def with_ratio_fallback(self, ratios: Sequence[MatchRatio]) -> MatchJob:
        return replace(self, fallback=tuple(_typed(r, MatchRatio) for r in ratios))

    def with_distance_config(self, config: DistanceConfig) -> MatchJob:
        return replace(self, config=_typed(config, DistanceConfig))

    def with_age_limit(self, years: AgeLimitYears) -> MatchJob:
        self._only_transition()
        return replace(self, options=replace(self.options, age_limit=_typed(years, AgeLimitYears)))

    def with_risk_set_policy(self, policy: RiskSetPolicy) -> MatchJob:
        self._only_transition()
        return replace(self, risk_set=policy)

    def _only_transition(self) -> None:
        if self.members is None:
            raise TypeError("only transition jobs have cases of their own")

    def run(self) -> Outcome:
        if self.members is not None:
            options = replace(self.options, ratio_fallback=self.fallback)
            return match_transition(self.members, self.schema, self.criteria, options, self.strategy, self.config, self.constraints, self.risk_set)
        return match_standard(self.anchors, self.candidates, self.schema, self.criteria, self.strategy, self.fallback, self.config, self.constraints)

    def run_with_balance(self, cases: DataFrame, controls: DataFrame, options: BalanceOptions = BalanceOptions(), column: str = "covariates") -> tuple[Outcome, BalanceReport]:
        """Run, and report the balance of cases and controls (with a covariates column) before and after."""
        outcome = self.run()
        return outcome, balance_report(cases, controls, outcome.pairs, options, self.schema.id, column, self.schema.order)
