"""Reports as CSV text: small tables, rendered on the driver. Fields are not quoted; numbers round half to even."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from decimal import ROUND_HALF_EVEN, Decimal
from pathlib import Path
from typing import TYPE_CHECKING, Protocol

if TYPE_CHECKING:
    from pairwell.operators.balance import BalanceReport
    from pairwell.operators.matching import Outcome

#: The columns of the numeric report after the covariate's name.
NUMERIC_COLUMNS = (
    "mean_case_pre", "mean_control_pre", "smd_pre", "var_ratio_pre", "ecdf_mean_diff_pre", "ecdf_max_diff_pre", "eqq_mean_diff_pre", "eqq_max_diff_pre",
    "mean_case_post", "mean_control_post", "smd_post", "var_ratio_post", "ecdf_mean_diff_post", "ecdf_max_diff_post", "eqq_mean_diff_post", "eqq_max_diff_post",
)
#: The columns of the categorical report after covariate and level.
CATEGORICAL_COLUMNS = ("p_case_pre", "p_control_pre", "smd_pre", "p_case_post", "p_control_post", "smd_post", "cramers_v_pre", "cramers_v_post")
#: The rows of the summary, and the diagnostics they show.
SUMMARY_ROWS = (
    "total_anchors_evaluated", "matched_anchors", "unmatched_anchors", "pairs_selected", "anchors_with_no_candidates",
    "anchors_below_required_ratio", "used_controls", "avg_controls_per_case", "requested_estimand", "realized_estimand",
)


@dataclass(frozen=True)
class ReportConfig:
    decimal_places: int = 4
    delimiter: str = ","
    field_precision: Mapping[str, int] = field(default_factory=dict)

    def precision_for(self, name: str) -> int:
        return self.field_precision.get(name, self.decimal_places)

    def line(self, *cells: object) -> str:
        return self.delimiter.join(map(str, cells)) + "\n"

    def number(self, x: float, places: int) -> str:
        return str(Decimal(x).quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN)) if x == x and abs(x) != float("inf") else str(x)


class ReportSink(Protocol):
    """Whatever can be rendered."""

    def render(self, config: ReportConfig = ReportConfig()) -> str: ...


def write_report(sink: ReportSink, path: str | Path, config: ReportConfig = ReportConfig()) -> None:
    """One file on the driver, as reports are read by people."""
    Path(path).write_text(sink.render(config))


@dataclass(frozen=True)
class NumericBalanceReport:
    report: BalanceReport

    def render(self, config: ReportConfig = ReportConfig()) -> str:
        out = config.line("covariate", *NUMERIC_COLUMNS)
        rows = self.report.wide().collect() if self.report.numeric is not None else []  # a row per covariate
        for r in rows:
            p = config.precision_for(r.covariate)
            out += config.line(r.covariate, *[config.number(x, p) for x in r[1:]])
        return out


@dataclass(frozen=True)
class CategoricalBalanceReport:
    report: BalanceReport

    def render(self, config: ReportConfig = ReportConfig()) -> str:
        out = config.line("covariate", "level", *CATEGORICAL_COLUMNS)
        rows = self.report.categorical.toLocalIterator() if self.report.categorical is not None else []
        for r in rows:
            p = config.precision_for(r.covariate)
            out += config.line(r.covariate, r.level, *[config.number(r[c], p) for c in CATEGORICAL_COLUMNS])
        return out


@dataclass(frozen=True)
class MatchSummaryReport:
    outcome: Outcome

    def render(self, config: ReportConfig = ReportConfig()) -> str:
        d = self.outcome.diagnostics
        shown = {"avg_controls_per_case": config.number(d.avg_controls_per_case, config.decimal_places), "requested_estimand": d.requested_estimand.value, "realized_estimand": d.realized_estimand.value}
        return config.line("metric", "value") + "".join(config.line(k, shown.get(k, getattr(d, k))) for k in SUMMARY_ROWS)


@dataclass(frozen=True)
class ExclusionCountsReport:
    outcome: Outcome

    def render(self, config: ReportConfig = ReportConfig()) -> str:
        rows = [(r.reason, r.n) for r in self.outcome.exclusions().orderBy("place").collect()]  # a row per reason
        return config.line("reason", "count") + "".join(config.line(*r) for r in rows or [("none", 0)])


def write_numeric_csv(report: BalanceReport, path: str | Path) -> None:
    write_report(NumericBalanceReport(report), path)


def write_categorical_csv(report: BalanceReport, path: str | Path) -> None:
    write_report(CategoricalBalanceReport(report), path)


def write_summary_csv(outcome: Outcome, path: str | Path) -> None:
    write_report(MatchSummaryReport(outcome), path)


def write_exclusion_counts_csv(outcome: Outcome, path: str | Path) -> None:
    write_report(ExclusionCountsReport(outcome), path)
