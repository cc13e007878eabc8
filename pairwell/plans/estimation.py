"""Options and errors of estimation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from enum import Enum

from pairwell.plans.spec import DistanceCaliper


class EstimationError(ValueError):
    """Preprocessing or fitting failed; kind says how."""

    def __init__(self, kind: str, covariate: str | None = None, record: str | None = None) -> None:
        super().__init__(": ".join(x for x in (kind, covariate, record) if x))
        self.kind, self.covariate, self.record = kind, covariate, record


#: The kinds of estimation errors.
EMPTY_INPUT = "empty_input"
MISSING_VALUES = "missing_values_not_allowed"
NON_FINITE = "non_finite_numeric_covariate"
MIXED_TYPE = "mixed_covariate_type"
NO_VALUES = "no_observed_values_for_covariate"
NO_COVARIATES = "no_covariates_available"
BAD_ELASTIC_NET = "invalid_elastic_net_config"
SOLVE_FAILED = "linear_system_solve_failed"
BAD_COVARIANCE = "invalid_covariance_matrix"
BAD_DISTANCE = "mahalanobis_config_build_failed"


class MissingPolicy(Enum):
    ERROR = "error"
    IMPUTE = "impute"


class Scale(Enum):
    PROBABILITY = "probability"
    LINEAR_PREDICTOR = "linear_predictor"


class CovarianceOf(Enum):
    WITHIN_GROUPS = "pooled_within_groups"
    ALL = "full_sample"


class Transformed(Enum):
    RAW = "raw"
    RANK = "rank"


@dataclass(frozen=True)
class Encoding:
    """keys: which covariates, in this order; all that are observed, sorted, if empty."""

    keys: tuple[str, ...] = ()
    intercept: bool = False
    drop_first_level: bool = True
    missing: MissingPolicy = MissingPolicy.ERROR


@dataclass(frozen=True)
class Logit:
    max_iter: int = 100
    tolerance: float = 1e-8
    l2: float = 1e-6
    clip: float = 1e-8
    name: str = "glm_logit"


@dataclass(frozen=True)
class ElasticNet:
    max_iter: int = 500
    tolerance: float = 1e-7
    strength: float = 1e-2
    mix: float = 0.5
    step_scale: float = 1.0
    clip: float = 1e-8
    name: str = "elastic_net_logit"

    def check(self) -> None:
        values = (self.mix, self.strength, self.tolerance, self.step_scale, self.clip)
        if not all(math.isfinite(x) for x in values) or self.max_iter < 1 or self.tolerance <= 0 or self.step_scale <= 0 or not 0 < self.clip < 0.5:
            raise EstimationError(BAD_ELASTIC_NET)


@dataclass(frozen=True)
class PropensityConfig:
    encoding: Encoding = field(default_factory=lambda: Encoding(intercept=True))
    estimator: Logit | ElasticNet = field(default_factory=Logit)
    scale: Scale = Scale.PROBABILITY
    caliper: DistanceCaliper | None = None


@dataclass(frozen=True)
class MahalanobisConfig:
    encoding: Encoding = field(default_factory=Encoding)
    covariance: CovarianceOf = CovarianceOf.WITHIN_GROUPS
    transform: Transformed = Transformed.RAW
    ridge: float = 1e-8
    attempts: int = 8
