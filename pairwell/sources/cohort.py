"""Cohorts: any DataFrame, with its columns mapped to roles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CohortSchema:
    """Which columns play which role.

    strata: a name for each stratum key and its column, or one map column's name. order: the column that gives
    the order in which rows are served (the id if not given); rows have no order of their own here.
    """

    id: str = "id"
    birth_date: str = "birth_date"
    strata: Mapping[str, str] | Sequence[str] | str = field(default_factory=dict)
    unique_key: str | None = None
    death_date: str | None = None
    event_date: str | None = None
    order: str | None = None

    def stratum(self, key: str) -> Column:
        if isinstance(self.strata, str):
            return F.col(self.strata)[key].cast("string")
        names = self.strata if isinstance(self.strata, Mapping) else {k: k for k in self.strata}
        return F.col(names[key]).cast("string") if key in names else F.lit(None).cast("string")


def cohort(df: DataFrame, schema: CohortSchema, keys: Sequence[str] = (), unique_by_key: str | None = None) -> DataFrame:
    """df with the roles as columns of fixed names, next to its own columns.

    __id string, __birth date, __s0.. the required strata, __unique string (the stratum unique_by_key, else the
    unique key), __death date, __event date, __ord. Times are cut to dates.
    """

    def day(name: str | None) -> Column:
        return F.to_date(F.col(name)) if name else F.lit(None).cast("date")

    own = F.col(schema.unique_key).cast("string") if schema.unique_key else F.lit(None).cast("string")
    unique = F.coalesce(schema.stratum(unique_by_key), own) if unique_by_key else F.lit(None).cast("string")
    roles = {"__id": F.col(schema.id).cast("string"), "__birth": day(schema.birth_date), "__unique": unique, "__death": day(schema.death_date), "__event": day(schema.event_date), "__ord": F.col(schema.order or schema.id)}
    roles |= {f"__s{k}": schema.stratum(key) for k, key in enumerate(keys)}
    return df.withColumns(roles)


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)
