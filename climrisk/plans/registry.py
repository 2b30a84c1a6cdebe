"""Names, Spark plans and SQL twins of all registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise KeyError(f"query {name!r} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            TWINS[name] = sql
        return plan

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounds computed doubles so that two engines print the same value."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def load() -> None:
    from climrisk.plans import (  # noqa: F401
        hazard_queries,
        model_queries,
        series_queries,
        source_queries,
        spatial_queries,
        table_queries,
    )
