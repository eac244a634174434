"""The list of queries: name -> (Spark plan, SQL oracle or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under ``name``, with its oracle SQL when one exists."""

    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} registered twice")
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return add


def with_sql(*ctes: str, select: str) -> str:
    """``WITH`` + comma-joined CTE lists + select."""
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n" + select.strip()
