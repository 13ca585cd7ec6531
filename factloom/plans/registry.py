"""Registry of queries: each has a Spark plan and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, casts: dict[str, str] | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under a name; ``sql`` is SQL with the same columns and rows.

    ``casts`` gives columns of it the plan's types, where the other engine computes in wider ones.
    """
    if sql is not None and casts:
        sql = f"select * replace ({', '.join(f'cast({c} as {t}) as {c}' for c, t in casts.items())}) from ({sql}) uncast"

    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name!r} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return add
