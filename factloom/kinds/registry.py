"""The kinds by name, open to more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

KINDS: dict[str, Callable[..., DataFrame]] = {}


def kind(name: str):
    """Register an evaluation: (mentions, params, **tables) to findings (object_id, param_code, status, ...)."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in KINDS:
            raise ValueError(f"kind {name!r} is registered twice")
        KINDS[name] = f
        return f

    return add


def evaluate(name: str, mentions: DataFrame, params: DataFrame, **tables: DataFrame) -> DataFrame:
    """Findings of one kind for the params that are of it; its other tables (profiles, norms, ...) by name."""
    from factloom.kinds import direction, generic, geometry, layers, numbers, presence, types  # noqa: F401

    if name not in KINDS:
        raise ValueError(f"unknown kind {name!r}: one of {sorted(KINDS)}")
    return KINDS[name](mentions, params.where(params.kind == name), **tables)
