"""All registered queries; importing the plan modules fills the registry."""

from __future__ import annotations

from factloom.plans import compare, documents, geometry, ingest, kinds, ladders, layers, match, predicates, reading, registry, rollup, rules, series, space, stats, streams, text, totals  # noqa: F401


def plans() -> dict[str, registry.Plan]:
    return dict(registry.PLANS)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)
