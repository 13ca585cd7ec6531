"""Comparison kinds over a caller's own mentions and params: evaluate(kind, mentions, params, ...)."""

from factloom.kinds.registry import KINDS, evaluate, kind  # noqa: F401
