"""Queries over the test tables, one per operator, with their DuckDB counterparts where SQL can express them."""

from . import aggregates, answers, claims, contracts, derivations, filters, graphs, kernels, more, ordering, reviews, scalars, sourcing, stateful, structure, texts
from .registry import ORACLES, QUERIES

MODULES = (filters, graphs, aggregates, ordering, texts, scalars, kernels, contracts, sourcing, stateful, more, claims, structure, reviews, derivations, answers)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
