"""All registered queries of the library's own operators."""

from __future__ import annotations

from duelframe.plans import ablation, claims, corpus, evaluation, evidence, intake, items, loadouts, more, published, questions, reports, retrieval, scopes, text  # noqa: F401
from duelframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
