"""Imports every query module so that its queries register, then exposes them."""

from __future__ import annotations

from studybank.plans import registry

_MODULES = [
    "studybank.plans.q_retrieval",
    "studybank.plans.q_evaluation",
    "studybank.plans.q_labels",
    "studybank.plans.q_text",
    "studybank.plans.q_contrastive",
    "studybank.plans.q_io",
    "studybank.plans.q_encode",
    "studybank.plans.q_streaming",
    "studybank.plans.q_plugins",
    "studybank.plans.q_jobs",
    "studybank.plans.q_sections_sql",   # attaches oracles to section queries above
]


def _load():
    import importlib
    for m in _MODULES:
        importlib.import_module(m)


def queries():
    _load()
    return registry.QUERIES


def oracles():
    _load()
    return registry.ORACLES
