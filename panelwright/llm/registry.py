"""Queries of the text operators."""
from __future__ import annotations

from importlib import import_module

MODULES = ("toxicity", "sharding", "html", "language_model", "jaccard", "quality", "substrings", "mixing", "secrets", "decontaminate", "simhash", "divergence", "importance")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__package__}.{m}"), name)
    return out


def queries() -> dict:
    """All opN_ queries; that of corpus_pipeline.py is added by the entry module at the repository top."""
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
