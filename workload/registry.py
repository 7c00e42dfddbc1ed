"""All registered queries and SQL counterparts."""

from __future__ import annotations

from importlib import import_module

MODULES = ["runs_and_history", "texts", "tags", "answers", "matching", "bank", "events", "jobs"]


def _parts(name: str) -> dict:
    merged: dict = {}
    for module in MODULES:
        try:
            part = import_module(f"workload.{module}")
        except ModuleNotFoundError:
            continue
        merged.update(getattr(part, name))
    return merged


def queries() -> dict:
    return _parts("QUERIES")


def oracles() -> dict:
    return _parts("ORACLES")
