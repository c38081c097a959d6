"""Registered queries and their oracle SQL."""

from __future__ import annotations

import importlib

MODULES = ("evaluation", "projections", "sources", "datasets", "spatial", "tracking", "augmentation", "live", "sinks", "reports")


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"boxwright.plans.{name}")
