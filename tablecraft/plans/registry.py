"""All named queries."""

from __future__ import annotations

import importlib

MODULES = ("cleaning", "insights", "features", "selection", "learning", "streams", "approximate", "regressions", "deviance", "forests")


def all_queries() -> dict:
    """name -> (function of session and folder, reference SQL or None)."""
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(f"tablecraft.plans.{m}").QUERIES
    return out
