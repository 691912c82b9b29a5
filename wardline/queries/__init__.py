"""Queries over the driver's tables, one per operator, registered on import."""

import importlib

MODULES = ["detection", "ledgering", "scoring", "drifting", "console", "analytics"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
