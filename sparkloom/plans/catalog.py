"""Imports every plan module so that its queries are registered."""

from __future__ import annotations

import importlib
import pkgutil

import sparkloom.plans as plans
from sparkloom.plans.registry import REGISTRY, Query


def load() -> dict[str, Query]:
    for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        if module not in {"catalog", "registry"}:
            importlib.import_module(f"sparkloom.plans.{module}")
    return dict(REGISTRY)
