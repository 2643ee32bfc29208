"""The queries of every operator here, and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from . import __path__ as _path


def _modules():
    return [importlib.import_module(f"{__package__}.{m.name}") for m in sorted(pkgutil.iter_modules(_path), key=lambda m: m.name) if m.name.startswith("op")]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLE.items()}
