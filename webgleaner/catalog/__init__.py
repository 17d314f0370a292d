"""Registered queries over the given tables and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("urls", "hosts", "content", "links", "sites", "answers", "reports", "jobs", "streams")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        part = getattr(import_module(f"{__name__}.{module}"), name)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLES")
