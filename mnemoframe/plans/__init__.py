"""Operators bound to the test tables, with the SQL each result is checked against."""

import importlib

MODULES = ["behaviour", "catalog", "qc", "conversion", "ingest", "registry_queries", "compare", "series", "similarity", "features"]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
