"""Registered queries: each operator run on tables derived from the parquet inputs, next to the
DuckDB SQL that must give the same rows."""

from parapet.catalog import ambiguity, checks, corpus, geometry, repair, report, sheets, sources, stream, text  # noqa: F401
from parapet.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
