"""Named queries over the genomic views, with DuckDB SQL to hold them against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("interval_queries", "sequence_queries", "genome_queries", "format_queries", "more_queries", "store_queries", "statistic_queries")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"{__name__}.{m}").SQL.items()}
