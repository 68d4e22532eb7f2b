"""Every registered query of the library outside the corpus subpackage, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules that each have QUERIES (name -> function of a session and a folder) and ORACLE (name -> SQL).
MODULES: tuple[str, ...] = ("millrace.plans.vector_queries", "millrace.plans.text_queries", "millrace.plans.table_queries", "millrace.plans.service_queries", "millrace.plans.listing_queries", "millrace.plans.split_queries")


def queries() -> dict[str, Callable]:
    return {name: query for m in MODULES for name, query in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(m).ORACLE.items()}
