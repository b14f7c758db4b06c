"""Queries over the benchmark tables, each with the SQL that checks it.

The tables hold no model files, so ``facts`` derives fact tables (artifacts, members,
callables, metadata, findings, …) from them by a fixed rule.  The rule is SQL that Spark and
the checking engine both read; everything after it is written twice, once with the
operators and once as SQL.
"""

from cargolens.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
