"""Registry of the queries that the library answers, with the SQL that states the same where SQL can."""

from __future__ import annotations

from quern.plans import core_queries, text_queries, token_queries, vector_queries

_MODULES = (core_queries, text_queries, token_queries, vector_queries)


def flagship(spark, sf_dir):
    from quern.plans.text_queries import chunk_and_encode

    return chunk_and_encode(spark, sf_dir)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
