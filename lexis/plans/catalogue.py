"""All queries of the library, by name."""

from __future__ import annotations

from lexis.plans import align_queries, corpus_queries, dictionary_queries, etl_queries, lookup_queries, page_queries, source_queries, text_queries  # noqa: F401  they register themselves
from lexis.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
