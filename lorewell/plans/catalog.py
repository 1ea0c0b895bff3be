"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from lorewell.plans import answer_queries, graph_queries, library_queries, linking_queries, record_queries, search_queries, text_queries
from lorewell.plans.registry import Query

AREAS = (search_queries.R, text_queries.R, graph_queries.R, record_queries.R, library_queries.R, answer_queries.R, linking_queries.R)


def queries() -> dict[str, Query]:
    return {k: f for r in AREAS for k, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in AREAS for k, s in r.sql.items()}
