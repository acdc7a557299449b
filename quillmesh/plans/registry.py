"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import evaluation, graphs, more, retrieval, texts

FLAGSHIP = "bm25_batch"
PARTS = (texts, retrieval, graphs, evaluation, more)


def queries() -> dict[str, Callable]:
    return {k: f for part in PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in PARTS for k, s in part.SQL.items()}
