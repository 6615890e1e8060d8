"""All registered queries by name."""

from __future__ import annotations

from driver_queries import (
    article_queries,
    io_queries,
    portfolio_queries,
    price_queries,
    research_queries,
    sentiment_queries,
    stream_queries,
    validation_queries,
)

QUERIES: dict = {}
for _module in (
    price_queries,
    article_queries,
    sentiment_queries,
    validation_queries,
    portfolio_queries,
    research_queries,
    io_queries,
    stream_queries,
):
    for _name, _entry in _module.Q.items():
        if _name in QUERIES:
            raise ValueError(f"query {_name!r} registered twice")
        QUERIES[_name] = _entry
