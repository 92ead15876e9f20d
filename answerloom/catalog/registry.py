"""All registered queries: name to (query, SQL or None)."""

from answerloom.catalog import (
    metric_queries, plan_queries, reshape_queries, scoring_queries, source_queries, split_queries,
    text_queries,
)

MODULES = (
    metric_queries, split_queries, text_queries, reshape_queries, scoring_queries, source_queries,
    plan_queries,
)


def registered() -> dict:
    out = {}
    for module in MODULES:
        for name, entry in module.QUERIES.items():
            assert name not in out, name
            out[name] = entry
    return out
