"""All registered queries and their SQL twins."""

from __future__ import annotations

from rubrica.plans import (
    file_queries,
    group_queries,
    judge_queries,
    prep_queries,
    reward_queries,
    run_queries,
    stat_queries,
    stream_queries,
)

_MODULES = [reward_queries, group_queries, prep_queries, judge_queries, run_queries, stat_queries, stream_queries, file_queries]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
