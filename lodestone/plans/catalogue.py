"""Every core query with its SQL."""

from lodestone.plans import graph_queries, history_queries, hotkeys, scalar_queries, scoring_queries, source_queries, text_queries

MODULES = [hotkeys, graph_queries, scoring_queries, scalar_queries, history_queries, text_queries, source_queries]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
