"""Named queries of the library and the SQL that must give the same rows."""

from tidemark.plans import data_queries, dialogue_queries, search_queries, source_queries, state_queries, temporal_queries, text_queries

_PARTS = (text_queries.R, data_queries.R, search_queries.R, state_queries.R, dialogue_queries.R, source_queries.R, temporal_queries.R)

QUERIES = {name: query for part in _PARTS for name, query in part.queries.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.sql.items()}
