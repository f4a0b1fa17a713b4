"""All queries of the library, by name, and the SQL that each is held against."""

from __future__ import annotations

from sigloom.plans import alias_queries, base, desk_queries, lists, matching, merge_queries, reads, rules, scalar_queries, screen_queries, state_queries, stream_queries, texts, upkeep_queries, vector_queries

MODULES = (alias_queries, desk_queries, lists, matching, merge_queries, reads, rules, scalar_queries, screen_queries, state_queries, stream_queries, texts, upkeep_queries, vector_queries)
QUERIES, SQL = base.QUERIES, base.SQL
