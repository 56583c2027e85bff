"""All queries of the engine's own operators, by name, with their DuckDB equivalents."""

from gaugeworks.plans import analytics, checks, latex, models, papers, ranking, runs, streamed, texts

QUERIES = {}
SQL = {}
for part in (ranking, analytics, texts, latex, papers, runs, streamed, checks, models):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
