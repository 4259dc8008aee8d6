"""All queries outside the subpackage for training data, and their SQL."""

from millrace.operators import calendar, catalogues, claims, dictionary, funnels, language, lifecycle, matching, reading, relational, schemas, scoring, signals, strategy, texts
from millrace.sources import tables
from millrace.streaming import desks, ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (funnels, relational, texts, scoring, lifecycle, catalogues, language, dictionary, signals, matching, reading, strategy, claims, calendar, schemas, tables, ingest, desks):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
