"""The queries of the operators, with the SQL that says the same."""

from . import layers, media, models, relational, sequence, tabular, text

MODULES = (tabular, text, models, sequence, media, layers, relational)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
