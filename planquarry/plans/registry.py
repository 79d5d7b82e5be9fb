"""All queries of this package but those of its llm part."""

from . import matching, records, shapes, stages, streams

_MODULES = (matching, records, stages, streams, shapes)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
