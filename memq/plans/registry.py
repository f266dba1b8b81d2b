"""All queries of the core."""

from memq.plans import chains, evaluation, memory, roundtrip, scalars, search, training, travel

_MODULES = (training, scalars, memory, chains, search, evaluation, travel, roundtrip)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
