"""Registered queries and, where SQL can express them, the SQL they are checked with."""

from workload import features, models, sources, tables, text, topics, vision

MODULES = (vision, text, tables, features, topics, models, sources)

QUERIES: dict = {}
ORACLES: dict = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
