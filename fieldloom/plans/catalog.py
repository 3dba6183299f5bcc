"""All queries over constraint systems, and the SQL of those that SQL can express.

A query whose SQL is held to line items of small quantity has a twin, ``<name>_whole``, over the whole table. Closures are
too slow in SQL there (pairs of all constraints), so their twins have none; tests hold them against brute force.
"""

from __future__ import annotations

import inspect
from functools import partial

from ..sources import derived as D
from . import algebra_queries, graph_queries, merge_queries, more_queries, relational_queries, rewriting_queries

_ALL = (relational_queries, algebra_queries, graph_queries, rewriting_queries, merge_queries, more_queries)
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _ALL for k, s in m.ORACLES.items()}
CLOSURES = ("reach AS", "w AS (SELECT", "f AS (SELECT DISTINCT coni AS node")

for _name, _f in list(QUERIES.items()):
    if "most" in inspect.signature(_f).parameters:
        QUERIES[f"{_name}_whole"] = partial(_f, most=None)
        _sql = ORACLES.get(_name, "")
        if D.SPARSE_SQL in _sql and not any(c in _sql for c in CLOSURES):
            ORACLES[f"{_name}_whole"] = _sql.replace(D.SPARSE_SQL, D.TERMS_SQL)
