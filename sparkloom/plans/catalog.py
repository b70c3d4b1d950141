"""All registered queries by name, and the SQL that each must equal."""

from __future__ import annotations

from . import image_queries, kernel_queries, series_queries, spatial_queries, store_queries, structure_queries, table_queries

_MODULES = (series_queries, table_queries, spatial_queries, kernel_queries, structure_queries, image_queries, store_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
