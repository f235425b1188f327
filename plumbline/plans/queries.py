"""All queries of the geospatial operators and their SQL."""

from __future__ import annotations

from plumbline.plans import queries_optimise, queries_outline, queries_points, queries_quality

QUERIES = {**queries_outline.QUERIES, **queries_points.QUERIES, **queries_quality.QUERIES, **queries_optimise.QUERIES}
ORACLE_SQL = {**queries_outline.ORACLE_SQL, **queries_points.ORACLE_SQL, **queries_quality.ORACLE_SQL, **queries_optimise.ORACLE_SQL}
