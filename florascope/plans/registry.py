"""All queries of the core and their SQL."""

from __future__ import annotations

from . import community, files, landscape, multivariate, tables

QUERIES: dict = {**tables.QUERIES, **community.QUERIES, **landscape.QUERIES, **multivariate.QUERIES, **files.QUERIES}
SQL: dict = {**tables.SQL, **community.SQL, **landscape.SQL, **files.SQL}
