"""All queries of the league library by name, with their SQL."""

from __future__ import annotations

from terrace.plans import league, pages, places, rasters, seasons, streams, tables

QUERIES = {**league.QUERIES, **tables.QUERIES, **seasons.QUERIES, **pages.QUERIES, **streams.QUERIES, **rasters.QUERIES, **places.QUERIES}
ORACLES = {**league.ORACLES, **tables.ORACLES, **seasons.ORACLES, **pages.ORACLES, **streams.ORACLES, **rasters.ORACLES, **places.ORACLES}
