"""All core queries. Importing this module registers them."""

from __future__ import annotations

from reelgrid.plans import clusters, graphs, joins, neighbours, products, roundtrips, scalars, summaries, timeline  # noqa: F401
from reelgrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
