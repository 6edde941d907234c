"""Registered queries over the warehouse tables, each with the SQL that states its result."""

from kindred.plans.catalog import activity, blends, evaluation, features, ingest, lookups, neighbours  # noqa: F401
from kindred.plans.catalog.registry import ORACLES, QUERIES  # noqa: F401
