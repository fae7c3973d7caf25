"""Imports every family so that its queries register."""

from counterlift.catalog import (  # noqa: F401
    campaign_queries,
    exposure_queries,
    matching_queries,
    model_queries,
    relational_queries,
    search_queries,
    store_queries,
)
from counterlift.catalog.registry import ORACLES, QUERIES  # noqa: F401
