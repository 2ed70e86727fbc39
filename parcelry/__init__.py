"""Consolidates per-registry package and object views into three Spark tables."""

from parcelry.plans.run import consolidate
from parcelry.plans.tables import create_targets, drop_targets
from parcelry.operators.listing import tag_listing, tag_lookup
from parcelry.sources.views import (
    Sources,
    sources_from_catalog,
    sources_from_frames,
    sources_from_views,
)

__all__ = [
    "Sources",
    "consolidate",
    "create_targets",
    "drop_targets",
    "sources_from_catalog",
    "sources_from_frames",
    "sources_from_views",
    "tag_listing",
    "tag_lookup",
]
