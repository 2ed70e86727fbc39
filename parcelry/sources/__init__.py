from parcelry.sources.discovery import (
    list_sources,
    pair_views,
    select_registries,
    skipped_views,
)
from parcelry.sources.views import (
    Sources,
    scan_objects,
    scan_packages,
    sources_from_catalog,
    sources_from_frames,
    sources_from_views,
    union_registries,
)

__all__ = [
    "Sources",
    "list_sources",
    "pair_views",
    "scan_objects",
    "scan_packages",
    "select_registries",
    "skipped_views",
    "sources_from_catalog",
    "sources_from_frames",
    "sources_from_views",
    "union_registries",
]
