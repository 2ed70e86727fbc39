from parcelry.streaming.events import (
    EVENT_SCHEMA,
    expired,
    matching_events,
    read_events,
    registries_to_refresh,
    retained,
    routed_events,
    unpack_bus_entries,
)
from parcelry.streaming.job import merge_on_events

__all__ = [
    "EVENT_SCHEMA",
    "expired",
    "matching_events",
    "merge_on_events",
    "read_events",
    "registries_to_refresh",
    "retained",
    "routed_events",
    "unpack_bus_entries",
]
