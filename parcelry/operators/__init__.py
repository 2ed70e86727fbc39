from parcelry.operators.listing import tag_listing, tag_lookup
from parcelry.operators.merge import (
    changed_tags,
    choose_tags,
    new_rows,
    tags_to_append,
    upsert_tags,
)
from parcelry.operators.projections import (
    bad_timestamps,
    entry_rows,
    revision_rows,
    tag_rows,
)

__all__ = [
    "bad_timestamps",
    "changed_tags",
    "choose_tags",
    "entry_rows",
    "new_rows",
    "revision_rows",
    "tag_listing",
    "tag_lookup",
    "tag_rows",
    "tags_to_append",
    "upsert_tags",
]
