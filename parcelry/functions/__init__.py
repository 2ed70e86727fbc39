from parcelry.functions.columns import (
    LATEST,
    epoch_to_timestamp,
    log_severity,
    multihash,
    registry_from_name,
    strip_view_suffix,
    zoneless,
)

__all__ = [
    "LATEST",
    "epoch_to_timestamp",
    "log_severity",
    "multihash",
    "registry_from_name",
    "strip_view_suffix",
    "zoneless",
]
