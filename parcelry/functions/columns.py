"""Column expressions. All are built-in Spark functions, so they stay in codegen."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tag word, the multihash prefixes and the two view suffixes.
LATEST = "latest"
MULTIHASH_PREFIXES = {"SHA256": "1220", "sha2-256-chunked": "b150"}
MULTIHASH_OTHER = "0000"
VIEW_SUFFIX = {"packages": "_packages-view", "objects": "_objects-view"}
UNKNOWN_REGISTRY = "unknown"

# Marks that give a log line its class, the first match wins.
SEVERITY_MARKS = (
    ("error", ("ERROR", "❌")),
    ("warn", ("WARN", "⚠️")),
    ("success", ("✅", "SUCCESS")),
)


def multihash(hash_struct: Column) -> Column:
    """Prefix for the hash type followed by the digest; NULL when there is no digest."""
    prefix = F.lit(MULTIHASH_OTHER)
    for hash_type, code in MULTIHASH_PREFIXES.items():
        prefix = F.when(hash_struct["type"] == hash_type, F.lit(code)).otherwise(prefix)
    return F.concat(prefix, hash_struct["value"])


def zoneless(moment: datetime) -> Column:
    """A moment as a zone-less timestamp, in UTC if it has a zone.

    As text, since a ``datetime`` literal depends on the zones of process and session.
    """
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def epoch_seconds(text: Column, on_bad: str = "fail") -> Column:
    """Epoch seconds held as text; ``on_bad="quarantine"`` turns other text into NULL."""
    if on_bad == "fail":
        return text.cast("bigint")
    if on_bad == "quarantine":
        return text.try_cast("bigint")
    raise ValueError(f"on_bad must be 'fail' or 'quarantine', not {on_bad!r}")


def epoch_to_timestamp(text: Column, on_bad: str = "fail") -> Column:
    """Epoch seconds as text to a zone-less timestamp, whatever the session time zone."""
    start = zoneless(datetime(1970, 1, 1))
    return F.timestamp_add("SECOND", epoch_seconds(text, on_bad), start)


def registry_from_name(name: Column, kind: str) -> Column:
    """Registry part of a view name, which may be quoted and carry catalog and database."""
    found = F.regexp_extract(name, rf'^(?:.*"\.)?"?([^"]+?){VIEW_SUFFIX[kind]}"?$', 1)
    return F.when(found == "", F.lit(UNKNOWN_REGISTRY)).otherwise(found)


def strip_view_suffix(name: Column) -> Column:
    """Name without its view suffix; other names come back unchanged."""
    return F.regexp_replace(name, "_(objects|packages)-view$", "")


def log_severity(message: Column) -> Column:
    """Class of a log line by the marks it contains: error, warn, success or plain."""
    severity = F.lit("plain")
    for name, marks in reversed(SEVERITY_MARKS):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | message.contains(mark)
        severity = F.when(hit, F.lit(name)).otherwise(severity)
    return severity
