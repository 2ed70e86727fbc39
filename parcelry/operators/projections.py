"""Source rows, already tagged with their registry, in the shape of the targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.functions.columns import LATEST, epoch_seconds, epoch_to_timestamp, multihash


def is_revision(tag: str = LATEST) -> Column:
    """Whether a package row is a revision: its timestamp is there and not the tag word."""
    return F.col("timestamp") != tag


def is_tag(tag: str = LATEST) -> Column:
    return F.col("timestamp") == tag


def revision_rows(packages: DataFrame, tag: str = LATEST, on_bad: str = "fail") -> DataFrame:
    """Revisions: package rows whose timestamp is not the tag word.

    A NULL timestamp is neither a revision nor a tag. A timestamp that is no
    number fails the job, or is left out with ``on_bad="quarantine"``.
    """
    # Guarded as well, since the optimizer may evaluate the cast before the filter.
    seconds = F.when(is_revision(tag), F.col("timestamp"))
    rows = packages.where(is_revision(tag))
    if on_bad == "quarantine":
        rows = rows.where(epoch_seconds(seconds, on_bad).isNotNull())
    return rows.select(
        "registry",
        "pkg_name",
        "top_hash",
        epoch_to_timestamp(seconds, on_bad).alias("timestamp"),
        "message",
        F.col("user_meta").alias("metadata"),
    )


def tag_rows(packages: DataFrame, tag: str = LATEST) -> DataFrame:
    """Tags: package rows whose timestamp is the tag word."""
    return packages.where(is_tag(tag)).select(
        "registry", "pkg_name", F.col("timestamp").alias("tag_name"), "top_hash"
    )


def entry_rows(objects: DataFrame) -> DataFrame:
    """Entries: object rows with their hash struct as one multihash string."""
    return objects.select(
        "registry",
        "top_hash",
        "logical_key",
        "physical_key",
        multihash(F.col("hash")).alias("multihash"),
        "size",
        F.col("meta").alias("metadata"),
    )


def bad_timestamps(packages: DataFrame, tag: str = LATEST) -> DataFrame:
    """Per registry, how many package rows have no timestamp or one that is no number."""
    timestamp = F.col("timestamp")
    seconds = epoch_seconds(timestamp, "quarantine")
    return (
        packages.where(timestamp.isNull() | ((timestamp != tag) & seconds.isNull()))
        .groupBy("registry")
        .agg(
            F.count_if(timestamp.isNull()).alias("null_timestamps"),
            F.count_if(timestamp.isNotNull()).alias("non_numeric_timestamps"),
        )
    )
