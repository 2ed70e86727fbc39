"""Which files does a tag of a package contain, smallest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.functions.columns import LATEST
from parcelry.operators.merge import hash_join

LISTING_COLUMNS = ("size", "logical_key", "physical_key", "registry", "multihash")


def _smallest_first(listing: DataFrame) -> DataFrame:
    """By size, without one last. Ties are ordered too: very many files may have
    the same size, and a sort on it alone would bring them into one task."""
    ties = [name for name in LISTING_COLUMNS if name != "size"]
    return listing.orderBy(F.asc_nulls_last("size"), *ties)


def tag_listing(
    entries: DataFrame,
    tags: DataFrame,
    registry: str | None = None,
    pkg_name: str | None = None,
    tag: str = LATEST,
) -> DataFrame:
    """Entries of the tagged revisions, for one package or for all of them.

    Both sides carry ``registry``, so a filter on it prunes the partitions of
    both. Spark broadcasts the tags if they are small by its own size check, and
    otherwise splits a revision with very many entries, also if the tags are an
    aggregate over the join columns.
    """
    wanted = tags.where(F.col("tag_name") == tag)
    if registry is not None:
        wanted = wanted.where(F.col("registry") == registry)
    if pkg_name is not None:
        wanted = wanted.where(F.col("pkg_name") == pkg_name)
    listing = hash_join(
        entries.select(*LISTING_COLUMNS, "top_hash"),
        wanted.select("registry", "top_hash"),
        ["registry", "top_hash"],
        "inner",
    )
    return _smallest_first(listing.select(*LISTING_COLUMNS))


def tag_lookup(
    entries: DataFrame,
    tags: DataFrame,
    registry: str,
    pkg_name: str,
    tag: str = LATEST,
    resolve: bool = False,
) -> DataFrame:
    """``tag_listing`` of one package without a join, for tables with one row per tag.

    The hash is a scalar subquery: Spark finds it first and pushes the value
    into the Parquet scan, where row groups of files sorted by hash are skipped.
    With ``resolve`` it is looked up at once and becomes a constant, by which
    Spark can also skip the buckets of a table bucketed by hash. Several rows
    for the tag fail the query instead of giving a partial answer.
    """
    found = tags.where(
        (F.col("registry") == registry)
        & (F.col("tag_name") == tag)
        & (F.col("pkg_name") == pkg_name)
    ).select("top_hash")
    if resolve:
        # Two rows suffice to see that there is more than one.
        hashes = [row["top_hash"] for row in found.take(2)]
        if len(hashes) > 1:
            raise ValueError(f"{registry}: {pkg_name} has several rows for {tag}")
        top_hash = F.lit(hashes[0] if hashes else None).cast("string")
    else:
        top_hash = found.scalar()
    listing = entries.where((F.col("registry") == registry) & (F.col("top_hash") == top_hash))
    return _smallest_first(listing.select(*LISTING_COLUMNS))
