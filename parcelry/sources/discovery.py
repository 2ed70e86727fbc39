"""Which registries exist, and which of the two views each of them has.

Every function takes a frame with one column ``name`` and returns a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.functions.columns import VIEW_SUFFIX
from parcelry.session import quoted

_VIEW_NAME = f"^(.*?)({VIEW_SUFFIX['packages']}|{VIEW_SUFFIX['objects']})$"


def list_sources(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Names of all tables and views of a database, temporary views included."""
    where = f" IN {quoted(database)}" if database else ""
    return (
        spark.sql(f"SHOW TABLES{where}")
        .select(F.col("tableName").alias("name"), F.col("isTemporary").alias("temporary"))
        .where(F.col("name").isNotNull())
    )


def _views(names: DataFrame) -> DataFrame:
    name = F.col("name")
    return names.where((name != "") & name.endswith("-view")).select(
        "name",
        name.rlike(_VIEW_NAME).alias("matched"),
        F.regexp_extract(name, _VIEW_NAME, 1).alias("registry"),
        F.regexp_extract(name, _VIEW_NAME, 2).alias("suffix"),
    )


def _wanted(registry: str | None) -> Column:
    wanted = F.col("matched")
    if registry:
        wanted = wanted & (F.col("registry") == registry)
    return wanted


def select_registries(names: DataFrame, registry: str | None = None) -> DataFrame:
    """Distinct registries that have a known view; optionally only the one asked for."""
    return _views(names).where(_wanted(registry)).select("registry").distinct()


def skipped_views(names: DataFrame, registry: str | None = None) -> DataFrame:
    """Views left out: of an unknown kind, or of another registry than the one asked for."""
    return _views(names).where(~_wanted(registry)).select("name")


def pair_views(names: DataFrame, registry: str | None = None) -> DataFrame:
    """One row per registry with its packages view and its objects view, NULL if missing."""

    def view(kind: str) -> Column:
        return F.max(F.when(F.col("suffix") == VIEW_SUFFIX[kind], F.col("name")))

    return (
        _views(names)
        .where(_wanted(registry))
        .groupBy("registry")
        .agg(view("packages").alias("packages_view"), view("objects").alias("objects_view"))
    )
