"""Source views and pre-loaded targets derived from the test tables.

A registry is a region, a package a customer, a revision an order, an entry an
order line. ``latest`` is the customer's newest order. Every frame grows with
the tables. ``oracle.py`` holds the same definitions in SQL.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.functions import zoneless
from parcelry.operators.projections import entry_rows

# Revisions up to here are in the pre-loaded targets.
LOADED_UNTIL = datetime(1998, 1, 1)
EVENT_SOURCE = "org.example.packages"
EVENTS_ASOF = datetime(2024, 1, 15)
SILENT = "asia"
LOG_ASOF = datetime(2024, 1, 31)
LOG_MINUTES = 7 * 24 * 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _registry_name() -> Column:
    return F.lower(F.replace(F.col("r_name"), F.lit(" "), F.lit("-")))


def registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(_registry_name().alias("registry"))


def registry_kinds(spark: SparkSession, sf_dir: str) -> dict[str, tuple[str, ...]]:
    rows = registries(spark, sf_dir).collect()
    return {row["registry"]: ("packages", "objects") for row in rows}


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their registry."""
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _registry_name().alias("registry"),
            F.concat_ws("/", F.lower("c_mktsegment"), "c_name").alias("pkg_name"),
            "c_custkey",
            "c_mktsegment",
        )
    )


def _top_hash(order_key: str) -> Column:
    return F.sha2(F.concat(F.lit("rev-"), F.col(order_key).cast("string")), 256)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = zoneless(datetime(1970, 1, 1))
    return (
        table(spark, sf_dir, "orders")
        .join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "registry",
            "pkg_name",
            _top_hash("o_orderkey").alias("top_hash"),
            F.timestamp_diff("SECOND", start, F.col("o_orderdate"))
            .cast("string")
            .alias("timestamp"),
            F.col("o_orderpriority").alias("message"),
            F.concat(F.lit('{"status":"'), F.col("o_orderstatus"), F.lit('"}')).alias("user_meta"),
            "c_mktsegment",
            "o_orderkey",
            "o_orderdate",
        )
    )


VIEW_COLUMNS = ("registry", "pkg_name", "top_hash", "timestamp", "message", "user_meta")


def _pick(orders: DataFrame, choose) -> DataFrame:
    """Every package's newest (``F.max``) or oldest (``F.min``) order."""
    row = F.struct("o_orderdate", "o_orderkey", "top_hash", "message", "user_meta", "c_mktsegment")
    return (
        orders.groupBy("registry", "pkg_name")
        .agg(choose(row).alias("r"))
        .select("registry", "pkg_name", "r.*")
    )


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packages views of all registries."""
    orders = _orders(spark, sf_dir)
    newest = _pick(orders, F.max).withColumn("timestamp", F.lit("latest"))
    return orders.select(*VIEW_COLUMNS).unionByName(newest.select(*VIEW_COLUMNS))


def objects(spark: SparkSession, sf_dir: str, loaded: bool = False) -> DataFrame:
    """The objects views of all registries; with ``loaded`` of revisions up to ``LOADED_UNTIL``."""
    part = F.col("l_partkey").cast("string")
    hash_type = (
        F.when(F.col("l_returnflag") == "A", "SHA256")
        .when(F.col("l_returnflag") == "N", "sha2-256-chunked")
        .otherwise("MD5")
    )
    orders = table(spark, sf_dir, "orders")
    if loaded:
        old = orders.where(F.col("o_orderdate") < zoneless(LOADED_UNTIL)).select("o_orderkey")
        orders = orders.join(old, "o_orderkey", "left_semi")
    owners = (
        orders.join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "registry")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "registry",
            _top_hash("l_orderkey").alias("top_hash"),
            F.concat(
                F.lit("line/"), F.col("l_linenumber").cast("string"), F.lit("/part-"), part
            ).alias("logical_key"),
            F.concat(
                F.lit("s3://"),
                F.col("registry"),
                F.lit("/parts/"),
                part,
                F.lit("?versionId="),
                F.col("l_suppkey").cast("string"),
            ).alias("physical_key"),
            F.struct(hash_type.alias("type"), F.sha2(part, 256).alias("value")).alias("hash"),
            (F.col("l_quantity").cast("bigint") * 1024).alias("size"),
            F.when(
                F.col("l_linestatus") == "O",
                F.concat(F.lit('{"flag":"'), F.col("l_returnflag"), F.lit('"}')),
            ).alias("meta"),
        )
    )


def loaded_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision target of an earlier run, under another message."""
    old = _orders(spark, sf_dir).where(F.col("o_orderdate") < zoneless(LOADED_UNTIL))
    return old.select(
        "registry",
        "pkg_name",
        "top_hash",
        F.col("o_orderdate").alias("timestamp"),
        F.lit("imported").alias("message"),
        F.col("user_meta").alias("metadata"),
    )


def loaded_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry target of an earlier run, with the objects in another place."""
    moved = F.replace(F.col("physical_key"), F.lit("/parts/"), F.lit("/archive/"))
    entries = entry_rows(objects(spark, sf_dir, loaded=True))
    return entries.withColumn("physical_key", moved)


TAG_COLUMNS = ("registry", "pkg_name", "tag_name", "top_hash")


def loaded_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag target of an earlier run.

    Packages of segment BUILDING are not in it, those of MACHINERY are up to
    date, FURNITURE has a stale row besides the current one, others are behind.
    """
    orders = _orders(spark, sf_dir)
    segment = F.col("c_mktsegment")
    newest = _pick(orders, F.max).where(segment.isin("MACHINERY", "FURNITURE"))
    oldest = _pick(orders, F.min).where(~segment.isin("MACHINERY", "BUILDING"))
    return (
        newest.unionByName(oldest).withColumn("tag_name", F.lit("latest")).select(*TAG_COLUMNS)
    )


def rival_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second ``latest`` rows, of the oldest order, for packages of segment AUTOMOBILE."""
    oldest = _pick(_orders(spark, sf_dir), F.min)
    return (
        oldest.where(F.col("c_mktsegment") == "AUTOMOBILE")
        .withColumn("tag_name", F.lit("latest"))
        .select(*TAG_COLUMNS)
    )


def broken_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages view in which some timestamps are missing and some are no numbers."""
    timestamp = (
        F.when(F.col("message") == "5-LOW", F.lit(None))
        .when(F.col("message") == "2-HIGH", F.concat(F.lit("v"), F.col("timestamp")))
        .otherwise(F.col("timestamp"))
    )
    return packages(spark, sf_dir).withColumn("timestamp", timestamp)


def view_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table names of a database in which every customer is a registry.

    Customers in debt have no objects view; some segments add names that are no
    views of a known kind.
    """
    registry = F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-")))
    segment = F.col("c_mktsegment")
    names = F.array(
        F.concat(registry, F.lit("_packages-view")),
        F.when(F.col("c_acctbal") >= 0, F.concat(registry, F.lit("_objects-view"))),
        F.when(segment == "FURNITURE", F.concat(registry, F.lit("_other-view"))),
        F.when(segment == "BUILDING", F.concat(registry, F.lit("-table"))),
        F.when(segment == "MACHINERY", F.lit("")),
    )
    return table(spark, sf_dir, "customer").select(
        F.explode(F.array_compact(names)).alias("name")
    )


def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names, plain and with catalog and database in quotes."""
    names = view_names(spark, sf_dir)
    qualified = F.concat(F.lit('"Catalog"."db-1"."'), F.col("name"), F.lit('"'))
    return names.unionByName(names.select(qualified.alias("name")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package events. Those of HOUSEHOLD customers name no registry, those of the others of
    ``SILENT`` name one that is not known, so no event names ``SILENT`` itself."""
    kind = F.col("event_type")
    bucket = F.when(
        F.col("registry") == SILENT, F.concat(F.lit("former-"), F.col("registry"))
    ).otherwise(F.col("registry"))
    detail_type = (
        F.when(kind.isin("click", "error"), "package-revision")
        .when(kind == "purchase", "package-tag")
        .when(kind == "view", "package-entry")
        .otherwise("package-deleted")
    )
    change = F.when(F.col("value") < 10, "created").when(F.col("value") < 40, "updated")
    detail = F.struct(
        F.lit("0.1").alias("version"),
        change.otherwise("deleted").alias("type"),
        F.when(F.col("c_mktsegment") != "HOUSEHOLD", bucket).alias("bucket"),
        F.col("pkg_name").alias("handle"),
        F.sha2(F.col("props"), 256).alias("topHash"),
    )
    return (
        table(spark, sf_dir, "events")
        .join(customers(spark, sf_dir), F.col("user_id") == F.col("c_custkey"))
        .select(
            F.lit("0").alias("version"),
            F.col("event_id").cast("string").alias("id"),
            detail_type.alias("detail-type"),
            F.when(kind == "error", "org.example.other").otherwise(EVENT_SOURCE).alias("source"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
            detail.alias("detail"),
        )
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log in which the event type gives the kind of line."""
    kind = F.col("event_type")
    text = (
        F.when(kind == "error", "ERROR Athena query failed ")
        .when(kind == "click", "WARN slow listing of bucket ")
        .when(kind == "purchase", "SUCCESS merged ")
        .when(kind == "signup", "✅ table ready ")
        .otherwise("scan of bucket done ")
    )
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"), F.concat(text, F.col("props")).alias("message")
    )
