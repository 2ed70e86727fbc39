"""The keys a table holds, kept beside it as digests in a table of their own.

A merge asks which of many delivered rows a table has already. With the digests of its keys at
hand, bucketed by digest, it reads 32 bytes a row of the registries it covers instead of their
key columns, and joins them where they lie: only the delivered side is shuffled.

The key table is a copy and may fall behind: a merge that stops between the two writes, or rows
written past the merge. So every row says how many rows of the table have its key, and a merge
first compares the sums with the row counts of its registries. A registry in which they differ
gets its keys anew, from the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelry.operators.merge import DIGEST, key_digest, key_has_null
from parcelry.plans.tables import key_table_name, sql_text, table_name
from parcelry.schemas import Target

_ROWS = "n_rows"
_PARTIAL = "has_null"
_PACKED = "__packed"
_KNOWN = "__known"
#: Whether several delivered rows have a key.
SEVERAL = "__several"

KEY_SCHEMA = T.StructType(
    [
        T.StructField(DIGEST, T.BinaryType()),
        T.StructField(_PARTIAL, T.BooleanType()),
        T.StructField(_ROWS, T.LongType()),
        T.StructField("registry", T.StringType()),
    ]
)


def create_key_table(spark: SparkSession, target: Target, database: str | None) -> str:
    """The name of the target's key table, which is created if it is absent."""
    name = key_table_name(target, database)
    if not spark.catalog.tableExists(name):
        (
            spark.createDataFrame([], KEY_SCHEMA)
            .write.format("parquet")
            .partitionBy("registry")
            .bucketBy(target.key_buckets, DIGEST)
            .mode("ignore")
            .saveAsTable(name)
        )
    return name


def digests_with_counts(rows: DataFrame, target: Target) -> DataFrame:
    """Rows of the key table for rows of the target: one for each key of a registry."""
    return (
        rows.select(
            key_digest(target.key).alias(DIGEST),
            key_has_null(target.key).alias(_PARTIAL),
            "registry",
        )
        .groupBy(DIGEST, _PARTIAL, "registry")
        .agg(F.count(F.lit(1)).alias(_ROWS))
    )


def append_digests(frame: DataFrame, target: Target, database: str | None) -> None:
    """Append rows made by ``digests_with_counts``, a task for each bucket."""
    spark = frame.sparkSession
    name = create_key_table(spark, target, database)
    rows = frame.select(*spark.table(name).columns)
    rows.repartition(target.key_buckets, DIGEST).write.insertInto(name)


def _in(registries: Sequence[str]) -> Column:
    return F.col("registry").isin(*registries)


def row_counts(
    spark: SparkSession, target: Target, database: str | None, registries: Sequence[str]
) -> dict[str, tuple[int, int]]:
    """Per registry the rows of the table, and the rows its key table stands for."""
    held = spark.table(table_name(target, database)).where(_in(registries))
    keys = spark.table(create_key_table(spark, target, database)).where(_in(registries))
    none = F.lit(0).cast("bigint")
    counts = (
        held.groupBy("registry")
        .agg(F.count(F.lit(1)).alias("held"), none.alias("noted"))
        .unionAll(keys.groupBy("registry").agg(none.alias("held"), F.sum(_ROWS).alias("noted")))
        .groupBy("registry")
        .agg(F.sum("held").alias("held"), F.sum("noted").alias("noted"))
    )
    return {r.registry: (r.held, r.noted) for r in counts.collect()}  # at most those asked for


def rebuild(
    spark: SparkSession, target: Target, database: str | None, registries: Sequence[str]
) -> None:
    """Take the keys of these registries from the table itself.

    Their old keys go first. If this stops half-way the counts differ still, and the next merge
    begins again.
    """
    if not registries:
        return
    name = create_key_table(spark, target, database)
    partitions = ", ".join(f"PARTITION (registry = {sql_text(r)})" for r in registries)
    spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {partitions}")
    held = spark.table(table_name(target, database)).where(_in(registries))
    append_digests(digests_with_counts(held, target), target, database)


def known_keys(
    spark: SparkSession,
    target: Target,
    database: str | None,
    registries: Sequence[str],
    null_safe: bool = True,
) -> DataFrame:
    """Digests of the keys noted for these registries.

    Under plain equality (``null_safe=False``) a key with a NULL part equals no other key, so
    those are left out.
    """
    keys = spark.table(key_table_name(target, database)).where(_in(registries))
    return (keys if null_safe else keys.where(~F.col(_PARTIAL))).select(DIGEST)


def delivered_keys(rows: DataFrame, target: Target, registries: Sequence[str]) -> DataFrame:
    """Digests of the keys of delivered rows, each once, what else the key table says of them, and
    whether several rows have them.

    Registry and NULLs are packed into a number, as Spark aggregates numbers by hash. Copies are
    dropped before the shuffle. Where Spark would deal out the key table rather than this, for
    having fewer buckets than the session has shuffle partitions, this is dealt out like it.
    """
    place = F.array_position(F.array(*map(F.lit, registries)), F.col("registry"))
    packed = (2 * place + key_has_null(target.key).cast("int")).cast("int")
    keys = (
        rows.select(key_digest(target.key).alias(DIGEST), packed.alias(_PACKED))
        .groupBy(DIGEST)
        .agg(F.min(_PACKED).alias(_PACKED), (F.count(F.lit(1)) > 1).alias(SEVERAL))
    )
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if partitions > target.key_buckets:
        keys = keys.repartition(target.key_buckets, DIGEST)
    return keys


def unknown_keys(
    rows: DataFrame,
    target: Target,
    database: str | None,
    registries: Sequence[str],
    null_safe: bool = True,
) -> DataFrame:
    """The delivered keys that the table lacks; on its side nothing is shuffled. Its key table
    must be up to date."""
    known = known_keys(rows.sparkSession, target, database, registries, null_safe)
    keys = delivered_keys(rows, target, registries)
    # No anti join, which Spark would move in front of the dealing out.
    found = keys.join(known.withColumn(_KNOWN, F.lit(True)), DIGEST, "left")
    return found.where(F.col(_KNOWN).isNull()).drop(_KNOWN)


def unpacked(keys: DataFrame, registries: Sequence[str]) -> DataFrame:
    """Rows of the key table for delivered keys that have one row each."""
    place = F.floor(F.col(_PACKED) / 2).cast("int")
    return keys.select(
        DIGEST,
        (F.col(_PACKED) % 2 == 1).alias(_PARTIAL),
        F.lit(1).cast("bigint").alias(_ROWS),
        F.element_at(F.array(*map(F.lit, registries)), place).alias("registry"),
    )
