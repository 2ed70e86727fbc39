"""Declared schemas, keys and physical layouts of the inputs and the three targets."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The SQL type names a column may be declared with.
SQL_TYPES: dict[str, T.DataType] = {
    "STRING": T.StringType(),
    "VARCHAR": T.StringType(),
    "BIGINT": T.LongType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
}

# Columns that may not be NULL in the partitioned tables.
REQUIRED_COLUMNS = ("registry", "pkg_name", "top_hash")


def spark_type(sql_type: str) -> T.DataType:
    """Spark type for a declared SQL type; an unknown name is stored as a string."""
    return SQL_TYPES.get(sql_type.upper(), T.StringType())


def table_schema(columns: dict[str, str]) -> T.StructType:
    """StructType from ``{name: SQL type}``; key columns are not nullable."""
    if not columns:
        raise ValueError("a table needs at least one column")
    for name, sql_type in columns.items():
        if not (name or "").strip() or not (sql_type or "").strip():
            raise ValueError(f"invalid column: name={name!r}, type={sql_type!r}")
    return T.StructType(
        [
            T.StructField(name, spark_type(sql_type), name not in REQUIRED_COLUMNS)
            for name, sql_type in columns.items()
        ]
    )


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A frame with the schema's columns and types, and no rows."""
    return spark.createDataFrame([], schema)


PACKAGES_VIEW = T.StructType(
    [
        T.StructField("pkg_name", T.StringType()),
        T.StructField("top_hash", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("user_meta", T.StringType()),
    ]
)

OBJECTS_VIEW = T.StructType(
    [
        T.StructField("top_hash", T.StringType()),
        T.StructField("logical_key", T.StringType()),
        T.StructField("physical_key", T.StringType()),
        T.StructField(
            "hash",
            T.StructType(
                [T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]
            ),
        ),
        T.StructField("size", T.LongType()),
        T.StructField("meta", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Target:
    """One of the three tables: what it holds, what makes a row new, how it is laid out."""

    name: str
    view: str  # kind of source view it is filled from
    schema: T.StructType
    key: tuple[str, ...]
    partition_by: tuple[str, ...]
    bucket_by: tuple[tuple[int, str], ...]  # all bucket transforms of the layout
    sort_by: tuple[str, ...] = ()
    #: Buckets of the table's keys (``plans.keys``). At scale as many as keep the digests of a
    #: bucket, of all registries that a job covers, to some hundred MB.
    key_buckets: int = 8

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


REVISION = Target(
    name="package_revision",
    view="packages",
    schema=table_schema(
        {
            "registry": "STRING",
            "pkg_name": "STRING",
            "top_hash": "STRING",
            "timestamp": "TIMESTAMP",
            "message": "STRING",
            "metadata": "STRING",
        }
    ),
    key=("registry", "pkg_name", "top_hash"),
    partition_by=("registry",),
    bucket_by=((8, "pkg_name"), (8, "top_hash")),
    sort_by=("pkg_name", "top_hash"),
)

TAG = Target(
    name="package_tag",
    view="packages",
    schema=table_schema(
        {
            "registry": "STRING",
            "pkg_name": "STRING",
            "tag_name": "STRING",
            "top_hash": "STRING",
        }
    ),
    key=("registry", "pkg_name", "tag_name"),
    partition_by=("registry", "tag_name"),
    bucket_by=((8, "pkg_name"),),
    sort_by=("pkg_name",),
)

ENTRY = Target(
    name="package_entry",
    view="objects",
    schema=table_schema(
        {
            "registry": "STRING",
            "top_hash": "STRING",
            "logical_key": "STRING",
            "physical_key": "STRING",
            "multihash": "STRING",
            "size": "BIGINT",
            "metadata": "STRING",
        }
    ),
    key=("registry", "top_hash", "logical_key", "metadata"),
    partition_by=("registry",),
    bucket_by=((64, "physical_key"),),
    sort_by=("top_hash", "logical_key"),
)

# Entry layout for read-mostly catalogs: a lookup of one revision opens one bucket of 64.
ENTRY_BY_TOP_HASH = replace(ENTRY, bucket_by=((64, "top_hash"),))

# Entry layout for frequent small merges: a merge writes few files, as no bucket needs its own.
ENTRY_SORTED = replace(ENTRY, bucket_by=())

TARGETS = (REVISION, TAG, ENTRY)
