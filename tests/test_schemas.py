import pytest
from pyspark.sql import types as T

from parcelry.schemas import ENTRY, REVISION, TAG, empty_frame, spark_type, table_schema


def test_types():
    assert spark_type("bigint") == T.LongType()
    assert spark_type("TIMESTAMP") == T.TimestampNTZType()
    assert spark_type("VARCHAR") == T.StringType()
    assert spark_type("INT") == T.IntegerType()
    assert spark_type("DOUBLE") == T.DoubleType()
    assert spark_type("BOOLEAN") == T.BooleanType()
    assert spark_type("geometry") == T.StringType()


def test_key_columns_are_required():
    nullable = {f.name: f.nullable for f in REVISION.schema}
    assert nullable == {
        "registry": False,
        "pkg_name": False,
        "top_hash": False,
        "timestamp": True,
        "message": True,
        "metadata": True,
    }
    assert [f.name for f in ENTRY.schema if not f.nullable] == ["registry", "top_hash"]
    assert TAG.columns == ["registry", "pkg_name", "tag_name", "top_hash"]


def test_layouts():
    assert REVISION.partition_by == ("registry",)
    assert REVISION.bucket_by == ((8, "pkg_name"), (8, "top_hash"))
    assert TAG.partition_by == ("registry", "tag_name")
    assert TAG.bucket_by == ((8, "pkg_name"),)
    assert ENTRY.partition_by == ("registry",)
    assert ENTRY.bucket_by == ((64, "physical_key"),)


@pytest.mark.parametrize("columns", [{}, {"": "STRING"}, {"a": ""}, {"a": None}, {" ": "INT"}])
def test_invalid_columns(columns):
    with pytest.raises(ValueError):
        table_schema(columns)


def test_empty_frame(spark):
    frame = empty_frame(spark, ENTRY.schema)
    assert frame.count() == 0
    assert frame.schema == ENTRY.schema
