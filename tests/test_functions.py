from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import NumberFormatException
from pyspark.sql import functions as F

from parcelry.functions import (
    epoch_to_timestamp,
    log_severity,
    multihash,
    registry_from_name,
    strip_view_suffix,
    zoneless,
)


def apply(spark, expression, values, kind="string"):
    frame = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in frame.select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "hash_type, value, expected",
    [
        ("SHA256", "ab", "1220ab"),
        ("sha2-256-chunked", "ab", "b150ab"),
        ("MD5", "ab", "0000ab"),
        ("sha256", "ab", "0000ab"),
        (None, "ab", "0000ab"),
        ("SHA256", None, None),
    ],
)
def test_multihash(spark, hash_type, value, expected):
    found = apply(spark, multihash, [(hash_type, value)], "struct<type: string, value: string>")
    assert found == [expected]


def test_multihash_of_no_hash_is_null(spark):
    assert apply(spark, multihash, [None], "struct<type: string, value: string>") == [None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_epoch_is_independent_of_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = apply(spark, epoch_to_timestamp, ["0", "1600000000", "5000000000", "-1", None])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == [
        datetime(1970, 1, 1),
        datetime(2020, 9, 13, 12, 26, 40),
        datetime(2128, 6, 11, 8, 53, 20),
        datetime(1969, 12, 31, 23, 59, 59),
        None,
    ]


def test_moments_are_independent_of_the_zones(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    east = timezone(timedelta(hours=2))
    try:
        found = spark.range(1).select(
            zoneless(datetime(2024, 3, 31, 2, 30)),
            zoneless(datetime(2024, 3, 31, 2, 30, 0, 5, tzinfo=east)),
        )
        assert tuple(found.first()) == (
            datetime(2024, 3, 31, 2, 30),
            datetime(2024, 3, 31, 0, 30, 0, 5),
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_bad_epoch_fails_or_is_null(spark):
    with pytest.raises(NumberFormatException):
        apply(spark, epoch_to_timestamp, ["v1.0"])
    assert apply(spark, lambda c: epoch_to_timestamp(c, "quarantine"), ["v1.0"]) == [None]
    with pytest.raises(ValueError):
        epoch_to_timestamp(F.col("v"), "ignore")


@pytest.mark.parametrize(
    "name, kind, expected",
    [
        ("npm_packages-view", "packages", "npm"),
        ("npm_objects-view", "packages", "unknown"),
        ("npm_objects-view", "objects", "npm"),
        ("a_b.c_packages-view", "packages", "a_b.c"),
        ('"Cat"."db-x"."one-two_packages-view"', "packages", "one-two"),
        ('"db"."one_packages-view"', "packages", "one"),
        ("_packages-view", "packages", "unknown"),
        ("plain", "packages", "unknown"),
        ("", "packages", "unknown"),
    ],
)
def test_registry_from_name(spark, name, kind, expected):
    assert apply(spark, lambda c: registry_from_name(c, kind), [name]) == [expected]


def test_strip_view_suffix(spark):
    names = ["one-two_packages-view", "test_objects-view", "x_other-view", "plain"]
    assert apply(spark, strip_view_suffix, names) == ["one-two", "test", "x_other-view", "plain"]


def test_log_severity_first_match_wins(spark):
    lines = ["SUCCESS after ERROR", "❌", "WARN SUCCESS", "⚠️ slow", "✅ done", "SUCCESS", "error"]
    assert apply(spark, log_severity, lines) == [
        "error",
        "error",
        "warn",
        "warn",
        "success",
        "success",
        "plain",
    ]
