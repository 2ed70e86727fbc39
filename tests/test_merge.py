from collections import Counter
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from parcelry.operators import (
    bad_timestamps,
    changed_tags,
    choose_tags,
    entry_rows,
    new_rows,
    revision_rows,
    tag_rows,
    tags_to_append,
    upsert_tags,
)
from parcelry.operators.merge import new_keys, rows_with_key
from parcelry.schemas import ENTRY, REVISION, TAG
from tests.conftest import rows

PACKAGES = "registry string, pkg_name string, top_hash string, timestamp string, message string, user_meta string"
ENTRY_COLUMNS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENTRY.schema)
TAG_COLUMNS = "registry string, pkg_name string, tag_name string, top_hash string"
REVISION_COLUMNS = "registry string, pkg_name string, top_hash string, timestamp timestamp_ntz, message string, metadata string"


def entry(logical="l", metadata=None, top="h", physical="p", registry="r"):
    return (registry, top, logical, physical, "0000v", 1, metadata)


def entries(spark, values):
    return spark.createDataFrame(values, ENTRY_COLUMNS)


def tags(spark, values):
    return spark.createDataFrame([("r", p, "latest", h) for p, h in values], TAG_COLUMNS)


def revisions(spark, values):
    return spark.createDataFrame(
        [("r", p, h, datetime(2020, 1, day), "m", None) for p, h, day in values], REVISION_COLUMNS
    )


def test_projections_split_by_timestamp(spark):
    packages = spark.createDataFrame(
        [
            ("r", "a", "h1", "1600000000", "m", "u"),
            ("r", "a", "h1", "latest", "m", "u"),
            ("r", "b", "h2", None, "m", "u"),
        ],
        PACKAGES,
    )
    assert rows(revision_rows(packages)) == [
        ("r", "a", "h1", datetime(2020, 9, 13, 12, 26, 40), "m", "u")
    ]
    assert rows(tag_rows(packages)) == [("r", "a", "latest", "h1")]
    assert rows(tag_rows(packages, "stable")) == []


def test_a_timestamp_that_is_no_number(spark):
    packages = spark.createDataFrame(
        [
            ("r", "a", "h1", "v1.0", "m", "u"),
            ("r", "a", "h2", "1600000000", "m", "u"),
            ("r", "a", "h3", None, "m", "u"),
            ("r", "a", "h3", "latest", "m", "u"),
            ("q", "a", "h3", "latest", "m", "u"),
        ],
        PACKAGES,
    )
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        revision_rows(packages).collect()
    assert [r["top_hash"] for r in revision_rows(packages, on_bad="quarantine").collect()] == ["h2"]
    assert rows(bad_timestamps(packages)) == [("r", 1, 1)]


def test_entry_without_hash(spark):
    objects = spark.createDataFrame(
        [("r", "h", "l", "p", None, 1, None)],
        "registry string, top_hash string, logical_key string, physical_key string, "
        "hash struct<type: string, value: string>, size bigint, meta string",
    )
    assert rows(entry_rows(objects)) == [("r", "h", "l", "p", None, 1, None)]


def test_null_metadata_is_new_only_under_plain_equality(spark):
    both = entries(spark, [entry(), entry(metadata="{}")])
    assert rows(new_rows(both, both, ENTRY.key)) == []
    assert rows(new_rows(both, both, ENTRY.key, null_safe=False)) == [entry()]


def test_null_and_empty_are_different_keys(spark):
    source = entries(spark, [entry(metadata=None), entry(metadata="")])
    target = entries(spark, [entry(metadata="")])
    assert rows(new_rows(source, target, ENTRY.key)) == [entry(metadata=None)]


def test_rows_with_one_key_are_new_together(spark):
    first = ("r", "a", "h", datetime(2020, 1, 1), "one", None)
    second = ("r", "a", "h", datetime(2020, 1, 1), "two", None)
    source = spark.createDataFrame([first, second, second], REVISION_COLUMNS)
    nothing = spark.createDataFrame([], REVISION_COLUMNS)
    held = spark.createDataFrame([first], REVISION_COLUMNS)
    assert rows(new_rows(source, nothing, REVISION.key)) == [first, second]
    assert rows(new_rows(source, held, REVISION.key)) == []


def test_a_moved_object_is_not_new(spark):
    source = entries(spark, [entry(physical="new place")])
    assert rows(new_rows(source, entries(spark, [entry(physical="old")]), ENTRY.key)) == []


def test_other_registry_does_not_count(spark):
    source = entries(spark, [entry(registry="r1")])
    target = entries(spark, [entry(registry="r2")])
    assert rows(new_rows(source, target, ENTRY.key)) == [entry(registry="r1")]


value = st.sampled_from([None, "", "a", "b"])
entry_values = st.lists(
    st.builds(entry, value, value, value, st.sampled_from(["p", "q"]), st.sampled_from(["r", "s"])),
    max_size=12,
)


def brute_force(source, target, null_safe):
    def key(row):
        return (row[0], row[1], row[2], row[6])

    known = {key(t) for t in target if null_safe or None not in key(t)}
    return Counter({row for row in source if key(row) not in known})


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(source=entry_values, target=entry_values, null_safe=st.booleans())
def test_new_rows_against_brute_force(spark, source, target, null_safe):
    s, t = entries(spark, source), entries(spark, target)
    expected = brute_force(source, target, null_safe)
    found = new_rows(s, t, ENTRY.key, null_safe)
    assert Counter(tuple(r) for r in found.collect()) == expected
    keys = new_keys(s, t, ENTRY.key, null_safe)
    picked = rows_with_key(s, keys, ENTRY.key).distinct()
    assert Counter(tuple(r) for r in picked.collect()) == expected


def test_a_moved_tag_is_appended_again_and_again(spark):
    held = tags(spark, [("a", "h1")])
    assert rows(tags_to_append(tags(spark, [("a", "h1")]), held)) == []
    inserted = []
    for _ in range(3):
        new = tags_to_append(tags(spark, [("a", "h2")]), held)
        inserted.append(new.count())
        held = tags(spark, [(r[1], r[3]) for r in held.collect() + new.collect()])
    assert inserted == [1, 1, 1]


tag_values = st.lists(st.tuples(value, value), max_size=10)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(source=tag_values, target=tag_values)
def test_tags_to_append_against_all_pairs(spark, source, target):
    def inserted(package, top_hash):
        matches = [t for p, t in target if package is not None and p == package]
        return not matches or any(
            t is None or (top_hash is not None and t != top_hash) for t in matches
        )

    expected = {("r", p, "latest", h) for p, h in source if inserted(p, h)}
    found = [tuple(r) for r in tags_to_append(tags(spark, source), tags(spark, target)).collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_the_newest_revision_decides_between_tags(spark):
    known = revisions(spark, [("a", "h1", 2), ("a", "h2", 1), ("b", "h3", 1), ("b", "h4", 1)])
    source = tags(
        spark, [("a", "h1"), ("a", "h2"), ("b", "h3"), ("b", "h4"), ("c", "h5"), ("a", "zz")]
    )
    assert rows(choose_tags(source, known)) == [
        ("r", "a", "latest", "h1"),
        ("r", "b", "latest", "h4"),
        ("r", "c", "latest", "h5"),
    ]


def test_upsert_keeps_one_row_per_tag(spark):
    known = revisions(spark, [])
    target = tags(spark, [("a", "h1"), ("a", "h2"), ("b", "h3"), (None, "h4")])
    source = tags(spark, [("a", "h2"), ("c", "h5"), (None, "h6")])
    assert rows(upsert_tags(source, target, known)) == [
        ("r", None, "latest", "h6"),
        ("r", "a", "latest", "h2"),
        ("r", "b", "latest", "h3"),
        ("r", "c", "latest", "h5"),
    ]
    chosen = choose_tags(source, known)
    assert rows(changed_tags(chosen, target)) == [
        ("r", None, "latest", "h6"),
        ("r", "a", "latest", "h2"),
        ("r", "c", "latest", "h5"),
    ]
    assert rows(changed_tags(chosen, upsert_tags(source, target, known))) == []


def test_tag_key_covers_registry_and_tag(spark):
    assert TAG.key == ("registry", "pkg_name", "tag_name")
    target = spark.createDataFrame([("r", "a", "stable", "h0"), ("q", "a", "latest", "h0")], TAG_COLUMNS)
    state = upsert_tags(tags(spark, [("a", "h1")]), target, revisions(spark, []))
    assert state.count() == 3
