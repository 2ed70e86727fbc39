import uuid
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parcelry import tag_listing, tag_lookup
from parcelry.plans import run, tables
from parcelry.plans.run import consolidate
from parcelry.plans.tables import create_database, drop_targets, table_name
from parcelry.schemas import ENTRY, OBJECTS_VIEW, PACKAGES_VIEW, REVISION, TAG, TARGETS
from parcelry.session import work_folder
from parcelry.sources.views import sources_from_catalog, sources_from_frames
from tests.conftest import rows

pytestmark = pytest.mark.usefixtures("interpreted")
TYPE = ("SHA256", "ab")


def package(name, top_hash, timestamp, message="m"):
    return (name, top_hash, timestamp, message, "{}")


def views(registry, tagged="h2", extra_objects=()):
    return {
        f"{registry}_packages-view": [
            package("a/a", "h1", "1600000000"),
            package("a/a", "h2", "1700000000"),
            package("a/a", tagged, "latest"),
            package("b/b", "h3", "1650000000"),
            package("b/b", "h3", "latest"),
            package("c/c", "h4", None),
        ],
        f"{registry}_objects-view": [
            ("h1", "README", "s3://x/1", TYPE, 5, None),
            ("h2", "README", "s3://x/2", TYPE, 9, None),
            ("h2", "data", "s3://x/3", TYPE, 7, '{"a":1}'),
            ("h2", "empty", "s3://x/4", None, None, None),
            ("h3", "data", "s3://x/3", TYPE, 7, None),
            *extra_objects,
        ],
    }


def contents(spark, database):
    return {
        t.name: rows(spark.table(table_name(t, database)).select(*t.columns)) for t in TARGETS
    }


def written(report):
    return [report.rows(t.name) for t in TARGETS]


@pytest.mark.parametrize("partitioned", [True, False])
def test_running_again_adds_nothing(spark, make_database, make_sources, partitioned):
    database = make_database(partitioned)
    sources = make_sources(views("r1") | views("r-2"))
    first = consolidate(spark, sources, database)
    assert written(first) == [6, 4, 10]
    assert first.summary() == {
        "num_tables": 2,
        "successful_tables": 6,
        "failed_tables": 0,
        "skipped_tables": 0,
        "total_queries": 6,
    }
    before = contents(spark, database)
    assert written(consolidate(spark, sources, database)) == [0, 0, 0]
    assert contents(spark, database) == before


@pytest.mark.parametrize("partitioned", [True, False])
def test_a_tag_moves(spark, make_database, make_sources, partitioned):
    database = make_database(partitioned)
    consolidate(spark, make_sources(views("r1", "h1") | views("r2", "h1")), database)
    moved = make_sources(views("r1", "h2") | views("r2", "h1"))
    assert written(consolidate(spark, moved, database)) == [0, 1, 0]
    assert contents(spark, database)["package_tag"] == [
        ("r1", "a/a", "latest", "h2"),
        ("r1", "b/b", "latest", "h3"),
        ("r2", "a/a", "latest", "h1"),
        ("r2", "b/b", "latest", "h3"),
    ]


def fail_after_writing(spark, monkeypatch):
    """Replacing tags fails when the new files are there, and the old ones, were they replaced
    in place, are not."""
    write = tables.write_version

    def fail(frame, target, folder, provider):
        write(frame, target, folder, provider)
        raise PySparkException("no space left")

    monkeypatch.setattr(tables, "write_version", fail)


@pytest.mark.parametrize("options", [{}, {"isolate": True}, {"group_size": 2}])
def test_a_failed_replacement_loses_no_tags(
    spark, make_database, make_sources, monkeypatch, options
):
    database = make_database(partitioned=False)
    start = make_sources(views("r1", "h1") | views("r2", "h1") | views("r3", "h1"))
    consolidate(spark, start, database, **options)
    before = contents(spark, database)
    moved = make_sources(views("r1", "h2") | views("r2", "h2") | views("r3", "h1"))
    with monkeypatch.context() as patch:
        fail_after_writing(spark, patch)
        report = consolidate(spark, moved, database, **options)
    failed = [o for o in report.outcomes if o.status == "failed"]
    assert {o.target for o in failed} == {"package_tag"}
    assert {r for o in failed for r in o.registries} >= {"r1", "r2"}
    assert report.rows("package_tag") == 0 and "no space left" in failed[0].error
    assert contents(spark, database) == before
    assert consolidate(spark, moved, database, **options).rows("package_tag") == 2
    assert [t[0] for t in contents(spark, database)["package_tag"]] == ["r1", "r1", "r2", "r2", "r3", "r3"]


@pytest.mark.parametrize("options", [{}, {"isolate": True}])
def test_a_failed_replacement_of_partitions_loses_no_tags(
    spark, make_database, make_sources, monkeypatch, options
):
    """A task that writes fails: the old tags stay readable, and the next run replaces them."""
    database = make_database()
    consolidate(spark, make_sources(views("r1", "h1") | views("r2", "h1")), database)
    before = contents(spark, database)["package_tag"]
    replace_tags = run.replace_tags

    def fail_late(target, tags):
        lost = F.raise_error(F.lit("no space left")).cast("string")
        state = replace_tags(target, tags)
        return state.withColumn("top_hash", F.when(F.col("pkg_name") == "b/b", lost).otherwise(F.col("top_hash")))

    moved = make_sources(views("r1", "h2") | views("r2", "h2"))
    with monkeypatch.context() as patch:
        patch.setattr(run, "replace_tags", fail_late)
        report = consolidate(spark, moved, database, **options)
    failed = [o for o in report.outcomes if o.status == "failed"]
    assert {(o.target, o.registries) for o in failed} == {
        ("package_tag", ("r1",)),
        ("package_tag", ("r2",)),
    }
    assert "no space left" in failed[0].error
    assert contents(spark, database)["package_tag"] == before
    left = spark.sql(f"SHOW TABLES IN `{database}`").where("not isTemporary")
    assert left.count() == 5  # the three and two of keys, none that was written through
    assert consolidate(spark, moved, database).rows("package_tag") == 2
    assert [t[3] for t in contents(spark, database)["package_tag"]] == ["h2", "h3"] * 2


def test_a_run_that_stops_while_partitions_are_switched(
    spark, make_database, make_sources, monkeypatch
):
    """Some partitions are new, the others old, each whole."""
    database = make_database()
    consolidate(spark, make_sources(views("r1", "h1") | views("r2", "h1")), database)
    moved = make_sources(views("r1", "h2") | views("r2", "h2"))
    switched = []

    def stop(spark, table, *wanted):
        if table.startswith(f"{table_name(TAG, database)} PARTITION"):
            switched.append(table)
            if len(switched) == 2:
                raise PySparkException("stopped")
        return described(spark, table, *wanted)

    described = tables._described
    with monkeypatch.context() as patch:
        patch.setattr(tables, "_described", stop)
        assert consolidate(spark, moved, database).failed == 2
    hashes = [t[3] for t in contents(spark, database)["package_tag"] if t[1] == "a/a"]
    assert sorted(hashes) == ["h1", "h2"]
    assert consolidate(spark, moved, database).rows("package_tag") == 1
    assert [t[3] for t in contents(spark, database)["package_tag"]] == ["h2", "h3"] * 2


def test_only_data_errors_are_narrowed_down(spark, make_database, make_sources, monkeypatch):
    database = make_database(partitioned=False)
    calls = []

    def fail(self, frame, target, registries):
        calls.append(registries)
        raise PySparkException("no space left on device")

    monkeypatch.setattr(run._Run, "insert_new", fail)
    sources = make_sources(views("r1") | views("r2") | views("r3"))
    report = consolidate(spark, sources, database, targets=[REVISION])
    assert len(calls) == 1 and report.failed == 3


def test_strict_run_repeats_what_it_cannot_compare(spark, make_database, make_sources):
    database = make_database(partitioned=False)
    consolidate(spark, make_sources(views("r1", "h1")), database, strict=True)
    moved = make_sources(views("r1", "h2"))
    assert written(consolidate(spark, moved, database, strict=True)) == [0, 1, 4]
    assert written(consolidate(spark, moved, database, strict=True)) == [0, 1, 4]
    tags = contents(spark, database)["package_tag"]
    assert Counter(tags)[("r1", "a/a", "latest", "h2")] == 2
    # The next run that is not strict settles the tag.
    consolidate(spark, moved, database)
    assert contents(spark, database)["package_tag"] == [
        ("r1", "a/a", "latest", "h2"),
        ("r1", "b/b", "latest", "h3"),
    ]


def test_ways_to_run_agree(spark, make_database, make_sources):
    """All at once, by registry, in groups and step by step: the same tables."""
    more = [("h9", f"k{i}", "s3://x/9", TYPE, i, None) for i in range(20)]
    start = views("r1", "h1") | views("r2")
    end = views("r1", "h2", more) | views("r2", "h1", more) | views("r3")
    results = []
    for options in [
        {},
        {"isolate": True},
        {"group_size": 2},
        {"broadcast_bytes": 0},
    ]:
        database = make_database(partitioned=False)
        consolidate(spark, make_sources(start), database, **options)
        consolidate(spark, make_sources(end), database, **options)
        results.append(contents(spark, database))
    database = make_database(partitioned=False)
    consolidate(spark, make_sources(start), database)
    for registry in ("r3", "r1", "r2"):
        consolidate(spark, make_sources(end), database, [registry])
    results.append(contents(spark, database))
    assert len(results[0]["package_entry"]) == 5 * 3 + 2 * 20
    assert all(result == results[0] for result in results[1:])


def test_views_of_a_catalog(spark, make_database):
    found = f"source_{uuid.uuid4().hex}"
    create_database(spark, found, f"{work_folder(spark)}/{found}")
    for name, data in views("r-2", "h1").items():
        schema = PACKAGES_VIEW if "packages" in name else OBJECTS_VIEW
        # The catalog used here allows no dash in a table's name, but in a view's.
        spark.createDataFrame(data, schema).createOrReplaceTempView(f"`{name}`")
    database = make_database(partitioned=False)
    consolidate(spark, sources_from_catalog(spark, found), database)
    assert {row[0] for row in contents(spark, database)["package_entry"]} == {"r-2"}
    for name in views("r-2"):
        spark.catalog.dropTempView(name)
    spark.sql(f"DROP DATABASE `{found}` CASCADE")


def test_a_group_costs_the_same_with_many_registries(spark, make_sources):
    def plan_size(n):
        views_of = {
            f"r{i}_packages-view": [package("a/a", "h1", "1600000000")] for i in range(n)
        }
        sources = make_sources(views_of)
        frame = sources.view("packages", ["r1", "r2"])
        return len(frame._jdf.queryExecution().analyzed().toString())

    assert plan_size(60) == plan_size(3)


def test_only_the_registries_asked_for(spark, make_database, make_sources):
    database = make_database(partitioned=False)
    sources = make_sources(views("r1") | views("r2"))
    report = consolidate(spark, sources, database, ["r2", "unknown"])
    assert report.summary()["num_tables"] == 1
    for held in contents(spark, database).values():
        assert {row[0] for row in held} == {"r2"}


def test_a_missing_view_is_skipped(spark, make_database, make_sources):
    database = make_database(partitioned=False)
    both = views("r1") | {
        "p_packages-view": views("p")["p_packages-view"],
        "o_objects-view": views("o")["o_objects-view"],
    }
    report = consolidate(spark, make_sources(both), database)
    assert (report.successful, report.failed, report.skipped) == (6, 0, 3)
    held = contents(spark, database)
    assert {row[0] for row in held["package_revision"]} == {"p", "r1"}
    assert {row[0] for row in held["package_entry"]} == {"o", "r1"}
    assert written(consolidate(spark, make_sources(both), database)) == [0, 0, 0]


def test_one_bad_registry_does_not_stop_the_others(spark, make_database, make_sources):
    database = make_database(partitioned=False)
    bad = views("bad")
    bad["bad_packages-view"].append(package("z/z", "hz", "v1.0"))
    sources = make_sources(views("r1") | bad | views("r2"))
    report = consolidate(spark, sources, database)
    assert (report.successful, report.failed) == (8, 1)
    failed = [o for o in report.outcomes if o.status == "failed"]
    assert [(o.target, o.registries) for o in failed] == [("package_revision", ("bad",))]
    good = [o.registries for o in report.outcomes if (o.target, o.status) == ("package_revision", "ok")]
    assert good == [("r1", "r2")]
    assert "CAST_INVALID_INPUT" in failed[0].error
    held = contents(spark, database)
    assert {row[0] for row in held["package_revision"]} == {"r1", "r2"}
    assert {row[0] for row in held["package_entry"]} == {"r1", "r2", "bad"}
    report = consolidate(spark, sources, database, on_bad_timestamp="quarantine")
    assert (report.failed, report.rows("package_revision")) == (0, 3)


def test_a_null_key_fails_only_in_the_partitioned_layout(spark, make_database, make_sources):
    broken = views("r1")
    broken["r1_packages-view"].append(package(None, "hn", "1600000000"))
    sources = make_sources(broken)
    plain = make_database(partitioned=False)
    assert consolidate(spark, sources, plain, targets=[REVISION]).rows("package_revision") == 4
    assert consolidate(spark, sources, plain, targets=[REVISION]).rows("package_revision") == 0
    report = consolidate(spark, sources, make_database(targets=[REVISION]), targets=[REVISION])
    assert report.failed == 1 and "pkg_name is NULL" in report.outcomes[0].error


def test_frames_may_hold_more_registries_than_asked_for(spark, make_database, make_sources):
    everything = make_sources(views("r1") | views("r2"))
    one = sources_from_frames(
        everything.packages, everything.objects, {"r2": ("packages", "objects")}
    )
    database = make_database(partitioned=False)
    consolidate(spark, one, database)
    for held in contents(spark, database).values():
        assert {row[0] for row in held} == {"r2"}


def test_no_registries(spark, make_database):
    report = consolidate(spark, sources_from_frames(None, None, {}), make_database(targets=TARGETS))
    assert set(report.summary().values()) == {0}


def test_targets_must_exist(spark, make_database, make_sources):
    database = make_database(partitioned=False)
    drop_targets(spark, database, [REVISION])
    sources = make_sources(views("r1"))
    with pytest.raises(LookupError, match="package_revision"):
        consolidate(spark, sources, database)
    with pytest.raises(LookupError, match="package_revision"):
        consolidate(spark, sources, database, targets=[TAG])
    assert consolidate(spark, sources, database, targets=[ENTRY]).successful == 1


def test_listing(spark, make_database, make_sources):
    database = make_database(targets=TARGETS)
    consolidate(spark, make_sources(views("r1") | views("r2", "h1")), database)
    entries = spark.table(table_name(ENTRY, database))
    tags = spark.table(table_name(TAG, database))
    expected = [
        (7, "data", "s3://x/3", "r1", "1220ab"),
        (9, "README", "s3://x/2", "r1", "1220ab"),
        (None, "empty", "s3://x/4", "r1", None),
    ]
    for listing in (
        tag_listing(entries, tags, "r1", "a/a"),
        tag_lookup(entries, tags, "r1", "a/a"),
        tag_lookup(entries, tags, "r1", "a/a", resolve=True),
    ):
        assert [tuple(r) for r in listing.collect()] == expected
    assert tag_listing(entries, tags).count() == 3 + 1 + 1 + 1
    for resolve in (True, False):
        assert tag_lookup(entries, tags, "r1", "no/such", resolve=resolve).count() == 0
    doubled = tags.unionByName(tags.withColumn("top_hash", F.lit("h1")))
    assert tag_listing(entries, doubled, "r1", "a/a").count() == 4
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        tag_lookup(entries, doubled, "r1", "a/a").collect()
    with pytest.raises(ValueError, match="several rows"):
        tag_lookup(entries, doubled, "r1", "a/a", resolve=True)
