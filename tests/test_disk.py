"""What a run leaves on the disks, and how much it moves."""

import time

import pytest
from pyspark.sql import functions as F

from parcelry.operators import entry_rows, new_rows
from parcelry.operators.merge import distinct_rows, pack_hashes, unpack_hashes
from parcelry.plans import run
from parcelry.plans.run import consolidate
from parcelry.plans.tables import append_rows, for_writing
from parcelry.schemas import ENTRY
from parcelry_checks import fixtures as fx
from tests.conftest import rows
from tests.test_consolidate import contents, views, written
from tests.test_keys import assert_up_to_date
from tests.test_plans import plan

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "ab", "AB", "aB", "abc", "t", "x", "xab", "0", "00", "é", "1220" + "0f" * 32, "zz", "a b"]


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = blocks.getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def test_a_merge_leaves_no_shuffle_files(spark, interpreted, make_database, make_sources):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting_before = spark.conf.get(setting)
    database, sources = make_database(), make_sources(views("r1") | views("r2"))
    before = shuffle_files(spark)
    consolidate(spark, sources, database)
    append_rows(spark.createDataFrame([("r1", "h7", "k", "s3://x/7", None, 1, None)], ENTRY.schema), ENTRY, database)
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(setting) == setting_before


def test_hashes_are_packed_without_loss(spark):
    frame = spark.createDataFrame([(a, b, "n") for a in TEXTS for b in TEXTS], "top_hash string, multihash string, note string")
    packed = pack_hashes(frame)
    assert [kind for _, kind in packed.dtypes] == ["binary", "binary", "string"]
    assert packed.distinct().count() == len(TEXTS) ** 2
    assert rows(unpack_hashes(packed)) == rows(frame)
    assert rows(distinct_rows(frame.union(frame))) == rows(frame)
    longest = packed.where(F.length("multihash") > 30).select(F.max(F.length("multihash"))).first()[0]
    assert longest == 35  # of 68 digits


def test_new_rows_are_shuffled_packed(spark):
    entries = entry_rows(fx.objects(spark, SF))
    text = plan(new_rows(entries, fx.loaded_entries(spark, SF), ENTRY.key))
    assert "unhex(top_hash" in text and "unhex(multihash" in text


def test_only_few_rows_are_shuffled_for_a_plain_table(spark):
    entries = spark.range(10).select(*(F.col("id").cast(f.dataType).alias(f.name) for f in ENTRY.schema))
    assert "Exchange" not in plan(for_writing(entries, ENTRY, []))
    assert "Exchange" in plan(for_writing(entries, ENTRY, [], few=True))


@pytest.mark.parametrize("broadcast_bytes", [0, 64, 1 << 25])
@pytest.mark.parametrize("partitioned", [True, False])
def test_copies_and_shared_keys(
    spark, interpreted, make_database, make_sources, partitioned, broadcast_bytes
):
    """Copies go, rows that only share their key stay; at first and beside rows that are held."""
    twice = [("h9", "k", f"s3://x/{i}", None, i, None) for i in (1, 2, 2)]
    again = [("h8", "k", f"s3://x/{i}", None, i, "{}") for i in (3, 3, 4)]
    database = make_database(partitioned)
    steps = [views("r1", extra_objects=twice), views("r1", extra_objects=twice + again)]
    added = []
    for step in steps:
        sources = make_sources(step)
        report = consolidate(spark, sources, database, broadcast_bytes=broadcast_bytes)
        added.append(written(report)[2])
        assert_up_to_date(spark, database)
    assert added == [7, 2]
    held = contents(spark, database)["package_entry"]
    assert len(held) == len(set(held)) == 9


def test_keys_of_views_that_change_meanwhile(
    spark, interpreted, make_database, make_sources, monkeypatch
):
    """More rows are written than were counted: the keys come from the table."""
    append = run.append_rows

    def with_another(frame, target, database=None, few=False):
        done = append(frame, target, database, few)
        if target is ENTRY:
            late = spark.createDataFrame([("r1", "h7", "k", "s3://x/7", None, 1, None)], ENTRY.schema)
            done += append(late, target, database, few)
        return done

    database = make_database()
    monkeypatch.setattr(run, "append_rows", with_another)
    assert written(consolidate(spark, make_sources(views("r1")), database))[2] == 6
    assert_up_to_date(spark, database)


def test_loaded_entries_are_those_of_old_revisions(spark):
    entries = entry_rows(fx.objects(spark, SF))
    old = (
        fx.table(spark, SF, "orders")
        .where(F.col("o_orderdate") < fx.zoneless(fx.LOADED_UNTIL))
        .select(F.sha2(F.concat(F.lit("rev-"), F.col("o_orderkey").cast("string")), 256).alias("top_hash"))
    )
    moved = F.replace(F.col("physical_key"), F.lit("/parts/"), F.lit("/archive/"))
    expected = entries.join(old, "top_hash", "left_semi").withColumn("physical_key", moved)
    found = fx.loaded_entries(spark, SF)
    assert found.columns == entries.columns
    assert rows(found) == rows(expected.select(*found.columns))


def test_a_bad_view_is_looked_for_once(spark, interpreted, make_database, make_sources, monkeypatch):
    """What the merge of revisions has found out is not tried by halves again for the tags."""
    database = make_database(partitioned=False)
    good = {name: found for r in ("r1", "r2", "r4") for name, found in views(r).items()}
    bad = views("r3") | {"r3_packages-view": [("a/a", "h1", "no number", "m", None)]}
    tried = {}

    def noting(merge):
        def noted(self, target, registries):
            tried.setdefault(target.name, []).append(tuple(sorted(registries)))
            return merge(self, target, registries)

        return noted

    for name in ("merge_revisions", "merge_tags"):
        monkeypatch.setattr(run._Run, name, noting(getattr(run._Run, name)))
    report = consolidate(spark, make_sources(good | bad), database)
    assert [o.registries for o in report.outcomes if o.status == "failed"] == [("r3",)]
    assert len(tried["package_revision"]) == 5
    assert tried["package_tag"] == [("r1", "r2", "r4"), ("r3",)]
