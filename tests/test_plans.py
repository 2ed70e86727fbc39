"""The physical plans: what is read, what is shuffled, and that nothing is paired freely."""

import re

import pytest
from pyspark.sql import functions as F

from parcelry.operators import (
    changed_tags,
    choose_tags,
    entry_rows,
    new_rows,
    revision_rows,
    tag_listing,
    tag_lookup,
    tag_rows,
    tags_to_append,
    upsert_tags,
)
from parcelry.operators.merge import new_keys, rows_with_key
from parcelry.plans.tables import append_rows, table_name
from parcelry.schemas import ENTRY, REVISION, TAG, TARGETS
from parcelry.session import work_folder
from parcelry_checks import fixtures as fx
from parcelry_checks.queries import new_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames(spark):
    """Landed views and targets, as files, so that the scans show in the plans."""
    folder = new_folder(spark, "plans")
    packages, objects = fx.packages(spark, SF), fx.objects(spark, SF)
    contents = {
        "packages": packages,
        "objects": objects,
        REVISION.name: revision_rows(packages),
        TAG.name: tag_rows(packages),
        ENTRY.name: entry_rows(objects),
    }
    read = {}
    for name, frame in contents.items():
        frame.write.partitionBy("registry").parquet(f"{folder}/{name}")
        read[name] = spark.read.parquet(f"{folder}/{name}")
    for target in TARGETS:
        read[target.name] = read[target.name].select(*target.columns)
    return read


@pytest.fixture
def large(spark):
    """Plans as for tables that are too large to broadcast."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    yield
    spark.conf.set(setting, before)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(frames):
    text = plan(tag_rows(frames["packages"]))
    assert "EqualTo(timestamp,latest)" in text
    assert "ReadSchema: struct<pkg_name:string,top_hash:string,timestamp:string>" in text
    text = plan(revision_rows(frames["packages"]))
    assert "Not(EqualTo(timestamp,latest))" in text


def test_unused_columns_are_not_read(frames):
    text = plan(new_keys(entry_rows(frames["objects"]), frames["package_entry"], ENTRY.key))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", text)
    assert schemas == [
        "top_hash:string,logical_key:string,meta:string",
        "top_hash:string,logical_key:string,metadata:string",
    ]


def test_registry_prunes_partitions(frames):
    wanted = frames["package_entry"].where(F.col("registry").isin("asia", "europe"))
    text = plan(new_rows(entry_rows(frames["objects"]), wanted, ENTRY.key))
    assert re.search(r"PartitionFilters: \[[^\]]*registry#\d+ IN \(asia,europe\)", text)


def test_keys_are_shuffled_once_on_each_side(frames, large):
    keys = new_keys(entry_rows(frames["objects"]), frames["package_entry"], ENTRY.key)
    text = plan(keys)
    assert "SortMergeJoin" in text and "LeftAnti" in text
    assert text.count("Exchange hashpartitioning") == 2
    # Copies are dropped before the shuffle: two aggregates around each.
    assert text.count("HashAggregate") == 4 and "ObjectHashAggregate" not in text


def test_both_sides_of_new_rows_are_shuffled_for_the_join(frames, large):
    """By the key, which lets Spark see a skew; only what is new moves again, to drop copies."""
    new = new_rows(entry_rows(frames["objects"]), frames["package_entry"], ENTRY.key)
    assert plan(new).count("Exchange hashpartitioning") == 4
    assert plan(new).count("Exchange hashpartitioning(__hash") == 2


@pytest.fixture
def skewed(spark, large):
    """Limits so low that a key with a third of a small table counts as skewed."""
    limits = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name, None) for name in limits}
    for name, value in limits.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def hot_entries(spark):
    """30,000 entries with a key each, and 15,000 that share one but differ in place."""
    number = F.col("id").cast("string")
    return spark.range(45000).repartition(8).select(
        F.lit("r").alias("registry"),
        F.when(F.col("id") < 15000, "hot").otherwise(F.sha2(number, 256)).alias("top_hash"),
        F.lit("README").alias("logical_key"),
        F.sha2(F.concat(F.lit("p"), number), 512).alias("physical_key"),
        F.lit("v").alias("multihash"),
        F.col("id").alias("size"),
        F.lit(None).cast("string").alias("metadata"),
    )


def test_a_hot_key_is_cut_into_several_tasks(spark, skewed):
    spark.sparkContext.setCheckpointDir(work_folder(spark))
    entries = hot_entries(spark)
    half = entries.where(F.col("size") >= 30000)
    for join, expected in (
        (new_rows(entries, half, ENTRY.key), 30000),
        (
            rows_with_key(
                entries, new_keys(entries, half, ENTRY.key).checkpoint(), ENTRY.key
            ).distinct(),
            30000,
        ),
        (
            tag_listing(
                entries,
                spark.createDataFrame(
                    [("r", "p", "latest", "hot")],
                    "registry string, pkg_name string, tag_name string, top_hash string",
                ),
            ),
            15000,
        ),
    ):
        assert len(join.collect()) == expected
        assert "skew=true" in join._jdf.queryExecution().executedPlan().toString()


def test_known_rows_are_dropped_before_any_shuffle(spark, frames):
    keys = frames["package_entry"].limit(1)
    keys = new_keys(keys, spark.createDataFrame([], ENTRY.schema), ENTRY.key)
    text = plan(rows_with_key(entry_rows(frames["objects"]), F.broadcast(keys), ENTRY.key))
    above_scan = text.split("FileScan")[0]
    assert "BroadcastHashJoin" in above_scan and "LeftSemi" in above_scan
    assert "hashpartitioning" not in above_scan


def test_nothing_is_paired_freely(frames, large):
    tags, revisions = tag_rows(frames["packages"]), frames["package_revision"]
    target = frames["package_tag"]
    for frame in (
        tags_to_append(tags, target),
        choose_tags(tags, revisions),
        changed_tags(choose_tags(tags, revisions), target),
        upsert_tags(tags, target, revisions),
        tag_listing(frames["package_entry"], target),
        new_rows(revision_rows(frames["packages"]), revisions, REVISION.key),
    ):
        text = plan(frame)
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
        assert "PythonUDF" not in text and "Window" not in text


def test_listing_prunes_both_sides(frames):
    text = plan(tag_listing(frames["package_entry"], frames["package_tag"], "asia", "p"))
    assert len(re.findall(r"registry#\d+ = asia", text)) >= 2
    assert "EqualTo(pkg_name,p)" in text


def test_listing_spreads_files_of_one_size(frames):
    text = plan(tag_listing(frames["package_entry"], frames["package_tag"]))
    assert re.search(r"rangepartitioning\(size#\d+L? ASC NULLS LAST, logical_key", text)


def test_lookup_pushes_the_hash_into_the_scan(frames):
    text = plan(tag_lookup(frames["package_entry"], frames["package_tag"], "asia", "p"))
    assert "EqualTo(top_hash,ScalarSubquery" in text
    assert "Join" not in text


def test_projections_stay_in_generated_code(spark, frames):
    frame = entry_rows(frames["objects"])
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert re.match(r"\*\(1\) Project", text)


def test_append_groups_rows_by_bucket(make_database, spark, frames):
    database = make_database()
    count = append_rows(frames["package_tag"], TAG, database)
    assert spark.table(table_name(TAG, database)).count() == count
