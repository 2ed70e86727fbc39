from dataclasses import replace
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parcelry.plans import tables
from parcelry.plans.tables import (
    append_rows,
    count_rows,
    create_database,
    create_target,
    create_targets,
    drop_targets,
    missing_targets,
    overwrite_partitions,
    replace_partitions,
    replace_rows,
    partition_columns,
    require_targets,
    table_exists,
    table_name,
    table_report,
)
from parcelry.schemas import ENTRY, ENTRY_BY_TOP_HASH, REVISION, TAG, TARGETS, Target, table_schema
from parcelry.session import Staging, work_folder
from tests.conftest import rows

TAGS = "registry string, pkg_name string, tag_name string, top_hash string"


def tag_frame(spark, values):
    return spark.createDataFrame([(r, p, "latest", h) for r, p, h in values], TAGS)


def table_files(spark, database, target):
    table = spark.table(table_name(target, database))
    return {r[0] for r in table.select("_metadata.file_path").distinct().collect()}


def test_create_is_repeatable(spark, make_database):
    database = make_database()
    append_rows(tag_frame(spark, [("r", "a", "h")]), TAG, database)
    assert create_targets(spark, database) == []
    assert spark.table(table_name(TAG, database)).count() == 1
    create_database(spark, database)
    assert spark.catalog.databaseExists(database)


def test_create_reports_failures_and_stops_only_if_all_fail(spark, make_database):
    database = make_database(targets=[])
    broken = replace(TAG, name="not-a-name")
    failed = create_targets(spark, database, [broken, REVISION])
    assert len(failed) == 1 and failed[0].startswith("not-a-name")
    assert table_exists(spark, REVISION, database)
    with pytest.raises(RuntimeError, match="no table could be created"):
        create_targets(spark, "no_such_database")


def test_exists_missing_and_drop(spark, make_database):
    database = make_database()
    assert missing_targets(spark, database) == []
    drop_targets(spark, database, [TAG])
    drop_targets(spark, database, [TAG])
    assert not table_exists(spark, TAG, database)
    assert missing_targets(spark, database) == ["package_tag"]
    with pytest.raises(LookupError, match="package_tag"):
        require_targets(spark, database)
    report = {r["table_name"]: (r["present"], r["n_rows"]) for r in table_report(spark, database).collect()}
    assert report == {
        "package_revision": (True, 0),
        "package_tag": (False, None),
        "package_entry": (True, 0),
    }
    drop_targets(spark, database)
    assert missing_targets(spark, database) == [t.name for t in TARGETS]
    assert [r["n_rows"] for r in table_report(spark, database).collect()] == [None] * 3


@pytest.mark.parametrize("partitioned", [True, False])
def test_columns_and_partitions(spark, make_database, partitioned):
    database = make_database(partitioned)
    for target in TARGETS:
        name = table_name(target, database)
        schema = {f.name: f.dataType for f in spark.table(name).schema}
        assert schema == {f.name: f.dataType for f in target.schema}
        expected = list(target.partition_by) if partitioned else []
        assert partition_columns(spark, name) == expected


def test_append_matches_columns_by_name(spark, make_database):
    for partitioned in (True, False):
        database = make_database(partitioned)
        frame = tag_frame(spark, [("r", "a", "h"), ("s", "b", "i")])
        shuffled = frame.select("top_hash", "tag_name", "registry", "pkg_name")
        assert append_rows(shuffled, TAG, database) == 2
        held = spark.table(table_name(TAG, database)).select(*TAG.columns)
        assert rows(held) == [("r", "a", "latest", "h"), ("s", "b", "latest", "i")]
        assert rows(count_rows(spark, database, [TAG])) == [("package_tag", 2)]


def test_required_columns(spark, make_database):
    frame = tag_frame(spark, [("r", None, "h")])
    with pytest.raises(Exception, match="package_tag.pkg_name is NULL"):
        append_rows(frame, TAG, make_database())
    assert append_rows(frame, TAG, make_database(partitioned=False)) == 1


def test_overwrite_leaves_other_partitions(spark, make_database):
    database = make_database()
    append_rows(tag_frame(spark, [("r", "a", "1"), ("r", "b", "1"), ("s", "a", "1")]), TAG, database)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    overwrite_partitions(tag_frame(spark, [("r", "a", "2")]), TAG, database)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    held = spark.table(table_name(TAG, database)).select(*TAG.columns)
    assert rows(held) == [("r", "a", "latest", "2"), ("s", "a", "latest", "1")]


def test_replacing_a_table_switches_its_folder(spark, make_database, monkeypatch):
    database = make_database(partitioned=False)
    append_rows(tag_frame(spark, [("r", "a", "1"), ("r", "b", "1")]), TAG, database)
    name = table_name(TAG, database)
    held = spark.table(name).select(*TAG.columns)
    replace_rows(held.where("pkg_name = 'a'"), TAG, database)
    assert rows(spark.table(name).select(*TAG.columns)) == [("r", "a", "latest", "1")]

    def fail_late(frame, target, folder, provider):
        frame.write.parquet(folder)
        raise PySparkException("no space left")

    monkeypatch.setattr(tables, "write_version", fail_late)
    with pytest.raises(PySparkException, match="no space"):
        replace_rows(tag_frame(spark, [("r", "a", "2")]), TAG, database)
    assert rows(spark.table(name).select(*TAG.columns)) == [("r", "a", "latest", "1")]
    append_rows(tag_frame(spark, [("r", "c", "3")]), TAG, database)
    assert spark.table(name).count() == 2


def test_replacing_partitions_switches_their_folders(spark, make_database):
    database = make_database()
    names = ["r", "it's/x", "s p%25"]
    append_rows(tag_frame(spark, [(r, "a", "1") for r in names]), TAG, database)
    name = table_name(TAG, database)
    read = lambda: rows(spark.table(name).select(*TAG.columns))
    for step in ("2", "3", "4"):
        held = spark.table(name).select(*TAG.columns).where("registry <> 'r'")
        new = tag_frame(spark, [(f"n{step}", "a", "1")])
        replace_partitions(held.withColumn("top_hash", F.lit(step)).unionAll(new), TAG, database)
    expected = [("it's/x", "4"), ("n2", "4"), ("n3", "4"), ("n4", "1"), ("r", "1"), ("s p%25", "4")]
    assert [(r[0], r[3]) for r in read()] == expected
    # Rows that are appended go where the partition is now.
    append_rows(tag_frame(spark, [("it's/x", "b", "5")]), TAG, database)
    assert ("it's/x", "b", "latest", "5") in read() and len(read()) == 7
    replaced = [f for f in table_files(spark, database, TAG) if "registry=it" in f]
    assert len(replaced) == 2
    # On disk is the version before as well, and no older one.
    folder = Path(tables._described(spark, name, "Location")[0].removeprefix("file:"))
    kept = {f.parent for f in folder.rglob("*.parquet") if "registry=it" in str(f)}
    assert len(kept) == 2
    drop_targets(spark, database, [TAG])
    assert not folder.exists()


def test_a_query_outlives_one_replacement(spark, make_database):
    for partitioned in (True, False):
        database = make_database(partitioned)
        append_rows(tag_frame(spark, [("r", "a", "1")]), TAG, database)
        begun = spark.read.parquet(*table_files(spark, database, TAG))
        replace = replace_partitions if partitioned else replace_rows
        replace(tag_frame(spark, [("r", "a", "2")]), TAG, database)
        assert begun.count() == 1
        assert [r[3] for r in rows(spark.table(table_name(TAG, database)).select(*TAG.columns))] == ["2"]
        replace(tag_frame(spark, [("r", "a", "3")]), TAG, database)
        with pytest.raises(Exception, match="FILE_NOT_EXIST|FileNotFound|does not exist"):
            begun.collect()


def entries(spark, count, hot=0):
    """``count`` entries with a physical key each, and ``hot`` that share one."""
    return spark.range(count + hot).select(
        F.lit("r").alias("registry"),
        F.sha2(F.col("id").cast("string"), 256).alias("top_hash"),
        F.concat(F.lit("l"), F.col("id")).alias("logical_key"),
        F.when(F.col("id") < count, F.concat(F.lit("p"), F.col("id")))
        .otherwise("everyone's file")
        .alias("physical_key"),
        F.lit("v").alias("multihash"),
        F.col("id").alias("size"),
        F.lit(None).cast("string").alias("metadata"),
    )


def test_a_bucket_goes_into_one_file_and_is_sorted(spark, make_database):
    database = make_database(targets=[ENTRY])
    append_rows(entries(spark, 3000), ENTRY, database)
    files = table_files(spark, database, ENTRY)
    assert len(files) == 64
    table = spark.table(table_name(ENTRY, database))
    bucket = F.pmod(F.hash("physical_key"), F.lit(64))
    per_file = table.groupBy("_metadata.file_path").agg(F.countDistinct(bucket).alias("n"))
    assert {r["n"] for r in per_file.collect()} == {1}
    one = spark.read.parquet(sorted(files)[0])
    hashes = [r["top_hash"] for r in one.collect()]
    assert hashes == sorted(hashes) and hashes


def test_a_hot_bucket_is_cut_into_several_tasks(spark, make_database):
    """A third of all rows in one bucket: written whole, but not by one task."""
    small = replace(ENTRY, bucket_by=((4, "physical_key"),))
    database = make_database(targets=[small])
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "256k")
    try:
        count = append_rows(entries(spark, 40000, hot=20000).repartition(8), small, database)
    finally:
        spark.conf.set(setting, before)
    assert count == 60000
    table = spark.table(table_name(small, database))
    assert table.count() == 60000
    hot = table.where(F.col("physical_key") == "everyone's file")
    assert hot.select("_metadata.file_path").distinct().count() > 2


def test_a_lookup_opens_one_bucket(spark, make_database):
    """With the files of all other buckets gone, a lookup by hash still works."""
    database = make_database(targets=[ENTRY_BY_TOP_HASH])
    append_rows(entries(spark, 200), ENTRY_BY_TOP_HASH, database)
    table = spark.table(table_name(ENTRY, database))
    row = table.select("top_hash", "_metadata.file_path").first()
    for file in table_files(spark, database, ENTRY) - {row["file_path"]}:
        Path("/" + file.removeprefix("file:").lstrip("/")).unlink()
    assert table.where(F.col("top_hash") == row["top_hash"]).count() == 1
    with pytest.raises(Exception, match="FILE_NOT_EXIST|FileNotFound|does not exist"):
        table.where(F.col("top_hash") != row["top_hash"]).collect()


def test_other_formats(spark, make_database):
    database = make_database(targets=[])
    table = Target("plain", "packages", table_schema({"registry": "STRING", "n": "INT"}),
                   ("registry",), (), ())
    create_target(spark, table, database, partitioned=False, file_format="orc")
    frame = spark.createDataFrame([("r", 1)], "registry string, n int")
    assert append_rows(frame, table, database) == 1
    assert rows(spark.table(f"{database}.plain")) == [("r", 1)]


def test_staging(spark):
    with Staging(spark) as staging:
        folder = Path(staging.folder.removeprefix("file:"))
        staged = staging.write(spark.createDataFrame([("ab", 1), (None, 2)], "a string, b int"))
        assert staged.rows == 2 and staged.bytes == 2 + 8 + 8
        assert folder.exists()
        assert rows(staged.frame) == [(None, 2), ("ab", 1)]
        assert staging.write(spark.range(0)).rows == 0
    assert not folder.exists()
    assert staging.folder.startswith(work_folder(spark))


def test_timestamps_have_no_zone(spark, make_database):
    database = make_database()
    moment = datetime(2020, 5, 1, 3, 4, 5)
    frame = spark.createDataFrame(
        [("r", "a", "h", moment, "m", None)],
        "registry string, pkg_name string, top_hash string, timestamp timestamp_ntz, "
        "message string, metadata string",
    )
    append_rows(frame, REVISION, database)
    held = spark.table(table_name(REVISION, database))
    assert dict(held.dtypes)["timestamp"] == "timestamp_ntz"
    assert held.first()["timestamp"] == moment
