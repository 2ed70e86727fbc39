"""Life cycle of the target tables: create, append, replace, count, drop."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parcelry.operators.merge import pack_hashes, unpack_hashes
from parcelry.schemas import TARGETS, Target, empty_frame
from parcelry.session import delete_folder, list_folder, no_shuffle_files_left, quoted

_SLICE = "__slice"
#: In a partitioned table's folder: its replaced partitions, by version. Spark does not list it.
_VERSIONS = "_versions"
#: What the folder of a version of a plain table has between the table's name and a unique one.
_VERSION = "-version-"


def create_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    """Create the database if it is absent, in a folder of its own if one is given."""
    where = f" LOCATION {sql_text(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(database)}{where}")


def table_name(target: Target, database: str | None) -> str:
    return f"{quoted(database)}.{target.name}" if database else target.name


def key_table_name(target: Target, database: str | None) -> str:
    """The table of the target's keys, if there is one (``plans.keys``)."""
    return f"{table_name(target, database)}_keys"


def sql_text(value: str) -> str:
    """A string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def create_target(
    spark: SparkSession,
    target: Target,
    database: str | None = None,
    partitioned: bool = True,
    file_format: str = "parquet",
) -> None:
    """Create one empty table; a table that exists already is left as it is.

    A Spark table takes one bucket specification, so the first of the target's
    bucket transforms is applied. Files are sorted, which keeps the row-group
    statistics of the lookup columns narrow.
    """
    writer = empty_frame(spark, target.schema).write.format(file_format)
    if file_format == "parquet":
        writer = writer.option("compression", "snappy")
    if partitioned:
        writer = writer.partitionBy(*target.partition_by)
        if target.bucket_by:
            buckets, column = target.bucket_by[0]
            writer = writer.bucketBy(buckets, column).sortBy(*target.sort_by)
    writer.mode("ignore").saveAsTable(table_name(target, database))


def create_targets(
    spark: SparkSession,
    database: str | None = None,
    targets: Sequence[Target] = TARGETS,
    partitioned: bool = True,
    file_format: str = "parquet",
) -> list[str]:
    """Create the absent tables and return the names that could not be created.

    One failure does not stop the others; only when all fail the run cannot go on.
    """
    failed = []
    for target in targets:
        try:
            create_target(spark, target, database, partitioned, file_format)
        except AnalysisException as error:
            failed.append(f"{target.name}: {error.getMessage()}")
    if len(failed) == len(targets):
        raise RuntimeError("no table could be created: " + "; ".join(failed))
    return failed


def drop_targets(
    spark: SparkSession, database: str | None = None, targets: Sequence[Target] = TARGETS
) -> None:
    for target in targets:
        name = table_name(target, database)
        if table_exists(spark, target, database):
            folder = _described(spark, name, "Location")[0]
            spark.sql(f"DROP TABLE {name}")
            _delete_versions(spark, folder, keep=())
        spark.sql(f"DROP TABLE IF EXISTS {key_table_name(target, database)}")


def table_exists(spark: SparkSession, target: Target, database: str | None = None) -> bool:
    """Whether the table exists, from metadata only."""
    return spark.catalog.tableExists(table_name(target, database))


def missing_targets(
    spark: SparkSession, database: str | None = None, targets: Sequence[Target] = TARGETS
) -> list[str]:
    return [t.name for t in targets if not table_exists(spark, t, database)]


def require_targets(
    spark: SparkSession, database: str | None = None, targets: Sequence[Target] = TARGETS
) -> None:
    missing = missing_targets(spark, database, targets)
    if missing:
        raise LookupError("tables not found: " + ", ".join(dict.fromkeys(missing)))


def count_rows(
    spark: SparkSession, database: str | None = None, targets: Sequence[Target] = TARGETS
) -> DataFrame:
    """Number of rows of every table."""
    counts = [
        spark.table(table_name(t, database)).agg(
            F.lit(t.name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")
        )
        for t in targets
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result.select("table_name", "n_rows")


def table_report(
    spark: SparkSession, database: str | None = None, targets: Sequence[Target] = TARGETS
) -> DataFrame:
    """Which tables exist, and how many rows those have."""
    names = spark.createDataFrame(
        [(t.name, table_exists(spark, t, database)) for t in targets],
        "table_name string, present boolean",
    )
    present = [t for t in targets if table_exists(spark, t, database)]
    if not present:
        return names.withColumn("n_rows", F.lit(None).cast("bigint"))
    return names.join(count_rows(spark, database, present), "table_name", "left")


def _described(spark: SparkSession, table: str, *wanted: str) -> list[str]:
    """Values of a detailed description, e.g. the location, of a table or a partition of one."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()
    # A partition's own location stands before that of its table.
    found = {row["col_name"]: row["data_type"] for row in reversed(rows)}
    return [found[name] for name in wanted]


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    """Names of the partition columns, from the table's description."""
    names = [row["col_name"] for row in spark.sql(f"DESCRIBE TABLE {table}").collect()]
    return names[names.index("# col_name") + 1 :] if "# col_name" in names else []


def required(frame: DataFrame, target: Target) -> DataFrame:
    """Fails the job on a NULL in a column that must have a value."""
    columns = []
    for field in target.schema:
        column = F.col(field.name)
        if not field.nullable:
            column = F.coalesce(
                column, F.raise_error(F.lit(f"{target.name}.{field.name} is NULL"))
            )
        columns.append(column.alias(field.name))
    return frame.select(*columns)


def for_writing(
    frame: DataFrame, target: Target, partitions: Sequence[str], few: bool = False
) -> DataFrame:
    """Rows grouped into files along the table's layout.

    Without this every task would write a file into every bucket it has rows
    for. ``rebalance`` brings a bucket's rows together, cuts groups above the
    advisory partition size into several tasks, so that a registry or a
    revision with a third of all rows does not end up in one, and joins small
    groups. A table without partitions takes a file from each task, so there only ``few`` rows are
    brought together, which many tasks may have; many would be shuffled for nothing.
    """
    if not partitions:
        return frame.hint("rebalance", *target.key) if few else frame
    if not target.bucket_by:
        dealt = unpack_hashes(pack_hashes(frame).hint("rebalance", *partitions))
        return dealt.sortWithinPartitions(*partitions, *target.sort_by)
    buckets, column = target.bucket_by[0]
    sliced = frame.withColumn(_SLICE, F.pmod(F.hash(column), F.lit(buckets)))
    dealt = pack_hashes(sliced).hint("rebalance", *partitions, _SLICE).drop(_SLICE)
    return unpack_hashes(dealt)


def append_rows(
    frame: DataFrame, target: Target, database: str | None = None, few: bool = False
) -> int:
    """Append rows to the table, columns matched by name; the number of rows written.

    ``few`` rows are put into few files, whatever number of tasks has them.
    """
    spark = frame.sparkSession
    name = table_name(target, database)
    partitions = partition_columns(spark, name)
    if partitions:
        frame = required(frame, target)
    seen = Observation()
    counted = for_writing(frame, target, partitions, few).observe(
        seen, F.count(F.lit(1)).alias("rows")
    )
    with no_shuffle_files_left(spark):
        counted.select(*spark.table(name).columns).write.insertInto(name)
    return seen.get["rows"]


@contextmanager
def _only_given_partitions(spark: SparkSession) -> Iterator[None]:
    """Overwrites replace only partitions that get rows.

    This must be the session setting: ``insertInto`` drops the writer option of
    the same name and would empty all other partitions.
    """
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def overwrite_partitions(frame: DataFrame, target: Target, database: str | None = None) -> None:
    """Replace the partitions the rows fall into, in place.

    The new files are complete before Spark takes the old ones away, but a failure in between
    leaves partitions without either; ``replace_partitions`` does not. ``frame`` must not read
    the table itself; stage it first.
    """
    spark = frame.sparkSession
    name = table_name(target, database)
    rows = for_writing(required(frame, target), target, partition_columns(spark, name))
    with _only_given_partitions(spark):
        rows.select(*spark.table(name).columns).write.insertInto(name, overwrite=True)


def replace_partitions(frame: DataFrame, target: Target, database: str | None = None) -> None:
    """Replace the partitions the rows fall into, each at once; ``frame`` may read the table.

    The rows are written into a folder of their own, through a table of the same layout that goes
    again. Then the catalog points each partition at its new folder. So a partition holds either
    its old or its new rows, whatever fails and when. The rows that were replaced stay until the
    next replacement, for queries that have begun to read them.
    """
    spark = frame.sparkSession
    name = table_name(target, database)
    partitions = partition_columns(spark, name)
    base = _described(spark, name, "Location")[0].rstrip("/")
    version = uuid.uuid4().hex
    versions = f"{base}/{_VERSIONS}"
    folder = f"{versions}/{version}"
    beside = f"{table_name(target, database)}_{version}"
    rows = for_writing(required(frame, target), target, partitions)
    spark.sql(f"CREATE TABLE {beside} LIKE {name} LOCATION {sql_text(folder)}")
    try:
        rows.select(*spark.table(name).columns).write.insertInto(beside)
        # As many as there are partitions to replace.
        written = spark.table(beside).select(*partitions).distinct().collect()
        specs = [
            ", ".join(f"{quoted(c)} = {sql_text(str(row[c]))}" for c in partitions)
            for row in written
        ]
        news = [_described(spark, f"{beside} PARTITION ({s})", "Location")[0] for s in specs]
        held = {tuple(row) for row in spark.sql(f"SHOW PARTITIONS {name}").collect()}
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {beside}")
        delete_folder(spark, folder)
        raise
    # From here on the folder stays: partitions may be pointed at it already.
    spark.sql(f"DROP TABLE {beside}")
    for spec, new in zip(specs, news):
        place = new.removeprefix(folder)
        if (place.strip("/"),) not in held:
            spark.sql(
                f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION ({spec}) LOCATION {sql_text(new)}"
            )
            continue
        old = _described(spark, f"{name} PARTITION ({spec})", "Location")[0]
        spark.sql(f"ALTER TABLE {name} PARTITION ({spec}) SET LOCATION {sql_text(new)}")
        for root in (base, *(f"{versions}/{v}" for v in list_folder(spark, versions))):
            if f"{root}{place}" not in (old, new):
                _delete_upward(spark, f"{root}{place}", stop=(base, versions))
    spark.catalog.refreshTable(name)


def _delete_upward(spark: SparkSession, folder: str, stop: Sequence[str]) -> None:
    """Delete a folder, and those above it that are empty then."""
    delete_folder(spark, folder)
    above = folder.rpartition("/")[0]
    while above not in stop and not list_folder(spark, above):
        delete_folder(spark, above)
        above = above.rpartition("/")[0]


def compact(
    spark: SparkSession, target: Target, registry: str, database: str | None = None
) -> None:
    """Write the partitions of one registry anew, in few files; each is replaced at once."""
    held = spark.table(table_name(target, database)).where(F.col("registry") == registry)
    replace_partitions(held.select(*target.columns), target, database)


def write_version(frame: DataFrame, target: Target, folder: str, provider: str) -> None:
    """Write rows as a table's files into a folder of their own."""
    for_writing(frame, target, [], few=True).select(*target.columns).write.format(provider).save(folder)


def _delete_versions(spark: SparkSession, folder: str, keep: Sequence[str]) -> None:
    """Delete the folders of a plain table's versions, of which ``folder`` is one, but ``keep``."""
    base = folder.rstrip("/").partition(_VERSION)[0]
    parent, _, own = base.rpartition("/")
    for found in list_folder(spark, parent):
        path = f"{parent}/{found}"
        if (found == own or found.startswith(f"{own}{_VERSION}")) and path not in keep:
            delete_folder(spark, path)


def replace_rows(frame: DataFrame, target: Target, database: str | None = None) -> None:
    """Replace all rows of a table without partitions; ``frame`` may read the table.

    The rows are written beside the table's folder and the table is then pointed at them, so it
    holds either its old or its new rows, whatever fails. The old folder stays until the next
    replacement, for queries that have begun to read it.
    """
    spark = frame.sparkSession
    name = table_name(target, database)
    old, provider = _described(spark, name, "Location", "Provider")
    old = old.rstrip("/")
    new = f"{old.partition(_VERSION)[0]}{_VERSION}{uuid.uuid4().hex}"
    try:
        write_version(frame, target, new, provider)
        spark.sql(f"ALTER TABLE {name} SET LOCATION {sql_text(new)}")
    except Exception:
        delete_folder(spark, new)
        raise
    spark.catalog.refreshTable(name)
    _delete_versions(spark, new, keep=(old, new))
