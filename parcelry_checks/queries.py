"""One check per operator, over whole tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta
from functools import reduce
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.functions import (
    epoch_to_timestamp,
    multihash,
    registry_from_name,
    strip_view_suffix,
)
from parcelry.operators import logs
from parcelry.operators.listing import tag_listing, tag_lookup
from parcelry.operators.merge import (
    changed_tags,
    choose_tags,
    new_rows,
    pack_hashes,
    tags_to_append,
    unpack_hashes,
    upsert_tags,
)
from parcelry.operators.projections import (
    bad_timestamps,
    entry_rows,
    is_revision,
    is_tag,
    revision_rows,
    tag_rows,
)
from parcelry.plans.run import RunReport, consolidate
from parcelry.plans.tables import (
    append_rows,
    compact,
    count_rows,
    create_database,
    create_targets,
    drop_targets,
    table_name,
    table_report,
)
from parcelry.schemas import (
    ENTRY,
    ENTRY_BY_TOP_HASH,
    ENTRY_SORTED,
    OBJECTS_VIEW,
    REVISION,
    TAG,
    TARGETS,
    Target,
)
from parcelry.session import work_folder
from parcelry.sources.discovery import pair_views, select_registries, skipped_views
from parcelry.sources.views import (
    Sources,
    scan_objects,
    scan_packages,
    sources_from_catalog,
    sources_from_frames,
    sources_from_views,
)
from parcelry.streaming import (
    matching_events,
    merge_on_events,
    read_events,
    registries_to_refresh,
    retained,
    routed_events,
    unpack_bus_entries,
)
from parcelry_checks import fixtures as fx

Check = Callable[[SparkSession, str], DataFrame]
_ONE_REGISTRY = "middle-east"
_databases: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def new_database(spark: SparkSession, partitioned: bool = True) -> str:
    """A database of its own in the shared folder, with the three empty tables."""
    name = f"parcelry_{uuid.uuid4().hex}"
    create_database(spark, name, f"{work_folder(spark)}/{name}")
    create_targets(spark, name, partitioned=partitioned)
    _databases.append(name)
    return name


def drop_databases(spark: SparkSession) -> None:
    """Remove what the checks of this process wrote."""
    while _databases:
        spark.sql(f"DROP DATABASE IF EXISTS `{_databases.pop()}` CASCADE")


def loaded_database(
    spark: SparkSession,
    sf_dir: str,
    targets: Sequence[Target] = TARGETS,
    partitioned: bool = True,
) -> str:
    """A database that holds the result of an earlier run."""
    name = new_database(spark, partitioned)
    rows = {
        REVISION.name: lambda: fx.loaded_revisions(spark, sf_dir),
        TAG.name: lambda: fx.loaded_tags(spark, sf_dir),
        ENTRY.name: lambda: fx.loaded_entries(spark, sf_dir),
    }
    for target in targets:
        append_rows(rows[target.name](), target, name)
    return name


def all_sources(spark: SparkSession, sf_dir: str) -> Sources:
    return sources_from_frames(
        fx.packages(spark, sf_dir), fx.objects(spark, sf_dir), fx.registry_kinds(spark, sf_dir)
    )


def read(spark: SparkSession, database: str, target: Target) -> DataFrame:
    return spark.table(table_name(target, database)).select(*target.columns)


def state(spark: SparkSession, database: str) -> DataFrame:
    """The three tables below each other, with a text column for each column of any."""
    frames = [
        read(spark, database, t).select(
            F.lit(t.name).alias("table_name"),
            *[F.col(name).cast("string").alias(name) for name in t.columns],
        )
        for t in TARGETS
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revision_rows(fx.packages(spark, sf_dir))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_rows(fx.packages(spark, sf_dir))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entry_rows(fx.objects(spark, sf_dir))


def _all_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).unionByName(fx.rival_tags(spark, sf_dir))


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose_tags(_all_tags(spark, sf_dir), _revisions(spark, sf_dir))


# --- sources


def registry_from_name_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.qualified_names(spark, sf_dir).select(
        "name",
        registry_from_name(F.col("name"), "packages").alias("from_packages"),
        registry_from_name(F.col("name"), "objects").alias("from_objects"),
    )


def scan_objects_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [c for c in OBJECTS_VIEW.fieldNames() if c != "hash"]
    return scan_objects(fx.objects(spark, sf_dir)).select(
        *columns, F.col("hash.type").alias("hash_type"), F.col("hash.value").alias("hash_value")
    )


def views_by_registry(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every registry's packages view as a view of its own."""
    packages = fx.packages(spark, sf_dir)
    return {
        f"{registry}_packages-view": packages.where(F.col("registry") == registry).drop("registry")
        for registry in fx.registry_kinds(spark, sf_dir)
    }


def union_registries_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources_from_views(spark, views_by_registry(spark, sf_dir)).view("packages")


# --- projections


def multihash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.objects(spark, sf_dir).select(
        F.col("hash.type").alias("hash_type"),
        F.col("hash.value").alias("hash_value"),
        multihash(F.col("hash")).alias("multihash"),
    )


def epoch_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.when(is_revision(), F.col("timestamp"))
    return (
        fx.packages(spark, sf_dir)
        .where(is_revision())
        .select(
            "top_hash",
            seconds.cast("bigint").alias("seconds"),
            epoch_to_timestamp(seconds).alias("created"),
        )
    )


def distinct_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Packed before the union, where Spark sees that both parts are one frame.
    entries = pack_hashes(_entries(spark, sf_dir))
    return unpack_hashes(entries.unionByName(entries).distinct())


# --- merges


def merge_entries_check(spark: SparkSession, sf_dir: str, null_safe: bool) -> DataFrame:
    entries = _entries(spark, sf_dir)
    return new_rows(entries, fx.loaded_entries(spark, sf_dir), ENTRY.key, null_safe)


def upsert_tags_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert_tags(
        _all_tags(spark, sf_dir), fx.loaded_tags(spark, sf_dir), _revisions(spark, sf_dir)
    )


def one_package(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    row = fx.customers(spark, sf_dir).where("c_custkey = 1").first()
    return row["registry"], row["pkg_name"]


def listing_package_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry, package = one_package(spark, sf_dir)
    return tag_listing(_entries(spark, sf_dir), _tags(spark, sf_dir), registry, package)


def tag_lookup_check(
    spark: SparkSession, sf_dir: str, layout: Target = ENTRY, resolve: bool = False
) -> DataFrame:
    registry, package = one_package(spark, sf_dir)
    database = new_database(spark)
    drop_targets(spark, database, [ENTRY])
    create_targets(spark, database, [layout])
    append_rows(_entries(spark, sf_dir), layout, database)
    append_rows(_tags(spark, sf_dir), TAG, database)
    return tag_lookup(
        read(spark, database, ENTRY), read(spark, database, TAG), registry, package, resolve=resolve
    )


def compact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in the layout without buckets, added in two parts, one registry compacted."""
    database = new_database(spark)
    drop_targets(spark, database, [ENTRY])
    create_targets(spark, database, [ENTRY_SORTED])
    entries = _entries(spark, sf_dir)
    early = F.col("logical_key") < "line/3"
    for part in (entries.where(early), entries.where(~early)):
        append_rows(part, ENTRY_SORTED, database)
    compact(spark, ENTRY_SORTED, _ONE_REGISTRY, database)
    return read(spark, database, ENTRY)


# --- tables


def create_partitioned_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = new_database(spark)
    append_rows(_revisions(spark, sf_dir), REVISION, database)
    return read(spark, database, REVISION)


def create_empty_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = new_database(spark, partitioned=False)
    append_rows(_tags(spark, sf_dir), TAG, database)
    return read(spark, database, TAG)


def append_rows_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = loaded_database(spark, sf_dir, [ENTRY], partitioned=False)
    append_rows(merge_entries_check(spark, sf_dir, True), ENTRY, database)
    return read(spark, database, ENTRY)


def _full_database(spark: SparkSession, sf_dir: str, partitioned: bool = True) -> str:
    database = new_database(spark, partitioned)
    append_rows(_revisions(spark, sf_dir), REVISION, database)
    append_rows(_tags(spark, sf_dir), TAG, database)
    append_rows(_entries(spark, sf_dir), ENTRY, database)
    return database


def partition_layout_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per registry, the registry taken from the folder of each file."""
    database = _full_database(spark, sf_dir)
    folder = F.regexp_extract("_metadata.file_path", "/registry=([^/]+)/", 1)
    frames = [
        spark.table(table_name(t, database))
        .groupBy(F.lit(t.name).alias("table_name"), folder.alias("registry"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        for t in TARGETS
    ]
    return reduce(DataFrame.unionByName, frames)


def count_probe_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(spark, _full_database(spark, sf_dir, partitioned=False))


def missing_tables_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = _full_database(spark, sf_dir, partitioned=False)
    drop_targets(spark, database, [TAG])
    return table_report(spark, database).fillna(0, "n_rows")


# --- whole runs


def consolidate_all_check(spark: SparkSession, sf_dir: str, isolate: bool = False) -> DataFrame:
    database = loaded_database(spark, sf_dir, partitioned=not isolate)
    consolidate(spark, all_sources(spark, sf_dir), database, isolate=isolate)
    return state(spark, database)


def consolidate_shuffled_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As at scale, where the new keys are too many to be broadcast."""
    database = loaded_database(spark, sf_dir, partitioned=False)
    consolidate(spark, all_sources(spark, sf_dir), database, broadcast_bytes=0)
    return state(spark, database)


def consolidate_discovered_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From views that are found in the catalog by their names."""
    made = []
    for kind, frame in (("packages", fx.packages(spark, sf_dir)), ("objects", fx.objects(spark, sf_dir))):
        for registry in fx.registry_kinds(spark, sf_dir):
            own = frame.where(F.col("registry") == registry).drop("registry")
            made.append(f"{registry}_{kind}-view")
            own.createOrReplaceTempView(f"`{made[-1]}`")
    database = loaded_database(spark, sf_dir, partitioned=False)
    try:
        consolidate(spark, sources_from_catalog(spark), database)
    finally:
        for name in made:
            spark.catalog.dropTempView(name)
    return state(spark, database)


def _failing_sources(spark: SparkSession, sf_dir: str) -> Sources:
    """One registry's packages cannot be read."""
    broken = F.col("registry") == _ONE_REGISTRY
    packages = fx.packages(spark, sf_dir).withColumn(
        "top_hash", F.when(broken, F.raise_error(F.lit("lost file"))).otherwise(F.col("top_hash"))
    )
    return sources_from_frames(
        packages, fx.objects(spark, sf_dir), fx.registry_kinds(spark, sf_dir)
    )


def consolidate_bad_registry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows written for each target and registry, and whether the job failed."""
    database = loaded_database(spark, sf_dir, partitioned=False)
    report = consolidate(spark, _failing_sources(spark, sf_dir), database)
    status = spark.createDataFrame(
        [(o.target, r, o.status) for o in report.outcomes for r in o.registries],
        "table_name string, registry string, status string",
    )
    held = state(spark, database).groupBy("table_name", "registry").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return status.join(held, ["table_name", "registry"])


def consolidate_after_failure_check(
    spark: SparkSession, sf_dir: str, partitioned: bool = False
) -> DataFrame:
    """A run in which a registry fails, and the same run once more when it can be read."""
    database = loaded_database(spark, sf_dir, partitioned=partitioned)
    consolidate(spark, _failing_sources(spark, sf_dir), database)
    consolidate(spark, all_sources(spark, sf_dir), database)
    return state(spark, database)


def consolidate_strict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs that compare keys by plain equality."""
    database = loaded_database(spark, sf_dir, partitioned=False)
    for _ in range(2):
        consolidate(spark, all_sources(spark, sf_dir), database, strict=True)
    return state(spark, database)


def consolidate_one_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = loaded_database(spark, sf_dir)
    consolidate(spark, all_sources(spark, sf_dir), database, [_ONE_REGISTRY])
    return state(spark, database)


def consolidate_rerun_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = loaded_database(spark, sf_dir, partitioned=False)
    sources = all_sources(spark, sf_dir)
    first = consolidate(spark, sources, database)
    second = consolidate(spark, sources, database)
    return spark.createDataFrame(
        [(t.name, first.rows(t.name), second.rows(t.name)) for t in TARGETS],
        "table_name string, first_run bigint, second_run bigint",
    )


def run_summary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run in which one registry has no objects view."""
    kinds = fx.registry_kinds(spark, sf_dir) | {_ONE_REGISTRY: ("packages",)}
    sources = sources_from_frames(
        fx.packages(spark, sf_dir), fx.objects(spark, sf_dir), kinds
    )
    summary = consolidate(spark, sources, new_database(spark, False)).summary()
    return spark.createDataFrame(
        [tuple(summary.values())],
        "num_tables bigint, successful_tables bigint, failed_tables bigint, "
        "skipped_tables bigint, total_queries bigint",
    )


# --- events


def _matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching_events(fx.events(spark, sf_dir), fx.EVENT_SOURCE)


def event_filter_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matching(spark, sf_dir).select(
        "id",
        F.col("detail-type").alias("detail_type"),
        "time",
        "detail.type",
        "detail.bucket",
        "detail.handle",
        F.col("detail.topHash").alias("top_hash"),
    )


def event_registries_check(spark: SparkSession, sf_dir: str, named: bool) -> DataFrame:
    events = _matching(spark, sf_dir)
    if named:
        events = events.where(F.col("detail.bucket").isNotNull())
    return registries_to_refresh(events, fx.customers(spark, sf_dir))


def dead_letter_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routed_events(_matching(spark, sf_dir), fx.EVENTS_ASOF)
    return routed.select("id", "time", "route", "reason")


def retained_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As if every event had become a dead letter when it was sent."""
    sent = F.to_timestamp_ntz("time", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    letters = _matching(spark, sf_dir).withColumn("dead_at", sent)
    return retained(letters, fx.EVENTS_ASOF).select("id", "time")


def run_stream(
    spark: SparkSession,
    sf_dir: str,
    events: DataFrame | None = None,
    load: Callable[[SparkSession, str], Sources] = all_sources,
    deliveries: int = 1,
    starts: Sequence[datetime] = (fx.EVENTS_ASOF,),
    **options,
) -> tuple[str, str]:
    """Run the event-driven merge to its end, once for each of ``starts``; the database and the
    dead-letter folder. Every event comes ``deliveries`` times, each in a micro-batch of its own."""
    inbox, letters = new_folder(spark, "events"), new_folder(spark, "dead-letters")
    events = fx.events(spark, sf_dir) if events is None else events
    for _ in range(deliveries):
        (events.coalesce(1) if deliveries > 1 else events).write.mode("append").json(inbox)
    database = loaded_database(spark, sf_dir, partitioned=False)
    checkpoint = new_folder(spark, "stream")
    for start in starts:
        query = merge_on_events(
            read_events(spark, inbox, files_per_batch=1 if deliveries > 1 else None),
            lambda session: load(session, sf_dir),
            event_source=fx.EVENT_SOURCE,
            database=database,
            dead_letters=letters,
            checkpoint=checkpoint,
            now=lambda at=start: at,
            **options,
        )
        query.awaitTermination()
    return database, letters


def stream_merge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state(spark, run_stream(spark, sf_dir)[0])


def stream_merge_named_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only events that name a registry, so the one that none names stays as it was."""
    events = fx.events(spark, sf_dir).where(F.col("detail.bucket").isNotNull())
    return state(spark, run_stream(spark, sf_dir, events)[0])


def stream_retries_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry fails in every attempt."""
    letters = run_stream(
        spark, sf_dir, load=_failing_sources, retries=1, retry_delay=timedelta(0)
    )[1]
    return spark.read.parquet(letters).select("id", "time", "detail.bucket", "reason")


def stream_dead_letters_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = spark.read.parquet(run_stream(spark, sf_dir)[1])
    return letters.select("id", "time", "detail.bucket", "reason")


def _refreshed(reports: list[tuple[int, RunReport]]) -> Counter:
    """How often each registry was merged."""
    merged = ({r for o in report.outcomes for r in o.registries} for _, report in reports)
    return Counter(chain.from_iterable(merged))


def stream_redelivered_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event in three micro-batches: how often each registry was refreshed."""
    reports: list[tuple[int, RunReport]] = []
    run_stream(spark, sf_dir, deliveries=3, on_report=lambda *report: reports.append(report))
    return spark.createDataFrame(
        list(_refreshed(reports).items()), "registry string, refreshed bigint"
    )


def stream_retries_later_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry cannot be read in the first two attempts, minutes apart, but in the third:
    attempts, dead letters but for expired events, and revisions by registry."""
    reports: list[tuple[int, RunReport]] = []

    def load(session: SparkSession, folder: str) -> Sources:
        return (_failing_sources if len(reports) < 2 else all_sources)(session, folder)

    later = [fx.EVENTS_ASOF + timedelta(minutes=m) for m in (0, 1, 2, 3)]
    database, letters = run_stream(
        spark, sf_dir, load=load, starts=later, on_report=lambda *report: reports.append(report)
    )
    died = spark.read.parquet(letters).where("reason <> 'expired'").agg(
        F.count(F.lit(1)).alias("letters")
    )
    attempts = spark.createDataFrame(
        list(_refreshed(reports).items()), "registry string, attempts bigint"
    )
    held = read(spark, database, REVISION).groupBy("registry").agg(
        F.count(F.lit(1)).alias("n_revisions")
    )
    return attempts.join(held, "registry").join(F.broadcast(died), how="left")


def event_put_form_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they are sent, with the detail as text and without a time, arriving when the
    delivered ones were sent."""
    sent = fx.events(spark, sf_dir).select(
        F.col("source").alias("Source"),
        F.col("detail-type").alias("DetailType"),
        F.to_json("detail").alias("Detail"),
        F.lit("default").alias("EventBusName"),
        "time",
    )
    return state(spark, run_stream(spark, sf_dir, unpack_bus_entries(sent, F.col("time").cast("timestamp")))[0])


# --- log triage


def _log_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.recent(fx.log_lines(spark, sf_dir), fx.LOG_ASOF, fx.LOG_MINUTES)


def queries() -> dict[str, Check]:
    return {
        "select_registries": lambda s, d: select_registries(fx.view_names(s, d)),
        "select_registry_target": lambda s, d: select_registries(
            fx.view_names(s, d), "customer-000000007"
        ),
        "skipped_views": lambda s, d: skipped_views(fx.view_names(s, d), "customer-000000007"),
        "pair_views": lambda s, d: pair_views(fx.view_names(s, d)),
        "registry_from_name": registry_from_name_check,
        "strip_view_suffix": lambda s, d: fx.view_names(s, d).select(
            "name", strip_view_suffix(F.col("name")).alias("stripped")
        ),
        "scan_packages": lambda s, d: scan_packages(fx.packages(s, d)),
        "scan_objects": scan_objects_check,
        "union_registries": union_registries_check,
        "project_revisions": _revisions,
        "project_tags": _tags,
        "project_entries": _entries,
        "epoch_to_timestamp": epoch_check,
        "filter_revisions": lambda s, d: fx.packages(s, d).where(is_revision()),
        "filter_tags": lambda s, d: fx.packages(s, d).where(is_tag()),
        "multihash": multihash_check,
        "quarantine_timestamps": lambda s, d: bad_timestamps(fx.broken_packages(s, d)),
        "quarantine_revisions": lambda s, d: revision_rows(
            fx.broken_packages(s, d), on_bad="quarantine"
        ),
        "distinct_rows": distinct_check,
        "merge_revisions": lambda s, d: new_rows(
            _revisions(s, d), fx.loaded_revisions(s, d), REVISION.key
        ),
        "merge_entries": lambda s, d: merge_entries_check(s, d, True),
        "merge_entries_strict": lambda s, d: merge_entries_check(s, d, False),
        "merge_tags_strict": lambda s, d: tags_to_append(_tags(s, d), fx.loaded_tags(s, d)),
        "choose_tags": _chosen,
        "changed_tags": lambda s, d: changed_tags(_chosen(s, d), fx.loaded_tags(s, d)),
        "upsert_tags": upsert_tags_check,
        "tag_listing": lambda s, d: tag_listing(_entries(s, d), _tags(s, d)),
        "tag_listing_package": listing_package_check,
        "tag_lookup": tag_lookup_check,
        "tag_lookup_resolved": lambda s, d: tag_lookup_check(s, d, ENTRY_BY_TOP_HASH, True),
        "compact_entries": compact_check,
        "create_partitioned": create_partitioned_check,
        "create_empty": create_empty_check,
        "append_rows": append_rows_check,
        "partition_layout": partition_layout_check,
        "count_probe": count_probe_check,
        "missing_tables": missing_tables_check,
        "consolidate_all": consolidate_all_check,
        "consolidate_isolated": lambda s, d: consolidate_all_check(s, d, isolate=True),
        "consolidate_shuffled": consolidate_shuffled_check,
        "consolidate_discovered": consolidate_discovered_check,
        "consolidate_bad_registry": consolidate_bad_registry_check,
        "consolidate_after_failure": consolidate_after_failure_check,
        "consolidate_after_failure_partitioned": lambda s, d: consolidate_after_failure_check(
            s, d, partitioned=True
        ),
        "consolidate_strict": consolidate_strict_check,
        "consolidate_one": consolidate_one_check,
        "consolidate_rerun": consolidate_rerun_check,
        "run_summary": run_summary_check,
        "event_filter": event_filter_check,
        "event_registries": lambda s, d: event_registries_check(s, d, False),
        "event_registries_named": lambda s, d: event_registries_check(s, d, True),
        "dead_letter_split": dead_letter_check,
        "dead_letters_retained": retained_check,
        "stream_merge": stream_merge_check,
        "stream_merge_named": stream_merge_named_check,
        "stream_retries": stream_retries_check,
        "stream_dead_letters": stream_dead_letters_check,
        "stream_redelivered": stream_redelivered_check,
        "stream_retries_later": stream_retries_later_check,
        "event_put_form": event_put_form_check,
        "log_recent": _log_window,
        "log_severity": lambda s, d: logs.with_severity(fx.log_lines(s, d)),
        "log_pattern": lambda s, d: logs.containing(_log_window(s, d), "bucket"),
        "log_error_count": lambda s, d: logs.error_count(_log_window(s, d)),
    }
