"""Times the headline operations and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. The source views are
landed as files once, outside the timing; every timed step reads them from there.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import functions as F

from parcelry import consolidate, tag_listing, tag_lookup
from parcelry.operators.merge import new_rows, tags_to_append, upsert_tags
from parcelry.operators.projections import entry_rows, revision_rows, tag_rows
from parcelry.plans.tables import (
    append_rows,
    compact,
    create_target,
    drop_targets,
    table_name,
)
from parcelry.schemas import ENTRY, ENTRY_BY_TOP_HASH, ENTRY_SORTED, REVISION, TAG
from parcelry.session import delete_folder
from parcelry.sources.views import sources_from_frames
from parcelry_checks import fixtures as fx
from parcelry_checks.compare import local_session
from parcelry_checks.queries import drop_databases, new_database, new_folder, one_package

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
# Revisions from here on arrive after the first load: about 1 % of all.
ARRIVES_FROM = datetime(2001, 7, 9, tzinfo=timezone.utc)

timings: dict[str, float] = {}


def timed(name: str, run: Callable[[], object]) -> object:
    started = time.perf_counter()
    result = run()
    timings[name] = round(time.perf_counter() - started, 3)
    return result


def drain(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS)
    landing = new_folder(spark, "landing")
    fx.packages(spark, SF_DIR).write.partitionBy("registry").parquet(f"{landing}/packages")
    fx.objects(spark, SF_DIR).write.partitionBy("registry").parquet(f"{landing}/objects")
    packages = spark.read.parquet(f"{landing}/packages")
    objects = spark.read.parquet(f"{landing}/objects")
    kinds = fx.registry_kinds(spark, SF_DIR)
    registry, package = one_package(spark, SF_DIR)

    # What there was before the last arrivals, again as files.
    limit = int(ARRIVES_FROM.timestamp())
    later = packages.where(F.col("timestamp") != "latest").where(
        F.col("timestamp").try_cast("bigint") >= limit
    )
    hashes = later.select("top_hash").distinct()
    packages.join(hashes, "top_hash", "left_anti").write.parquet(f"{landing}/old-packages")
    objects.join(hashes, "top_hash", "left_anti").write.parquet(f"{landing}/old-objects")
    before = sources_from_frames(
        spark.read.parquet(f"{landing}/old-packages"),
        spark.read.parquet(f"{landing}/old-objects"),
        kinds,
    )
    now = sources_from_frames(packages, objects, kinds)

    database = new_database(spark)
    timed("first_load", lambda: consolidate(spark, before, database))
    timed("increment", lambda: consolidate(spark, now, database))
    timed("rerun", lambda: consolidate(spark, now, database))
    # The same with entries in the layout for small merges.
    small = new_database(spark)
    drop_targets(spark, small, [ENTRY])
    create_target(spark, ENTRY_SORTED, small)
    sorted_targets = (REVISION, TAG, ENTRY_SORTED)
    timed("sorted_first_load", lambda: consolidate(spark, before, small, targets=sorted_targets))
    timed("sorted_increment", lambda: consolidate(spark, now, small, targets=sorted_targets))
    timed("sorted_compact", lambda: compact(spark, ENTRY_SORTED, registry, small))
    entries = spark.table(table_name(ENTRY, database))
    tags = spark.table(table_name(TAG, database))
    revisions = spark.table(table_name(REVISION, database))

    timed("project_entries", lambda: drain(entry_rows(objects)))
    timed(
        "merge_revisions",
        lambda: drain(new_rows(revision_rows(packages), revisions, REVISION.key)),
    )
    timed("merge_entries", lambda: drain(new_rows(entry_rows(objects), entries, ENTRY.key)))
    timed(
        "merge_entries_strict",
        lambda: drain(new_rows(entry_rows(objects), entries, ENTRY.key, null_safe=False)),
    )
    timed("merge_tags_strict", lambda: drain(tags_to_append(tag_rows(packages), tags)))
    timed(
        "upsert_tags",
        lambda: drain(upsert_tags(tag_rows(packages), tags.select(*TAG.columns), revisions)),
    )
    timed("tag_listing", lambda: drain(tag_listing(entries, tags)))

    def listings(prefix: str, held) -> None:
        timed(f"{prefix}_listing", lambda: drain(tag_listing(held, tags, registry, package)))
        timed(f"{prefix}_lookup", lambda: drain(tag_lookup(held, tags, registry, package)))
        timed(
            f"{prefix}_lookup_resolved",
            lambda: drain(tag_lookup(held, tags, registry, package, resolve=True)),
        )

    listings("by_physical_key", entries)
    rows = entry_rows(objects).distinct()
    drop_targets(spark, database, [ENTRY])
    create_target(spark, ENTRY_BY_TOP_HASH, database)
    timed("load_by_top_hash", lambda: append_rows(rows, ENTRY_BY_TOP_HASH, database))
    listings("by_top_hash", spark.table(table_name(ENTRY, database)))

    drop_databases(spark)
    delete_folder(spark, landing)
    print(
        json.dumps(
            {
                "metric": "total time of the headline operations",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    sys.exit(main())
