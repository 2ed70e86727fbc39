"""Merge the source views of all registries, or some, into the three tables.

One job per target covers all registries of a group. A group that fails for its
data is repeated by halves, so one bad source fails alone and does not hold up the
others. Any other failure, such as a full disk, fails the group as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.functions.columns import LATEST
from parcelry.operators.merge import (
    DIGEST,
    changed_tags,
    choose_tags,
    distinct_rows,
    replace_tags,
    rows_with_key,
    rows_without_key,
    tags_to_append,
)
from parcelry.operators.projections import entry_rows, revision_rows, tag_rows
from parcelry.plans.keys import (
    SEVERAL,
    append_digests,
    delivered_keys,
    digests_with_counts,
    rebuild,
    row_counts,
    unknown_keys,
    unpacked,
)
from parcelry.plans.tables import (
    append_rows,
    partition_columns,
    replace_partitions,
    replace_rows,
    require_targets,
    table_name,
)
from parcelry.schemas import REVISION, TAG, TARGETS, Target
from parcelry.session import Staging, no_shuffle_files_left
from parcelry.sources.views import Sources

# New keys are broadcast up to this uncompressed size; above it they are joined by shuffle.
BROADCAST_BYTES = 32 * 1024 * 1024
_KEY_BYTES = 64  # of a digest, as a row


#: What the message of an error holds that comes from the data of some registry.
DATA_ERRORS = (
    "CAST_INVALID_INPUT",
    "USER_RAISED_EXCEPTION",
    "FAILED_READ_FILE",
    "PATH_NOT_FOUND",
    "UNRESOLVED_COLUMN",
    "FIELD_NOT_FOUND",
    "TABLE_OR_VIEW_NOT_FOUND",
    "FileNotFoundException",
    " is NULL",
)


@dataclass(frozen=True)
class Outcome:
    """Result of one job: the registries it covered and the rows it wrote."""

    target: str
    registries: tuple[str, ...]
    status: str  # "ok", "failed" or "skipped"
    rows: int = 0
    error: str | None = None


@dataclass
class RunReport:
    registries: int = 0
    outcomes: list[Outcome] = field(default_factory=list)

    def _pairs(self, status: str) -> int:
        return sum(len(o.registries) for o in self.outcomes if o.status == status)

    @property
    def successful(self) -> int:
        return self._pairs("ok")

    @property
    def failed(self) -> int:
        return self._pairs("failed")

    @property
    def skipped(self) -> int:
        return self._pairs("skipped")

    def rows(self, target: str) -> int:
        return sum(o.rows for o in self.outcomes if o.target == target)

    def summary(self) -> dict[str, object]:
        """Totals over registries and targets; a skipped pair ran no query."""
        return {
            "num_tables": self.registries,
            "successful_tables": self.successful,
            "failed_tables": self.failed,
            "skipped_tables": self.skipped,
            "total_queries": self.successful + self.failed,
        }


@dataclass
class _Run:
    spark: SparkSession
    sources: Sources
    database: str | None
    strict: bool
    tag: str
    on_bad_timestamp: str
    broadcast_bytes: int
    staging: Staging  # for the whole run
    moved: list[DataFrame] = field(default_factory=list)  # staged tags, not yet in the table
    warnings: dict[str, str] = field(default_factory=dict)  # of the job at hand, by target

    def source(self, kind: str, registries: Sequence[str]) -> DataFrame:
        return self.sources.view(kind, registries)

    def held(self, target: Target, registries: Sequence[str]) -> DataFrame:
        """Target rows of these registries; names as literals prune its partitions."""
        table = self.spark.table(table_name(target, self.database))
        return table.where(F.col("registry").isin(*registries)).select(*target.columns)

    def insert_new(self, rows: DataFrame, target: Target, registries: Sequence[str]) -> int:
        """Append the rows whose key the table lacks.

        A rerun mostly meets rows it knows. So only digests of the delivered keys are shuffled, to
        the table's own digests, to find the new ones; these are staged, and pick the full rows:
        in the scan, without a shuffle, if they fit the broadcast limit, else by a shuffle join.
        Only picked rows that share a key are made distinct, which most do not. An empty table
        lacks every key, which needs no join.
        """
        counts = row_counts(self.spark, target, self.database, registries)
        outdated = sorted(r for r, (held, noted) in counts.items() if held != noted)
        if outdated:
            rebuild(self.spark, target, self.database, outdated)
        empty = not any(held for held, _ in counts.values())
        with Staging(self.spark, codec="zstd") as staging:
            keys = staging.write(
                delivered_keys(rows, target, registries)
                if empty
                else unknown_keys(
                    rows, target, self.database, registries, null_safe=not self.strict
                )
            )
            if keys.rows == 0:
                return 0
            single, shared = keys.frame.where(~F.col(SEVERAL)), keys.frame.where(SEVERAL)
            n_shared = shared.count()
            few = self.fits(keys.rows)
            if not self.fits(n_shared):
                new = rows if empty else self.picked(rows, keys.frame, target, few)
                several = staging.write(distinct_rows(new))
                new, single, n_single = several.frame, single.limit(0), 0
            else:
                n_single = keys.rows - n_shared
                if not empty:
                    new = self.picked(rows, single, target, few)
                elif n_shared:
                    new = rows_without_key(rows, F.broadcast(shared.select(DIGEST)), target.key)
                else:
                    new = rows
                several = None
                if n_shared:
                    again = self.picked(rows, shared, target, True)
                    several = staging.write(distinct_rows(again))
                    new = new.unionByName(several.frame)
                name = table_name(target, self.database)
                if not (few or empty) and partition_columns(self.spark, name):
                    # What was shuffled for the join goes before the rows are dealt out again.
                    new = staging.write(new).frame
            written = append_rows(new, target, self.database, few)

            def note() -> None:
                if written != n_single + (several.rows if several else 0):
                    # The views have changed meanwhile.
                    return rebuild(self.spark, target, self.database, registries)
                noted = unpacked(single, registries)
                if several:
                    noted = noted.unionByName(digests_with_counts(several.frame, target))
                append_digests(noted, target, self.database)

            self.note_keys(target, note)
            return written

    def fits(self, keys: int) -> bool:
        """Whether so many digests are broadcast."""
        return keys * _KEY_BYTES <= self.broadcast_bytes

    def picked(self, rows: DataFrame, keys: DataFrame, target: Target, few: bool) -> DataFrame:
        wanted = keys.select(DIGEST)
        return rows_with_key(
            rows, F.broadcast(wanted) if few else wanted, target.key, pack=not few
        )

    def note_keys(self, target: Target, write: Callable[[], None]) -> None:
        """Bring the key table up to date. If that fails the merge has been done nevertheless, and
        the next one finds that the counts differ."""
        try:
            write()
        except (PySparkException, Py4JError) as error:
            self.warnings[target.name] = f"keys are taken anew by the next merge: {error}"

    def merge_revisions(self, target: Target, registries: Sequence[str]) -> int:
        packages = self.source("packages", registries)
        rows = revision_rows(packages, self.tag, self.on_bad_timestamp)
        return self.insert_new(rows, target, registries)

    def merge_entries(self, target: Target, registries: Sequence[str]) -> int:
        return self.insert_new(entry_rows(self.source("objects", registries)), target, registries)

    def merge_tags(self, target: Target, registries: Sequence[str]) -> int:
        tags = tag_rows(self.source("packages", registries), self.tag)
        held = self.held(target, registries).where(F.col("tag_name") == self.tag)
        if self.strict:
            return append_rows(tags_to_append(tags, held), target, self.database, few=True)
        chosen = choose_tags(tags, self.held(REVISION, registries))
        changed = self.staging.write(changed_tags(chosen, held))
        if changed.rows == 0:
            return 0
        if not partition_columns(self.spark, table_name(target, self.database)):
            self.moved.append(changed.frame)  # the table is replaced once, at the end of the run
            return changed.rows
        # At most one name per registry of this group.
        touched = [r[0] for r in changed.frame.select("registry").distinct().collect()]
        replaced = held.where(F.col("registry").isin(*touched))
        replace_partitions(replace_tags(replaced, changed.frame), target, self.database)
        return changed.rows

    def replace_moved_tags(self, report: "RunReport") -> None:
        """Put the tags of all groups into a table without partitions, in one replacement."""
        if not self.moved:
            return
        name = table_name(TAG, self.database)
        changed = reduce(DataFrame.unionByName, self.moved)
        try:
            held = self.spark.table(name).select(*TAG.columns)
            replace_rows(replace_tags(held, changed), TAG, self.database)
        except (PySparkException, Py4JError) as error:
            # The table is as it was, so the next run finds the same tags changed.
            report.outcomes = [
                replace(o, status="failed", rows=0, error=str(error))
                if (o.target, o.status) == (TAG.name, "ok") and o.rows
                else o
                for o in report.outcomes
            ]

    def merge_group(self, targets: Sequence[Target], group: Sequence[str]) -> list[Outcome]:
        """All targets of a group, those of the two kinds of views at the same time."""

        def merge(part: Sequence[Target]) -> list[Outcome]:
            done: list[Outcome] = []
            for target in part:
                # A view that could not be read for one target will hardly be for the next.
                bad = {r for o in done if o.status == "failed" for r in o.registries}
                ready = [r for r in group if target.view in self.sources.kinds[r]]
                lacking = tuple(r for r in group if target.view not in self.sources.kinds[r])
                if lacking:
                    done.append(Outcome(target.name, lacking, "skipped"))
                halves = [r for r in ready if r not in bad], [r for r in ready if r in bad]
                for some in filter(None, halves):
                    done += self.attempt(target, some)
            return done

        # Revisions before tags: the newest revision decides between two tags. Entries need
        # neither, and many jobs of a small merge leave most cores idle.
        kinds = dict.fromkeys(t.view for t in targets)
        parts = [[t for t in targets if t.view == kind] for kind in kinds]
        with ThreadPoolExecutor(max(len(parts), 1)) as pool:
            # A thread's own Spark properties, such as its job group, go along.
            own = [pool.submit(inheritable_thread_target(self.spark)(merge), p) for p in parts]
            return [outcome for future in own for outcome in future.result()]

    def step(self, target: Target) -> Callable[[Target, Sequence[str]], int]:
        return {
            "package_revision": self.merge_revisions,
            "package_tag": self.merge_tags,
            "package_entry": self.merge_entries,
        }[target.name]

    def attempt(self, target: Target, registries: Sequence[str]) -> list[Outcome]:
        self.warnings.pop(target.name, None)
        try:
            rows = self.step(target)(target, registries)
        except (PySparkException, Py4JError, ValueError) as error:
            of_data = any(mark in str(error) for mark in DATA_ERRORS)
            if len(registries) > 1 and of_data:
                # By halves: the good ones still share a few large jobs.
                half = len(registries) // 2
                halves = registries[:half], registries[half:]
                return [o for part in halves for o in self.attempt(target, part)]
            return [Outcome(target.name, tuple(registries), "failed", error=str(error))]
        return [Outcome(target.name, tuple(registries), "ok", rows, self.warnings.get(target.name))]


def consolidate(
    spark: SparkSession,
    sources: Sources,
    database: str | None = None,
    registries: Sequence[str] | None = None,
    *,
    targets: Sequence[Target] = TARGETS,
    strict: bool = False,
    isolate: bool = False,
    group_size: int = 64,
    tag: str = LATEST,
    on_bad_timestamp: str = "fail",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> RunReport:
    """Bring the tables up to date with the sources; running it again adds nothing.

    ``registries`` limits the run, ``None`` means all. ``strict`` compares keys
    by plain equality and only ever appends tags. ``group_size`` bounds how many
    registries one job covers, ``isolate`` makes it one. A target whose source
    view a registry lacks is skipped for it.
    """
    needed = list(targets)
    if not strict and any(t.name == TAG.name for t in targets):
        needed.append(REVISION)
    require_targets(spark, database, needed)
    wanted = sources.registries if registries is None else [
        r for r in sources.registries if r in set(registries)
    ]
    report = RunReport(len(wanted))
    size = 1 if isolate else group_size
    with Staging(spark) as staging, no_shuffle_files_left(spark):
        run = _Run(
            spark, sources, database, strict, tag, on_bad_timestamp, broadcast_bytes, staging
        )
        for start in range(0, len(wanted), size):
            report.outcomes += run.merge_group(targets, wanted[start : start + size])
        run.replace_moved_tags(report)
    return report
