"""The source views of all registries as two frames with a ``registry`` column."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.functions.columns import VIEW_SUFFIX
from parcelry.schemas import OBJECTS_VIEW, PACKAGES_VIEW
from parcelry.session import quote, quoted
from parcelry.sources.discovery import list_sources, pair_views

VIEW_SCHEMAS = {"packages": PACKAGES_VIEW, "objects": OBJECTS_VIEW}


def scan_packages(view: DataFrame) -> DataFrame:
    """The packages-view columns that are used; others never leave the scan."""
    return view.select(*PACKAGES_VIEW.fieldNames())


def scan_objects(view: DataFrame) -> DataFrame:
    """The objects-view columns that are used, of ``hash`` only its two fields."""
    hash_struct = F.struct(F.col("hash.type"), F.col("hash.value")).alias("hash")
    return view.select(
        *[hash_struct if name == "hash" else F.col(name) for name in OBJECTS_VIEW.fieldNames()]
    )


_SCANS = {"packages": scan_packages, "objects": scan_objects}


def union_registries(views: Mapping[str, DataFrame], kind: str) -> DataFrame:
    """All views of one kind, ``{registry: view}``, as one frame tagged with the registry."""
    frames = [
        _SCANS[kind](view).select(F.lit(registry).alias("registry"), "*")
        for registry, view in views.items()
    ]
    if not frames:
        raise ValueError(f"no {kind} view given")
    # Pairwise, so that analysing many registries costs n log n and not n squared.
    while len(frames) > 1:
        paired = [a.unionByName(b) for a, b in zip(frames[::2], frames[1::2])]
        frames = paired + (frames[-1:] if len(frames) % 2 else [])
    return frames[0]


@dataclass(frozen=True)
class Sources:
    """Both views of every registry, and which registry has which of them.

    Views are either frames that hold many registries, or ``{registry: view}``; of the latter
    only those asked for are put together, so a group of a run costs the same however many
    registries there are.
    """

    packages: DataFrame | Mapping[str, DataFrame] | None
    objects: DataFrame | Mapping[str, DataFrame] | None
    kinds: Mapping[str, frozenset[str]]  # registry -> {"packages", "objects"}

    @property
    def registries(self) -> list[str]:
        return sorted(self.kinds)

    def view(self, kind: str, registries: Sequence[str] | None = None) -> DataFrame:
        """The views of a kind as one frame, of all registries or some."""
        held = self.packages if kind == "packages" else self.objects
        if not isinstance(held, DataFrame):
            wanted = [r for r in held or {} if registries is None or r in set(registries)]
            if not wanted:
                raise ValueError(f"no registry has a {kind} view")
            return union_registries({r: held[r] for r in wanted}, kind)
        return held if registries is None else held.where(F.col("registry").isin(*registries))


def sources_from_frames(
    packages: DataFrame | None,
    objects: DataFrame | None,
    registries: Mapping[str, Iterable[str]],
) -> Sources:
    """Sources that already carry a ``registry`` column, e.g. a partitioned landing table.

    ``registries`` says which views each registry has.
    """
    return Sources(packages, objects, {r: frozenset(k) for r, k in registries.items()})


class _CatalogViews(Mapping):
    """Views of a database by registry, looked up when one is asked for."""

    def __init__(self, spark: SparkSession, names: Mapping[str, str]):
        self.spark, self.names = spark, names

    def __getitem__(self, registry: str) -> DataFrame:
        return self.spark.table(self.names[registry])

    def __iter__(self):
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


def _paired(names: DataFrame, registry: str | None) -> dict[str, dict[str, str]]:
    """View names by kind and registry; only names pass through the driver."""
    found: dict[str, dict[str, str]] = {kind: {} for kind in VIEW_SUFFIX}
    for pair in pair_views(names, registry).collect():
        for kind in found:
            if pair[f"{kind}_view"] is not None:
                found[kind][pair["registry"]] = pair[f"{kind}_view"]
    return found


def _kinds(found: Mapping[str, Mapping[str, object]]) -> dict[str, frozenset[str]]:
    registries = {r for views in found.values() for r in views}
    return {r: frozenset(k for k in found if r in found[k]) for r in sorted(registries)}


def sources_from_views(
    spark: SparkSession, views: Mapping[str, DataFrame], registry: str | None = None
) -> Sources:
    """Sources from ``{view name: frame}``, optionally only those of one registry."""
    found = _paired(spark.createDataFrame([(name,) for name in views], "name string"), registry)
    frames = {kind: {r: views[n] for r, n in names.items()} for kind, names in found.items()}
    return Sources(frames["packages"], frames["objects"], _kinds(found))


def sources_from_catalog(
    spark: SparkSession, database: str | None = None, registry: str | None = None
) -> Sources:
    """Sources from the views of a database, found by name; temporary views count as well."""
    listed = list_sources(spark, database)
    found = _paired(listed, registry)
    # Temporary views are listed with every database but belong to none.
    own = {r.name for r in listed.where("temporary").collect()}
    where = f"{quoted(database)}." if database else ""
    views = {
        kind: _CatalogViews(
            spark, {r: f"{'' if n in own else where}{quote(n)}" for r, n in names.items()}
        )
        for kind, names in found.items()
    }
    return Sources(views["packages"], views["objects"], _kinds(found))
