import uuid

import pytest

from parcelry.plans.tables import create_database, create_targets
from parcelry.schemas import OBJECTS_VIEW, PACKAGES_VIEW
from parcelry.session import work_folder
from parcelry.sources.views import sources_from_views
from parcelry_checks.compare import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4")
    yield session
    session.stop()


@pytest.fixture
def make_database(spark):
    """Creates databases with empty targets and drops them after the test."""
    made = []

    def make(partitioned=True, targets=None):
        name = f"test_{uuid.uuid4().hex}"
        create_database(spark, name, f"{work_folder(spark)}/{name}")
        made.append(name)
        if targets is None:
            create_targets(spark, name, partitioned=partitioned)
        elif targets:
            create_targets(spark, name, targets, partitioned)
        return name

    yield make
    for name in made:
        spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")


@pytest.fixture
def make_sources(spark):
    """Sources from ``{view name: rows}``."""

    def make(views, registry=None):
        frames = {
            name: spark.createDataFrame(
                rows, PACKAGES_VIEW if "packages" in name else OBJECTS_VIEW
            )
            for name, rows in views.items()
        }
        return sources_from_views(spark, frames, registry)

    return make


def rows(frame):
    """Rows as sorted tuples, NULL first."""
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: [(v is not None, v) for v in r])


@pytest.fixture
def interpreted(spark):
    """No generated code: for runs of many jobs over a handful of rows, compiling is the cost."""
    settings = {
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.sql.shuffle.partitions": "2",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)
