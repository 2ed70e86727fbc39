import json
from datetime import datetime, timedelta
from time import sleep

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parcelry.plans import tables
from parcelry.plans.tables import table_name
from parcelry.schemas import REVISION
from parcelry.streaming import (
    EVENT_SCHEMA,
    expired,
    matching_events,
    merge_on_events,
    read_events,
    registries_to_refresh,
    retained,
    routed_events,
    unpack_bus_entries,
)
from parcelry.streaming.job import Waiting, without_redelivered
from tests.conftest import rows
from tests.test_consolidate import package, views

pytestmark = pytest.mark.usefixtures("interpreted")
SOURCE = "org.example.packages"
NOW = datetime(2025, 4, 26, 12, 0, 0)
AT_ONCE = timedelta(0)


def event(bucket="r1", time="2025-04-26T11:46:51Z", change="created", kind="package-revision",
          source=SOURCE, name="e"):
    detail = {"version": "0.1", "type": change, "handle": "a/a", "topHash": "h2"}
    if bucket is not None:
        detail["bucket"] = bucket
    return {
        "version": "0", "id": name, "detail-type": kind, "source": source, "account": "1",
        "time": time, "region": "eu", "resources": [], "detail": detail,
    }


def frame(spark, events):
    lines = spark.createDataFrame([(json.dumps(e),) for e in events], "line string")
    return lines.select(F.from_json("line", EVENT_SCHEMA).alias("e")).select("e.*")


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, 1),
        ({"kind": "package-tag"}, 1),
        ({"kind": "package-entry"}, 1),
        ({"kind": "package-deleted"}, 0),
        ({"change": "updated"}, 1),
        ({"change": "deleted"}, 0),
        ({"source": "org.example.other"}, 0),
    ],
)
def test_matching_events(spark, change, expected):
    assert matching_events(frame(spark, [event(**change)]), SOURCE).count() == expected


def test_events_in_the_put_form(spark):
    detail = json.dumps(event()["detail"])
    entries = spark.createDataFrame(
        [(SOURCE, "package-revision", detail, "default")],
        "Source string, DetailType string, Detail string, EventBusName string",
    )
    unpacked = unpack_bus_entries(entries)
    assert unpacked.schema.simpleString() == EVENT_SCHEMA.simpleString()
    found = matching_events(unpacked, SOURCE)
    assert rows(found.select("detail.bucket", "detail.topHash")) == [("r1", "h2")]
    assert found.where(expired(datetime(2020, 1, 1))).count() == 0
    assert found.where(expired(datetime(2100, 1, 1))).count() == 1


@pytest.mark.parametrize(
    "buckets, expected",
    [
        ([], []),
        (["r1", "r1"], ["r1"]),
        (["r1", "elsewhere"], ["r1"]),
        (["elsewhere"], []),
        (["r1", None], ["r1", "r2", "r3"]),
        ([""], ["r1", "r2", "r3"]),
    ],
)
def test_registries_to_refresh(spark, buckets, expected):
    known = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "registry string")
    events = frame(spark, [event(b) for b in buckets]) if buckets else spark.createDataFrame([], EVENT_SCHEMA)
    assert [r[0] for r in rows(registries_to_refresh(events, known))] == expected


def test_routes(spark):
    events = [
        event(time="2025-04-25T11:59:59Z", name="old"),
        event(time="2025-04-25T12:00:00Z", name="day"),
        event(time="2025-04-26T114651", name="unreadable"),
        event(time="2025-04-25T14:00:00+02:00", name="day there"),
        event(time="2025-04-25T13:59:59+02:00", name="old there"),
        event(time="2025-04-25T12:00:00", name="without zone"),
    ]
    found = routed_events(frame(spark, events), NOW)
    assert {(r["id"], r["route"], r["reason"]) for r in found.collect()} == {
        ("old", "dead_letter", "expired"),
        ("day", "deliver", None),
        ("unreadable", "deliver", None),
        ("day there", "deliver", None),
        ("old there", "dead_letter", "expired"),
        ("without zone", "deliver", None),
    }


def test_dead_letters_are_kept_for_two_weeks(spark):
    letters = spark.createDataFrame(
        [(datetime(2025, 4, 12, 12, 0, 0),), (datetime(2025, 4, 12, 11, 59, 59),)],
        "dead_at timestamp_ntz",
    )
    assert retained(letters, NOW).count() == 1


@pytest.fixture
def stream(spark, make_database, make_sources, tmp_path):
    """Runs the job over batches of events on one checkpoint."""
    database = make_database(partitioned=False)
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    batches = []

    def run(events, sources, checkpoint="checkpoint", **options):
        (inbox / f"{len(batches)}.json").write_text("\n".join(json.dumps(e) for e in events))
        batches.append(events)
        query = merge_on_events(
            read_events(spark, str(inbox)),
            lambda _: sources,
            event_source=SOURCE,
            database=database,
            dead_letters=str(tmp_path / "dead"),
            checkpoint=str(tmp_path / checkpoint),
            **{"now": lambda: NOW, **options},
        )
        query.awaitTermination()
        letters = spark.read.parquet(str(tmp_path / "dead"))
        held = spark.table(table_name(REVISION, database))
        registries = {r["registry"] for r in held.select("registry").distinct().collect()}
        return registries, held.count(), rows(letters.select("id", "reason"))

    return run


def test_events_merge_their_registry(stream, make_sources):
    sources = make_sources(views("r1") | views("r2") | views("r3"))
    old = event("r3", time="2025-04-20T00:00:00Z", name="old")
    assert stream([event("r1"), event("r1"), old], sources) == ({"r1"}, 3, [("old", "expired")])
    assert stream([event("r2", change="deleted")], sources)[0] == {"r1"}
    assert stream([event(None)], sources)[0] == {"r1", "r2", "r3"}
    # The same events once more, as after a lost checkpoint.
    again = stream([event("r1")], sources, checkpoint="other")
    assert again == ({"r1", "r2", "r3"}, 9, [("old", "expired")] * 2)


def test_events_of_a_failing_registry_become_dead_letters(stream, make_sources):
    bad = views("bad")
    bad["bad_packages-view"].append(package("z/z", "hz", "v1.0"))
    sources = make_sources(bad | views("r1"))
    events = [event("bad", name="b"), event("r1", name="g")]
    assert stream(events, sources, retries=1, retry_delay=AT_ONCE) == ({"r1"}, 3, [("b", "retries exhausted")])


def test_a_failed_replacement_is_repeated_without_loss(stream, make_sources, spark, monkeypatch):
    start = make_sources(views("r1", "h1") | views("r2", "h1"))
    stream([event(None)], start)
    write, calls = tables.write_version, []

    def fail_once(frame, target, folder, provider):
        write(frame, target, folder, provider)
        calls.append(folder)
        if len(calls) == 1:
            raise PySparkException("no space left")

    monkeypatch.setattr(tables, "write_version", fail_once)
    moved = make_sources(views("r1", "h2") | views("r2", "h1"))
    assert stream([event("r1", name="m")], moved, retry_delay=AT_ONCE) == ({"r1", "r2"}, 6, [])
    assert len(calls) == 2


def bad_and_good():
    bad = views("bad")
    bad["bad_packages-view"].append(package("z/z", "hz", "v1.0"))
    return bad | views("r1"), views("bad") | views("r1")


def test_redelivered_events_are_left_out(stream, make_sources):
    sources = make_sources(views("r1") | views("r2"))
    reports = []
    keep = {"on_report": lambda batch, report: reports.append(report)}
    for _ in range(2):
        stream([event("r1"), event("r1"), event("r2", name="f")], sources, **keep)
    assert [r.registries for r in reports] == [2]
    # Without an id as well; an event that differs in anything is another one.
    stream([event("r1", name=None)], sources, **keep)
    stream([event("r1", name=None)], sources, **keep)
    assert [r.registries for r in reports] == [2, 1]
    stream([event("r1", time="2025-04-26T11:46:52Z")], sources, **keep)
    assert [r.registries for r in reports] == [2, 1, 1]


def test_the_state_of_redelivery_goes_after_its_time(spark, tmp_path):
    """A second later nothing is left of the first batch, and its event counts as new."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    seen = []
    for number, wait in enumerate((0, 0, 3)):
        sleep(wait)
        (inbox / f"{number}.json").write_text(json.dumps(event()))
        query = (
            without_redelivered(read_events(spark, str(inbox)), hours=0)
            .writeStream.foreachBatch(lambda batch, _: seen.append(batch.count()))
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    state = query.lastProgress["stateOperators"][0]
    assert state["operatorName"] == "dedupeWithinWatermark" and state["numRowsTotal"] <= 1
    assert sum(seen) >= 2


def test_a_failed_merge_is_tried_again_later(stream, make_sources):
    bad, good = map(make_sources, bad_and_good())
    reports = []
    keep = {"on_report": lambda batch, report: reports.append(report)}
    at = lambda minutes: {"now": lambda: NOW + timedelta(minutes=minutes), **keep}
    events = [event("bad", name="b"), event("r1", name="g")]
    assert stream(events, bad, **at(0)) == ({"r1"}, 3, [])
    # Not due yet; a minute later it is, and fails again; then two minutes go by.
    assert stream([], bad, **at(0.5)) == ({"r1"}, 3, [])
    assert stream([], bad, **at(1)) == ({"r1"}, 3, [])
    assert stream([], good, **at(2.5)) == ({"r1"}, 3, [])
    assert [r.registries for r in reports] == [2, 1]
    assert stream([], good, **at(3)) == ({"bad", "r1"}, 6, [])
    assert stream([], good, **at(60)) == ({"bad", "r1"}, 6, [])
    assert [r.registries for r in reports] == [2, 1, 1]


def test_repeats_end_in_a_dead_letter(stream, make_sources):
    bad, _ = map(make_sources, bad_and_good())
    minutes = [0, 1, 3, 7]
    found = [
        stream(
            [event("bad", name="b")] if m == 0 else [],
            bad,
            now=lambda m=m: NOW + timedelta(minutes=m),
        )[2]
        for m in minutes
    ]
    assert found == [[], [], [], [("b", "retries exhausted")]]
    # An event for the registry that comes later begins anew.
    assert stream([event("bad", name="c")], bad, now=lambda: NOW + timedelta(minutes=9))[2] == found[3]


def test_a_waiting_event_expires(stream, make_sources):
    bad, _ = map(make_sources, bad_and_good())
    assert stream([event("bad", name="b")], bad)[2] == []
    assert stream([], bad, now=lambda: NOW + timedelta(hours=25))[2] == [("b", "expired")]


def test_a_merge_for_another_event_settles_those_that_wait(stream, make_sources):
    bad, good = map(make_sources, bad_and_good())
    assert stream([event(None, name="all"), event("bad", name="b")], bad) == ({"r1"}, 3, [])
    assert stream([event("bad", name="c")], good) == ({"bad", "r1"}, 6, [])
    later = {"now": lambda: NOW + timedelta(hours=30)}
    assert stream([], good, **later) == ({"bad", "r1"}, 6, [])


def test_a_repeated_batch_reads_what_was_before_it(spark, tmp_path):
    schema = frame(spark, [event()]).schema
    waiting = Waiting(spark, str(tmp_path / "waiting"), schema)
    rows_of = lambda n: spark.createDataFrame(
        [tuple(frame(spark, [event(name=f"e{n}")]).first()) + ("r1", n, NOW, "x")], waiting.schema
    )
    assert waiting.before(0).count() == 0 and not waiting.any_due(NOW)
    for batch in (0, 3, 3, 4):
        waiting.write(rows_of(batch), batch)
        expected = {0: None, 3: 0, 4: 3}[batch]
        found = waiting.before(batch).first()
        assert (found and found.tries) == expected
    assert waiting.any_due(NOW) and not waiting.any_due(NOW - timedelta(seconds=1))
    assert sorted(p.name for p in (tmp_path / "waiting").iterdir()) == ["batch-3", "batch-4"]


def test_letters_are_dropped_after_their_time(stream, make_sources):
    sources = make_sources(views("r1"))
    old = event("r1", time="2025-04-20T00:00:00Z", name="old")
    assert stream([old], sources)[2] == [("old", "expired")]
    later = event("r1", time="2025-05-20T00:00:00Z", name="later")
    found = stream([later], sources, now=lambda: datetime(2025, 6, 1))
    assert found[2] == [("later", "expired")]


def test_streamed_frames_are_filtered(spark, tmp_path):
    events = read_events(spark, str(tmp_path), files_per_batch=5)
    assert events.isStreaming
    assert matching_events(events, SOURCE).isStreaming
    assert routed_events(events, NOW).isStreaming
