from datetime import date

import pytest
from pyspark.sql import functions as F

from chainage.contract import ContractError
from chainage.operators import locate as loc
from chainage.plans import catalog
from chainage.plans.jobs import index_for, sync_routes
from chainage.plans.merge import merge_routes
from chainage.plans.scratch import scratch_dir
from chainage.plans.store import RouteStore

A = [(0, 0, 0), (10, 0, 1), (20, 0, 2)]
MOVED = [(0, 9, 0), (10, 9, 1)]


@pytest.fixture
def store(spark, tmp_path):
    return RouteStore(spark, str(tmp_path / "store"), buckets=4)


def vertices(df):
    return sorted((r.ROUTEID, r.VERTEX_SEQ, r.LAT) for r in df.collect())


def files_read(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_merge_replaces_whole_routes(make_points):
    old = make_points({"a": A, "b": A})
    new = make_points({"b": MOVED, "c": MOVED})
    got = vertices(merge_routes(old, new))
    assert got == vertices(make_points({"a": A})) + vertices(new)
    assert merge_routes(None, new) is new


def test_versions_are_published_and_kept(store, make_points):
    with pytest.raises(ContractError, match="no active catalog entry"):
        store.latest()
    routes = {f"r{i}": A for i in range(12)}
    assert store.publish(make_points(routes), date(2024, 1, 1), "me", "first") == 1
    assert store.publish(make_points({"r3": MOVED, "new": MOVED}), date(2024, 1, 5), "me", "second") == 2
    assert store.publish(make_points({"r4": MOVED}), date(2024, 1, 5), "you", "third", dense=True) == 3

    rows = [tuple(r) for r in store.catalog().select("VERSION", "START_DATE", "END_DATE", "AUTHOR").orderBy("VERSION").collect()]
    assert rows == [
        (1, date(2024, 1, 1), date(2024, 1, 5), "me"),
        (2, date(2024, 1, 5), date(2024, 1, 5), "me"),
        (3, date(2024, 1, 5), None, "you"),
    ]
    want = routes | {"r3": MOVED, "new": MOVED, "r4": MOVED}
    latest = store.latest()
    assert latest.version == 3
    assert vertices(latest.points) == vertices(make_points(want))
    assert latest.segments.count() == 10 * 2 + 3 * 1
    assert latest.linestrings.count() == 13
    assert vertices(store.version(1).points) == vertices(make_points(routes))
    assert store.as_of("2024-01-03").version == 1
    assert store.as_of("2024-01-05").version == 3
    with pytest.raises(ContractError):
        store.as_of("2023-12-31")


def test_a_route_filter_opens_one_bucket(store, make_points):
    store.publish(make_points({f"r{i}": A for i in range(12)}), date(2024, 1, 1))
    one = store.latest("r5")
    assert vertices(one.points) == vertices(make_points({"r5": A}))
    assert one.segments.count() == 2 and one.linestrings.count() == 1
    files = {f.split("bucket=")[1][0] for f in files_read(one.points)}
    assert len(files) == 1
    assert store.latest(["r1", "r2", "none"]).points.count() == 6
    assert store.latest("none").points.count() == 0


def test_untouched_buckets_are_not_rewritten(store, make_points):
    store.publish(make_points({f"r{i}": A for i in range(12)}), date(2024, 1, 1))
    before = files_read(store.latest().points)
    store.publish(make_points({"r3": MOVED}), date(2024, 1, 2))
    after = files_read(store.latest().points)
    assert len(before & after) > 0 and before - after
    assert len({f.split("bucket=")[1][0] for f in before - after}) == 1


def test_bad_batches_are_refused_and_leave_no_version(store, make_points):
    twice = make_points({"a": A}).unionByName(make_points({"a": A}))
    with pytest.raises(ContractError, match="delivered twice"):
        store.publish(twice, date(2024, 1, 1))
    with pytest.raises(ContractError, match="route id"):
        store.publish(make_points({None: A}), date(2024, 1, 1))
    with pytest.raises(ContractError, match="no vertices"):
        store.publish(make_points({"a": A}).where("false"), date(2024, 1, 1))
    with pytest.raises(ContractError, match="no active catalog entry"):
        store.latest()


def test_a_failed_publish_is_invisible(store, make_points, monkeypatch):
    store.publish(make_points({"a": A}), date(2024, 1, 1))
    monkeypatch.setattr("chainage.plans.store.linestrings", lambda df: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.publish(make_points({"a": MOVED}), date(2024, 1, 2))
    monkeypatch.undo()
    assert store.latest().version == 1
    assert vertices(store.latest().points) == vertices(make_points({"a": A}))
    assert store.publish(make_points({"a": MOVED}), date(2024, 1, 3)) == 2


def test_one_vertex_routes_have_no_segment(store, make_points, make_events):
    store.publish(make_points({"dot": A[:1], "a": A}), date(2024, 1, 1))
    store.publish(make_points({"a": A[:1]}), date(2024, 1, 2))
    assert store.latest().segments.count() == 0
    assert store.latest().linestrings.count() == 2
    assert store.version(1).segments.count() == 2


def test_a_store_without_any_segment_can_be_read(store, make_points, make_events):
    store.publish(make_points({"dot": A[:1]}), date(2024, 1, 1))
    latest = store.latest()
    assert (latest.points.count(), latest.segments.count()) == (1, 0)
    assert loc.locate(make_events([(1, "dot", 5, 3)]), latest.index()).count() == 0
    store.publish(make_points({"a": A}))
    assert store.latest().segments.count() == 2
    assert store.catalog().where("VERSION = 2").first().START_DATE == date.today()


def test_location_on_a_stored_version(store, make_points, make_events):
    store.publish(make_points({"a": A}), date(2024, 1, 1))
    store.publish(make_points({"a": MOVED}), date(2024, 1, 2))
    event = make_events([(1, "a", 5, 3)])
    assert loc.locate(event, store.latest().index()).first().DIST_TO_LRS == 6
    assert loc.locate(event, store.version(1).index()).first().DIST_TO_LRS == 3
    assert loc.locate(event, index_for(store, event)).first().DIST_TO_LRS == 6


def test_sync_of_selected_routes(spark, store):
    from test_sources import feature, payload

    page = payload(feature([[[0, 0, 0], [1, 1, 1]]], LINKID="a"), feature([[[0, 0, 0], [1, 1, 1]]], LINKID="b"))
    pages = spark.createDataFrame([(page,)], ["payload"])
    sync_routes(pages, store, date(2024, 1, 1), routes=["b"])
    assert {r.ROUTEID for r in store.latest().points.collect()} == {"b"}
    sync_routes(pages, store, date(2024, 1, 2))
    assert store.latest().points.count() == 4
    moved = spark.createDataFrame([(page.replace("[1, 1, 1]", "[2, 2, 2]"),)], ["payload"])
    ids = spark.createDataFrame([("a",), ("a",), ("unknown",)], "ROUTEID string")
    sync_routes(moved, store, date(2024, 1, 3), routes=ids)
    assert {(r.ROUTEID, r.LON) for r in store.latest().points.collect()} == {("a", 0), ("a", 2), ("b", 0), ("b", 1)}


def test_catalog_functions(spark):
    rows = spark.createDataFrame(
        [("x", 1, date(2024, 1, 1)), ("x", 2, date(2024, 1, 1)), ("x", 3, date(2024, 2, 1)), ("y", 1, date(2024, 3, 1))],
        "k string, VERSION int, START_DATE date",
    )
    dated = catalog.with_end_dates(rows, ["k"])
    assert {(r.k, r.VERSION) for r in catalog.latest(dated, ["k"]).collect()} == {("x", 3), ("y", 1)}
    assert {(r.k, r.VERSION) for r in catalog.as_of(dated, "2024-01-15", ["k"]).collect()} == {("x", 2)}
    assert catalog.next_version(rows, []).first()[0] == 4
    assert catalog.next_version(rows.where("false"), []).first()[0] == 1
    assert catalog.latest(dated.where("false"), []).count() == 0


def test_scratch_follows_the_session_setting(spark):
    assert scratch_dir(spark, "x").startswith(scratch_dir(spark, "y").rsplit("/", 1)[0])
    spark.conf.set("chainage.test", "1")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
