"""The checked sync of landed page files."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from chainage.contract import ContractError
from chainage.plans.jobs import index_for, sync_landing
from chainage.plans.store import RouteStore
from chainage.sources import esri, landing
from test_sources import feature, payload

LINE = [[[0, 0, 0], [1, 1, 1]]]
MOMENT = "2024-01-01 00:00:00"
OLD, NEW = 946684800000, 2524608000000


@pytest.fixture
def store(spark, tmp_path):
    return RouteStore(spark, str(tmp_path / "store"), buckets=8)


def road(name, paths=LINE, **attributes):
    return feature(paths, **({"LINKID": name, "ROAD_STATUS": "N"} | attributes))


def land(tmp_path, pages: dict, pattern: str = "offset={}/page.json") -> str:
    for offset, features in pages.items():
        path = tmp_path / "landed" / pattern.format(offset)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(features if isinstance(features, str) else payload(*features))
    return str(tmp_path / "landed")


def published(store):
    return sorted(r.ROUTEID for r in store.latest().points.select("ROUTEID").distinct().collect())


@pytest.mark.parametrize("pattern", ["offset={}/page.json", "roads-offset-{}.json"])
def test_only_routes_in_force_are_published(spark, tmp_path, store, pattern):
    pages = {
        0: [road("old", FROMDATE=OLD), road("undated"), road("text", FROMDATE="2001-02-03 00:00:00")],
        3: [road("planned", FROMDATE=NEW), road("ended", FROMDATE=OLD, TODATE=OLD), road("closed", ROAD_STATUS="X")],
        6: [road("none", ROAD_STATUS=None), road("digits", FROMDATE=str(OLD))],
    }
    done = sync_landing(spark, land(tmp_path, pages, pattern), store, 8, 3, MOMENT, date(2024, 1, 1))
    assert (done.version, done.features, done.rejected, done.inactive) == (1, 8, 0, 4)
    assert published(store) == ["digits", "old", "text", "undated"]


def test_wrong_pages_stop_the_sync(spark, tmp_path, store):
    pages = {0: [road("a")], 4: "not json", 6: [road(c) for c in "bcd"], 9: [road("e")]}
    with pytest.raises(landing.LandingError, match="offset 0") as refused:
        sync_landing(spark, land(tmp_path, pages), store, 8, 2, MOMENT)
    rows = refused.value.pages.orderBy("offset").collect()
    assert [tuple(r) for r in rows] == [(0, 2, 1), (2, 2, 0), (4, 2, 0), (6, 2, 3), (9, 0, 1)]
    assert store.catalog().count() == 0


def test_a_page_landed_twice_is_noticed(spark, tmp_path, store):
    land(tmp_path, {0: [road("a")]})
    folder = land(tmp_path, {0: [road("a")]}, "again/offset-{}.json")
    with pytest.raises(landing.LandingError, match=r"0 \(2 of 1\)"):
        sync_landing(spark, folder, store, 1, 5, MOMENT)


def test_files_without_an_offset_are_noticed(spark, tmp_path, store):
    with pytest.raises(landing.LandingError):
        sync_landing(spark, land(tmp_path, {0: [road("a")]}, "page{}.json"), store, 1, 5, MOMENT)


def test_broken_features_count_only_if_in_force(spark, tmp_path, store):
    pages = {0: [road("a"), road("gone", paths=[], TODATE=OLD)], 2: [road(None), road("b", FROMDATE="soon")]}
    folder = land(tmp_path, pages)
    with pytest.raises(Exception, match="cannot become a route"):
        sync_landing(spark, folder, store, 4, 2, MOMENT)
    assert store.catalog().count() == 0
    done = sync_landing(spark, folder, store, 4, 2, MOMENT, mode="skip")
    assert (done.features, done.rejected, done.inactive) == (4, 2, 1)
    assert published(store) == ["a"]


def test_selected_routes_replace_their_own(spark, tmp_path, store, make_points):
    store.publish(make_points({"a": [(9, 9, 9)], "b": [(9, 9, 9)]}), date(2023, 1, 1))
    folder = land(tmp_path, {0: [road("a"), road("b")]})
    sync_landing(spark, folder, store, 2, 2, MOMENT, routes=["b"])
    assert store.latest().points.where("LAT = 9").select("ROUTEID").collect()[0][0] == "a"
    assert store.latest().points.where("ROUTEID = 'b'").count() == 2


def test_service_columns(spark):
    page = payload(
        road("a", FROMDATE=1.5e12, TODATE=None), road("b", FROMDATE="2020-01-02"), road("c", FROMDATE="x"), road("d", TODATE=[1])
    )
    parsed = esri.features(spark.createDataFrame([(page,)], ["payload"]))
    rows = {r.ROUTEID: r for r in esri.with_service_columns(parsed).collect()}
    assert rows["a"].FROMDATE.isoformat() == "2017-07-14T02:40:00" and rows["a"].TODATE is None
    assert rows["b"].FROMDATE.isoformat() == "2020-01-02T00:00:00" and rows["b"].problem is None
    assert "invalid FROMDATE" in rows["c"].problem and "invalid FROMDATE" in rows["d"].problem


def test_the_announced_count_may_be_a_table(spark):
    landed = spark.createDataFrame([(0,)] * 4 + [(8,)], ["offset"])
    announced = spark.range(10).agg(F.count("*"))
    found = landing.landing_check(landed, announced, 4).orderBy("offset").collect()
    assert [tuple(r) for r in found] == [(4, 4, 0), (8, 2, 1)]
    none = landing.landing_check(landed.where("false"), announced.select(F.lit(0).cast("bigint")), 4)
    assert none.count() == 0


# -- what a store opens -----------------------------------------------------------


def buckets_opened(df):
    """The buckets that the plan's scan is limited to."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    listed = re.search(r"bucket#\d+ (?:IN \(([\d,]+)\)|= (\d+)|INSET ([\d, ]+))", plan)
    assert listed, plan
    return set(next(g for g in listed.groups() if g).replace(" ", "").strip(",").split(","))


def test_a_table_of_ids_opens_only_its_buckets(spark, store, make_points, make_events):
    store.publish(make_points({f"r{i}": [(i, 0, 0), (i, 1, 1)] for i in range(60)}), date(2024, 1, 1))
    ids = spark.createDataFrame([("r1",), ("r2",), ("none",), ("r1",)], "ROUTEID string")
    chosen = store.latest(ids)
    assert len(buckets_opened(store.latest().points)) == 8
    wanted = set().union(*(buckets_opened(store.latest(r).points) for r in ("r1", "r2", "none")))
    assert len(wanted) <= 3
    for table in (chosen.points, chosen.segments, chosen.linestrings, chosen.boxes):
        assert buckets_opened(table) == wanted
    assert sorted({r.ROUTEID for r in chosen.points.collect()}) == ["r1", "r2"]
    assert store.latest(ids.where("false")).points.count() == 0
    assert store.as_of("2024-01-01", ids).points.count() == 4


def test_requests_open_the_routes_at_hand(spark, store, make_points, make_events, monkeypatch):
    store.publish(make_points({f"r{i}": [(i, 0, 0), (i, 1, 1)] for i in range(60)}), date(2024, 1, 1))
    events = make_events([(1, "r5", 5, 1), (2, "r5", 5, 2), (3, "none", 1, 1), (4, None, 1, 1)])
    few = index_for(store, events).segments
    # The ids reach the scan.
    assert "In(ROUTEID" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr("chainage.plans.jobs.MAX_IN_LIST", 1)
    many = index_for(store, events).segments
    assert "LeftSemi" in many._jdf.queryExecution().executedPlan().toString()
    assert few.collect() == many.collect() != []


def test_many_ids_are_taken_from_the_events_once(spark, store, tmp_path, make_points, make_events, monkeypatch):
    store.publish(make_points({f"r{i}": [(i, 0, 0), (i, 1, 1)] for i in range(60)}), date(2024, 1, 1))
    path = str(tmp_path / "asked")
    make_events([(1, "r5", 5, 1), (2, "r6", 5, 2), (3, "none", 1, 1), (4, None, 1, 1)]).write.parquet(path)
    monkeypatch.setattr("chainage.plans.jobs.MAX_IN_LIST", 1)
    index = index_for(store, spark.read.parquet(path))
    for table in (index.segments, *index.levels):
        assert not any("/asked/" in f for f in table.inputFiles())
    assert {r.route for r in index.segments.collect()} == {"r5", "r6"}


def test_one_route_is_in_one_file_of_a_table(spark, tmp_path, make_points):
    """One bucket in several files: each holds a run of routes, so statistics leave one to read."""
    store = RouteStore(spark, str(tmp_path / "wide"), buckets=1)
    routes = {f"r{i:03}": [(i, j, j) for j in range(40)] for i in range(200)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.publish(make_points(routes), date(2024, 1, 1), dense=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for table in ("points", "segments", "boxes", "linestrings"):
        rows = getattr(store.latest(), table)
        spans = rows.groupBy(F.input_file_name().alias("file")).agg(F.min("ROUTEID").alias("lo"), F.max("ROUTEID").alias("hi"))
        spans = sorted((r.lo, r.hi) for r in spans.collect())
        assert len(spans) > 2
        assert all(before[1] <= after[0] for before, after in zip(spans, spans[1:], strict=False))
        holding = [s for s in spans if s[0] <= "r100" <= s[1]]
        assert len(holding) <= 2 and rows.where("ROUTEID = 'r100'").count() > 0


def test_an_empty_list_of_ids(store, make_points):
    store.publish(make_points({"a": [(0, 0, 0)]}), date(2024, 1, 1))
    assert store.latest([]).points.count() == 0
    with pytest.raises(ContractError):
        store.as_of("2023-01-01", [])


def test_many_pages_are_landed_in_few_files(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry
    from chainage.sources import esri
    from fixtures import tables as fx

    monkeypatch.setattr(entry, "scratch_dir", lambda _, purpose: str(tmp_path / purpose))
    # 1,500 vertices a table are a page or two, so routes are made short here to have many.
    monkeypatch.setattr(fx, "PER_ROUTE", 10)
    entry._two_versions(spark, "/root/testdata/sf0.001")
    landed = str(tmp_path / "pages")
    want = {r.payload for r in fx.esri_payloads(spark, "/root/testdata/sf0.001").collect()}
    pages = esri.read_payloads(spark, landed, lines=True).collect()
    assert len(pages) == len(want) >= 50 and len({p.file for p in pages}) <= 4
