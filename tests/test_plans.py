"""Properties of the physical plans that matter at scale."""

import re

import pytest

import __spark_entry__ as entry
from chainage.operators import index as ix
from chainage.operators import locate as loc
from chainage.operators import routes as rt
from chainage.plans.store import RouteStore
from chainage.sources import geojson
from fixtures import tables as fx

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["mvalue", "mvalue_left", "segments", "project_inverse", "esri_points", "geojson_export"])
def test_no_python_and_no_cross_product(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_location_has_no_single_partition_step(spark):
    text = plan(entry.queries()["mvalue"](spark, SF))
    assert "SinglePartition" not in text


def test_route_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "points")
    fx.points(spark, SF).write.parquet(path)
    stored = spark.read.parquet(path)
    assert "PushedFilters: [IsNotNull(ROUTEID), EqualTo(ROUTEID,0000001)]" in plan(rt.only_routes(stored, "0000001"))
    assert re.search(r"PushedFilters: \[In\(ROUTEID, \[a,b\]\)\]", plan(rt.only_routes(stored, ["a", "b"])))


def test_only_needed_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "events")
    fx.events(spark, SF).selectExpr("*", "repeat('x', 100) as wide").write.parquet(path)
    events = spark.read.parquet(path)
    index = ix.build_index(rt.segments(fx.points(spark, SF), dense=True), depth=1)
    text = plan(loc.locate(events.drop("wide"), index))
    reads = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert all("wide" not in r for r in reads)
    # the place search itself needs three columns
    assert "ROUTEID:string,LON:double,LAT:double" in reads


def test_box_grouping_reuses_the_segment_partitioning(spark, tmp_path):
    segments = rt.segments(fx.points(spark, SF), dense=True, with_block=True)
    index = ix.build_index(segments, depth=1)
    # vertices to blocks, then boxes to routes: two shuffles
    assert plan(index.levels[0]).count("Exchange hashpartitioning") == 2


@pytest.fixture
def large_tables(spark):
    """Plans as for tables that are too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name, scans, exchanges", [("mvalue", 3, 10), ("shortest_line", 3, 10), ("box_candidates", 3, 12)])
def test_vertices_are_shuffled_once(spark, large_tables, name, scans, exchanges):
    df = entry.queries()[name](spark, SF)
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    reused = text.count("ReusedExchange")
    assert reused >= 1 and text.count("FileScan") <= scans
    assert text.count("Exchange hashpartitioning") - reused <= exchanges


def test_candidates_are_not_shuffled(spark, large_tables):
    df = entry.queries()["mvalue_multi"](spark, SF)
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    assert not re.search(r"hashpartitioning\([^)]*node#", text)
    # places are sent to their route once, and what is found is sent on with the event's place
    assert len(re.findall(r"Exchange hashpartitioning\(route#\d+, _salt#\d+, \d+\), REPARTITION_BY_NUM", text)) == 1
    assert not re.search(r"hashpartitioning\(route#\d+, x#\d+, y#\d+, _salt", text)


def test_candidates_are_sorted_by_place_before_route(spark, large_tables):
    index = ix.build_index(rt.segments(fx.points(spark, SF), dense=True, with_block=True), depth=1)
    text = plan(loc.locate(fx.events(spark, SF), index))
    assert re.search(r"Sort \[\S*x#\d+ ASC NULLS FIRST, \S*y#\d+ ASC", text.replace("knownfloatingpointnormalized(normalizenanandzero(", "")), text
    assert not re.search(r"Sort \[route#\d+ ASC NULLS FIRST, \S*x#", text.replace("knownfloatingpointnormalized(normalizenanandzero(", ""))


def test_stored_segments_are_shuffled_once_for_a_search(spark, tmp_path):
    store = RouteStore(spark, str(tmp_path / "routes"), buckets=4)
    store.publish(fx.points(spark, SF))
    index = store.latest().index()
    assert len(index.levels) == 1
    assert plan(index.by_route()).count("Exchange hashpartitioning") == 1


def test_coordinates_are_read_once_for_a_feature(spark):
    documents = spark.createDataFrame([(1, "{}")], "doc_id bigint, document string")
    found = geojson.events(geojson.valid(geojson.features(documents)), "ROUTEID string", keep=("doc_id",))
    text = plan(found)
    assert text.count("ArrayType(DoubleType") == 1
    # Nor do rows carry the document that they are from.
    assert not re.search(r"Generate posexplode[^\n]*_doc#", text)
