"""A third or more of all rows under one key must not land in one task."""

import contextlib

import pytest
from pyspark.sql import functions as F

from chainage.operators import index as ix
from chainage.operators import locate as loc
from chainage.operators import routes as rt


@contextlib.contextmanager
def settings(spark, **values):
    values = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    old = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


SMALL = {
    "autoBroadcastJoinThreshold": "-1",
    "adaptive__advisoryPartitionSizeInBytes": "20k",
    "adaptive__skewJoin__skewedPartitionThresholdInBytes": "40k",
    "adaptive__skewJoin__skewedPartitionFactor": "2",
    "shuffle__partitions": "8",
}


def executed(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def points(spark):
    return spark.range(200 * 40).selectExpr(
        "lpad(string(id div 40), 3, '0') as ROUTEID", "double(id % 7) as LAT", "double(id % 40) as LON",
        "(id % 40) / 10d as MVAL", "int(id % 40) as VERTEX_SEQ",
    )


def test_a_place_shared_by_most_events_is_split(spark, points):
    events = spark.range(60_000, numPartitions=8).selectExpr(
        "id", "if(id % 3 < 2, '007', lpad(string(id % 200), 3, '0')) as ROUTEID",
        "if(id % 3 < 2, 5d, id % 91 / 3d) as LON", "1.5d as LAT", "repeat('x', 50) as note",
    )
    with settings(spark, **SMALL):
        out = loc.locate(events, ix.build_index(rt.segments(points, dense=True), depth=1))
        rows, plan = executed(out)
    assert "skew=true" in plan
    assert len(rows) == 60_000
    assert len({(r.MVAL, r.DIST_TO_LRS) for r in rows if r.ROUTEID == "007" and r.LON == 5.0}) == 1


def test_a_hot_route_is_spread_over_salts_at_the_top(spark, points):
    places = spark.range(40_000).selectExpr("'007' as route", "id / 1000d as x", "id % 13 as y").withColumn(
        "y", F.col("y").cast("double")
    )
    with settings(spark, **SMALL, adaptive__coalescePartitions__enabled="false"):
        index = ix.build_index(rt.segments(points, dense=True), depth=1)
        per_task = ix.descend(places, index).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) >= 40_000
    assert len(per_task) >= 4
    assert max(r["count"] for r in per_task) < 0.6 * sum(r["count"] for r in per_task)


def test_a_long_route_is_cut_for_the_segment_window(spark):
    n = 5 * (1 << rt.BLOCK_BITS)
    line = spark.range(n).selectExpr(
        "'a' as ROUTEID", "0d as LAT", "double(id) as LON", "0d as MVAL", "int(id) as VERTEX_SEQ"
    )
    with settings(spark, shuffle__partitions="16", adaptive__coalescePartitions__enabled="false"):
        per_task = rt.segments(line).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == n - 1
    assert len(per_task) >= 3


def test_long_routes_are_spread_in_the_anti_join(spark):
    n = 6 * (1 << rt.BLOCK_BITS)
    table = spark.range(n).selectExpr("if(id % 9 = 0, 'b', 'a') as ROUTEID", "int(id) as VERTEX_SEQ")
    ids = spark.createDataFrame([("b",)], ["ROUTEID"])
    with settings(spark, **SMALL, adaptive__coalescePartitions__enabled="false"):
        kept = rt.join_ids(table, ids, "left_anti")
        per_task = kept.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == table.where("ROUTEID = 'a'").count()
    assert len(per_task) >= 3


def test_a_hot_route_is_salted_by_its_places(spark, points, monkeypatch):
    places = spark.range(20_000).selectExpr("if(id % 5 = 0, '003', '007') as route", "id / 500d as x", "double(id % 13) as y")
    index = ix.build_index(rt.segments(points, dense=True), depth=1)
    want = {tuple(r) for r in loc.nearest_on_route(places, index).collect()}
    monkeypatch.setattr(ix, "HOT_PLACES", 2_000)
    with settings(spark, **SMALL):
        found, by = ix.candidates(places, index)
        salts = {r.route: r.n for r in found.groupBy("route").agg(F.countDistinct("_salt").alias("n")).collect()}
        got = {tuple(r) for r in loc.nearest_on_route(places, index).collect()}
    assert salts == {"003": 2, "007": 8} and by == ["route", "x", "y", "_salt"]
    assert got == want and len(got) == 20_000
