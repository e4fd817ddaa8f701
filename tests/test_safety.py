"""What must not happen: lost or mixed rows in a store, other people's columns overwritten."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chainage.contract import ColumnMap, ContractError
from chainage.operators import locate as loc
from chainage.operators import routes as rt
from chainage.operators.index import build_index
from chainage.plans.store import RouteStore

LINE = [(0, 0, 0), (10, 0, 10), (10, 10, 20)]


def names_of(points) -> set:
    return {r[0] for r in points.select("ROUTEID").distinct().collect()}


def test_a_store_keeps_its_number_of_buckets(spark, make_points, tmp_path):
    root = str(tmp_path / "store")
    routes = {f"r{i}": LINE for i in range(12)}
    RouteStore(spark, root, buckets=4).publish(make_points(routes), date(2024, 1, 1))
    assert RouteStore(spark, root).latest(["r0"]).points.count() == 3
    assert RouteStore(spark, root).publish(make_points(routes), date(2024, 1, 2)) == 2
    assert RouteStore(spark, root).latest().points.count() == 36
    with pytest.raises(ContractError, match="4 buckets"):
        RouteStore(spark, root, buckets=3).publish(make_points(routes))
    with pytest.raises(ContractError, match="4 buckets"):
        RouteStore(spark, root, buckets=64).latest()


def test_a_store_is_one_catalog_however_it_is_spelt(spark, make_points, tmp_path):
    root = str(tmp_path / "store")
    RouteStore(spark, root).publish(make_points({"a": LINE}), date(2024, 1, 1))
    RouteStore(spark, f"file:{root}").publish(make_points({"b": LINE}), date(2024, 2, 1))
    store = RouteStore(spark, root)
    assert names_of(store.latest().points) == {"a", "b"}
    ends = {r.VERSION: r.END_DATE for r in store.catalog().collect()}
    assert ends == {1: date(2024, 2, 1), 2: None}
    for r in store.catalog().collect():
        assert names_of(store.listed("points", r.LRS_POINT_FILE)) == {1: {"a"}, 2: {"a", "b"}}[r.VERSION]
        assert names_of(store.listed("segments", r.LRS_SEGMENT_FILE)) == {1: {"a"}, 2: {"a", "b"}}[r.VERSION]


def test_versions_neither_go_back_in_time_nor_double(spark, make_points, tmp_path, monkeypatch):
    store = RouteStore(spark, str(tmp_path / "store"))
    store.publish(make_points({"a": LINE}), date(2024, 2, 1))
    with pytest.raises(ContractError, match="before"):
        store.publish(make_points({"a": LINE}), date(2024, 1, 1))
    late = RouteStore(spark, store.root)
    monkeypatch.setattr(late, "_rows", lambda: store._rows().where("false"))
    with pytest.raises(ContractError, match="another publish"):
        late.publish(make_points({"b": LINE}), date(2024, 3, 1))
    assert names_of(store.latest().points) == {"a"}


def test_own_columns_stay_and_matched_needs_a_distance(spark, make_points):
    index = build_index(rt.segments(make_points({"1": LINE}), dense=True, with_block=True))
    rows = [(1, "1", 3.0, 1.0), (2, "1", None, None), (3, "2", 1.0, 1.0)]
    own = ["m", "dist", "hit", "cx", "cy", "_x", "x", "y", "route", "node", "_place", "_own", "a.b"]
    events = spark.createDataFrame(rows, "id int, ROUTEID string, X double, Y double")
    events = events.select("*", *[F.lit(c).alias(c) for c in own if c not in ("x", "y")])
    names = ColumnMap(lon="X", lat="Y")
    got = {r["id"]: r for r in loc.locate(events, index, names, unmatched="keep", matched_flag="FOUND").collect()}
    assert [got[i]["FOUND"] for i in (1, 2, 3)] == [True, False, False]
    assert (got[1]["MVAL"], got[1]["DIST_TO_LRS"], got[1]["Y"]) == (3.0, 1.0, 1.0)
    assert all(r[c] == c for r in got.values() for c in own if c not in ("x", "y"))
    lines = loc.shortest_line(events, index, names)
    found = loc.box_candidates(lines, index, names).collect()
    assert [(r["id"], r["X"], r["Y"], r["route"], r["M_AT"]) for r in found] == [(1, 3.0, 1.0, "route", 3.0)]


def test_decimal_route_ids_are_whole_numbers(spark, make_points):
    index = build_index(rt.segments(make_points({"540182": LINE}), dense=True, with_block=True))
    events = spark.createDataFrame([(Decimal("540182.00"), 1.0, 3.0)], "ROUTEID decimal(12,2), LAT double, LON double")
    assert loc.locate(events, index).count() == 1
    odd = spark.createDataFrame([(Decimal("1.50"), 1.0, 3.0)], "ROUTEID decimal(12,2), LAT double, LON double")
    with pytest.raises(Exception, match="fractional"):
        loc.locate(odd, index).collect()


def test_measure_of_a_route_is_told_for_all_its_parts(spark, make_points):
    points = make_points({"a": [(i, 0, i) for i in range(20)]})
    bare = points.withColumn("MVAL", F.when(F.col("VERTEX_SEQ") == 9, 1.0))
    lines = rt.with_has_m(rt.linestrings(bare, bits=3))
    assert [r.has_m for r in lines.collect()] == [True] * 3
    assert rt.route_has_m(bare).collect() == [("a", True)]
    assert rt.route_has_m(bare.withColumn("MVAL", F.lit(None).cast("double"))).collect() == [("a", False)]


def test_scratch_needs_a_shared_folder():
    from chainage.plans.scratch import scratch_dir

    class Bare:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="executors share"):
        scratch_dir(Bare, "x")
