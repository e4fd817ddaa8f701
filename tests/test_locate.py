import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainage.contract import ColumnMap, ContractError
from chainage.functions.projection import GEOGRAPHIC, LAMBERT_WKT
from chainage.operators import index as ix
from chainage.operators import locate as loc
from chainage.operators import routes as rt
from chainage.operators.project import project

# Vertices stated by the published test cases, (easing, northing, measure).
ROUTE_1 = [(-2191377.9268, 602211.7360, 0.0), (-2191367.4396, 602215.7183, 0.0111),
           (-2171959.2450, 603642.3114, 27.37)]
ROUTE_2 = [(-2190936.8996, 593568.9883, 0.0), (-2190911.0422, 593544.8700, 0.03536)]


def located(events, points, **how):
    index = ix.build_index(rt.segments(points))
    return {r.id: r for r in loc.locate(events, index, **how).collect()}


def brute(x, y, line):
    """Least (distance, segment number) and its measure, in NumPy."""
    v = np.asarray(line, float)
    x0, y0, m0 = v[:-1].T
    dx, dy, dm = (v[1:] - v[:-1]).T
    l2 = dx * dx + dy * dy
    t = np.where(l2 == 0, 0, np.clip(((x - x0) * dx + (y - y0) * dy) / np.where(l2 == 0, 1, l2), 0, 1))
    d = np.sqrt((x - x0 - t * dx) ** 2 + (y - y0 - t * dy) ** 2)
    i = int(np.argmin(d))
    return d[i], m0[i] + t[i] * dm[i]


def test_golden_cases(make_points, make_events):
    points = make_points({"01001": ROUTE_1, "01002": ROUTE_2})
    events = make_events(
        [(1, "01001", *ROUTE_1[0][:2]), (2, "01001", *ROUTE_1[1][:2]), (3, "01001", *ROUTE_1[2][:2]),
         (4, "01001", -2100000, 500000), (5, "01002", *ROUTE_2[0][:2]), (6, "01002", *ROUTE_2[1][:2])]
    )
    got = located(events, points)
    for key, m in {1: 0, 2: 0.0111, 3: 27.37, 5: 0, 6: 0.03536}.items():
        assert got[key].MVAL == pytest.approx(m, abs=1e-3)
        assert got[key].DIST_TO_LRS == pytest.approx(0, abs=1e-3)
    assert got[4].DIST_TO_LRS >= 1000 and got[4].MVAL is not None


def test_special_shapes(make_points, make_events):
    points = make_points(
        {
            "zero": [(0, 0, 1), (0, 0, 2), (10, 0, 3)],
            "vertical": [(0, 0, 0), (0, 10, 1)],
            "single": [(0, 0, 0)],
            "cross": [(0, 0, 0), (10, 10, 1), (10, 0, 2), (0, 10, 3)],
        }
    )
    events = make_events(
        [(1, "zero", -1, 0), (2, "vertical", 3, 5), (3, "single", 0, 0), (4, "cross", 5, 5), (5, "none", 0, 0)]
    )
    got = located(events, points)
    assert sorted(got) == [1, 2, 4]
    assert (got[1].MVAL, got[1].DIST_TO_LRS) == (1, 1)
    assert (got[2].MVAL, got[2].DIST_TO_LRS) == (0.5, 3)
    # the two legs tie; the lower vertex number wins
    assert (got[4].MVAL, got[4].DIST_TO_LRS) == (0.5, 0)


def test_unmatched_and_null_coordinates(make_points, make_events):
    points = make_points({"a": [(0, 0, 5), (10, 0, 6)]})
    events = make_events([(1, "a", None, 1), (2, "x", 0, 0), (3, None, 0, 0), (4, "a", 5, 2), (5, "x", None, None)])
    dropped = located(events, points)
    assert sorted(dropped) == [1, 4]
    assert (dropped[1].MVAL, dropped[1].DIST_TO_LRS) == (None, None)
    kept = located(events, points, unmatched="keep", matched_flag="HIT")
    assert [kept[k].MVAL for k in (1, 2, 3, 4, 5)] == [0, 0, 0, 5.5, 0]
    # Without coordinates there is no distance, so nothing was matched.
    assert [kept[k].HIT for k in (1, 2, 3, 4, 5)] == [False, False, False, True, False]
    assert kept[2].DIST_TO_LRS is None


def test_old_results_are_replaced_and_other_columns_kept(make_points, make_events):
    points = make_points({"a": [(0, 0, 5), (10, 0, 6)]})
    events = make_events([(1, "a", 5, 2)]).selectExpr("9d as MVAL", "*", "8d as OFFSET", "'p' as note")
    names = ColumnMap(distance="OFFSET")
    out = loc.locate(events, ix.build_index(rt.segments(points)), names)
    assert out.columns == ["id", "ROUTEID", "LAT", "LON", "note", "MVAL", "OFFSET"]
    assert tuple(out.first())[-3:] == ("p", 5.5, 2)


def test_repeated_events_stay_repeated(make_points, make_events):
    points = make_points({"a": [(0, 0, 5), (10, 0, 6)]})
    events = make_events([(1, "a", 5, 2)] * 3 + [(2, "a", 5, 2)])
    out = loc.locate(events, ix.build_index(rt.segments(points)))
    assert sorted(r.id for r in out.collect()) == [1, 1, 1, 2]


@pytest.mark.parametrize(("seed", "depth"), [(1, None), (2, 1), (3, 2), (4, 3), (5, 4)])
def test_equals_brute_force_at_any_depth(spark, make_points, make_events, seed, depth):
    rng = np.random.default_rng(seed)
    routes = {}
    for name, n in (("walk", 2500), ("short", 3), ("curl", 900)):
        if name == "curl":
            a = np.linspace(0, 60, n)
            xy = np.c_[a * np.cos(a), a * np.sin(a)]
        else:
            xy = np.cumsum(rng.normal(0, 5, (n, 2)), axis=0)
        routes[name] = [(x, y, i * 0.1) for i, (x, y) in enumerate(xy)]
    rows = []
    for i in range(300):
        name = ("walk", "short", "curl")[i % 3]
        x, y, _ = routes[name][rng.integers(len(routes[name]))]
        far = 10 ** rng.uniform(-3, 4)
        rows.append((i, name, x + rng.normal(0, far), y + rng.normal(0, far)))
    index = ix.build_index(rt.segments(make_points(routes)), depth=depth)
    got = {r.id: r for r in loc.locate(make_events(rows), index).collect()}
    for key, name, x, y in rows:
        d, m = brute(x, y, routes[name])
        assert got[key].DIST_TO_LRS == pytest.approx(d, abs=1e-9, rel=1e-12)
        assert got[key].MVAL == pytest.approx(m, abs=1e-9)


def test_index_depth_and_row_sizes(spark):
    line = spark.range(3 * (1 << rt.BLOCK_BITS)).selectExpr(
        "'a' as ROUTEID", "0d as LAT", "double(id) as LON", "double(id) as MVAL", "int(id) as VERTEX_SEQ"
    )
    segments = rt.segments(line, dense=True)
    assert ix.index_depth(segments) == 3
    index = ix.build_index(segments)
    sizes = [level.agg(F.max(F.size("boxes")), F.count("*")).first() for level in index.levels]
    assert [s[0] for s in sizes] == [24, 16, 16]
    assert [s[1] for s in sizes] == [1, 24, 384]
    events = spark.createDataFrame([(1, "a", 4.0, 70000.25)], "id int, ROUTEID string, LAT double, LON double")
    assert tuple(loc.locate(events, index).first())[-2:] == (70000.25, 4.0)


def test_shortest_line_then_boxes(make_points, make_events):
    points = make_points({"a": [(0, 0, 0), (10, 0, 1), (10, 10, 2)], "b": [(0, 0, 0), (0, 0, 1)]})
    index = ix.build_index(rt.segments(points))
    lines = loc.shortest_line(make_events([(1, "a", 12, 0), (2, "a", 5, 3), (3, "b", 1, 0)]), index)
    placed = {r.id: (r.CLOSEST_LON, r.CLOSEST_LAT, r.DIST_TO_LRS) for r in lines.collect()}
    assert placed == {1: (10, 0, 2), 2: (5, 0, 3), 3: (0, 0, 1)}
    boxes = sorted((r.id, r.VERTEX_SEQ, r.M_AT) for r in loc.box_candidates(lines, index).collect() if r.id != 3)
    assert boxes == [(1, 0, 1.0), (1, 1, 1.0), (2, 0, 0.5)]
    (no_length,) = [r for r in loc.box_candidates(lines, index).collect() if r.id == 3]
    assert no_length.M_AT is None


def test_line_candidates_equal_the_two_steps(make_points, make_events):
    line = [(i % 5, i // 5, i / 10) for i in range(60)]
    index = ix.build_index(rt.segments(make_points({"a": line, "b": [(0, 0, 0), (0, 0, 1)]})), depth=1)
    events = [(i, "ab?"[i % 7 % 3], (i % 13) / 2, (i % 17) / 2) for i in range(40)]
    events += [(90, "a", None, 1), (91, None, 1, 1), (92, "a", math.nan, 0), events[3], events[3], (93, "a", events[3][2], events[3][3])]
    given = make_events(events)
    steps = loc.box_candidates(loc.shortest_line(given, index), index)
    once = loc.line_candidates(given, index)
    assert sorted(once.columns) == sorted(steps.columns)
    assert sorted(map(repr, once.select(*steps.columns).collect())) == sorted(map(repr, steps.collect()))
    assert once.count() > len(events) and loc.line_candidates(given.limit(0), index).count() == 0


def test_calculate_m_value_projects_and_keeps_the_input_coordinates(make_points, make_events, spark):
    points = make_points({"01001": ROUTE_1})
    grid = make_events([(1, "01001", *ROUTE_1[1][:2])])
    degrees = project(grid, LAMBERT_WKT, GEOGRAPHIC)
    names = ColumnMap("LINKID", "Y", "X", "KM", "OFF")
    asked = degrees.withColumnsRenamed({"ROUTEID": "LINKID", "LAT": "Y", "LON": "X"})
    row = loc.calculate_m_value(asked, points, names).first()
    assert row.KM == pytest.approx(0.0111, abs=1e-6) and row.OFF == pytest.approx(0, abs=1e-3)
    assert row.X == asked.first().X
    on_grid = loc.calculate_m_value(asked, points, names, output_crs="working").first()
    assert on_grid.X == pytest.approx(ROUTE_1[1][0], abs=1e-4)
    assert on_grid.KM == pytest.approx(row.KM)
    with pytest.raises(ContractError, match="no rows"):
        loc.calculate_m_value(asked.withColumn("LINKID", F.lit("x")), points, names, strict=True)
    with pytest.raises(ContractError, match="unsupported CRS"):
        loc.calculate_m_value(asked, points, names, crs="EPSG:3857")


def test_impossible_and_signed_zero_coordinates(make_points, make_events):
    points = make_points({"a": [(0, 0, 5), (10, 0, 6)]})
    events = [(1, "a", math.nan, 0), (2, "a", 0, math.inf), (3, "a", -1e200, 0), (4, "a", -0.0, 0.0), (5, "a", 0.0, -0.0)]
    got = located(make_events(events), points)
    assert [got[k].MVAL for k in (1, 2, 3, 4, 5)] == [None, None, None, 5, 5]
