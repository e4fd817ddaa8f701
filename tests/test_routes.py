import pytest
from pyspark.sql import functions as F

from chainage.contract import ContractError
from chainage.operators import routes as rt

LINE = [(0, 0, 0.0), (10, 0, 1.0), (10, 5, 1.5), (20, 5, 2.5)]


def as_dicts(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def test_segments_pair_each_vertex_with_the_next(make_points):
    out = rt.segments(make_points({"a": LINE, "b": LINE[:1]}))
    assert out.columns == [
        "ROUTEID", "LON", "LAT", "MVAL", "VERTEX_SEQ", "LON1", "LAT1", "MVAL1", "mvgradient", "c",
    ]
    rows = as_dicts(out, "ROUTEID", "VERTEX_SEQ")
    assert [(r["LON"], r["LON1"], r["MVAL1"]) for r in rows] == [(0, 10, 1.0), (10, 10, 1.5), (10, 20, 2.5)]
    # (LAT1 - LAT) / (LON - LON1), null on a vertical segment
    assert [r["mvgradient"] for r in rows] == [0, None, 0]
    assert [r["c"] for r in rows] == [0, None, 5]


@pytest.mark.parametrize("dense", [True, False])
def test_segments_across_block_borders(spark, dense):
    n = 2 * (1 << rt.BLOCK_BITS) + 3
    line = spark.range(n).selectExpr(
        "'a' as ROUTEID", "double(id % 7) as LAT", "double(id) as LON", "id / 10d as MVAL", "int(id) as VERTEX_SEQ"
    )
    got = rt.segments(line, dense=dense).agg(
        F.count("*"), F.sum(F.col("LON1") - F.col("LON")), F.countDistinct("VERTEX_SEQ"), F.max("LON1")
    )
    assert tuple(got.first()) == (n - 1, n - 1.0, n - 1, n - 1.0)


def test_segments_with_gaps_in_the_numbering(spark):
    seqs = [-40000, -3, 5, 32768, 32770, 200000, 2**31 - 1]
    line = spark.createDataFrame(
        [(0.0, float(i), float(i), s, "a") for i, s in enumerate(seqs)],
        "LAT double, LON double, MVAL double, VERTEX_SEQ int, ROUTEID string",
    )
    rows = rt.segments(line).orderBy("VERTEX_SEQ").collect()
    assert [(r.VERTEX_SEQ, r.LON1 - r.LON) for r in rows] == [(s, 1.0) for s in seqs[:-1]]


@pytest.mark.parametrize("missing", ["id <> 32768", "not id between 32700 and 32800", "id > 100000 or id < 10"])
def test_broken_promise_of_dense_numbering_raises(spark, missing):
    line = spark.range(100_100).where(missing).selectExpr(
        "'a' as ROUTEID", "0d as LAT", "double(id) as LON", "0d as MVAL", "int(id) as VERTEX_SEQ"
    )
    with pytest.raises(Exception, match="VERTEX_SEQ has gaps"):
        rt.segments(line, dense=True).collect()


def test_path_borders_join_or_break(make_points):
    points = make_points({"a": LINE}).withColumn("PATH_SEQ", F.expr("VERTEX_SEQ div 2").cast("int"))
    assert rt.segments(points).count() == 3
    assert [r.VERTEX_SEQ for r in rt.segments(points, by_path=True).orderBy("VERTEX_SEQ").collect()] == [0, 2]
    with pytest.raises(ContractError):
        rt.segments(make_points({"a": LINE}), by_path=True)


def test_linestrings_and_text(make_points):
    lines = rt.with_has_m(rt.with_wkt(rt.linestrings(make_points({"a": LINE[:2]})), decimals=1))
    row = lines.first()
    assert row.wkt == "LINESTRING ZM (0.0 0.0 0 0.0, 10.0 0.0 0 1.0)"
    assert (row.PART, row.n_vertices, row.has_m) == (0, 2, True)


def test_a_very_long_line_continues_in_parts(spark, monkeypatch):
    monkeypatch.setattr(rt, "LINE_BITS", 3)
    line = spark.range(20).selectExpr(
        "'a' as ROUTEID", "0d as LAT", "double(id) as LON", "0d as MVAL", "int(id) as VERTEX_SEQ"
    )
    parts = rt.linestrings(line).orderBy("PART").collect()
    assert [p.n_vertices for p in parts] == [8, 8, 4]
    assert [p.vertices[-1]["VERTEX_SEQ"] for p in parts] == [8, 16, 19]
    assert [p.vertices[0]["VERTEX_SEQ"] for p in parts] == [0, 8, 16]


def test_route_filters(spark, make_points):
    points = make_points({"a": LINE, "b": LINE, "c": LINE})
    assert rt.only_routes(points, "a").count() == 4
    assert rt.only_routes(points, ["a", "c", "x"]).count() == 8
    ids = spark.createDataFrame([("b",), ("b",)], "ROUTEID string")
    assert rt.only_routes(points, ids).count() == 4
    many = [f"r{i}" for i in range(rt.MAX_IN_LIST)] + ["a"]
    assert rt.only_routes(points, many).count() == 4


def test_duplicate_vertices_are_listed(make_points):
    points = make_points({"a": LINE})
    assert rt.duplicate_vertices(points).count() == 0
    assert rt.duplicate_vertices(rt.union_sources(points, points)).count() == 4
