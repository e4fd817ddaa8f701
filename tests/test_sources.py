import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chainage.contract import ColumnMap, ContractError
from chainage.functions.projection import GEOGRAPHIC, LAMBERT_WKT
from chainage.operators.project import project
from chainage.sources import esri, geojson, landing, tables

WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]'


def payload(*features, **reference):
    return json.dumps({"spatialReference": reference or {"wkt": LAMBERT_WKT}, "features": features})


def feature(paths, **attributes):
    return {"geometry": {"hasM": True, "paths": paths}, "attributes": attributes}


def esri_df(spark, *texts):
    return esri.features(spark.createDataFrame([(t,) for t in texts], ["payload"]))


def test_paths_join_and_ordinates_fill_up(spark):
    page = payload(
        feature([[[110.0, -7.0, 0, 0], [110.1, -7.1, 10, 1]], [[1, 2]], []], LINKID="a", SK_LENGTH=1.5),
        feature([[[5, 6, 7]]], LINKID="b"),
    )
    rows = esri.points(esri_df(spark, page), with_path=True).orderBy("ROUTEID", "VERTEX_SEQ").collect()
    assert [tuple(r) for r in rows] == [
        (-7.0, 110.0, 0.0, 0, "a", 0), (-7.1, 110.1, 10.0, 1, "a", 0), (2.0, 1.0, 0.0, 2, "a", 1),
        (6.0, 5.0, 7.0, 0, "b", 0),
    ]
    assert esri.points(esri_df(spark, page)).columns == ["LAT", "LON", "MVAL", "VERTEX_SEQ", "ROUTEID"]


@pytest.mark.parametrize(
    ("page", "reason"),
    [
        (payload(feature([], LINKID="a")), "paths"),
        (payload(feature([[]], LINKID="a")), "paths"),
        (payload(feature([[], None], LINKID="a")), "paths"),
        (payload(feature([[[1, 2, 3]]], LINKID=5)), "LINKID"),
        (payload(feature([[[1, 2, 3]]])), "LINKID"),
        (payload(feature([[[1, 2, 3]]], LINKID="a"), wkt="", wkt2=""), "wkt"),
        (payload(feature([[[1, 2, 3]]], LINKID="a"), wkt='PROJCS["Other"]'), "CRS"),
        ("not json", "not readable"),
    ],
)
def test_bad_features_fail_or_are_set_aside(spark, page, reason):
    good = payload(feature([[[1, 2, 3]]], LINKID="ok"), wkt2=LAMBERT_WKT)
    parsed = esri_df(spark, page, good)
    with pytest.raises(Exception, match="cannot become a route"):
        esri.points(parsed).collect()
    assert [r.ROUTEID for r in esri.points(parsed, mode="skip").collect()] == ["ok"]
    (row,) = esri.rejected(parsed).collect()
    assert reason in row.problem


def test_geographic_routes_are_projected(spark):
    row = esri.points(esri_df(spark, payload(feature([[[95.4, 5.6, 1]]], LINKID="a"), wkt=WGS84))).first()
    degrees = spark.createDataFrame([(5.6, 95.4)], "LAT double, LON double")
    want = project(degrees, GEOGRAPHIC, LAMBERT_WKT).first()
    assert (row.LON, row.LAT, row.MVAL) == (want.LON, want.LAT, 1.0)


def test_landed_files_are_read_whole(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"page{i}.json").write_text(payload(feature([[[i, 0, 0], [i, 1, 1]]], LINKID=f"r{i}")))
    pages = esri.read_payloads(spark, str(tmp_path))
    assert esri.points(esri.features(pages)).count() == 6


def test_active_routes(spark):
    df = spark.createDataFrame(
        [("a", None, None, "N"), ("b", "2020-01-01", None, "N"), ("c", "2030-01-01", None, "N"),
         ("d", None, "2021-01-01", "N"), ("e", None, None, "X")],
        "RouteId string, f string, t string, ROAD_STATUS string",
    ).selectExpr("RouteId", "cast(f as timestamp) FROMDATE", "cast(t as timestamp) TODATE", "ROAD_STATUS")
    active = landing.active_routes(df, "2024-01-01")
    assert sorted(r.RouteId for r in active.collect()) == ["a", "b"]
    assert [r.RouteId for r in landing.active_routes(df, "2024-01-01", ["b", "c"]).collect()] == ["b"]


def test_landing_check_finds_missing_and_short_pages(spark):
    landed = spark.createDataFrame([(0,)] * 4 + [(8,)] * 1, ["offset"])
    found = landing.landing_check(landed, 10, 4).orderBy("offset").collect()
    assert [tuple(r) for r in found] == [(4, 4, 0), (8, 2, 1)]


def collection(*features, kind="FeatureCollection"):
    return json.dumps({"type": kind, "features": list(features)})


def place(coordinates=(95.3588172, 5.5072984), kind="Point", what="Feature", **properties):
    return {"type": what, "geometry": {"type": kind, "coordinates": coordinates}, "properties": properties}


def geo_df(spark, *texts):
    return geojson.features(spark.createDataFrame(list(enumerate(texts)), ["doc", "document"]))


def test_events_with_inferred_columns(spark):
    doc = collection(
        place(ROUTEID="01002", n=290, flag=True, mixed=1, none=None),
        place(ROUTEID="01002", n=2.5, mixed="a", extra="x"),
    )
    out = geojson.events(geo_df(spark, doc))
    assert out.columns == ["LAT", "LON", "ROUTEID", "extra", "flag", "mixed", "n", "none"]
    assert dict(out.dtypes)["n"] == "double" and dict(out.dtypes)["flag"] == "boolean"
    first = out.where("extra is null").first()
    assert tuple(first) == (5.5072984, 95.3588172, "01002", None, True, "1", 290.0, None)


def test_route_property_must_exist(spark):
    with pytest.raises(ContractError, match="'LINKID' not found"):
        geojson.events(geo_df(spark, collection(place(name="t"))), cols=ColumnMap(route_id="LINKID"))


@pytest.mark.parametrize(
    ("doc", "index", "reason"),
    [
        (collection(kind="Feature"), None, "expected FeatureCollection"),
        (collection(), None, "no features"),
        ("[1", None, "expected FeatureCollection"),
        (collection(place(ROUTEID="a"), place(what="Thing", ROUTEID="a")), 1, "expected Feature type"),
        (collection(place([[1, 2], [3, 4]], "LineString", ROUTEID="a")), 0, "only Point"),
        (collection(place([1], ROUTEID="a")), 0, "at least 2 coordinates"),
        (collection(place(LINKID="a")), 0, "missing required ROUTEID"),
    ],
)
def test_structural_validation(spark, doc, index, reason):
    parsed = geo_df(spark, doc)
    (row,) = geojson.problems(parsed).collect()
    assert row.feature_index == index and reason in row.problem
    with pytest.raises(Exception, match=reason):
        geojson.valid(parsed, strict=True).collect()
    assert geojson.valid(parsed).count() == (1 if index == 1 else 0)


def test_a_null_route_property_is_present(spark):
    assert geojson.valid(geo_df(spark, collection(place(ROUTEID=None)))).count() == 1


def test_export_order_and_nulls(spark):
    df = spark.createDataFrame(
        [("01002", 5.5072984, 95.3588172, 1234.567, None, bytearray(b"raw"))],
        "ROUTEID string, LAT double, LON double, MVAL double, gone string, b binary",
    ).withColumn("day", F.current_date())
    got = json.loads(geojson.to_features(df).first().feature)
    assert got == place(ROUTEID="01002", MVAL=1234.567, b="raw") | {
        "geometry": {"type": "Point", "coordinates": [95.3588172, 5.5072984]}
    }
    with pytest.raises(Exception, match="null coordinate"):
        geojson.to_features(df.withColumn("LAT", F.lit(None).cast("double"))).collect()


def test_collections_answer_by_request(spark):
    rows = [(1, 1, '{"i":1}'), (1, 0, '{"i":0}'), (2, 0, '{"i":9}')]
    df = spark.createDataFrame(rows, ["doc", "feature_index", "feature"])
    answers = {r.doc: json.loads(r.document) for r in geojson.to_collections(df, "doc", "feature_index").collect()}
    assert answers[1] == {"type": "FeatureCollection", "features": [{"i": 0}, {"i": 1}]}
    assert len(answers[2]["features"]) == 1


def test_export_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, 2.5), ("b", 3.5, 4.5)], "ROUTEID string, LAT double, LON double")
    features = geojson.to_features(df).withColumns({"doc": F.lit(1), "feature_index": F.monotonically_increasing_id()})
    geojson.to_collections(features, "doc", "feature_index").select("document").write.text(str(tmp_path / "out"))
    back = geojson.events(geojson.features(geojson.read_collections(spark, str(tmp_path / "out"))))
    assert sorted(map(tuple, back.collect())) == [(1.5, 2.5, "a"), (3.5, 4.5, "b")]


def test_parquet_events_and_compaction(spark, tmp_path):
    source, target = str(tmp_path / "many"), str(tmp_path / "few")
    df = spark.range(1000).selectExpr("string(id) as LINKID", "1d as TO_STA_LAT", "2d as TO_STA_LONG")
    tables.write_table(df.repartition(20), source)
    tables.compact(spark, source, target)
    found, names = tables.read_events(spark, target)
    assert names == ColumnMap("LINKID", "TO_STA_LAT", "TO_STA_LONG")
    assert found.distinct().count() == 1000
    assert len(list(Path(target).glob("*.snappy.parquet"))) < 5
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_table(df, target)
