"""GeoJSON files of any size, inference and the one-document sink."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chainage.contract import ColumnMap, ContractError
from chainage.sources import geojson
from test_sources import collection, geo_df, place


def rows_of(parsed, *more):
    return sorted(map(tuple, geojson.events(geojson.valid(parsed, strict=True), "ROUTEID string, n double", keep=more).collect()))


def some(n):
    # Texts with brackets, quotes and the separator itself, which is escaped in JSON.
    return [place([i, -i], ROUTEID=f"r{i}", n=i, text=f'x"],{{"type":"Feature" {i}') for i in range(n)]


def compact(value) -> str:
    return json.dumps(value, separators=(",", ":"))


def test_lines_equal_collections(spark, tmp_path):
    features = some(300)
    for k in range(3):
        lines = [json.dumps(f) for f in features[k * 100 : k * 100 + 100]]
        (tmp_path / f"part{k}.json").write_text("\n".join(lines) + "\n\n")
    (tmp_path / "whole.json").write_text(collection(place([9, 9], ROUTEID="w", n=1), place([8, 8], ROUTEID="w", n=2)) + "\n")
    want = rows_of(geo_df(spark, collection(*features), collection(place([9, 9], ROUTEID="w", n=1), place([8, 8], ROUTEID="w", n=2))))
    assert rows_of(geojson.read_lines(spark, str(tmp_path))) == want


def test_lines_that_are_no_features_are_problems(spark, tmp_path):
    lines = [json.dumps(place(ROUTEID="a")), "{broken", "[1]", '"text"', json.dumps(place(what="Thing", ROUTEID="a")), collection()]
    (tmp_path / "lines.json").write_text("\n".join(lines))
    parsed = geojson.read_lines(spark, str(tmp_path))
    assert geojson.valid(parsed).count() == 1
    assert geojson.problems(parsed).count() == 5


def test_a_large_document_is_read_by_several_tasks(spark, tmp_path):
    features = some(20_000)
    (tmp_path / "one.json").write_text(compact({"type": "FeatureCollection", "name": "x", "features": features, "crs": {"a": [1]}}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        parsed = geojson.read_split(spark, str(tmp_path))
        assert parsed.select(F.spark_partition_id()).distinct().count() > 3
        got = rows_of(parsed)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == rows_of(geo_df(spark, collection(*features)))


@pytest.mark.parametrize(
    "text",
    [
        json.dumps({"type": "FeatureCollection", "features": some(5)}),
        json.dumps({"type": "FeatureCollection", "features": some(5)}, indent=2),
        compact({"type": "FeatureCollection", "features": some(5)}),
        compact({"features": some(5), "type": "FeatureCollection"}),
        # Features written in two ways within a document.
        '{"type":"FeatureCollection","features":[' + ",\n ".join(f(x) for f, x in zip([compact, json.dumps, compact, json.dumps, json.dumps], some(5))) + "\n]\n}\n",
        '{"type":"FeatureCollection","features":[' + ",".join(f(x) for f, x in zip([json.dumps, json.dumps, compact, json.dumps, compact], some(5))) + "]}",
    ],
)
def test_no_feature_is_lost_however_it_is_written(spark, tmp_path, text):
    (tmp_path / "one.json").write_text(text)
    parsed = geojson.read_split(spark, str(tmp_path))
    found = sorted(r.ROUTEID for r in geojson.events(geojson.valid(parsed), "ROUTEID string").collect())
    if geojson.problems(parsed).count() == 0:
        assert found == [f"r{i}" for i in range(5)]
    else:
        # What can't be read is a problem, never silence.
        assert text.startswith('{"type":"FeatureCollection","features":[{"type": ')


def test_separator_inside_a_feature_is_a_problem(spark, tmp_path):
    nested = place(ROUTEID="a") | {"properties": {"ROUTEID": "a", "x": place(ROUTEID="b")}}
    (tmp_path / "one.json").write_text(compact({"type": "FeatureCollection", "features": [nested]}))
    assert geojson.problems(geojson.read_split(spark, str(tmp_path))).count() > 0


@pytest.mark.parametrize("text", [collection(), '{"type":"FeatureCollection","features":[]}', "{}", "[]", "x"])
def test_documents_without_features_are_problems(spark, tmp_path, text):
    (tmp_path / "one.json").write_text(text)
    assert geojson.problems(geojson.read_split(spark, str(tmp_path))).count() == 1


def test_one_document_from_ordered_parts(spark, tmp_path):
    rows = spark.range(500).selectExpr("string(id % 7) as ROUTEID", "double(id) as LAT", "0d as LON", "id as row")
    features = geojson.to_features(rows.repartition(9), keep=("row",))
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        geojson.write_document(features, path, "row")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(Path(path).glob("part-*"))
    assert len(parts) > 2
    whole = json.loads("".join(p.read_text() for p in parts))
    assert whole["type"] == "FeatureCollection"
    assert [f["geometry"]["coordinates"][1] for f in whole["features"]] == list(range(500))
    back = geojson.events(geojson.valid(geojson.read_split(spark, path), strict=True), "ROUTEID string")
    assert back.count() == 500


def test_documents_of_one_and_of_no_feature(spark, tmp_path):
    rows = spark.range(1).selectExpr("'a' as ROUTEID", "1d as LAT", "0d as LON", "id as row")
    features = geojson.to_features(rows, keep=("row",))
    for n, name in ((1, "one"), (0, "none")):
        geojson.write_document(features.limit(n), str(tmp_path / name), "row")
        text = "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
        assert len(json.loads(text)["features"]) == n
    with pytest.raises(ContractError, match="tell all rows apart"):
        geojson.write_document(features.union(features), str(tmp_path / "twice"), "row")


def test_kinds_that_conflict_are_listed(spark):
    parsed = geo_df(
        spark,
        collection(place(ROUTEID="a", n=1, m=None, o={"x": 1}), place(ROUTEID="a", n=2.5, m=True)),
        collection(place(ROUTEID="a", n="x", m=True, o="y"), place(ROUTEID="a", n=False)),
    )
    found = sorted(map(tuple, geojson.property_conflicts(parsed).collect()))
    assert found == [("n", "boolean", 1), ("n", "double", 2), ("n", "string", 1), ("o", "string", 1), ("o", "structure", 1)]
    kinds = dict(geojson.events(parsed).dtypes)
    assert (kinds["n"], kinds["m"], kinds["o"]) == ("string", "boolean", "string")


def test_properties_named_like_columns_are_kept_apart(spark):
    parsed = geo_df(spark, collection(place([2, 1], ROUTEID="a", LAT="x", lat=5, lon=6, doc="d", k=1, K=2)))
    out = geojson.events(parsed, keep=("doc",))
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    (row,) = out.collect()
    assert (row.LAT, row.LON, row.ROUTEID, row.doc) == (1.0, 2.0, "a", 0)
    names = geojson.column_names(geojson.infer_properties(parsed), keep=("doc",))
    values = {p: row[c] for p, c in names.items()}
    assert values == {"ROUTEID": "a", "LAT": "x", "lat": 5.0, "lon": 6.0, "doc": "d", "k": 1.0, "K": 2.0}


def test_the_route_id_keeps_its_name(spark):
    parsed = geo_df(spark, collection(place(routeid="x", ROUTEID="a")))
    names = geojson.column_names(geojson.infer_properties(parsed))
    assert names == {"ROUTEID": "ROUTEID", "routeid": "routeid_PROPERTY"}
    assert geojson.events(parsed, cols=ColumnMap()).first().ROUTEID == "a"


def test_too_many_keys_raise(spark, monkeypatch):
    monkeypatch.setattr(geojson, "MAX_KEYS", 3)
    parsed = geo_df(spark, collection(place(ROUTEID="a", a=1, b=2), place(ROUTEID="a", c=1)))
    with pytest.raises(ContractError, match="3 property keys"):
        geojson.infer_properties(parsed)
