import pytest

from chainage.contract import ColumnMap, ContractError


def test_missing_columns_are_all_named(spark):
    df = spark.createDataFrame([(1.0,)], "LAT double")
    with pytest.raises(ContractError, match=r"\['ROUTEID', 'LON'\]"):
        ColumnMap().require(df)


def test_names_that_differ_only_in_case_are_refused(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "ROUTEID string, LAT double, LON double, lat double")
    with pytest.raises(ContractError, match="letter case"):
        ColumnMap().require(df)


@pytest.mark.parametrize(
    ("schema", "found"),
    [
        ("ROUTEID string, LAT double, LON double", ColumnMap()),
        ("LINKID string, TO_STA_LAT double, TO_STA_LONG double",
         ColumnMap(route_id="LINKID", lat="TO_STA_LAT", lon="TO_STA_LONG")),
        ("id string, route_id string, latitude double, lon double, m double, distance double",
         ColumnMap("route_id", "latitude", "lon", "m", "distance")),
        ("routeid string", ColumnMap()),
    ],
)
def test_alias_detection_is_ordered_and_case_sensitive(spark, schema, found):
    assert ColumnMap.detect(spark.createDataFrame([], schema)) == found


def test_explicit_names_override_detection_one_by_one(spark):
    df = spark.createDataFrame([], "LINKID string, KEY string, LAT double, LON double")
    assert ColumnMap.detect(df).route_id == "LINKID"
    mapped = ColumnMap.detect(df, route_id="KEY", m_value="KM", distance=None)
    assert (mapped.route_id, mapped.m_value, mapped.lat) == ("KEY", "KM", "LAT")
    with pytest.raises(ContractError, match="unknown column roles"):
        ColumnMap.detect(df, altitude="Z")


def test_rename_there_and_back(spark):
    names = ColumnMap("LINKID", "Y", "X", "KM", "OFFSET")
    df = spark.createDataFrame([], "LINKID string, X double, Y double, other int")
    standard = names.to_standard(df)
    assert standard.columns == ["ROUTEID", "LON", "LAT", "other"]
    back = names.from_standard(standard.selectExpr("*", "1d MVAL", "2d DIST_TO_LRS"))
    assert back.columns == ["LINKID", "X", "Y", "other", "KM", "OFFSET"]


def test_conform_orders_and_casts(spark):
    df = spark.createDataFrame([("x", "1.5", 7, 2)], "other string, LAT string, ROUTEID int, LON int")
    out = ColumnMap().conform(df)
    assert out.columns == ["ROUTEID", "LAT", "LON", "other"]
    assert out.first().asDict() == {"ROUTEID": "7", "LAT": 1.5, "LON": 2.0, "other": "x"}


def test_bad_numbers_fail_or_become_null(spark):
    df = spark.createDataFrame([("a", "x", 1.0)], "ROUTEID string, LAT string, LON double")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ColumnMap().conform(df).collect()
    assert ColumnMap().conform(df, on_error="null").first().LAT is None


def test_numeric_route_ids(spark):
    df = spark.createDataFrame([(540182.0, 1.0, 2.0), (None, 1.0, 2.0)], "ROUTEID double, LAT double, LON double")
    assert [r.ROUTEID for r in ColumnMap().conform(df).collect()] == ["540182", None]
    half = spark.createDataFrame([(1.5, 1.0, 2.0)], "ROUTEID double, LAT double, LON double")
    with pytest.raises(Exception, match="fractional route id"):
        ColumnMap().conform(half).collect()


def test_guessing_columns_by_name_parts(spark):
    df = spark.createDataFrame([], "ID int, LINKID string, OLD_LINK_ID string, FROM_STA_LAT double, TO_STA_LAT double, LNG double")
    assert ColumnMap.guess(df) == ColumnMap("OLD_LINK_ID", "FROM_STA_LAT", "LNG")
    other = spark.createDataFrame([], "road_id string, stalat double, longitude double")
    assert ColumnMap.guess(other) == ColumnMap("road_id", "stalat", "longitude")
    with pytest.raises(ContractError):
        ColumnMap.guess(spark.createDataFrame([], "a int"))
