import math

import pytest

from chainage.contract import ColumnMap, ContractError
from chainage.functions import projection as pj
from chainage.operators.project import project


def test_constants_follow_from_the_definition():
    assert pj.CONE == pytest.approx(-0.04366553455478361, abs=1e-15)
    assert pj.RHO_ORIGIN == pytest.approx(-145758714.6147239, abs=1e-4)


def test_known_place_and_back(spark):
    df = spark.createDataFrame([("a", 5.647860000331377, 95.42103999972832, 1)], "k string, LAT double, LON double, z int")
    there = project(df, pj.GEOGRAPHIC, pj.LAMBERT_WKT)
    assert there.columns == ["k", "z", "LON", "LAT"]
    row = there.first()
    assert (row.LON, row.LAT) == pytest.approx((-2184157.9710, 609253.9259), abs=1e-3)
    back = project(there, pj.LAMBERT_WKT, pj.GEOGRAPHIC).first()
    assert (back.LON, back.LAT) == pytest.approx((95.42103999972832, 5.647860000331377), abs=1e-10)


def test_scale_is_true_on_the_standard_parallels(spark):
    for parallel in pj.STANDARD_PARALLELS:
        df = spark.createDataFrame([(parallel, 115.0), (parallel, 115.001)], "LAT double, LON double")
        a, b = project(df, pj.GEOGRAPHIC, pj.LAMBERT_WKT).orderBy("LON").collect()
        phi = math.radians(parallel)
        radius = pj.SEMI_MAJOR / math.sqrt(1 - (pj.ECCENTRICITY * math.sin(phi)) ** 2) * math.cos(phi)
        assert math.hypot(a.LON - b.LON, a.LAT - b.LAT) == pytest.approx(radius * math.radians(0.001), rel=1e-9)


def test_same_crs_is_untouched_and_names_are_free(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "Y double, X double")
    names = ColumnMap(lat="Y", lon="X")
    assert project(df, pj.LAMBERT_WKT, pj.LAMBERT_WKT, names) is df
    assert project(df, pj.GEOGRAPHIC, pj.LAMBERT_WKT, names).columns == ["X", "Y"]


@pytest.mark.parametrize("crs", ["", "4326", "EPSG:3857", 'PROJCS["Other"]', "PROJCS=x"])
def test_other_crs_are_refused(spark, crs):
    df = spark.createDataFrame([(1.0, 2.0)], "LAT double, LON double")
    with pytest.raises(ContractError):
        project(df, crs, pj.LAMBERT_WKT)
