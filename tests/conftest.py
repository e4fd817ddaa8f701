from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
# Python tasks import the library too.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("chainage-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


POINTS = "LAT double, LON double, MVAL double, VERTEX_SEQ int, ROUTEID string"


@pytest.fixture(scope="session")
def make_points(spark):
    """Route vertices from {route: [(lon, lat, m), ...]}."""

    def make(routes: dict, first: int = 0):
        rows = [
            (float(lat), float(lon), float(m), first + i, route)
            for route, vertices in routes.items()
            for i, (lon, lat, m) in enumerate(vertices)
        ]
        return spark.createDataFrame(rows, POINTS)

    return make


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from [(key, route, lon, lat), ...]."""

    def make(rows):
        return spark.createDataFrame(
            [(k, r, None if y is None else float(y), None if x is None else float(x)) for k, r, x, y in rows],
            "id int, ROUTEID string, LAT double, LON double",
        )

    return make
