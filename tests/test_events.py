from pyspark.sql import functions as F
import pytest

from chainage.contract import ContractError
from chainage.operators import events as ev
from chainage.sources import tables


def test_route_ids_and_report(make_events, make_points):
    events = make_events([(1, "a", 0, 0), (2, "a", 0, 0), (3, "x", 0, 0), (4, None, 0, 0)])
    assert sorted(r.ROUTEID for r in ev.event_route_ids(events).collect()) == ["a", "x"]
    report = ev.match_report(events, make_points({"a": [(0, 0, 0), (1, 1, 1)], "b": [(0, 0, 0)]}))
    assert {tuple(r) for r in report.collect()} == {("a", 2, 2, 0), ("x", 1, 0, 1), (None, 1, 0, 1)}


def test_best_candidate_breaks_ties_by_the_next_column(spark):
    df = spark.createDataFrame([(1, 2.0, 9, "p"), (1, 2.0, 3, "q"), (2, 1.0, 1, "r")], ["k", "dist", "seq", "tag"])
    assert {(r.k, r.tag) for r in ev.best_candidate(df, "k", "dist", "seq").collect()} == {(1, "q"), (2, "r")}
    with pytest.raises(ContractError):
        ev.best_candidate(df, "k")


def test_route_sample_takes_one_event_per_route(make_events):
    events = make_events([(i, f"r{i % 7}", i, 0) for i in range(70)])
    sample = ev.route_sample(events, 5, "id").collect()
    assert len({r.ROUTEID for r in sample}) == 5 and all(r.id < 7 for r in sample)
    assert sample == ev.route_sample(events.orderBy(F.desc("id")), 5, "id").collect()
    assert [r.id for r in ev.route_sample(events, 3, "id", order=F.col("id")).collect()] == [0, 1, 2]
    assert ev.route_sample(events, 100, "id").count() == 7


def test_order_and_column_replacement(make_events):
    events = make_events([(3, "a", 0, 0), (1, "b", 0, 0)])
    assert [r.ROUTEID for r in ev.restore_order(events, "id", drop=True).collect()] == ["b", "a"]
    assert ev.replace_columns(events, LAT=F.lit(1.0), NEW=F.lit(2)).columns == ["id", "ROUTEID", "LON", "LAT", "NEW"]


def test_input_order_without_a_key(spark, tmp_path):
    """Rows keep their place in their files through shuffles, also with repeated rows."""
    path = str(tmp_path / "events")
    rows = [(f"r{i % 3}", 1.0, 2.0, (i * 37) % 101) for i in range(300)]
    spark.createDataFrame(rows, "ROUTEID string, LAT double, LON double, v int").repartition(4).write.parquet(path)
    order = (tables.INPUT_FILE, tables.INPUT_ROW)
    placed, names = tables.read_events(spark, path, with_order=True)
    assert names.route_id == "ROUTEID"
    mixed = placed.repartition(7, "v").join(spark.createDataFrame([(f"r{i}",) for i in range(3)], "ROUTEID string"), "ROUTEID")
    got = [r.v for r in ev.restore_order(mixed, *order, drop=True).collect()]
    want = []
    for file in sorted(spark.read.parquet(path).inputFiles()):
        want += [r.v for r in spark.read.parquet(file).collect()]
    assert got == want
    with pytest.raises(ContractError, match="INPUT_ROW"):
        placed.write.parquet(str(tmp_path / "again"))
        tables.read_events(spark, str(tmp_path / "again"), with_order=True)
    with pytest.raises(ContractError, match="input order"):
        ev.restore_order(placed)


def test_compaction_keeps_the_order(spark, tmp_path):
    source, target = str(tmp_path / "many"), str(tmp_path / "few")
    spark.range(5000).selectExpr("id % 50 as a", "id as b").repartition(20).write.parquet(source)
    tables.compact(spark, source, target, ("a", "b"))
    rows = spark.read.parquet(target)
    assert rows.count() == 5000
    for file in rows.inputFiles():
        keys = [tuple(r) for r in spark.read.parquet(file).collect()]
        assert keys == sorted(keys)
