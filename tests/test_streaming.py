import pytest

from chainage.functions.projection import LAMBERT_WKT
from chainage.operators.index import build_index
from chainage.operators.locate import locate
from chainage.operators.routes import segments
from chainage.streaming.locate_stream import locate_stream, read_event_stream, read_located

LINE = [(0, 0, 0), (10, 0, 1), (20, 0, 2)]


def run(spark, tmp_path, index, schema):
    query = locate_stream(
        read_event_stream(spark, str(tmp_path / "in"), schema, max_files=2),
        lambda batch: index,
        str(tmp_path / "out"),
        str(tmp_path / "progress"),
        crs=LAMBERT_WKT,
    )
    query.awaitTermination()
    return read_located(spark, str(tmp_path / "out"))


def test_stream_equals_batch_and_resumes(spark, tmp_path, make_points, make_events):
    index = build_index(segments(make_points({"a": LINE})))
    events = make_events([(i, "a" if i % 4 else "none", i, i % 5) for i in range(40)])
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    out = run(spark, tmp_path, index, events.schema)
    names = ["id", "ROUTEID", "LAT", "LON", "MVAL", "DIST_TO_LRS"]
    want = sorted(map(tuple, locate(events, index).select(*names).collect()))
    assert sorted(map(tuple, out.select(*names).collect())) == want
    assert out.select("batch_id").distinct().count() == 3
    # a second run finds nothing new; one more file adds only its own rows
    assert run(spark, tmp_path, index, events.schema).count() == len(want)
    make_events([(99, "a", 15, 1)]).write.mode("append").parquet(str(tmp_path / "in"))
    assert run(spark, tmp_path, index, events.schema).where("id = 99").count() == 1


def test_a_repeated_stream_is_read_once(spark, tmp_path, make_points, make_events):
    index = build_index(segments(make_points({"a": LINE})))
    events = make_events([(1, "a", 5, 1)])
    events.write.parquet(str(tmp_path / "in"))
    run(spark, tmp_path, index, events.schema)
    # without its progress the stream starts over at batch 0
    query = locate_stream(
        read_event_stream(spark, str(tmp_path / "in"), events.schema), lambda batch: index,
        str(tmp_path / "out"), str(tmp_path / "progress2"), crs=LAMBERT_WKT,
    )
    query.awaitTermination()
    assert read_located(spark, str(tmp_path / "out")).count() == 1


def test_a_killed_stream_shows_completed_batches_only(spark, tmp_path, make_points, make_events):
    """The stream dies in its second batch, once before and once after the rows are written."""
    index = build_index(segments(make_points({"a": LINE})))
    events = make_events([(i, "a", i, 1) for i in range(12)])
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    target, calls = str(tmp_path / "out"), []

    def stream(snapshot):
        return locate_stream(
            read_event_stream(spark, str(tmp_path / "in"), events.schema, max_files=1),
            snapshot, target, str(tmp_path / "progress"), crs=LAMBERT_WKT,
        )

    def dies_early(batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return index

    with pytest.raises(Exception, match="killed"):
        stream(dies_early).awaitTermination()
    seen = read_located(spark, target)
    assert {r.batch_id for r in seen.select("batch_id").distinct().collect()} == {0}
    # What a driver leaves that is lost between its rows and the list.
    seen.drop("batch_id").write.parquet(f"{target}/data/batch_id=1/attempt=lost")
    assert read_located(spark, target).count() == seen.count()
    stream(lambda batch: index).awaitTermination()
    names = ["id", "MVAL", "DIST_TO_LRS"]
    want = sorted(map(tuple, locate(events, index).select(*names).collect()))
    assert sorted(map(tuple, read_located(spark, target).select(*names).collect())) == want
