"""Registered queries and their SQL counterparts; the work is in ``chainage``."""

from __future__ import annotations

import logging
import tempfile
from collections.abc import Callable
from datetime import date
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainage.contract import ColumnMap
from chainage.functions.projection import GEOGRAPHIC, LAMBERT_WKT
from chainage.operators import events as ev
from chainage.operators import locate as loc
from chainage.operators import routes as rt
from chainage.operators.index import RouteIndex, build_index
from chainage.operators.project import project
from chainage.plans import catalog, jobs
from chainage.plans.merge import merge_routes
from chainage.plans.scratch import scratch_dir
from chainage.plans.store import RouteStore
from chainage.sources import esri, geojson, landing, tables
from chainage.streaming.locate_stream import locate_stream, read_event_stream, read_located
from fixtures import oracles as sql
from fixtures import tables as fx

CATALOG = ["CATALOG"]
# 600 vertices a route fit the top row of the index.
FIXTURE_DEPTH = 1
FIRST_DAY, SECOND_DAY = date(2024, 1, 1), date(2024, 2, 1)
ROUNDING = {"MVAL": 6, "DIST_TO_LRS": 6}


def entry(spark: SparkSession) -> DataFrame:
    return _prepared(mvalue)(spark, "/root/testdata/sf0.001")


def _index(spark: SparkSession, sf: str) -> RouteIndex:
    parts = rt.segments(fx.points(spark, sf), dense=True, with_block=True)
    return build_index(parts, depth=FIXTURE_DEPTH)


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    digits = digits or ROUNDING
    return df.withColumns({c: F.round(c, n) for c, n in digits.items() if c in df.columns})


# -- location ----------------------------------------------------------------


def mvalue(spark, sf):
    return _rounded(loc.locate(fx.events(spark, sf), _index(spark, sf))).drop("event_type")


def mvalue_left(spark, sf):
    kept = loc.locate(
        fx.events(spark, sf), _index(spark, sf), unmatched="keep", matched_flag="MATCHED"
    )
    return _rounded(kept)


def mvalue_multi(spark, sf):
    """Many events on every route, without a unique event key."""
    return _rounded(loc.locate(fx.item_events(spark, sf), _index(spark, sf)))


def replace_mval(spark, sf):
    old = fx.events(spark, sf).withColumns({"MVAL": F.lit(-1.0), "DIST_TO_LRS": F.lit(-1.0)})
    return _rounded(loc.locate(old, _index(spark, sf)))


def _placed(spark, sf):
    """Located events in their order in the event file, which has no key for it."""
    path = scratch_dir(spark, "inventory")
    tables.write_table(fx.events(spark, sf), path)
    placed, _ = tables.read_events(spark, path, with_order=True)
    located = loc.locate(placed, _index(spark, sf), unmatched="keep")
    return _rounded(ev.restore_order(located, tables.INPUT_FILE, tables.INPUT_ROW))


def restore_order(spark, sf):
    return _placed(spark, sf).select("event_id", "MVAL")


def input_order(spark, sf):
    """Events of each file, by their place in it; the table given is one file."""
    rows, _ = tables.read_events(
        spark, f"{sf}/events.parquet", with_order=True, route_id="event_type", lat="value", lon="value"
    )
    ordered = ev.restore_order(rows, tables.INPUT_FILE, tables.INPUT_ROW)
    return ordered.select("event_id", "event_type", tables.INPUT_ROW)


def mvalue_points(spark, sf):
    """The public call on a points table, in degrees."""
    located = loc.calculate_m_value(fx.degree_events(spark, sf), fx.points(spark, sf), INVENTORY)
    return _rounded(located, MVAL=4, DIST_TO_LRS=4).drop("TO_STA_LONG", "TO_STA_LAT")


def shortest_line(spark, sf):
    lines = loc.shortest_line(fx.events(spark, sf), _index(spark, sf))
    digits = {"CLOSEST_LON": 6, "CLOSEST_LAT": 6, "DIST_TO_LRS": 6}
    return _rounded(lines, **digits).drop("event_type", "LON", "LAT")


def box_candidates(spark, sf):
    """The segments at the closest place of every event."""
    found = loc.line_candidates(fx.events(spark, sf), _index(spark, sf))
    return found.select("event_id", "ROUTEID", "VERTEX_SEQ", F.round("M_AT", 6).alias("M_AT"))


def best_candidate(spark, sf):
    """The cheapest line of every order: first by price, then by the other columns."""
    order = ["l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber"]
    lines = fx.table(spark, sf, "lineitem").select("l_orderkey", *order)
    return ev.best_candidate(lines, "l_orderkey", *order)


def match_report(spark, sf):
    return ev.match_report(fx.events(spark, sf), fx.points(spark, sf))


def event_route_ids(spark, sf):
    return ev.event_route_ids(fx.item_events(spark, sf))


def route_sample(spark, sf):
    return ev.route_sample(
        fx.events(spark, sf), 500, "event_id", order=F.col("event_id")
    ).select("event_id", "ROUTEID")


def route_sample_few(spark, sf):
    return ev.route_sample(
        fx.events(spark, sf), 7, "event_id", order=F.col("event_id")
    ).select("event_id", "ROUTEID")


# -- route tables ------------------------------------------------------------


def segments(spark, sf):
    return _rounded(rt.segments(fx.points(spark, sf), dense=True), mvgradient=6, c=4, MVAL1=6, MVAL=6)


def segments_gapped(spark, sf):
    """Vertex numbers with gaps: the successor is the next number there is."""
    some = fx.points(spark, sf).where("VERTEX_SEQ % 7 <> 3")
    return _rounded(rt.segments(some), mvgradient=6, c=4, MVAL1=6, MVAL=6)


def linestrings(spark, sf):
    lines = rt.linestrings(fx.points(spark, sf))
    first, last = F.get("vertices", F.lit(0)), F.element_at("vertices", -1)
    return lines.select(
        "ROUTEID",
        "PART",
        "n_vertices",
        first["LON"].alias("first_lon"),
        last["LON"].alias("last_lon"),
        F.round(F.aggregate("vertices", F.lit(0.0), lambda s, v: s + v["LAT"]), 3).alias("sum_lat"),
    )


def linestring_parts(spark, sf):
    """Parts of 128 vertices, and whether the whole route has a measure."""
    bare = fx.points(spark, sf).withColumn("MVAL", F.when(F.col("VERTEX_SEQ") < 100, F.col("MVAL")))
    lines = rt.with_has_m(rt.linestrings(bare, bits=7))
    return lines.select("ROUTEID", "PART", "n_vertices", "has_m")


def mvalue_own_names(spark, sf):
    """Columns named like the library's own, some rows without coordinates."""
    events = fx.events(spark, sf).select(
        "event_id", "ROUTEID",
        F.when(F.col("event_id") % 10 != 0, F.col("LON")).alias("X"), F.col("LAT").alias("Y"),
        *[F.col("event_id").alias(c) for c in ("m", "dist", "hit", "route", "node", "_x", "a.b")],
    )
    names = ColumnMap(lon="X", lat="Y")
    return _rounded(loc.locate(events, _index(spark, sf), names, unmatched="keep", matched_flag="MATCHED"))


def catalog_files(spark, sf):
    """The rows of the first of two versions, by the paths that the catalog lists."""
    store = _two_versions(spark, sf)
    paths = store.catalog().where("VERSION = 1").first()["LRS_POINT_FILE"]
    return tables.route_columns(store.listed("points", paths))


def linestring_wkt(spark, sf):
    return rt.with_wkt(rt.linestrings(fx.points(spark, sf))).drop("vertices")


def has_m(spark, sf):
    """Routes whose vertices carry a measure; half the routes lose theirs here."""
    bare = fx.points(spark, sf).withColumn(
        "MVAL", F.when(F.col("ROUTEID").cast("bigint") % 2 == 0, F.col("MVAL"))
    )
    return rt.route_has_m(bare)


def route_filter_one(spark, sf):
    """One route of a stored version; its bucket and the files that can hold it are opened."""
    return tables.route_columns(_one_version(spark, sf).latest("0000001").points)


def route_filter_in(spark, sf):
    return rt.only_routes(_stored(spark, fx.points(spark, sf)), ["0000000", "0000002", "none"])


def route_filter_join(spark, sf):
    """Vertices of the routes that occur in the events."""
    return rt.only_routes(fx.points(spark, sf), ev.event_route_ids(fx.events(spark, sf)))


def route_all(spark, sf):
    return _stored(spark, fx.points(spark, sf))


def route_union(spark, sf):
    return rt.union_sources(fx.points(spark, sf), fx.delivery_points(spark, sf))


def _stored(spark, df):
    path = scratch_dir(spark, "routes")
    tables.write_table(df, path, ("ROUTEID", "VERTEX_SEQ"))
    return spark.read.parquet(path)


# -- merge, catalog, store ---------------------------------------------------


def merge_points(spark, sf):
    return merge_routes(fx.points(spark, sf), fx.delivery_points(spark, sf))


def merge_segments(spark, sf):
    batch = fx.delivery_points(spark, sf)
    old = rt.segments(fx.points(spark, sf), dense=True)
    merged = merge_routes(old, rt.segments(batch, dense=True), replaced=batch)
    return _rounded(merged, mvgradient=6, c=4, MVAL1=6, MVAL=6)


def merge_linestrings(spark, sf):
    batch = fx.delivery_points(spark, sf)
    old = rt.linestrings(fx.points(spark, sf))
    return rt.with_wkt(merge_routes(old, rt.linestrings(batch), replaced=batch)).drop("vertices")


def catalog_history(spark, sf):
    return catalog.with_end_dates(fx.catalog_rows(spark, sf), CATALOG)


def catalog_latest(spark, sf):
    return catalog.latest(catalog_history(spark, sf), CATALOG)


def catalog_as_of(spark, sf):
    return catalog.as_of(catalog_history(spark, sf), "2024-02-10", CATALOG)


def catalog_next(spark, sf):
    return catalog.next_version(fx.catalog_rows(spark, sf), CATALOG)


def _one_version(spark, sf) -> RouteStore:
    store = RouteStore(spark, scratch_dir(spark, "store"), buckets=16)
    store.publish(fx.points(spark, sf), FIRST_DAY, "survey", "first", dense=True)
    return store


def _two_versions(spark, sf) -> RouteStore:
    store, landed = RouteStore(spark, scratch_dir(spark, "store"), buckets=16), scratch_dir(spark, "pages")
    # Pages are of two routes, and the jobs list as many files as there are; nothing here asks for a page's offset.
    fx.esri_payloads(spark, sf).select("payload").write.text(landed)
    jobs.sync_routes(esri.read_payloads(spark, landed, lines=True), store, FIRST_DAY, "survey", "first")
    store.publish(fx.delivery_points(spark, sf), SECOND_DAY, "survey", "second", dense=True)
    return store


def sync_pipeline(spark, sf):
    """Payloads to version 1, a delivery to version 2, then the open version."""
    return tables.route_columns(_two_versions(spark, sf).latest().points)


def sync_landing(spark, sf):
    """Page files to a version: complete, and without the routes that are not in force."""
    store, landed = RouteStore(spark, scratch_dir(spark, "store"), buckets=16), scratch_dir(spark, "pages")
    count = fx.land_pages(spark, sf, landed)
    jobs.sync_landing(spark, landed, store, count, fx.PER_PAGE, "2024-01-01 00:00:00", FIRST_DAY, "survey", "first")
    return tables.route_columns(store.latest().points)


def sync_short_page(spark, sf):
    """The pages that stop a sync, and how many versions there are then."""
    store, landed = RouteStore(spark, scratch_dir(spark, "store"), buckets=16), scratch_dir(spark, "pages")
    count = fx.land_pages(spark, sf, landed, short=True)
    try:
        jobs.sync_landing(spark, landed, store, count, fx.PER_PAGE, "2024-01-01 00:00:00", FIRST_DAY)
    except landing.LandingError as refused:
        versions = store.catalog().agg(F.count("*").alias("n_versions"))
        return refused.pages.crossJoin(versions)
    raise AssertionError("a sync with wrong pages was published")


def store_as_of(spark, sf):
    """The points in force on the day before the second version."""
    return tables.route_columns(_two_versions(spark, sf).as_of("2024-01-31").points)


def store_routes(spark, sf):
    """The open version's segments of the routes that occur in the events, by a table of ids."""
    ids = ev.event_route_ids(fx.events(spark, sf))
    parts = _two_versions(spark, sf).latest(ids).segments
    return _rounded(parts, mvgradient=6, c=4, MVAL1=6, MVAL=6)


def store_linestrings(spark, sf):
    return rt.with_wkt(_two_versions(spark, sf).latest().linestrings).drop("vertices")


def catalog_publish(spark, sf):
    store = _two_versions(spark, sf)
    counts = [
        store.version(v).points.agg(F.count("*").alias("n_points"), F.countDistinct("ROUTEID").alias("n_routes"))
        .withColumn("VERSION", F.lit(v))
        for v in (1, 2)
    ]
    return (
        store.catalog()
        .join(counts[0].unionByName(counts[1]), "VERSION")
        .drop("LRS_POINT_FILE", "LRS_SEGMENT_FILE", "LRS_LINESTR_FILE")
    )


# -- projection and contract -------------------------------------------------


def project_forward(spark, sf):
    return _rounded(project(fx.wide_degree_points(spark, sf), GEOGRAPHIC, LAMBERT_WKT), LON=3, LAT=3)


def project_inverse(spark, sf):
    there = project(fx.wide_degree_points(spark, sf), GEOGRAPHIC, LAMBERT_WKT)
    return _rounded(project(there, LAMBERT_WKT, GEOGRAPHIC), LON=8, LAT=8)


INVENTORY = ColumnMap(route_id="LINKID", lat="TO_STA_LAT", lon="TO_STA_LONG")


def rename_standard(spark, sf):
    return INVENTORY.to_standard(fx.degree_events(spark, sf))


def contract_events(spark, sf):
    as_text = fx.degree_events(spark, sf).withColumn("TO_STA_LAT", F.col("TO_STA_LAT").cast("string"))
    return INVENTORY.conform(as_text)


def events_aliased(spark, sf):
    path = scratch_dir(spark, "inventory")
    tables.write_table(fx.degree_events(spark, sf), path)
    df, found = tables.read_events(spark, path)
    return found.to_standard(df)


def events_mapped(spark, sf):
    path = scratch_dir(spark, "inventory")
    tables.write_table(fx.degree_events(spark, sf).withColumn("ROUTEID", F.lit("other")), path)
    df, found = tables.read_events(spark, path, route_id="LINKID", m_value="KM")
    return found.to_standard(df.drop("ROUTEID")).withColumn("m_name", F.lit(found.m_value))


# -- sources and sinks -------------------------------------------------------


def esri_points(spark, sf):
    return esri.points(esri.features(fx.esri_payloads(spark, sf)))


def active_routes(spark, sf):
    return landing.active_routes(fx.road_features(spark, sf), "1999-06-01 00:00:00")


def landing_check(spark, sf):
    """Pages of ten orders; orders with status P did not arrive."""
    orders = fx.table(spark, sf, "orders")
    landed = orders.where("o_orderstatus <> 'P'").select(F.expr("o_orderkey div 10 * 10").alias("offset"))
    return landing.landing_check(landed, orders.agg(F.count("*")), 10)


def geojson_events(spark, sf):
    return geojson.events(geojson.features(fx.geojson_documents(spark, sf)))


def geojson_events_custom(spark, sf):
    names = ColumnMap(route_id="ROUTEID", lat="Y", lon="X")
    parsed = geojson.features(fx.geojson_documents(spark, sf, broken=True))
    good = geojson.valid(parsed, names)
    return geojson.events(good, fx.EVENT_PROPERTIES, names, keep=("doc_id", "feature_index"))


def geojson_lines(spark, sf):
    """The events through files of a Feature per line."""
    path = scratch_dir(spark, "lines")
    geojson.to_features(_typed_events(spark, sf)).write.text(path)
    return geojson.events(geojson.valid(geojson.read_lines(spark, path), strict=True))


def geojson_split(spark, sf):
    """The events through one document in several files, which are cut where Features begin."""
    path = scratch_dir(spark, "document")
    rows = _typed_events(spark, sf)
    geojson.write_document(geojson.to_features(rows.withColumn("row", F.col("event_id")), keep=("row",)), path, "row")
    return geojson.events(geojson.valid(geojson.read_split(spark, path), strict=True))


def _typed_events(spark, sf):
    parsed = geojson.features(fx.geojson_documents(spark, sf))
    return geojson.events(parsed)


def geojson_conflicts(spark, sf):
    parsed = geojson.features(fx.geojson_documents(spark, sf, mixed=True))
    return geojson.property_conflicts(parsed)


def geojson_mixed(spark, sf):
    """Inferred columns where a property is of several kinds, and another is called like a coordinate."""
    parsed = geojson.features(fx.geojson_documents(spark, sf, mixed=True))
    return geojson.events(parsed)


def validate_geojson(spark, sf):
    parsed = geojson.features(fx.geojson_documents(spark, sf, broken=True))
    return geojson.problems(parsed).select("doc_id", "feature_index", "problem")


def geojson_export(spark, sf):
    some = fx.events(spark, sf).withColumn(
        "event_type", F.when(F.col("event_type") != "error", F.col("event_type"))
    )
    return geojson.to_features(some, keep=("event_id",))


def compact_events(spark, sf):
    small, large = scratch_dir(spark, "small"), scratch_dir(spark, "large")
    tables.write_table(fx.events(spark, sf).repartition(32), small)
    tables.compact(spark, small, large)
    return spark.read.parquet(large)


# -- whole jobs --------------------------------------------------------------


def pipeline_geojson(spark, sf):
    """Documents on the working grid to located documents, read back as a table."""
    asked, located = "event_id bigint, ROUTEID string, event_type string", "MVAL double, DIST_TO_LRS double"
    answers = geojson.to_collections(
        jobs.locate_geojson(
            fx.geojson_documents(spark, sf, broken=True),
            _one_version(spark, sf),
            "doc_id",
            properties=asked,
            crs=LAMBERT_WKT,
        ),
        "doc_id",
        "feature_index",
    )
    read = geojson.valid(geojson.features(answers), strict=True)
    return _rounded(geojson.events(read, f"{asked}, {located}", keep=("doc_id",)))


def pipeline_bulk(spark, sf):
    """Degrees, inventory column names, stored routes: the bulk job end to end."""
    located = jobs.locate_bulk(fx.degree_events(spark, sf), _one_version(spark, sf).latest().index())
    return _rounded(located, MVAL=4, DIST_TO_LRS=4).drop("TO_STA_LONG", "TO_STA_LAT")


def stream_mvalue(spark, sf):
    source, target = scratch_dir(spark, "arrivals"), scratch_dir(spark, "located")
    arrivals = fx.events(spark, sf).drop("event_type")
    tables.write_table(arrivals.repartition(8), source)
    store = _one_version(spark, sf)
    query = locate_stream(
        read_event_stream(spark, source, arrivals.schema, max_files=4),
        lambda batch: jobs.index_for(store, batch),
        target,
        scratch_dir(spark, "progress"),
        crs=LAMBERT_WKT,
    )
    query.awaitTermination()
    return _rounded(read_located(spark, target).drop("batch_id"))


_QUERIES = (
    mvalue,
    mvalue_left,
    mvalue_multi,
    replace_mval,
    restore_order,
    input_order,
    mvalue_points,
    shortest_line,
    box_candidates,
    best_candidate,
    match_report,
    event_route_ids,
    route_sample,
    route_sample_few,
    segments,
    segments_gapped,
    linestrings,
    linestring_wkt,
    linestring_parts,
    mvalue_own_names,
    catalog_files,
    has_m,
    route_filter_one,
    route_filter_in,
    route_filter_join,
    route_all,
    route_union,
    merge_points,
    merge_segments,
    merge_linestrings,
    catalog_history,
    catalog_latest,
    catalog_as_of,
    catalog_next,
    catalog_publish,
    sync_pipeline,
    sync_landing,
    sync_short_page,
    store_as_of,
    store_routes,
    store_linestrings,
    project_forward,
    project_inverse,
    rename_standard,
    contract_events,
    events_aliased,
    events_mapped,
    esri_points,
    active_routes,
    landing_check,
    geojson_events,
    geojson_events_custom,
    geojson_lines,
    geojson_split,
    geojson_conflicts,
    geojson_mixed,
    validate_geojson,
    geojson_export,
    compact_events,
    pipeline_geojson,
    pipeline_bulk,
    stream_mvalue,
)


def _llm():
    """The module of the training-data queries, if it and what it needs can be imported."""
    try:
        from chainage.llm import queries as module
    except ImportError as missing:
        logging.getLogger(__name__).warning("training-data queries are left out: %s", missing)
        return None
    return module


def _prepared(query):
    """Lets Python tasks import this repository, and names a shared folder where one machine is all there is."""

    @wraps(query)
    def run(spark, sf):
        context = spark.sparkContext
        context.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent))
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not named and context.master.startswith("local["):
            # One machine only; on a cluster the library asks for a shared folder.
            context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        return query(spark, sf)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {q.__name__: q for q in _QUERIES}
    more = _llm()
    return {name: _prepared(q) for name, q in (own | (more.queries() if more else {})).items()}


def oracle_sql() -> dict[str, str]:
    more = _llm()
    return _own_sql() | (more.oracle_sql() if more else {})


def _own_sql() -> dict[str, str]:
    nearest = sql.nearest_of(sql.EVENTS, sql.POINTS, "event_id, event_type, LON, LAT")
    matched = "round(m, 6) as MVAL, round(dist, 6) as DIST_TO_LRS"
    rounded = (
        "ROUTEID, LON, LAT, round(MVAL, 6) as MVAL, VERTEX_SEQ, LON1, LAT1, round(MVAL1, 6) as MVAL1, "
        "round(mvgradient, 6) as mvgradient, round(c, 4) as c"
    )
    degrees = sql.DEGREE_EVENTS
    x, y = sql.grid_of("TO_STA_LONG", "TO_STA_LAT")
    on_grid = f"select event_id, LINKID as ROUTEID, {x} as LON, {y} as LAT from ({degrees}) d"
    wide_x, wide_y = sql.grid_of("LON", "LAT")
    standard = f"select event_id, LINKID as ROUTEID, TO_STA_LONG as LON, TO_STA_LAT as LAT from ({degrees}) d"
    history = f"""
        select *, lead(START_DATE) over (partition by CATALOG order by VERSION) as END_DATE from (
          select o_orderkey // 8 as CATALOG, cast(o_orderkey % 8 + 1 as int) as VERSION,
                 date '2024-01-01' + cast((o_orderkey % 8) // 2 * 30 + (o_orderkey // 8) % 28 as int) as START_DATE,
                 'points/' || o_orderkey as LRS_POINT_FILE, o_orderpriority as AUTHOR from orders) v"""
    features = f"""
        select e.event_id, e.event_id // 50 as doc_id, cast(e.event_id % 50 as int) as slot,
               {sql.ROUTE.format('(user_id // 4)')} as ROUTEID, event_type,
               (user_id // 4) * 1000.0e0 + e.event_id % 6000 as LON, value as LAT,
               cast(json_extract(props, '$.k') as double) as k from events e"""
    sound = f"select * from ({features}) f where slot not in (7, 11, 13, 17)"
    good_nearest = sql.nearest_of(sound, sql.POINTS, "doc_id, event_id, event_type, LON, LAT")
    versions = f"""
        select 1 as VERSION, date '2024-01-01' as START_DATE, date '2024-02-01' as END_DATE,
               'survey' as AUTHOR, 'first' as COMMIT_MSG, count(*) as n_points,
               count(distinct ROUTEID) as n_routes from ({sql.POINTS}) p
        union all
        select 2, date '2024-02-01', null, 'survey', 'second', count(*), count(distinct ROUTEID)
        from ({sql.merged(lambda t: t)}) m"""
    return {
        "mvalue": f"select event_id, ROUTEID, LON, LAT, {matched} from ({nearest}) n",
        "mvalue_left": f"""
            select e.*, n.event_id is not null as MATCHED, round(coalesce(m, 0), 6) as MVAL,
                   round(dist, 6) as DIST_TO_LRS
            from ({sql.EVENTS}) e left join ({nearest}) n on e.event_id = n.event_id""",
        "mvalue_multi": f"""
            select i.*, round(m, 6) as MVAL, round(dist, 6) as DIST_TO_LRS
            from ({sql.ITEM_EVENTS}) i join (
              {sql.nearest_of(f"select distinct ROUTEID, LON, LAT from ({sql.ITEM_EVENTS}) x",
                              sql.POINTS, "ROUTEID, LON, LAT").replace("ROUTEID, LON, LAT, ROUTEID", "ROUTEID, LON, LAT")}
            ) n on i.ROUTEID = n.ROUTEID and i.LON = n.LON and i.LAT = n.LAT""",
        "replace_mval": f"select event_id, event_type, ROUTEID, LON, LAT, {matched} from ({nearest}) n",
        "restore_order": f"""
            select e.event_id, round(coalesce(m, 0), 6) as MVAL
            from ({sql.EVENTS}) e left join ({nearest}) n on e.event_id = n.event_id
            order by e.event_id""",
        "input_order": "select event_id, event_type, row_number() over () - 1 as INPUT_ROW from events",
        "mvalue_points": f"""
            select event_id, ROUTEID as LINKID, round(m, 4) as MVAL, round(dist, 4) as DIST_TO_LRS
            from ({sql.nearest_of(on_grid, sql.POINTS, 'event_id')}) n""",
        "shortest_line": f"""
            select event_id, ROUTEID, round(cx, 6) as CLOSEST_LON, round(cy, 6) as CLOSEST_LAT,
                   round(dist, 6) as DIST_TO_LRS from ({nearest}) n""",
        "box_candidates": f"""
            select n.event_id, n.ROUTEID, s.VERTEX_SEQ, round(
              (s.MVAL1 - s.MVAL) / nullif(sqrt((LON1 - LON0) * (LON1 - LON0) + (LAT1 - LAT0) * (LAT1 - LAT0)), 0)
              * sqrt((cx - LON0) * (cx - LON0) + (cy - LAT0) * (cy - LAT0)) + s.MVAL, 6) as M_AT
            from ({nearest}) n join (
              select ROUTEID, VERTEX_SEQ, MVAL, MVAL1, LON as LON0, LAT as LAT0, LON1, LAT1
              from ({sql.segments_of(sql.POINTS)}) s0) s on n.ROUTEID = s.ROUTEID
             and cx between least(LON0, LON1) and greatest(LON0, LON1)
             and cy between least(LAT0, LAT1) and greatest(LAT0, LAT1)""",
        "best_candidate": """
            select l_orderkey, l_extendedprice, l_partkey, l_suppkey, l_quantity, l_linenumber from (
              select *, row_number() over (partition by l_orderkey order by l_extendedprice, l_partkey,
                                           l_suppkey, l_quantity, l_linenumber) as rn from lineitem) l
            where rn = 1""",
        "match_report": f"""
            select e.ROUTEID, count(*) as events, count(p.ROUTEID) as matched,
                   count(*) - count(p.ROUTEID) as unmatched
            from ({sql.EVENTS}) e left join (select distinct ROUTEID from ({sql.POINTS}) q) p
              on e.ROUTEID = p.ROUTEID group by e.ROUTEID""",
        "event_route_ids": f"select distinct ROUTEID from ({sql.ITEM_EVENTS}) i",
        "route_sample": f"""
            select min(event_id) as event_id, ROUTEID from ({sql.EVENTS}) e group by ROUTEID
            order by 1 limit 500""",
        "route_sample_few": f"""
            select min(event_id) as event_id, ROUTEID from ({sql.EVENTS}) e group by ROUTEID
            order by 1 limit 7""",
        "segments_gapped": f"""
            select {rounded} from ({sql.segments_of(f"select * from ({sql.POINTS}) q where VERTEX_SEQ % 7 <> 3")}) s""",
        "segments": f"select {rounded} from ({sql.segments_of(sql.POINTS)}) s",
        "linestrings": f"""
            select ROUTEID, 0 as PART, cast(count(*) as int) as n_vertices,
                   arg_min(LON, VERTEX_SEQ) as first_lon, arg_max(LON, VERTEX_SEQ) as last_lon,
                   round(sum(LAT), 3) as sum_lat from ({sql.POINTS}) p group by ROUTEID""",
        "linestring_wkt": sql.wkt_of(sql.POINTS),
        "linestring_parts": f"""
            select ROUTEID, cast(VERTEX_SEQ // 128 as int) as PART, cast(count(*) as int) as n_vertices, true as has_m
            from ({sql.POINTS}) p group by all""",
        "mvalue_own_names": f"""
            select e.event_id, e.ROUTEID, case when e.event_id % 10 <> 0 then e.LON end as "X", e.LAT as "Y",
                   e.event_id as m, e.event_id as dist, e.event_id as hit, e.event_id as route, e.event_id as node,
                   e.event_id as _x, e.event_id as "a.b",
                   n.event_id is not null and e.event_id % 10 <> 0 as MATCHED,
                   case when e.event_id % 10 <> 0 then round(coalesce(n.m, 0), 6) else 0 end as MVAL,
                   case when e.event_id % 10 <> 0 then round(n.dist, 6) end as DIST_TO_LRS
            from ({sql.EVENTS}) e left join ({nearest}) n on e.event_id = n.event_id""",
        "catalog_files": sql.POINTS,
        "has_m": f"""
            select ROUTEID, cast(ROUTEID as bigint) % 2 = 0 as has_m from ({sql.POINTS}) p
            group by ROUTEID""",
        "route_filter_one": f"select * from ({sql.POINTS}) p where ROUTEID = '0000001'",
        "route_filter_in": f"select * from ({sql.POINTS}) p where ROUTEID in ('0000000', '0000002')",
        "route_filter_join": f"""
            select * from ({sql.POINTS}) p where ROUTEID in (select ROUTEID from ({sql.EVENTS}) e)""",
        "route_all": sql.POINTS,
        "route_union": f"{sql.POINTS} union all {sql.DELIVERY}",
        "merge_points": sql.merged(lambda t: t),
        "merge_segments": f"select {rounded} from ({sql.merged(sql.segments_of)}) s",
        "merge_linestrings": sql.merged(sql.wkt_of),
        "catalog_history": history,
        "catalog_latest": f"""
            select * from ({history}) h where END_DATE is null""",
        "catalog_as_of": f"""
            select * from ({history}) h where START_DATE <= date '2024-02-10'
              and (END_DATE is null or date '2024-02-10' < END_DATE)""",
        "catalog_next": f"""
            select CATALOG, cast(max(VERSION) + 1 as int) as NEXT_VERSION from ({history}) h
            group by CATALOG""",
        "catalog_publish": versions,
        "sync_pipeline": sql.merged(lambda t: t),
        "sync_landing": f"select * from ({sql.POINTS}) p where cast(ROUTEID as bigint) % 5 in (0, 3)",
        "sync_short_page": f"""
            select *, 0 as n_versions from (
              select o as "offset", least(2, n - o) as expected_rows,
                     case when o in (0, 4) then 0 when o = 2 then least(2, n - o) + 1 else least(2, n - o) end as landed_rows
              from (select n, unnest(range(0, n, 2)) as o from (select count(distinct ROUTEID) as n from ({sql.POINTS}) p) c) r
              union all select 1000, 0, 1) l
            where expected_rows <> landed_rows""",
        "store_as_of": sql.POINTS,
        "store_routes": f"""
            select {rounded} from ({sql.merged(sql.segments_of)}) s
            where ROUTEID in (select ROUTEID from ({sql.EVENTS}) e)""",
        "store_linestrings": sql.merged(sql.wkt_of),
        "project_forward": f"""
            select event_id, round({wide_x}, 3) as LON, round({wide_y}, 3) as LAT from ({sql.WIDE}) w""",
        "project_inverse": f"""
            select event_id, round(LON, 8) as LON, round(LAT, 8) as LAT from ({sql.WIDE}) w""",
        "rename_standard": standard,
        "contract_events": degrees,
        "events_aliased": standard,
        "events_mapped": f"select *, 'KM' as m_name from ({standard}) s",
        "esri_points": sql.POINTS,
        "active_routes": f"""
            select * from (
              select o_orderkey as OBJECTID, {sql.ROUTE.format('(o_orderkey // 100)')} as RouteId,
                     case when o_orderkey % 7 <> 0 then o_orderdate end as FROMDATE,
                     case when o_orderkey % 3 <> 0 then o_orderdate end as TODATE,
                     case when o_orderstatus = 'O' then 'N' else o_orderstatus end as ROAD_STATUS
              from orders) r
            where TODATE is null and (FROMDATE < timestamp '1999-06-01 00:00:00' or FROMDATE is null)
              and ROAD_STATUS = 'N'""",
        "landing_check": """
            select p."offset", p.expected_rows, coalesce(n, 0) as landed_rows from (
              select o as "offset", least(10, (select count(*) from orders) - o) as expected_rows
              from range(0, (select count(*) from orders), 10) r(o)) p
            left join (select o_orderkey // 10 * 10 as o, count(*) as n from orders
                       where o_orderstatus <> 'P' group by 1) l on p."offset" = l.o
            where coalesce(n, 0) <> expected_rows""",
        "geojson_events": f"""
            select LAT, LON, ROUTEID, cast(event_id as double) as event_id, event_type, k
            from ({features}) f""",
        "geojson_events_custom": f"""
            select doc_id, slot as feature_index, LAT as "Y", LON as "X", ROUTEID, event_type, k
            from ({sound}) f""",
        "geojson_lines": f"""
            select LAT, LON, ROUTEID, cast(event_id as double) as event_id, event_type, k
            from ({features}) f""",
        "geojson_split": f"""
            select LAT, LON, ROUTEID, cast(event_id as double) as event_id, event_type, k
            from ({features}) f""",
        "geojson_conflicts": f"""
            select 'code' as key, case slot % 5 when 0 then 'double' when 1 then 'boolean' else 'string' end as kind,
                   count(*) as features from ({features}) f where slot % 5 < 3 group by all
            union all
            select 'shape', case slot % 2 when 0 then 'structure' else 'string' end, count(*) from ({features}) f group by all""",
        "geojson_mixed": f"""
            select LAT, LON, ROUTEID, cast(event_id as double) as event_id, event_type, k, 'kept' as LAT_PROPERTY,
                   case slot % 5 when 0 then '7' when 1 then 'true' when 2 then 'seven' end as code,
                   case slot % 2 when 0 then '[1]' else 'list' end as shape
            from ({features}) f""",
        "validate_geojson": f"""
            select doc_id, slot as feature_index,
                   case slot when 17 then 'expected Feature type'
                             when 7 then 'only Point geometry is supported'
                             when 11 then 'Point must have at least 2 coordinates'
                             else 'missing required ROUTEID property' end as problem
            from ({features}) f where slot in (7, 11, 13, 17)""",
        "geojson_export": f"""
            select event_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || LON || ','
                   || LAT || ']}},"properties":{{"ROUTEID":"' || ROUTEID || '"'
                   || case when event_type <> 'error' then ',"event_type":"' || event_type || '"' else '' end
                   || '}}}}' as feature from ({sql.EVENTS}) e""",
        "compact_events": sql.EVENTS,
        "pipeline_geojson": f"""
            select doc_id, event_id, LON, LAT, ROUTEID, event_type, {matched}
            from ({good_nearest}) n""",
        "pipeline_bulk": f"""
            select event_id, ROUTEID as LINKID, round(m, 4) as MVAL, round(dist, 4) as DIST_TO_LRS
            from ({sql.nearest_of(on_grid, sql.POINTS, 'event_id')}) n""",
        "stream_mvalue": f"select event_id, ROUTEID, LON, LAT, {matched} from ({nearest}) n",
    }
