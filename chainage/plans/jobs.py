"""End-to-end jobs composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainage.contract import ColumnMap
from chainage.functions.projection import GEOGRAPHIC
from chainage.operators.events import event_route_ids
from chainage.operators.index import RouteIndex
from chainage.operators.locate import calculate_m_value
from chainage.operators.routes import MAX_IN_LIST, only_routes
from chainage.plans.scratch import scratch_dir
from chainage.plans.store import RouteStore
from chainage.sources import esri, geojson, landing


def sync_routes(
    payloads: DataFrame,
    store: RouteStore,
    as_of_date: date | None = None,
    author: str = "",
    message: str = "",
    routes=None,
    mode: str = "fail",
) -> int:
    """Landed payloads to a new version: all routes, or the selected ones only (an id, a list or a table of ids)."""
    parsed = esri.features(payloads)
    if routes is not None:
        parsed = only_routes(parsed, routes)
    vertices = esri.points(parsed, mode=mode)
    return store.publish(vertices, as_of_date, author, message, dense=True)


@dataclass(frozen=True)
class Sync:
    """What a checked sync did: the version, and how many features landed, could not become a route, and were not in force."""

    version: int
    features: int
    rejected: int
    inactive: int


def sync_landing(
    spark: SparkSession,
    folder: str,
    store: RouteStore,
    expected: int,
    page_size: int,
    moment: datetime | str,
    as_of_date: date | None = None,
    author: str = "",
    message: str = "",
    routes=None,
    mode: str = "fail",
) -> Sync:
    """Landed page files to a new version: complete pages, routes in force at ``moment``, all or the selected ones.

    The payloads are read and parsed once, into typed features in the shared folder; pages, counts, routes and
    rejects are taken from there. If a page is missing, short or not planned, nothing is
    published and :class:`LandingError` lists the pages. Features out of force may be broken; others fail the
    job, or are left out with ``mode="skip"``.
    """
    parsed = esri.with_service_columns(esri.features(esri.read_payloads(spark, folder)))
    # Where it can't be told whether a feature is in force, its problem counts.
    unknown = F.col("feature_index").isNull() | F.startswith("problem", F.lit("invalid FROMDATE"))
    current = F.coalesce(unknown, F.lit(False)) | landing.in_force(moment)
    path = scratch_dir(spark, "features")
    typed = parsed.withColumn("current", current)
    typed.write.parquet(path)
    staged = spark.read.schema(typed.schema).parquet(path)
    wrong = landing.landing_check(staged.where("feature_index is not null").select("offset"), expected, page_size)
    if not wrong.isEmpty():
        raise landing.LandingError(wrong)
    counts = staged.agg(
        F.count("feature_index").alias("features"),
        F.count_if(F.col("current") & F.col("problem").isNotNull()).alias("rejected"),
        F.count_if(~F.col("current")).alias("inactive"),
    ).first()
    chosen = staged.where("current")
    if routes is not None:
        chosen = only_routes(chosen, routes)
    version = store.publish(esri.points(chosen, mode=mode), as_of_date, author, message, dense=True)
    return Sync(version, **counts.asDict())


def index_for(store: RouteStore, events: DataFrame, cols: ColumnMap = ColumnMap()) -> RouteIndex:
    """Index of the open version, limited to the routes that occur in the events.

    For requests and micro-batches that touch few of the stored routes; a bulk
    job reads all of them with ``store.latest().index()``. Reads the events for
    their route ids.
    """
    ids = event_route_ids(events, cols).withColumnRenamed(cols.route_id, "ROUTEID")
    few = [r[0] for r in ids.limit(MAX_IN_LIST + 1).collect()]
    if len(few) > MAX_IN_LIST:
        # Every table that is opened asks for them, and the events are many.
        path = scratch_dir(store.spark, "ids")
        ids.write.parquet(path)
        ids = store.spark.read.schema("ROUTEID string").parquet(path)
    # A list reaches the scan as a filter; more ids than that are joined. Either way only their buckets are opened.
    return store.latest(few if len(few) <= MAX_IN_LIST else ids).index()


def locate_geojson(
    documents: DataFrame,
    routes: RouteIndex | RouteStore,
    doc_id: str,
    cols: ColumnMap = ColumnMap(),
    properties: str | None = None,
    crs: str = GEOGRAPHIC,
    output_crs: str = "input",
    strict: bool = False,
) -> DataFrame:
    """GeoJSON requests to located Features: doc id, feature_index, feature text.

    With a store as ``routes`` the documents are parsed once, into the shared folder, and of the open version only
    the routes that occur are read. Invalid features are left out (list them with ``geojson.problems``), or
    fail the job with ``strict=True``.
    """
    keep = (doc_id, "feature_index")
    good = geojson.valid(geojson.features(documents), cols, strict=strict)
    events = geojson.events(good, properties, cols, keep=keep)
    if isinstance(routes, RouteStore):
        path = scratch_dir(routes.spark, "events")
        events.write.parquet(path)
        events = routes.spark.read.schema(events.schema).parquet(path)
        routes = index_for(routes, events, cols)
    located = calculate_m_value(events, routes, cols, crs, output_crs=output_crs)
    return geojson.to_features(located, cols, keep=keep)


def locate_bulk(
    events: DataFrame,
    index: RouteIndex,
    cols: ColumnMap | None = None,
    crs: str = GEOGRAPHIC,
    unmatched: str = "drop",
) -> DataFrame:
    """A bulk event table to the same table with measure and distance."""
    names = ColumnMap.detect(events) if cols is None else cols
    return calculate_m_value(events, index, names, crs, unmatched)
