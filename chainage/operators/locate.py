"""Locate point events on their routes: measure, distance, closest place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainage.contract import ColumnMap, ContractError, _quoted, route_key
from chainage.functions.measure import fraction_along, interpolate_measure
from chainage.functions.projection import GEOGRAPHIC, LAMBERT_WKT, check_crs, to_grid
from chainage.operators.events import require_rows
from chainage.operators.index import RouteIndex, build_index, candidates, descend
from chainage.operators.project import project
from chainage.operators.routes import segments

NAN = float("nan")
Projection = Callable[[Column, Column], tuple[Column, Column]]


def nearest_on_route(
    places: DataFrame, index: RouteIndex, to_working: Projection | None = None, counted: bool = True
) -> DataFrame:
    """Exact nearest segment for each distinct (route, x, y) of ``places``.

    Adds dist, seq, m, cx, cy (the closest place); the lower vertex number wins
    a tie. Places of unknown routes, and of routes without a segment, are left
    out. Places without coordinates stay, with nulls. ``to_working`` projects
    the places; x and y in the result are the given ones. ``counted`` is that of
    :func:`chainage.operators.index.salted`.
    """
    keys, searched = ["route", "x", "y"], places.select("route", "x", "y")
    if to_working is not None:
        keys = ["route", "given_x", "given_y"]
        searched = searched.toDF(*keys)
        x, y = to_working(F.col("given_x"), F.col("given_y"))
        searched = searched.select(*keys, x.alias("x"), y.alias("y"))
    found, by = candidates(searched, index, counted)
    if to_working is not None:
        by = [c for c in by if c not in ("x", "y")]
    t = fraction_along("x", "y", "x0", "y0", "dx", "dy")
    near = (
        found
        .selectExpr("*", "x1 - x0 as dx", "y1 - y0 as dy")
        .selectExpr("*", f"{t} as t")
        .selectExpr(
            *by, "seq", "m0 + t * (m1 - m0) as m", "x0 + t * dx as cx",
            "y0 + t * dy as cy", "x - x0 - t * dx as off_x", "y - y0 - t * dy as off_y",
        )
        .selectExpr(*by, "sqrt(off_x * off_x + off_y * off_y) as dist", "seq", "m", "cx", "cy")
    )
    # The candidates are sorted by these columns: first by numbers, which differ from place to place, so that few
    # comparisons look beyond the eight bytes kept with the pointers. Those of route ids are often all alike.
    by = sorted(by, key=lambda c: c not in keys[1:])
    best = near.groupBy(*by).agg(F.expr("min(struct(dist, seq, m, cx, cy)) as best"))
    return best.select(*keys, "best.*").withColumnsRenamed(dict(zip(keys, ("route", "x", "y"))))


def locate(
    events: DataFrame,
    index: RouteIndex,
    cols: ColumnMap = ColumnMap(),
    unmatched: str = "drop",
    to_working: Projection | None = None,
    matched_flag: str | None = None,
    closest: tuple[str, str] | None = None,
) -> DataFrame:
    """Events with the measure and distance columns replaced, both last.

    ``unmatched="drop"`` leaves out events of unknown routes; ``"keep"`` gives
    them measure 0 and a null distance. ``to_working`` projects the event's
    coordinates into the routes' CRS for the search; results are matched to
    events by the coordinates as given. ``closest`` names two columns for the
    closest place on the route.
    """
    if unmatched not in ("drop", "keep"):
        raise ContractError("unmatched must be 'drop' or 'keep'")
    cols.require(events)
    # The caller's columns travel in one struct, so no name of theirs meets ours.
    # Grouping and joining treat NaN as equal to itself, null not. The hash is a
    # key of its own so that both join sides are shuffled afresh, which lets
    # adaptive execution split a place that very many events share.
    kept = [c for c in events.columns if c not in (cols.m_value, cols.distance)]
    keyed = _keyed(events, kept, cols.route_id, cols.lon, cols.lat)
    found = nearest_on_route(_distinct_places(keyed), index, to_working).selectExpr(
        "hash(route, x, y) as _place", "route as _route", "x as _x", "y as _y", "dist", "m",
        "cx", "cy",
    )
    how = "inner" if unmatched == "drop" else "left"
    joined = keyed.join(found, ["_place", "_route", "_x", "_y"], how)
    result = [F.expr("m" if unmatched == "drop" else "coalesce(m, 0D)").alias(cols.m_value)]
    result.append(F.col("dist").alias(cols.distance))
    extra = []
    if closest:
        extra += [F.col("cx").alias(closest[0]), F.col("cy").alias(closest[1])]
    if matched_flag:
        # A known route is not enough: without coordinates there is no distance.
        extra.append(F.expr("dist is not null").alias(matched_flag))
    return joined.select(*_own(events, kept, cols.route_id, cols.lon, cols.lat), *extra, *result)


def _keyed(events: DataFrame, kept: list[str], route: str, x: str, y: str) -> DataFrame:
    """The kept columns as one struct, and the place that each row is searched by.

    What the place tells already is not in the struct again: of a coordinate there is only whether it is null.
    """
    told = _told(events, route, x, y)
    own = F.struct(
        *[
            (F.col(_quoted(c)).isNull() if c in told else F.col(_quoted(c))).alias(f"c{i}")
            for i, c in enumerate(kept)
            if told.get(c) != "_route"
        ]
    )
    return events.select(
        own.alias("_own"),
        route_key(events, route).alias("_route"),
        F.coalesce(F.col(_quoted(x)).cast("double"), F.lit(NAN)).alias("_x"),
        F.coalesce(F.col(_quoted(y)).cast("double"), F.lit(NAN)).alias("_y"),
    ).selectExpr("*", "hash(_route, _x, _y) as _place")


def _told(events: DataFrame, route: str, x: str, y: str) -> dict[str, str]:
    """The columns that the place holds as they are: their types say that no value changes."""
    kinds = dict(events.dtypes)
    wanted = {route: ("_route", "string"), x: ("_x", "double"), y: ("_y", "double")}
    return {c: name for c, (name, kind) in wanted.items() if kinds[c] == kind}


def _distinct_places(keyed: DataFrame) -> DataFrame:
    places = keyed.selectExpr("_route as route", "_x as x", "_y as y")
    return places.where("route is not null").distinct()


def _own(events: DataFrame, kept: list[str], route: str, x: str, y: str) -> list[Column]:
    """The kept columns of :func:`_keyed` rows."""
    told = _told(events, route, x, y)

    def value(i: int, c: str) -> Column:
        if c not in told:
            return F.col(f"_own.c{i}")
        known = F.col(told[c])
        return known if told[c] == "_route" else F.when(~F.col(f"_own.c{i}"), known)

    return [value(i, c).alias(c) for i, c in enumerate(kept)]


def shortest_line(
    events: DataFrame, index: RouteIndex, cols: ColumnMap = ColumnMap()
) -> DataFrame:
    """Events of known routes with the closest place (CLOSEST_LON, CLOSEST_LAT) and distance."""
    placed = locate(events, index, cols, closest=("CLOSEST_LON", "CLOSEST_LAT"))
    return placed.drop(cols.m_value)


def box_candidates(
    places: DataFrame,
    index: RouteIndex,
    cols: ColumnMap = ColumnMap(),
    x: str = "CLOSEST_LON",
    y: str = "CLOSEST_LAT",
) -> DataFrame:
    """Each place with every segment of its route whose closed box contains it.

    Adds VERTEX_SEQ and M_AT, the measure by share of the segment's length
    (null on a segment without length). The index is walked by containment,
    so only segments near the place are compared.
    """
    keyed = _keyed(places, places.columns, cols.route_id, x, y)
    found = _containing(_distinct_places(keyed), index, []).selectExpr(
        "hash(route, x, y) as _place", "route as _route", "x as _x", "y as _y", "seq", "m_at"
    )
    joined = keyed.join(found, ["_place", "_route", "_x", "_y"])
    return joined.select(
        *_own(places, places.columns, cols.route_id, x, y), F.col("seq").alias(cols.vertex_seq), F.col("m_at").alias("M_AT")
    )


def line_candidates(
    events: DataFrame, index: RouteIndex, cols: ColumnMap = ColumnMap()
) -> DataFrame:
    """:func:`shortest_line` and :func:`box_candidates` of its closest places in one.

    The search goes on from the distinct closest places, so the events
    themselves are joined once, at the end.
    """
    cols.require(events)
    kept = [c for c in events.columns if c not in (cols.m_value, cols.distance)]
    keyed = _keyed(events, kept, cols.route_id, cols.lon, cols.lat)
    # The search goes on with every route salted, so the places aren't counted for this one.
    nearest = nearest_on_route(_distinct_places(keyed), index, counted=False).selectExpr(
        "route", "cx as x", "cy as y", "x as _x", "y as _y", "dist"
    )
    found = _containing(nearest, index, ["_x", "_y", "dist"]).selectExpr(
        "hash(route, _x, _y) as _place", "route as _route", "_x", "_y", "x", "y", "dist", "seq", "m_at"
    )
    joined = keyed.join(found, ["_place", "_route", "_x", "_y"])
    return joined.select(
        *_own(events, kept, cols.route_id, cols.lon, cols.lat),
        F.col("x").alias("CLOSEST_LON"),
        F.col("y").alias("CLOSEST_LAT"),
        F.col("dist").alias(cols.distance),
        F.col("seq").alias(cols.vertex_seq),
        F.col("m_at").alias("M_AT"),
    )


def _containing(places: DataFrame, index: RouteIndex, carried: list[str]) -> DataFrame:
    """(route, x, y, ...) with ``seq`` and ``m_at`` of every segment of the route whose closed box holds the place."""
    leaves = descend(places, index, inside=True).where("node is not null")
    inside = leaves.join(index.segments, ["route", "node"]).where(
        "x between least(x0, x1) and greatest(x0, x1) and y between least(y0, y1) and greatest(y0, y1)"
    )
    m_at = interpolate_measure("m0", "m1", "x0", "y0", "x1", "y1", "x", "y")
    return inside.selectExpr("route", "x", "y", *carried, "seq", f"{m_at} as m_at")


def calculate_m_value(
    events: DataFrame,
    routes: DataFrame | RouteIndex,
    mapping: ColumnMap = ColumnMap(),
    crs: str = GEOGRAPHIC,
    unmatched: str = "drop",
    output_crs: str = "input",
    strict: bool = False,
) -> DataFrame:
    """Measure and distance of every event on its route.

    ``events`` may name its columns as it likes (``mapping``) and be in either
    supported CRS; ``routes`` is a points table in the working CRS, or an
    index built from one. ``output_crs="working"`` returns the coordinates in
    the working CRS. ``strict=True`` raises when no event was located.
    """
    if output_crs not in ("input", "working"):
        raise ContractError("output_crs must be 'input' or 'working'")
    ready = mapping.conform(events)
    check_crs(crs)
    index = routes if isinstance(routes, RouteIndex) else build_index(segments(routes, with_block=True))
    if output_crs == "working":
        ready = project(ready, crs, LAMBERT_WKT, mapping)
    in_working = output_crs == "working" or crs == LAMBERT_WKT
    located = locate(ready, index, mapping, unmatched, None if in_working else to_grid)
    return require_rows(located, "the located events") if strict else located
