"""Box index over route segments, used to find the nearest segment exactly.

16 consecutive segments form a leaf, 16 leaves a node, and so on. Every box
carries one vertex of its segments, so a point knows both how near the box may
be and how near its content surely is. A search walks from the route's top row
(at most 65 boxes) down; each further step joins the point with rows of 16
boxes, so the work per point grows with the logarithm of the route's length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainage.contract import ColumnMap
from chainage.functions.measure import box_gap2, point_gap2
from chainage.operators.routes import BLOCK, BLOCK_BITS

FAN_BITS = 4
FAN_OUT = 1 << FAN_BITS
TOP_BOXES = 64
# Coordinates whose squares would overflow count as unknown.
FARTHEST = 1e150
# Vertices a leaf keeps, by name and offset; the first bounds the search in
# all leaves, the others only in those it leaves over.
SAMPLES = {"v": 7, "a": 1, "b": 4, "c": 10, "d": 13}
SALTS = 8
HOT_PLACES = 1 << 17
# Room for rounding in the bounds, in coordinate units and relative.
SLACK, RELATIVE_SLACK = 1e-6, 1e-9


@dataclass(frozen=True)
class RouteIndex:
    """``levels`` from the top row of each route down to the leaves, and the segments.

    Level rows are (route, node, boxes); the top level has no node. Segment
    rows are (route, block, node, seq, x0, y0, m0, x1, y1, m1).
    """

    levels: tuple[DataFrame, ...]
    segments: DataFrame

    def by_route(self) -> DataFrame:
        """(route, leaves): the segments of each leaf in a map by node, for an index of one level, whose routes are short."""
        # Both groupings keep the partitioning by route, so stored segments are shuffled once.
        per_leaf = self.segments.where("node is not null").repartition("route").groupBy("route", "block", "node").agg(
            F.expr("collect_list(struct(seq, x0, y0, m0, x1, y1, m1)) as segments")
        )
        return per_leaf.groupBy("route").agg(
            F.expr("map_from_entries(collect_list(struct(node, segments))) as leaves")
        )


def index_depth(vertices: DataFrame, cols: ColumnMap = ColumnMap()) -> int:
    """Levels needed so that no route's top row has more than 65 boxes (runs a job)."""
    lo, hi = vertices.agg(F.min(cols.vertex_seq), F.max(cols.vertex_seq)).first()
    return 1 if hi is None else depth_for(lo, hi)


def depth_for(lo: int, hi: int) -> int:
    """Levels needed for vertex numbers from ``lo`` to ``hi``."""
    depth = 1
    while (hi >> FAN_BITS * depth) - (lo >> FAN_BITS * depth) > TOP_BOXES:
        depth += 1
    return depth


def _slim(segments: DataFrame, cols: ColumnMap) -> DataFrame:
    block = F.col(BLOCK) if BLOCK in segments.columns else F.shiftright(cols.vertex_seq, BLOCK_BITS)
    slim = segments.select(
        F.col(cols.route_id).alias("route"),
        block.alias("block"),
        F.col(cols.vertex_seq).alias("seq"),
        F.col(cols.lon).alias("x0"),
        F.col(cols.lat).alias("y0"),
        F.col(cols.m_value).alias("m0"),
        F.col(f"{cols.lon}1").alias("x1"),
        F.col(f"{cols.lat}1").alias("y1"),
        F.col(f"{cols.m_value}1").alias("m1"),
    ).where("x0 is not null and y0 is not null and y1 is not null")
    return slim.selectExpr("*", f"shiftright(seq, {FAN_BITS}) as node")


def leaf_boxes(segments: DataFrame, cols: ColumnMap = ColumnMap()) -> DataFrame:
    """One row per leaf: its box and a few of its vertices. Does not depend on the depth."""
    # Grouping also by block keeps the partitioning of the segment step. Each
    # vertex kept is the one nearest to its target offset; the order is
    # distinct within a leaf, so x and y are of one vertex.
    offset = f"(seq & {FAN_OUT - 1})"
    vertices = [
        F.expr(f"min_by({c}0, abs({offset} - {target}) * {FAN_OUT} + {offset}) as {name}{c}")
        for name, target in SAMPLES.items()
        for c in "xy"
    ]
    return _slim(segments, cols).groupBy("route", "block", "node").agg(
        F.expr("min(least(x0, x1)) as xmin"),
        F.expr("max(greatest(x0, x1)) as xmax"),
        F.expr("min(least(y0, y1)) as ymin"),
        F.expr("max(greatest(y0, y1)) as ymax"),
        *vertices,
    )


def build_index(
    segments: DataFrame,
    cols: ColumnMap = ColumnMap(),
    depth: int | None = None,
    boxes: DataFrame | None = None,
) -> RouteIndex:
    """Index the output of :func:`chainage.operators.routes.segments`.

    ``depth`` may be given when it is known, for instance from the stored
    snapshot; any depth gives right results. So may ``boxes``, the stored
    :func:`leaf_boxes` of the same segments.
    """
    if depth is None:
        depth = index_depth(segments, cols)
    slim = _slim(segments, cols)
    if boxes is None:
        boxes = leaf_boxes(segments, cols)
    sampled = ", ".join(f"{name}x, {name}y" for name in SAMPLES)
    gathered = F.expr(f"collect_list(struct(node, xmin, xmax, ymin, ymax, {sampled})) as boxes")
    levels: list[DataFrame] = []
    for level in range(1, depth):
        keys = ["route", "block"] if (level + 1) * FAN_BITS <= BLOCK_BITS else ["route"]
        grouped = boxes.groupBy(*keys, F.expr(f"shiftright(node, {FAN_BITS}) as parent")).agg(
            gathered,
            F.expr("min(xmin) as xmin"),
            F.expr("max(xmax) as xmax"),
            F.expr("min(ymin) as ymin"),
            F.expr("max(ymax) as ymax"),
            F.expr("min_by(vx, node) as vx"),
            F.expr("min_by(vy, node) as vy"),
        )
        levels.append(grouped.selectExpr("route", "parent as node", "boxes"))
        boxes = grouped.withColumnRenamed("parent", "node").drop("boxes")
        gathered = F.expr("collect_list(struct(node, xmin, xmax, ymin, ymax, vx, vy)) as boxes")
    return RouteIndex((boxes.groupBy("route").agg(gathered), *reversed(levels)), slim)


def descend(places: DataFrame, index: RouteIndex, inside: bool = False) -> DataFrame:
    """Leaves of each place's route that may hold its nearest segment.

    ``places`` has (route, x, y, ...); the result adds ``node`` (a leaf) and
    ``reach2``, the squared distance no nearest segment can exceed. Places of
    unknown routes are dropped; places without coordinates keep one row with a
    null node. ``inside=True`` asks for leaves whose box contains the place.
    """
    found, top = salted(places, index.levels[0])
    return _descend(found, [f"`{c}`" for c in places.columns], (top, *index.levels[1:]), inside)


def salted(places: DataFrame, *tables: DataFrame, counted: bool = False) -> list[DataFrame]:
    """The places with a ``_salt`` of their own, and tables of a row per route with every salt of the route.

    There are ``SALTS`` for each route. With ``counted`` a route has one for every ``HOT_PLACES`` of its places, so long rows
    of ``tables`` are repeated only where that pays, for another look at the places. They must be distinct then.
    """
    salts, last = F.lit(SALTS), F.lit(SALTS - 1)
    if counted:
        per_route = places.groupBy("route").agg(F.expr(f"cast(ceil(count(1) / {HOT_PLACES}) as int) as _salts"))
        # At most a row for HOT_PLACES places.
        hot = F.broadcast(per_route.where("_salts > 1"))
        places, *tables = (t.join(hot, "route", "left") for t in (places, *tables))
        salts, last = F.coalesce("_salts", F.lit(1)), F.coalesce(F.col("_salts") - 1, F.lit(0))
    own = F.pmod(F.xxhash64("x", "y"), salts).cast("int")
    spread = [t.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))) for t in tables]
    return [t.drop("_salts") for t in (places.withColumn("_salt", own), *spread)]


def candidates(places: DataFrame, index: RouteIndex, counted: bool = True) -> tuple[DataFrame, list[str]]:
    """Each place with the segments of its route that may be nearest, and the columns to group its rows by.

    ``places`` has (route, x, y, ...). Adds node and reach2 as :func:`descend` does, and seq, x0, y0, m0, x1, y1, m1, which are
    null where there is no leaf. With one level, the columns to group by are those that the result is partitioned by
    already: places are shuffled once, by route and salt, and candidates not at all. ``counted`` is that of :func:`salted`.
    """
    gap2 = box_gap2(
        "x", "y", "least(x0, x1)", "greatest(x0, x1)", "least(y0, y1)", "greatest(y0, y1)"
    )
    reached = f"node is null or {gap2} <= reach2"
    if len(index.levels) > 1:
        near = descend(places, index).join(index.segments.drop("block"), ["route", "node"], "left")
        return near.where(reached), places.columns
    found, boxes, segments = salted(places, index.levels[0], index.by_route(), counted=counted)
    # A place grows to several candidates, which the task sorts. Adaptive execution goes by the places' few bytes and
    # would merge partitions until these don't fit its memory; a number that is given it leaves as it is.
    found = found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "route", "_salt")
    kept = [f"`{c}`" for c in found.columns]
    leaves = _descend(found, kept, (boxes,)).join(segments, ["route", "_salt"], "left")
    near = leaves.selectExpr(*kept, "node", "reach2", "explode_outer(leaves[node]) as seg")
    return near.selectExpr(*kept, "node", "reach2", "seg.*").where(reached), found.columns


def _descend(found: DataFrame, kept: list[str], levels, inside: bool = False) -> DataFrame:
    content = "array_min(transform(boxes, b -> {}))".format(point_gap2("x", "y", "b.vx", "b.vy"))
    reach2 = _with_slack(content)
    near2 = box_gap2("x", "y", "box.xmin", "box.xmax", "box.ymin", "box.ymax")
    # False for NaN too, which Spark orders above every number.
    known = f"abs(x) < {FARTHEST!r}D and abs(y) < {FARTHEST!r}D"
    for depth, level in enumerate(levels):
        if depth == 0:
            found = found.join(level, ["route", "_salt"])
            bound = reach2
        else:
            found = found.join(level, ["route", "node"], "left")
            bound = f"least(reach2, {reach2})"
        found = (
            found.selectExpr(*kept, f"{'0D' if inside else bound} as reach2", "boxes")
            .selectExpr(
                *kept,
                "reach2",
                f"explode_outer(case when {known} then boxes end) as box",
            )
            .where(f"box is null or {near2} <= reach2")
        )
        names = SAMPLES if depth == len(levels) - 1 else ()
        # The slack grows with the distance, so the least bound is that of the least distance.
        bounds = ", ".join(point_gap2("x", "y", f"box.{n}x", f"box.{n}y") for n in names)
        tight = "reach2" if inside or not bounds else f"least(reach2, {_with_slack(f'least({bounds})')})"
        found = found.selectExpr(*kept, f"{tight} as reach2", "box.node as node")
    return found


def _with_slack(distance2: str) -> str:
    return f"pow(sqrt({distance2}) * {1 + RELATIVE_SLACK!r}D + {SLACK!r}D, 2D)"
