"""Route tables derived from vertices: segments, linestrings, filters.

No step gathers one whole route. A route is cut into blocks of consecutive
``VERTEX_SEQ`` values; each block also gets the first vertex of the next one,
so neighbours can be paired inside a block. ``VERTEX_SEQ`` is a 32-bit
integer, so a route has at most 2^17 blocks and the step that finds the next
block handles at most that many rows per route.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainage.contract import ColumnMap, ContractError

BLOCK_BITS = 15
MAX_IN_LIST = 1000
SALTS = 16
EDGE = "_edge"
BLOCK = "_block"


def close_blocks(
    points: DataFrame, cols: ColumnMap, bits: int = BLOCK_BITS, dense: bool = False
) -> DataFrame:
    """Add ``_block`` and, per block, one ``_edge`` row: the next block's first vertex.

    ``dense=True`` promises that every route numbers its vertices without gaps
    from 0 on; the first vertex of a block is then known from its number and
    one pass suffices. A broken promise raises in :func:`segments`.
    """
    seq = F.col(cols.vertex_seq)
    block = F.shiftright(seq, bits)
    if dense:
        own = F.struct(block.alias("b"), F.lit(False).alias("e"))
        before = F.struct((block - 1).alias("b"), F.lit(True).alias("e"))
        starts_block = (seq > 0) & (seq.bitwiseAND(F.lit((1 << bits) - 1)) == 0)
        copies = F.when(starts_block, F.array(own, before)).otherwise(F.array(own))
        return points.withColumn("_copy", F.explode(copies)).select(
            *points.columns, F.col("_copy.b").alias(BLOCK), F.col("_copy.e").alias(EDGE)
        )
    keyed = points.withColumn(BLOCK, block).withColumn(EDGE, F.lit(False))
    kept = [c for c in (cols.lon, cols.lat, cols.m_value, "PATH_SEQ") if c in points.columns]
    heads = keyed.groupBy(cols.route_id, BLOCK).agg(
        F.min(cols.vertex_seq).alias(cols.vertex_seq),
        *[F.min_by(c, cols.vertex_seq).alias(c) for c in kept],
    )
    by_block = Window.partitionBy(cols.route_id).orderBy(BLOCK)
    edges = (
        heads.withColumn("_before", F.lag(BLOCK).over(by_block))
        .where(F.col("_before").isNotNull())
        .withColumn(BLOCK, F.col("_before"))
        .drop("_before")
        .withColumn(EDGE, F.lit(True))
    )
    return keyed.unionByName(edges, allowMissingColumns=True)


def segments(
    points: DataFrame,
    cols: ColumnMap = ColumnMap(),
    dense: bool = False,
    by_path: bool = False,
    with_block: bool = False,
) -> DataFrame:
    """Every vertex with its successor on the route; the last vertex is dropped.

    ``by_path=True`` also drops the joint between two paths of one route
    (needs PATH_SEQ). The gradient is null where it has no finite value.
    ``with_block`` keeps the column the rows are partitioned by, so that an
    index can be built on them without another shuffle.
    """
    cols.require(points, cols.m_value, cols.vertex_seq)
    if by_path and "PATH_SEQ" not in points.columns:
        raise ContractError("by_path needs a PATH_SEQ column")
    lon, lat, m = cols.lon, cols.lat, cols.m_value
    others = [c for c in points.columns if c not in (lon, lat, m, cols.vertex_seq)]
    # The coordinates and the measure order what the numbers leave open. As sort keys they also stay in every plan's
    # shuffle, whatever is taken from it, so that a plan with both boxes and segments shuffles the vertices once.
    in_block = Window.partitionBy(cols.route_id, BLOCK).orderBy(cols.vertex_seq, EDGE, lon, lat, m)
    closed = close_blocks(points, cols, dense=dense)
    paired = closed.withColumns(
        {f"{c}1": F.lead(c).over(in_block) for c in (lon, lat, m)}
        | ({"_path1": F.lead("PATH_SEQ").over(in_block)} if by_path else {})
        | ({"_before": F.lag(cols.vertex_seq).over(in_block)} if dense else {})
    )
    if dense:
        seq = F.col(cols.vertex_seq)
        starts_block = seq.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) == 0
        gap = F.col("_before").isNull() & (F.col(EDGE) | ((F.col(BLOCK) != 0) & ~starts_block))
        broken = F.raise_error(F.lit("VERTEX_SEQ has gaps: call segments with dense=False"))
        paired = paired.where(F.when(gap, broken.cast("boolean")).otherwise(F.lit(True)))
    kept = paired.where(~F.col(EDGE) & F.col(f"{lon}1").isNotNull())
    if by_path:
        kept = kept.where(F.col("_path1") == F.col("PATH_SEQ"))
    gradient = F.try_divide(F.col(f"{lat}1") - F.col(lat), F.col(lon) - F.col(f"{lon}1"))
    return kept.withColumn("mvgradient", gradient).select(
        *others,
        lon,
        lat,
        m,
        cols.vertex_seq,
        f"{lon}1",
        f"{lat}1",
        f"{m}1",
        "mvgradient",
        (F.col(lat) - F.col("mvgradient") * F.col(lon)).alias("c"),
        *([BLOCK] if with_block else []),
    )


LINE_BITS = 16


def linestrings(
    points: DataFrame, cols: ColumnMap = ColumnMap(), bits: int | None = None
) -> DataFrame:
    """One row per route and part: ROUTEID, PART, n_vertices, vertices.

    A part holds at most 2^``bits`` consecutive vertices (2^16 if not given), so a road of ordinary
    length is one row. A longer route continues in further parts; each of them
    ends with the first vertex of the next, so the parts join without a gap.
    """
    cols.require(points, cols.m_value, cols.vertex_seq)
    slim = points.select(cols.route_id, cols.vertex_seq, cols.lon, cols.lat, cols.m_value)
    vertex = F.struct(
        F.col(cols.vertex_seq).alias("VERTEX_SEQ"),
        F.col(cols.lon).alias("LON"),
        F.col(cols.lat).alias("LAT"),
        F.col(cols.m_value).alias("M"),
    )
    return (
        close_blocks(slim, cols, bits=LINE_BITS if bits is None else bits)
        .groupBy(F.col(cols.route_id).alias("ROUTEID"), F.col(BLOCK).alias("PART"))
        .agg(
            F.count_if(~F.col(EDGE)).cast("int").alias("n_vertices"),
            F.array_sort(F.collect_list(vertex)).alias("vertices"),
        )
    )


def with_wkt(lines: DataFrame, decimals: int = 6) -> DataFrame:
    """Add ``wkt``: LINESTRING ZM text with Z fixed at 0."""
    number = f"%.{decimals}f"
    text = F.transform(
        "vertices",
        lambda v: F.format_string(f"{number} {number} 0 {number}", v["LON"], v["LAT"], v["M"]),
    )
    return lines.withColumn(
        "wkt", F.concat(F.lit("LINESTRING ZM ("), F.concat_ws(", ", text), F.lit(")"))
    )


def with_has_m(lines: DataFrame) -> DataFrame:
    """Add ``has_m``: does any vertex of the route, in whichever part, carry a measure."""
    some = F.exists("vertices", lambda v: v["M"].isNotNull())
    per_route = lines.groupBy("ROUTEID").agg(F.max(some).alias("has_m"))
    return lines.join(per_route, "ROUTEID")


def route_has_m(points: DataFrame, cols: ColumnMap = ColumnMap()) -> DataFrame:
    """ROUTEID and has_m of every route, straight from its vertices."""
    cols.require(points, cols.m_value)
    return points.groupBy(F.col(cols.route_id).alias("ROUTEID")).agg(
        F.bool_or(F.col(cols.m_value).isNotNull()).alias("has_m")
    )


def only_routes(table: DataFrame, routes, cols: ColumnMap = ColumnMap()) -> DataFrame:
    """Rows of the given routes.

    ``routes`` is one id, a list of ids (pushed to the scan) or a DataFrame
    with the route-id column (semi join, for any number of ids).
    """
    key = F.col(cols.route_id)
    if isinstance(routes, str):
        return table.where(key == routes)
    if isinstance(routes, DataFrame):
        return join_ids(table, routes.select(cols.route_id), "left_semi", cols)
    ids = list(routes)
    if len(ids) > MAX_IN_LIST:
        wanted = table.sparkSession.createDataFrame([(i,) for i in ids], f"`{cols.route_id}` string")
        return join_ids(table, wanted, "left_semi", cols)
    return table.where(key.isin(ids))


def join_ids(
    table: DataFrame, ids: DataFrame, how: str, cols: ColumnMap = ColumnMap()
) -> DataFrame:
    """Rows whose route is (``left_semi``) or is not (``left_anti``) among ``ids``.

    A long route's rows are spread over several join keys by their place on
    the route, and each id is offered under all of them.
    """
    wanted = ids.select(cols.route_id).distinct()
    if cols.vertex_seq in table.columns:
        spread = F.pmod(F.shiftright(cols.vertex_seq, BLOCK_BITS), F.lit(SALTS))
    elif "PART" in table.columns:
        spread = F.pmod("PART", F.lit(SALTS))
    elif "block" in table.columns:
        spread = F.pmod("block", F.lit(SALTS))
    else:
        return table.join(wanted, cols.route_id, how)
    offered = wanted.withColumn("_spread", F.explode(F.lit(list(range(SALTS)))))
    salted = table.withColumn("_spread", F.coalesce(spread, F.lit(0)).cast("int"))
    return salted.join(offered, [cols.route_id, "_spread"], how).select(*table.columns)


def union_sources(*tables: DataFrame) -> DataFrame:
    """All rows of several route tables, columns matched by name."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table)
    return first


def duplicate_vertices(points: DataFrame, cols: ColumnMap = ColumnMap()) -> DataFrame:
    """Vertex numbers that occur more than once: a route delivered twice."""
    return (
        points.groupBy(cols.route_id, cols.vertex_seq)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )
