"""Event-table operators around the location step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainage.contract import ColumnMap, ContractError, route_key


def event_route_ids(events: DataFrame, cols: ColumnMap = ColumnMap()) -> DataFrame:
    """The distinct route ids that occur in the events."""
    ids = events.select(route_key(events, cols.route_id).alias(cols.route_id))
    return ids.where(F.col(cols.route_id).isNotNull()).distinct()


def match_report(events: DataFrame, routes: DataFrame, cols: ColumnMap = ColumnMap()) -> DataFrame:
    """Per route id of the events: how many there are and how many have a route.

    ``routes`` is any table with the route-id column. Events are counted
    before the join, so a route with very many events is one row in it.
    """
    counted = events.groupBy(route_key(events, cols.route_id).alias(cols.route_id)).agg(
        F.count(F.lit(1)).alias("events")
    )
    known = routes.select(cols.route_id).distinct().withColumn("_known", F.lit(True))
    matched = F.when(F.col("_known"), F.col("events")).otherwise(F.lit(0))
    return counted.join(known, cols.route_id, "left").select(
        cols.route_id,
        "events",
        matched.alias("matched"),
        (F.col("events") - matched).alias("unmatched"),
    )


def best_candidate(candidates: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by the order columns; spare rows drop map-side."""
    if not order:
        raise ContractError("best_candidate needs at least one order column")
    whole = F.struct(*[F.col(c) for c in candidates.columns])
    rank = F.struct(*[F.col(c) for c in order])
    best = candidates.groupBy(key).agg(F.min_by(whole, rank).alias("_best"))
    return best.select("_best.*")


def route_sample(
    events: DataFrame,
    n: int,
    key: str,
    cols: ColumnMap = ColumnMap(),
    order: Column | None = None,
) -> DataFrame:
    """One event per route (the least key), then ``n`` of them.

    The choice of routes is pseudo-random but repeatable, or follows ``order``.
    """
    one = best_candidate(events.where(F.col(cols.route_id).isNotNull()), cols.route_id, key)
    return one.orderBy(F.xxhash64(F.lit(42), key) if order is None else order, key).limit(n)


def restore_order(events: DataFrame, *key: str, drop: bool = False) -> DataFrame:
    """Sort by the columns that tell the input order (a range-partitioned sort).

    That is a key of the caller's, or the place in the files that ``tables.read_events`` adds on request.
    """
    if not key:
        raise ContractError("restore_order needs the columns that tell the input order")
    ordered = events.orderBy(*key)
    return ordered.drop(*key) if drop else ordered


def replace_columns(df: DataFrame, **values: Column) -> DataFrame:
    """Drop the named columns where present and append their new values, in order."""
    kept = [F.col(c) for c in df.columns if c not in values]
    return df.select(*kept, *[v.alias(n) for n, v in values.items()])


def require_rows(df: DataFrame, what: str = "result") -> DataFrame:
    """Raise if the table is empty (reads until the first row)."""
    if df.isEmpty():
        raise ContractError(f"{what} has no rows")
    return df
