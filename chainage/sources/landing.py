"""Checks on landed pages of a feature service."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainage.contract import ColumnMap, ContractError
from chainage.operators.routes import only_routes


class LandingError(ContractError):
    """Pages are missing, short or not planned; ``pages`` lists them all."""

    def __init__(self, pages: DataFrame):
        some = [f"{r['offset']} ({r['landed_rows']} of {r['expected_rows']})" for r in pages.orderBy("offset").limit(5).collect()]
        super().__init__(f"pages did not land as announced, for instance at offset {', '.join(some)}")
        self.pages = pages


def in_force(as_of: datetime | str | Column) -> Column:
    """Has the feature started, not ended, and road status N?"""
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    started = F.col("FROMDATE").isNull() | (F.col("FROMDATE") < moment)
    return F.col("TODATE").isNull() & started & F.col("ROAD_STATUS").eqNullSafe("N")


def active_routes(
    features: DataFrame, as_of: datetime | str | Column, route_ids=None, id_column: str = "RouteId"
) -> DataFrame:
    """Features in force at ``as_of``: started, not ended, road status N."""
    active = features.where(in_force(as_of))
    if route_ids is None:
        return active
    return only_routes(active, route_ids, ColumnMap(route_id=id_column))


def landing_check(landed: DataFrame, expected: int | DataFrame, page_size: int) -> DataFrame:
    """Pages whose landed row count is not what the service announced.

    ``landed`` has one row per feature with its page's ``offset``; ``expected``
    is the announced feature count, or a table of one row with it. Pages that
    the count doesn't plan for have 0 expected rows. Result: offset, expected_rows, landed_rows.
    """
    if isinstance(expected, DataFrame):
        total = F.col("_total")
        none, step = (F.lit(n).cast("bigint") for n in (0, page_size))
        offsets = F.explode(F.sequence(none, F.greatest(total - 1, none), step))
        plan = expected.toDF("_total").select(total, offsets.alias("id")).where(F.col("id") < total)
    else:
        total = F.lit(expected)
        plan = landed.sparkSession.range(0, expected, page_size)
    plan = plan.select(
        F.col("id").alias("offset"),
        F.least(F.lit(page_size).cast("bigint"), total - F.col("id")).alias("expected_rows"),
    )
    counts = landed.groupBy(F.col("offset").cast("bigint").alias("offset")).agg(
        F.count(F.lit(1)).alias("landed_rows")
    )
    none = F.lit(0).cast("bigint")
    return (
        plan.join(counts, "offset", "full")
        .withColumns({c: F.coalesce(c, none) for c in ("expected_rows", "landed_rows")})
        .where("landed_rows <> expected_rows")
    )
