"""Merge of a batch of routes into an existing route table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainage.contract import ColumnMap
from chainage.operators.routes import join_ids


def merge_routes(
    previous: DataFrame | None,
    batch: DataFrame,
    cols: ColumnMap = ColumnMap(),
    replaced: DataFrame | None = None,
) -> DataFrame:
    """Previous rows of routes the batch does not have, and all batch rows.

    ``replaced`` gives the batch's route ids where they are not those of
    ``batch`` itself (a route may have vertices but no segment).
    """
    if previous is None:
        return batch
    ids = (batch if replaced is None else replaced).select(cols.route_id)
    ids = ids.where(F.col(cols.route_id).isNotNull())
    return join_ids(previous, ids, "left_anti", cols).unionByName(batch)
