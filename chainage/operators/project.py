"""Projection of whole tables between the two supported CRSs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainage.contract import ColumnMap, ContractError
from chainage.functions.projection import check_crs, to_degrees, to_grid


def project(
    df: DataFrame, from_crs: str, to_crs: str, cols: ColumnMap = ColumnMap()
) -> DataFrame:
    """Coordinates in ``to_crs``; the two coordinate columns move to the end.

    A table already in ``to_crs`` is returned as it is.
    """
    missing = [c for c in (cols.lon, cols.lat) if c not in df.columns]
    if missing:
        raise ContractError(f"missing required columns: {missing}")
    if check_crs(from_crs) == check_crs(to_crs):
        return df
    convert = to_grid if from_crs.startswith("EPSG:") else to_degrees
    lon, lat = convert(F.col(cols.lon).cast("double"), F.col(cols.lat).cast("double"))
    rest = [c for c in df.columns if c not in (cols.lon, cols.lat)]
    return df.select(*rest, lon.alias(cols.lon), lat.alias(cols.lat))
