"""Version catalog: which data belongs to which route version, and when.

Rows are only ever appended. A version ends on the day the next one of the
same catalog starts; that day is computed when reading, not stored. ``by``
names the columns that tell several catalogs in one table apart.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_end_dates(catalog: DataFrame, by: list[str]) -> DataFrame:
    """Add END_DATE, null for the open version of each catalog."""
    order = Window.partitionBy(*by).orderBy("VERSION")
    return catalog.withColumn("END_DATE", F.lead("START_DATE").over(order))


def latest(dated: DataFrame, by: list[str]) -> DataFrame:
    """The open row with the highest version, per catalog."""
    return _highest(dated.where(F.col("END_DATE").isNull()), by)


def as_of(dated: DataFrame, day: date | str, by: list[str]) -> DataFrame:
    """The version in force on a day, per catalog (an addition of ours)."""
    moment = F.lit(day).cast("date")
    in_force = (F.col("START_DATE") <= moment) & (
        F.col("END_DATE").isNull() | (moment < F.col("END_DATE"))
    )
    return _highest(dated.where(in_force), by)


def next_version(catalog: DataFrame, by: list[str]) -> DataFrame:
    """One more than the highest version; 1 for an empty catalog when ``by`` is empty."""
    return catalog.groupBy(*by).agg(
        (F.coalesce(F.max("VERSION"), F.lit(0)) + 1).cast("int").alias("NEXT_VERSION")
    )


def _highest(rows: DataFrame, by: list[str]) -> DataFrame:
    whole = F.struct(*[F.col(c) for c in rows.columns])
    best = rows.groupBy(*by).agg(F.max_by(whole, "VERSION").alias("_row"))
    return best.where(F.col("_row").isNotNull()).select("_row.*")
