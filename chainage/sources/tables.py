"""Event and route tables in Parquet: read, write, compact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainage.contract import ColumnMap, ContractError


#: Where a row stood in the input: its file, and its place in that file.
INPUT_FILE, INPUT_ROW = "INPUT_FILE", "INPUT_ROW"


def read_events(
    spark: SparkSession, path: str, with_order: bool = False, **names: str | None
) -> tuple[DataFrame, ColumnMap]:
    """An event table and its column names, found by alias unless given.

    ``with_order`` adds INPUT_FILE and INPUT_ROW, which name a row wherever it is read, also when a
    task is repeated; :func:`chainage.operators.events.restore_order` sorts by them.
    """
    df = spark.read.parquet(path)
    found = ColumnMap.detect(df, **names)
    if with_order:
        taken = sorted({INPUT_FILE, INPUT_ROW} & {c.upper() for c in df.columns})
        if taken:
            raise ContractError(f"the input has columns of its own called {taken}")
        place = {INPUT_FILE: F.col("_metadata.file_path"), INPUT_ROW: F.col("_metadata.row_index")}
        df = df.withColumns(place)
    return df, found


def write_table(df: DataFrame, path: str, sort_by: tuple[str, ...] = ()) -> None:
    """Write Parquet (Snappy); never over an existing table."""
    ordered = df.sortWithinPartitions(*sort_by) if sort_by else df
    ordered.write.mode("errorifexists").option("compression", "snappy").parquet(path)


def compact(spark: SparkSession, source: str, target: str, order: tuple[str, ...] = ()) -> None:
    """Rewrite many small files into few of the session's advisory partition size.

    The rebalance shuffle merges small and splits large partitions at run time. With ``order`` the
    rows are cut by ranges of these columns instead and sorted, so that every file holds a run of them.
    """
    rows = spark.read.parquet(source)
    write_table(rows.repartitionByRange(*order) if order else rows.hint("rebalance"), target, order)


def route_columns(df: DataFrame) -> DataFrame:
    """A points table in its fixed column order and types."""
    return df.select(
        F.col("LAT").cast("double"),
        F.col("LON").cast("double"),
        F.col("MVAL").cast("double"),
        F.col("VERTEX_SEQ").cast("int"),
        F.col("ROUTEID").cast("string"),
    )
