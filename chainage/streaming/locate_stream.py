"""Location of a stream of events against a fixed route snapshot."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chainage.contract import ColumnMap
from chainage.functions.projection import GEOGRAPHIC
from chainage.operators.index import RouteIndex
from chainage.operators.locate import calculate_m_value


def read_event_stream(
    spark: SparkSession, path: str, schema, max_files: int | None = None
) -> DataFrame:
    """Event files in a folder as a stream; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


#: A completed attempt at a micro-batch.
DONE = "batch_id bigint, attempt string, finished bigint"


def read_located(spark: SparkSession, target: str) -> DataFrame:
    """What a running or stopped stream has completed, each micro-batch once, with its ``batch_id``.

    Only listed attempts are read, of a batch that was tried again the one that was completed last: neither a folder
    that is being written nor one that a lost driver has left is seen. A list not yet begun is an empty result
    only to a caller that catches PATH_NOT_FOUND.
    """
    listed = spark.read.schema(DONE).parquet(f"{target}/done")
    last = listed.groupBy("batch_id").agg(F.max_by("attempt", "finished").alias("attempt"))
    rows = spark.read.parquet(f"{target}/data")
    kinds = {c: rows.schema[c].dataType for c in ("batch_id", "attempt")}
    chosen = last.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    return rows.join(chosen, list(kinds), "left_semi").drop("attempt")


def locate_stream(
    events: DataFrame,
    snapshot: Callable[[DataFrame], RouteIndex],
    target: str,
    checkpoint: str,
    cols: ColumnMap = ColumnMap(),
    crs: str = GEOGRAPHIC,
    unmatched: str = "drop",
    continuous: bool = False,
) -> StreamingQuery:
    """Write each micro-batch, located, to a folder of its own under ``target``; :func:`read_located` reads them.

    ``snapshot`` is asked for an index once per micro-batch, so a newly
    published route version takes effect between batches; it is given the batch
    and may open only that batch's routes (``jobs.index_for``). Every attempt at a batch writes a folder of its
    own, and is listed under ``target/done`` when it is complete. Without ``continuous`` the query
    stops when all present files are done.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        attempt = uuid.uuid4().hex
        located = calculate_m_value(batch, snapshot(batch), cols, crs, unmatched)
        located.write.parquet(f"{target}/data/batch_id={batch_id}/attempt={attempt}")
        done = batch.sparkSession.createDataFrame([(batch_id, attempt, time.time_ns())], DONE)
        done.coalesce(1).write.mode("append").parquet(f"{target}/done")

    writer = events.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start()
