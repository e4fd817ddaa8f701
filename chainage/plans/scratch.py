"""A shared folder for tables a job writes for itself."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new path under the cluster's checkpoint folder, which the session must name."""
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
