"""Session settings that suit the location jobs; all are ordinary Spark settings.

A search step turns a few bytes per place into much arithmetic, so its
partitions should be smaller than Spark's byte-based defaults. The skew-join
settings let adaptive execution split a route or place that very many events
share.
"""

LOCATION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
}
