"""Route payloads in ESRI JSON to route vertices.

A payload is one page of a feature service. Pages are rows of text, one file
each on disk, so a landing folder of any number of pages is read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainage.contract import ContractError
from chainage.functions.projection import LAMBERT_WKT, to_grid

PAYLOAD_SCHEMA = (
    "spatialReference struct<wkt string, wkt2 string>, "
    "features array<struct<geometry struct<hasM boolean, paths array<array<array<double>>>>, "
    "attributes variant>>"
)


def read_payloads(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per landed file: payload text, its path, and the page's offset.

    The offset is read from the path, where it follows ``offset=`` or ``offset-``; it is null if the path names none.
    With ``lines`` a file holds a payload per line instead, for pages so many that a file each would be costly.
    """
    file = F.col("_metadata.file_path")
    named = F.regexp_extract(file, r"offset[=-](\d+)", 1)
    # Folders of any depth; their names are not columns here.
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=not lines)
    return files.select(
        F.col("value").alias("payload"), file.alias("file"), named.try_cast("bigint").alias("offset")
    )


def features(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per feature; ``problem`` says why it cannot become a route, else null."""
    rest = [c for c in payloads.columns if c != column]
    page = payloads.select(*rest, F.from_json(column, PAYLOAD_SCHEMA).alias("_page"))
    exploded = page.select(
        *rest,
        F.coalesce(
            F.nullif(F.col("_page.spatialReference.wkt"), F.lit("")),
            F.nullif(F.col("_page.spatialReference.wkt2"), F.lit("")),
        ).alias("wkt"),
        F.posexplode_outer("_page.features").alias("feature_index", "_feature"),
    )
    link = F.try_variant_get("_feature.attributes", "$.LINKID", "variant")
    is_text = F.schema_of_variant(link) == "STRING"
    routed = exploded.select(
        *rest,
        "feature_index",
        "wkt",
        F.when(is_text, F.try_variant_get("_feature.attributes", "$.LINKID", "string")).alias(
            "ROUTEID"
        ),
        F.col("_feature.attributes").alias("attributes"),
        F.col("_feature.geometry.paths").alias("paths"),
    )
    problem = (
        F.when(F.col("feature_index").isNull(), "payload is not readable or has no features")
        .when(F.coalesce(F.size(F.flatten("paths")), F.lit(0)) <= 0, "missing or invalid paths")
        .when(F.col("ROUTEID").isNull(), "missing or invalid LINKID")
        .when(F.col("wkt").isNull(), "missing or invalid wkt")
        .when(~(F.col("wkt") == LAMBERT_WKT) & ~_geographic(F.col("wkt")), "unsupported CRS")
    )
    return routed.withColumn("problem", problem)


def with_service_columns(parsed: DataFrame) -> DataFrame:
    """The parsed features with FROMDATE and TODATE as timestamps and ROAD_STATUS, in place of ``attributes``.

    The service writes dates as milliseconds since 1970; digits in text count the same, other text as a date. A date
    that can't be read is a problem, as a feature without one would count as in force.
    """
    dates, unread = {}, F.lit(False)
    for name in ("FROMDATE", "TODATE"):
        text = F.try_variant_get("attributes", f"$.{name}", "string")
        millis = F.timestamp_millis(text.try_cast("double").try_cast("bigint"))
        dates[name] = F.coalesce(millis, F.try_to_timestamp(text))
        unread = unread | (text.isNotNull() & dates[name].isNull())
    problem = F.coalesce("problem", F.when(unread, "invalid FROMDATE or TODATE"))
    status = F.try_variant_get("attributes", "$.ROAD_STATUS", "string")
    return parsed.withColumns(dates | {"ROAD_STATUS": status, "problem": problem}).drop("attributes")


def points(parsed: DataFrame, mode: str = "fail", with_path: bool = False) -> DataFrame:
    """Route vertices of the parsed features, numbered 0.. across a route's paths.

    ``mode="skip"`` leaves out features with a problem (list them with
    :func:`rejected`); ``"fail"`` raises on the first. Geographic routes are
    projected to the working grid. ``with_path`` adds PATH_SEQ.
    """
    if mode not in ("fail", "skip"):
        raise ContractError("mode must be 'fail' or 'skip'")
    if mode == "skip":
        good = parsed.where(F.col("problem").isNull())
    else:
        stop = F.raise_error(F.concat(F.lit("feature cannot become a route: "), F.col("problem")))
        good = parsed.where(
            F.when(F.col("problem").isNotNull(), stop.cast("boolean")).otherwise(F.lit(True))
        )
    tagged = F.flatten(
        F.transform("paths", lambda path, i: F.transform(path, lambda v: F.struct(i.alias("p"), v.alias("v"))))
    )
    vertex = good.select(
        "ROUTEID", "wkt", F.posexplode(tagged).alias("VERTEX_SEQ", "_vertex")
    )
    lon, lat, m = (F.coalesce(F.get("_vertex.v", F.lit(i)), F.lit(0.0)) for i in range(3))
    grid_x, grid_y = to_grid(lon, lat)
    geographic = _geographic(F.col("wkt"))
    return vertex.select(
        F.when(geographic, grid_y).otherwise(lat).alias("LAT"),
        F.when(geographic, grid_x).otherwise(lon).alias("LON"),
        m.alias("MVAL"),
        "VERTEX_SEQ",
        "ROUTEID",
        *([F.col("_vertex.p").alias("PATH_SEQ")] if with_path else []),
    )


def rejected(parsed: DataFrame) -> DataFrame:
    """The features that cannot become routes, with the reason."""
    return parsed.where(F.col("problem").isNotNull()).drop("paths", "attributes")


def _geographic(wkt: Column) -> Column:
    return wkt.startswith("GEOGCS[") & wkt.contains("WGS_1984")
