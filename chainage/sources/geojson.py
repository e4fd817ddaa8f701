"""GeoJSON FeatureCollections to event tables, validation, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainage.contract import ColumnMap, ContractError
from chainage.plans.scratch import scratch_dir

FEATURE = "type string, geometry struct<type string, coordinates variant>, properties variant"
COLLECTION_SCHEMA = f"type string, features array<struct<{FEATURE}>>"
LINE_SCHEMA = f"{FEATURE}, features array<struct<{FEATURE}>>"
#: How most writers, ours included, begin a Feature.
SEPARATOR = '{"type":"Feature"'
MAX_KEYS = 2000


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: document text and its path."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("value").alias("document"), F.col("_metadata.file_path").alias("file"))


def features(documents: DataFrame, column: str = "document") -> DataFrame:
    """One row per feature: feature_index, feature_type, geometry_type, coordinates, properties.

    A document without features keeps one row with a null index.
    """
    rest = [c for c in documents.columns if c != column]
    parsed = documents.select(*rest, F.from_json(column, COLLECTION_SCHEMA).alias("_doc"))
    return _unfolded(parsed, rest, F.col("_doc.type"), F.col("_doc.features"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files of a Feature per line, as the columns of :func:`features` and the file; cut at any line, so of any size.

    A line may also hold a whole collection. Each line is a document, so its one Feature has the index 0.
    Blank lines are left out; a line that is neither keeps one row, which is a problem.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", LINE_SCHEMA).alias("_doc"))
    own = F.struct(*[F.col(f"_doc.{c}").alias(c) for c in ("type", "geometry", "properties")])
    whole = F.col("_doc.type").eqNullSafe("FeatureCollection")
    single = F.col("_doc.type").isNotNull() & ~whole
    return _unfolded(
        parsed,
        ["file"],
        F.when(whole | single, "FeatureCollection"),
        F.when(single, F.array(own)).when(whole, F.col("_doc.features")),
    )


def read_split(spark: SparkSession, path: str, separator: str = SEPARATOR) -> DataFrame:
    """Files of one collection each, as the columns of :func:`features` and the file, cut where Features begin.

    ``separator`` is the text that Features begin with; files are divided among tasks at it, so a collection may be
    larger than a row. Within a JSON text value quotes are escaped, so it can't occur there. A Feature that begins
    otherwise stays in the piece of the one before and is read with it, and a file without the separator is
    read whole. A Feature that holds the separator itself, as an object in its properties, is cut in two and
    keeps rows that are a problem. ``feature_index`` counts within a piece.
    """
    pieces = spark.read.option("lineSep", separator).text(path).where(F.trim("value") != "")
    # The rest of a Feature goes on with a comma or a brace, so only a head begins like a document.
    is_head = F.ltrim("value").startswith("{")
    bare = F.col("value").rlike(r'^\s*\{[^\[\]]*"features"\s*:\s*\[\s*$')
    rest = F.regexp_replace(F.concat(F.lit(separator), "value"), r"[\s,]+$", "")
    parsed = pieces.where(~(is_head & bare)).select(
        F.col("_metadata.file_path").alias("file"),
        F.when(is_head, F.from_json("value", COLLECTION_SCHEMA)).alias("_doc"),
        # A piece's last bracket may close the collection; what follows a whole list is not read.
        F.when(~is_head, F.from_json(F.concat(F.lit("["), rest, F.lit("]")), f"array<struct<{FEATURE}>>")).alias("_list"),
    )
    return _unfolded(
        parsed,
        ["file"],
        F.coalesce(F.col("_doc.type"), F.when(F.col("_list").isNotNull(), "FeatureCollection")),
        F.coalesce("_doc.features", "_list"),
    )


def _unfolded(parsed: DataFrame, rest: list[str], collection_type: Column, features: Column) -> DataFrame:
    # Flat already in the list: a filter behind it would read the coordinates once more. The list has a column of its
    # own, so rows don't carry their whole document through the explode.
    flat = F.transform(
        features,
        lambda f: F.when(
            f.isNotNull(),
            F.struct(
                f["type"].alias("feature_type"),
                f["geometry"]["type"].alias("geometry_type"),
                F.try_variant_get(f["geometry"]["coordinates"], "$", "array<double>").alias("coordinates"),
                f["properties"].alias("properties"),
            ),
        ),
    )
    listed = parsed.select(*rest, collection_type.alias("collection_type"), flat.alias("_features"))
    rows = listed.select(*rest, "collection_type", F.posexplode_outer("_features").alias("feature_index", "_f"))
    return rows.select(*rest, "collection_type", "feature_index", "_f.*")


def with_problem(parsed: DataFrame, cols: ColumnMap = ColumnMap()) -> DataFrame:
    """Add ``problem``: the first structural rule a feature breaks, or null."""
    has_route = _property(cols.route_id, "variant").isNotNull()
    problem = (
        F.when(~F.col("collection_type").eqNullSafe("FeatureCollection"), "expected FeatureCollection")
        .when(F.col("feature_index").isNull(), "no features in FeatureCollection")
        .when(~F.col("feature_type").eqNullSafe("Feature"), "expected Feature type")
        .when(~F.col("geometry_type").eqNullSafe("Point"), "only Point geometry is supported")
        .when(
            F.coalesce(F.size("coordinates"), F.lit(0)) < 2,
            "Point must have at least 2 coordinates",
        )
        .when(~has_route, F.lit(f"missing required {cols.route_id} property"))
    )
    return parsed.withColumn("problem", problem)


def problems(parsed: DataFrame, cols: ColumnMap = ColumnMap()) -> DataFrame:
    """The invalid features with their reason."""
    bad = with_problem(parsed, cols).where(F.col("problem").isNotNull())
    return bad.drop("properties", "coordinates")


def valid(parsed: DataFrame, cols: ColumnMap = ColumnMap(), strict: bool = False) -> DataFrame:
    """The valid features; ``strict=True`` fails the job on an invalid one."""
    checked = with_problem(parsed, cols)
    if not strict:
        return checked.where(F.col("problem").isNull()).drop("problem")
    message = F.concat(F.lit("feature "), F.col("feature_index"), F.lit(": "), F.col("problem"))
    stop = F.raise_error(F.coalesce(message, F.col("problem"))).cast("boolean")
    keep = F.when(F.col("problem").isNotNull(), stop).otherwise(F.lit(True))
    return checked.where(keep).drop("problem")


def infer_properties(parsed: DataFrame) -> T.StructType:
    """Columns for all property keys, by name (runs one job).

    All numbers give double, all booleans boolean; anything else, or a mix,
    gives string; :func:`property_conflicts` lists the mixes. Kinds are merged in the tasks, and more than
    MAX_KEYS keys raise: such features need a schema, or their properties are data rather than columns.
    """
    found = (
        _kinds(parsed)
        .groupBy("key")
        .agg(F.min("kind").alias("low"), F.max("kind").alias("high"))
        .limit(MAX_KEYS + 1)
        .collect()
    )
    if len(found) > MAX_KEYS:
        raise ContractError(f"more than {MAX_KEYS} property keys: give a schema")
    found.sort(key=lambda r: r["key"])
    kinds = {"double": T.DoubleType(), "boolean": T.BooleanType()}
    return T.StructType(
        [
            T.StructField(r.key, kinds.get(r.low, T.StringType()) if r.low == r.high else T.StringType())
            for r in found
        ]
    )


def _kinds(parsed: DataFrame) -> DataFrame:
    """``key, kind`` of every property; null values have no kind."""
    entries = parsed.select(
        F.explode(F.expr("cast(properties as map<string, variant>)")).alias("key", "value")
    )
    kind = F.schema_of_variant("value")
    family = (
        F.when(kind == "VOID", None)
        .when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), "double")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "STRING", "string")
        # After every other kind, as objects and lists become text too.
        .otherwise("structure")
    )
    return entries.select("key", family.alias("kind"))


def property_conflicts(parsed: DataFrame) -> DataFrame:
    """Properties whose values are of several kinds: ``key, kind, features``, a row per kind.

    Such a property becomes a string column when the schema is inferred.
    """
    counted = _kinds(parsed).where("kind is not null").groupBy("key", "kind").agg(F.count(F.lit(1)).alias("features"))
    mixed = counted.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    return counted.join(mixed, "key", "left_semi")


def column_names(properties: T.StructType, cols: ColumnMap = ColumnMap(), keep: tuple[str, ...] = ()) -> dict[str, str]:
    """The column of every property: its own name, unless a coordinate, a kept column or another property has that.

    Column names don't tell upper from lower case. A property that meets another name gets the suffix
    ``_PROPERTY``, once more for every further meeting; the route id keeps its name.
    """
    taken = {c.lower() for c in (cols.lat, cols.lon, *keep)}
    out = {}
    for name in sorted(properties.fieldNames(), key=lambda n: n != cols.route_id):
        column = name
        while column.lower() in taken:
            column += "_PROPERTY"
        taken.add(column.lower())
        out[name] = column
    return {name: out[name] for name in properties.fieldNames()}


def events(
    parsed: DataFrame,
    properties: T.StructType | str | None = None,
    cols: ColumnMap = ColumnMap(),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Point features as an event table: kept columns, LAT, LON, then properties.

    ``properties`` is the schema of the property columns; without it the
    schema is inferred by a job over the features. The route-id property must
    be among them. Properties named like another column are renamed (:func:`column_names`).
    """
    if isinstance(properties, str):
        properties = T.StructType.fromDDL(properties)
    schema = infer_properties(parsed) if properties is None else properties
    if cols.route_id not in schema.fieldNames():
        raise ContractError(f"required property {cols.route_id!r} not found in features")
    names = column_names(schema, cols, keep)
    return parsed.where(F.col("feature_index").isNotNull()).select(
        *keep,
        F.get("coordinates", F.lit(1)).alias(cols.lat),
        F.get("coordinates", F.lit(0)).alias(cols.lon),
        *[_property(f.name, f.dataType.simpleString()).alias(names[f.name]) for f in schema],
    )


def to_features(
    df: DataFrame, cols: ColumnMap = ColumnMap(), keep: tuple[str, ...] = ()
) -> DataFrame:
    """One Feature text per row: [lon, lat] and the other columns, nulls left out.

    A row without coordinates fails the job.
    """
    skip = {cols.lat, cols.lon, *keep}
    names = sorted(c for c in df.columns if c not in skip and _exportable(df.schema[c].dataType))
    values = [
        (F.col(c).cast("string") if isinstance(df.schema[c].dataType, T.BinaryType) else F.col(c)).alias(c)
        for c in names
    ]
    stop = F.raise_error(F.lit("null coordinate in GeoJSON export")).cast("double")
    lon, lat = (F.coalesce(F.col(c).cast("double"), stop) for c in (cols.lon, cols.lat))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
        F.struct(*values).alias("properties"),
    )
    return df.select(*keep, F.to_json(feature).alias("feature"))


def to_collections(features: DataFrame, by: str, order: str) -> DataFrame:
    """One FeatureCollection text per ``by``, for answers as small as their requests."""
    # No element is null, where array_sort, with its comparator for each pair, would differ.
    ordered = F.sort_array(F.collect_list(F.struct(order, "feature")))
    body = F.concat_ws(",", F.transform(ordered, lambda f: f["feature"]))
    document = F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}"))
    return features.groupBy(by).agg(document.alias("document"))


def write_document(features: DataFrame, path: str, *order: str) -> None:
    """All Features as one FeatureCollection in text files that are one JSON document when joined by name.

    ``features`` has the column ``feature`` and the columns of ``order``, which must tell the rows apart. The Features are
    staged in the shared folder, cut by ranges of ``order`` and written, a line each, so no task holds them all. The
    first line also opens the collection and the last one closes it; without Features that is all there is.
    """
    spark = features.sparkSession
    staged = scratch_dir(spark, "document")
    features.select(F.struct(*order).alias("place"), "feature").write.parquet(staged)
    rows = spark.read.parquet(staged)
    head, tail = '{"type":"FeatureCollection","features":[', "]}"
    ends = rows.agg(F.min("place"), F.max("place")).first()
    if ends[0] is None:
        spark.createDataFrame([(head + tail,)], "value string").coalesce(1).write.text(path)
        return
    kinds = rows.schema["place"].dataType
    first, last = (
        F.col("place") == F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(end, kinds, strict=True)])
        for end in ends
    )
    if rows.where(first | last).count() > 1 + (ends[0] != ends[1]):
        raise ContractError(f"{order} does not tell all rows apart")
    value = F.concat(F.when(first, head).otherwise(""), "feature", F.when(last, tail).otherwise(","))
    ordered = rows.repartitionByRange("place").sortWithinPartitions("place")
    ordered.select(value.alias("value")).write.text(path)


def _exportable(kind: T.DataType) -> bool:
    # The property types that are exported.
    return isinstance(
        kind,
        (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.StringType, T.BooleanType, T.BinaryType),
    )


def _property(name: str, kind: str) -> Column:
    path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return F.try_variant_get("properties", path, kind)
