"""Versioned store of the three route tables on a plain file system.

    <root>/points|segments|linestrings|boxes/commit=<id>/bucket=<n>/*.parquet
    <root>/catalog/version=<n>/*.parquet
    <root>/staged/<id>/*.parquet

Routes are hashed into buckets. A publish rewrites only the buckets its batch
touches (``boxes``, the leaves of the box index, go with the segments); the
catalog row says, bucket by bucket, which commit holds the
version's rows; the number of buckets is that list's length, and a store keeps
the number it was made with. Paths in the catalog are relative to the root.
Data is written first and the catalog row last, into a folder of its version
that must not exist, so a failed publish leaves only folders no version refers
to, and of two writers of one version the second fails.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainage.contract import ContractError
from chainage.operators.index import SAMPLES, RouteIndex, build_index, depth_for, leaf_boxes
from chainage.operators.routes import linestrings, only_routes, segments
from chainage.plans import catalog
from chainage.plans.merge import merge_routes
from chainage.sources.tables import route_columns

CATALOG_SCHEMA = (
    "VERSION int, START_DATE date, LRS_POINT_FILE string, LRS_SEGMENT_FILE string, "
    "LRS_LINESTR_FILE string, AUTHOR string, COMMIT_MSG string, "
    "BUCKET_COMMITS array<string>, INDEX_DEPTH int"
)
PUBLIC_COLUMNS = [
    "VERSION",
    "START_DATE",
    "END_DATE",
    "LRS_POINT_FILE",
    "LRS_SEGMENT_FILE",
    "LRS_LINESTR_FILE",
    "AUTHOR",
    "COMMIT_MSG",
]
#: A store has one catalog, however its root is spelt; there is one row for each version.
ONE_CATALOG: list[str] = []
TABLES = ("points", "segments", "linestrings", "boxes")
SCHEMAS = {
    "points": "LAT double, LON double, MVAL double, VERTEX_SEQ int, ROUTEID string",
    "segments": "ROUTEID string, LON double, LAT double, MVAL double, VERTEX_SEQ int, "
    "LON1 double, LAT1 double, MVAL1 double, mvgradient double, c double",
    "linestrings": "ROUTEID string, PART int, n_vertices int, "
    "vertices array<struct<VERTEX_SEQ: int, LON: double, LAT: double, M: double>>",
    "boxes": "ROUTEID string, block int, node int, xmin double, xmax double, ymin double, ymax double, "
    + ", ".join(f"{name}{c} double" for name in SAMPLES for c in "xy"),
}
ORDER = {"linestrings": "PART", "boxes": "node"}


@dataclass(frozen=True)
class RouteTables:
    """The tables of one version, read lazily."""

    version: int
    points: DataFrame
    segments: DataFrame
    linestrings: DataFrame
    boxes: DataFrame
    depth: int

    def index(self) -> RouteIndex:
        leaves = self.boxes.withColumnRenamed("ROUTEID", "route")
        return build_index(self.segments, depth=self.depth, boxes=leaves)


class RouteStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        """``buckets`` counts for a new store (64 if not given); for others it must be theirs."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.asked, self.buckets = buckets, buckets or 64

    def _adopt(self, row) -> None:
        """Takes the number of buckets from a catalog row."""
        stored = len(row["BUCKET_COMMITS"])
        if self.asked not in (None, stored):
            raise ContractError(f"the store has {stored} buckets, not {self.asked}")
        self.buckets = stored

    # -- catalog ---------------------------------------------------------

    def catalog(self) -> DataFrame:
        """All versions with their end dates."""
        return catalog.with_end_dates(self._rows(), ONE_CATALOG).select(*PUBLIC_COLUMNS)

    def latest(self, routes=None) -> RouteTables:
        """The open version; ``routes`` limits it to one, a list or a table of ids, and to their buckets."""
        dated = catalog.with_end_dates(self._rows(), ONE_CATALOG)
        return self._open(catalog.latest(dated, ONE_CATALOG), routes)

    def as_of(self, day: date | str, routes=None) -> RouteTables:
        """The version that was in force on a day."""
        dated = catalog.with_end_dates(self._rows(), ONE_CATALOG)
        return self._open(catalog.as_of(dated, day, ONE_CATALOG), routes)

    def version(self, number: int, routes=None) -> RouteTables:
        return self._open(self._rows().where(F.col("VERSION") == number), routes)

    # -- publish ---------------------------------------------------------

    def publish(
        self,
        batch: DataFrame,
        as_of_date: date | None = None,
        author: str = "",
        message: str = "",
        dense: bool = False,
    ) -> int:
        """Merge a batch of route vertices and make the result the next version.

        ``as_of_date`` is the day the version starts, today if not given.

        The batch is written to the store once and read back, so it may come
        from any plan. A route delivered twice is refused.
        """
        rows = self._rows()
        before = rows.orderBy(F.desc("VERSION")).limit(1).first()
        number = 1 if before is None else before["VERSION"] + 1
        start = as_of_date or date.today()
        if before is not None:
            self._adopt(before)
            if start < before["START_DATE"]:
                raise ContractError(f"version {number} would start before version {number - 1}")
        commit = f"{number:06d}-{uuid.uuid4().hex[:12]}"
        staged_path = f"{self.root}/staged/{commit}"
        route_columns(batch).withColumn("bucket", self._bucket()).write.parquet(staged_path)
        staged = self.spark.read.parquet(staged_path)
        touched, depth = self._check(staged)
        new = {
            "points": staged,
            "segments": segments(staged, dense=dense),
            "linestrings": linestrings(staged).withColumn("bucket", self._bucket()),
        }

        def write(table: str) -> None:
            old = None
            if before is not None:
                live = [(c, b) for b, c in enumerate(before["BUCKET_COMMITS"]) if c and b in touched]
                old = self._scan(table, live) if live else None
            put(table, merge_routes(old, new[table], replaced=staged))

        def put(table: str, merged: DataFrame) -> None:
            # Every file holds a run of routes, or a run of one route's vertices, so that a
            # filter on the route skips the bucket's other files by their statistics.
            order = ("bucket", "ROUTEID", ORDER.get(table, "VERTEX_SEQ"))
            (
                merged.repartitionByRange(*order)
                .sortWithinPartitions(*order)
                .write.partitionBy("bucket")
                .parquet(f"{self.root}/{table}/commit={commit}")
            )

        with ThreadPoolExecutor(len(new)) as pool:
            list(pool.map(write, new))
        # The leaves are made of the segments as stored, which are in order already: pairing the vertices
        # once more and joining the old leaves would cost more than reading these.
        leaves = leaf_boxes(self._scan("segments", [(commit, b) for b in touched]))
        put("boxes", leaves.withColumnRenamed("route", "ROUTEID").withColumn("bucket", self._bucket()))
        commits = list(before["BUCKET_COMMITS"]) if before is not None else [None] * self.buckets
        for b in touched:
            commits[b] = commit
        depth = max(depth, before["INDEX_DEPTH"] if before is not None else 1)
        folders = [(c, b) for b, c in enumerate(commits) if c]
        paths = [",".join(f"{t}/commit={c}/bucket={b}" for c, b in folders) for t in TABLES[:3]]
        row = (number, start, *paths, author, message, commits, depth)
        entry = self.spark.createDataFrame([row], CATALOG_SCHEMA)
        try:
            entry.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/catalog/version={number}")
        except AnalysisException as err:
            if err.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            raise ContractError(f"another publish has made version {number}") from err
        return number

    def _check(self, staged: DataFrame) -> tuple[list[int], int]:
        """Refuse a bad batch; its buckets and the index depth it needs (one job)."""
        per_vertex = staged.groupBy("ROUTEID", "VERTEX_SEQ", "bucket").agg(
            F.count(F.lit(1)).alias("copies")
        )
        seen = per_vertex.agg(
            F.min(F.when(F.col("copies") > 1, F.col("ROUTEID"))).alias("doubled"),
            F.count_if(F.col("ROUTEID").isNull() | F.col("VERTEX_SEQ").isNull()).alias("unnamed"),
            F.min("VERTEX_SEQ").alias("lo"),
            F.max("VERTEX_SEQ").alias("hi"),
            F.collect_set("bucket").alias("buckets"),
        ).first()
        if seen["doubled"] is not None:
            raise ContractError(f"route delivered twice, for instance {seen['doubled']}")
        if seen["unnamed"]:
            raise ContractError(f"{seen['unnamed']} vertices lack a route id or number")
        if seen["lo"] is None:
            raise ContractError("the batch has no vertices")
        return sorted(seen["buckets"]), depth_for(seen["lo"], seen["hi"])

    # -- reading ---------------------------------------------------------

    def listed(self, table: str, paths: str) -> DataFrame:
        """The rows that a catalog column of paths leads to, such as ``points`` by LRS_POINT_FILE."""
        pairs = [p.split("commit=", 1)[1].split("/bucket=") for p in paths.split(",")]
        return self._scan(table, [(c, int(b)) for c, b in pairs]).drop("bucket")

    def _rows(self) -> DataFrame:
        """Catalog rows; only a catalog that does not exist yet counts as empty."""
        try:
            reader = self.spark.read.schema(CATALOG_SCHEMA).option("recursiveFileLookup", "true")
            return reader.parquet(f"{self.root}/catalog")
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], CATALOG_SCHEMA)

    def _open(self, entry: DataFrame, routes) -> RouteTables:
        row = entry.first()
        if row is None:
            raise ContractError("no active catalog entry found")
        self._adopt(row)
        live = [(c, b) for b, c in enumerate(row["BUCKET_COMMITS"]) if c]
        if routes is not None:
            wanted = self._buckets_of(routes)
            live = [(c, b) for c, b in live if b in wanted] or live[:1]
        opened = []
        for table in TABLES:
            df = self._scan(table, live).drop("bucket")
            opened.append(df if routes is None else only_routes(df, routes))
        return RouteTables(row["VERSION"], *opened, depth=row["INDEX_DEPTH"])

    def _scan(self, table: str, live: list[tuple[str, int]]) -> DataFrame:
        """The table's rows in the given (commit, bucket) folders, by partition pruning."""
        by_commit: dict[str, list[int]] = {}
        for commit, bucket in live:
            by_commit.setdefault(commit, []).append(bucket)
        wanted = [
            (F.col("commit") == c) & F.col("bucket").isin(b) for c, b in sorted(by_commit.items())
        ]
        schema = f"{SCHEMAS[table]}, commit string, bucket int"
        # Only the commits that this version refers to are listed.
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}")
        df = reader.parquet(*[f"{self.root}/{table}/commit={c}" for c in sorted(by_commit)])
        return df.where(reduce(Column.__or__, wanted)).drop("commit")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("ROUTEID"), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, routes) -> set[int]:
        """The buckets of one, a list or a table of ids: at most as many numbers as there are buckets (one job)."""
        if not isinstance(routes, DataFrame):
            ids = [routes] if isinstance(routes, str) else list(routes)
            routes = self.spark.createDataFrame([(i,) for i in ids], "ROUTEID string")
        return {r[0] for r in routes.select(self._bucket().alias("bucket")).distinct().collect()}
