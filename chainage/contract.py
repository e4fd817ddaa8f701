"""Column contract shared by every operator.

A table of route vertices or point events is an ordinary DataFrame; which of
its columns carry the route id, the coordinates, the measure and the distance
is said by one immutable :class:`ColumnMap`.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS_SCHEMA = T.StructType(
    [
        T.StructField("LAT", T.DoubleType()),
        T.StructField("LON", T.DoubleType()),
        T.StructField("MVAL", T.DoubleType()),
        T.StructField("VERTEX_SEQ", T.IntegerType()),
        T.StructField("ROUTEID", T.StringType()),
    ]
)

# Names under which each column is looked for in an event file,
# in order of preference; the first is also the default.
ALIASES = {
    "route_id": ("ROUTEID", "LINKID", "route_id", "id"),
    "lat": ("LAT", "TO_STA_LAT", "latitude", "lat"),
    "lon": ("LON", "TO_STA_LONG", "longitude", "lon"),
    "m_value": ("MVAL", "m", "m_value"),
    "distance": ("DIST_TO_LRS", "dist_to_lrs", "distance"),
}


class ContractError(ValueError):
    """The input does not have the columns, types or settings an operator needs."""


@dataclass(frozen=True)
class ColumnMap:
    """Names of the columns that carry the linear-referencing meaning."""

    route_id: str = "ROUTEID"
    lat: str = "LAT"
    lon: str = "LON"
    m_value: str = "MVAL"
    distance: str = "DIST_TO_LRS"
    vertex_seq: str = "VERTEX_SEQ"

    @classmethod
    def detect(cls, df: DataFrame, **explicit: str | None) -> ColumnMap:
        """Find each column under its known aliases; explicit names win."""
        found = {}
        for role, names in ALIASES.items():
            if explicit.get(role):
                found[role] = explicit[role]
            else:
                found[role] = next((n for n in names if n in df.columns), names[0])
        unknown = set(explicit) - {f.name for f in fields(cls)}
        if unknown:
            raise ContractError(f"unknown column roles: {sorted(unknown)}")
        if explicit.get("vertex_seq"):
            found["vertex_seq"] = explicit["vertex_seq"]
        return cls(**found)

    @classmethod
    def guess(cls, df: DataFrame) -> ColumnMap:
        """Find the required columns of an unknown survey file by parts of their names."""
        lower = {c: c.lower() for c in df.columns}

        def having(*parts: str, also: tuple[str, ...] = ("",)) -> list[str]:
            return [
                c for c, n in lower.items() if any(p in n for p in parts) and any(a in n for a in also)
            ]

        # The name parts looked for; of several link ids the last counts.
        routes = having("linkid", "link_id")[-1:] or having("id")[:1]
        lats = having("lat", also=("sta", "from", "to"))
        lons = having("lon", "lng")
        if not (routes and lats and lons):
            raise ContractError(f"no route, latitude and longitude columns among {df.columns}")
        return cls(route_id=routes[0], lat=lats[0], lon=lons[0])

    def with_names(self, **names: str) -> ColumnMap:
        return replace(self, **names)

    @property
    def required(self) -> list[str]:
        return [self.route_id, self.lat, self.lon]

    def require(self, df: DataFrame, *extra: str) -> DataFrame:
        """Raise unless all required columns are there, each under one spelling."""
        missing = [c for c in [*self.required, *extra] if c not in df.columns]
        if missing:
            raise ContractError(f"missing required columns: {missing}")
        folded = [c.lower() for c in df.columns]
        clashes = sorted(c for c in df.columns if folded.count(c.lower()) > 1)
        if clashes:
            raise ContractError(f"columns differ only in letter case: {clashes}")
        return df

    def to_standard(self, df: DataFrame) -> DataFrame:
        """Rename the required columns to ROUTEID, LAT and LON."""
        std = ColumnMap()
        return df.withColumnsRenamed(
            {self.route_id: std.route_id, self.lat: std.lat, self.lon: std.lon}
        )

    def from_standard(self, df: DataFrame) -> DataFrame:
        """Rename standard columns, results included, to this map's names."""
        std = ColumnMap()
        return df.withColumnsRenamed(
            {
                std.route_id: self.route_id,
                std.lat: self.lat,
                std.lon: self.lon,
                std.m_value: self.m_value,
                std.distance: self.distance,
            }
        )

    def conform(self, df: DataFrame, on_error: str = "fail") -> DataFrame:
        """Required columns first with their types, then the others in order.

        Bad text in a numeric column fails the job, or becomes null with
        ``on_error="null"``. A fractional numeric route id always fails.
        """
        self.require(df)
        if on_error not in ("fail", "null"):
            raise ContractError("on_error must be 'fail' or 'null'")
        to_double = "try_cast" if on_error == "null" else "cast"
        coords = [
            getattr(F.col(_quoted(c)), to_double)("double").alias(c) for c in (self.lat, self.lon)
        ]
        rest = [F.col(_quoted(c)) for c in df.columns if c not in self.required]
        return df.select(route_key(df, self.route_id).alias(self.route_id), *coords, *rest)


def route_key(df: DataFrame, name: str) -> Column:
    """The route id as a string; whole numbers lose their decimal point."""
    value = F.col(_quoted(name))
    kind = df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = value.cast("bigint")
        return F.when(
            value.isNull() | (value == whole.cast("double")), whole.cast("string")
        ).otherwise(F.raise_error(F.lit(f"fractional route id in column {name}")).cast("string"))
    if isinstance(kind, T.DecimalType):
        whole = F.floor(value)
        return F.when(value.isNull() | (value == whole), whole.cast("string")).otherwise(
            F.raise_error(F.lit(f"fractional route id in column {name}")).cast("string")
        )
    return value.cast("string")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
