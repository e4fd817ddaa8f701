"""Linear referencing on Spark: locate point events on measured routes."""

from chainage.contract import ColumnMap, ContractError
from chainage.functions.projection import GEOGRAPHIC, LAMBERT_WKT
from chainage.operators.index import RouteIndex, build_index
from chainage.operators.locate import (
    box_candidates,
    calculate_m_value,
    line_candidates,
    locate,
    shortest_line,
)
from chainage.operators.project import project
from chainage.operators.routes import linestrings, only_routes, segments
from chainage.plans.store import RouteStore

__all__ = [
    "GEOGRAPHIC",
    "LAMBERT_WKT",
    "ColumnMap",
    "ContractError",
    "RouteIndex",
    "RouteStore",
    "box_candidates",
    "build_index",
    "calculate_m_value",
    "line_candidates",
    "linestrings",
    "locate",
    "only_routes",
    "project",
    "segments",
    "shortest_line",
]
