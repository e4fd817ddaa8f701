"""Point-to-segment and point-to-box arithmetic as SQL expressions.

Arguments are SQL expressions too. A squared term is written with ``pow``
because a product would name, and so evaluate, its argument twice.
"""

from __future__ import annotations


def fraction_along(x: str, y: str, x0: str, y0: str, dx: str, dy: str) -> str:
    """Where the closest place lies between start (0) and end (1) of a segment."""
    length2 = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(({x} - {x0}) * {dx} + ({y} - {y0}) * {dy}) / {length2}"
    return f"case when {length2} = 0 then 0D else greatest(0D, least(1D, {t})) end"


def point_gap2(x0: str, y0: str, x1: str, y1: str) -> str:
    """Squared distance between two points."""
    return f"(pow({x1} - {x0}, 2D) + pow({y1} - {y0}, 2D))"


def box_gap2(x: str, y: str, xmin: str, xmax: str, ymin: str, ymax: str) -> str:
    """Squared distance from a point to a closed box, 0 inside."""
    gap_x = f"greatest({xmin} - {x}, {x} - {xmax}, 0D)"
    gap_y = f"greatest({ymin} - {y}, {y} - {ymax}, 0D)"
    return f"(pow({gap_x}, 2D) + pow({gap_y}, 2D))"


def interpolate_measure(
    m0: str, m1: str, x0: str, y0: str, x1: str, y1: str, x: str, y: str
) -> str:
    """Measure of a place on a segment by its share of the segment's length.

    Null where the segment has no length.
    """
    length, part = point_gap2(x0, y0, x1, y1), point_gap2(x0, y0, x, y)
    return f"try_divide({m1} - {m0}, sqrt({length})) * sqrt({part}) + {m0}"
