"""The same fixtures and results as plain SQL, by brute force."""

from __future__ import annotations

import math

ROUTE = "lpad(cast({0} as varchar), 7, '0')"

POINTS = f"""
    select o_custkey % 50 * 2.0e0 as LAT,
           (o_orderkey // 600) * 1000.0e0 + (o_orderkey % 600) * 10.0e0 as LON,
           (o_orderkey % 600) * 0.1e0 as MVAL,
           cast(o_orderkey % 600 as int) as VERTEX_SEQ,
           {ROUTE.format('(o_orderkey // 600)')} as ROUTEID
    from orders"""

EVENTS = f"""
    select event_id, event_type, {ROUTE.format('(user_id // 4)')} as ROUTEID,
           (user_id // 4) * 1000.0e0 + event_id % 6000 as LON, value as LAT
    from events"""

ITEM_EVENTS = f"""
    select l_linenumber, {ROUTE.format('(l_orderkey // 600)')} as ROUTEID,
           (l_orderkey // 600) * 1000.0e0 + l_partkey % 6000 + 0.3137e0 as LON,
           l_quantity * 2.0e0 + 0.0071e0 as LAT
    from lineitem"""

DELIVERY = f"""
    select c_nationkey * 2.0e0 as LAT,
           (c_custkey // 100 * 2) * 1000.0e0 + (c_custkey % 100) * 12.0e0 as LON,
           (c_custkey % 100) * 0.12e0 as MVAL,
           cast(c_custkey % 100 as int) as VERTEX_SEQ,
           {ROUTE.format('(c_custkey // 100 * 2)')} as ROUTEID
    from customer"""

DEGREE_EVENTS = f"""
    select event_id, {ROUTE.format('(user_id // 4)')} as LINKID,
           115.0e0 + ((user_id // 4) * 1000.0e0 + event_id % 6000) / 111319.49e0 as TO_STA_LONG,
           value / 110574.0e0 as TO_STA_LAT
    from events"""

WIDE = """
    select event_id, 95.0e0 + event_id % 4600 / 100.0e0 as LON, -11.0e0 + value / 30.0e0 as LAT
    from events"""


def segments_of(points: str) -> str:
    return f"""
    select *, (LAT1 - LAT) / nullif(LON - LON1, 0) as mvgradient,
           LAT - (LAT1 - LAT) / nullif(LON - LON1, 0) * LON as c
    from (select ROUTEID, LON, LAT, MVAL, VERTEX_SEQ,
                 lead(LON) over w as LON1, lead(LAT) over w as LAT1, lead(MVAL) over w as MVAL1
          from ({points}) p window w as (partition by ROUTEID order by VERTEX_SEQ)) s
    where LON1 is not null"""


def nearest_of(events: str, points: str, key: str) -> str:
    """Brute force: every event against every segment of its route."""
    return f"""
    select {key}, ROUTEID, dist, seq, m, x0 + t * dx as cx, y0 + t * dy as cy from (
      select *, row_number() over (partition by {key} order by dist, seq) as rn from (
        select *, m0 + t * dm as m,
               sqrt((ex - x0 - t * dx) * (ex - x0 - t * dx) + (ey - y0 - t * dy) * (ey - y0 - t * dy)) as dist
        from (
          select *, case when dx * dx + dy * dy = 0 then 0.0e0 else greatest(0.0e0, least(1.0e0,
                      ((ex - x0) * dx + (ey - y0) * dy) / (dx * dx + dy * dy))) end as t
          from (
            select {', '.join('e.' + k.strip() for k in key.split(','))}, e.ROUTEID, e.LON as ex, e.LAT as ey,
                   s.VERTEX_SEQ as seq, s.LON as x0, s.LAT as y0, s.MVAL as m0, s.LON1 - s.LON as dx,
                   s.LAT1 - s.LAT as dy, s.MVAL1 - s.MVAL as dm
            from ({events}) e join ({segments_of(points)}) s on e.ROUTEID = s.ROUTEID) a) b) c) d
    where rn = 1"""


def merged(table_of) -> str:
    """Routes of the first delivery that the second lacks, and the second."""
    return f"""
    select * from ({table_of(POINTS)}) a
    where not exists (select 1 from ({DELIVERY}) d where d.ROUTEID = a.ROUTEID)
    union all select * from ({table_of(DELIVERY)}) b"""


def wkt_of(points: str) -> str:
    return f"""
    select ROUTEID, 0 as PART, cast(count(*) as int) as n_vertices,
           'LINESTRING ZM (' || string_agg(printf('%.6f %.6f 0 %.6f', LON, LAT, MVAL), ', '
                                           order by VERTEX_SEQ) || ')' as wkt
    from ({points}) p group by ROUTEID"""


# Ellipsoid and cone of the working grid, worked out from its definition.
_f = 1 / 298.257223563
_E = math.sqrt(2 * _f - _f * _f)
_A = 6378137.0


def _t(phi: float) -> float:
    s = _E * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (_E * math.sin(phi)) ** 2)


_p1, _p2 = math.radians(2.0), math.radians(-7.0)
_N = math.log(_m(_p1) / _m(_p2)) / math.log(_t(_p1) / _t(_p2))
_F = _m(_p1) / (_N * _t(_p1) ** _N)
_R0 = _A * _F * _t(0.0) ** _N


def grid_of(lon: str, lat: str) -> tuple[str, str]:
    sine = f"sin(radians({lat}))"
    shrink = f"({_N!r} * ({_E!r} * atanh({_E!r} * {sine}) - atanh({sine})))"
    theta = f"({_N!r} * radians({lon} - 115.0e0))"
    rho = f"({_R0!r} * exp({shrink}))"
    # exp(u) - 1 = 2 exp(u/2) sinh(u/2) and 1 - cos(v) = 2 sin(v/2)^2
    grown = f"(2 * exp({shrink} / 2) * sinh({shrink} / 2))"
    return f"{rho} * sin({theta})", f"2 * {rho} * pow(sin({theta} / 2), 2) - {_R0!r} * {grown}"
