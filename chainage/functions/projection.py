"""WGS84 geographic coordinates to and from the working grid, as column expressions.

The grid is an ellipsoidal Lambert conformal conic with two standard
parallels; both directions are closed-form or unrolled, so they stay inside
generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainage.contract import ContractError

GEOGRAPHIC = "EPSG:4326"

# The working grid's definition text, compared literally, and
# the numbers it states.
LAMBERT_WKT = 'PROJCS["Indonesia Lambert Conformal Conic",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Lambert_Conformal_Conic"],PARAMETER["False_Easting",0.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",115.0],PARAMETER["Standard_Parallel_1",2.0],PARAMETER["Standard_Parallel_2",-7.0],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'  # noqa: E501
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257223563
CENTRAL_MERIDIAN = 115.0
STANDARD_PARALLELS = (2.0, -7.0)
LATITUDE_OF_ORIGIN = 0.0
CRS_PREFIXES = ("EPSG:", "PROJCS=", "GEOGCS=", "PROJCS[", "GEOGCS[")

_FLATTENING = 1 / INVERSE_FLATTENING
ECCENTRICITY = math.sqrt(_FLATTENING * (2 - _FLATTENING))


def _log_t(phi: float) -> float:
    return ECCENTRICITY * math.atanh(ECCENTRICITY * math.sin(phi)) - math.atanh(math.sin(phi))


def _log_parallel(phi: float) -> float:
    return math.log(math.cos(phi)) - math.log1p(-((ECCENTRICITY * math.sin(phi)) ** 2)) / 2


_P1, _P2 = (math.radians(p) for p in STANDARD_PARALLELS)
CONE = (_log_parallel(_P1) - _log_parallel(_P2)) / (_log_t(_P1) - _log_t(_P2))
SCALE = math.exp(_log_parallel(_P1) - CONE * _log_t(_P1)) / CONE
_LOG_ORIGIN = CONE * _log_t(math.radians(LATITUDE_OF_ORIGIN))
RHO_ORIGIN = SEMI_MAJOR * SCALE * math.exp(_LOG_ORIGIN)


def check_crs(crs: str) -> str:
    """Refuse text that is not a CRS, and CRSs other than the two supported."""
    if not crs.startswith(CRS_PREFIXES):
        raise ContractError(f"invalid CRS format: {crs}")
    if crs not in (GEOGRAPHIC, LAMBERT_WKT):
        raise ContractError(f"unsupported CRS: {crs}")
    return crs


def to_grid(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to (easting, northing) in metres.

    The cone's radius is about 1.5e8 m, so the northing is not taken as a
    difference of two radii but from the small terms they differ by.
    """
    sine = F.sin(F.radians(lat))
    log_t = F.lit(ECCENTRICITY) * F.atanh(F.lit(ECCENTRICITY) * sine) - F.atanh(sine)
    shrink = F.lit(CONE) * log_t - F.lit(_LOG_ORIGIN)
    rho = F.lit(RHO_ORIGIN) * F.exp(shrink)
    theta = F.radians(lon - F.lit(CENTRAL_MERIDIAN)) * F.lit(CONE)
    sag = 2 * rho * F.pow(F.sin(theta / 2), F.lit(2.0))
    return rho * F.sin(theta), sag - F.lit(RHO_ORIGIN) * F.expm1(shrink)


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Metres on the grid to (longitude, latitude) in degrees."""
    sign = F.lit(math.copysign(1.0, CONE))
    north = F.lit(RHO_ORIGIN) - y
    rho = sign * F.sqrt(x * x + north * north)
    t = F.pow(rho / F.lit(SEMI_MAJOR * SCALE), F.lit(1 / CONE))
    phi = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(5):
        bent = F.exp(-F.lit(ECCENTRICITY) * F.atanh(F.lit(ECCENTRICITY) * F.sin(phi)))
        phi = F.lit(math.pi / 2) - 2 * F.atan(t * bent)
    theta = F.atan2(sign * x, sign * north)
    return F.degrees(theta / F.lit(CONE)) + F.lit(CENTRAL_MERIDIAN), F.degrees(phi)
