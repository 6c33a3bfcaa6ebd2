"""Coordinates of the national grid as longitude and latitude, in column expressions of a fixed number of steps."""

from __future__ import annotations

from collections.abc import Callable
from math import asin, atan, cos, pi, radians, sin, sqrt, tan

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Ellipsoids: half axis and flattening of the older one and of WGS 84; first eccentricity of the older one.
OLD, WORLD = (6377397.155, 1 / 299.1528128), (6378137.0, 1 / 298.257223563)
ECCENTRICITY = 0.081696831215303
#: Fixed values. Oblique cone: middle latitude, base meridian, tilt of its axis, base parallel, scale on it.
MIDDLE, MERIDIAN, TILT, PARALLEL, SCALE = radians(49.5), radians(24 + 50 / 60), radians(30 + 17 / 60 + 17.30311 / 3600), radians(78.5), 0.9999
#: Fixed values. Seven parameters, coordinate frame: metres, seconds of arc, parts of a million.
SHIFT, TURN, STRETCH = (570.8, 85.7, 462.8), (-4.998, -1.587, -5.261), 3.56
#: Steps of either fixed point; each gains more than two decimal places.
STEPS = 8
#: Place for the self-check: grid east and north, longitude and latitude; metres allowed.
KNOWN, ALLOWED = ((-866718.0, -1038323.0), (12.7017, 49.9648)), 50

_E2 = ECCENTRICITY**2
_B = sqrt(1 + _E2 * cos(MIDDLE) ** 4 / (1 - _E2))
_SPHERE = OLD[0] * sqrt(1 - _E2) / (1 - _E2 * sin(MIDDLE) ** 2)
_U = asin(sin(MIDDLE) / _B)
_K = tan(pi / 4 + _U / 2) * ((1 + ECCENTRICITY * sin(MIDDLE)) / (1 - ECCENTRICITY * sin(MIDDLE))) ** (ECCENTRICITY * _B / 2) / tan(pi / 4 + MIDDLE / 2) ** _B
_N = sin(PARALLEL)
_RHO = SCALE * _SPHERE / tan(PARALLEL)
_TURNS = tuple(radians(s / 3600) for s in TURN)
_M = 1 + STRETCH * 1e-6


def settled(start: Column, step: Callable[[Column], Column], steps: int = STEPS) -> Column:
    """A fixed number of steps of an iteration, as one loop over an array, so that the expression does not grow."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda x, _: step(x))


def _off_the_cone(east: Column, north: Column) -> tuple[Column, Column]:
    """Latitude and longitude (radians) on the older ellipsoid."""
    x, y = -north, -east
    rho, angle = F.hypot(x, y), F.atan2(y, x) / _N
    tilted = 2 * (F.atan(F.pow(F.lit(_RHO) / rho, F.lit(1 / _N)) * tan(pi / 4 + PARALLEL / 2)) - pi / 4)
    u = F.asin(cos(TILT) * F.sin(tilted) - sin(TILT) * F.cos(tilted) * F.cos(angle))
    v = F.asin(F.cos(tilted) * F.sin(angle) / F.cos(u))
    sphere = _K ** (-1 / _B) * F.pow(F.tan(u / 2 + pi / 4), F.lit(1 / _B))

    def step(lat: Column) -> Column:
        s = ECCENTRICITY * F.sin(lat)
        return 2 * (F.atan(sphere * F.pow((1 + s) / (1 - s), F.lit(ECCENTRICITY / 2))) - pi / 4)

    return settled(u, step), MERIDIAN - v / _B


def _in_space(lat: Column, lon: Column, half_axis: float, flat: float) -> tuple[Column, Column, Column]:
    e2 = flat * (2 - flat)
    n = half_axis / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return n * F.cos(lat) * F.cos(lon), n * F.cos(lat) * F.sin(lon), n * (1 - e2) * F.sin(lat)


def _on_ellipsoid(x: Column, y: Column, z: Column, half_axis: float, flat: float) -> tuple[Column, Column]:
    e2, p = flat * (2 - flat), F.hypot(x, y)

    def step(lat: Column) -> Column:
        n = half_axis / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
        return F.atan2(z, p * (1 - e2 * n / (p / F.cos(lat))))

    return settled(F.atan2(z, p * (1 - e2)), step), F.atan2(y, x)


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def world(east: Column, north: Column) -> Column:
    """A struct of lon and lat in degrees, seven decimal places (about a centimetre); null for the cone's tip and for nulls."""
    a, b, c = _TURNS

    def moved(p: Column) -> Column:
        x, y, z = p["x"], p["y"], p["z"]
        axes = SHIFT[0] + _M * (x + c * y - b * z), SHIFT[1] + _M * (y + a * z - c * x), SHIFT[2] + _M * (z + b * x - a * y)
        return F.struct(*[v.alias(k) for k, v in zip("xyz", axes, strict=True)])

    def degrees(p: Column) -> Column:
        lat, lon = _on_ellipsoid(p["x"], p["y"], p["z"], *WORLD)
        return F.struct(F.round(F.degrees(lon), 7).alias("lon"), F.round(F.degrees(lat), 7).alias("lat"))

    old = F.struct(*[v.alias(k) for k, v in zip(("lat", "lon"), _off_the_cone(east.cast("double"), north.cast("double")), strict=True)])
    space = _with(old, lambda p: F.struct(*[v.alias(k) for k, v in zip("xyz", _in_space(p["lat"], p["lon"], *OLD), strict=True)]))
    return F.when(east.isNotNull() & north.isNotNull() & ((east != 0) | (north != 0)), _with(_with(space, moved), degrees))


def metres(a: Column, b: tuple[float, float]) -> Column:
    """Distance of a struct of lon and lat from a place near by."""
    return F.hypot((a["lat"] - b[1]) * 111_320, (a["lon"] - b[0]) * 111_320 * cos(radians(b[1])))


def world_sql(table: str) -> str:
    """Tables of a WITH clause, the last one named world: all columns of ``table`` (with east and north, not null), lon and lat, by the same steps, one after another."""
    steps: list[str] = []

    def then(select: str) -> None:
        steps.append(f"w{len(steps)} AS MATERIALIZED (SELECT {select} FROM {f'w{len(steps) - 1}' if steps else table})")

    e2 = WORLD[1] * (2 - WORLD[1])
    o2 = OLD[1] * (2 - OLD[1])
    then(f"*, sqrt(east * east + north * north) AS rho, atan2(-east, -north) / {_N!r} AS angle")
    then(f"*, 2 * (atan(pow({_RHO!r} / rho, {1 / _N!r}) * {tan(pi / 4 + PARALLEL / 2)!r}) - pi() / 4) AS tilted")
    then(f"*, asin({cos(TILT)!r} * sin(tilted) - {sin(TILT)!r} * cos(tilted) * cos(angle)) AS u")
    then(f"*, u AS f, {MERIDIAN!r} - asin(cos(tilted) * sin(angle) / cos(u)) / {_B!r} AS old_lon, {_K ** (-1 / _B)!r} * pow(tan(u / 2 + pi() / 4), {1 / _B!r}) AS sphere")
    for _ in range(STEPS):
        s = f"{ECCENTRICITY!r} * sin(f)"
        then(f"* REPLACE (2 * (atan(sphere * pow((1 + {s}) / (1 - {s}), {ECCENTRICITY / 2!r})) - pi() / 4) AS f)")
    then(f"*, {OLD[0]!r} / sqrt(1 - {o2!r} * sin(f) * sin(f)) AS n")
    then(f"*, n * cos(f) * cos(old_lon) AS x, n * cos(f) * sin(old_lon) AS y, n * {1 - o2!r} * sin(f) AS z")
    a, b, c = (f"({t!r})" for t in _TURNS)
    then(f"* REPLACE ({SHIFT[0]} + {_M!r} * (x + {c} * y - {b} * z) AS x, {SHIFT[1]} + {_M!r} * (y + {a} * z - {c} * x) AS y, {SHIFT[2]} + {_M!r} * (z + {b} * x - {a} * y) AS z)")
    then(f"*, sqrt(x * x + y * y) AS p, atan2(z, sqrt(x * x + y * y) * {1 - e2!r}) AS g")
    for _ in range(STEPS):
        n = f"{WORLD[0]!r} / sqrt(1 - {e2!r} * sin(g) * sin(g))"
        then(f"* REPLACE (atan2(z, p * (1 - {e2!r} * ({n}) / (p / cos(g)))) AS g)")
    steps.append(f"world AS (SELECT *, round(degrees(atan2(y, x)), 7) AS lon, round(degrees(g), 7) AS lat FROM w{len(steps) - 1})")
    return ", ".join(steps)
