"""Plane rectangular zones and longitude / latitude: transverse Mercator by its series, as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from parcelworks.functions.bind import let

#: Ellipsoid, scale on the central meridian, and (latitude, longitude) of the origins of zones 1 to 19.
RADIUS, FLATTENING, CENTRAL_SCALE = 6378137.0, 1 / 298.257222101, 0.9999
ORIGINS = (
    (33, 129.5), (33, 131), (36, 132 + 1 / 6), (33, 133.5), (36, 134 + 1 / 3), (36, 136), (36, 137 + 1 / 6), (36, 138.5), (36, 139 + 5 / 6), (40, 140 + 5 / 6),
    (44, 140.25), (44, 142.25), (44, 144.25), (26, 142), (26, 127.5), (26, 124), (26, 131), (20, 136), (26, 154),
)

_N = FLATTENING / (2 - FLATTENING)
#: Radius of the rectifying sphere, and the series in the third flattening (Karney 2011, to the fourth order): to the plane and back.
_RECTIFYING = RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_TO = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BACK = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))


def _conformal(tan: Column) -> Column:
    """Tangent of the conformal latitude from that of the latitude, a plain column."""
    s = F.sinh(_E * F.atanh(_E * tan / F.sqrt(1 + tan * tan)))
    return tan * F.sqrt(1 + s * s) - s * F.sqrt(1 + tan * tan)


def _meridian(latitude: float) -> float:
    """Rectifying latitude of an origin."""
    tan = math.tan(math.radians(latitude))
    s = math.sinh(_E * math.atanh(_E * tan / math.sqrt(1 + tan * tan)))
    xi = math.atan(tan * math.sqrt(1 + s * s) - s * math.sqrt(1 + tan * tan))
    return xi + sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(_TO))


def _of_zone(zone: Column, values: list[float]) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), zone - 1)


def to_zone(longitude: Column, latitude: Column, zone: Column) -> Column:
    """(x, y) in metres, x to the east and y to the north, of degrees; null for a zone that is none."""
    size = CENTRAL_SCALE * _RECTIFYING

    def angles(v: Column) -> Column:
        return let({"t": _conformal(v["tan"]), "away": v["away"]}, sphere)

    def sphere(v: Column) -> Column:
        t, cos = v["t"], F.cos(v["away"])
        return let({"xi": F.atan2(t, cos), "eta": F.asinh(F.sin(v["away"]) / F.sqrt(t * t + cos * cos))}, plane)

    def plane(v: Column) -> Column:
        xi, eta = v["xi"], v["eta"]
        north = xi + sum(c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(_TO))
        east = eta + sum(c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(_TO))
        return F.struct((size * east).alias("x"), (size * north).alias("y"))

    away = F.radians(longitude - _of_zone(zone, [o[1] for o in ORIGINS]))
    point = let({"tan": F.tan(F.radians(latitude)), "away": away}, angles)
    moved = let({"p": point, "y0": size * _of_zone(zone, [_meridian(o[0]) for o in ORIGINS])}, lambda v: F.struct(v["p"]["x"].alias("x"), (v["p"]["y"] - v["y0"]).alias("y")))
    return F.when(zone.between(1, len(ORIGINS)), moved)


def from_zone(x: Column, y: Column, zone: Column) -> Column:
    """(longitude, latitude) in degrees of metres in a zone; null for a zone that is none."""
    size = CENTRAL_SCALE * _RECTIFYING

    def plane(v: Column) -> Column:
        xi, eta = v["xi"], v["eta"]
        a = xi - sum(c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(_BACK))
        b = eta - sum(c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(_BACK))
        return let({"a": a, "b": b}, sphere)

    def sphere(v: Column) -> Column:
        a, b = v["a"], v["b"]
        goal = F.sin(a) / F.sqrt(F.sinh(b) * F.sinh(b) + F.cos(a) * F.cos(a))
        return let({"goal": goal, "away": F.degrees(F.atan2(F.sinh(b), F.cos(a)))}, ellipsoid)

    def ellipsoid(v: Column) -> Column:
        goal, flat = v["goal"], 1 - _E**2

        def nearer(tan: Column, _: Column) -> Column:  # Newton on the conformal latitude
            step = lambda w: tan + (goal - w["t"]) / F.sqrt(1 + w["t"] * w["t"]) * (1 + flat * tan * tan) / (flat * F.sqrt(1 + tan * tan))
            return let({"t": _conformal(tan)}, step)

        tan = F.aggregate(F.sequence(F.lit(1), F.lit(4)), goal, nearer)
        return F.struct(v["away"].alias("longitude"), F.degrees(F.atan(tan)).alias("latitude"))

    point = let({"xi": y / size + _of_zone(zone, [_meridian(o[0]) for o in ORIGINS]), "eta": x / size}, plane)
    moved = let({"p": point, "l0": _of_zone(zone, [o[1] for o in ORIGINS])}, lambda v: F.struct((v["p"]["longitude"] + v["l0"]).alias("longitude"), v["p"]["latitude"].alias("latitude")))
    return F.when(zone.between(1, len(ORIGINS)), moved)


def zone_of(crs: Column) -> Column:
    """Zone 1 to 19 of a coordinate system's name, else null."""
    zone = F.regexp_extract(F.coalesce(crs, F.lit("")), r"([0-9]+)系", 1).try_cast("int")
    return F.when(zone.between(1, len(ORIGINS)), zone)


def change_zone(x: Column, y: Column, old: Column, new: Column) -> Column:
    """(x, y) of a point of one zone in another."""
    return let({"p": from_zone(x, y, old), "new": new}, lambda v: to_zone(v["p"]["longitude"], v["p"]["latitude"], v["new"]))


# Points of whole tables: the same series on Arrow columns. Expressions inside lambda functions take those above


def _conformal_of(tan: np.ndarray) -> np.ndarray:
    s = np.sinh(_E * np.arctanh(_E * tan / np.sqrt(1 + tan * tan)))
    return tan * np.sqrt(1 + s * s) - s * np.sqrt(1 + tan * tan)


_LONGITUDES, _MERIDIANS = np.array([float(o[1]) for o in ORIGINS]), np.array([_meridian(o[0]) for o in ORIGINS])


def _degrees(x: np.ndarray, y: np.ndarray, zone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``from_zone`` of zones that are there."""
    size = CENTRAL_SCALE * _RECTIFYING
    xi, eta = y / size + _MERIDIANS[zone - 1], x / size
    a = xi - sum(c * np.sin(2 * (j + 1) * xi) * np.cosh(2 * (j + 1) * eta) for j, c in enumerate(_BACK))
    b = eta - sum(c * np.cos(2 * (j + 1) * xi) * np.sinh(2 * (j + 1) * eta) for j, c in enumerate(_BACK))
    goal, flat = np.sin(a) / np.sqrt(np.sinh(b) ** 2 + np.cos(a) ** 2), 1 - _E**2
    tan = goal
    for _ in range(4):  # Newton on the conformal latitude
        t = _conformal_of(tan)
        tan = tan + (goal - t) / np.sqrt(1 + t * t) * (1 + flat * tan * tan) / (flat * np.sqrt(1 + tan * tan))
    return np.degrees(np.arctan2(np.sinh(b), np.cos(a))) + _LONGITUDES[zone - 1], np.degrees(np.arctan(tan))


def _metres(longitude: np.ndarray, latitude: np.ndarray, zone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``to_zone`` of zones that are there."""
    size, away = CENTRAL_SCALE * _RECTIFYING, np.radians(longitude - _LONGITUDES[zone - 1])
    t, cos = _conformal_of(np.tan(np.radians(latitude))), np.cos(away)
    xi, eta = np.arctan2(t, cos), np.arcsinh(np.sin(away) / np.sqrt(t * t + cos * cos))
    north = xi + sum(c * np.sin(2 * (j + 1) * xi) * np.cosh(2 * (j + 1) * eta) for j, c in enumerate(_TO))
    east = eta + sum(c * np.cos(2 * (j + 1) * xi) * np.sinh(2 * (j + 1) * eta) for j, c in enumerate(_TO))
    return size * east, size * north - size * _MERIDIANS[zone - 1]


def _pair(*names: str) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


def _on_rows(helper, names: tuple[str, str], x: pa.Array, y: pa.Array, *zones: pa.Array) -> pa.Array:
    """Structs of ``helper``'s two columns; null where a zone is none, with null fields where a coordinate is null."""
    place = [v.to_numpy(zero_copy_only=False).astype(float) for v in (x, y)]
    zones = [np.nan_to_num(z.to_numpy(zero_copy_only=False).astype(float)).astype(int) for z in zones]
    known = np.logical_and.reduce([(z >= 1) & (z <= len(ORIGINS)) for z in zones])
    empty = x.is_null().to_numpy(zero_copy_only=False) | y.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        found = helper(*place, *[np.where(known, z, 1) for z in zones])
    return pa.StructArray.from_arrays([pa.array(v, pa.float64(), mask=empty | ~known) for v in found], names=list(names), mask=pa.array(~known))


@F.arrow_udf(_pair("longitude", "latitude"))
def degrees_of_rows(x: pa.Array, y: pa.Array, zone: pa.Array) -> pa.Array:
    """``from_zone`` by the batch."""
    return _on_rows(_degrees, ("longitude", "latitude"), x, y, zone)


@F.arrow_udf(_pair("x", "y"))
def zone_of_rows_changed(x: pa.Array, y: pa.Array, old: pa.Array, new: pa.Array) -> pa.Array:
    """``change_zone`` by the batch."""
    return _on_rows(lambda a, b, z, w: _metres(*_degrees(a, b, z), w), ("x", "y"), x, y, old, new)


def change_box(box: Column, old: Column, new: Column, points: int = 32, rounds: int = 3) -> Column:
    """The box (min_x, ...) in another zone that holds all of a box, whose edges are bent there. The outermost points lie on the edges: of ``points`` places an edge the outermost in each direction is
    taken, then that many between its neighbours, and so on for ``rounds``; what may still lie beyond is less than a billionth of the box's size, which is added."""

    def moved(places: Column) -> Column:
        """Points of the edges in the new zone; places 0 to 4 run round the box."""

        def one(t: Column) -> Column:
            side, f = F.floor(t) % 4, t - F.floor(t)
            x = F.when(side == 0, box["min_x"] + f * (box["max_x"] - box["min_x"])).when(side == 1, box["max_x"]).when(side == 2, box["max_x"] - f * (box["max_x"] - box["min_x"])).otherwise(box["min_x"])
            y = F.when(side == 0, box["min_y"]).when(side == 1, box["min_y"] + f * (box["max_y"] - box["min_y"])).when(side == 2, box["max_y"]).otherwise(box["max_y"] - f * (box["max_y"] - box["min_y"]))
            return let({"p": change_zone(x, y, old, new)}, lambda v: F.struct(v["p"]["x"].alias("x"), v["p"]["y"].alias("y"), t.alias("t")))

        return F.transform(places, one)

    def outermost(found: Column) -> Column:
        """The points of least and greatest x and y."""
        by = lambda c, sign: F.array_min(F.transform(found, lambda p: F.struct((sign * p[c]).alias("v"), p["x"].alias("x"), p["y"].alias("y"), p["t"].alias("t"))))
        return F.array(by("x", 1), by("x", -1), by("y", 1), by("y", -1))

    best = outermost(moved(F.transform(F.sequence(F.lit(0), F.lit(4 * points - 1)), lambda i: i / F.lit(float(points)))))
    width = 1.0 / points
    for _ in range(rounds - 1):
        near = lambda b: F.transform(F.sequence(F.lit(-points), F.lit(points)), lambda i: F.pmod(b["t"] + i * F.lit(width / points), F.lit(4.0)))  # noqa: E731, B023
        best = let({"b": best}, lambda v: outermost(F.concat(moved(F.flatten(F.transform(v["b"], lambda b: near(b)))), F.transform(v["b"], lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["t"].alias("t"))))))  # noqa: B023
        width /= points

    def wide(v: Column) -> Column:
        b = v["b"]
        pad = 1e-9 * (F.get(b, F.lit(1))["x"] - F.get(b, F.lit(0))["x"] + F.get(b, F.lit(3))["y"] - F.get(b, F.lit(2))["y"])
        return F.struct((F.get(b, F.lit(0))["x"] - pad).alias("min_x"), (F.get(b, F.lit(2))["y"] - pad).alias("min_y"), (F.get(b, F.lit(1))["x"] + pad).alias("max_x"), (F.get(b, F.lit(3))["y"] + pad).alias("max_y"))

    return let({"b": best}, wide)
