"""Spatial joins of polygons and points by grid cells of several sizes.

A shape is registered in the grid whose cells are just larger than it and in all coarser ones in use, so it lies in four cells of a grid
at most, whatever its size. Two shapes meet in the coarser of their two grids, in one cell of it: an equi-join, without a pair too many
and without a cell size to choose. Geometries are polygons or shapes of several parts; what is inside follows from the even-odd rule over all rings.
Shapes of different coordinate systems must not be mixed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.functions.geom import edges_contain, edges_distance, edges_of
from parcelworks.functions.shapes import as_shape, is_box, shape_box
from parcelworks.sources.scratch import dealt, written

#: Side of the cells of level 0; a level's cells are four times as wide as those of the level below.
BASE, STEP, LOWEST, HIGHEST = 1.0, 4.0, -12, 24


def _level(box: Column) -> Column:
    """The finest level whose cells are at least as wide as the box."""
    extent = F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"])
    exact = F.ceil(F.log(F.greatest(extent, F.lit(1e-9)) / BASE) / F.log(F.lit(STEP))).cast("int")
    return F.least(F.greatest(exact, F.lit(LOWEST)), F.lit(HIGHEST))


def _width(level: Column) -> Column:
    return F.pow(F.lit(STEP), level) * BASE


def _spread(rows: DataFrame, levels: list[int], name: str) -> DataFrame:
    """A row for each cell that a box touches in its own level and the coarser ones of ``levels``."""
    box, at = F.col(f"__box_{name}"), F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))
    rows = rows.withColumn("__at", at).where(F.col("__at") >= F.col(f"__level_{name}"))
    cell = lambda v: F.floor(v / _width(F.col("__at")))
    across = lambda a: F.explode(F.sequence(cell(box[f"min_{a}"]), cell(box[f"max_{a}"])))
    return rows.withColumn("__i", across("x")).withColumn("__j", across("y"))


def box_pairs(left: DataFrame, right: DataFrame, left_box: str, right_box: str, left_extent: float | None = None) -> DataFrame:
    """Pairs of rows whose boxes meet, borders included, each pair once. Column names of both sides must differ.

    The levels in use, some thirty small numbers at most, are the only thing the driver asks for; for that both inputs are written once, but a left one whose boxes are
    all ``left_extent`` wide or less is only read. A hot cell is split by AQE."""
    left = written(left, "shapes") if left_extent is None else left
    a = left.where(F.col(left_box).isNotNull()).withColumn("__box_a", F.col(left_box))
    b = written(right, "areas").where(F.col(right_box).isNotNull()).withColumn("__box_b", F.col(right_box))
    found = b.select(_level(F.col("__box_b")).alias("x")).distinct()
    if left_extent is None:
        a = a.withColumn("__level_a", _level(F.col("__box_a")))
        levels = sorted(r.x for r in found.union(a.select(F.col("__level_a").alias("x")).distinct()).distinct().collect())
    else:  # one level up, so that a rounded difference is no wider than a cell
        own = min(HIGHEST, max(LOWEST, math.ceil(math.log(max(left_extent, 1e-9) / BASE, STEP)) + 1))
        a = a.withColumn("__level_a", F.lit(own))
        levels = sorted({max(own, r.x) for r in found.collect()})
    met = _spread(a, levels or [0], "a").join(_spread(b.withColumn("__level_b", _level(F.col("__box_b"))), levels or [0], "b"), ["__at", "__i", "__j"])
    p, q, at = F.col("__box_a"), F.col("__box_b"), F.col("__at")
    cell = lambda v: F.floor(v / _width(at))
    once = (at == F.greatest("__level_a", "__level_b")) & (F.col("__i") == cell(F.greatest(p["min_x"], q["min_x"]))) & (F.col("__j") == cell(F.greatest(p["min_y"], q["min_y"])))
    return met.where(once & _boxes_touch(p, q)).drop("__at", "__i", "__j", "__level_a", "__level_b", "__box_a", "__box_b")


def _point_box(x: Column, y: Column, reach: float = 0.0) -> Column:
    return F.struct((x - reach).alias("min_x"), (y - reach).alias("min_y"), (x + reach).alias("max_x"), (y + reach).alias("max_y"))


def _extent(areas: DataFrame) -> DataFrame:
    """One row (__extent): the box round all areas (geom); null where there is none."""
    box = areas.select(shape_box(as_shape(areas, "geom")).alias("b"))
    return box.agg(F.struct(*[f(f"b.{c}").alias(c) for c, f in (("min_x", F.min), ("min_y", F.min), ("max_x", F.max), ("max_y", F.max))]).alias("__extent"))


def _boxes_touch(p: Column, q: Column) -> Column:
    return (p["min_x"] <= q["max_x"]) & (p["max_x"] >= q["min_x"]) & (p["min_y"] <= q["max_y"]) & (p["max_y"] >= q["min_y"])


def _known(rows: DataFrame, key: str, name: str, flat: bool = False, within: DataFrame | None = None) -> DataFrame:
    """``key`` and what joins ask of a geometry, computed once a row: its box, whether it is that box, and its edges, as structs or as four flat arrays. Shapes whose
    box does not touch that of ``within`` (one row, ``_extent``) are left out before the rest is computed."""
    shaped = dealt(rows.select(key, as_shape(rows, "geom").alias("__s")), key)
    if within is not None:
        shaped = shaped.join(F.broadcast(within), _boxes_touch(shape_box(F.col("__s")), F.col("__extent"))).drop("__extent")
    edges = edges_of(F.flatten("__s"))
    shaped = shaped.select(key, shape_box(F.col("__s")).alias(f"__{name}_box"), is_box(F.col("__s")).alias(f"__{name}_is_box"), edges.alias("__e"))
    ends = {"x1": lambda e: e["p"]["x"], "y1": lambda e: e["p"]["y"], "x2": lambda e: e["q"]["x"], "y2": lambda e: e["q"]["y"]}
    arrays = F.struct(*[F.transform("__e", end).alias(n) for n, end in ends.items()])
    return shaped.select(key, f"__{name}_box", f"__{name}_is_box", (arrays if flat else F.col("__e")).alias(f"__{name}"))


# Helpers on pairs of shapes: numpy on the flat edges of one pair


def _up(edges: np.ndarray) -> np.ndarray:
    """Edges (x1, y1, x2, y2 by row) that rise; level ones are left out."""
    swap = edges[1] > edges[3]
    return np.where(swap, edges[[2, 3, 0, 1]], edges)[:, edges[1] != edges[3]]


def _crossings(e: np.ndarray, block: int = 512) -> np.ndarray:
    """Heights at which two edges cross inside both."""
    x, y, dx, dy = e[0], e[1], e[2] - e[0], e[3] - e[1]
    out = []
    for low in range(0, len(x), block):
        i = slice(low, low + block)
        turn = dx[i, None] * dy - dy[i, None] * dx
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((x - x[i, None]) * dy - (y - y[i, None]) * dx) / turn
            u = ((x - x[i, None]) * dy[i, None] - (y - y[i, None]) * dx[i, None]) / turn
        at = (t > 0) & (t < 1) & (u > 0) & (u < 1)
        out.append((y[i, None] + t * dy[i, None])[at])
    return np.concatenate(out)


def overlap_area(a: np.ndarray, b: np.ndarray, cells: int = 1 << 20) -> float:
    """Area inside both of two shapes, given by their edges (x1, y1, x2, y2 by row).

    The heights of all vertices and crossings cut the common box into slabs in which edges do not cross; between neighbouring edges of a slab lie
    trapezoids, whose area is their width at half height times the slab's. A run of slabs takes at most about ``cells`` widths at once."""
    if not a.shape[1] or not b.shape[1]:
        return 0.0
    box = lambda e, k: (min(e[k].min(), e[k + 2].min()), max(e[k].max(), e[k + 2].max()))
    (ax, ax2), (bx, bx2), (ay, ay2), (by, by2) = box(a, 0), box(b, 0), box(a, 1), box(b, 1)
    left, right, low, high = max(ax, bx), min(ax2, bx2), max(ay, by), min(ay2, by2)
    if left >= right or low >= high:
        return 0.0
    e = [_up(s - np.array([[left], [low], [left], [low]])) for s in (a, b)]  # near the origin, for small differences
    own = np.repeat([0, 1], [s.shape[1] for s in e])
    e = np.concatenate(e, axis=1)
    right, high = right - left, high - low
    near = (e[3] > 0) & (e[1] < high) & (np.minimum(e[0], e[2]) < right)
    e, own = e[:, near], own[near]
    heights = np.concatenate([e[1], e[3], _crossings(e), [0.0, high]])
    heights = np.unique(heights[(heights >= 0) & (heights <= high)])
    total, step = 0.0, max(1, cells // max(1, len(own)))
    slope = (e[2] - e[0]) / (e[3] - e[1])
    for start in range(0, len(heights) - 1, step):
        part = heights[start : start + step + 1]
        active = (e[3] > part[0]) & (e[1] < part[-1])
        mid, f, k = (part[:-1] + part[1:]) / 2, e[:, active], own[active]
        x = f[0] + (mid[:, None] - f[1]) * slope[active]
        there = (f[1] <= mid[:, None]) & (f[3] > mid[:, None])
        x = np.where(there, np.clip(x, 0, right), right)  # what lies beyond the common box has no width
        order = np.argsort(x, axis=1, kind="stable")
        x, there = np.take_along_axis(x, order, 1), np.take_along_axis(there, order, 1)
        inside = [(np.cumsum(there & (k[order] == side), axis=1) & 1).astype(bool) for side in (0, 1)]
        widths = np.diff(x, axis=1, append=right)
        total += float(((widths * (inside[0] & inside[1])).sum(1) * np.diff(part)).sum())
    return total


def _any_inside(e: np.ndarray, x: np.ndarray, y: np.ndarray, block: int = 512) -> bool:
    """Whether one of some points lies inside edges, by the even-odd rule."""
    e = _up(e)
    for low in range(0, len(x), block):
        px, py = x[low : low + block, None], y[low : low + block, None]
        over = (e[1] <= py) & (e[3] > py)
        left = px < e[0] + (py - e[1]) * (e[2] - e[0]) / (e[3] - e[1])
        if ((over & left).sum(1) & 1).any():
            return True
    return False


def shapes_meet(a: np.ndarray, b: np.ndarray, block: int = 256) -> bool:
    """Whether two shapes, given by their edges, share a point, borders included: two edges meet, or a vertex of one lies inside the other."""
    if not a.shape[1] or not b.shape[1]:
        return False
    box = lambda e: (np.minimum(e[0], e[2]), np.minimum(e[1], e[3]), np.maximum(e[0], e[2]), np.maximum(e[1], e[3]))

    def near(e: np.ndarray, other: np.ndarray) -> np.ndarray:
        x, y, x2, y2 = box(e)
        ox, oy, ox2, oy2 = box(other)
        return e[:, (x <= ox2.max()) & (x2 >= ox.min()) & (y <= oy2.max()) & (y2 >= oy.min())]

    p, q = near(a, b), near(b, a)
    if not p.shape[1] and not q.shape[1]:
        return False
    qx, qy, qx2, qy2 = box(q)
    turn = lambda ox, oy, ux, uy, vx, vy: (ux - ox) * (vy - oy) - (uy - oy) * (vx - ox)
    for low in range(0, p.shape[1] if q.shape[1] else 0, block):  # edges of one against those of the other, in blocks
        x1, y1, x2, y2 = (c[low : low + block, None] for c in p)
        d1, d2 = turn(q[0], q[1], q[2], q[3], x1, y1), turn(q[0], q[1], q[2], q[3], x2, y2)
        d3, d4 = turn(x1, y1, x2, y2, q[0], q[1]), turn(x1, y1, x2, y2, q[2], q[3])
        boxes = (np.minimum(x1, x2) <= qx2) & (np.maximum(x1, x2) >= qx) & (np.minimum(y1, y2) <= qy2) & (np.maximum(y1, y2) >= qy)
        if (boxes & (np.sign(d1) * np.sign(d2) <= 0) & (np.sign(d3) * np.sign(d4) <= 0)).any():
            return True
    return _any_inside(b, p[0], p[1]) or _any_inside(a, q[0], q[1])


def _on_pairs(helper, kind: str, left: str, right: str) -> Column:
    """``helper`` on the flat edges of two columns; null where either has none."""

    def run(ax: pd.Series, ay: pd.Series, ax2: pd.Series, ay2: pd.Series, bx: pd.Series, by: pd.Series, bx2: pd.Series, by2: pd.Series) -> pd.Series:
        out = [None if p[0] is None or p[4] is None else helper(np.array(p[:4], float).reshape(4, -1), np.array(p[4:], float).reshape(4, -1)) for p in zip(ax, ay, ax2, ay2, bx, by, bx2, by2, strict=True)]
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, kind)(*[F.col(f"{side}.{c}") for side in (left, right) for c in ("x1", "y1", "x2", "y2")])


def _edge_pairs(shapes: DataFrame, areas: DataFrame) -> DataFrame:
    """(key, admin_id, __shape, __area, boxes and __boxes) of pairs whose boxes meet. ``__boxes``: both are rectangles along the axes, which need no edges; the other pairs are dealt
    over all tasks by their ids, since one pair may take long."""
    met = box_pairs(_known(shapes, "key", "shape", True, _extent(areas)), _known(areas, "admin_id", "area", True), "__shape_box", "__area_box")
    both = F.col("__shape_is_box") & F.col("__area_is_box")
    hidden = {c: F.when(~F.col("__boxes"), F.col(c)) for c in ("__shape", "__area")}
    met = met.withColumn("__boxes", both).withColumns(hidden).drop("__shape_is_box", "__area_is_box")
    return dealt(met, "key", "admin_id")


# Joins


def _holding(points: DataFrame, areas: DataFrame, reach: float = 0.0) -> DataFrame:
    """(key, x, y, admin_id, __area, __holds) of points and areas whose box meets the square of ``reach`` round them."""
    p = points.select("key", "x", "y", _point_box(F.col("x"), F.col("y"), reach).alias("__point"))
    met = box_pairs(p, _known(areas, "admin_id", "area"), "__point", "__area_box", left_extent=2 * reach)
    x, y, box = F.col("x"), F.col("y"), F.col("__area_box")
    in_box = x.between(box["min_x"], box["max_x"]) & y.between(box["min_y"], box["max_y"])
    return met.withColumn("__holds", in_box & F.when(F.col("__area_is_box"), True).otherwise(edges_contain(F.col("__area"), x, y)))


def containing_area(points: DataFrame, areas: DataFrame) -> DataFrame:
    """(key, admin_id): the area (admin_id, geom) of the smallest id that contains each point (key, x, y), borders included and holes not."""
    return _holding(points, areas).where("__holds").groupBy("key").agg(F.min("admin_id").alias("admin_id"))


def update_oaza(parcels: DataFrame, found: DataFrame) -> DataFrame:
    """``parcels`` (key, oaza_name, ...) with the district of ``found`` (key, name) where there is one, and ``updated``: 1 where it differs
    from what was there."""
    joined = parcels.join(found.select("key", F.col("name").alias("__name")), "key", "left")
    differs = F.col("__name").isNotNull() & ~F.equal_null("__name", F.col("oaza_name"))
    return joined.withColumn("updated", differs.cast("int")).withColumn("oaza_name", F.coalesce("__name", "oaza_name")).drop("__name")


def largest_overlap(shapes: DataFrame, areas: DataFrame) -> DataFrame:
    """(key, admin_id, overlap): the area (admin_id, geom) that shares most with each shape (key, geom); the smallest id on ties; shapes that only touch do not count.
    Pairs without overlap go after the aggregation: a filter on a Python column would run it twice."""
    met = _edge_pairs(shapes, areas)
    p, q = F.col("__shape_box"), F.col("__area_box")
    side = lambda a: F.least(p[f"max_{a}"], q[f"max_{a}"]) - F.greatest(p[f"min_{a}"], q[f"min_{a}"])
    met = met.select("key", "admin_id", F.coalesce(F.when(F.col("__boxes"), side("x") * side("y")), _on_pairs(overlap_area, "double", "__shape", "__area")).alias("overlap"))
    best = met.groupBy("key").agg(F.min(F.struct((-F.round("overlap", 6)).alias("o"), "admin_id", "overlap")).alias("m"))
    return best.where("m.overlap > 0").select("key", "m.admin_id", "m.overlap")


def meeting_pairs(shapes: DataFrame, areas: DataFrame) -> DataFrame:
    """(key, admin_id) of shapes (key, geom) and areas (admin_id, geom) that share a point, borders included."""
    meets = F.coalesce(_on_pairs(shapes_meet, "boolean", "__shape", "__area"), F.lit(False))
    return _edge_pairs(shapes, areas).where(F.col("__boxes") | meets).select("key", "admin_id")


def meeting(shapes: DataFrame, areas: DataFrame) -> DataFrame:
    """Keys of the shapes that meet one of the areas; all keys if there is no area. A union of the
    areas is not needed: who meets it meets one of them."""
    if areas.isEmpty():
        return shapes.select("key").distinct()
    return meeting_pairs(shapes, areas).select("key").distinct()


def locate(points: DataFrame, areas: DataFrame, tolerance: float) -> DataFrame:
    """(key, admin_id): the area that holds each point (key, x, y), else the nearest of those whose box meets the square of
    ``tolerance`` round it; the smallest id on ties, no row where there is none."""
    met = _holding(points, areas, tolerance)
    far = F.when(F.col("__holds"), 0.0).otherwise(edges_distance(F.col("__area"), F.col("x"), F.col("y")))
    return met.groupBy("key").agg(F.min(F.struct((~F.col("__holds")).alias("out"), far.alias("d"), "admin_id")).alias("m")).select("key", "m.admin_id")


def areas_by_name(areas: DataFrame) -> DataFrame:
    """(name, admin_id, geom): the first area of each name."""
    return areas.groupBy("name").agg(F.min(F.struct("admin_id", "geom")).alias("m")).select("name", "m.admin_id", "m.geom")
