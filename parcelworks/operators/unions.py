"""Area and centre of the union of shapes, where overlaps count once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.operators.spatial import _crossings, _known, _up
from parcelworks.sources.scratch import written


def union_moments(shapes: list[np.ndarray], box: tuple[float, float, float, float]) -> tuple[float, float, float]:
    """(area, integral of x, integral of y) of the part of a box that one of some shapes covers at least, each given by its edges (x1, y1, x2, y2 by row).

    The heights of vertices and crossings, also those with the box's sides, cut the box into slabs in which no two edges cross; along a slab the number of shapes that hold a place
    changes at the edges, and what counts are those where it leaves or reaches zero."""
    left, low, right, high = box
    parts = [_up(s) for s in shapes]
    own = np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])
    e = np.concatenate(parts, axis=1) if parts else np.empty((4, 0))
    near = (e[3] > low) & (e[1] < high) & (np.minimum(e[0], e[2]) < right)
    e, own = e[:, near], own[near]
    slope = (e[2] - e[0]) / (e[3] - e[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        sides = np.concatenate([e[1] + (x - e[0]) / slope for x in (left, right)])
        sides = sides[np.isfinite(sides) & (sides > np.tile(e[1], 2)) & (sides < np.tile(e[3], 2))]
    heights = np.concatenate([e[1], e[3], _crossings(e) if e.shape[1] else [], sides, [low, high]])
    heights = np.unique(heights[(heights >= low) & (heights <= high)])
    area = sum_x = sum_y = 0.0
    for y0, y1 in zip(heights[:-1], heights[1:], strict=True):
        at = np.flatnonzero((e[1] <= (y0 + y1) / 2) & (e[3] > (y0 + y1) / 2))
        if not len(at):
            continue
        below, above = (np.clip(e[0, at] + (y - e[1, at]) * slope[at], left, right) for y in (y0, y1))
        k = own[at]
        order = np.argsort(below + above, kind="stable")
        grouped = order[np.argsort(k[order], kind="stable")]  # by shape, from left to right: in, out, in, ...
        first = np.flatnonzero(np.append(True, k[grouped][1:] != k[grouped][:-1]))
        turn = np.empty(len(at), int)
        turn[grouped] = np.where((np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 2, -1, 1)
        count = np.cumsum(turn[order])
        before = count - turn[order]
        sign = np.where((before == 0) & (count > 0), -1, np.where((before > 0) & (count == 0), 1, 0))
        a, b, h = below[order], above[order], y1 - y0
        # an edge cut off by the box on the right still closes what it opened: what is open at the end reaches the side
        rest = 1 if count[-1] > 0 else 0
        a, b, sign = np.append(a, right), np.append(b, right), np.append(sign, rest)
        area += float((sign * (a + b)).sum()) / 2 * h
        sum_x += float((sign * (a * a + a * b + b * b)).sum()) / 6 * h
        sum_y += float((sign * (a * (2 * y0 + y1) + b * (y0 + 2 * y1))).sum()) / 6 * h
    return area, sum_x, sum_y


def _moments(cell: pd.DataFrame) -> pd.DataFrame:
    row = cell.iloc[0]
    shapes = [np.array(p, float).reshape(4, -1) - np.array([[row.x0], [row.y0]] * 2) for p in zip(cell["x1"], cell["y1"], cell["x2"], cell["y2"], strict=True)]  # about the key's corner
    box = (row.i * row.width, row.j * row.width, (row.i + 1) * row.width, (row.j + 1) * row.width)
    area, x, y = union_moments(shapes, box)
    return pd.DataFrame({"key": [row.key], "x0": [row.x0], "y0": [row.y0], "area": [area], "sx": [x], "sy": [y]})


def union_centres(shapes: DataFrame, cell_rows: int = 64) -> DataFrame:
    """(key, area, cx, cy): area and centroid of the union of the shapes (key: string, geom: polygons or shapes of several parts) of each key. Overlaps count once; a key without area gives no row.

    The plane of a key is cut into square cells, about one for ``cell_rows`` of its shapes; moments add up over cells, so a task holds the shapes of a cell and not those of a key. A shape stands in all cells that its box touches."""
    known = written(_known(shapes, "key", "shape", True).where("__shape_box IS NOT NULL"), "union-shapes")
    box = F.col("__shape_box")
    ends = known.groupBy("key").agg(F.min("__shape_box.min_x").alias("x0"), F.min("__shape_box.min_y").alias("y0"), F.max("__shape_box.max_x").alias("xn"), F.max("__shape_box.max_y").alias("yn"), F.count(F.lit(1)).alias("n"))
    extent = F.greatest(F.col("xn") - F.col("x0"), F.col("yn") - F.col("y0"))
    grid = ends.select("key", "x0", "y0", (extent * (1 + 1e-9) / F.ceil(F.sqrt(F.col("n") / cell_rows))).alias("width")).where("width > 0")
    spread = known.join(grid, "key")
    for name, low, high, start in (("i", "min_x", "max_x", "x0"), ("j", "min_y", "max_y", "y0")):
        cells = F.sequence(F.floor((box[low] - F.col(start)) / F.col("width")), F.floor((box[high] - F.col(start)) / F.col("width")))
        spread = spread.withColumn(name, F.explode(cells))
    sums = spread.select("key", "i", "j", "x0", "y0", "width", "__shape.*").groupBy("key", "i", "j").applyInPandas(_moments, "key string, x0 double, y0 double, area double, sx double, sy double")
    whole = sums.groupBy("key").agg(F.first("x0").alias("x0"), F.first("y0").alias("y0"), F.sum("area").alias("area"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy")).where("area > 0")
    return whole.select("key", "area", (F.col("x0") + F.col("sx") / F.col("area")).alias("cx"), (F.col("y0") + F.col("sy") / F.col("area")).alias("cy"))
