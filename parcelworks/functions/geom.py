"""Polygon functions. A polygon is an array of rings, a ring an array of struct<x, y>; ring 0 is the outer one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelworks.functions.bind import let

POLYGON = "array<array<struct<x:double,y:double>>>"


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0)))


def ring_sums(ring: Column) -> Column:
    """(a, mx, my) of a ring: twice its signed area and first moments times 6, about its first vertex; the ring
    is closed if it is not yet. The ring itself is computed once, not for every vertex."""
    return let({"ring": ring}, lambda v: _bound_ring_sums(v["ring"]))


def _bound_ring_sums(ring: Column) -> Column:
    first = F.get(ring, F.lit(0))
    last = F.size(ring) - 1
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc: Column, i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        px, py, qx, qy = p["x"] - first["x"], p["y"] - first["y"], q["x"] - first["x"], q["y"] - first["y"]
        cross = px * qy - qx * py
        return F.struct((acc["a"] + cross).alias("a"), (acc["mx"] + (px + qx) * cross).alias("mx"), (acc["my"] + (py + qy) * cross).alias("my"))

    return F.when(F.size(ring) >= 3, F.aggregate(F.sequence(F.lit(0), last), start, step)).otherwise(start)


def polygon_area(polygon: Column) -> Column:
    """Outer shoelace area less the holes', 0 at least; 0 for null or fewer than three points."""
    sizes = F.transform(polygon, lambda r: F.abs(ring_sums(r)["a"]) / 2)
    holes = F.aggregate(F.slice(sizes, 2, F.greatest(F.size(sizes) - 1, F.lit(0))), F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(polygon) > 0, F.greatest(F.lit(0.0), F.get(sizes, F.lit(0)) - holes)).otherwise(0.0)


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centroid; null for a ring without area."""
    place = lambda v: F.when(v["s"]["a"] != 0, F.struct((v["p"]["x"] + v["s"]["mx"] / (3 * v["s"]["a"])).alias("x"), (v["p"]["y"] + v["s"]["my"] / (3 * v["s"]["a"])).alias("y")))
    return let({"s": ring_sums(ring), "p": F.get(ring, F.lit(0))}, place)


def affine(polygon: Column, scale: Column, dx: Column, dy: Column) -> Column:
    """Every coordinate times ``scale`` plus (dx, dy)."""
    return F.transform(polygon, lambda r: F.transform(r, lambda p: F.struct((p["x"] * scale + dx).alias("x"), (p["y"] * scale + dy).alias("y"))))


def to_wkt(polygon: Column) -> Column:
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit(")"))
    return F.concat(F.lit("POLYGON("), F.array_join(F.transform(polygon, ring), ", "), F.lit(")"))


def from_wkt(text: Column) -> Column:
    """The polygon of a text; null where it is anything else, or of several parts (``shapes.parse_wkt`` takes those)."""
    from parcelworks.functions.shapes import parse_wkt

    return let({"s": parse_wkt(text)["geom"]}, lambda v: F.when(F.size(v["s"]) == 1, F.get(v["s"], F.lit(0))))


def polygon_centroid(polygon: Column) -> Column:
    """Area-weighted centroid with holes taken out; null for a polygon that is null, empty or without area. All rings' moments are taken
    about the first vertex of ring 0 and count by the size of their area, whatever way they turn."""
    def add(acc: Column, r: Column) -> Column:
        # moments about the polygon's origin: those about the ring's own first vertex, and its area times the way between them
        sign = F.signum(r["s"]["a"]) * r["sign"]
        mx = r["s"]["mx"] + 3 * r["s"]["a"] * (r["p"]["x"] - r["o"]["x"])
        my = r["s"]["my"] + 3 * r["s"]["a"] * (r["p"]["y"] - r["o"]["y"])
        return F.struct((acc["a"] + sign * r["s"]["a"]).alias("a"), (acc["mx"] + sign * mx).alias("mx"), (acc["my"] + sign * my).alias("my"))

    def placed(v: Column) -> Column:
        t, o = v["t"], v["o"]
        return F.when(t["a"] != 0, F.struct((o["x"] + t["mx"] / (3 * t["a"])).alias("x"), (o["y"] + t["my"] / (3 * t["a"])).alias("y")))

    origin = F.get(F.get(polygon, F.lit(0)), F.lit(0))
    sums = F.transform(polygon, lambda r, i: F.struct(ring_sums(r).alias("s"), F.get(r, F.lit(0)).alias("p"), origin.alias("o"), F.when(i == 0, 1.0).otherwise(-1.0).alias("sign")))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.when(F.coalesce(F.size(polygon), F.lit(0)) > 0, let({"t": F.aggregate(F.filter(sums, lambda r: r["p"].isNotNull()), start, add), "o": origin}, placed))


def polygon_box(polygon: Column) -> Column:
    """(min_x, min_y, max_x, max_y) of ring 0; null for a polygon that is null or has no point."""
    ring = F.get(polygon, F.lit(0))
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    box = F.struct(F.array_min(x).alias("min_x"), F.array_min(y).alias("min_y"), F.array_max(x).alias("max_x"), F.array_max(y).alias("max_y"))
    return F.when(F.size(ring) > 0, box)


def _edges(ring: Column) -> Column:
    """(p, q) of every edge of a ring, closed."""
    return F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i).alias("p"), F.get(ring, (i + 1) % F.size(ring)).alias("q")))


def edges_of(polygon: Column) -> Column:
    """(p, q) of all edges of all rings. Rings of a shape of several parts, flattened, are taken as well."""
    return F.flatten(F.transform(F.filter(polygon, lambda r: F.size(r) > 0), _edges))


def edges_contain(edges: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside edges by the even-odd rule, so that holes are outside; on an edge counts as inside."""

    def crossed(e: Column) -> Column:
        p, q = e["p"], e["q"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)))

    def on(e: Column) -> Column:
        p, q = e["p"], e["q"]
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        within = (x >= F.least(p["x"], q["x"])) & (x <= F.greatest(p["x"], q["x"])) & (y >= F.least(p["y"], q["y"])) & (y <= F.greatest(p["y"], q["y"]))
        return (cross == 0) & within

    return F.coalesce((F.size(F.filter(edges, crossed)) % 2 == 1) | F.exists(edges, on), F.lit(False))


def edges_distance(edges: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the nearest of edges."""

    def far(e: Column) -> Column:
        p, q = e["p"], e["q"]
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        size = dx * dx + dy * dy
        t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - p["x"]) * dx + (y - p["y"]) * dy) / size))).otherwise(0.0)
        ox, oy = p["x"] + t * dx - x, p["y"] + t * dy - y
        return F.sqrt(ox * ox + oy * oy)

    return F.array_min(F.transform(edges, far))


def polygon_contains(polygon: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon, on its border included."""
    return edges_contain(edges_of(polygon), x, y)


def point_distance(polygon: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the nearest edge of a polygon."""
    return edges_distance(edges_of(polygon), x, y)


def stitched_ring(curves: Column) -> Column:
    """A ring from arrays of points in order: a curve's first point goes where it is within 1e-6 of the last one kept, and the ring is closed
    where its ends are not the same. Null with fewer than three points."""
    near = lambda p, q: (F.abs(p["x"] - q["x"]) < 1e-6) & (F.abs(p["y"] - q["y"]) < 1e-6)
    none = F.array().cast("array<struct<x:double,y:double>>")

    def join(acc: Column, c: Column) -> Column:
        meets = (F.size(acc) > 0) & (F.size(c) > 0) & near(F.try_element_at(acc, F.lit(-1)), F.get(c, F.lit(0)))
        return F.concat(acc, F.when(meets, F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c))

    ring = F.aggregate(curves, none, join)
    first, last = F.get(ring, F.lit(0)), F.try_element_at(ring, F.lit(-1))
    closed = F.when((first["x"] == last["x"]) & (first["y"] == last["y"]), ring).otherwise(F.concat(ring, F.array(first)))
    return F.when(F.size(ring) >= 3, closed)
