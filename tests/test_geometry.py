"""Polygon functions and spatial joins against brute force, on star-shaped polygons with holes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelworks.functions import geom, shapes, zones
from parcelworks.operators import match, spatial, store, unions
from parcelworks.sources import scratch

SHAPE = "array<array<struct<x:double,y:double>>>"


def star(rng, cx, cy, size, n=9):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(cx + size * rng.uniform(0.4, 1) * math.cos(t), cy + size * rng.uniform(0.4, 1) * math.sin(t)) for t in turns]
    return [*ring, ring[0]]


def square(x, y, s):
    x, y = float(x), float(y)
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


def inside(polygon, x, y):
    odd = False
    for ring in polygon:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def distance(polygon, x, y):
    best = math.inf
    for ring in polygon:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            dx, dy = x2 - x1, y2 - y1
            t = 0 if dx == dy == 0 else min(1, max(0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(x1 + t * dx - x, y1 + t * dy - y))
    return best


@pytest.fixture(scope="module")
def areas():
    """Districts of very different sizes, some with a hole."""
    rng = random.Random(4)
    out = [[star(rng, rng.uniform(0, 100), rng.uniform(0, 100), s)] for s in (1, 2, 5, 5, 9, 15, 15, 30, 60, 0.2)]
    out += [[square(10, 10, 40), square(20, 20, 10), square(35, 35, 5)], [square(-500, -500, 2000), square(-100, -100, 190)]]
    return out


@pytest.fixture(scope="module")
def districts(spark, areas):
    return spark.createDataFrame([(i, f"d{i}", p) for i, p in enumerate(areas)], f"admin_id long, name string, geom {SHAPE}")


@pytest.fixture(scope="module")
def spots(spark):
    rng = random.Random(5)
    rows = [(i, rng.uniform(-20, 120), rng.uniform(-20, 120)) for i in range(500)] + [(1000, 10.0, 30.0), (1001, 20.0, 25.0), (1002, 5000.0, 0.0)]
    return rows, spark.createDataFrame(rows, "key long, x double, y double")


def test_point_in_polygon(areas, districts, spots):
    rows, frame = spots
    got = {r.key: r.admin_id for r in spatial.containing_area(frame, districts).collect()}
    want = {k: min(found) for k, x, y in rows if (found := [i for i, p in enumerate(areas) if inside(p, x, y)])}
    assert {k: v for k, v in got.items() if k < 1000} == {k: v for k, v in want.items() if k < 1000} and len(set(want.values())) > 4
    for k, x, y in rows[-3:-1]:  # borders count as inside, those of holes too
        assert got[k] == min([10] + [i for i, p in enumerate(areas) if inside(p, x, y)])
    assert 1002 not in got and {r.admin_id for r in spatial.containing_area(frame.where("key >= 1000"), districts.where("admin_id = 10")).collect()} == {10}


def test_locate(areas, districts, spots):
    rows, frame = spots
    got = {r.key: r.admin_id for r in spatial.locate(frame, districts, 4.0).collect()}
    want = {}
    for k, x, y in rows:
        near = []
        for i, p in enumerate(areas):
            xs, ys = [a for a, _ in p[0]], [b for _, b in p[0]]
            if min(xs) <= x + 4 and max(xs) >= x - 4 and min(ys) <= y + 4 and max(ys) >= y - 4:
                near.append((not inside(p, x, y), 0 if inside(p, x, y) else distance(p, x, y), i))
        if near:
            want[k] = min(near)[2]
    assert {k: v for k, v in got.items() if k < 1000} == {k: v for k, v in want.items() if k < 1000}


def flat(rings):
    """Edges of rings, a column each."""
    return np.array([(*a, *b) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)], float).reshape(-1, 4).T


def test_overlap_of_shapes_that_are_not_convex():
    bent = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)]
    around = [(-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9)]
    assert abs(spatial.overlap_area(flat([bent]), flat([around])) - 7) < 1e-12
    turned = [(4 - x, 4 - y) for x, y in bent]
    assert abs(spatial.overlap_area(flat([bent]), flat([turned])) - 2) < 1e-12  # two corners
    holed = [around, [(-1, -1), (2, -1), (2, 2), (-1, 2), (-1, -1)]]
    assert abs(spatial.overlap_area(flat([bent]), flat(holed)) - 4) < 1e-12
    assert abs(spatial.overlap_area(flat(holed), flat(holed)) - (324 - 9)) < 1e-9
    bow = [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]  # crosses itself
    assert abs(spatial.overlap_area(flat([bow]), flat([around])) - 2) < 1e-12
    assert spatial.overlap_area(flat([bent]), flat([[(4, 0), (5, 0), (5, 4), (4, 4)]])) == 0 == spatial.overlap_area(flat([]), flat([bent]))
    far = [(x + 4e6, y - 5e6) for x, y in bent]
    assert abs(spatial.overlap_area(flat([far]), flat([[(x + 4e6, y - 5e6) for x, y in turned]])) - 2) < 1e-6


def test_overlap_of_stars_with_holes_and_parts():
    """Against a grid of points, either way round, and in small runs of slabs."""
    rng = random.Random(12)
    shapes = []
    for _ in range(12):
        x, y = rng.uniform(10, 50), rng.uniform(10, 50)
        outer, other = star(rng, x, y, 20), star(rng, x + 60, y, 12)
        hole = [(x + (px - x) * 0.4, y + (py - y) * 0.4) for px, py in outer]
        shapes.append([outer, hole, other])
    grid = [(x + 0.5, y + 0.5) for x in range(-30, 140, 1) for y in range(-30, 90, 1)]
    within = [np.array([inside(s, x, y) for x, y in grid]) for s in shapes]
    for i in range(0, 12, 2):
        for j in range(1, 12, 3):
            a, b = flat(shapes[i]), flat(shapes[j])
            exact = spatial.overlap_area(a, b)
            assert abs(exact - (within[i] & within[j]).sum()) < 40
            assert abs(exact - spatial.overlap_area(b, a)) < 1e-6 and abs(exact - spatial.overlap_area(a, b, cells=100)) < 1e-6


def test_joins_on_shapes_of_several_parts(spark):
    """A point, a lot and the largest overlap are found in the second part; polygons and shapes go together."""
    parts = [[square(0, 0, 10), square(4, 4, 2)], [[(30.0, 0.0), (40.0, 0.0), (40.0, 2.0), (32.0, 2.0), (32.0, 10.0), (30.0, 10.0), (30.0, 0.0)]]]
    areas = spark.createDataFrame([(1, parts), (2, [[square(36, 6, 9)]]), (3, []), (4, None)], f"admin_id long, geom array<{SHAPE}>")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 5.0), (3, 31.0, 9.0), (4, 35.0, 5.0), (5, 40.0, 1.0), (6, 45.0, 8.0)], "key long, x double, y double")
    assert {r.key: r.admin_id for r in spatial.containing_area(points, areas).collect()} == {2: 1, 3: 1, 5: 1, 6: 2}
    assert {r.key: r.admin_id for r in spatial.locate(points, areas, 2.5).collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 2}
    shapes = spark.createDataFrame([(1, [square(4.5, 4.5, 1)]), (2, [square(31, 1, 8)]), (3, [square(35, 3, 1)]), (4, [square(40, 2, 1)])], f"key long, geom {SHAPE}")
    assert {(r.key, r.admin_id) for r in spatial.meeting_pairs(shapes, areas).collect()} == {(2, 1), (2, 2), (4, 1)}
    # of the square of 8: two strips of the bent part, 8 + 7; 3 x 3 of the other area
    assert [(r.key, r.admin_id, round(r.overlap, 9)) for r in spatial.largest_overlap(shapes, areas).collect()] == [(2, 1, 15.0)]
    with pytest.raises(ValueError, match="neither"):
        spatial.containing_area(points, areas.select("admin_id", F.lit("x").alias("geom")))


def test_overlap_runs_its_function_once(spark, areas, districts):
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(areas)], f"key long, geom {SHAPE}")
    plan = spatial.largest_overlap(frame, districts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Repartition" in plan


def test_overlap_by_counting(spark, areas, districts):
    """Clipped areas against a fine grid of points, and never more than either shape."""
    hull = [(20.0, 5.0), (60.0, 10.0), (70.0, 50.0), (40.0, 80.0), (5.0, 45.0), (20.0, 5.0)]
    grid = [(x + 0.25, y + 0.25) for x in np.arange(0, 80, 0.5) for y in np.arange(0, 90, 0.5)]
    sizes = {}
    for i, p in enumerate(areas):
        sizes[i] = sum(inside([hull], x, y) and inside(p, x, y) for x, y in grid) * 0.25
    for i, p in enumerate(areas):
        exact = spatial.overlap_area(flat([hull]), flat(p))
        assert abs(exact - sizes[i]) < 20 and abs(exact - spatial.overlap_area(flat([hull[::-1]]), flat(p))) < 1e-9
    best = spatial.largest_overlap(spark.createDataFrame([("h", [hull]), ("away", [square(9000, 9000, 1)])], f"key string, geom {SHAPE}"), districts).collect()
    assert [(r.key, r.admin_id) for r in best] == [("h", max(sizes, key=lambda i: sizes[i]))]


def test_meeting_polygons(spark, areas, districts):
    rng = random.Random(6)
    shapes = [[star(rng, rng.uniform(-40, 140), rng.uniform(-40, 140), rng.choice([0.3, 3, 20]))] for _ in range(150)]
    shapes += [[square(22, 22, 3)], [square(20, 20, 2)], [square(50, 10, 1)], [square(36, 36, 1)]]  # in a hole; at its border; at the outer border; in the other hole
    frame = spark.createDataFrame(list(enumerate(shapes)), f"key long, geom {SHAPE}")

    def segments(p):
        return [(a, b) for r in p for a, b in zip(r, r[1:], strict=False)]

    def cross(a, b, c, d):
        turn = lambda o, u, v: (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])
        boxes = min(a[0], b[0]) <= max(c[0], d[0]) and max(a[0], b[0]) >= min(c[0], d[0]) and min(a[1], b[1]) <= max(c[1], d[1]) and max(a[1], b[1]) >= min(c[1], d[1])
        return boxes and turn(c, d, a) * turn(c, d, b) <= 0 and turn(a, b, c) * turn(a, b, d) <= 0

    meets = lambda p, q: any(cross(a, b, c, d) for a, b in segments(p) for c, d in segments(q)) or inside(q, *p[0][0]) or inside(p, *q[0][0])
    want = {(k, i) for k, p in enumerate(shapes) for i, q in enumerate(areas) if meets(p, q)}
    got = [(r.key, r.admin_id) for r in spatial.meeting_pairs(frame, districts).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert (150, 10) not in want and {(151, 10), (152, 10)} <= want
    assert {r.key for r in spatial.meeting(frame, districts.limit(0)).collect()} == set(range(len(shapes)))


def test_box_pairs_once_whatever_the_size(spark):
    rng = random.Random(7)
    boxes = [(i, (x := rng.uniform(-1e4, 1e4)), (y := rng.uniform(-1e4, 1e4)), x + rng.choice([0, 1e-4, 1, 50, 900, 30000]), y + rng.choice([0, 1, 700, 40000])) for i in range(300)]
    box = F.struct("min_x", "min_y", "max_x", "max_y")
    frame = lambda n: spark.createDataFrame(boxes, f"{n} long, min_x double, min_y double, max_x double, max_y double").select(n, box.alias(f"box_{n}"))
    got = [(r.a, r.b) for r in spatial.box_pairs(frame("a"), frame("b"), "box_a", "box_b").collect()]
    want = {(p[0], q[0]) for p in boxes for q in boxes if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]}
    assert len(got) == len(set(got)) and set(got) == want


def test_centroid_takes_holes_out(spark):
    rng = random.Random(8)
    rows = [(0, [square(0, 0, 10), square(2, 2, 2)])]
    rows += [(i, [star(rng, 1e6, 2e6, 50), square(1e6 - 3, 2e6 - 3, 6)]) for i in range(1, 30)] + [(i + 100, [r[::-1] for r in p]) for i, p in rows]
    rows += [(900, None), (901, []), (902, [[(1.0, 1.0), (2.0, 2.0), (1.0, 1.0)]])]
    frame = spark.createDataFrame(rows, f"key long, geom {SHAPE}")
    got = {r.key: r.c for r in frame.select("key", geom.polygon_centroid(F.col("geom")).alias("c")).collect()}

    def moments(ring):
        ox, oy = ring[0]
        a = mx = my = 0.0
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            x1, y1, x2, y2 = x1 - ox, y1 - oy, x2 - ox, y2 - oy
            c = x1 * y2 - x2 * y1
            a, mx, my = a + c / 2, mx + (x1 + x2) * c / 6, my + (y1 + y2) * c / 6
        s = 1 if a >= 0 else -1
        return s * a, s * (mx + a * ox), s * (my + a * oy)

    for key, polygon in rows:
        if key < 900:
            parts = [moments(r) for r in polygon]
            a, mx, my = (parts[0][k] - sum(p[k] for p in parts[1:]) for k in range(3))
            assert math.isclose(got[key].x, mx / a, abs_tol=1e-6) and math.isclose(got[key].y, my / a, abs_tol=1e-6)
    assert math.isclose(got[0].x, (500 - 4 * 3) / 96) and got[900] is None and got[901] is None and got[902] is None


def test_zones(spark):
    """A published pair of coordinates, origins, and round trips under a millimetre up to 130 km away and between zones."""
    rng = random.Random(9)
    rows = [(z, rng.uniform(-130_000, 130_000), rng.uniform(-300_000, 300_000)) for z in range(1, 20) for _ in range(20)]
    frame = spark.createDataFrame(rows, "zone int, x double, y double")
    ll = frame.withColumn("ll", zones.from_zone(F.col("x"), F.col("y"), F.col("zone")))
    back = ll.select("x", "y", zones.to_zone(F.col("ll.longitude"), F.col("ll.latitude"), F.col("zone")).alias("b"), zones.change_zone(F.col("x"), F.col("y"), F.col("zone"), F.col("zone") % 19 + 1).alias("o"), "zone")
    back = back.withColumn("c", zones.change_zone(F.col("o.x"), F.col("o.y"), F.col("zone") % 19 + 1, F.col("zone")))
    assert all(abs(r.b.x - r.x) < 1e-4 and abs(r.b.y - r.y) < 1e-4 for r in back.collect())
    near = back.where(F.abs(F.col("o.x")) < 500_000).collect()
    assert len(near) > 50 and all(abs(r.c.x - r.x) < 1e-3 and abs(r.c.y - r.y) < 1e-3 for r in near)
    one = spark.createDataFrame([(140.08785504166664, 36.103774791666666, 9)], "lon double, lat double, zone int").select(zones.to_zone(F.col("lon"), F.col("lat"), F.col("zone")).alias("p")).first().p
    assert abs(one.y - 11543.6883) < 1e-3 and abs(one.x - 22916.2436) < 1e-3
    origin = spark.createDataFrame([(float(o[1]), float(o[0]), i + 1) for i, o in enumerate(zones.ORIGINS)] + [(0.0, 0.0, 20)], "lon double, lat double, zone int")
    points = [r.p for r in origin.select(zones.to_zone(F.col("lon"), F.col("lat"), F.col("zone")).alias("p")).collect()]
    assert points[-1] is None and all(abs(p.x) < 1e-6 and abs(p.y) < 1e-6 for p in points[:-1])
    box = spark.range(1).select(zones.change_box(F.struct(F.lit(0.0).alias("min_x"), F.lit(0.0).alias("min_y"), F.lit(100.0).alias("max_x"), F.lit(50.0).alias("max_y")), F.lit(8), F.lit(8)).alias("b")).first().b
    assert math.isclose(box.max_x, 100, abs_tol=1e-4) and math.isclose(box.max_y, 50, abs_tol=1e-4)
    for low, high, old, new in (((-90_000.0, -200_000.0), (60_000.0, 150_000.0), 8, 9), ((-40_000.0, 0.0), (40_000.0, 90_000.0), 6, 6), ((10_000.0, -5_000.0), (10_400.0, -4_900.0), 9, 7)):
        area = F.struct(*[F.lit(v).alias(n) for n, v in zip(("min_x", "min_y", "max_x", "max_y"), (*low, *high), strict=True)])
        b = spark.range(1).select(zones.change_box(area, F.lit(old), F.lit(new)).alias("b")).first().b
        inside_ = [(rng.uniform(low[0], high[0]), rng.uniform(low[1], high[1])) for _ in range(9000)]
        inside_ += [(rng.choice((low[0], high[0])), rng.uniform(low[1], high[1])) for _ in range(500)] + [(rng.uniform(low[0], high[0]), rng.choice((low[1], high[1]))) for _ in range(500)]
        moved = [r.p for r in spark.createDataFrame(inside_, "x double, y double").select(zones.change_zone(F.col("x"), F.col("y"), F.lit(old), F.lit(new)).alias("p")).collect()]
        assert all(b.min_x <= p.x <= b.max_x and b.min_y <= p.y <= b.max_y for p in moved)
        tight = (min(p.x for p in moved) - b.min_x, b.max_x - max(p.x for p in moved), min(p.y for p in moved) - b.min_y, b.max_y - max(p.y for p in moved))
        assert max(tight) < 0.01 * (b.max_x - b.min_x + b.max_y - b.min_y)


# Matching


PARCELS = [(1, "a", "大字1", "12-3"), (1, "b", "", "12-3"), (1, "c", None, "12"), (1, "d", "大字2", "道"), (2, "e", "大字1小字", "13-1"), (2, "f", "大字9", "12"), (2, "g", "大字1", ""), (2, "h", "大字1", None), (1, "a", "大字1", "12-3")]
LOTS = [(1, "大字1", None, "12", "3"), (2, None, None, "12", ""), (3, "大字1", "x町", "12", "9"), (4, "大字2", None, "水", None), (5, "大字1", None, "12-3", ""), (6, "大字1小字", None, "13", "1"), (7, "大字1", None, None, None), (8, "大字1", "西町", "11", "")]


def by_hand(levels, digits_only=False):
    out = set()
    split = lambda c: tuple((c or "").split("-", 1)) if "-" in (c or "") else (c or "", "")
    for m, f, oaza, chiban in PARCELS:
        p, pb = split(chiban)
        for lot, lo, muni, q, qb in LOTS:
            q, qb = q or "", qb or ""
            if not p or (oaza and not (lo and (oaza.startswith(lo) or lo.startswith(oaza)))) or (muni and muni not in "西町"):
                continue
            joined = lambda a, b: f"{a}-{b}" if b else a
            near = len(p) == len(q) and p[:-1] == q[:-1] and (not digits_only or (p.isdigit() and q.isdigit()))
            level = "exact" if joined(p, pb) == joined(q, qb) else "parent" if p == q else "near" if near else None
            if level in levels:
                out.add((m, f, chiban, lot, level))
    return out


@pytest.mark.parametrize("levels", [match.LEVELS, ("exact",), ("exact", "parent"), ("near",), ("parent",), ("exact", "near")])
def test_matches_by_hand(spark, levels):
    parcels = spark.createDataFrame([(*p, "西町") for p in PARCELS], "xml_meta_id long, fude_id string, oaza_name string, chiban string, municipality_name string")
    lots = spark.createDataFrame(LOTS, "lot_id long, oaza_name string, municipality_name string, parent_no string, branch_no string")
    rows = [tuple(r) for r in match.number_matches(parcels, lots, levels).collect()]
    want = by_hand(levels)
    assert len(rows) == len(set(rows)) and set(rows) == want
    rank = {x: i for i, x in enumerate(match.LEVELS)}
    best = {}
    for m, f, c, lot, level in want:
        best[m, f, c] = min(best.get((m, f, c), (9, 0)), (rank[level], lot))
    assert {(r.xml_meta_id, r.fude_id, r.chiban): (rank[r.level], r.lot_id) for r in match.best_lots(parcels, lots, levels).collect()} == best
    first = {}
    for m, f, _, lot, level in want:
        first[lot] = min(first.get(lot, (9, 0, "")), (rank[level], m, f))
    assert {r.lot_id: (rank[r.level], r.xml_meta_id, r.fude_id) for r in match.best_maps(parcels, lots, levels).collect()} == first
    if levels == match.LEVELS:
        assert {tuple(r) for r in match.number_matches(parcels, lots, digits_only=True).collect()} == by_hand(levels, True)


def test_lot_numbers_of_any_type(spark):
    rows = [(1, 12.0, 3), (2, 0.0, 0), (3, None, None), (4, 12.5, 7)]
    out = match.lot_numbers(spark.createDataFrame(rows, "lot_id long, parent_no double, branch_no int")).orderBy("lot_id").collect()
    assert [(r.parent_no, r.branch_no) for r in out] == [("12", "3"), ("", ""), ("", ""), ("12.5", "7")]


def test_wkt_of_all_kinds(spark):
    """Polygons and shapes in every spelling; what cannot be read says why and ends no job."""
    good = {
        "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))": (1, 16.0), "polygon z ((0 0 5,4 0 5,4 4 5,0 0 5),(1 0.5 2, 2 0.5 2, 2 1.5 2))": (1, 7.5), "MULTIPOLYGON EMPTY": (0, 0.0), " POLYGON  EMPTY ": (0, 0.0),
        "SRID=4326;MULTIPOLYGON ( ( ( 0 0 , 1e3 0, -1.5E-2 1 , 0 0 ) ) )": (1, 500.0), "POLYGON ZM((0 0 1 2,\n1 1 2 3,\t1 0 2 2))": (1, 0.5), "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,7 5,7 7,5 5),(6 5.5, 6.5 5.5, 6.5 6)))": (2, 2.375),
        "POLYGON((" + ", ".join(f"{i} {i * i}" for i in range(20000)) + "))": (1, None),
    }
    bad = ["", "POLYGON((0 0, 1 x, 2 2))", "POLYGON((0 0, 1 1))", "LINESTRING(0 0,1 1)", "POLYGON((0 0, 1 1, 1 0)", "POLYGON(0 0, 1 1, 1 0)", "MULTIPOLYGON((0 0,1 1, 1 0))", "POLYGON((0 0, 1 1e999, 1 0))",
           "POLYGON((0 0,1 1,1 0)),((2 2,3 3,4 4))", "POLYGON((0 0,1 1,1 0) (2 2,3 3,4 4))", "POLYGON((0 0 1 2 3,1 1,1 0))", "GEOMETRYCOLLECTION(POLYGON((0 0,1 1,1 0)))"]
    rows = spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string").withColumn("p", shapes.parse_wkt(F.col("t")))
    got = {r.t: r for r in rows.select("t", F.size("p.geom").alias("n"), "p.error", shapes.shape_area(F.col("p.geom")).alias("a"), geom.from_wkt(F.col("t")).isNull().alias("none")).collect()}
    for text, (n, area) in good.items():
        assert got[text].error is None and got[text].n == n and (area is None or abs(got[text].a - area) < 1e-9) and got[text].none == (n != 1)
    assert all(got[t].error and got[t].n is None and got[t].none for t in bad)
    assert got[None].error is None and got[None].n is None


def test_layer_of_areas_keeps_its_errors(spark, tmp_path):
    rows = [("a", "POLYGON((0 0, 2 0, 2 2, 0 0))"), ("b", "POLYGON((0 0"), (None, "POLYGON EMPTY"), ("c", None), ("d", "MULTIPOLYGON EMPTY")]
    spark.createDataFrame(rows, "S_NAME string, wkt string").write.parquet(f"{tmp_path}/layer")
    areas = store.load_areas(spark, f"{tmp_path}/layer", "S_NAME")
    assert {(r.name, None if r.geom is None else len(r.geom), r.error is None) for r in areas.collect()} == {("a", 1, True), ("b", None, False), ("d", 0, True)}
    points = spark.createDataFrame([(1, 1.5, 1.0), (2, 9.0, 9.0)], "key long, x double, y double")
    assert [r.key for r in spatial.containing_area(points, areas).collect()] == [1]


def test_rectangles_are_told_from_other_shapes(spark):
    made = [([square(0, 0, 3)], True), ([square(0, 0, 3)[::-1]], True), ([square(0, 0, 3)[:4]], True), ([square(0, 0, 3), square(1, 1, 1)], False), ([[(0.0, 0.0), (3.0, 3.0), (3.0, 0.0), (0.0, 3.0)]], False),
            ([[(0.0, 0.0), (3.0, 0.0), (0.0, 0.0), (0.0, 3.0), (0.0, 0.0)]], False), ([[(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 0.0)]], False), ([[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 3.0), (0.0, 0.0)]], False), ([], False)]
    frame = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(made)], f"i long, g {SHAPE}")
    got = {r.i: r.b for r in frame.select("i", shapes.is_box(shapes.as_shape(frame, "g")).alias("b")).collect()}
    assert got == {i: box for i, (_, box) in enumerate(made)}


def test_scratch_tables_go_with_their_scope(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{tmp_path}")
    folders = lambda: [p.name for p in tmp_path.iterdir()]
    with scratch.scope(spark):
        table = scratch.written(spark.range(10), "ten")
        assert table.count() == 10 and len(folders()) == 1
    assert not folders()
    kept = scratch.written(spark.range(3), "three")
    assert kept.count() == 3
    scratch.drop(kept)
    assert not folders()


def test_union_counts_overlaps_once(spark):
    """Stars with holes and parts against a grid of points; squares in closed form; whatever the cells."""
    rng = random.Random(31)
    frames, rows = {}, []
    for key in ("a", "b"):
        frames[key] = []
        for _ in range(25):
            x, y = rng.uniform(0, 80), rng.uniform(0, 60)
            outer = star(rng, x, y, rng.uniform(4, 15))
            frames[key].append([outer, [(x + (px - x) * 0.4, y + (py - y) * 0.4) for px, py in outer]])
            rows.append((key, frames[key][-1]))
    rows += [("c", [square(0, 0, 2)]), ("c", [square(1, 1, 2)]), ("c", [square(0, 0, 2)]), ("d", [square(5, 5, 1), square(5, 5, 1)]), ("e", None), ("f", [[(0.0, 0.0), (3.0, 0.0)]])]
    frame = spark.createDataFrame(rows, f"key string, geom {SHAPE}")
    outs = [{r.key: (r.area, r.cx, r.cy) for r in unions.union_centres(frame, cell_rows=n).collect()} for n in (64, 3)]
    for key, shapes_ in frames.items():
        grid = np.array([(x + 0.5, y + 0.5) for x in range(-20, 100) for y in range(-20, 80)])
        held = np.array([any(inside(s, x, y) for s in shapes_) for x, y in grid])
        for out in outs:
            assert abs(out[key][0] - held.sum()) < 0.03 * held.sum() and abs(out[key][1] - grid[held, 0].mean()) < 0.5 and abs(out[key][2] - grid[held, 1].mean()) < 0.5
        assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(outs[0][key], outs[1][key], strict=True))
    assert all(math.isclose(x, y, rel_tol=1e-12) for out in outs for x, y in zip(out["c"], (7.0, 1.5, 1.5), strict=True)) and set(outs[0]) == {"a", "b", "c"}


def test_a_hot_cell_is_split(spark):
    """Points of which nearly all lie in one cell of a large area: the join's tasks for that cell are split, and no pair is lost."""
    low = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        spread = spark.range(400).select((F.col("id") + 10**6).alias("key"), (F.col("id") * 70.0 + 5000).alias("x"), (F.col("id") % 20 * 80.0).alias("y"))
        points = spark.range(40_000).select(F.col("id").alias("key"), (F.rand(1) * 10).alias("x"), (F.rand(2) * 10).alias("y")).unionByName(spread).repartition(6)
        areas = spark.createDataFrame([(1, [square(0, 0, 60)]), *[(i, [square(5000 + 70 * i, i % 20 * 80 - 30, 60)]) for i in range(2, 300)]], f"admin_id long, geom {SHAPE}")
        found = spatial.containing_area(points, areas)
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sum(r.admin_id == 1 for r in rows) == 40_000 and len({r.key for r in rows}) == len(rows) > 40_200
        assert "skew=true" in plan or "skewed" in plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
