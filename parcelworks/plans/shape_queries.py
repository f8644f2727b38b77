"""Queries on areas of several parts, with holes and bends, read from WKT; their SQL counts in rectangles.

Every kind of area of ``layer`` is a sum of rectangles less others, given here as fixed values relative to its corner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.functions import geom, shapes
from parcelworks.operators import spatial, store, unions
from parcelworks.plans.registry import query

#: Fixed values: (kind, x0, y0, x1, y1, sign) of the rectangles of each kind of area, and those of the bent shape of a map.
_PARTS = """parts(kind, x0, y0, x1, y1, s) AS (VALUES (1, 0, 0, 20, 10, 1), (2, 0, 0, 5, 5, 1), (2, 10, 10, 14, 14, 1), (3, 0, 0, 20, 20, 1), (3, 4, 4, 8, 8, -1),
  (4, 0, 0, 20, 5, 1), (4, 0, 5, 5, 20, 1), (7, 0, 0, 6, 6, 1), (7, 1, 1, 2, 2, -1), (7, 10, 0, 20, 6, 1), (7, 12, 1, 15, 3, -1))"""
_BENT = "bent(x0, y0, x1, y1) AS (VALUES (-3, 2, 25, 6), (-3, 6, 2, 32))"
_PIECES = f"{_PARTS}, piece AS (SELECT layer_id AS area_id, x + x0 AS x0, y + y0 AS y0, x + x1 AS x1, y + y1 AS y1, s FROM layer JOIN parts USING (kind))"
_MAPS = f"{_BENT}, strip AS (SELECT layer_id AS key, x + x0 AS x0, y + y0 AS y0, x + x1 AS x1, y + y1 AS y1 FROM layer, bent WHERE layer_id % 2 = 0)"


def _areas(layer: DataFrame) -> DataFrame:
    """The layer's areas by its own ids."""
    return store.areas_from_wkt(layer, "name").withColumn("admin_id", F.substring("name", 2, 20).cast("long"))


def _bent_maps(layer: DataFrame) -> DataFrame:
    """Bent shapes (key, geom), one for every second area, that reach into its neighbours."""
    corners = ((-3, 2), (25, 2), (25, 6), (2, 6), (2, 32), (-3, 32), (-3, 2))
    point = lambda dx, dy: F.struct((F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y"))
    return layer.where("layer_id % 2 = 0").select(F.col("layer_id").alias("key"), F.array(F.array(*[point(*c) for c in corners])).alias("geom"))


@query(
    "s7_layer_of_areas",
    "layer",
    f""", {_PARTS}, sums AS (SELECT kind, sum(s * (x1 - x0) * (y1 - y0))::DOUBLE AS area, min(x0) AS x0, max(y1) AS y1 FROM parts GROUP BY 1)
    SELECT name, CASE kind WHEN 0 THEN 0 WHEN 2 THEN 2 WHEN 7 THEN 2 WHEN 5 THEN -1 WHEN 6 THEN -1 ELSE 1 END AS parts, coalesce(area, 0) AS area, (x + x0)::DOUBLE AS min_x, (y + y1)::DOUBLE AS max_y,
      CASE kind WHEN 5 THEN 'brackets or signs that do not fit' WHEN 6 THEN 'neither POLYGON nor MULTIPOLYGON' END AS error FROM layer LEFT JOIN sums USING (kind)""",
)
def _(layer):
    rows = store.areas_from_wkt(layer, "name").withColumn("box", shapes.shape_box(F.col("geom")))
    parts = F.coalesce(F.size("geom"), F.lit(-1))
    return rows.select("name", F.when(F.col("geom").isNull(), -1).otherwise(parts).alias("parts"), shapes.shape_area(F.col("geom")).alias("area"), F.col("box.min_x").alias("min_x"), F.col("box.max_y").alias("max_y"), "error")


@query("g3_shape_round_trip", "layer", "SELECT layer_id, CASE kind WHEN 0 THEN 'MULTIPOLYGON EMPTY' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE 'MULTIPOLYGON(((' END AS head, kind NOT IN (5, 6) AS same FROM layer")
def _(layer):
    rows = _areas(layer).withColumn("text", shapes.to_wkt(F.col("geom")))
    again = rows.withColumn("again", shapes.parse_wkt(F.col("text"))["geom"])
    head = F.regexp_extract("text", r"^(MULTIPOLYGON EMPTY|MULTIPOLYGON\({3})", 1)
    return again.select(F.col("admin_id").alias("layer_id"), head.alias("head"), (F.col("geom").isNotNull() & F.equal_null("again", "geom")).alias("same"))


@query(
    "g4_shape_centroid",
    "layer",
    f""", {_PARTS} SELECT layer_id, round(x + sum(s * (x1 - x0) * (y1 - y0) * (x0 + x1) / 2.0) / sum(s * (x1 - x0) * (y1 - y0)), 6) AS cx,
      round(y + sum(s * (x1 - x0) * (y1 - y0) * (y0 + y1) / 2.0) / sum(s * (x1 - x0) * (y1 - y0)), 6) AS cy FROM layer LEFT JOIN parts USING (kind) GROUP BY layer_id, layer.x, layer.y""",
)
def _(layer):
    rows = _areas(layer).select(F.col("admin_id").alias("layer_id"), shapes.shape_centroid(F.col("geom")).alias("c"))
    return rows.select("layer_id", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"))


@query(
    "j10_bent_overlap",
    "layer",
    f""", {_PIECES}, {_MAPS}, met AS (SELECT key, area_id, sum(s * greatest(0, least(strip.x1, piece.x1) - greatest(strip.x0, piece.x0)) * greatest(0, least(strip.y1, piece.y1) - greatest(strip.y0, piece.y0))) AS overlap
      FROM strip JOIN piece ON strip.x0 < piece.x1 AND strip.x1 > piece.x0 AND strip.y0 < piece.y1 AND strip.y1 > piece.y0 GROUP BY ALL)
    SELECT key, area_id, overlap::DOUBLE AS overlap FROM met WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY overlap DESC, area_id) = 1""",
)
def _(layer):
    return spatial.largest_overlap(_bent_maps(layer), _areas(layer)).select("key", F.col("admin_id").alias("area_id"), F.round("overlap", 6).alias("overlap"))


@query(
    "j11_point_in_parts",
    "layer",
    f""", {_PIECES}, p AS (SELECT layer_id AS key, x + layer_id % 17 AS px, y + layer_id % 13 AS py FROM layer),
    open AS (SELECT key, area_id FROM p JOIN piece ON s < 0 AND px > x0 AND px < x1 AND py > y0 AND py < y1)
    SELECT key, min(area_id) AS area_id FROM p JOIN piece ON s > 0 AND px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 WHERE NOT EXISTS (SELECT 1 FROM open WHERE open.key = p.key AND open.area_id = piece.area_id) GROUP BY 1""",
)
def _(layer):
    x, y = (F.col("x") + F.col("layer_id") % 17).cast("double"), (F.col("y") + F.col("layer_id") % 13).cast("double")
    points = layer.select(F.col("layer_id").alias("key"), x.alias("x"), y.alias("y"))
    return spatial.containing_area(points, _areas(layer)).select("key", F.col("admin_id").alias("area_id"))


@query(
    "j13_bent_meeting",
    "layer",
    f""", {_PIECES}, {_MAPS} SELECT DISTINCT key, area_id FROM strip JOIN piece ON s > 0 AND strip.x0 <= piece.x1 AND strip.x1 >= piece.x0 AND strip.y0 <= piece.y1 AND strip.y1 >= piece.y0""",
)
def _(layer):
    return spatial.meeting_pairs(_bent_maps(layer), _areas(layer)).select("key", F.col("admin_id").alias("area_id"))


@query(
    "a13_union_centres",
    "admin",
    """, b AS (SELECT admin_id % 2 AS key, * FROM admin), xs AS (SELECT key, min_x AS x FROM b UNION SELECT key, max_x FROM b), ys AS (SELECT key, min_y AS y FROM b UNION SELECT key, max_y FROM b),
    xi AS (SELECT key, x, lead(x) OVER (PARTITION BY key ORDER BY x) AS x2 FROM xs), yi AS (SELECT key, y, lead(y) OVER (PARTITION BY key ORDER BY y) AS y2 FROM ys),
    cell AS (SELECT xi.key, x, x2, y, y2 FROM xi JOIN yi USING (key) WHERE x2 IS NOT NULL AND y2 IS NOT NULL AND EXISTS (SELECT 1 FROM b WHERE b.key = xi.key AND min_x <= x AND max_x >= x2 AND min_y <= y AND max_y >= y2))
    SELECT key, round(sum((x2 - x) * (y2 - y)), 4) AS area, round(sum((x2 - x) * (y2 - y) * (x + x2) / 2) / sum((x2 - x) * (y2 - y)), 4) AS cx, round(sum((x2 - x) * (y2 - y) * (y + y2) / 2) / sum((x2 - x) * (y2 - y)), 4) AS cy FROM cell GROUP BY 1""",
)
def _(admin):
    shapes = admin.select((F.col("admin_id") % 2).cast("string").alias("key"), geom.rectangle(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y")).alias("geom"))
    rows = unions.union_centres(shapes, cell_rows=4)
    return rows.select(F.col("key").cast("long").alias("key"), F.round("area", 4).alias("area"), F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"))
