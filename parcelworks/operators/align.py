"""Placement of maps: extents, centres, shifts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.functions.geom import affine
from parcelworks.functions.maps import effective_scale, is_arbitrary
from parcelworks.operators.stats import dominant_oaza


def map_bounds(parcels: DataFrame) -> DataFrame:
    """(xml_meta_id, min_x, min_y, max_x, max_y) of parcels given as x0, y0, w, h."""
    return parcels.groupBy("xml_meta_id").agg(F.min("x0").alias("min_x"), F.min("y0").alias("min_y"), F.max(F.col("x0") + F.col("w")).alias("max_x"), F.max(F.col("y0") + F.col("h")).alias("max_y"))


def weighted_centres(shapes: DataFrame, key: str) -> DataFrame:
    """(key, cx, cy): area-weighted centres of (key, area, cx, cy), exact where shapes do not overlap."""
    area = F.sum("area")
    return shapes.groupBy(key).agg((F.sum(F.col("area") * F.col("cx")) / area).alias("cx"), (F.sum(F.col("area") * F.col("cy")) / area).alias("cy"))


def mean_centres(parcels: DataFrame) -> DataFrame:
    return parcels.groupBy("xml_meta_id").agg(F.avg(F.col("x0") + F.col("w") / 2).alias("cx"), F.avg(F.col("y0") + F.col("h") / 2).alias("cy"))


def auto_positions(meta: DataFrame, parcels: DataFrame, districts: DataFrame) -> DataFrame:
    """(xml_meta_id, dx, dy) that bring each arbitrary map's centre to its district's (name, cx, cy)."""
    maps = meta.where(is_arbitrary(F.col("crs_type"))).select(F.col("id").alias("xml_meta_id"))
    shapes = parcels.select("xml_meta_id", (F.col("w") * F.col("h")).alias("area"), (F.col("x0") + F.col("w") / 2).alias("cx"), (F.col("y0") + F.col("h") / 2).alias("cy"))
    centres = weighted_centres(shapes, "xml_meta_id").join(maps, "xml_meta_id", "left_semi")
    named = centres.join(dominant_oaza(parcels), "xml_meta_id")
    target = districts.select(F.trim("name").alias("oaza_name"), F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    return named.join(target, "oaza_name").select("xml_meta_id", (F.col("tx") - F.col("cx")).alias("dx"), (F.col("ty") - F.col("cy")).alias("dy"))


def placed_maps(parcels: DataFrame, envelopes: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parcels and envelopes (xml_meta_id, geom) moved together by their maps' (dx, dy), and with ``moved``, whether they were."""
    moves = moves.withColumn("scale", F.lit(1.0))
    hit = moves.select("xml_meta_id").withColumn("moved", F.lit(True))
    mark = lambda df: shift(df, moves).join(hit, "xml_meta_id", "left").withColumn("moved", F.coalesce("moved", F.lit(False)))
    return mark(parcels), mark(envelopes)


def anchored_moves(anchors: DataFrame, meta: DataFrame) -> DataFrame:
    """(xml_meta_id, scale, dx, dy) that bring the source point (sx, sy) of each map to its target (tx, ty): maps of arbitrary coordinates are scaled to
    metres first, others only shifted."""
    s = F.when(is_arbitrary(F.col("crs_type")), effective_scale(F.col("scale_denominator"), F.col("map_name")) / 1000.0).otherwise(1.0)
    rows = anchors.join(meta.select(F.col("id").alias("xml_meta_id"), s.alias("scale")), "xml_meta_id")
    return rows.select("xml_meta_id", "scale", (F.col("tx") - F.col("scale") * F.col("sx")).alias("dx"), (F.col("ty") - F.col("scale") * F.col("sy")).alias("dy"))


def match_anchors(best: DataFrame, parcels: DataFrame, lots: DataFrame) -> DataFrame:
    """(xml_meta_id, sx, sy, tx, ty): for each map the centre of the parcel with the best match, and of its lot. ``best``: xml_meta_id, fude_id, lot_id,
    level; parcels: xml_meta_id, fude_id, cx, cy; lots: lot_id, cx, cy."""
    rank = F.when(F.col("level") == "exact", 0).when(F.col("level") == "parent", 1).otherwise(2)
    one = best.groupBy("xml_meta_id").agg(F.min(F.struct(rank.alias("p"), "fude_id", "lot_id")).alias("m")).select("xml_meta_id", "m.fude_id", "m.lot_id")
    source = parcels.groupBy("xml_meta_id", "fude_id").agg(F.min(F.struct("cx", "cy")).alias("s"))
    joined = one.join(source, ["xml_meta_id", "fude_id"]).join(lots.select("lot_id", F.col("cx").alias("tx"), F.col("cy").alias("ty")), "lot_id")
    return joined.select("xml_meta_id", F.col("s.cx").alias("sx"), F.col("s.cy").alias("sy"), "tx", "ty")


def shift(parcels: DataFrame, moves: DataFrame, geom: str = "geom") -> DataFrame:
    """Parcels with polygons moved by their map's (scale, dx, dy); maps without a move stay."""
    moved = parcels.join(moves, "xml_meta_id", "left")
    new = affine(F.col(geom), F.coalesce("scale", F.lit(1.0)), F.coalesce("dx", F.lit(0.0)), F.coalesce("dy", F.lit(0.0)))
    return moved.withColumn(geom, new).drop("scale", "dx", "dy")
