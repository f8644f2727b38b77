"""Parcel polygons out of the parsed elements of map files, in joins and groups by (source_name, id)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelworks.functions.geom import polygon_area, stitched_ring
from parcelworks.sources.scratch import written

POINTS = "array<struct<x:double,y:double>>"

#: Elements a task of an assembly gets, about.
ELEMENTS = 500_000


def _stored(parsed: DataFrame, *kinds: str) -> tuple[DataFrame, int]:
    """Elements of some kinds, written, so that files are parsed once for all steps of an assembly; and the number of tasks its shuffles are to have. It grows with the elements, so that the memory of
    a task, which sorts its part, does not."""
    rows = written(parsed.where(F.col("kind").isin(*kinds)).select("source_name", "kind", "id", "doc_seq", "ring_no", "seq", "ref", "x", "y"), "elements")
    return rows, max(int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ELEMENTS))


def _last(rows: DataFrame) -> DataFrame:
    """Rows of the last element of each (source_name, id)."""
    newest = F.max("doc_seq").over(Window.partitionBy("source_name", "id"))
    return rows.withColumn("__last", newest).where("doc_seq = __last").drop("__last")


def points(parsed: DataFrame) -> DataFrame:
    """(source_name, point_id, x, y): of points of one id the last counts."""
    last = parsed.where("kind = 'point'").groupBy("source_name", F.col("id").alias("point_id")).agg(F.max_by(F.struct("x", "y"), "doc_seq").alias("p"))
    return last.select("source_name", "point_id", "p.x", "p.y")


def curve_vertices(parsed: DataFrame) -> DataFrame:
    """(source_name, curve_id, seq, x, y): vertices in order, those given by a point in that point's place; one whose point is missing is
    left out. Of curves of one id the last counts, even if it has no vertex."""
    return _curve_vertices(*_stored(parsed, "point", "curve", "vertex"))


def _curve_vertices(elements: DataFrame, tasks: int) -> DataFrame:
    drawn = elements.where("kind IN ('curve', 'vertex')").select("source_name", "kind", "id", "doc_seq", "seq", "ref", "x", "y")
    last = _last(drawn.repartition(tasks, "source_name", "id")).where("kind = 'vertex'").drop("kind", "doc_seq")
    at = points(elements.where("kind = 'point'").repartition(tasks, "source_name", "id")).select("source_name", F.col("point_id").alias("ref"), F.col("x").alias("__x"), F.col("y").alias("__y"))
    met = last.where("x IS NULL OR y IS NULL").repartition(tasks, "source_name", "ref").join(at, ["source_name", "ref"])
    placed = last.unionByName(met.withColumns({"x": F.coalesce("x", "__x"), "y": F.coalesce("y", "__y")}).select(last.columns))
    return placed.where("x IS NOT NULL AND y IS NOT NULL").select("source_name", F.col("id").alias("curve_id"), "seq", "x", "y")


def _in_order(*columns: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*columns))), lambda r: r[columns[-1]])


def surface_polygons(parsed: DataFrame, swap_xy: bool = True) -> DataFrame:
    """(source_name, surface_id, geom): the rings of each surface, out of its curves in order. A reference that begins with ``-`` takes its
    curve backwards; a curve that is missing is passed over; a short hole is left out, a short outer ring makes the whole polygon null. X is north
    in the files, so coordinates are swapped."""
    x, y = ("y", "x") if swap_xy else ("x", "y")
    parsed, tasks = _stored(parsed, "point", "curve", "vertex", "surface", "ring")
    vertices = _curve_vertices(parsed, tasks).repartition(tasks, "source_name", "curve_id").select("source_name", "curve_id", "seq", F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("p"))
    curves = vertices.groupBy("source_name", "curve_id").agg(_in_order("seq", "p").alias("points"))
    elements = _last(parsed.where("kind IN ('surface', 'ring')").select("source_name", "kind", "id", "doc_seq", "ring_no", "seq", "ref").repartition(tasks, "source_name", "id"))
    refs = elements.where("kind = 'ring'").select(
        "source_name", F.col("id").alias("surface_id"), "ring_no", "seq", F.col("ref").startswith("-").alias("back"), F.regexp_replace("ref", "^[+-]", "").alias("curve_id")
    )
    met = refs.repartition(tasks, "source_name", "curve_id").join(curves, ["source_name", "curve_id"]).withColumn("points", F.when(F.col("back"), F.reverse("points")).otherwise(F.col("points")))
    rings = met.repartition(tasks, "source_name", "surface_id").groupBy("source_name", "surface_id", "ring_no").agg(_in_order("seq", "points").alias("curves"))
    rings = rings.select("source_name", "surface_id", "ring_no", stitched_ring(F.col("curves")).alias("ring"))
    shapes = rings.groupBy("source_name", "surface_id").agg(F.array_sort(F.collect_list(F.struct("ring_no", "ring"))).alias("rings"))
    outer = F.try_element_at(F.filter("rings", lambda r: r["ring_no"] == 0), F.lit(1))["ring"]
    holes = F.transform(F.filter("rings", lambda r: (r["ring_no"] > 0) & r["ring"].isNotNull()), lambda r: r["ring"])
    return shapes.select("source_name", "surface_id", F.when(outer.isNotNull(), F.concat(F.array(outer), holes)).alias("geom"))


def parcels(parsed: DataFrame, swap_xy: bool = True) -> DataFrame:
    """(source_name, fude_id, the codes and names, shape_ref, geom, area_sqm): a row a parcel, of rows of one id the first. A parcel
    without a polygon stays, with null geometry and area 0."""
    rows = parsed.where("kind = 'parcel'").groupBy("source_name", F.col("id").alias("fude_id")).agg(F.min_by(F.struct("ref", "fields"), "doc_seq").alias("p"))
    fields = ("oaza_code", "oaza_name", "chome_code", "koaza_code", "yobi_code", "chiban", "coord_type")
    rows = rows.select("source_name", "fude_id", *[F.col("p.fields")[f].alias(f) for f in fields], F.col("p.ref").alias("shape_ref"))
    shapes = surface_polygons(parsed, swap_xy).withColumnRenamed("surface_id", "shape_ref")
    return rows.join(shapes, ["source_name", "shape_ref"], "left").withColumn("area_sqm", F.coalesce(polygon_area(F.col("geom")), F.lit(0.0)))


def headers(parsed: DataFrame) -> DataFrame:
    """(source_name, map_name, ..., scale_denominator): one row a file that could be parsed, with the numbers of its elements: distinct points
    and curves, and parcel elements, repeated ones included."""
    names = ("map_name", "municipality_code", "municipality_name", "crs_type", "geodetic_type", "transform_program", "transform_version", "param_version")
    heads = parsed.where("kind = 'header'").select("source_name", *[F.col("fields")[n].alias(n) for n in names], F.col("fields")["scale_denominator"].cast("int").alias("scale_denominator"))
    return heads.join(element_counts(parsed), "source_name")


def element_counts(parsed: DataFrame) -> DataFrame:
    """(source_name, point_count, curve_count, fude_count) of each file that could be parsed. Distinct ids are counted over pre-aggregated rows."""
    once = parsed.where("kind IN ('header', 'point', 'curve', 'parcel')").groupBy("source_name", "kind", "id").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("source_name").agg(
        F.count_if(F.col("kind") == "point").alias("point_count"), F.count_if(F.col("kind") == "curve").alias("curve_count"), F.coalesce(F.sum(F.when(F.col("kind") == "parcel", F.col("n"))), F.lit(0)).alias("fude_count")
    )


def boundary_points(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'boundary_point'").select("source_name", "doc_seq", F.col("fields")["point_name"].alias("point_name"), F.col("ref").alias("shape_ref"))


def boundary_lines(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind = 'boundary_line'").select("source_name", "doc_seq", F.col("ref").alias("shape_ref"), F.col("fields")["line_type"].alias("line_type"))


def file_status(parsed: DataFrame) -> DataFrame:
    """(source_name, failed, error, parcels) of each file: what an import reports."""
    return parsed.groupBy("source_name").agg(
        (F.count_if(F.col("kind") == "error") > 0).alias("failed"), F.max(F.when(F.col("kind") == "error", F.col("fields")["error"])).alias("error"), F.count_if(F.col("kind") == "parcel").alias("parcels")
    )


# Convex hulls


def hull_points(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (n, 2), counter-clockwise from the lowest x; by a chain over the points in order of x and y."""
    order = np.unique(xy, axis=0)
    if len(order) < 3:
        return order
    halves, rows = [], order.tolist()
    for part in (rows, rows[::-1]):
        chain: list[list[float]] = []
        for p in part:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        halves += chain[:-1]
    return np.array(halves)


#: Points of a key in a batch that are not cut down, since they are few.
FEW = 16


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Corners of the points of each key in a batch: those of the whole are among them. Keys with few points in it keep them all."""
    for batch in batches:
        codes, _ = pd.factorize(batch["key"])
        order = np.argsort(codes, kind="stable")
        xy, sizes = batch[["x", "y"]].to_numpy()[order], np.bincount(codes)
        parts, counts = [], []
        for end, size in zip(np.cumsum(sizes), sizes, strict=True):
            parts.append(xy[end - size : end] if size <= FEW else hull_points(xy[end - size : end]))
            counts.append(len(parts[-1]))
        if parts:
            first = order[np.repeat(np.cumsum(sizes) - sizes, counts)]
            corners = np.concatenate(parts)
            yield pd.DataFrame({"key": batch["key"].to_numpy()[first], "x": corners[:, 0], "y": corners[:, 1]})


def _final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The closed ring of the hull of each row's points."""
    for batch in batches:
        rings = [hull_points(np.column_stack([x, y])) for x, y in zip(batch["x"], batch["y"], strict=True)]
        rings = [np.append(r, r[:1], axis=0) for r in rings]
        yield pd.DataFrame({"key": batch["key"], "x": [r[:, 0] for r in rings], "y": [r[:, 1] for r in rings]})


def convex_hulls(coordinates: DataFrame) -> DataFrame:
    """(key, geom): the convex hull of the points (key: string, x, y) of each key as a polygon; null for fewer than three points or points on
    one line. Points are cut down to partial hulls batch by batch before they are shuffled, so a group holds few of them where those of a key come together, or are many."""

    part = coordinates.select(F.col("key").cast("string").alias("key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("key IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    left = part.mapInPandas(_partial, "key string, x double, y double").groupBy("key").agg(F.collect_list(F.struct("x", "y")).alias("p"))
    hulls = left.select("key", F.transform("p", lambda p: p["x"]).alias("x"), F.transform("p", lambda p: p["y"]).alias("y")).mapInPandas(_final, "key string, x array<double>, y array<double>")
    ring = F.zip_with("x", "y", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return hulls.select("key", F.when(F.size("x") > 3, F.array(ring)).alias("geom"))


def map_hulls(parsed: DataFrame, swap_xy: bool = True) -> DataFrame:
    """(source_name, geom): the hull of all points and curve vertices of a file. A vertex given by a point is where that point is, which counts anyway, so that references need not be looked up. A file's
    elements come together in a task before they are cut down to partial hulls: scattered over all tasks, a batch would hold too few of each file."""
    x, y = ("y", "x") if swap_xy else ("x", "y")
    elements, tasks = _stored(parsed.where("kind <> 'vertex' OR (x IS NOT NULL AND y IS NOT NULL)"), "point", "curve", "vertex")
    at_once = lambda kinds: elements.where(F.col("kind").isin(*kinds)).select("source_name", "kind", "id", "doc_seq", "x", "y").repartition(tasks, "source_name")
    both = points(at_once(["point"])).select("source_name", "x", "y").unionByName(_last(at_once(["curve", "vertex"])).where("kind = 'vertex'").select("source_name", "x", "y"))
    keyed = both.select(F.col("source_name").alias("key"), F.col(x).alias("x"), F.col(y).alias("y")).sortWithinPartitions("key")
    return convex_hulls(keyed).withColumnRenamed("key", "source_name")
