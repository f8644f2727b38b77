"""Shapes of several parts. A shape is an array of polygons (``geom.POLYGON``) whose insides do not overlap; one without parts is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from parcelworks.functions.bind import let
from parcelworks.functions.geom import POLYGON, polygon_area, polygon_centroid

SHAPE = f"array<{POLYGON}>"


def as_shape(rows: DataFrame, column: str) -> Column:
    """A column of polygons or of shapes as shapes."""
    kind, depth = rows.schema[column].dataType, 0
    while isinstance(kind, ArrayType):
        kind, depth = kind.elementType, depth + 1
    if depth not in (2, 3):
        raise ValueError(f"{column} holds neither polygons nor shapes")
    return F.col(column) if depth == 3 else F.when(F.col(column).isNotNull(), F.array(F.col(column)))


def shape_area(shape: Column) -> Column:
    """Sum of the parts' areas without their holes; 0 for null or empty."""
    return F.coalesce(F.aggregate(F.transform(shape, polygon_area), F.lit(0.0), lambda a, b: a + b), F.lit(0.0))


def shape_centroid(shape: Column) -> Column:
    """The parts' centroids weighed by their areas; null for a shape that is null, empty or without area."""
    parts = F.filter(F.transform(shape, lambda p: F.struct(polygon_area(p).alias("a"), polygon_centroid(p).alias("c"))), lambda p: p["c"].isNotNull() & (p["a"] > 0))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    sums = F.aggregate(parts, start, lambda s, p: F.struct((s["a"] + p["a"]).alias("a"), (s["x"] + p["a"] * p["c"]["x"]).alias("x"), (s["y"] + p["a"] * p["c"]["y"]).alias("y")))
    return let({"s": sums}, lambda v: F.when(v["s"]["a"] > 0, F.struct((v["s"]["x"] / v["s"]["a"]).alias("x"), (v["s"]["y"] / v["s"]["a"]).alias("y"))))


def shape_box(shape: Column) -> Column:
    """(min_x, min_y, max_x, max_y) of all outer rings; null for a shape that is null or has no point."""

    def box(points: Column) -> Column:
        x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
        return F.when(F.size(points) > 0, F.struct(F.array_min(x).alias("min_x"), F.array_min(y).alias("min_y"), F.array_max(x).alias("max_x"), F.array_max(y).alias("max_y")))

    outer = F.filter(F.transform(shape, lambda p: F.get(p, F.lit(0))), lambda r: r.isNotNull())
    return let({"points": F.flatten(outer)}, lambda v: box(v["points"]))


def is_box(shape: Column) -> Column:
    """Whether a shape is one rectangle along the axes, without a hole: so it equals its ``shape_box``."""

    def fits(v: Column) -> Column:
        ring, box = v["ring"], v["box"]
        corners = F.forall(ring, lambda p: p["x"].isin(box["min_x"], box["max_x"]) & p["y"].isin(box["min_y"], box["max_y"]))
        full = (box["max_x"] - box["min_x"]) * (box["max_y"] - box["min_y"])
        return (F.size(ring).between(4, 5)) & corners & (full > 0) & (polygon_area(F.array(ring)) == full)

    one = (F.size(shape) == 1) & (F.size(F.get(shape, F.lit(0))) == 1)
    return F.coalesce(one & let({"ring": F.get(F.get(shape, F.lit(0)), F.lit(0)), "box": shape_box(shape)}, fits), F.lit(False))


def to_wkt(shape: Column) -> Column:
    """MULTIPOLYGON of all parts, whatever their number; null for null."""
    point = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, point), ", "), F.lit(")"))
    part = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    parts = F.array_join(F.transform(shape, part), ", ")
    return F.when(F.size(shape) > 0, F.concat(F.lit("MULTIPOLYGON("), parts, F.lit(")"))).when(shape.isNotNull(), "MULTIPOLYGON EMPTY")


def parse_wkt(text: Column) -> Column:
    """(geom, error) of a text: POLYGON or MULTIPOLYGON, in any case, of two to four numbers a point of which the first two count (Z, M, ZM), or EMPTY.
    Anything else, a number that cannot be read or is not finite, and a ring of fewer than three points give no geom but an error; null gives neither.
    Rings are taken as they are written, closed or not."""
    body = F.upper(F.trim(F.regexp_replace(text, r"\s+", " ")))
    kind = r"^(?:SRID=\d+ ?; ?)?(MULTIPOLYGON|POLYGON)(?: ?(?:ZM|Z|M))? ?(EMPTY|\(.*\))$"
    no_shape, none = F.lit(None).cast(SHAPE), F.lit(None).cast("string")
    said = lambda words: F.struct(no_shape.alias("geom"), F.lit(words).alias("error"))

    def point(text: Column) -> Column:
        numbers = F.transform(F.split(F.trim(text), " "), lambda n: n.try_cast("double"))
        good = lambda v: F.size(v["n"]).between(2, 4) & F.forall(v["n"], lambda n: n.isNotNull() & (F.abs(n) < float("inf")))
        return let({"n": numbers}, lambda v: F.when(good(v), F.struct(F.get(v["n"], F.lit(0)).alias("x"), F.get(v["n"], F.lit(1)).alias("y"))))

    ring = lambda r: F.transform(F.split(r, ","), point)
    part = lambda p: F.transform(F.split(p, r"\) ?, ?\("), ring)

    def read(v: Column) -> Column:
        inside = F.regexp_replace(F.regexp_replace(v["rest"], r"^\( ?\( ?\( ?", ""), r" ?\) ?\) ?\)$", "")
        return let({"g": F.transform(F.split(inside, r"\) ?\) ?, ?\( ?\("), part)}, judged)

    def judged(v: Column) -> Column:
        rings = F.flatten(v["g"])
        return (
            F.when(F.exists(F.flatten(rings), lambda p: p.isNull()), said("a point that cannot be read"))
            .when(F.exists(rings, lambda r: F.size(r) < 3), said("a ring of fewer than three points"))
            .otherwise(F.struct(v["g"].alias("geom"), none.alias("error")))
        )

    def known(v: Column) -> Column:
        # a polygon is a shape of one part: a third pair of brackets
        rest = F.when(v["kind"] == "POLYGON", F.concat(F.lit("("), v["rest"], F.lit(")"))).otherwise(v["rest"])
        return (
            F.when(v["kind"] == "", said("neither POLYGON nor MULTIPOLYGON"))
            .when(v["rest"] == "EMPTY", F.struct(F.array().cast(SHAPE).alias("geom"), none.alias("error")))
            .when((v["kind"] == "POLYGON") & rest.rlike(r"\) ?\) ?,"), said("a polygon of several parts"))
            .when(~rest.rlike(r"^\( ?\( ?\(.*\) ?\) ?\)$") | rest.rlike(r"[^-+0-9E.,() ]"), said("brackets or signs that do not fit"))
            .otherwise(let({"rest": rest}, read))
        )

    named = {"kind": F.regexp_extract(body, kind, 1), "rest": F.regexp_extract(body, kind, 2)}
    return F.when(text.isNotNull(), let(named, known)).otherwise(F.struct(no_shape.alias("geom"), none.alias("error")))
