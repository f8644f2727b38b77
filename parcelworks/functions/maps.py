"""Functions on names, scales and coordinate systems of maps."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parcelworks.functions.numbers import DIGITS, FULL_DIGITS


def normalize_municipality(name: Column) -> Column:
    """Everything through the first 郡, then through the first 県, removed; null becomes empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "^.*?郡", ""), "^.*?県", "")


def names_pair(a: Column, b: Column) -> Column:
    """Equal, or one begins with the other."""
    return a.startswith(b) | b.startswith(a)


def scale_from_name(name: Column) -> Column:
    """First digit run before 図, if 100 or more; full-width digits count."""
    digits = F.regexp_extract(F.translate(name, FULL_DIGITS, DIGITS), "([0-9]+)図", 1)
    return F.when((digits != "") & (digits.try_cast("bigint") >= 100), digits.try_cast("int"))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC, which Spark lacks. Meant for distinct names."""
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def scales_of_names(names: DataFrame) -> DataFrame:
    """(map_name, scale) of the distinct map names, normalized by NFKC in full before the digits are looked for."""
    return names.select("map_name").distinct().withColumn("scale", scale_from_name(nfkc(F.col("map_name"))))


def mixing_factors(scale: Column, other: Column) -> Column:
    """(area, length): what areas and lengths are wrong by where a map of one scale counts as one of the other."""
    return F.struct(((scale / other) * (scale / other)).alias("area"), (scale / other).alias("length"))


def effective_scale(stored: Column, name: Column, override: dict[int, int] | None = None) -> Column:
    """Stored scale (0 counts as none), else the name's, else 600; then the override, if it names that scale."""
    scale = F.coalesce(F.when(stored != 0, stored), scale_from_name(name), F.lit(600))
    for old, new in (override or {}).items():
        scale = F.when(F.coalesce(F.when(stored != 0, stored), scale_from_name(name), F.lit(600)) == old, new).otherwise(scale)
    return scale.cast("int")


def estimated_area(area: Column, coord_type: Column, scale: Column) -> Column:
    """Area of a parcel on paper times (scale / 1000) squared; others as they are; null where null or 0."""
    factor = F.when(coord_type == "図上測量", (scale / 1000.0) * (scale / 1000.0)).otherwise(1.0)
    return F.when(area != 0, area * factor)


def is_arbitrary(crs: Column) -> Column:
    return ~F.contains(F.coalesce(crs, F.lit("")), F.lit("公共座標"))


def crs_short(crs: Column) -> Column:
    return F.when(F.contains(crs, F.lit("任意")), "任意").when(F.contains(crs, F.lit("公共座標")), "公共").otherwise(crs)


def crs_epsg(crs: Column) -> Column:
    """6668 + zone for zones 1 to 19, else 6676."""
    zone = F.regexp_extract(F.coalesce(crs, F.lit("")), r"([0-9]+)系", 1)
    return F.when((zone != "") & zone.try_cast("int").between(1, 19), zone.try_cast("int") + 6668).otherwise(6676)


def frame_scale(width: Column, height: Column, tolerance: float = 1.0) -> Column:
    """Scale of a map frame of 545 by 450 mm sheets; null when both sides disagree."""
    by_width, by_height = F.round(width / 0.545), F.round(height / 0.450)
    return F.when(F.abs(by_width - by_height) <= tolerance, by_width.cast("int"))
