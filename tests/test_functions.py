import math

import pytest
from pyspark.sql import functions as F

from parcelworks.functions import geom, maps, numbers


def one(spark, column, **values):
    types = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], types).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,parent,branch",
    [("3558X(4/4)", "3558", ""), ("3558-1X(4/4)", "3558", "1"), ("247-3W1", "247", "3"), ("1084-1-内", "1084", "1"), ("170-内W1", "170", ""), (None, "", ""), ("", "", ""), ("道", "道", "")],
)
def test_parse_number(spark, text, parent, branch):
    assert one(spark, numbers.parent_of(F.col("s")), s=text) == parent
    assert one(spark, numbers.branch_of(F.col("s")), s=text) == branch


@pytest.mark.parametrize(
    "a,b,c,d,level",
    [("1906", "3", "1906", "3", "exact"), ("1906", "3", "1906", "", "parent"), ("1906", "", "1907", "", "near"), ("99", "", "100", "", None), ("道", "", "水", "", "near"), ("12", "3", "12-3", "", "exact")],
)
def test_match_level(spark, a, b, c, d, level):
    assert one(spark, numbers.match_level(*[F.col(x) for x in "abcd"]), a=a, b=b, c=c, d=d) == level


@pytest.mark.parametrize("text", ["1-2", "1番2", "１－２"])
def test_normalize_number(spark, text):
    assert one(spark, numbers.normalize_number(F.col("s")), s=text) == "12"


@pytest.mark.parametrize("text,want", [("賀茂郡西伊豆町", "西伊豆町"), ("賀茂郡南伊豆町", "南伊豆町"), ("静岡県下田市", "下田市"), ("西伊豆町", "西伊豆町"), (None, "")])
def test_municipality(spark, text, want):
    assert one(spark, maps.normalize_municipality(F.col("s")), s=text) == want


@pytest.mark.parametrize("text,want", [("松崎町雲見１０００図無Ｈ２１", 1000), ("松崎町岩科南側６００図無Ｈ２１", 600), ("松崎町岩科南側－３図無Ｈ２１", None), (None, None)])
def test_scale_from_name(spark, text, want):
    assert one(spark, maps.scale_from_name(F.col("s")), s=text) == want


@pytest.mark.parametrize("text,want", [("公共座標8系", 6676), ("公共座標1系", 6669), ("公共座標19系", 6687), ("公共座標20系", 6676), ("任意座標系", 6676), (None, 6676)])
def test_epsg(spark, text, want):
    assert one(spark, maps.crs_epsg(F.col("s")), s=text) == want


@pytest.mark.parametrize("w,h,want", [(327.0, 270.0, 600), (545.0, 450.0, 1000), (654.0, 540.0, 1200), (1362.5, 1125.0, 2500), (1635.0, 1350.0, 3000), (327.0, 450.0, None)])
def test_frame_scale(spark, w, h, want):
    assert one(spark, maps.frame_scale(F.col("w"), F.col("h")), w=w, h=h) == want


@pytest.mark.parametrize("scale,factor", [(500, 0.25), (600, 0.36), (1000, 1.0), (1200, 1.44), (2500, 6.25), (3000, 9.0)])
def test_estimated_area(spark, scale, factor):
    assert math.isclose(one(spark, maps.estimated_area(F.col("a"), F.col("t"), F.col("s")), a=10.0, t="図上測量", s=scale), 10 * factor)


def test_polygon_with_hole(spark):
    wkt = "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))"
    shape = geom.from_wkt(F.col("s"))
    assert one(spark, geom.polygon_area(shape), s=wkt) == 96.0
    assert one(spark, geom.polygon_area(geom.affine(shape, F.lit(2.0), F.lit(5.0), F.lit(7.0))), s=wkt) == 384.0
    assert one(spark, geom.polygon_area(geom.from_wkt(geom.to_wkt(shape))), s=wkt) == 96.0
    c = one(spark, geom.ring_centroid(F.get(shape, F.lit(0))), s=wkt)
    assert (c.x, c.y) == (5.0, 5.0)


def test_a_parcel_of_two_districts_matches_a_lot_once(spark):
    from parcelworks.operators import match

    parcels = spark.createDataFrame([(1, "a", "", "5-2", "x"), (1, "a", "大字1", "5-2", "x"), (1, "b", "大字1", "5-3", None)], "xml_meta_id long, fude_id string, oaza_name string, chiban string, municipality_name string")
    lots = spark.createDataFrame([(7, "大字1", "", "5-2", ""), (8, "大字1", "y", "5", "3")], "lot_id long, oaza_name string, municipality_name string, parent_no string, branch_no string")
    found = sorted(tuple(r) for r in match.number_matches(parcels, lots, ("exact",)).collect())
    assert found == [(1, "a", "5-2", 7, "exact"), (1, "b", "5-3", 8, "exact")]
    assert sorted(tuple(r) for r in match.best_lots(parcels, lots).collect()) == found


def test_a_ring_is_computed_once(spark):
    assert str(geom.ring_sums(F.col("zzz"))).count("zzz") == 1
