"""All registered queries of the cadastral part, with the SQL that gives the same rows.

Each query applies an operator of the library to tables that Spark derives from the driver's tables
(``fixtures``); the oracle is written apart from it, over the same derived tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelworks.functions import geom, maps, numbers
from parcelworks.operators import align, match, search, spatial, stats, store
from parcelworks.plans.fixtures import oracle, view
from parcelworks.sources import scratch

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

#: DuckDB expressions for what the functions compute.
_STRIP = r"regexp_replace(trim({0}), '(X[(（]\p{{Nd}}+/\p{{Nd}}+[)）]|W\p{{Nd}}+|V\p{{Nd}}+|-内)+$', '')"
_PARENT = "split_part(" + _STRIP + ", '-', 1)"
_BRANCH = "CASE WHEN contains(" + _STRIP + ", '-') THEN substr(" + _STRIP + ", strpos(" + _STRIP + ", '-') + 1) ELSE '' END"
_SCALE = "TRY_CAST(regexp_extract(translate(map_name, '０１２３４５６７８９', '0123456789'), '([0-9]+)図', 1) AS INT)"
_PARTS = "string_split_regex(chiban, '[-－ー]')"
_ARBITRARY = "NOT contains(crs_type, '公共座標')"


def query(name: str, tables: str, sql: str | None):
    """Registers a function of the named tables as a query."""

    def register(f):
        _QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, t) for t in tables.split()])
        if sql is not None:
            _ORACLES[name] = oracle(tables, sql)
        return f

    return register


def file_query(name: str, sql: str):
    """Registers a function of (spark, sf_dir) that reads map files made of ``sheet``, which ``sql`` reads, too."""

    def register(f):
        _QUERIES[name] = f
        _ORACLES[name] = oracle("sheet", sql)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


# Scalar functions


@query("f1_normalize_number", "parcel", "SELECT DISTINCT chiban, lower(translate(chiban, '０１２３４５６７８９番号の-－ー', '0123456789')) AS normal FROM parcel")
def _(parcel):
    return parcel.select("chiban", numbers.normalize_number(F.col("chiban")).alias("normal")).distinct()


@query(
    "f2_natural_key",
    "parcel",
    rf"""SELECT DISTINCT chiban, array_to_string(list_transform({_PARTS}, lambda p: CASE WHEN regexp_extract(p, '^[0-9]+') <> ''
      THEN '0:' || regexp_extract(p, '^[0-9]+')::BIGINT || ':' || regexp_replace(p, '^[0-9]+', '') ELSE '1:0:' || p END), '|') AS natural_key FROM parcel""",
)
def _(parcel):
    text = F.array_join(F.transform(numbers.natural_key(F.col("chiban")), lambda k: F.concat_ws(":", k["c"].cast("string"), k["n"]["digits"], k["r"])), "|")
    return parcel.select("chiban", text.alias("natural_key")).distinct()


@query("f3_parse_number", "parcel", f"SELECT DISTINCT chiban, {_PARENT.format('chiban')} AS parent, {_BRANCH.format('chiban')} AS branch FROM parcel")
def _(parcel):
    return parcel.select("chiban", numbers.parent_of(F.col("chiban")).alias("parent"), numbers.branch_of(F.col("chiban")).alias("branch")).distinct()


@query("f5_municipality", "meta", "SELECT id, regexp_replace(regexp_replace(municipality_name, '^.*?郡', ''), '^.*?県', '') AS normal FROM meta")
def _(meta):
    return meta.select("id", maps.normalize_municipality(F.col("municipality_name")).alias("normal"))


@query("f6_scale_from_name", "meta", f"SELECT id, CASE WHEN {_SCALE} >= 100 THEN {_SCALE} END AS scale FROM meta")
def _(meta):
    return meta.select("id", maps.scale_from_name(F.col("map_name")).alias("scale"))


@query("f7_effective_scale", "meta", f"SELECT id, coalesce(nullif(scale_denominator, 0), CASE WHEN {_SCALE} >= 100 THEN {_SCALE} END, 600) AS scale FROM meta")
def _(meta):
    return meta.select("id", maps.effective_scale(F.col("scale_denominator"), F.col("map_name")).alias("scale"))


@query(
    "f8_estimated_area",
    "meta parcel",
    f"""SELECT xml_meta_id, fude_id, nullif(w * h, 0) * CASE WHEN coord_type = '図上測量' THEN (scale / 1000.0::DOUBLE) * (scale / 1000.0::DOUBLE) ELSE 1 END AS est_area
      FROM parcel JOIN (SELECT id, coalesce(nullif(scale_denominator, 0), CASE WHEN {_SCALE} >= 100 THEN {_SCALE} END, 600)::DOUBLE AS scale FROM meta) ON id = xml_meta_id""",
)
def _(meta, parcel):
    scales = meta.select(F.col("id").alias("xml_meta_id"), maps.effective_scale(F.col("scale_denominator"), F.col("map_name")).alias("scale"))
    area = maps.estimated_area(F.col("w") * F.col("h"), F.col("coord_type"), F.col("scale"))
    return parcel.join(scales, "xml_meta_id").select("xml_meta_id", "fude_id", area.alias("est_area"))


@query(
    "f9_epsg",
    "meta",
    """SELECT id, CASE WHEN TRY_CAST(regexp_extract(crs_type, '([0-9]+)系', 1) AS INT) BETWEEN 1 AND 19
      THEN 6668 + regexp_extract(crs_type, '([0-9]+)系', 1)::INT ELSE 6676 END AS epsg FROM meta""",
)
def _(meta):
    return meta.select("id", maps.crs_epsg(F.col("crs_type")).alias("epsg"))


@query("f10_content_hash", "xml_file", "SELECT doc_id, sha256(content) AS xml_sha256 FROM xml_file")
def _(xml_file):
    return xml_file.select("doc_id", F.sha2(F.col("content").cast("binary"), 256).alias("xml_sha256"))


@query(
    "f12_number_class",
    "parcel",
    r"""SELECT number_class, count(*) AS n FROM (SELECT CASE chiban WHEN '道' THEN 'road' WHEN '水' THEN 'water' WHEN '筆界未定地' THEN 'undetermined'
      WHEN '無地番' THEN 'unnumbered' WHEN '地図外' THEN 'off-map' ELSE CASE WHEN regexp_matches(chiban, '^\p{Nd}') THEN 'numeric' ELSE 'other' END END AS number_class FROM parcel) GROUP BY 1""",
)
def _(parcel):
    return parcel.groupBy(numbers.number_class(F.col("chiban")).alias("number_class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f14_frame_scale",
    "frame",
    """SELECT xml_meta_id, CASE WHEN abs(round((ur_x - ll_x) / 0.545) - round((ur_y - ll_y) / 0.450)) <= 1 THEN round((ur_x - ll_x) / 0.545)::INT END AS scale FROM frame""",
)
def _(frame):
    return frame.select("xml_meta_id", maps.frame_scale(F.col("ur_x") - F.col("ll_x"), F.col("ur_y") - F.col("ll_y")).alias("scale"))


# Geometry


@query("g2_area", "parcel", "SELECT xml_meta_id, fude_id, x0, round(w * h, 4) AS area FROM parcel")
def _(parcel):
    box = geom.rectangle(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))
    return parcel.select("xml_meta_id", "fude_id", "x0", F.round(geom.polygon_area(box), 4).alias("area"))


@query("g4_centroid", "parcel", "SELECT xml_meta_id, fude_id, round(x0 + w / 2, 4) AS cx, round(y0 + h / 2, 4) AS cy FROM parcel")
def _(parcel):
    box = geom.rectangle(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"))
    centre = parcel.select("xml_meta_id", "fude_id", geom.ring_centroid(F.get(box, F.lit(0))).alias("c"))
    return centre.select("xml_meta_id", "fude_id", F.round("c.x", 4).alias("cx"), F.round("c.y", 4).alias("cy"))


@query(
    "g6_georeference",
    "meta parcel",
    """SELECT xml_meta_id, round(min(s * x0 + 100 - s * mx), 3) AS min_x, round(max(s * (y0 + h) + 200 - s * my), 3) AS max_y FROM parcel
      JOIN (SELECT xml_meta_id AS m, avg(x0 + w / 2) AS mx, avg(y0 + h / 2) AS my FROM parcel GROUP BY 1) ON m = xml_meta_id
      JOIN (SELECT id, CASE WHEN NOT contains(crs_type, '公共座標') THEN coalesce(scale_denominator, 600) / 1000.0 ELSE 1.0 END::DOUBLE AS s FROM meta) ON id = xml_meta_id GROUP BY xml_meta_id""",
)
def _(meta, parcel):
    s = F.when(maps.is_arbitrary(F.col("crs_type")), F.coalesce("scale_denominator", F.lit(600)) / 1000.0).otherwise(1.0)
    moves = align.mean_centres(parcel).join(meta.select(F.col("id").alias("xml_meta_id"), s.alias("scale")), "xml_meta_id")
    moves = moves.select("xml_meta_id", "scale", (100 - F.col("scale") * F.col("cx")).alias("dx"), (200 - F.col("scale") * F.col("cy")).alias("dy"))
    shapes = parcel.select("xml_meta_id", geom.rectangle(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")).alias("geom"))
    ring = F.get(F.col("geom"), F.lit(0))
    moved = align.shift(shapes, moves).select("xml_meta_id", F.array_min(F.transform(ring, lambda p: p["x"])).alias("x"), F.array_max(F.transform(ring, lambda p: p["y"])).alias("y"))
    return moved.groupBy("xml_meta_id").agg(F.round(F.min("x"), 3).alias("min_x"), F.round(F.max("y"), 3).alias("max_y"))


@query("a11_bounds", "parcel", "SELECT xml_meta_id, min(x0) AS min_x, min(y0) AS min_y, max(x0 + w) AS max_x, max(y0 + h) AS max_y FROM parcel GROUP BY 1")
def _(parcel):
    return align.map_bounds(parcel)


@query(
    "a13_centres",
    "parcel",
    "SELECT xml_meta_id, round(sum(w * h * (x0 + w / 2)) / sum(w * h), 4) AS cx, round(sum(w * h * (y0 + h / 2)) / sum(w * h), 4) AS cy FROM parcel GROUP BY 1",
)
def _(parcel):
    shapes = parcel.select("xml_meta_id", (F.col("w") * F.col("h")).alias("area"), (F.col("x0") + F.col("w") / 2).alias("cx"), (F.col("y0") + F.col("h") / 2).alias("cy"))
    return align.weighted_centres(shapes, "xml_meta_id").select("xml_meta_id", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"))


@query("a14_mean_centres", "parcel", "SELECT xml_meta_id, round(avg(x0 + w / 2), 4) AS cx, round(avg(y0 + h / 2), 4) AS cy FROM parcel GROUP BY 1")
def _(parcel):
    return align.mean_centres(parcel).select("xml_meta_id", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"))


_DOMINANT = """dominant AS (SELECT xml_meta_id, oaza_name FROM (SELECT xml_meta_id, oaza_name, row_number() OVER (PARTITION BY xml_meta_id ORDER BY count(*) DESC, oaza_name) AS k
  FROM parcel WHERE oaza_name <> '' GROUP BY 1, 2) WHERE k = 1)"""


@query(
    "g8_auto_position",
    "meta parcel admin",
    f""", {_DOMINANT},
    centre AS (SELECT xml_meta_id, sum(w * h * (x0 + w / 2)) / sum(w * h) AS cx, sum(w * h * (y0 + h / 2)) / sum(w * h) AS cy FROM parcel GROUP BY 1),
    district AS (SELECT trim(name) AS name, sum(a * (min_x + max_x) / 2) / sum(a) AS cx, sum(a * (min_y + max_y) / 2) / sum(a) AS cy FROM (SELECT *, (max_x - min_x) * (max_y - min_y) AS a FROM admin) GROUP BY 1)
    SELECT centre.xml_meta_id, round(district.cx - centre.cx, 4) AS dx, round(district.cy - centre.cy, 4) AS dy FROM centre JOIN meta ON id = centre.xml_meta_id AND {_ARBITRARY}
    JOIN dominant ON dominant.xml_meta_id = centre.xml_meta_id JOIN district ON district.name = oaza_name""",
)
def _(meta, parcel, admin):
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    shapes = admin.select(F.trim("name").alias("name"), area.alias("area"), ((F.col("min_x") + F.col("max_x")) / 2).alias("cx"), ((F.col("min_y") + F.col("max_y")) / 2).alias("cy"))
    return align.auto_positions(meta, parcel, align.weighted_centres(shapes, "name")).select("xml_meta_id", F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"))


# Reads, filters, updates


@query("p1_maps_by_crs", "meta", "SELECT id, file_name FROM meta WHERE crs_type = '任意座標系' ORDER BY file_name")
def _(meta):
    return meta.where("crs_type = '任意座標系'").select("id", "file_name").orderBy("file_name")


@query("p2_parcels_of_map", "parcel", "SELECT fude_id, chiban FROM parcel WHERE xml_meta_id = 7")
def _(parcel):
    return parcel.where("xml_meta_id = 7").select("fude_id", "chiban")


@query("p3_search_parcels", "meta parcel", "SELECT xml_meta_id, fude_id, chiban, file_name, crs_type FROM parcel JOIN meta ON id = xml_meta_id WHERE contains(lower(chiban), 'w1')")
def _(meta, parcel):
    return store.search_parcels(parcel, meta, "W1").select("xml_meta_id", "fude_id", "chiban", "file_name", "crs_type")


@query(
    "p5_crs_class",
    "meta",
    f"SELECT id, {_ARBITRARY} AS arbitrary, CASE WHEN contains(crs_type, '任意') THEN '任意' WHEN contains(crs_type, '公共座標') THEN '公共' ELSE crs_type END AS crs FROM meta",
)
def _(meta):
    return meta.select("id", maps.is_arbitrary(F.col("crs_type")).alias("arbitrary"), maps.crs_short(F.col("crs_type")).alias("crs"))


@query("p7_not_off_map", "meta parcel", "SELECT id FROM meta WHERE id NOT IN (SELECT xml_meta_id FROM parcel GROUP BY 1 HAVING bool_and(chiban = '道'))")
def _(meta, parcel):
    return stats.off_map_only(meta, parcel, "道").select("id")


@query(
    "p8_numbers_exist",
    "parcel lot",
    "SELECT DISTINCT parent_no AS chiban, oaza_name FROM lot WHERE EXISTS (SELECT 1 FROM parcel WHERE parcel.chiban = lot.parent_no AND parcel.oaza_name = lot.oaza_name)",
)
def _(parcel, lot):
    return store.exists_queries(parcel, lot.select(F.col("parent_no").alias("chiban"), "oaza_name").distinct())


@query("p8_districts_exist", "parcel lot", "SELECT DISTINCT oaza_name FROM lot WHERE oaza_name IN (SELECT oaza_name FROM parcel)")
def _(parcel, lot):
    return store.exists_queries(parcel, lot.select("oaza_name").distinct(), ["oaza_name"])


@query("p8_numbers_anywhere", "parcel lot", "SELECT DISTINCT parent_no AS chiban FROM lot WHERE parent_no IN (SELECT chiban FROM parcel)")
def _(parcel, lot):
    return store.exists_queries(parcel, lot.select(F.col("parent_no").alias("chiban")).distinct(), ["chiban"])


@query(
    "p10_update_crs",
    "meta lot",
    """SELECT id, coalesce(new_crs, crs_type) AS crs_type FROM meta LEFT JOIN (SELECT lot_id, CASE WHEN lot_id % 3 = 0 THEN '公共座標8系' END AS new_crs FROM lot) ON lot_id = id""",
)
def _(meta, lot):
    changes = lot.select(F.col("lot_id").alias("id"), F.when(F.col("lot_id") % 3 == 0, "公共座標8系").alias("crs_type"))
    return store.update_by_id(meta.select("id", "crs_type"), changes, ["id"], ["crs_type"])


@query(
    "p11_srid",
    "meta parcel",
    "SELECT (SELECT count(*) FROM meta WHERE crs_type = '公共座標8系') AS maps, (SELECT count(*) FROM parcel JOIN meta ON id = xml_meta_id WHERE crs_type = '公共座標8系') AS parcels",
)
def _(meta, parcel):
    chosen = meta.where("crs_type = '公共座標8系'")
    counts = chosen.agg(F.lit("maps").alias("k"), F.count(F.lit(1)).alias("n")).union(store.with_map(parcel, chosen).agg(F.lit("parcels").alias("k"), F.count(F.lit(1)).alias("n")))
    return counts.agg(F.max(F.when(F.col("k") == "maps", F.col("n"))).alias("maps"), F.max(F.when(F.col("k") == "parcels", F.col("n"))).alias("parcels"))


@query("p12_oaza_area", "admin", "SELECT name, min(admin_id) AS admin_id, arg_min(min_x, admin_id) AS min_x FROM admin GROUP BY name")
def _(admin):
    return admin.groupBy("name").agg(F.min("admin_id").alias("admin_id"), F.min_by("min_x", "admin_id").alias("min_x"))


# Joins


@query(
    "j1_not_yet_known",
    "xml_file",
    """, f AS (SELECT doc_id, source_name, sha256(content) AS h, regexp_extract(source_name, '([^/]*)$', 1) AS base FROM xml_file), k AS (SELECT * FROM f WHERE doc_id % 3 = 0)
    SELECT doc_id FROM f WHERE h NOT IN (SELECT h FROM k) AND source_name NOT IN (SELECT source_name FROM k) AND base NOT IN (SELECT source_name FROM k)""",
)
def _(xml_file):
    files = xml_file.select("doc_id", "source_name", F.sha2(F.col("content").cast("binary"), 256).alias("xml_sha256"))
    return store.not_yet_known(files, files.where("doc_id % 3 = 0")).select("doc_id")


@query("j2_parcel_map", "meta parcel", "SELECT file_name, count(*) AS n, round(sum(w), 2) AS width FROM parcel JOIN meta ON id = xml_meta_id GROUP BY 1")
def _(meta, parcel):
    return store.with_map(parcel, meta, "file_name").groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 2).alias("width"))


_PAIRS = """pair AS (SELECT a, b FROM (SELECT DISTINCT oaza_name AS a FROM parcel WHERE oaza_name <> ''), (SELECT DISTINCT oaza_name AS b FROM lot WHERE oaza_name <> '')
  WHERE starts_with(a, b) OR starts_with(b, a))"""


@query("j6_oaza_pairs", "parcel lot", f", {_PAIRS} SELECT a, b FROM pair")
def _(parcel, lot):
    return match.oaza_pairs(parcel, lot)


_MATCH = f""", {_PAIRS},
  p AS (SELECT xml_meta_id, fude_id, chiban, oaza_name, municipality_name, {_PARENT.format("chiban")} AS pp, {_BRANCH.format("chiban")} AS pb FROM parcel JOIN meta ON id = xml_meta_id),
  pj AS (SELECT *, CASE WHEN pb <> '' THEN pp || '-' || pb ELSE pp END AS pj FROM p WHERE pp <> ''),
  paired AS (SELECT a, b FROM pair UNION SELECT '', oaza_name FROM lot),
  matched AS (SELECT DISTINCT xml_meta_id, fude_id, chiban, lot_id, CASE WHEN pj = qj THEN 'exact' WHEN pp = parent_no THEN 'parent' ELSE 'near' END AS level
    FROM pj JOIN paired ON pj.oaza_name = a JOIN (SELECT *, CASE WHEN branch_no <> '' THEN parent_no || '-' || branch_no ELSE parent_no END AS qj FROM lot) l ON l.oaza_name = b
    WHERE (pj = qj OR pp = parent_no OR (length(pp) = length(parent_no) AND length(pp) > 0 AND substr(pp, 1, length(pp) - 1) = substr(parent_no, 1, length(pp) - 1)))
      AND (l.municipality_name = '' OR pj.municipality_name = '' OR contains(pj.municipality_name, l.municipality_name)))"""


def _matches(meta, parcel, lot) -> DataFrame:
    return match.number_matches(store.with_map(parcel, meta, "municipality_name"), lot)


@query("j7_number_match", "meta parcel lot", _MATCH + " SELECT xml_meta_id, fude_id, chiban, lot_id, level FROM matched")
def _(meta, parcel, lot):
    return _matches(meta, parcel, lot)


@query(
    "w1_best_match",
    "meta parcel lot",
    _MATCH
    + """ SELECT xml_meta_id, fude_id, chiban, lot_id, level FROM (SELECT *, row_number() OVER (PARTITION BY xml_meta_id, fude_id, chiban
      ORDER BY CASE level WHEN 'exact' THEN 0 WHEN 'parent' THEN 1 ELSE 2 END, lot_id) AS k FROM matched) WHERE k = 1""",
)
def _(meta, parcel, lot):
    return match.best_lots(store.with_map(parcel, meta, "municipality_name"), lot)


@query(
    "p6_municipality_filter",
    "meta lot",
    """SELECT municipality_name, (SELECT count(*) FROM lot WHERE lot.municipality_name = '' OR m.municipality_name = '' OR contains(m.municipality_name, lot.municipality_name)) AS n
      FROM (SELECT DISTINCT municipality_name FROM meta) m""",
)
def _(meta, lot):
    return match.lots_of_municipalities(meta.select("municipality_name").distinct(), lot)


def _shapes(areas: DataFrame) -> DataFrame:
    """Areas whose geometry is their rectangle."""
    return areas.withColumn("geom", geom.rectangle(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y")))


def _map_boxes(parcel: DataFrame) -> DataFrame:
    return _shapes(align.map_bounds(parcel).withColumnRenamed("xml_meta_id", "key"))


def _lot_shapes(lot: DataFrame) -> DataFrame:
    """Lots whose geometry is the square of ten round their centre."""
    x, y = F.col("cx"), F.col("cy")
    return lot.withColumn("geom", geom.rectangle(x - 5, y - 5, x + 5, y + 5))


def _parcel_shapes(parcel: DataFrame) -> DataFrame:
    x, y = F.col("x0"), F.col("y0")
    return parcel.withColumn("geom", geom.rectangle(x, y, x + F.col("w"), y + F.col("h")))


_BOXES = "(SELECT xml_meta_id, min(x0) AS x0, min(y0) AS y0, max(x0 + w) AS x1, max(y0 + h) AS y1 FROM parcel GROUP BY 1)"


@query(
    "j10_largest_overlap",
    "parcel admin",
    f"""SELECT key, admin_id, round(overlap, 4) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(overlap, 6) DESC, admin_id) AS k FROM (
      SELECT xml_meta_id AS key, admin_id, (least(x1, max_x) - greatest(x0, min_x)) * (least(y1, max_y) - greatest(y0, min_y)) AS overlap FROM {_BOXES} JOIN admin
      ON least(x1, max_x) > greatest(x0, min_x) AND least(y1, max_y) > greatest(y0, min_y))) WHERE k = 1""",
)
def _(parcel, admin):
    return spatial.largest_overlap(_map_boxes(parcel), _shapes(admin)).select("key", "admin_id", F.round("overlap", 4).alias("overlap"))


@query(
    "j11_point_in_area",
    "parcel admin",
    """SELECT xml_meta_id, fude_id, x0, admin_id FROM (SELECT xml_meta_id, fude_id, x0, min(admin_id) AS admin_id FROM parcel JOIN admin
      ON x0 + w / 2 BETWEEN min_x AND max_x AND y0 + h / 2 BETWEEN min_y AND max_y GROUP BY ALL)""",
)
def _(parcel, admin):
    points = parcel.select(F.struct("xml_meta_id", "fude_id", "x0").alias("key"), (F.col("x0") + F.col("w") / 2).alias("x"), (F.col("y0") + F.col("h") / 2).alias("y"))
    return spatial.containing_area(points, _shapes(admin)).select("key.*", "admin_id")


@query("j16_maps_of_oaza", "meta parcel", "SELECT id, file_name FROM meta WHERE id IN (SELECT xml_meta_id FROM parcel WHERE oaza_name = '大字3')")
def _(meta, parcel):
    return store.maps_of_oaza(meta, parcel, "大字3").select("id", "file_name")


@query(
    "j17_parcel_frame_scale",
    "parcel frame",
    """SELECT xml_meta_id, fude_id, x0, coalesce(scale_denominator, round((ur_x - ll_x) / 0.545)::INT) AS scale FROM parcel JOIN frame USING (xml_meta_id)""",
)
def _(parcel, frame):
    scale = F.coalesce("scale_denominator", maps.frame_scale(F.col("ur_x") - F.col("ll_x"), F.col("ur_y") - F.col("ll_y")))
    return parcel.join(frame, "xml_meta_id").select("xml_meta_id", "fude_id", "x0", scale.alias("scale"))


# Aggregations


@query(
    "a1_totals",
    "meta parcel",
    """SELECT 'maps' AS kind, '' AS name, count(*) AS n FROM meta UNION ALL SELECT 'parcels', '', count(*) FROM parcel
      UNION ALL SELECT 'crs', crs_type, count(*) FROM meta GROUP BY 2 UNION ALL SELECT 'oaza', oaza_name, count(*) FROM parcel GROUP BY 2""",
)
def _(meta, parcel):
    return stats.totals(meta, parcel)


@query("a3_oaza_names", "parcel", "SELECT DISTINCT oaza_name FROM parcel WHERE oaza_name <> '' ORDER BY 1")
def _(parcel):
    return parcel.where("oaza_name <> ''").select("oaza_name").distinct().orderBy("oaza_name")


@query("a4_maps_per_oaza", "parcel", f", {_DOMINANT} SELECT oaza_name, count(*) AS maps FROM dominant GROUP BY 1")
def _(parcel):
    return stats.dominant_oaza(parcel).groupBy("oaza_name").agg(F.count(F.lit(1)).alias("maps"))


@query("a6_dominant_oaza", "parcel", f", {_DOMINANT} SELECT xml_meta_id, oaza_name FROM dominant")
def _(parcel):
    return stats.dominant_oaza(parcel)


@query(
    "a7_search_index",
    "meta parcel",
    rf""", rows AS (SELECT DISTINCT oaza_name, chiban, file_name FROM parcel JOIN meta ON id = xml_meta_id WHERE oaza_name <> ''),
    keyed AS (SELECT DISTINCT oaza_name, chiban, list_transform({_PARTS}, lambda p: CASE WHEN regexp_extract(p, '^[0-9]+') <> ''
      THEN row(0, regexp_extract(p, '^[0-9]+')::BIGINT, regexp_replace(p, '^[0-9]+', '')) ELSE row(1, 0::BIGINT, p) END) AS k FROM rows)
    SELECT oaza_name, entry_count, file_count, chibans FROM (SELECT oaza_name, count(*) AS entry_count, count(DISTINCT file_name) AS file_count FROM rows GROUP BY 1)
    JOIN (SELECT oaza_name, string_agg(chiban, ' ' ORDER BY k, chiban) AS chibans FROM keyed GROUP BY 1) USING (oaza_name)""",
)
def _(meta, parcel):
    return stats.search_index(parcel, meta).select("oaza_name", "entry_count", "file_count", F.array_join("chiban_list", " ").alias("chibans"))


@query(
    "a9_map_summary",
    "parcel",
    f"""SELECT xml_meta_id, count(*) AS n, string_agg(DISTINCT coord_type, ',' ORDER BY coord_type) AS coord_types, string_agg(DISTINCT oaza_name, ',' ORDER BY oaza_name) AS oaza_names,
      min(TRY_CAST(p AS BIGINT)) AS min_parent, max(TRY_CAST(p AS BIGINT)) AS max_parent FROM (SELECT *, {_PARENT.format("chiban")} AS p FROM parcel) GROUP BY 1""",
)
def _(parcel):
    return stats.map_summary(parcel)


@query(
    "a10_archive_names",
    "meta",
    """SELECT archive, CASE WHEN ends_with(stem, '_' || m) THEN archive ELSE stem || '_' || m || '.zip' END AS new_name FROM (
      SELECT split_part(file_name, '/', 1) AS archive, regexp_replace(split_part(file_name, '/', 1), '\\.zip$', '') AS stem, min(municipality_name) AS m
      FROM meta WHERE municipality_name <> '' GROUP BY 1, 2 HAVING count(DISTINCT municipality_name) = 1)""".replace("\\\\", "\\"),
)
def _(meta):
    return stats.archive_municipality(meta)


@query("a15_crs_table", "meta", f"SELECT municipality_name, count(*) FILTER ({_ARBITRARY}) AS arbitrary, count(*) FILTER (NOT ({_ARBITRARY})) AS public FROM meta GROUP BY 1")
def _(meta):
    return stats.crs_table(meta)


@query(
    "a16_shared_numbers",
    "meta parcel",
    rf"""SELECT oaza_name, CASE chiban WHEN '道' THEN 'road' WHEN '水' THEN 'water' WHEN '筆界未定地' THEN 'undetermined' ELSE CASE WHEN regexp_matches(chiban, '^\p{{Nd}}') THEN 'numeric' ELSE 'other' END END AS number_class,
      count(*) AS n FROM (SELECT oaza_name, chiban FROM parcel JOIN meta ON id = xml_meta_id WHERE oaza_name <> '' GROUP BY 1, 2 HAVING bool_or({_ARBITRARY}) AND bool_or(NOT ({_ARBITRARY}))) GROUP BY 1, 2""",
)
def _(meta, parcel):
    return stats.shared_numbers(parcel, meta)


@query(
    "a17_mixed_scales",
    "meta parcel",
    """SELECT oaza_name, string_agg(scale_denominator::VARCHAR, ',' ORDER BY scale_denominator) AS scales FROM (SELECT DISTINCT oaza_name, scale_denominator
      FROM parcel JOIN meta ON id = xml_meta_id WHERE oaza_name <> '' AND scale_denominator IS NOT NULL) GROUP BY 1 HAVING count(*) > 1""",
)
def _(meta, parcel):
    return stats.mixed_scales(parcel, meta)


@query(
    "a18_scale_coverage",
    "meta",
    f"""SELECT count(scale_denominator) AS explicit, count(*) FILTER (scale_denominator IS NULL AND {_SCALE} >= 100) AS inferred,
      count(*) FILTER (scale_denominator IS NULL AND NOT coalesce({_SCALE} >= 100, false)) AS none, count(*) AS total FROM meta WHERE {_ARBITRARY}""",
)
def _(meta):
    return stats.scale_coverage(meta)


# Windows, searches, sets


@query(
    "w2_first_wins",
    "parcel",
    """SELECT xml_meta_id, fude_id, chiban, x0 FROM (SELECT *, row_number() OVER (PARTITION BY xml_meta_id, fude_id ORDER BY chiban NULLS FIRST, x0 NULLS FIRST, y0 NULLS FIRST) AS k FROM parcel) WHERE k = 1""",
)
def _(parcel):
    return match.first_wins(parcel, ["xml_meta_id", "fude_id"], ["chiban", "x0", "y0"]).select("xml_meta_id", "fude_id", "chiban", "x0")


@query(
    "w3_export_names",
    "parcel",
    rf""", p AS (SELECT xml_meta_id, oaza_name, chiban, {_PARENT.format("chiban")} AS pp, {_BRANCH.format("chiban")} AS pb FROM parcel),
    r AS (SELECT *, row_number() OVER (PARTITION BY xml_meta_id, oaza_name ORDER BY coalesce(TRY_CAST(pp AS BIGINT), 999999), coalesce(TRY_CAST(pb AS BIGINT), -1), chiban) AS k, count(*) OVER (PARTITION BY xml_meta_id, oaza_name) AS n FROM p)
    SELECT xml_meta_id, oaza_name, CASE WHEN n = 1 THEN oaza_name || '_' || chiban ELSE oaza_name || '_' || CASE WHEN pb <> '' THEN pp || '-' || pb ELSE pp END || '他' END AS export_name FROM r WHERE k = 1""",
)
def _(parcel):
    return match.export_names(parcel)


@query(
    "o1_search",
    "parcel",
    "SELECT xml_meta_id, fude_id, oaza_name, chiban FROM parcel WHERE contains(chiban, '12') ORDER BY oaza_name, chiban, xml_meta_id, fude_id LIMIT 50",
)
def _(parcel):
    return search.search_numbers(parcel, "12").select("xml_meta_id", "fude_id", "oaza_name", "chiban")


@query(
    "o4_first_hits",
    "parcel lot",
    """SELECT query, r.m AS xml_meta_id, r.f AS fude_id FROM (SELECT query, min(row(xml_meta_id, fude_id)::STRUCT(m BIGINT, f VARCHAR)) AS r FROM (SELECT chiban, xml_meta_id, fude_id FROM parcel)
      JOIN (SELECT DISTINCT parent_no || '-3' AS query FROM lot) ON contains(chiban, query) GROUP BY 1)""",
)
def _(parcel, lot):
    return search.first_places(parcel, lot.select(F.concat("parent_no", F.lit("-3")).alias("query")).distinct()).select("query", "xml_meta_id", "fude_id")


@query("o1_indexed_search", "parcel", "SELECT DISTINCT oaza_name, chiban, xml_meta_id, fude_id FROM parcel WHERE contains(lower(chiban), '99w')")
def _(parcel):
    path = scratch.new_folder(parcel.sparkSession, "number-index")
    search.write_number_index(parcel, path, "oaza_name", "xml_meta_id", "fude_id")
    return search.search_index(parcel.sparkSession, path, "99W").select("oaza_name", "chiban", "xml_meta_id", "fude_id").distinct()


@query(
    "o4_search_places",
    "parcel lot",
    """SELECT query, r.m AS xml_meta_id, r.f AS fude_id, r.x + r.w / 2 AS cx, r.y + r.h / 2 AS cy, r.x AS min_x, r.y AS min_y, r.x + r.w AS max_x, r.y + r.h AS max_y
      FROM (SELECT query, min(row(xml_meta_id, fude_id, x0, y0, w, h)::STRUCT(m BIGINT, f VARCHAR, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)) AS r FROM parcel
      JOIN (SELECT DISTINCT CASE WHEN branch_no <> '' THEN parent_no || '-' || branch_no ELSE parent_no END AS query FROM lot WHERE lot_id % 20 = 0) ON contains(chiban, query) GROUP BY 1)""",
)
def _(parcel, lot):
    texts = lot.where("lot_id % 20 = 0").select(numbers.joined_number(F.col("parent_no"), F.col("branch_no")).alias("query")).distinct()
    return search.first_places(parcel, texts)


@query("u2_shared_chiban", "meta parcel", f"SELECT oaza_name, chiban FROM parcel JOIN meta ON id = xml_meta_id WHERE {_ARBITRARY} INTERSECT SELECT oaza_name, chiban FROM parcel JOIN meta ON id = xml_meta_id WHERE NOT ({_ARBITRARY})")
def _(meta, parcel):
    rows = store.with_map(parcel, meta, "crs_type")
    pick = lambda c: rows.where(c).select("oaza_name", "chiban")
    return pick(maps.is_arbitrary(F.col("crs_type"))).intersect(pick(~maps.is_arbitrary(F.col("crs_type"))))


_PARCEL_KEYS = _MATCH + """,
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY xml_meta_id, fude_id, chiban ORDER BY CASE level WHEN 'exact' THEN 0 WHEN 'parent' THEN 1 ELSE 2 END, lot_id) AS k FROM matched) WHERE k = 1),
  chosen AS (SELECT DISTINCT b.xml_meta_id, b.lot_id, b.level AS how, l.parent_no AS qp, CASE WHEN l.branch_no <> '' THEN l.parent_no || '-' || l.branch_no ELSE l.parent_no END AS qj FROM best b JOIN lot l ON l.lot_id = b.lot_id WHERE b.level <> 'near'),
  mutual AS (SELECT v.xml_meta_id, v.lot_id, r.fude_id, r.chiban, CASE WHEN how = 'parent' THEN 'parent' WHEN r.pj = v.qj THEN 'exact' ELSE 'parent' END AS level
    FROM chosen v JOIN pj r ON r.xml_meta_id = v.xml_meta_id AND (r.pj = v.qj OR (how = 'exact' AND r.pp = v.qp)))"""


@query("j8_mutual_match", "meta parcel lot", _PARCEL_KEYS + " SELECT DISTINCT xml_meta_id, lot_id, fude_id, chiban, level FROM mutual")
def _(meta, parcel, lot):
    return match.mutual_matches(match.best_lots(store.with_map(parcel, meta, "municipality_name"), lot), parcel, lot)


@query(
    "j12_district_differs",
    "parcel admin",
    f""", {_DOMINANT}, hit AS (SELECT key, name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(overlap, 6) DESC, admin_id) AS k FROM (
      SELECT xml_meta_id AS key, admin_id, name, (least(x1, max_x) - greatest(x0, min_x)) * (least(y1, max_y) - greatest(y0, min_y)) AS overlap FROM {_BOXES} JOIN admin
      ON least(x1, max_x) > greatest(x0, min_x) AND least(y1, max_y) > greatest(y0, min_y))) WHERE k = 1)
    SELECT xml_meta_id, oaza_name, name FROM dominant JOIN hit ON key = xml_meta_id WHERE name <> oaza_name""",
)
def _(parcel, admin):
    hit = spatial.largest_overlap(_map_boxes(parcel), _shapes(admin)).join(admin.select("admin_id", "name"), "admin_id").select(F.col("key").alias("xml_meta_id"), "name")
    return stats.dominant_oaza(parcel).join(hit, "xml_meta_id").where("name <> oaza_name").select("xml_meta_id", "oaza_name", "name")


@query(
    "j13_lots_in_oaza",
    "lot admin",
    """SELECT lot_id FROM lot WHERE EXISTS (SELECT 1 FROM admin WHERE (starts_with(name, '大字3') OR starts_with('大字3', name))
      AND cx + 5 >= min_x AND cx - 5 <= max_x AND cy + 5 >= min_y AND cy - 5 <= max_y)""",
)
def _(lot, admin):
    areas = admin.where(maps.names_pair(F.col("name"), F.lit("大字3")))
    return spatial.meeting(_lot_shapes(lot).withColumnRenamed("lot_id", "key"), _shapes(areas)).select(F.col("key").alias("lot_id"))


@query(
    "j15_municipality_match",
    "meta lot",
    r""", n AS (SELECT DISTINCT municipality_name AS name, regexp_replace(regexp_replace(municipality_name, '^.*?郡', ''), '^.*?県', '') AS key FROM meta),
    r AS (SELECT municipality_name AS ref, min(lot_id) AS ord FROM lot GROUP BY 1)
    SELECT name, ref FROM (SELECT name, ref, row_number() OVER (PARTITION BY name ORDER BY name <> ref, ord) AS k FROM n JOIN r ON name = ref OR key = ref OR ends_with(key, ref) OR ends_with(ref, key)) WHERE k = 1""",
)
def _(meta, lot):
    return match.municipality_matches(meta.select(F.col("municipality_name").alias("name")).distinct(), lot.groupBy(F.col("municipality_name").alias("ref")).agg(F.min("lot_id").alias("ord")))


@query(
    "o2_suggestions",
    "parcel",
    rf"""SELECT chiban, oaza_name FROM (SELECT chiban, min(oaza_name) AS oaza_name FROM parcel WHERE starts_with(chiban, '1') AND oaza_name <> '' GROUP BY 1)
      ORDER BY oaza_name, list_transform({_PARTS}, lambda p: CASE WHEN regexp_extract(p, '^[0-9]+') <> '' THEN row(0, regexp_extract(p, '^[0-9]+')::BIGINT, regexp_replace(p, '^[0-9]+', ''))
      ELSE row(1, 0::BIGINT, p) END), chiban LIMIT 10""",
)
def _(parcel):
    return search.suggestions(parcel, "1")


@query("o2_prefix_table", "parcel", rf"""SELECT prefix, rank::INT AS rank, oaza_name, chiban FROM (SELECT prefix, oaza_name, chiban, row_number() OVER (PARTITION BY prefix ORDER BY oaza_name, list_transform({_PARTS}, lambda p: CASE WHEN regexp_extract(p, '^[0-9]+') <> ''
      THEN row(0, regexp_extract(p, '^[0-9]+')::BIGINT, regexp_replace(p, '^[0-9]+', '')) ELSE row(1, 0::BIGINT, p) END), chiban) AS rank FROM (SELECT chiban, oaza_name, unnest(list_transform(range(0, length(chiban) + 1), lambda n: left(chiban, n))) AS prefix
      FROM (SELECT chiban, min(oaza_name) AS oaza_name FROM parcel WHERE oaza_name <> '' GROUP BY 1))) WHERE rank <= 10""")
def _(parcel):
    return search.prefix_table(parcel)


@query("o3_natural_order", "parcel", rf"""SELECT chiban, row_number() OVER (ORDER BY list_transform({_PARTS}, lambda p: CASE WHEN regexp_extract(p, '^[0-9]+') <> '' THEN row(0, regexp_extract(p, '^[0-9]+')::BIGINT, regexp_replace(p, '^[0-9]+', ''))
      ELSE row(1, 0::BIGINT, p) END), chiban) AS n FROM (SELECT DISTINCT chiban FROM parcel)""")
def _(parcel):
    return search.positions(parcel.select("chiban").distinct().withColumn("k", numbers.natural_key(F.col("chiban"))), [], ["k", "chiban"]).select("chiban", "n")


@query("a7_ranked_numbers", "meta parcel", rf"""SELECT oaza_name, chiban, row_number() OVER (PARTITION BY oaza_name ORDER BY list_transform({_PARTS}, lambda p: CASE WHEN regexp_extract(p, '^[0-9]+') <> '' THEN row(0, regexp_extract(p, '^[0-9]+')::BIGINT, regexp_replace(p, '^[0-9]+', ''))
      ELSE row(1, 0::BIGINT, p) END), chiban) AS n FROM (SELECT DISTINCT oaza_name, chiban FROM parcel JOIN meta ON id = xml_meta_id WHERE oaza_name <> '' AND chiban <> '')""")
def _(meta, parcel):
    return search.positions(stats.numbered_index(parcel, meta), ["oaza_name"], ["order_key", "chiban"]).select("oaza_name", "chiban", "n")


@query("o3_map_order", "parcel", rf"""SELECT xml_meta_id, chiban, row_number() OVER (PARTITION BY xml_meta_id ORDER BY list_transform({_PARTS}, lambda p: CASE WHEN regexp_extract(p, '^[0-9]+') <> '' THEN row(0, regexp_extract(p, '^[0-9]+')::BIGINT, regexp_replace(p, '^[0-9]+', ''))
      ELSE row(1, 0::BIGINT, p) END), chiban) AS n FROM (SELECT DISTINCT xml_meta_id, chiban FROM parcel)""")
def _(parcel):
    return search.natural_order(parcel)


@query("s9_export", "meta parcel", "SELECT fude_id, chiban, x0, file_name, crs_type FROM parcel JOIN meta ON id = xml_meta_id WHERE oaza_name = '大字3' AND xml_meta_id IN (3, 25, 47)")
def _(meta, parcel):
    return store.export_parcels(_parcel_shapes(parcel), meta, "大字3", [3, 25, 47]).select("fude_id", "chiban", "x0", "file_name", "crs_type")


@query("s9_export_all", "meta parcel", "SELECT fude_id, x0, file_name, crs_type, 'MULTIPOLYGON' AS kind FROM parcel JOIN meta ON id = xml_meta_id WHERE w >= 10")
def _(meta, parcel):
    rows = _parcel_shapes(parcel).withColumn("geom", F.when(F.col("w") >= 10, F.col("geom")))  # those without a geometry stay behind
    return store.export_parcels(rows, meta).select("fude_id", "x0", "file_name", "crs_type", F.regexp_extract("wkt", "^([A-Z]+)", 1).alias("kind"))


@query("f11_label", "parcel", "SELECT DISTINCT chiban, w, chiban || chr(10) || format('{:,}', round(w * 1000)::BIGINT) || ' m²' AS label FROM parcel")
def _(parcel):
    label = F.concat_ws("\n", "chiban", F.concat(F.format_number(F.col("w") * 1000, 0), F.lit(" m²")))
    return parcel.select("chiban", "w", label.alias("label")).distinct()


@query("f13_scale_mixing", "meta", "SELECT DISTINCT a.scale_denominator AS a, b.scale_denominator AS b, (a.scale_denominator / b.scale_denominator::DOUBLE) * (a.scale_denominator / b.scale_denominator::DOUBLE) AS area_factor FROM meta a JOIN meta b ON a.scale_denominator > b.scale_denominator")
def _(meta):
    scales = meta.where("scale_denominator IS NOT NULL").select("scale_denominator").distinct()
    ratio = F.col("a") / F.col("b")
    return scales.select(F.col("scale_denominator").alias("a")).join(scales.select(F.col("scale_denominator").alias("b")), F.col("a") > F.col("b")).select("a", "b", (ratio * ratio).alias("area_factor"))


@query("g5_affine", "parcel", "SELECT xml_meta_id, fude_id, x0, x0 * 2 + 5 AS x, (y0 + h) * 2 - 7 AS y FROM parcel")
def _(parcel):
    box = geom.affine(geom.rectangle(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")), F.lit(2.0), F.lit(5.0), F.lit(-7.0))
    corner = F.get(F.get(box, F.lit(0)), F.lit(3))
    return parcel.select("xml_meta_id", "fude_id", "x0", corner["x"].alias("x"), corner["y"].alias("y"))


@query(
    "p4_review_queue",
    "parcel",
    "SELECT xml_meta_id, fude_id, chiban, CASE WHEN w * h < 10 THEN 'small' ELSE 'narrow' END AS review_reason FROM parcel WHERE oaza_name = '大字3' AND (w * h < 10 OR h < 1.02)",
)
def _(parcel):
    small, narrow = F.col("w") * F.col("h") < 10, F.col("h") < 1.02
    flagged = parcel.withColumn("needs_review", (small | narrow).cast("int")).withColumn("review_reason", F.when(small, "small").otherwise("narrow"))
    return store.review_queue(flagged, "大字3").select("xml_meta_id", "fude_id", "chiban", "review_reason")


@query(
    "p9_set_reliability",
    "parcel lot",
    "SELECT xml_meta_id, fude_id, x0, CASE WHEN lot_id IS NULL THEN 'LOW' ELSE 'HIGH' END AS reliability FROM parcel LEFT JOIN (SELECT lot_id FROM lot WHERE lot_id % 2 = 0) ON lot_id = xml_meta_id",
)
def _(parcel, lot):
    changes = lot.where("lot_id % 2 = 0").select(F.col("lot_id").alias("xml_meta_id"), F.lit("HIGH").alias("reliability"))
    rows = parcel.select("xml_meta_id", "fude_id", "x0", F.lit("LOW").alias("reliability"))
    return store.update_by_id(rows, changes, ["xml_meta_id"], ["reliability"])


@query(
    "a5_import_summary",
    "xml_file",
    """SELECT count(*) AS processed, count(*) FILTER (content IS NULL OR length(content) < 40) AS failed, sum(CASE WHEN length(content) >= 40 THEN length(content) - length(replace(content, chr(10), '')) ELSE 0 END)::BIGINT AS parcels,
      count(*) FILTER (content IS NULL OR length(content) < 40) = 0 AS success FROM xml_file""",
)
def _(xml_file):
    size = F.coalesce(F.length("content"), F.lit(0))
    lines = F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit("")))
    return stats.import_summary(xml_file.select((size < 40).alias("failed"), F.when(size >= 40, lines).otherwise(0).alias("parcels")))


@query(
    "a8_index_statistics",
    "meta parcel",
    """, rows AS (SELECT DISTINCT oaza_name, chiban, file_name FROM parcel JOIN meta ON id = xml_meta_id WHERE oaza_name <> '')
    SELECT count(*) AS oaza, sum(n)::BIGINT AS entries, sum(c)::BIGINT AS chiban FROM (SELECT oaza_name, count(*) AS n, count(DISTINCT chiban) AS c FROM rows GROUP BY 1)""",
)
def _(meta, parcel):
    return stats.index_statistics(parcel, meta)


@query(
    "s8_append_twice",
    "parcel",
    """SELECT b.xml_meta_id, count(DISTINCT b.fude_id) - count(DISTINCT a.fude_id) AS kept, count(*) - count(DISTINCT b.fude_id) + count(DISTINCT a.fude_id) AS dropped
      FROM (SELECT * FROM parcel WHERE w >= 25) b LEFT JOIN (SELECT DISTINCT xml_meta_id, fude_id FROM parcel WHERE w < 40) a USING (xml_meta_id, fude_id) GROUP BY 1""",
)
def _(parcel):
    path = scratch.new_folder(parcel.sparkSession, "stored-parcels")
    store.append_parcels(parcel.where("w < 40"), path, ["chiban", "x0", "y0"])
    store.append_parcels(parcel.where("w >= 25"), path, ["chiban", "x0", "y0"])
    return store.append_counts(parcel.sparkSession, path).where("batch = 1").select("xml_meta_id", "kept", "dropped")


@query("s8_stored_rows", "parcel", "SELECT xml_meta_id, count(DISTINCT fude_id) AS kept FROM parcel GROUP BY 1")
def _(parcel):
    return match.first_wins(parcel, ["xml_meta_id", "fude_id"], ["chiban", "x0", "y0"]).groupBy("xml_meta_id").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "s10_export_matched",
    "meta parcel lot",
    _MATCH
    + """, hit_maps AS (SELECT DISTINCT xml_meta_id FROM matched WHERE level = 'exact'), hits AS (SELECT DISTINCT xml_meta_id, fude_id FROM matched WHERE level = 'exact')
    SELECT xml_meta_id, fude_id, oaza_name, chiban FROM parcel WHERE xml_meta_id NOT IN (SELECT xml_meta_id FROM hit_maps) OR (xml_meta_id, fude_id) IN (SELECT xml_meta_id, fude_id FROM hits)""",
)
def _(meta, parcel, lot):
    return match.export_rows(parcel, match.best_lots(store.with_map(parcel, meta, "municipality_name"), lot, ("exact",))).select("xml_meta_id", "fude_id", "oaza_name", "chiban")


@query(
    "j9_lot_best_map",
    "meta parcel lot",
    _MATCH
    + """ SELECT lot_id, xml_meta_id, fude_id, level FROM (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY CASE level WHEN 'exact' THEN 0 WHEN 'parent' THEN 1 ELSE 2 END, xml_meta_id, fude_id) AS k FROM matched) WHERE k = 1""",
)
def _(meta, parcel, lot):
    return match.best_maps(store.with_map(parcel, meta, "municipality_name"), lot)


@query(
    "j14_locate",
    "lot admin",
    """SELECT lot_id, admin_id FROM (SELECT lot_id, admin_id, row_number() OVER (PARTITION BY lot_id ORDER BY greatest(min_x - cx, 0, cx - max_x) * greatest(min_x - cx, 0, cx - max_x) + greatest(min_y - cy, 0, cy - max_y) * greatest(min_y - cy, 0, cy - max_y), admin_id) AS k
      FROM lot JOIN admin ON cx + 30 >= min_x AND cx - 30 <= max_x AND cy + 30 >= min_y AND cy - 30 <= max_y) WHERE k = 1""",
)
def _(lot, admin):
    return spatial.locate(lot.select(F.col("lot_id").alias("key"), F.col("cx").alias("x"), F.col("cy").alias("y")), _shapes(admin), 30.0).select(F.col("key").alias("lot_id"), "admin_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best lot of every parcel by number."""
    return _QUERIES["w1_best_match"](spark, sf_dir)


# The other modules register their queries when they are imported.
from parcelworks.plans import ingest_queries, more_queries, shape_queries  # noqa: E402,F401
