"""Queries of the cadastral part that look at whole records: geometry, both directions of matching, index lookups, audits, updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelworks.functions import geom, maps, numbers, zones
from parcelworks.operators import align, match, search, spatial, stats, store
from parcelworks.plans.registry import _ARBITRARY, _BRANCH, _DOMINANT, _MATCH, _PARENT, _SCALE, _lot_shapes, _matches, _parcel_shapes, _shapes, query

_MEETS = "cx + 5 >= min_x AND cx - 5 <= max_x AND cy + 5 >= min_y AND cy - 5 <= max_y"
_LEVEL = """CASE WHEN pj = qj THEN 'exact' WHEN pp = qp THEN 'parent' WHEN length(pp) = length(qp) AND length(pp) > 0 AND substr(pp, 1, length(pp) - 1) = substr(qp, 1, length(pp) - 1) THEN 'near' END"""
_NUMBERED = f"""p AS (SELECT *, CASE WHEN pb <> '' THEN pp || '-' || pb ELSE pp END AS pj FROM (SELECT *, {_PARENT.format("chiban")} AS pp, {_BRANCH.format("chiban")} AS pb FROM parcel) WHERE pp <> ''),
  q AS (SELECT *, parent_no AS qp, CASE WHEN branch_no <> '' THEN parent_no || '-' || branch_no ELSE parent_no END AS qj FROM lot)"""


# Functions


@query("f4_match_level", "parcel lot", f", {_NUMBERED} SELECT DISTINCT chiban, lot_id, {_LEVEL} AS level FROM p JOIN q ON lot_id = xml_meta_id")
def _(parcel, lot):
    met = parcel.join(lot, F.col("lot_id") == F.col("xml_meta_id"))
    level = numbers.match_level(numbers.parent_of(F.col("chiban")), numbers.branch_of(F.col("chiban")), F.col("parent_no"), F.col("branch_no"))
    return met.select("chiban", "lot_id", level.alias("level")).distinct()


@query("f6_nfkc_scale", "meta", f"SELECT DISTINCT map_name, CASE WHEN {_SCALE} >= 100 THEN {_SCALE} END AS scale FROM meta")
def _(meta):
    return maps.scales_of_names(meta)


@query(
    "f13_mixing_factors",
    "meta",
    """, s AS (SELECT DISTINCT scale_denominator::DOUBLE AS v FROM meta WHERE scale_denominator IS NOT NULL) SELECT a.v AS scale, b.v AS other, (a.v / b.v) * (a.v / b.v) AS area, a.v / b.v AS length FROM s a JOIN s b ON a.v <> b.v""",
)
def _(meta):
    scales = meta.where("scale_denominator IS NOT NULL").select(F.col("scale_denominator").cast("double").alias("scale")).distinct()
    pairs = scales.join(scales.withColumnRenamed("scale", "other"), F.col("scale") != F.col("other"))
    return pairs.select("scale", "other", maps.mixing_factors(F.col("scale"), F.col("other")).alias("f")).select("scale", "other", "f.area", "f.length")


@query("f15_stamped", "meta", "SELECT id, true AS imported, true AS updated FROM meta")
def _(meta):
    now, day = F.current_timestamp(), F.expr("INTERVAL 1 DAY")
    fresh = lambda c: F.col(c).between(now - day, now + day)
    return store.stamped(meta.select("id")).select("id", fresh("import_date").alias("imported"), fresh("updated_date").alias("updated"))


@query(
    "g3_wkt_round_trip",
    "parcel",
    "SELECT xml_meta_id, fude_id, x0, 'POLYGON' AS kind, 5 AS points, x0 AS first_x, y0 AS first_y, x0 + w AS third_x, y0 + h AS third_y FROM parcel",
)
def _(parcel):
    text = _parcel_shapes(parcel).select("xml_meta_id", "fude_id", "x0", geom.to_wkt(F.col("geom")).alias("wkt"))
    ring = F.get(geom.from_wkt(F.col("wkt")), F.lit(0))
    first, third = F.get(ring, F.lit(0)), F.get(ring, F.lit(2))
    return text.select("xml_meta_id", "fude_id", "x0", F.regexp_extract("wkt", "^([A-Z]+)", 1).alias("kind"), F.size(ring).alias("points"), first["x"].alias("first_x"), first["y"].alias("first_y"), third["x"].alias("third_x"), third["y"].alias("third_y"))


def _holed(parcel):
    """Parcels with a hole of a sixteenth of their size off their centre."""
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    return parcel.withColumn("geom", F.concat(geom.rectangle(x, y, x + w, y + h), geom.rectangle(x + w / 4, y + h / 4, x + w / 2, y + h / 2)))


@query("g4_holed_centroid", "parcel", "SELECT xml_meta_id, fude_id, x0, round((x0 + w / 2 - (x0 + 3 * w / 8) / 16) * 16 / 15, 6) AS cx, round((y0 + h / 2 - (y0 + 3 * h / 8) / 16) * 16 / 15, 6) AS cy FROM parcel")
def _(parcel):
    return _holed(parcel).select("xml_meta_id", "fude_id", "x0", geom.polygon_centroid(F.col("geom")).alias("c")).select("xml_meta_id", "fude_id", "x0", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"))


@query("g7_shifted_maps", "parcel", "SELECT xml_meta_id, round(min(x0) + 3, 4) AS min_x, round(max(y0 + h) - xml_meta_id, 4) AS max_y FROM parcel GROUP BY 1")
def _(parcel):
    moves = parcel.select("xml_meta_id").distinct().select("xml_meta_id", F.lit(1.0).alias("scale"), F.lit(3.0).alias("dx"), (-F.col("xml_meta_id")).cast("double").alias("dy"))
    boxes = align.shift(_parcel_shapes(parcel).select("xml_meta_id", "geom"), moves).withColumn("b", geom.polygon_box(F.col("geom")))
    return boxes.groupBy("xml_meta_id").agg(F.round(F.min("b.min_x"), 4).alias("min_x"), F.round(F.max("b.max_y"), 4).alias("max_y"))


@query(
    "g8_placed_maps",
    "meta parcel admin",
    f""", {_DOMINANT},
    centre AS (SELECT xml_meta_id, sum(w * h * (x0 + w / 2)) / sum(w * h) AS cx, sum(w * h * (y0 + h / 2)) / sum(w * h) AS cy, min(x0) AS x, max(y0 + h) AS y, count(*) AS n FROM parcel GROUP BY 1),
    district AS (SELECT trim(name) AS name, sum(a * (min_x + max_x) / 2) / sum(a) AS cx, sum(a * (min_y + max_y) / 2) / sum(a) AS cy FROM (SELECT *, (max_x - min_x) * (max_y - min_y) AS a FROM admin) GROUP BY 1),
    move AS (SELECT centre.xml_meta_id AS m, district.cx - centre.cx AS dx, district.cy - centre.cy AS dy FROM centre JOIN meta ON id = centre.xml_meta_id AND {_ARBITRARY}
      JOIN dominant ON dominant.xml_meta_id = centre.xml_meta_id JOIN district ON district.name = oaza_name)
    SELECT xml_meta_id, m IS NOT NULL AS moved, n AS parcels, round(x + coalesce(dx, 0), 3) AS min_x, round(y + coalesce(dy, 0), 3) AS max_y, round(x + coalesce(dx, 0), 3) AS envelope_min_x FROM centre LEFT JOIN move ON m = xml_meta_id""",
)
def _(meta, parcel, admin):
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    shapes = admin.select(F.trim("name").alias("name"), area.alias("area"), ((F.col("min_x") + F.col("max_x")) / 2).alias("cx"), ((F.col("min_y") + F.col("max_y")) / 2).alias("cy"))
    moves = align.auto_positions(meta, parcel, align.weighted_centres(shapes, "name"))
    envelopes = _shapes(align.map_bounds(parcel)).select("xml_meta_id", "geom")
    moved, frames = align.placed_maps(_parcel_shapes(parcel).select("xml_meta_id", "geom"), envelopes, moves)
    box = moved.withColumn("b", geom.polygon_box(F.col("geom"))).groupBy("xml_meta_id", "moved").agg(F.count(F.lit(1)).alias("parcels"), F.round(F.min("b.min_x"), 3).alias("min_x"), F.round(F.max("b.max_y"), 3).alias("max_y"))
    return box.join(frames.select("xml_meta_id", F.round(geom.polygon_box(F.col("geom"))["min_x"], 3).alias("envelope_min_x")), "xml_meta_id")


@query("g9_zone_round_trip", "parcel", "SELECT xml_meta_id, fude_id, x0, true AS within_a_millimetre, true AS north_of_origin FROM parcel")
def _(parcel):
    zone = (1 + F.pmod("xml_meta_id", F.lit(19))).cast("int")
    there = zones.zone_of_rows_changed(F.col("x0"), F.col("y0") + 100, zone, F.lit(9))
    moved = parcel.select("xml_meta_id", "fude_id", "x0", zone.alias("zone"), "y0", there.alias("p"), zones.degrees_of_rows(F.col("x0"), F.col("y0") + 100, zone).alias("ll"))
    back = moved.withColumn("b", zones.zone_of_rows_changed(F.col("p.x"), F.col("p.y"), F.lit(9), F.col("zone")))
    origin = F.get(F.array(*[F.lit(float(o[0])) for o in zones.ORIGINS]), F.col("zone") - 1)
    return back.select("xml_meta_id", "fude_id", "x0", ((F.abs(F.col("b.x") - F.col("x0")) < 0.001) & (F.abs(F.col("b.y") - 100 - F.col("y0")) < 0.001)).alias("within_a_millimetre"), (F.col("ll.latitude") > origin).alias("north_of_origin"))


@query(
    "g6_anchored_maps",
    "meta parcel lot",
    _MATCH
    + f""", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY xml_meta_id, fude_id, chiban ORDER BY CASE level WHEN 'exact' THEN 0 WHEN 'parent' THEN 1 ELSE 2 END, lot_id) AS k FROM matched) WHERE k = 1),
    anchor AS (SELECT * FROM (SELECT xml_meta_id, fude_id, lot_id, row_number() OVER (PARTITION BY xml_meta_id ORDER BY CASE level WHEN 'exact' THEN 0 WHEN 'parent' THEN 1 ELSE 2 END, fude_id, lot_id) AS r FROM best) WHERE r = 1),
    source AS (SELECT xml_meta_id, fude_id, min(row(x0 + w / 2, y0 + h / 2)::STRUCT(x DOUBLE, y DOUBLE)) AS s FROM parcel GROUP BY 1, 2),
    scaled AS (SELECT id, CASE WHEN {_ARBITRARY} THEN coalesce(nullif(scale_denominator, 0), CASE WHEN {_SCALE} >= 100 THEN {_SCALE} END, 600) / 1000.0::DOUBLE ELSE 1.0 END::DOUBLE AS sc FROM meta)
    SELECT anchor.xml_meta_id, sc AS scale, round(cx - sc * s.x, 4) AS dx, round(cy - sc * s.y, 4) AS dy FROM anchor JOIN source ON source.xml_meta_id = anchor.xml_meta_id AND source.fude_id = anchor.fude_id
      JOIN lot ON lot.lot_id = anchor.lot_id JOIN scaled ON id = anchor.xml_meta_id""",
)
def _(meta, parcel, lot):
    best = match.best_lots(store.with_map(parcel, meta, "municipality_name"), lot)
    centres = parcel.select("xml_meta_id", "fude_id", (F.col("x0") + F.col("w") / 2).alias("cx"), (F.col("y0") + F.col("h") / 2).alias("cy"))
    moves = align.anchored_moves(align.match_anchors(best, centres, lot), meta)
    return moves.select("xml_meta_id", "scale", F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"))


# Reads and updates


@query("p1_maps_by_file", "meta lot", "SELECT id, file_name, crs_type FROM meta WHERE file_name IN (SELECT 'z' || (lot_id % 25) || '.zip/m' || lot_id || '.xml' FROM lot)")
def _(meta, lot):
    asked = lot.select(F.concat(F.lit("z"), (F.col("lot_id") % 25).cast("string"), F.lit(".zip/m"), F.col("lot_id").cast("string"), F.lit(".xml")).alias("file_name"))
    return meta.join(asked, "file_name", "left_semi").select("id", "file_name", "crs_type")


@query("p1_all_maps", "meta", "SELECT * FROM meta ORDER BY file_name")
def _(meta):
    return meta.orderBy("file_name")


_OFF = "off AS (SELECT xml_meta_id, CASE WHEN xml_meta_id % 7 = 0 OR (xml_meta_id % 5 = 0 AND y0 > 100) THEN '地図外' ELSE chiban END AS chiban FROM parcel)"


@query("p7_off_map", "meta parcel", f", {_OFF} SELECT id FROM meta WHERE id NOT IN (SELECT xml_meta_id FROM off GROUP BY 1 HAVING bool_and(chiban = '地図外'))")
def _(meta, parcel):
    outside = (F.col("xml_meta_id") % 7 == 0) | ((F.col("xml_meta_id") % 5 == 0) & (F.col("y0") > 100))
    return stats.off_map_only(meta, parcel.withColumn("chiban", F.when(outside, "地図外").otherwise(F.col("chiban")))).select("id")


@query(
    "p9_reliability_of_maps",
    "parcel lot",
    """SELECT xml_meta_id, fude_id, x0, hit AS updated, CASE WHEN hit THEN 'MEDIUM' ELSE 'LOW' END AS reliability, CASE WHEN hit THEN 'shift' END AS transform_method, CASE WHEN hit THEN 1 ELSE 0 END AS needs_review, CASE WHEN hit THEN 'far' END AS review_reason
      FROM (SELECT *, xml_meta_id IN (SELECT lot_id FROM lot WHERE lot_id % 3 = 0) AND chiban = '道' AS hit FROM parcel) QUALIFY count(*) OVER (PARTITION BY xml_meta_id, fude_id) = 1""",
)
def _(parcel, lot):
    counts = parcel.groupBy("xml_meta_id", "fude_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    rows = parcel.join(counts, ["xml_meta_id", "fude_id"]).select("xml_meta_id", "fude_id", "x0", "chiban", F.lit("LOW").alias("reliability"), F.lit(None).cast("string").alias("transform_method"), F.lit(0).alias("needs_review"), F.lit(None).cast("string").alias("review_reason"))
    ids = rows.where("chiban = '道'").join(lot.where("lot_id % 3 = 0").select(F.col("lot_id").alias("xml_meta_id")), "xml_meta_id").select("xml_meta_id", "fude_id")
    return store.set_reliability(rows, ids, "MEDIUM", "shift", True, "far").drop("chiban")


@query("p10_update_oaza", "meta parcel", f", {_DOMINANT} SELECT id, coalesce(oaza_name, 'none') AS oaza_name FROM meta LEFT JOIN dominant ON xml_meta_id = id")
def _(meta, parcel):
    changes = stats.dominant_oaza(parcel).withColumnRenamed("xml_meta_id", "id")
    return store.update_by_id(meta.select("id", F.lit("none").alias("oaza_name")), changes, ["id"], ["oaza_name"])


@query(
    "p10_set_geometry",
    "parcel",
    """SELECT xml_meta_id, fude_id, CASE WHEN xml_meta_id % 2 = 0 THEN '変換済み' ELSE coord_type END AS coord_type, round(min_x, 4) AS min_x FROM (SELECT xml_meta_id, fude_id, coord_type, x0, CASE WHEN xml_meta_id % 2 = 0 THEN x0 * 2 ELSE x0 END AS min_x FROM parcel)
      QUALIFY count(*) OVER (PARTITION BY xml_meta_id, fude_id) = 1""",
)
def _(parcel):
    counts = parcel.groupBy("xml_meta_id", "fude_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    rows = _parcel_shapes(parcel.join(counts, ["xml_meta_id", "fude_id"])).select("xml_meta_id", "fude_id", "coord_type", "geom")
    new = rows.where("xml_meta_id % 2 = 0").withColumn("geom", geom.affine(F.col("geom"), F.lit(2.0), F.lit(0.0), F.lit(0.0)))
    return store.set_geometry(rows, new).select("xml_meta_id", "fude_id", "coord_type", F.round(geom.polygon_box(F.col("geom"))["min_x"], 4).alias("min_x"))


@query("p11_srid_rows", "meta parcel", "SELECT xml_meta_id, fude_id, x0, CASE WHEN crs_type = '公共座標8系' THEN 6676 END AS srid FROM parcel JOIN meta ON id = xml_meta_id")
def _(meta, parcel):
    return store.with_srid(store.with_map(parcel, meta, "crs_type")).select("xml_meta_id", "fude_id", "x0", "srid")


@query("p12_oaza_polygon", "admin", "SELECT name, admin_id, (max_x - min_x) * (max_y - min_y) AS area, min_x, max_y FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY admin_id) AS k FROM admin) WHERE k = 1")
def _(admin):
    one = spatial.areas_by_name(_shapes(admin)).withColumn("b", geom.polygon_box(F.col("geom")))
    return one.select("name", "admin_id", geom.polygon_area(F.col("geom")).alias("area"), F.col("b.min_x").alias("min_x"), F.col("b.max_y").alias("max_y"))


@query(
    "u1_append_store",
    "xml_file",
    """, f AS (SELECT source_name, sha256(content) AS h, regexp_extract(source_name, '([^/]*)$', 1) AS base FROM xml_file), k AS (SELECT DISTINCT source_name, h FROM f WHERE source_name LIKE 'z1%'),
    fresh AS (SELECT DISTINCT source_name, h FROM f WHERE h NOT IN (SELECT h FROM k) AND source_name NOT IN (SELECT source_name FROM k) AND base NOT IN (SELECT source_name FROM k)),
    one AS (SELECT h, min(source_name) AS source_name FROM fresh GROUP BY 1)
    SELECT source_name, h AS xml_sha256 FROM k UNION ALL SELECT source_name, min(h) FROM one GROUP BY 1""",
)
def _(xml_file):
    files = xml_file.select("source_name", F.sha2(F.col("content").cast("binary"), 256).alias("xml_sha256"))
    return store.append_new(files.where("source_name LIKE 'z1%'").distinct(), files)


# Matching


@query("j8_mutual_lots", "meta parcel lot", _MATCH + f""", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY CASE level WHEN 'exact' THEN 0 WHEN 'parent' THEN 1 ELSE 2 END, xml_meta_id, fude_id) AS k FROM matched) WHERE k = 1)
  SELECT DISTINCT b.lot_id, b.xml_meta_id, b.fude_id, m.lot_id AS other_lot_id, CASE WHEN b.level = 'exact' THEN m.level ELSE 'parent' END AS level
  FROM best b JOIN matched m ON m.xml_meta_id = b.xml_meta_id AND m.fude_id = b.fude_id WHERE (b.level = 'exact' AND m.level <> 'near') OR (b.level = 'parent' AND m.level = 'exact')""")
def _(meta, parcel, lot):
    parcels = store.with_map(parcel, meta, "municipality_name")
    return match.mutual_lots(match.best_maps(parcels, lot), parcels, lot)


@query(
    "j8_mutual_near",
    "meta parcel lot",
    _MATCH
    + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY xml_meta_id, fude_id, chiban ORDER BY CASE level WHEN 'exact' THEN 0 WHEN 'parent' THEN 1 ELSE 2 END, lot_id) AS k FROM matched) WHERE k = 1),
  v AS (SELECT DISTINCT b.xml_meta_id, b.lot_id, b.level AS how, l.parent_no AS qp, CASE WHEN l.branch_no <> '' THEN l.parent_no || '-' || l.branch_no ELSE l.parent_no END AS qj FROM best b JOIN lot l ON l.lot_id = b.lot_id WHERE b.level <> 'near'),
  m AS (SELECT v.xml_meta_id, v.lot_id, r.fude_id, r.chiban, how, """
    + _LEVEL
    + """ AS level FROM v JOIN pj r ON r.xml_meta_id = v.xml_meta_id)
  SELECT DISTINCT xml_meta_id, lot_id, fude_id, chiban, CASE how WHEN 'exact' THEN level ELSE 'parent' END AS level FROM m WHERE level IS NOT NULL AND (how = 'exact' OR level = 'exact')""",
)
def _(meta, parcel, lot):
    return match.mutual_matches(match.best_lots(store.with_map(parcel, meta, "municipality_name"), lot), parcel, lot, near=True)


@query(
    "j9_other_maps",
    "parcel lot",
    f""", {_NUMBERED}, chosen AS (SELECT lot_id AS c, 1 + lot_id % 100 AS m, regexp_replace(oaza_name, '小字$', '') AS oaza FROM lot),
    asked AS (SELECT q.lot_id, q.qp, q.qj, m, oaza FROM q JOIN chosen ON c = lot_id WHERE qp <> ''),
    here AS (SELECT * FROM (SELECT lot_id, xml_meta_id, fude_id, chiban, {_LEVEL} AS level FROM asked JOIN p ON xml_meta_id = m) WHERE level IS NOT NULL),
    maps AS (SELECT DISTINCT oaza_name, xml_meta_id AS other FROM parcel WHERE oaza_name <> ''),
    there AS (SELECT * FROM (SELECT lot_id, xml_meta_id, fude_id, chiban, {_LEVEL} AS level FROM asked JOIN maps ON oaza_name = oaza AND other <> m JOIN p ON p.xml_meta_id = other WHERE lot_id NOT IN (SELECT lot_id FROM here)) WHERE level IS NOT NULL),
    best AS (SELECT lot_id, min(row(CASE level WHEN 'exact' THEN 0 WHEN 'parent' THEN 1 ELSE 2 END, xml_meta_id)::STRUCT(p INT, m BIGINT)).m AS bm FROM there GROUP BY 1)
    SELECT DISTINCT lot_id, xml_meta_id, fude_id, chiban, level, false AS other_map FROM here UNION ALL
    SELECT DISTINCT there.lot_id, xml_meta_id, fude_id, chiban, level, true FROM there JOIN best ON best.lot_id = there.lot_id AND bm = xml_meta_id""",
)
def _(parcel, lot):
    chosen = lot.select("lot_id", (1 + F.col("lot_id") % 100).alias("xml_meta_id"), F.regexp_replace("oaza_name", "小字$", "").alias("oaza_name"))
    return match.matches_in_maps(chosen, lot.drop("oaza_name"), parcel)


@query(
    "j7_spatial_match",
    "meta parcel lot admin",
    f""", {_NUMBERED}, names AS (SELECT DISTINCT oaza_name AS a FROM parcel WHERE oaza_name <> ''), covered AS (SELECT a, admin.* FROM names JOIN admin ON starts_with(a, name) OR starts_with(name, a)),
    allowed AS (SELECT DISTINCT a, lot_id AS l FROM covered JOIN lot ON {_MEETS} UNION SELECT a, lot_id FROM (SELECT a FROM names WHERE a NOT IN (SELECT a FROM covered) UNION SELECT ''), lot)
    SELECT DISTINCT xml_meta_id, fude_id, chiban, lot_id, {_LEVEL} AS level FROM p JOIN meta ON id = xml_meta_id JOIN allowed ON a = oaza_name JOIN q ON lot_id = l
    WHERE {_LEVEL} IS NOT NULL AND (q.municipality_name = '' OR meta.municipality_name = '' OR contains(meta.municipality_name, q.municipality_name))""",
)
def _(meta, parcel, lot, admin):
    return match.number_matches(store.with_map(parcel, meta, "municipality_name"), _lot_shapes(lot), areas=_shapes(admin))


@query(
    "w2_last_wins",
    "parcel",
    "SELECT xml_meta_id, fude_id, chiban, x0 FROM (SELECT *, row_number() OVER (PARTITION BY xml_meta_id, fude_id ORDER BY chiban DESC, x0 DESC, y0 DESC) AS k FROM parcel) WHERE k = 1",
)
def _(parcel):
    return match.first_wins(parcel, ["xml_meta_id", "fude_id"], ["chiban", "x0", "y0"], last=True).select("xml_meta_id", "fude_id", "chiban", "x0")


@query(
    "w3_clicked_names",
    "parcel",
    rf""", p AS (SELECT xml_meta_id, oaza_name, CASE WHEN xml_meta_id % 4 = 1 THEN NULL ELSE chiban END AS chiban FROM parcel), c AS (SELECT xml_meta_id, oaza_name, min(chiban) AS clicked FROM parcel WHERE xml_meta_id % 3 = 0 GROUP BY 1, 2),
    n AS (SELECT *, {_PARENT.format("chiban")} AS pp, {_BRANCH.format("chiban")} AS pb FROM p WHERE chiban IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY xml_meta_id, oaza_name ORDER BY coalesce(TRY_CAST(pp AS BIGINT), 999999), coalesce(TRY_CAST(pb AS BIGINT), -1), chiban) AS k, count(*) OVER (PARTITION BY xml_meta_id, oaza_name) AS n FROM n),
    s AS (SELECT DISTINCT xml_meta_id, oaza_name FROM p)
    SELECT s.xml_meta_id, s.oaza_name, CASE WHEN clicked IS NOT NULL THEN s.oaza_name || '_' || clicked WHEN n IS NULL THEN s.oaza_name WHEN n = 1 THEN s.oaza_name || '_' || chiban
      ELSE s.oaza_name || '_' || CASE WHEN pb <> '' THEN pp || '-' || pb ELSE pp END || '他' END AS export_name
    FROM s LEFT JOIN r ON r.xml_meta_id = s.xml_meta_id AND r.oaza_name = s.oaza_name AND k = 1 LEFT JOIN c ON c.xml_meta_id = s.xml_meta_id AND c.oaza_name = s.oaza_name""",
)
def _(parcel):
    clicked = parcel.where("xml_meta_id % 3 = 0").groupBy("xml_meta_id", "oaza_name").agg(F.min("chiban").alias("chiban"))
    return match.export_names(parcel.withColumn("chiban", F.when(F.col("xml_meta_id") % 4 != 1, F.col("chiban"))), clicked)


@query(
    "s10_export_table",
    "meta parcel lot",
    _MATCH
    + f""", hit_maps AS (SELECT DISTINCT xml_meta_id FROM matched WHERE level = 'exact'), hits AS (SELECT DISTINCT xml_meta_id, fude_id FROM matched WHERE level = 'exact'),
    ground AS (SELECT id, coalesce(nullif(scale_denominator, 0), CASE WHEN {_SCALE} >= 100 THEN {_SCALE} END, 600) AS scale FROM meta WHERE NOT ({_ARBITRARY}))
    SELECT xml_meta_id, fude_id, oaza_name, chiban, round(w * h, 4) AS est_area, scale, x0 AS min_x FROM parcel JOIN ground ON id = xml_meta_id WHERE xml_meta_id NOT IN (SELECT xml_meta_id FROM hit_maps) OR (xml_meta_id, fude_id) IN (SELECT xml_meta_id, fude_id FROM hits)""",
)
def _(meta, parcel, lot):
    hits = match.best_lots(store.with_map(parcel, meta, "municipality_name"), lot, ("exact",))
    rows = match.export_table(_parcel_shapes(parcel).withColumn("area_sqm", geom.polygon_area(F.col("geom"))), meta, hits)
    return rows.select("xml_meta_id", "fude_id", "oaza_name", "chiban", F.round("est_area", 4).alias("est_area"), "scale", geom.polygon_box(F.col("geom"))["min_x"].alias("min_x"))


# Spatial joins


@query("j11_updated_oaza", "parcel admin", """, hit AS (SELECT xml_meta_id AS m, fude_id AS f, x0 AS x, min(admin_id) AS a FROM parcel JOIN admin ON x0 + w / 2 BETWEEN min_x AND max_x AND y0 + h / 2 BETWEEN min_y AND max_y GROUP BY ALL)
  SELECT xml_meta_id, count(*) AS parcels, count(*) FILTER (name IS NOT NULL AND name <> oaza_name) AS updated, count(*) FILTER (coalesce(name, oaza_name) = '大字0') AS in_zero FROM parcel LEFT JOIN hit ON m = xml_meta_id AND f = fude_id AND x = x0 LEFT JOIN admin ON admin_id = a GROUP BY 1""")
def _(parcel, admin):
    key = F.struct("xml_meta_id", "fude_id", "x0").alias("key")
    points = parcel.select(key, (F.col("x0") + F.col("w") / 2).alias("x"), (F.col("y0") + F.col("h") / 2).alias("y"))
    found = spatial.containing_area(points, _shapes(admin)).join(admin.select("admin_id", "name"), "admin_id").select("key", "name")
    rows = spatial.update_oaza(parcel.select(key, "oaza_name"), found)
    return rows.groupBy(F.col("key.xml_meta_id").alias("xml_meta_id")).agg(F.count(F.lit(1)).alias("parcels"), F.sum("updated").alias("updated"), F.count_if(F.col("oaza_name") == "大字0").alias("in_zero"))


@query(
    "j12_municipality_differs",
    "meta parcel admin",
    """, box AS (SELECT xml_meta_id AS key, min(x0) AS x0, min(y0) AS y0, max(x0 + w) AS x1, max(y0 + h) AS y1 FROM parcel GROUP BY 1),
    hit AS (SELECT key, '静岡県賀茂郡NATION_' || admin_id || '町' AS name FROM (SELECT key, admin_id, row_number() OVER (PARTITION BY key ORDER BY round((least(x1, max_x) - greatest(x0, min_x)) * (least(y1, max_y) - greatest(y0, min_y)), 6) DESC, admin_id) AS k
      FROM box JOIN admin ON least(x1, max_x) > greatest(x0, min_x) AND least(y1, max_y) > greatest(y0, min_y)) WHERE k = 1)
    SELECT id, municipality_name, name AS found_name FROM meta JOIN hit ON key = id
    WHERE regexp_replace(regexp_replace(municipality_name, '^.*?郡', ''), '^.*?県', '') <> regexp_replace(regexp_replace(name, '^.*?郡', ''), '^.*?県', '')""",
)
def _(meta, parcel, admin):
    boxes = _shapes(align.map_bounds(parcel).withColumnRenamed("xml_meta_id", "key"))
    names = admin.select("admin_id", F.concat(F.lit("静岡県賀茂郡NATION_"), F.col("admin_id").cast("string"), F.lit("町")).alias("name"))
    found = spatial.largest_overlap(boxes, _shapes(admin)).join(names, "admin_id").select(F.col("key").alias("id"), "name")
    return stats.municipality_differs(meta, found)


@query("j13_lots_in_districts", "lot admin", f"SELECT lot_id FROM lot WHERE EXISTS (SELECT 1 FROM admin WHERE (starts_with(name, '大字1') OR starts_with('大字1', name)) AND {_MEETS})")
def _(lot, admin):
    areas = _shapes(admin).where(maps.names_pair(F.col("name"), F.lit("大字1")))
    return spatial.meeting(_lot_shapes(lot).withColumnRenamed("lot_id", "key"), areas).select(F.col("key").alias("lot_id"))


# Aggregates


@query("a6_filled_oaza", "meta parcel", f", {_DOMINANT} SELECT id, CASE WHEN id % 3 = 0 THEN '既知' ELSE coalesce(oaza_name, '') END AS oaza_name FROM meta LEFT JOIN dominant ON xml_meta_id = id")
def _(meta, parcel):
    return stats.filled_oaza(meta.withColumn("oaza_name", F.when(F.col("id") % 3 == 0, "既知").otherwise("")), parcel).select("id", "oaza_name")


_INDEX = "rows AS (SELECT DISTINCT oaza_name, (CAST(y0 AS BIGINT) % 3)::VARCHAR AS koaza, chiban, file_name FROM parcel JOIN meta ON id = xml_meta_id WHERE oaza_name <> '')"
_NORMAL = "lower(translate(chiban, '０１２３４５６７８９番号の-－ー', '0123456789'))"
_SORTED = r"""list_transform(string_split_regex(chiban, '[-－ー]'), lambda p: CASE WHEN regexp_extract(p, '^[0-9]+') <> '' THEN row(0, regexp_extract(p, '^[0-9]+')::BIGINT, regexp_replace(p, '^[0-9]+', '')) ELSE row(1, 0::BIGINT, p) END)"""


def _with_koaza(parcel):
    return parcel.withColumn("koaza_code", (F.col("y0").cast("bigint") % 3).cast("string"))


@query(
    "a7_koaza_numbers",
    "meta parcel",
    f""", {_INDEX} SELECT oaza_name, koaza, numbers, files FROM (SELECT oaza_name, koaza, string_agg(chiban, ' ' ORDER BY k, chiban) AS numbers FROM (SELECT DISTINCT oaza_name, koaza, chiban, {_SORTED} AS k FROM rows) GROUP BY 1, 2)
      JOIN (SELECT oaza_name, string_agg(DISTINCT file_name, ' ' ORDER BY file_name) AS files FROM rows GROUP BY 1) USING (oaza_name)""",
)
def _(meta, parcel):
    index = stats.search_index(_with_koaza(parcel), meta)
    return index.select("oaza_name", F.explode("koaza").alias("koaza", "numbers"), F.array_join("files", " ").alias("files")).withColumn("numbers", F.array_join("numbers", " "))


@query("a7_districts_of_numbers", "meta parcel", f", {_INDEX} SELECT chiban, string_agg(DISTINCT oaza_name, ' ' ORDER BY oaza_name) AS districts FROM rows GROUP BY 1")
def _(meta, parcel):
    return stats.districts_of_numbers(parcel, meta).select("chiban", F.array_join("districts", " ").alias("districts"))


@query("a7_normalized_numbers", "meta parcel", f", {_INDEX} SELECT oaza_name, normal, chiban FROM (SELECT oaza_name, {_NORMAL} AS normal, chiban, row_number() OVER (PARTITION BY oaza_name, {_NORMAL} ORDER BY {_SORTED} DESC, chiban DESC) AS n FROM rows) WHERE n = 1")
def _(meta, parcel):
    return stats.normalized_numbers(parcel, meta)


@query("a8_distribution", "meta parcel", ", rows AS (SELECT DISTINCT oaza_name, chiban, file_name FROM parcel JOIN meta ON id = xml_meta_id WHERE oaza_name <> '') SELECT oaza_name, count(*) AS entries FROM rows GROUP BY 1 ORDER BY 2 DESC, 1")
def _(meta, parcel):
    return stats.index_distribution(parcel, meta)


@query("a5_import_errors", "xml_file", "SELECT source_name, 'short' AS error FROM xml_file WHERE content IS NULL OR length(content) < 200 ORDER BY 1")
def _(xml_file):
    short = F.coalesce(F.length("content"), F.lit(0)) < 200
    return stats.import_errors(xml_file.select("source_name", short.alias("failed"), F.when(short, "short").alias("error")))


@query("a15_coord_types", "parcel", "SELECT coord_type, count(DISTINCT xml_meta_id) AS maps, count(*) AS parcels FROM parcel GROUP BY GROUPING SETS ((coord_type), ())")
def _(parcel):
    return stats.coord_type_table(parcel)


@query(
    "a16_by_municipality",
    "meta parcel",
    rf""", n AS (SELECT municipality_name, oaza_name, chiban, bool_or({_ARBITRARY}) AS a, bool_or(NOT ({_ARBITRARY})) AS p, avg(w * h) FILTER ({_ARBITRARY}) AS old, avg(w * h) FILTER (NOT ({_ARBITRARY})) AS new
      FROM parcel JOIN (SELECT id, regexp_replace(municipality_name, '[0-9]+', '') AS municipality_name, crs_type FROM meta) m ON id = xml_meta_id WHERE oaza_name <> '' GROUP BY 1, 2, 3),
    d AS (SELECT municipality_name, oaza_name, bool_or(a) AND bool_or(p) AS ab, count(*) FILTER (a AND p) AS s, count(*) FILTER (a AND p AND regexp_matches(chiban, '^\p{{Nd}}')) AS sn, min(CASE WHEN a AND p THEN new / old END) AS lo, max(CASE WHEN a AND p THEN new / old END) AS hi FROM n GROUP BY 1, 2)
    SELECT municipality_name, count(*) FILTER (ab) AS districts, sum(s)::BIGINT AS shared, sum(sn)::BIGINT AS shared_numeric, round(min(lo), 6) AS min_ratio, round(max(hi), 6) AS max_ratio FROM d GROUP BY 1""",
)
def _(meta, parcel):
    towns = meta.withColumn("municipality_name", F.regexp_replace("municipality_name", "[0-9]+", ""))
    rows = stats.shared_by_municipality(parcel.withColumn("area_sqm", F.col("w") * F.col("h")), towns)
    return rows.withColumns({c: F.round(c, 6) for c in ("min_ratio", "max_ratio")})


@query(
    "a17_numbers_across_scales",
    "meta parcel",
    r""", n AS (SELECT DISTINCT oaza_name, chiban, scale_denominator AS s FROM parcel JOIN meta ON id = xml_meta_id WHERE oaza_name <> '' AND scale_denominator IS NOT NULL AND regexp_matches(chiban, '^\p{Nd}'))
    SELECT a.oaza_name, a.s AS small, b.s AS large, count(*) AS n FROM n a JOIN n b ON a.oaza_name = b.oaza_name AND a.chiban = b.chiban AND a.s < b.s GROUP BY 1, 2, 3""",
)
def _(meta, parcel):
    return stats.numbers_across_scales(parcel, meta)


@query(
    "a18_scale_shares",
    "meta",
    f""", m AS (SELECT scale_denominator AS s, CASE WHEN {_SCALE} >= 100 THEN {_SCALE} END AS n FROM meta WHERE {_ARBITRARY}), t AS (SELECT count(*)::DOUBLE AS total FROM m)
    SELECT kind, maps, maps / total AS share FROM (SELECT 'explicit' AS kind, count(*) FILTER (s IS NOT NULL) AS maps FROM m UNION ALL SELECT 'inferred', count(*) FILTER (s IS NULL AND n IS NOT NULL) FROM m
      UNION ALL SELECT 'conflicting', count(*) FILTER (s <> n) FROM m UNION ALL SELECT 'none', count(*) FILTER (s IS NULL AND n IS NULL) FROM m), t""",
)
def _(meta):
    return stats.scale_shares(meta)


@query("a18_scales_of_maps", "meta frame", "SELECT xml_meta_id, count(DISTINCT s) AS n FROM (SELECT xml_meta_id, scale_denominator AS s FROM frame UNION ALL SELECT id, coalesce(scale_denominator, 500) + id % 2 FROM meta) WHERE s IS NOT NULL GROUP BY 1 HAVING count(DISTINCT s) > 1")
def _(meta, frame):
    other = meta.select(F.col("id").alias("xml_meta_id"), (F.coalesce("scale_denominator", F.lit(500)) + F.col("id") % 2).cast("int").alias("scale_denominator"))
    return stats.maps_of_several_scales(frame.select("xml_meta_id", "scale_denominator").unionByName(other))


@query(
    "j17_listed_parcels",
    "parcel frame",
    """, listed AS (SELECT xml_meta_id AS m, list(DISTINCT fude_id) FILTER (y0::BIGINT % 2 = 0) AS refs FROM parcel GROUP BY 1),
    r AS (SELECT m, unnest(refs) AS f FROM listed) SELECT p.xml_meta_id, p.fude_id, p.x0, coalesce(scale_denominator, round((ur_x - ll_x) / 0.545)::INT) AS scale FROM parcel p JOIN r ON m = p.xml_meta_id AND f = p.fude_id JOIN frame ON frame.xml_meta_id = p.xml_meta_id""",
)
def _(parcel, frame):
    refs = parcel.where("cast(y0 as bigint) % 2 = 0").groupBy("xml_meta_id").agg(F.collect_set("fude_id").alias("parcel_refs"))
    return stats.frame_scales(parcel, frame.join(refs, "xml_meta_id")).select("xml_meta_id", "fude_id", "x0", "scale")


@query(
    "o4_first_places_of_maps",
    "meta parcel lot",
    """, t AS (SELECT DISTINCT parent_no AS query FROM lot WHERE lot_id % 20 = 0), h AS (SELECT query, min(row(xml_meta_id, fude_id, x0)::STRUCT(m BIGINT, f VARCHAR, x DOUBLE)) AS r FROM parcel JOIN t ON contains(chiban, query) GROUP BY 1)
    SELECT query, r.m AS xml_meta_id, r.f AS fude_id, file_name FROM h JOIN meta ON id = r.m""",
)
def _(meta, parcel, lot):
    texts = lot.where("lot_id % 20 = 0").select(F.col("parent_no").alias("query")).distinct()
    return store.with_map(search.first_places(parcel, texts), meta, "file_name").select("query", "xml_meta_id", "fude_id", "file_name")
