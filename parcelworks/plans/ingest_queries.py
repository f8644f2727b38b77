"""Queries on map files: parsing, assembly, hulls. The files are written by Spark from the driver's tables (``fixtures.map_files``); the oracles
know what must come of them from the same tables, without any XML."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.functions.geom import polygon_box
from parcelworks.operators import assemble
from parcelworks.plans.fixtures import archives, map_files
from parcelworks.plans.registry import file_query, query
from parcelworks.sources import scratch
from parcelworks.sources.archives import expand_archives, parse_maps, read_directory
from parcelworks.streaming.incremental import decide

_HOLED, _INDIRECT = "CAST(y0 AS BIGINT) % 5 = 0", "CAST(y0 AS BIGINT) % 2 = 0"
_ROWS = "SELECT file_name AS source_name, * EXCLUDE (file_name) FROM sheet"


def _parsed(spark, sf_dir) -> DataFrame:
    return parse_maps(map_files(spark, sf_dir))


@file_query("s3_headers", "SELECT DISTINCT file_name AS source_name, map_name, '' AS municipality_code, municipality_name, crs_type, NULL::VARCHAR AS geodetic_type, scale_denominator FROM sheet")
def _(spark, sf_dir):
    return assemble.headers(_parsed(spark, sf_dir)).select("source_name", "map_name", "municipality_code", "municipality_name", "crs_type", "geodetic_type", "scale_denominator")


@file_query("s4_parsed_parcels", f"SELECT source_name, fude_id, '' AS oaza_code, oaza_name, (CAST(y0 AS BIGINT) % 3)::VARCHAR AS koaza_code, chiban, coord_type, 'F' || fude_id AS shape_ref FROM ({_ROWS})")
def _(spark, sf_dir):
    return assemble.parcels(_parsed(spark, sf_dir)).select("source_name", "fude_id", "oaza_code", "oaza_name", "koaza_code", "chiban", "coord_type", "shape_ref")


@file_query(
    "s5_parsed_geometry",
    f"""SELECT source_name, count(*) * 4 AS points, sum(CASE WHEN {_INDIRECT} THEN 6 ELSE 0 END)::BIGINT AS references_to_points, sum(CASE WHEN {_INDIRECT} THEN 0 ELSE 6 END + CASE WHEN {_HOLED} THEN 4 ELSE 0 END)::BIGINT AS vertices,
      sum(2 + CASE WHEN {_HOLED} THEN 1 ELSE 0 END)::BIGINT AS ring_refs FROM ({_ROWS}) GROUP BY 1""",
)
def _(spark, sf_dir):
    kind, by_point = F.col("kind"), F.col("x").isNull()
    return _parsed(spark, sf_dir).groupBy("source_name").agg(
        F.count_if(kind == "point").alias("points"), F.count_if((kind == "vertex") & by_point).alias("references_to_points"),
        F.count_if((kind == "vertex") & ~by_point).alias("vertices"), F.count_if(kind == "ring").alias("ring_refs"),
    )


@file_query(
    "s6_boundaries",
    f"""SELECT source_name, 'line' AS kind, CASE WHEN oaza_name = '' THEN '大字界線' ELSE '筆界線' END AS name, count(*) AS n FROM ({_ROWS}) GROUP BY 1, 3
      UNION ALL SELECT source_name, 'point', chiban, count(*) FROM ({_ROWS}) GROUP BY 1, 3""",
)
def _(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    lines = assemble.boundary_lines(parsed).groupBy("source_name", F.lit("line").alias("kind"), F.col("line_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return lines.unionByName(assemble.boundary_points(parsed).groupBy("source_name", F.lit("point").alias("kind"), F.col("point_name").alias("name")).agg(F.count(F.lit(1)).alias("n")))


@file_query("a2_element_counts", f"SELECT source_name, count(*) * 4 AS point_count, sum(2 + CASE WHEN {_HOLED} THEN 1 ELSE 0 END)::BIGINT AS curve_count, count(*) AS fude_count FROM ({_ROWS}) GROUP BY 1")
def _(spark, sf_dir):
    return assemble.element_counts(_parsed(spark, sf_dir))


@file_query(
    "j3_curve_vertices",
    f"""SELECT source_name, 'C' || fude_id || '.1' AS curve_id, 3 AS n, round(y0, 4) AS first_x, round(x0, 4) AS first_y, round(y0 + h, 4) AS last_x, round(x0 + w, 4) AS last_y FROM ({_ROWS})""",
)
def _(spark, sf_dir):
    at = F.struct("seq", "x", "y")
    ends = assemble.curve_vertices(_parsed(spark, sf_dir)).where("curve_id LIKE '%.1'").groupBy("source_name", "curve_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min(at).alias("a"), F.max(at).alias("z"))
    return ends.select("source_name", "curve_id", "n", *[F.round(F.col(f"{e}.{c}"), 4).alias(f"{name}_{c}") for e, name in (("a", "first"), ("z", "last")) for c in "xy"])


@file_query(
    "j4_rings",
    f"""SELECT source_name, 'F' || fude_id AS surface_id, CASE WHEN {_HOLED} THEN 2 ELSE 1 END AS rings, 5 AS outer_points, CASE WHEN {_HOLED} THEN 5 END AS hole_points,
      round(x0, 4) AS min_x, round(y0, 4) AS min_y, round(x0 + w, 4) AS max_x, round(y0 + h, 4) AS max_y FROM ({_ROWS})""",
)
def _(spark, sf_dir):
    shapes = assemble.surface_polygons(_parsed(spark, sf_dir)).withColumn("box", polygon_box(F.col("geom")))
    sides = [F.round(F.col(f"box.{c}"), 4).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    return shapes.select("source_name", "surface_id", F.size("geom").alias("rings"), F.size(F.get("geom", F.lit(0))).alias("outer_points"), F.when(F.size("geom") > 1, F.size(F.get("geom", F.lit(1)))).alias("hole_points"), *sides)


@file_query("j5_parcel_polygons", f"SELECT source_name, fude_id, chiban, round(w * h * CASE WHEN {_HOLED} THEN 15.0 / 16 ELSE 1 END, 6) AS area FROM ({_ROWS})")
def _(spark, sf_dir):
    return assemble.parcels(_parsed(spark, sf_dir)).select("source_name", "fude_id", "chiban", F.round("area_sqm", 6).alias("area"))


@file_query("g1_closed_rings", f"SELECT source_name, count(*) AS polygons, sum(1 + CASE WHEN {_HOLED} THEN 1 ELSE 0 END)::BIGINT AS rings, sum(1 + CASE WHEN {_HOLED} THEN 1 ELSE 0 END)::BIGINT AS closed FROM ({_ROWS}) GROUP BY 1")
def _(spark, sf_dir):
    rings = assemble.surface_polygons(_parsed(spark, sf_dir)).select("source_name", "surface_id", F.explode("geom").alias("r"))
    closed = F.get("r", F.lit(0)) == F.try_element_at("r", F.lit(-1))
    return rings.groupBy("source_name").agg(F.countDistinct("surface_id").alias("polygons"), F.count(F.lit(1)).alias("rings"), F.count_if(closed).alias("closed"))


@file_query("a12_map_hulls", f"SELECT source_name, round(min(x0), 4) AS min_x, round(min(y0), 4) AS min_y, round(max(x0 + w), 4) AS max_x, round(max(y0 + h), 4) AS max_y FROM ({_ROWS}) GROUP BY 1")
def _(spark, sf_dir):
    hulls = assemble.map_hulls(_parsed(spark, sf_dir)).withColumn("box", polygon_box(F.col("geom")))
    return hulls.select("source_name", *[F.round(F.col(f"box.{c}"), 4).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query(
    "t1_file_fates",
    "xml_file",
    """, k AS (SELECT DISTINCT source_name, sha256(content) AS xml_sha256 FROM xml_file WHERE doc_id % 3 = 0), f AS (SELECT DISTINCT source_name, sha256(content) AS xml_sha256 FROM xml_file WHERE doc_id % 3 <> 0),
    open AS (SELECT * FROM f WHERE xml_sha256 NOT IN (SELECT xml_sha256 FROM k) AND source_name NOT IN (SELECT source_name FROM k) AND regexp_extract(source_name, '[^/]*$') NOT IN (SELECT source_name FROM k)),
    one AS (SELECT * FROM open QUALIFY row_number() OVER (PARTITION BY xml_sha256 ORDER BY source_name) = 1), two AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY xml_sha256) = 1)
    SELECT source_name, xml_sha256, CASE WHEN (source_name, xml_sha256) IN (SELECT (source_name, xml_sha256) FROM two) THEN 'new' ELSE 'known' END AS status FROM f""",
)
def _(xml_file):
    files = xml_file.withColumn("xml_sha256", F.sha2(F.col("content").cast("binary"), 256))
    return decide(files.where("doc_id % 3 <> 0"), files.where("doc_id % 3 = 0"))


@file_query(
    "s2_archive_files",
    """SELECT split_part(file_name, '/', 1) AS archive, CASE WHEN sheet_id % 3 = 0 THEN replace(file_name, '/', '/in.zip/') ELSE file_name END AS source_name, NULL::VARCHAR AS error, count(*) AS parcels FROM sheet GROUP BY ALL
      UNION ALL SELECT DISTINCT 'cut-' || split_part(file_name, '/', 1), NULL, 'File is not a zip file', 0 FROM sheet""",
)
def _(spark, sf_dir):
    packed = archives(spark, sf_dir)
    cut = packed.select(F.concat(F.lit("cut-"), "archive").alias("archive"), F.substring("content", 1, 100).alias("content"))  # without its directory an archive fails alone
    files = expand_archives(packed.unionByName(cut))
    parcels = F.regexp_count(F.col("content").cast("string"), F.lit("<筆 "))
    return files.select("archive", "source_name", "error", F.coalesce(parcels, F.lit(0)).cast("long").alias("parcels"))


@file_query("s1_files_of_a_folder", "SELECT sheet_id, 1 AS files, count(*) AS parcels FROM sheet GROUP BY 1")
def _(spark, sf_dir):
    folder = scratch.new_folder(spark, "map-files")
    number = F.regexp_extract("source_name", "s([0-9]+)[.]xml$", 1).cast("long")
    map_files(spark, sf_dir).select(number.alias("sheet_id"), F.col("content").cast("string").alias("value")).write.partitionBy("sheet_id").text(folder)
    parcels = parse_maps(read_directory(spark, folder, "*.txt")).where("kind = 'parcel'")
    label = F.regexp_extract("source_name", "^sheet_id=([0-9]+)/part-[^/]*$", 1).cast("long")  # the path from the folder on
    return parcels.groupBy(label.alias("sheet_id")).agg(F.countDistinct("source_name").alias("files"), F.count(F.lit(1)).alias("parcels"))
