"""Cadastral tables derived from the driver's tables. The text runs in Spark and in DuckDB."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = {"meta": ("supplier", "nation"), "parcel": ("lineitem",), "lot": ("part",), "admin": ("nation",), "frame": ("supplier",), "xml_file": ("documents",), "ring": ("embeddings",), "sheet": ("part",), "layer": ("part",)}



def _at(dx: int, dy: int, rest: str = "") -> str:
    """SQL text of a point of ``layer``."""
    return f"concat(cast(x + {dx} as string), ' ', cast(y + {dy} as string), '{rest}')"


def _ring(x0: int, y0: int, x1: int, y1: int, rest: str = "") -> str:
    return ", ', ', ".join(_at(dx, dy, rest) for dx, dy in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)))


SQL = {
    "meta": """select cast(s_suppkey as bigint) as id,
 concat('z', cast(s_nationkey as string), '.zip/m', cast(s_suppkey as string), '.xml') as file_name,
 concat('松崎町大字', cast(s_suppkey % 22 as string), '区', case s_suppkey % 4 when 0 then '１０００図無Ｈ２１' when 1 then '６００図有' when 2 then '－３図無' else '図' end) as map_name,
 concat(case s_nationkey % 3 when 0 then '賀茂郡' when 1 then '静岡県賀茂郡' else '' end, n_name, '町') as municipality_name,
 case when s_suppkey % 6 = 0 then concat('公共座標', cast(s_suppkey % 23 as string), '系') else '任意座標系' end as crs_type,
 case s_suppkey % 8 when 0 then null when 1 then 500 when 2 then 600 when 3 then 1000 when 4 then 1200 when 5 then 2500 when 6 then 3000 else 5000 end as scale_denominator
 from supplier join nation on s_nationkey = n_nationkey""",
    "parcel": """select cast(l_suppkey as bigint) as xml_meta_id,
 concat('H', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as fude_id,
 case when l_partkey % 50 = 0 then '' else concat('大字', cast(l_suppkey % 22 as string)) end as oaza_name,
 case when l_partkey % 41 = 0 then '道' when l_partkey % 43 = 0 then '水' when l_partkey % 97 = 0 then '筆界未定地'
  else concat(cast(1 + l_partkey % 997 as string),
   case when l_linenumber > 2 then concat('-', cast(l_linenumber as string)) else '' end,
   case cast(l_quantity as int) % 10 when 0 then 'W1' when 1 then 'X(1/4)' when 2 then '-内' when 3 then '-内W1' else '' end) end as chiban,
 case when l_suppkey % 6 = 0 then '測量成果' else '図上測量' end as coord_type,
 l_extendedprice / 100 as x0, cast(l_partkey as double) as y0, cast(l_quantity as double) as w, cast(l_linenumber + l_tax as double) as h
 from lineitem""",
    "lot": """select cast(p_partkey as bigint) as lot_id, concat('大字', cast(p_partkey % 22 as string), case when p_size % 3 = 0 then '小字' else '' end) as oaza_name,
 concat('NATION_', cast(p_partkey % 25 as string), '町') as municipality_name,
 cast(1 + p_partkey % 997 as string) as parent_no,
 case when p_size % 2 = 0 then '' else cast(p_size % 8 as string) end as branch_no,
 cast(p_partkey as double) * 10 as cx, p_retailprice as cy from part""",
    "admin": """select cast(n_nationkey as bigint) as admin_id, concat('大字', cast(n_nationkey % 22 as string)) as name,
 cast(n_nationkey % 5 as double) * 210 as min_x,
 cast(n_nationkey % 5 as double) * 210 + case when n_nationkey % 2 = 0 then 190 else 220 end as max_x,
 cast((n_nationkey - n_nationkey % 5) as double) * 80 as min_y,
 cast((n_nationkey - n_nationkey % 5) as double) * 80 + case when n_nationkey % 3 = 0 then 380 else 410 end as max_y
 from nation""",
    "frame": """select xml_meta_id, cast(10 as double) as ll_x, cast(20 as double) as ll_y,
 10 + cast(545 as double) * sc / 1000 as ur_x, 20 + cast(450 as double) * sc / 1000 as ur_y,
 case when xml_meta_id % 8 = 0 then null else sc end as scale_denominator
 from (select cast(s_suppkey as bigint) as xml_meta_id, case s_suppkey % 8 when 0 then 600 when 1 then 500 when 2 then 600
  when 3 then 1000 when 4 then 1200 when 5 then 2500 when 6 then 3000 else 5000 end as sc from supplier) s""",
    "sheet": """select concat('H', cast(p_partkey as string)) as fude_id, cast(floor(p_partkey / 40) as bigint) as sheet_id,
 concat('z', cast(cast(floor(p_partkey / 400) as bigint) as string), '.zip/s', cast(cast(floor(p_partkey / 40) as bigint) as string), '.xml') as file_name,
 concat('松崎町大字', cast(cast(floor(p_partkey / 40) as bigint) % 22 as string), '区') as map_name, concat('賀茂郡', cast(cast(floor(p_partkey / 40) as bigint) % 7 as string), '町') as municipality_name,
 case when cast(floor(p_partkey / 40) as bigint) % 6 = 0 then '公共座標8系' else '任意座標系' end as crs_type,
 case cast(floor(p_partkey / 40) as bigint) % 4 when 0 then null when 1 then 500 when 2 then 600 else 1000 end as scale_denominator,
 case when p_partkey % 50 = 0 then '' else concat('大字', cast(cast(floor(p_partkey / 40) as bigint) % 22 as string)) end as oaza_name,
 case when p_partkey % 41 = 0 then '道' else concat(cast(1 + p_partkey % 997 as string), case when p_size % 3 = 0 then concat('-', cast(p_size % 8 as string)) else '' end) end as chiban,
 case when p_size % 2 = 0 then '測量成果' else '図上測量' end as coord_type,
 cast(p_retailprice as double) as x0, cast(p_partkey % 97 as double) as y0, cast(1 + p_size % 30 as double) as w, cast(2 + p_partkey % 7 as double) / 4 as h
 from part""",
    "layer": f"""select layer_id, x, y, kind, concat('L', cast(layer_id as string)) as name, case kind when 0 then 'POLYGON EMPTY'
  when 1 then concat('POLYGON((', {_ring(0, 0, 20, 10)}, '))') when 2 then concat('MULTIPOLYGON(((', {_ring(0, 0, 5, 5)}, ')), ((', {_ring(10, 10, 14, 14)}, ')))')
  when 3 then concat('polygon z ((', {_ring(0, 0, 20, 20, " 5")}, '),(', {_ring(4, 4, 8, 8, " 5")}, '))')
  when 4 then concat('POLYGON ((', {_at(0, 0)}, ', ', {_at(20, 0)}, ', ', {_at(20, 5)}, ', ', {_at(5, 5)}, ', ', {_at(5, 20)}, ', ', {_at(0, 20)}, '))')
  when 5 then concat('POLYGON((', {_at(0, 0)}, ', ', {_at(1, 0)}, ' oops))') when 6 then concat('LINESTRING(', {_at(0, 0)}, ', ', {_at(1, 1)}, ')')
  else concat('MULTIPOLYGON Z(((', {_ring(0, 0, 6, 6, " 1")}, '), (', {_ring(1, 1, 2, 2, " 1")}, ')), ((', {_ring(10, 0, 20, 6, " 1")}, '), (', {_ring(12, 1, 15, 3, " 1")}, ')))') end as wkt
 from (select cast(p_partkey as bigint) as layer_id, cast(p_partkey % 40 as bigint) * 30 as x, cast(floor(p_partkey / 40) as bigint) * 30 as y, cast(p_partkey % 8 as bigint) as kind from part) p""",
    "xml_file": """select doc_id, concat('z', cast(doc_id % 20 as string), '.zip/d', cast(doc_id % 900 as string), '.xml') as source_name,
 text as content from documents""",
}


#: What the XML of a row of ``sheet`` is made of: a parcel is a rectangle whose ring is one curve forwards and one backwards, every second one by points, every
#: fifth with a hole of a sixteenth of its size. X is north in the files.
INDIRECT, HOLED = "cast(y0 as bigint) % 2 = 0", "cast(y0 as bigint) % 5 = 0"


def _tag(name: str, text: str, space: str = "zmn:") -> str:
    return f"concat('<{space}{name}>', {text}, '</{space}{name}>')"


def _element_sql() -> str:
    """A Spark SQL expression for the elements of one parcel."""
    corners = [("x0", "y0"), ("x0 + w", "y0"), ("x0 + w", "y0 + h"), ("x0", "y0 + h")]
    holes = [("x0 + w / 4", "y0 + h / 4"), ("x0 + w / 2", "y0 + h / 4"), ("x0 + w / 2", "y0 + h / 2"), ("x0 + w / 4", "y0 + h / 2")]
    place = lambda c: f"concat('<zmn:X>', cast({c[1]} as string), '</zmn:X><zmn:Y>', cast({c[0]} as string), '</zmn:Y>')"
    point = lambda i: f"concat('<zmn:GM_Point id=\"P', k, '.{i}\">', {place(corners[i])}, '</zmn:GM_Point>')"
    direct = lambda c: f"concat('<zmn:GM_PointArray.column><zmn:GM_Position.direct>', {place(c)}, '</zmn:GM_Position.direct></zmn:GM_PointArray.column>')"
    by_point = lambda i: f"concat('<zmn:GM_PointArray.column><zmn:GM_Position.indirect><zmn:GM_PointRef.point idref=\"P', k, '.{i}\"/></zmn:GM_Position.indirect></zmn:GM_PointArray.column>')"
    vertex = lambda i: f"case when {INDIRECT} then {by_point(i)} else {direct(corners[i])} end"
    curve = lambda name, parts: f"concat('<zmn:GM_Curve id=\"C', k, '.{name}\">', {', '.join(parts)}, '</zmn:GM_Curve>')"
    ref = lambda kind, *names: f"concat('<zmn:GM_SurfaceBoundary.{kind}>', {', '.join(f"'<zmn:GM_CompositeCurve.generator idref=\"{n[0]}C', k, '.{n[1]}\"/>'" for n in names)}, '</zmn:GM_SurfaceBoundary.{kind}>')"
    hole = curve("h", [direct(c) for c in holes])
    shape = f"concat('<zmn:GM_Surface id=\"F', k, '\">', {ref('exterior', '+1', '-2')}, case when {HOLED} then {ref('interior', '+h')} else '' end, '</zmn:GM_Surface>')"
    own = {"大字名": "oaza_name", "小字コード": "cast(cast(y0 as bigint) % 3 as string)", "地番": "chiban", "座標値種別": "coord_type"}
    texts = ", ".join(_tag(t, c, "") for t, c in own.items())
    parcel = f"concat('<筆 id=\"', k, '\">', {texts}, '<形状 idref=\"F', k, '\"/></筆>')"
    line = "concat('<筆界線><形状 idref=\"C', k, '.1\"/><線種別>', case when oaza_name = '' then '大字界線' else '筆界線' end, '</線種別></筆界線>')"
    mark = "concat('<筆界点><点番名>', chiban, '</点番名><形状 idref=\"P', k, '.0\"/></筆界点>')"
    return f"concat({', '.join(point(i) for i in range(4))}, {curve('1', [vertex(0), vertex(1), vertex(2)])}, {curve('2', [vertex(0), vertex(3), vertex(2)])}, case when {HOLED} then {hole} else '' end, {shape}, {mark}, {line}, {parcel})"


def map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_name, content): map files of forty parcels each, written by Spark from ``sheet``."""
    rows = view(spark, sf_dir, "sheet").selectExpr("*", "fude_id as k").selectExpr("*", f"{_element_sql()} as element")
    header = ("file_name", "map_name", "municipality_name", "crs_type", "scale_denominator")
    bodies = rows.groupBy(*header).agg(F.array_join(F.array_sort(F.collect_list("element")), "").alias("body"))
    fields = ", ".join(_tag(t, c, "") for t, c in (("地図名", "map_name"), ("市区町村名", "municipality_name"), ("座標系", "crs_type")))
    scale = f"coalesce({_tag('縮尺分母', 'cast(scale_denominator as string)', '')}, '')"
    head = f"concat('<地図 xmlns=\"http://www.moj.go.jp/MINJI/tizuxml\" xmlns:zmn=\"http://www.moj.go.jp/MINJI/tizuzumen\">', {fields}, {scale})"
    return bodies.selectExpr("file_name as source_name", f"cast(concat({head}, body, '</地図>') as binary) as content")


def _zipped(files: pd.DataFrame) -> pd.DataFrame:
    """One archive of its map files; every third one lies in an archive inside it."""
    outer, inner = io.BytesIO(), io.BytesIO()
    name = files["archive"].iloc[0]
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as out:
        with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as within:
            for label, content, deep in zip(files["source_name"], files["content"], files["deep"], strict=True):
                (within if deep else out).writestr(label.removeprefix(f"{name}/"), content)
        out.writestr("in.zip", inner.getvalue())
    return pd.DataFrame({"archive": [name], "content": [outer.getvalue()]})


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(archive, content): the map files packed by the first part of their label, ten an archive."""
    number = F.regexp_extract("source_name", "s([0-9]+)[.]xml$", 1).cast("long")
    files = map_files(spark, sf_dir).withColumns({"archive": F.regexp_extract("source_name", "^[^/]+", 0), "deep": number % 3 == 0})
    return files.groupBy("archive").applyInPandas(_zipped, "archive string, content binary")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for source in SOURCES[name]:
        spark.read.parquet(f"{sf_dir}/{source}.parquet").createOrReplaceTempView(source)
    return spark.sql(SQL[name])


def oracle(names: str, query: str) -> str:
    """``query`` with the derived tables it names as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split()) + "\n" + query
