"""From nested archives to parcel polygons, on files with every hard case; and the incremental import against the batch."""

import io
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from parcelworks.operators import assemble, stats, store
from parcelworks.sources.archives import expand_archives, parse_maps, read_directory
from parcelworks.streaming.incremental import import_new, imported, statuses, stored

DIRECT = "<zmn:GM_PointArray.column><zmn:GM_Position.direct><zmn:X>{}</zmn:X><zmn:Y>{}</zmn:Y></zmn:GM_Position.direct></zmn:GM_PointArray.column>"
POINT = '<zmn:GM_PointArray.column><zmn:GM_Position.indirect><zmn:GM_PointRef.point idref="{}"/></zmn:GM_Position.indirect></zmn:GM_PointArray.column>'


def curve(name, *vertices):
    return f'<zmn:GM_Curve id="{name}">' + "".join(POINT.format(v) if isinstance(v, str) else DIRECT.format(*v) for v in vertices) + "</zmn:GM_Curve>"


def surface(name, *rings):
    kinds = ["exterior"] + ["interior"] * (len(rings) - 1)
    parts = [f"<zmn:GM_SurfaceBoundary.{k}>" + "".join(f'<zmn:GM_CompositeCurve.generator idref="{c}"/>' for c in r) + f"</zmn:GM_SurfaceBoundary.{k}>" for k, r in zip(kinds, rings, strict=True)]
    return f'<zmn:GM_Surface id="{name}">' + "".join(parts) + "</zmn:GM_Surface>"


def parcel(name, shape, chiban="1"):
    return f'<筆 id="{name}"><大字コード>022</大字コード><大字名>雲見</大字名><地番>{chiban}</地番><形状 idref="{shape}"/><座標値種別>図上測量</座標値種別></筆>'


def document(*elements, scale="<縮尺分母>600</縮尺分母>"):
    body = "<地図名>雲見１０００図</地図名><市区町村名>賀茂郡松崎町</市区町村名><座標系>任意座標系</座標系>" + scale + "".join(elements)
    return f'<地図 xmlns="http://www.moj.go.jp/MINJI/tizuxml" xmlns:zmn="http://www.moj.go.jp/MINJI/tizuzumen">{body}</地図>'.encode()


def point(name, x, y):
    return f'<zmn:GM_Point id="{name}"><zmn:X>{x}</zmn:X><zmn:Y>{y}</zmn:Y></zmn:GM_Point>'


HARD = document(
    point("P1", 0, 0), point("P2", 0, 99), point("P2", 0, 10), point("", 1, 1), point("PX", "no", 1),  # of two points the last counts
    curve("C1", "P1", "P2", "missing"), curve("C2", (10, 0), (10, 10), (0, 10)), curve("C3", (10, 0), (0, 0)), curve("C4", (2, 2), (4, 2), (4, 4), (2, 4)), curve("C5", (5, 5), (6, 6)), curve("C6", (7, 7)), curve("C6"),
    surface("F1", ["+C1", "-C2", "none", "C3"], ["+C4"], ["C5"], []),  # joints meet; one hole, a short hole, an empty one
    surface("F2", ["C5"]), surface("F3", ["C4"]), surface("F3", ["C4"], ["C5", "C6"]), surface("F4", ["C6"]),
    parcel("H1", "F1", "1906-3"), parcel("H1", "F2", "again"), parcel("H2", "F2"), parcel("H3", "F9"), parcel("", "F1"), parcel("H4", "F3"),
    "<筆界点><点番名>a</点番名><形状 idref='P1'/></筆界点><筆界点><点番名>b</点番名></筆界点><筆界線><形状 idref='C1'/><線種別>大字界線</線種別></筆界線><筆界線/>",
)


@pytest.fixture(scope="module")
def parsed(spark):
    return parse_maps(spark.createDataFrame([("a/m.xml", HARD), ("b.xml", b"<broken")], "source_name string, content binary")).cache()


def test_polygons_of_hard_elements(parsed):
    rows = {r.fude_id: r for r in assemble.parcels(parsed).collect()}
    ring = lambda r: [(p.x, p.y) for p in r]
    assert set(rows) == {"H1", "H2", "H3", "H4"} and rows["H1"].chiban == "1906-3" and rows["H1"].oaza_code == "022" and rows["H1"].yobi_code == ""
    assert [ring(r) for r in rows["H1"].geom] == [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)]]  # x is north
    assert rows["H1"].area_sqm == 96 and (rows["H2"].geom, rows["H2"].area_sqm, rows["H3"].geom, rows["H3"].area_sqm) == (None, 0, None, 0)
    assert len(rows["H4"].geom) == 1 and rows["H4"].area_sqm == 4


def test_files_are_parsed_once_and_tasks_grow_with_elements(spark, monkeypatch):
    fresh = parse_maps(spark.createDataFrame([("a/m.xml", HARD)], "source_name string, content binary"))
    monkeypatch.setattr(assemble, "ELEMENTS", 4)
    for rows, n in ((assemble.surface_polygons(fresh), 3), (assemble.curve_vertices(fresh).where("curve_id = 'C1'"), 2)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        tasks = [int(x) for x in re.findall(r"RepartitionByExpression \[[^\]]*\], ([0-9]+)", plan)]
        assert "MapInArrow" not in plan and tasks and min(tasks) > 4  # the session's shuffles have four
        assert rows.count() == n


def test_counts_headers_boundaries_status(parsed):
    head = assemble.headers(parsed).collect()
    assert [(r.map_name, r.municipality_name, r.crs_type, r.municipality_code, r.transform_program, r.scale_denominator, r.point_count, r.curve_count, r.fude_count) for r in head] == [
        ("雲見１０００図", "賀茂郡松崎町", "任意座標系", "", None, 600, 2, 6, 5)
    ]
    assert [(r.point_name, r.shape_ref) for r in assemble.boundary_points(parsed).collect()] == [("a", "P1")]
    assert sorted((r.shape_ref, r.line_type) for r in assemble.boundary_lines(parsed).collect()) == [("", ""), ("C1", "大字界線")]
    status = {r.source_name: (r.failed, r.parcels) for r in assemble.file_status(parsed).collect()}
    assert status == {"a/m.xml": (False, 5), "b.xml": (True, 0)}
    assert [r.source_name for r in stats.import_errors(assemble.file_status(parsed)).collect()] == ["b.xml"]
    summary = stats.import_summary(assemble.file_status(parsed)).first()
    assert (summary.processed, summary.failed, summary.parcels, summary.success) == (2, 1, 5, False)


@pytest.mark.parametrize("text,want", [("<縮尺分母>0</縮尺分母><縮尺分母>500</縮尺分母>", None), ("<縮尺分母>x</縮尺分母>", None), ("<縮尺分母> 2500 </縮尺分母>", 2500), ("", None)])
def test_scale_of_header(spark, text, want):
    rows = parse_maps(spark.createDataFrame([("m", document(scale=text))], "source_name string, content binary"))
    assert assemble.headers(rows).first().scale_denominator == want


def brute_hull(points):
    """Corners: points that are no mixture of others, by the half-plane of each pair."""
    points = sorted(set(map(tuple, points)))
    out = set()
    for a in points:
        for b in points:
            side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in points]
            if a != b and min(side) >= -1e-12:
                line = [p for p, s in zip(points, side, strict=True) if abs(s) <= 1e-12]
                out |= {min(line), max(line)}
    return out


def test_hulls(spark):
    rng, rows = np.random.default_rng(3), []
    for k in range(12):
        rows += [(f"k{k}", float(x), float(y)) for x, y in rng.integers(0, 12, (3 + 5 * k, 2))]
    rows += [("two", 0.0, 0.0), ("two", 1.0, 1.0), ("line", 0.0, 0.0), ("line", 1.0, 1.0), ("line", 2.0, 2.0), ("none", None, 1.0)]
    got = {r.key: r.geom for r in assemble.convex_hulls(spark.createDataFrame(rows, "key string, x double, y double").repartition(5)).collect()}
    assert got["two"] is None and got["line"] is None and "none" not in got
    for k in range(12):
        want = brute_hull([r[1:] for r in rows if r[0] == f"k{k}"])
        ring = [] if got[f"k{k}"] is None else [(p.x, p.y) for p in got[f"k{k}"][0]]
        assert set(ring) == want if ring else len(want) < 3
        assert not ring or (ring[0] == ring[-1] and len(ring) == len(want) + 1)


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("_xml", ".xml").replace("_zip", ".zip"), data)
    return out.getvalue()


def test_from_archives_to_polygons(spark):
    square = document(curve("C", (0, 0), (0, 7), (3, 7), (3, 0)), surface("F", ["C"]), parcel("H", "F"))
    outer = zipped(a_xml=square, in_zip=zipped(deep_zip=zipped(b_xml=HARD)))
    frame = spark.createDataFrame([("one.zip", outer), ("two.zip", zipped(c_xml=square)), ("bad.zip", b"no")], "archive string, content binary")
    files = expand_archives(frame).where("error IS NULL")
    hashed = files.withColumn("xml_sha256", F.sha2("content", 256))
    known = hashed.select("source_name", "xml_sha256").limit(0)
    fresh = store.append_new(known, hashed)
    assert sorted(r.source_name for r in fresh.collect()) == ["one.zip/a.xml", "one.zip/in.zip/deep.zip/b.xml"]  # c.xml has the content of a.xml
    parcels = assemble.parcels(parse_maps(files.join(fresh, "source_name", "left_semi")))
    assert sorted((r.source_name, r.fude_id, r.area_sqm) for r in parcels.where("geom IS NOT NULL").collect()) == [
        ("one.zip/a.xml", "H", 21.0), ("one.zip/in.zip/deep.zip/b.xml", "H1", 96.0), ("one.zip/in.zip/deep.zip/b.xml", "H4", 4.0),
    ]
    hulls = {r.source_name: len(r.geom[0]) for r in assemble.map_hulls(parse_maps(files)).collect()}
    assert hulls["one.zip/a.xml"] == 5


def test_import_skips_content_label_and_name(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    go = lambda: import_new(spark, str(inbox), f"{tmp_path}/store", f"{tmp_path}/state", status=f"{tmp_path}/status")
    (inbox / "a.xml").write_bytes(b"1")
    (inbox / "b.xml").write_bytes(b"1")
    go()
    (inbox / "c.xml").write_bytes(b"2")
    (inbox / "d.xml").write_bytes(b"1")
    go()
    go()  # nothing new
    known = stored(spark, f"{tmp_path}/store")
    assert sorted((r.source_name, bytes(r.content)) for r in known.collect()) == [("a.xml", b"1"), ("c.xml", b"2")]
    told = {r.source_name: r.status for r in statuses(spark, f"{tmp_path}/status").collect()}
    assert told == {"a.xml": "imported", "b.xml": "known", "c.xml": "imported", "d.xml": "known"}
    files = spark.createDataFrame([(n, c) for n, c in (("a.xml", "1"), ("b.xml", "1"), ("c.xml", "2"), ("d.xml", "1"))], "source_name string, c string").select("source_name", F.sha2(F.col("c").cast("binary"), 256).alias("xml_sha256"))
    batch = store.append_new(files.limit(0), files)
    assert sorted(r.source_name for r in batch.collect()) == sorted(r.source_name for r in known.collect())


def test_import_parses_and_survives_a_failure(spark, tmp_path, monkeypatch):
    """Folders with odd names; a run that fails after each of its writes leaves what a run without failures does."""
    square = document(curve("C", (0, 0), (0, 7), (3, 7), (3, 0)), surface("F", ["C"]), parcel("H", "F"))

    def read(at, name):
        rows = imported(spark, f"{at}/tables", name)
        return sorted(map(str, rows.select("source_name", *(["fude_id", "area_sqm"] if name == "parcels" else ["map_name", "fude_count"])).collect()))

    ends = []
    for fail_after in (None, 0, 1, 2, 3):
        at = tmp_path / f"in+box (1) %41 {fail_after}"
        (at / "in" / "sub $").mkdir(parents=True)
        (at / "in" / "a.xml").write_bytes(square)
        (at / "in" / "sub $" / "b.xml").write_bytes(square)
        (at / "in" / "broken.xml").write_bytes(b"<broken")
        writes = []

        def failing(self, path, *a, _original=DataFrameWriter.parquet, _after=fail_after, _writes=writes, **k):
            if "/batch=" in path and _after is not None:
                if len(_writes) == _after:
                    _writes.append("failed")
                    raise OSError("lost")
                _writes.append(path)
            return _original(self, path, *a, **k)

        go = lambda at=at: import_new(spark, f"{at}/in", f"{at}/store", f"{at}/state", status=f"{at}/status", tables=f"{at}/tables", recursive=True)
        if fail_after is not None:
            with monkeypatch.context() as m, pytest.raises(Exception, match="lost"):
                m.setattr(DataFrameWriter, "parquet", failing)
                go()
            assert "failed" in writes
        go()
        (at / "in" / "c.xml").write_bytes(HARD)
        (at / "in" / "again.xml").write_bytes(b"<broken")
        go()
        fates = sorted((r.source_name, r.status, r.error is not None) for r in statuses(spark, f"{at}/status").collect())
        ends.append((sorted((r.source_name, bytes(r.content)) for r in stored(spark, f"{at}/store").collect()), fates, read(at, "maps"), read(at, "parcels")))
        assert len(read_directory(spark, f"{at}/in").where("source_name IN ('a.xml', 'c.xml')").collect()) == 2
    assert ends[0][1] == [("a.xml", "imported", False), ("again.xml", "failed", True), ("broken.xml", "failed", True), ("c.xml", "imported", False), ("sub $/b.xml", "known", False)]
    assert [n for n, _ in ends[0][0]] == ["a.xml", "c.xml"] and len(ends[0][2]) == 2 and len(ends[0][3]) == 5
    assert all(end == ends[0] for end in ends)


def test_layer_of_polygons(spark, tmp_path):
    spark.createDataFrame([("雲見", "POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"), (None, "POLYGON((0 0, 1 0, 1 1, 0 0))"), ("x", None)], "S_NAME string, wkt string").write.parquet(f"{tmp_path}/layer")
    rows = store.load_areas(spark, f"{tmp_path}/layer", "S_NAME").collect()
    assert [(r.name, len(r.geom[0][0])) for r in rows] == [("雲見", 5)]
