import io
import zipfile

from parcelworks.sources.archives import expand_archives, parse_maps, read_archives, read_directory
from parcelworks.streaming.incremental import import_new, stored

XML = """<地図 xmlns="http://www.moj.go.jp/MINJI/tizuxml" xmlns:zmn="http://www.moj.go.jp/MINJI/tizuzumen">
<縮尺分母>600</縮尺分母><zmn:GM_Point id="P1"><zmn:X>1.5</zmn:X><zmn:Y>2</zmn:Y></zmn:GM_Point><zmn:GM_Point id="P2"><zmn:X>no</zmn:X></zmn:GM_Point>
<筆 id="H1"><大字名>雲見</大字名><地番>1906-3</地番><形状 idref="F1"/><座標値種別>図上測量</座標値種別></筆><筆><地番>9</地番></筆></地図>""".encode()


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_zip", ".zip"), data)
    return out.getvalue()


def test_archives(spark):
    inner = zipped(a_xml=XML)
    rows = [("one.zip", zipped(sub__b_xml=XML, in_zip=zipped(deep_zip=inner))), ("bad.zip", b"PK no"), ("part.zip", zipped(c_xml=XML, broken_zip=b"no")), ("none.zip", None)]
    escape = io.BytesIO()
    with zipfile.ZipFile(escape, "w") as z:
        z.writestr("../x.xml", XML)
    rows.append(("up.zip", escape.getvalue()))
    frame = spark.createDataFrame(rows, "archive string, content binary")
    out = expand_archives(frame).collect()
    assert {r.source_name for r in out if r.content is not None} == {"one.zip/sub/b.xml", "one.zip/in.zip/deep.zip/a.xml"}
    assert {r.archive for r in out if r.error} == {"bad.zip", "part.zip", "none.zip", "up.zip"}
    assert "part.zip/c.xml" in {r.source_name for r in expand_archives(frame, "skip").collect()}


def test_parse(spark):
    declared = "<!DOCTYPE a [<!ENTITY x 'y'>]><a/>"
    outside = '<!DOCTYPE a SYSTEM "http://example.com/a.dtd"><a/>'
    bad = [("e.xml", declared.encode()), ("u.xml", declared.encode("utf-16")), ("p.xml", (" " * 9000 + declared).lstrip().encode()), ("o.xml", outside.encode()), ("n.xml", None), ("x.xml", b"<a>")]
    frame = spark.createDataFrame([("m.xml", XML), ("d.xml", b"<!DOCTYPE a><a/>"), *bad], "source_name string, content binary")
    rows = parse_maps(frame).collect()
    parcels = [(r.id, r.ref, r.fields) for r in rows if r.kind == "parcel"]
    assert [(i, f, x["chiban"], x["oaza_name"], x["coord_type"], x["koaza_code"]) for i, f, x in parcels] == [("H1", "F1", "1906-3", "雲見", "図上測量", "")]
    assert [(r.id, r.x, r.y) for r in rows if r.kind == "point"] == [("P1", 1.5, 2.0)]
    head = next(r.fields for r in rows if r.kind == "header" and r.source_name == "m.xml")
    assert head["scale_denominator"] == "600" and head["map_name"] == "" and head["geodetic_type"] is None
    assert {r.source_name for r in rows if r.kind == "error"} == {name for name, _ in bad}


def test_directory_and_stream(spark, tmp_path):
    inbox = tmp_path / "in"
    (inbox / "sub").mkdir(parents=True)
    (inbox / "a.xml").write_bytes(XML)
    (inbox / "b.xml").write_bytes(XML)
    (inbox / "sub" / "c.xml").write_bytes(XML + b" ")
    assert {r.source_name for r in read_directory(spark, str(inbox)).collect()} == {"a.xml", "b.xml", "sub/c.xml"}
    go = lambda: import_new(spark, str(inbox), f"{tmp_path}/store", f"{tmp_path}/state")
    go()
    assert stored(spark, f"{tmp_path}/store").count() == 1
    (inbox / "d.xml").write_bytes(XML)
    (inbox / "e.xml").write_bytes(XML + b"  ")
    go()
    assert stored(spark, f"{tmp_path}/store").count() == 2


def test_archives_are_inflated_an_entry_at_a_time(monkeypatch):
    """500 MB of files, some of them in an archive inside: what is held at once is one file, or the packed archives."""
    import tracemalloc

    from parcelworks.sources import archives

    def packed(entries):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in entries:
                z.writestr(name, data)
        return out.getvalue()

    large = b"<a>" + b" " * (20 << 20)
    content = packed([(f"{i}.xml", large) for i in range(13)] + [("in.zip", packed([(f"{i}.xml", large) for i in range(12)]))])
    tracemalloc.start()
    sizes = [len(data) for _, data in archives._expand("z", content, "fail")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [len(large)] * 25 and peak < 4 * len(large)
    monkeypatch.setattr(archives, "MAX_BYTES", 300 << 20)
    given = []
    try:
        given += [label for label, _ in archives._expand("z", content, "fail")]
    except ValueError as e:
        assert "too large" in str(e)
    assert not given  # none of an archive that fails


def test_archives_below_a_folder(spark, tmp_path):
    (tmp_path / "in (1)" / "sub").mkdir(parents=True)
    (tmp_path / "in (1)" / "a.zip").write_bytes(zipped(x_xml=XML))
    (tmp_path / "in (1)" / "sub" / "b.zip").write_bytes(zipped(in_zip=zipped(y_xml=XML), bad_zip=b"no", z_xml=XML))
    read = lambda how: {(r.archive, r.source_name) for r in read_archives(spark, f"{tmp_path}/in (1)", on_bad_inner=how).collect()}
    assert read("skip") == {("a.zip", "a.zip/x.xml"), ("sub/b.zip", "sub/b.zip/in.zip/y.xml"), ("sub/b.zip", "sub/b.zip/z.xml")}
    assert read("fail") == {("a.zip", "a.zip/x.xml"), ("sub/b.zip", None)}
