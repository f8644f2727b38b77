"""Map XML out of archives within archives, and its elements as rows: header, points, curve vertices, ring references, boundary
points and lines, parcels. ``operators.assemble`` makes polygons of them."""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of one archive: entries, and bytes it may hold when inflated.
MAX_ENTRIES, MAX_BYTES = 20_000, 1 << 30


class _Budget:
    def __init__(self):
        self.entries, self.bytes = 0, 0


def _walk(name: str, content: bytes, on_bad_inner: str, bad: set[tuple[str, int]], budget: _Budget | None) -> Iterator[tuple[str, bytes]]:
    """(label, content) of the XML files of an archive and of those in it, an entry at a time. With a ``budget`` the entries are checked: limits, names and
    checksums; contents are then read in pieces and not given, and inner archives that are broken go to ``bad``, if they may. Without one, those in ``bad`` are passed over."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for info in archive.infolist():
            path = posixpath.normpath(info.filename.replace("\\", "/"))
            label, inner = f"{name}/{path}", path.lower().endswith(".zip")
            if budget:
                budget.entries += 1
                if budget.entries > MAX_ENTRIES:
                    raise ValueError("too many entries")
                if path.startswith(("/", "..")) or ":" in path.split("/")[0]:
                    raise ValueError(f"entry leaves the archive: {info.filename}")
            if info.is_dir() or not (inner or path.lower().endswith(".xml")):
                continue
            pieces = []
            with archive.open(info) as entry:
                while piece := entry.read(1 << 20):
                    if budget:
                        budget.bytes += len(piece)
                        if budget.bytes > MAX_BYTES:
                            raise ValueError("too large when inflated")
                    if inner or not budget:
                        pieces.append(piece)
            if not inner:
                yield label, b"".join(pieces)
            elif (label, info.header_offset) not in bad:
                try:
                    yield from _walk(label, b"".join(pieces), on_bad_inner, bad, budget)
                except zipfile.BadZipFile:
                    if on_bad_inner == "fail":
                        raise
                    bad.add((label, info.header_offset))


def _expand(name: str, content: bytes, on_bad_inner: str) -> Iterator[tuple[str, bytes]]:
    """Files of an archive, which is checked to its end before the first one is given: so none is given of an archive that fails, and no more than one
    inflated file, and the inner archives round it, are held at a time."""
    bad: set[tuple[str, int]] = set()
    for _ in _walk(name, content, on_bad_inner, bad, _Budget()):
        pass
    yield from _walk(name, content, on_bad_inner, bad, None)


def expand_archives(archives: DataFrame, on_bad_inner: str = "fail") -> DataFrame:
    """(archive, source_name, content, error) of the XML files in (archive, content), at any depth. An archive that
    is broken, too large or unsafe gives one row with its error and no content. Archives are inflated twice, once to check them and once for their files, so that a task holds the packed archive and
    one inflated file at a time."""
    kinds = {"archive": pa.string(), "source_name": pa.string(), "content": pa.binary(), "error": pa.string()}

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        try:
            for label, data in _expand(name, content, on_bad_inner):
                yield name, label, data, None
        except (ValueError, zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, zlib.error) as e:
            yield name, None, None, str(e) or type(e).__name__

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                for row in rows(name.as_py(), content.as_py() or b""):  # one file a batch
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds.values(), strict=True)], names=list(kinds))

    return archives.select("archive", "content").mapInArrow(expand, "archive string, source_name string, content binary, error string")


def read_archives(spark: SparkSession, path: str, pattern: str = "*.zip", on_bad_inner: str = "fail") -> DataFrame:
    """``expand_archives`` of the archives below ``path``, whose names count from there on; archives are dealt over tasks, one a partition where there are tasks for it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return expand_archives(files.select(relative_to(path).alias("archive"), "content"), on_bad_inner)


def relative_to(folder: str) -> Column:
    """The column ``path`` of files below ``folder``, from there on. Both are taken literally, apart from a scheme in front."""
    bare = lambda c: F.regexp_replace(c, "^[A-Za-z][A-Za-z0-9+.-]*:/*|^/+", "")
    whole, root = bare(F.col("path")), bare(F.lit(folder.rstrip("/") + "/"))
    return F.when(F.startswith(whole, root), F.substring(whole, F.char_length(root) + 1, F.char_length(whole))).otherwise(whole)


def read_directory(spark: SparkSession, path: str, pattern: str = "*.xml", recursive: bool = True) -> DataFrame:
    """(source_name, content) of the files below ``path``; the label is the path from there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(relative_to(path).alias("source_name"), "content")


#: Name spaces, and the tags of header and parcel fields.
MAP_SPACE, SHAPE_SPACE = "http://www.moj.go.jp/MINJI/tizuxml", "http://www.moj.go.jp/MINJI/tizuzumen"
HEADER = {
    "map_name": "地図名", "municipality_code": "市区町村コード", "municipality_name": "市区町村名", "crs_type": "座標系", "geodetic_type": "測地系判別",
    "transform_program": "変換プログラム", "transform_version": "変換プログラムバージョン", "param_version": "変換パラメータバージョン", "scale_denominator": "縮尺分母",
}
PARCEL = {
    "oaza_code": "大字コード", "oaza_name": "大字名", "chome_code": "丁目コード", "koaza_code": "小字コード", "yobi_code": "予備コード", "chiban": "地番", "coord_type": "座標値種別",
}


def _tree(content: bytes) -> ElementTree.Element:
    """The root of a document. Declarations of entities, and references to what lies outside, are refused where the parser meets them,
    whatever the document's encoding."""

    def refuse(*_):
        raise ValueError("entity declarations and external references are refused")

    builder, parser = ElementTree.TreeBuilder(), expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    full = lambda name: "{" + name if "}" in name else name
    parser.StartElementHandler = lambda name, attributes: builder.start(full(name), attributes)
    parser.EndElementHandler, parser.CharacterDataHandler = lambda name: builder.end(full(name)), builder.data
    parser.EntityDeclHandler = parser.UnparsedEntityDeclHandler = parser.ExternalEntityRefHandler = refuse
    parser.StartDoctypeDeclHandler = lambda name, system, public, inner: refuse() if system or public else None
    parser.Parse(content, True)
    return builder.close()


def _number(element: ElementTree.Element | None) -> float | None:
    try:
        return float(element.text)
    except (AttributeError, TypeError, ValueError):
        return None


def _scale(text: str | None) -> str | None:
    try:
        return str(n) if (n := int(text or "")) > 0 else None
    except ValueError:
        return None


def _own(tag: str) -> str:
    return f"{{{MAP_SPACE}}}{tag}"


def _shape(tag: str) -> str:
    return f"{{{SHAPE_SPACE}}}{tag}"


_POINT, _CURVE, _SURFACE, _X, _Y = (_shape(t) for t in ("GM_Point", "GM_Curve", "GM_Surface", "X", "Y"))
_COLUMN, _DIRECT, _INDIRECT, _POINT_REF = (_shape(t) for t in ("GM_PointArray.column", "GM_Position.direct", "GM_Position.indirect", "GM_PointRef.point"))
_EXTERIOR, _INTERIOR, _GENERATOR = (_shape(t) for t in ("GM_SurfaceBoundary.exterior", "GM_SurfaceBoundary.interior", "GM_CompositeCurve.generator"))
_PARCEL, _MARK, _LINE, _FORM, _LINE_TYPE, _MARK_NAME = (_own(t) for t in ("筆", "筆界点", "筆界線", "形状", "線種別", "点番名"))
_TAGS, _PARCEL_TAGS = {_POINT, _CURVE, _SURFACE, _PARCEL, _MARK, _LINE}, {k: _own(t) for k, t in PARCEL.items()}


def _parsed(name: str, content: bytes) -> Iterator[tuple]:
    """Rows (source_name, kind, id, doc_seq, ring_no, seq, ref, x, y, fields); ``doc_seq`` is the element's place in the document."""
    root = _tree(content)
    first: dict[str, str] = {}
    for doc_seq, e in enumerate(root.iter()):
        tag = e.tag
        if tag not in _TAGS:
            first.setdefault(tag, e.text or "")
            continue
        key = e.get("id", "")
        if tag == _POINT and key:
            x, y = (_number(next(e.iter(a), None)) for a in (_X, _Y))
            if x is not None and y is not None:
                yield name, "point", key, doc_seq, 0, 0, "", x, y, None
        elif tag == _CURVE and key:
            yield name, "curve", key, doc_seq, 0, -1, "", None, None, None
            for seq, column in enumerate(e.iter(_COLUMN)):
                direct, ref = next(column.iter(_DIRECT), None), next((p for i in column.iter(_INDIRECT) for p in i.iter(_POINT_REF)), None)
                if direct is not None:
                    x, y = (_number(direct.find(a)) for a in (_X, _Y))
                    if x is not None and y is not None:
                        yield name, "vertex", key, doc_seq, 0, seq, "", x, y, None
                elif ref is not None:
                    yield name, "vertex", key, doc_seq, 0, seq, ref.get("idref", ""), None, None, None
        elif tag == _SURFACE and key:
            yield name, "surface", key, doc_seq, 0, -1, "", None, None, None
            outer = next(e.iter(_EXTERIOR), None)
            for ring_no, ring in enumerate([outer, *e.iter(_INTERIOR)]):
                refs = [g.get("idref") for g in ring.iter(_GENERATOR)] if ring is not None else []
                for seq, ref in enumerate(r for r in refs if r):
                    yield name, "ring", key, doc_seq, ring_no, seq, ref, None, None, None
        elif tag in (_PARCEL, _MARK, _LINE):
            child = {c.tag: c for c in reversed(e)}  # the first of a tag counts
            text = lambda tag: getattr(child.get(tag), "text", None) or ""  # noqa: E731,B023
            form = child.get(_FORM)
            ref = "" if form is None else form.get("idref", "")
            if tag == _PARCEL and key:
                yield name, "parcel", key, doc_seq, 0, 0, ref, None, None, {k: text(t) for k, t in _PARCEL_TAGS.items()}
            elif tag == _LINE:
                yield name, "boundary_line", "", doc_seq, 0, 0, ref, None, None, {"line_type": text(_LINE_TYPE)}
            elif tag == _MARK and form is not None and _MARK_NAME in child:
                yield name, "boundary_point", "", doc_seq, 0, 0, ref, None, None, {"point_name": text(_MARK_NAME)}
        else:
            first.setdefault(tag, e.text or "")
    fields = {k: first.get(_own(t), "") for k, t in HEADER.items()}
    absent = {k: fields[k] or None for k in ("geodetic_type", "transform_program", "transform_version", "param_version")}
    yield name, "header", "", -1, 0, 0, "", None, None, fields | absent | {"scale_denominator": _scale(fields["scale_denominator"])}


ROWS = "source_name string, kind string, id string, doc_seq long, ring_no int, seq int, ref string, x double, y double, fields map<string,string>"
_TYPES = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.map_(pa.string(), pa.string()))
_NAMES = ["source_name", "kind", "id", "doc_seq", "ring_no", "seq", "ref", "x", "y", "fields"]


def parse_maps(files: DataFrame, batch_rows: int = 50_000) -> DataFrame:
    """Long rows of all elements of (source_name, content), by ``kind``: header (fields; absent text is empty, but null for the geodetic and
    transform fields; scale_denominator only if a whole number above 0), point (id, x, y), curve (id) and its vertex rows (seq; x, y or the
    point referred to), surface (id) and its ring rows (ring_no, 0 outside, seq, curve referred to), boundary_point (fields, ref), boundary_line (fields, ref), parcel (id,
    ref of its surface, fields). Points and curves without id or with unreadable numbers are left out. A file that cannot be parsed
    gives one row of kind ``error`` and no other."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    rows = list(_parsed(name.as_py(), content.as_py() or b""))
                except (expat.ExpatError, ValueError) as e:
                    rows = [(name.as_py(), "error", "", -1, 0, 0, "", None, None, {"error": str(e)})]
                for low in range(0, len(rows), batch_rows):
                    columns = zip(*rows[low : low + batch_rows], strict=True)
                    columns = [pa.array([list(v.items()) if isinstance(v, dict) else v for v in c] if t == _TYPES[-1] else c, t) for c, t in zip(columns, _TYPES, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return files.select("source_name", "content").mapInArrow(parse, ROWS)
