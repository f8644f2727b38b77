"""Costly steps are not left to the few tasks that read a small file, and intermediate tables are made once."""

import glob

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from parcelworks.functions import geom
from parcelworks.operators import assemble, match, spatial, store


def parts_with_rows(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_areas_of_one_row_group_are_read_by_all_tasks(spark):
    rows = spark.range(0, 400, 1, 1).select(F.concat(F.lit("L"), "id").alias("name"), F.concat(F.lit("POLYGON((0 0, "), "id", F.lit(" 0, 1 1))")).alias("wkt"))
    assert parts_with_rows(rows) == 1
    areas = store.areas_from_wkt(rows, "name")
    assert parts_with_rows(areas.where("error IS NULL")) == 4 and areas.where("geom IS NOT NULL").count() == 400


def test_edges_of_shapes_of_one_row_group_are_made_by_all_tasks(spark):
    x = F.col("id").cast("double")
    shapes = spark.range(0, 400, 1, 1).select(F.col("id").alias("key"), geom.rectangle(x, x, x + 1, x + 2).alias("geom"))
    known = spatial._known(shapes, "key", "shape", True)
    assert parts_with_rows(known.where("__shape_is_box")) == 4 and known.where("__shape_is_box").count() == 400


def test_zones_of_rows_are_those_of_expressions(spark):
    from parcelworks.functions import zones

    rows = spark.createDataFrame([(1200.5, -300.25, 9, 8), (-8000.0, 52000.0, 1, 19), (None, 2.0, 3, 4), (1.0, 2.0, 20, 9), (1.0, 2.0, 9, None)], "x double, y double, old int, new int")
    c = [F.col(n) for n in ("x", "y", "old", "new")]
    both = rows.select(zones.zone_of_rows_changed(*c).alias("a"), zones.change_zone(*c).alias("b"), zones.degrees_of_rows(*c[:3]).alias("d"), zones.from_zone(*c[:3]).alias("e")).collect()
    for r in both:
        for fast, slow in ((r.a, r.b), (r.d, r.e)):
            for p, q in zip(fast or (None, None), slow or (None, None), strict=True):
                assert (p is None) == (q is None) and (p is None or abs(p - q) < 1e-6)


def test_counts_of_a_batch_are_not_added_up_in_one_task(spark, tmp_path):
    rows = spark.range(0, 4000).selectExpr("id as xml_meta_id", "string(id) as fude_id", "string(id) as chiban")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert store.append_parcels(rows, f"{tmp_path}/s", ["chiban"]) == (4000, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(glob.glob(f"{tmp_path}/s/counts/batch=0/*.parquet")) == 4


def test_numbers_are_not_parsed_again_where_pairs_are_compared(spark):
    parcels = spark.createDataFrame([(1, "a", "大字1", "12-3W1", ""), (1, "b", "", "19", "松崎町"), (2, "c", "大字2", "道", "")], "xml_meta_id long, fude_id string, oaza_name string, chiban string, municipality_name string")
    lots = spark.createDataFrame([(7, "大字1", "12", "3", ""), (8, "大字9", "11", "", "松崎町"), (9, "大字1", "500", "", "")], "lot_id long, oaza_name string, parent_no string, branch_no string, municipality_name string")
    found = match.number_matches(parcels, lots)
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.fude_id, r.lot_id, r.level) for r in found.collect()) == [("a", 7, "exact"), ("b", 7, "near"), ("b", 8, "near")]


def test_lots_that_have_most_pairs_are_compared_by_all_tasks(spark):
    parcels = spark.range(0, 40).selectExpr("id as xml_meta_id", "string(id) as fude_id", "'' as oaza_name", "string(id + 10) as chiban", "'' as municipality_name")
    lots = spark.range(0, 400, 1, 1).selectExpr("id as lot_id", "'大字1' as oaza_name", "string(10 + id % 10) as parent_no", "'' as branch_no", "'' as municipality_name")
    found = match.number_matches(parcels, lots)
    assert parts_with_rows(found) >= 4 and found.count() == 4000


def test_edges_of_far_shapes_are_not_made(spark):
    x = F.col("id").cast("double")
    shapes = spark.range(0, 400, 1, 1).select(F.col("id").alias("key"), geom.rectangle(x, x, x + 1, x + 2).alias("geom"))
    areas = spark.range(1).select(F.col("id").alias("admin_id"), geom.rectangle(F.lit(10), F.lit(10), F.lit(12), F.lit(12)).alias("geom"))
    near = spatial._known(shapes, "key", "shape", True, spatial._extent(areas))
    assert sorted(r.key for r in near.collect()) == [9, 10, 11, 12] == sorted(r.key for r in spatial.meeting_pairs(shapes, areas).collect())
    assert spatial._known(shapes, "key", "shape", True, spatial._extent(areas.where("admin_id < 0"))).count() == 0


def stored_rows(monkeypatch, module):
    """Numbers of the rows that ``module`` writes from now on, by the table's name."""
    rows, write = {}, module.written

    def written(df, name):
        out = write(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(module, "written", written)
    return rows


def test_parcels_of_maps_that_are_not_asked_get_no_keys(spark, monkeypatch):
    rows = stored_rows(monkeypatch, match)
    parcels = spark.range(0, 4000).selectExpr("id % 400 as xml_meta_id", "string(id) as fude_id", "concat('大字', id % 2) as oaza_name", "string(100 + id % 400) as chiban")
    lots = spark.createDataFrame([(1, "103", ""), (2, "107", ""), (3, "250", ""), (4, "250", ""), (5, "", "")], "lot_id long, parent_no string, branch_no string")
    chosen = spark.createDataFrame([(1, 3, "大字1"), (2, 3, "大字1"), (3, 3, "大字0"), (4, 3, "大字7"), (5, 3, "大字1")], "lot_id long, xml_meta_id long, oaza_name string")
    found = sorted({(r.lot_id, r.xml_meta_id, r.level, r.other_map) for r in match.matches_in_maps(chosen, lots, parcels).collect()})
    assert found == [(1, 3, "exact", False), (2, 3, "near", False), (3, 150, "exact", True)]
    assert rows["parcels-of-asked-maps"] == [10, 10] and rows["numbers-of-districts"] == [200]


def test_matches_in_maps_are_those_of_all_pairs(spark):
    numbers = ["1", "2", "12", "12-3", "13-3-1", "13", "道", "-3", "129", ""]
    parcels = [(m, f"{m}.{n}", f"大字{(m + n) % 2}", c) for m in (1, 2, 3) for n, c in enumerate(numbers) if (m + n) % 3]
    lots = [(i, p, b) for i, (p, b) in enumerate([("1", ""), ("12", "3"), ("12-3", ""), ("13-3", "1"), ("13", "9"), ("11", "3"), ("5", ""), ("-3", ""), ("128", ""), ("777", ""), ("", "3")])]
    chosen = [(i, 1 + i % 3, f"大字{i % 2}") for i, *_ in lots]

    def level(c, p, b):
        parent, _, branch = c.partition("-")
        if not parent or not p:
            return None
        joined = lambda x, y: f"{x}-{y}" if y else x
        return "exact" if joined(parent, branch) == joined(p, b) else "parent" if parent == p else "near" if len(parent) == len(p) and parent[:-1] == p[:-1] else None

    frames = [spark.createDataFrame(r, s) for r, s in ((chosen, "lot_id long, xml_meta_id long, oaza_name string"), (lots, "lot_id long, parent_no string, branch_no string"), (parcels, "xml_meta_id long, fude_id string, oaza_name string, chiban string"))]
    for levels in (("exact",), ("exact", "parent"), ("exact", "parent", "near"), ("near",), ("exact", "near")):
        want = set()
        for (i, p, b), (_, own, district) in zip(lots, chosen, strict=True):
            met = [(match.LEVELS.index(s), m, f, c, s) for m, f, _, c in parcels if (s := level(c, p, b)) in levels]
            here = [x for x in met if x[1] == own]
            maps = {m for m, _, o, _ in parcels if o == district and m != own}
            there = [x for x in met if x[1] in maps]
            want |= {(i, m, f, c, s, not here) for _, m, f, c, s in (here or [x for x in there if x[1] == min(there)[1]])}
        assert {tuple(r) for r in match.matches_in_maps(*frames, levels).collect()} == want


def test_hulls_of_maps_need_neither_a_second_parse_nor_references(spark, monkeypatch):
    rows = stored_rows(monkeypatch, assemble)
    point = lambda f, i, seq, x, y: (f, "point", i, seq, 0, 0, "", float(x), float(y))
    vertex = lambda f, i, seq, n, x, y, ref="": (f, "vertex", i, seq, 0, n, ref, x, y)
    parsed = []
    for n in range(300):
        f = f"f{n}"
        parsed += [point(f, "p", 1, 50, 50), point(f, "p", 2, 0, 0), point(f, "q", 3, n + 1, 0), point(f, "r", 4, 0, n + 1)]  # of points of one id the last counts
        parsed += [(f, "curve", "c", 5, 0, -1, "", None, None), vertex(f, "c", 5, 0, 99.0, 99.0), (f, "curve", "c", 6, 0, -1, "", None, None)]  # and of curves, even without a vertex
        parsed += [(f, "curve", "d", 7, 0, -1, "", None, None), vertex(f, "d", 7, 0, None, None, "q"), vertex(f, "d", 7, 1, -1.0, -1.0), vertex(f, "d", 7, 2, None, None, "none")]
    frame = spark.createDataFrame(parsed, "source_name string, kind string, id string, doc_seq long, ring_no int, seq int, ref string, x double, y double").repartition(16)
    hulls = assemble.map_hulls(frame, swap_xy=False)
    plan = hulls._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "LogicalRDD" not in plan and rows == {"elements": [300 * 9]}
    got = {r.source_name: {(p.x, p.y) for p in r.geom[0]} for r in hulls.collect()}
    assert got == {f"f{n}": {(-1.0, -1.0), (n + 1.0, 0.0), (0.0, n + 1.0)} for n in range(300)}


def test_few_points_of_many_keys_are_not_cut_down(monkeypatch):
    calls = []
    cut = assemble.hull_points
    monkeypatch.setattr(assemble, "hull_points", lambda xy: calls.append(len(xy)) or cut(xy))
    few = pd.DataFrame({"key": [f"k{n % 900}" for n in range(2700)], "x": np.arange(2700.0), "y": np.arange(2700.0) % 7})
    many = pd.DataFrame({"key": "m", "x": np.arange(400.0) % 20, "y": np.arange(400.0) // 20})
    (out,) = assemble._partial(iter([pd.concat([few, many]).sample(frac=1, random_state=1)]))
    assert calls == [400]
    assert sorted(map(tuple, out[out["key"] != "m"].to_numpy())) == sorted(map(tuple, few.to_numpy()))
    assert sorted(map(tuple, out.loc[out["key"] == "m", ["x", "y"]].to_numpy())) == [(0, 0), (0, 19), (19, 0), (19, 19)]


def test_mutual_pairs_of_single_parcels_are_not_compared_for_repeats(spark):
    parcels = [(1, "a", "12"), (1, "b", "12-3"), (1, "c", "13"), (1, "d", "50"), (1, "d", "50"), (1, "e", "51W1"), (1, "f", "道"), (1, "g", ""), (2, "a", "12"), (2, "b", "19")]
    lots = [(5, "12", ""), (6, "50", "8"), (6, "50", "8"), (7, "12", "3")]
    best = [(1, "a", "12", 5, "exact"), (1, "b", "12-3", 5, "parent"), (1, "c", "13", 5, "near"), (1, "d", "50", 6, "parent"), (2, "b", "19", 5, "near"), (2, "a", "12", 5, "exact")]
    frames = [spark.createDataFrame(r, c) for r, c in ((best, "xml_meta_id long, fude_id string, chiban string, lot_id long, level string"), (parcels, "xml_meta_id long, fude_id string, chiban string"), (lots, "lot_id long, parent_no string, branch_no string"))]
    found = match.mutual_matches(*frames, near=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Aggregate") and "regexp" not in plan  # only one side of the union is made distinct
    want = [(1, 5, "a", "12", "exact"), (1, 5, "a", "12", "parent"), (1, 5, "b", "12-3", "parent"), (1, 5, "c", "13", "near"), (2, 5, "a", "12", "exact"), (2, 5, "b", "19", "near")]
    assert sorted(tuple(r) for r in found.collect()) == want
    # a lot of several numbers shows a pair once
    twice = spark.createDataFrame([*lots, (5, "13", ""), (5, "18", "2")], "lot_id long, parent_no string, branch_no string")
    got = sorted(tuple(r) for r in match.mutual_matches(frames[0], frames[1], twice, near=True).collect())
    more = [(1, 5, "a", "12", "near"), (1, 5, "b", "12-3", "near"), (1, 5, "c", "13", "exact"), (1, 5, "c", "13", "parent"), (2, 5, "a", "12", "near")]
    assert got == sorted(want + more)


def test_parcels_are_compared_with_numbers_and_not_with_lots(spark, monkeypatch):
    rows = stored_rows(monkeypatch, match)
    monkeypatch.setattr(match, "LOTS", 100)
    parcels = spark.createDataFrame([(1, "a", "大字1", "12", ""), (1, "b", "大字1", "12-3", ""), (2, "c", "", "17", ""), (2, "c", "大字1", "17", "")], "xml_meta_id long, fude_id string, oaza_name string, chiban string, municipality_name string")
    lots = spark.range(0, 360).selectExpr("id as lot_id", "'大字1' as oaza_name", "string(if(id < 300, 12, 13)) as parent_no", "if(id < 300, '', '3') as branch_no", "'' as municipality_name")
    odd = spark.createDataFrame([(0, "大字1", "12", "", ""), (None, "大字1", "13", "3", "")], "lot_id long, oaza_name string, parent_no string, branch_no string, municipality_name string")
    found = match.number_matches(parcels, lots.union(odd))
    assert "numbers-of-many-lots" in rows and 4 * 4 <= rows["lots-of-numbers"][0] <= 4 * 5  # in the district and in all, for maps with and without a municipality
    got = sorted((r.fude_id, -1 if r.lot_id is None else r.lot_id, r.level) for r in found.collect())
    low, high = range(300), [-1, *range(300, 360)]
    want = [("a", i, "exact") for i in low] + [("b", i, "parent") for i in low] + [("c", i, "near") for i in low] + [(f, i, "near") for f in "abc" for i in high]
    assert got == sorted(want)
