"""Searches and orders that take their whole query set and table."""

import re

from pyspark.sql import functions as F

from parcelworks.functions import numbers
from parcelworks.operators import match, search
from parcelworks.plans import registry
from parcelworks.plans.fixtures import view
from tests.compare import SMALL


def test_all_due_numbers_are_searched(spark):
    lots = view(spark, SMALL, "lot").where("lot_id % 20 = 0").collect()
    parcels = view(spark, SMALL, "parcel").collect()
    want = {}
    for text in {"-".join(x for x in (r.parent_no, r.branch_no) if x) for r in lots}:
        first = min(((p.xml_meta_id, p.fude_id, p.x0, p.y0, p.x0 + p.w, p.y0 + p.h) for p in parcels if text in p.chiban), default=None)
        if first:
            want[text] = first
    got = {r.query: (r.xml_meta_id, r.fude_id, r.min_x, r.min_y, r.max_x, r.max_y) for r in registry.queries()["o4_search_places"](spark, SMALL).collect()}
    assert got == want and any("-" in q for q in want) and any("-" not in q for q in want)


def test_every_map_is_ordered(spark):
    rows = registry.queries()["o3_map_order"](spark, SMALL).collect()
    assert {(r.xml_meta_id, r.chiban) for r in rows} == {(p.xml_meta_id, p.chiban) for p in view(spark, SMALL, "parcel").collect()}
    for m in {r.xml_meta_id for r in rows}:
        mine = sorted((r.n, r.chiban) for r in rows if r.xml_meta_id == m)
        plain = [int(c) for _, c in mine if c.isdigit()]
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and plain == sorted(plain)


# The index and the orders, on hard numbers

HARD = ["12-3", "１２-3", "9" * 20, "8" * 20, "08", "8", "10", "", None, "道", "W12", "w12-3W1", "1-10", "1-9", "1-" + "9" * 25, "0", "00-1", "a" * 300 + "12-3"]


def hard_parcels(spark):
    rows = [(m, f"{m}.{i}", f"d{m}", c, float(m), float(i), 1.0, 2.0) for m in (1, 2) for i, c in enumerate(HARD) if m == 1 or i % 2]
    return spark.createDataFrame(rows, "xml_meta_id long, fude_id string, oaza_name string, chiban string, x0 double, y0 double, w double, h double")


def key(chiban):
    out = []
    for p in re.split("[-－ー]", chiban or ""):
        digits = re.match("[0-9]*", p.translate(str.maketrans("０１２３４５６７８９", "0123456789")))[0]
        out.append((0, int(digits), p[len(digits) :]) if digits else (1, 0, p))
    return out


def test_numbers_of_any_length_are_ordered(spark):
    rows = search.natural_order(hard_parcels(spark)).collect()
    for m in (1, 2):
        mine = [r.chiban for r in sorted((r for r in rows if r.xml_meta_id == m), key=lambda r: r.n)]
        assert sorted(r.n for r in rows if r.xml_meta_id == m) == list(range(1, len(mine) + 1))
        assert [key(c) for c in mine] == sorted(key(c) for c in {c for i, c in enumerate(HARD) if m == 1 or i % 2})


def test_youngest_number_of_any_length_names_a_set(spark):
    rows = [(1, "d", "5"), (1, "d", "9" * 20), (2, "d", "8" * 21), (2, "d", "7" * 21 + "-1"), (3, "d", "道"), (3, "d", "1000000"), (4, "d", "7-1"), (4, "d", "7"), (5, "d", None), (6, "d", "03"), (6, "d", "12")]
    got = {r.xml_meta_id: r.export_name for r in match.export_names(spark.createDataFrame(rows, "xml_meta_id long, oaza_name string, chiban string")).collect()}
    assert got == {1: "d_5他", 2: f"d_{'7' * 21}-1他", 3: "d_道他", 4: "d_7他", 5: "d", 6: "d_03他"}  # words count as 999999


def test_a_hot_district_is_ranked_in_bounded_tasks(spark):
    """Places of 60,000 numbers of one district and few of others: no partition holds much more than its share."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 1000 == 0, F.concat(F.lit("z"), F.col("id") % 7)).otherwise("hot").alias("oaza_name"), F.col("id").cast("string").alias("chiban"))
    rows = rows.unionByName(spark.createDataFrame([(None, "1"), (None, "2")], "oaza_name string, chiban string")).withColumn("k", numbers.natural_key(F.col("chiban")))
    got = search.positions(rows, ["oaza_name"], ["k"]).select("oaza_name", "chiban", "n").toPandas()
    for name, part in got.groupby("oaza_name", dropna=False):
        part = part.sort_values("n")
        assert part["n"].tolist() == list(range(1, len(part) + 1)) and part["chiban"].astype(int).is_monotonic_increasing, name
    sizes = [r["count"] for r in rows.repartitionByRange(8, "oaza_name", "k").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 60_000 / 8


def test_index_finds_what_a_scan_does(spark, tmp_path):
    parcels = hard_parcels(spark)
    search.write_number_index(parcels, f"{tmp_path}/index", "oaza_name", "xml_meta_id", "fude_id", buckets=8)
    for text in ("12", "2-3", "12-3", "W1", "w12", "9", "-", "道", "zzz", "12-3w1", "", "9" * 20, "1-99", "aaaa", "a12-"):
        got = sorted(r.fude_id for r in search.search_index(spark, f"{tmp_path}/index", text).collect())
        want = sorted(r.fude_id for r in search.search_numbers(parcels, text, limit=1000).collect())
        assert got == want, text
    plan = search.search_index(spark, f"{tmp_path}/index", "12-3")._jdf.queryExecution().executedPlan().toString()
    scans = {part.split("]")[0].lstrip(" ["): part for part in plan.split("FileScan parquet")[1:]}
    lists = next(part for columns, part in scans.items() if columns.startswith("gram"))
    assert len(scans) == 2 and "In(gram, [12-,2-3])" in lists and re.search(r"PartitionFilters: \[[^\]]*bucket#\d+", lists)


def test_texts_meet_only_numbers_with_their_rarest_gram(spark):
    parcels = hard_parcels(spark)
    texts = ["12", "2-3", "12-3", "W1", "道", "zzz", "", "9" * 20, "1-9", "8", "12-", None, "12-3W1"]
    got = {r.query: (r.xml_meta_id, r.fude_id) for r in search.first_places(parcels, spark.createDataFrame([(t,) for t in texts], "query string")).collect()}
    rows = parcels.collect()
    want = {t: min((r.xml_meta_id, r.fude_id) for r in rows if r.chiban and t.lower() in r.chiban.lower()) for t in texts if t and any(r.chiban and t.lower() in r.chiban.lower() for r in rows)}
    assert got == want and len(want) == 10


def test_suggestions_are_read_from_their_table(spark, tmp_path):
    parcels = hard_parcels(spark).unionByName(hard_parcels(spark).withColumn("chiban", F.concat("chiban", F.lit("-7"))))
    search.write_prefixes(parcels, f"{tmp_path}/prefixes", files=3)
    for prefix in ("", "1", "1-", "12-3", "9", "道", "nothing", "a"):
        want = [(r.oaza_name, r.chiban) for r in search.suggestions(parcels, prefix).collect()]
        assert [(r.oaza_name, r.chiban) for r in search.suggest(spark, f"{tmp_path}/prefixes", prefix).collect()] == want, prefix
    plan = search.prefix_table(parcels)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "EqualTo(prefix,1)" in search.suggest(spark, f"{tmp_path}/prefixes", "1")._jdf.queryExecution().executedPlan().toString()


def test_municipalities_by_ends_and_parts(spark):
    names = ["静岡県賀茂郡松崎町", "賀茂郡松崎町", "松崎町", "西町", "x", "", None, "東京都港区"]
    refs = [("松崎町", 5), ("崎町", 2), ("町", 9), ("静岡県賀茂郡西町", 3), ("港区", 1), ("x", 8), ("ax", 0)]
    rows = match.municipality_matches(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(refs, "ref string, ord int")).collect()
    normal = lambda n: re.sub("^.*?県", "", re.sub("^.*?郡", "", n))
    want = {}
    for n in names:
        fits = [(n != r, o, r) for r, o in refs if n == r or normal(n or "").endswith(r) or r.endswith(normal(n or ""))]
        if fits:
            want[n] = min(fits)[2]
    assert {r.name: r.ref for r in rows} == want and len(rows) == len(want)
    lots = ["松崎町", "松", "", None, "西町", "西町", "zz"]
    got = {r.municipality_name: r.n for r in match.lots_of_municipalities(spark.createDataFrame([(n,) for n in names], "municipality_name string"), spark.createDataFrame([(n,) for n in lots], "municipality_name string")).collect()}
    assert got == {n: sum(not n or not lot or lot in n for lot in lots) for n in names}
