"""Counts and audit statistics on maps and parcels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.functions.maps import crs_short, frame_scale, is_arbitrary, normalize_municipality, scale_from_name
from parcelworks.functions.numbers import natural_key, normalize_number, number_class, parent_of


def totals(meta: DataFrame, parcels: DataFrame) -> DataFrame:
    """(kind, name, n): maps, parcels, maps by CRS, parcels by district."""
    part = lambda df, kind, name: df.groupBy(F.lit(kind).alias("kind"), name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    out = part(meta, "maps", F.lit("")).union(part(parcels, "parcels", F.lit("")))
    return out.union(part(meta, "crs", F.col("crs_type"))).union(part(parcels.where("oaza_name IS NOT NULL"), "oaza", F.col("oaza_name")))


def dominant_oaza(parcels: DataFrame) -> DataFrame:
    """(xml_meta_id, oaza_name): the most frequent non-empty district of a map, the first by name on ties."""
    counts = parcels.where("oaza_name <> ''").groupBy("xml_meta_id", "oaza_name").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("xml_meta_id").agg(F.min(F.struct(-F.col("n"), "oaza_name"))["oaza_name"].alias("oaza_name"))


def filled_oaza(meta: DataFrame, parcels: DataFrame) -> DataFrame:
    """``meta`` whose empty or null district is the most frequent one of the map's parcels, where there is one."""
    found = dominant_oaza(parcels).select(F.col("xml_meta_id").alias("id"), F.col("oaza_name").alias("__found"))
    joined = meta.join(found, "id", "left")
    return joined.withColumn("oaza_name", F.when(F.coalesce("oaza_name", F.lit("")) == "", F.coalesce("__found", "oaza_name")).otherwise(F.col("oaza_name"))).drop("__found")


def index_entries(parcels: DataFrame, meta: DataFrame) -> DataFrame:
    """(oaza_name, koaza_code, chiban, file_name): the distinct rows of the index. Searches read this flat table; it grows with the parcels
    and is in no one group."""
    rows = parcels.join(meta.select(F.col("id").alias("xml_meta_id"), "file_name"), "xml_meta_id").where("oaza_name <> ''")
    koaza = F.coalesce("koaza_code", F.lit("")) if "koaza_code" in parcels.columns else F.lit("")
    return rows.select("oaza_name", koaza.alias("koaza_code"), "chiban", "file_name").distinct()


def search_index(parcels: DataFrame, meta: DataFrame) -> DataFrame:
    """(oaza_name, entry_count, chiban_list in natural order, file_count, files, koaza) of the index entries, a row a district; ``koaza`` maps each sub-district
    to its numbers in natural order. A row holds a district's distinct numbers: for a search over large districts take
    ``index_entries`` or ``numbered_index``."""
    rows = index_entries(parcels, meta)
    listed = lambda c: F.transform(F.array_sort(F.collect_set(F.struct(natural_key(F.col(c)).alias("k"), F.col(c).alias("c")))), lambda x: x["c"])
    parts = rows.groupBy("oaza_name", "koaza_code").agg(listed("chiban").alias("numbers"))
    koaza = parts.groupBy("oaza_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("koaza_code", "numbers")))).alias("koaza"))
    whole = rows.groupBy("oaza_name").agg(
        F.count(F.lit(1)).alias("entry_count"), listed("chiban").alias("chiban_list"), F.countDistinct("file_name").alias("file_count"), F.sort_array(F.collect_set("file_name")).alias("files")
    )
    return whole.join(koaza, "oaza_name")


def numbered_index(parcels: DataFrame, meta: DataFrame) -> DataFrame:
    """(oaza_name, chiban, order_key): the numbers of each district as rows, with the key that sorts them; no list, no group."""
    return index_entries(parcels, meta).select("oaza_name", "chiban").distinct().withColumn("order_key", natural_key(F.col("chiban")))


def districts_of_numbers(parcels: DataFrame, meta: DataFrame) -> DataFrame:
    """(chiban, districts): the districts of each number, in order of name."""
    return index_entries(parcels, meta).select("chiban", "oaza_name").distinct().groupBy("chiban").agg(F.sort_array(F.collect_list("oaza_name")).alias("districts"))


def normalized_numbers(parcels: DataFrame, meta: DataFrame) -> DataFrame:
    """(oaza_name, normal, chiban): for each normalized number of a district the last of its numbers in natural order."""
    rows = numbered_index(parcels, meta).withColumn("normal", normalize_number(F.col("chiban")))
    return rows.groupBy("oaza_name", "normal").agg(F.max(F.struct("order_key", "chiban"))["chiban"].alias("chiban"))


def map_summary(parcels: DataFrame) -> DataFrame:
    """(xml_meta_id, n, coord_types, oaza_names, min_parent, max_parent) of each map; parents of digits only count."""
    parent = parent_of(F.col("chiban"))
    number = F.when(parent.rlike("^[0-9]+$"), parent.try_cast("bigint"))
    return parcels.groupBy("xml_meta_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.sort_array(F.collect_set("coord_type")), ",").alias("coord_types"),
        F.array_join(F.sort_array(F.collect_set("oaza_name")), ",").alias("oaza_names"),
        F.min(number).alias("min_parent"),
        F.max(number).alias("max_parent"),
    )


def archive_municipality(meta: DataFrame) -> DataFrame:
    """(archive, new_name): archives all of whose maps share one non-empty municipality."""
    rows = meta.where("municipality_name <> ''").withColumn("archive", F.split("file_name", "/")[0])
    one = rows.groupBy("archive").agg(F.min("municipality_name").alias("m"), F.max("municipality_name").alias("x")).where("m = x")
    stem = F.regexp_replace("archive", r"\.zip$", "")
    new = F.when(stem.endswith(F.concat(F.lit("_"), F.col("m"))), F.col("archive")).otherwise(F.concat(stem, F.lit("_"), F.col("m"), F.lit(".zip")))
    return one.select("archive", new.alias("new_name"))


def crs_table(meta: DataFrame) -> DataFrame:
    """(municipality_name, arbitrary, public): numbers of maps."""
    counts = meta.groupBy("municipality_name").agg(F.count_if(is_arbitrary(F.col("crs_type"))).alias("arbitrary"), F.count(F.lit(1)).alias("n"))
    return counts.select("municipality_name", "arbitrary", (F.col("n") - F.col("arbitrary")).alias("public"))


def coord_type_table(parcels: DataFrame) -> DataFrame:
    """(coord_type, maps, parcels), and a row of totals whose coord_type is null."""
    per_map = parcels.groupBy("coord_type", "xml_meta_id").agg(F.count(F.lit(1)).alias("n"))
    kinds = per_map.groupBy("coord_type").agg(F.count(F.lit(1)).alias("maps"), F.sum("n").alias("parcels"))
    whole = per_map.agg(F.lit(None).cast("string").alias("coord_type"), F.countDistinct("xml_meta_id").alias("maps"), F.coalesce(F.sum("n"), F.lit(0)).alias("parcels"))
    return kinds.unionByName(whole)


def shared_by_municipality(parcels: DataFrame, meta: DataFrame) -> DataFrame:
    """(municipality_name, districts, shared, shared_numeric, min_ratio, max_ratio): districts with public and arbitrary maps, the numbers that maps of both
    kinds hold there, and the range of the ratio of their mean areas, public to arbitrary. Parcels have area_sqm."""
    rows = parcels.join(meta.select(F.col("id").alias("xml_meta_id"), "municipality_name", is_arbitrary(F.col("crs_type")).alias("arbitrary")), "xml_meta_id").where("oaza_name <> ''")
    area = lambda a: F.avg(F.when(F.col("arbitrary") == a, F.col("area_sqm")))
    numbers = rows.groupBy("municipality_name", "oaza_name", "chiban").agg(F.bool_or("arbitrary").alias("a"), F.bool_or(~F.col("arbitrary")).alias("p"), area(True).alias("old"), area(False).alias("new"))
    both = F.col("a") & F.col("p")
    ratio = F.when(both & (F.col("old") > 0), F.col("new") / F.col("old"))
    numeric = number_class(F.col("chiban")) == "numeric"
    districts = numbers.groupBy("municipality_name", "oaza_name").agg(
        (F.bool_or("a") & F.bool_or("p")).alias("both"), F.count_if(both).alias("shared"), F.count_if(both & numeric).alias("numeric"), F.min(ratio).alias("low"), F.max(ratio).alias("high")
    )
    return districts.groupBy("municipality_name").agg(
        F.count_if("both").alias("districts"), F.sum("shared").alias("shared"), F.sum("numeric").alias("shared_numeric"), F.min("low").alias("min_ratio"), F.max("high").alias("max_ratio")
    )


def numbers_across_scales(parcels: DataFrame, meta: DataFrame) -> DataFrame:
    """(oaza_name, small, large, n): numeric numbers that maps of two scales of a district share, for each pair of scales."""
    rows = parcels.join(meta.select(F.col("id").alias("xml_meta_id"), "scale_denominator"), "xml_meta_id").where("oaza_name <> '' AND scale_denominator IS NOT NULL")
    rows = rows.where(number_class(F.col("chiban")) == "numeric")
    sets = rows.groupBy("oaza_name", "chiban").agg(F.array_sort(F.collect_set("scale_denominator")).alias("s"))  # a handful of scales a number
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("small"), b.alias("large")))))
    return sets.where(F.size("s") > 1).select("oaza_name", F.explode(pairs).alias("x")).groupBy("oaza_name", "x.small", "x.large").agg(F.count(F.lit(1)).alias("n"))


def shared_numbers(parcels: DataFrame, meta: DataFrame) -> DataFrame:
    """(oaza_name, number_class, n): numbers that both a public and an arbitrary map of a district hold."""
    rows = parcels.join(meta.select(F.col("id").alias("xml_meta_id"), "crs_type"), "xml_meta_id")
    side = rows.where("oaza_name <> ''").groupBy("oaza_name", "chiban").agg(F.bool_or(is_arbitrary(F.col("crs_type"))).alias("a"), F.bool_or(~is_arbitrary(F.col("crs_type"))).alias("p"))
    return side.where("a AND p").groupBy("oaza_name", number_class(F.col("chiban")).alias("number_class")).agg(F.count(F.lit(1)).alias("n"))


def mixed_scales(parcels: DataFrame, meta: DataFrame) -> DataFrame:
    """(oaza_name, scales): districts whose maps have several scales."""
    rows = parcels.join(meta.select(F.col("id").alias("xml_meta_id"), "scale_denominator"), "xml_meta_id").where("oaza_name <> '' AND scale_denominator IS NOT NULL")
    sets = rows.select("oaza_name", "scale_denominator").distinct().groupBy("oaza_name").agg(F.sort_array(F.collect_set("scale_denominator")).alias("s"))
    return sets.where(F.size("s") > 1).select("oaza_name", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("scales"))


def scale_coverage(meta: DataFrame) -> DataFrame:
    """(explicit, inferred, none, total) of arbitrary maps."""
    stored, named = F.col("scale_denominator").isNotNull(), scale_from_name(F.col("map_name")).isNotNull()
    rows = meta.where(is_arbitrary(F.col("crs_type")))
    return rows.agg(F.count_if(stored).alias("explicit"), F.count_if(~stored & named).alias("inferred"), F.count_if(~stored & ~named).alias("none"), F.count(F.lit(1)).alias("total"))


def scale_shares(meta: DataFrame) -> DataFrame:
    """(kind, maps, share) of arbitrary maps: scale explicit, inferred from the name, conflicting (both, and different; they also count as explicit), or none."""
    stored, named = F.col("scale_denominator"), scale_from_name(F.col("map_name"))
    rows = meta.where(is_arbitrary(F.col("crs_type"))).select(stored.alias("s"), named.alias("n"))
    tests = {"explicit": "s IS NOT NULL", "inferred": "s IS NULL AND n IS NOT NULL", "conflicting": "s IS NOT NULL AND n IS NOT NULL AND s <> n", "none": "s IS NULL AND n IS NULL"}
    counts = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.expr(t)).alias(k) for k, t in tests.items()])
    listed = counts.select("total", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("maps")) for k in tests])).alias("r"))
    return listed.select("r.kind", "r.maps", F.try_divide("r.maps", "total").alias("share"))


def maps_of_several_scales(scales: DataFrame) -> DataFrame:
    """(xml_meta_id, n): maps with more than one scale among (xml_meta_id, scale_denominator); there should be none."""
    return scales.where("scale_denominator IS NOT NULL").groupBy("xml_meta_id").agg(F.countDistinct("scale_denominator").alias("n")).where("n > 1")


def municipality_differs(meta: DataFrame, found: DataFrame) -> DataFrame:
    """(id, municipality_name, found_name): maps whose normalized municipality is another than that of the area they lie in (``found``: id, name)."""
    joined = meta.select("id", "municipality_name").join(found.select("id", F.col("name").alias("found_name")), "id")
    return joined.where(normalize_municipality(F.col("municipality_name")) != normalize_municipality(F.col("found_name")))


def off_map_only(meta: DataFrame, parcels: DataFrame, value: str = "地図外") -> DataFrame:
    """Maps that are not made up of off-map parcels alone."""
    only = parcels.groupBy("xml_meta_id").agg(F.bool_and(F.col("chiban") == value).alias("only")).where("only")
    return meta.join(only, meta["id"] == only["xml_meta_id"], "left_anti")


def listed_maps(meta: DataFrame) -> DataFrame:
    return meta.select("id", "file_name", crs_short(F.col("crs_type")).alias("crs"))


def import_summary(files: DataFrame) -> DataFrame:
    """(processed, failed, parcels, success) of (failed, parcels), a row for each file, skipped ones included. Without files the import failed."""
    failed, n = F.count_if("failed"), F.count(F.lit(1))
    return files.agg(n.alias("processed"), failed.alias("failed"), F.coalesce(F.sum(F.col("parcels").cast("bigint")), F.lit(0)).alias("parcels"), ((failed == 0) & (n > 0)).alias("success"))


def import_errors(files: DataFrame) -> DataFrame:
    """(source_name, error) of the files that failed, in order: a table, since their number has no bound."""
    return files.where("failed").select("source_name", "error").orderBy("source_name")


def index_statistics(parcels: DataFrame, meta: DataFrame) -> DataFrame:
    """(oaza, entries, chiban): districts, and sums of their entries and of their distinct numbers."""
    rows = parcels.join(meta.select(F.col("id").alias("xml_meta_id"), "file_name"), "xml_meta_id").where("oaza_name <> ''")
    numbers = rows.select("oaza_name", "chiban", "file_name").distinct().groupBy("oaza_name", "chiban").agg(F.count(F.lit(1)).alias("n"))
    districts = numbers.groupBy("oaza_name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))
    return districts.agg(F.count(F.lit(1)).alias("oaza"), F.sum("n").alias("entries"), F.sum("c").alias("chiban"))


def index_distribution(parcels: DataFrame, meta: DataFrame) -> DataFrame:
    """(oaza_name, entries): entries of each district, the most first."""
    return index_entries(parcels, meta).groupBy("oaza_name").agg(F.count(F.lit(1)).alias("entries")).orderBy(F.desc("entries"), "oaza_name")


def frame_scales(parcels: DataFrame, frames: DataFrame) -> DataFrame:
    """``parcels`` listed by a map frame (xml_meta_id, parcel_refs, ll_x, ll_y, ur_x, ur_y, scale_denominator), with its ``scale``: the explicit one, else
    that of its size."""
    scale = F.coalesce("scale_denominator", frame_scale(F.col("ur_x") - F.col("ll_x"), F.col("ur_y") - F.col("ll_y")))
    listed = frames.select("xml_meta_id", scale.alias("scale"), F.explode("parcel_refs").alias("fude_id")).distinct()
    return parcels.join(listed, ["xml_meta_id", "fude_id"])
