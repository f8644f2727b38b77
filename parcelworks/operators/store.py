"""Reads of and updates to the map and parcel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.functions.shapes import as_shape, parse_wkt, to_wkt
from parcelworks.sources.scratch import dealt, written


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_map(parcels: DataFrame, meta: DataFrame, *columns: str) -> DataFrame:
    """Parcels with columns of their map. These are written first: a table of known size is not joined by a shuffle of all parcels while it is small."""
    return parcels.join(written(meta.select(F.col("id").alias("xml_meta_id"), *columns), "columns-of-maps"), "xml_meta_id")


def search_parcels(parcels: DataFrame, meta: DataFrame, text: str, oaza: str | None = None) -> DataFrame:
    """Parcels whose number contains ``text`` (ASCII case aside, literally), optionally of one district."""
    found = parcels.where(F.contains(ascii_lower(F.col("chiban")), ascii_lower(F.lit(text))))
    if oaza is not None:
        found = found.where(F.col("oaza_name") == oaza)
    return with_map(found, meta, "file_name", "crs_type")


def not_yet_known(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (source_name, xml_sha256) whose content, label and bare name are all unknown to ``known``."""
    base = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    left = files.join(known.select("xml_sha256").distinct(), "xml_sha256", "left_anti")
    left = left.join(known.select("source_name").distinct(), "source_name", "left_anti").withColumn("__base", base(F.col("source_name")))
    return left.join(known.select(F.col("source_name").alias("__base")).distinct(), "__base", "left_anti").drop("__base")


def maps_of_oaza(meta: DataFrame, parcels: DataFrame, oaza: str) -> DataFrame:
    return meta.join(parcels.where(F.col("oaza_name") == oaza), meta["id"] == parcels["xml_meta_id"], "left_semi")


def exists_queries(parcels: DataFrame, asked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of ``asked`` whose columns ``by`` some parcel has: number and district by default; ["oaza_name"] asks for districts, ["chiban"] for numbers anywhere."""
    return asked.join(parcels, by or ["chiban", "oaza_name"], "left_semi")


def update_by_id(rows: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``rows`` with the non-null columns of ``changes`` in place of their own."""
    new = changes.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def write_parcels(parcels: DataFrame, path: str, *partition: str) -> None:
    parcels.write.mode("append").partitionBy(*partition).parquet(path)


def append_parcels(parcels: DataFrame, path: str, order: list[str], keys: tuple[str, ...] = ("xml_meta_id", "fude_id")) -> tuple[int, int]:
    """Appends parcels to the Parquet folder ``path``/rows as one batch and returns how many were kept and how many dropped. A parcel whose ``keys`` are stored already, or came
    earlier by ``order`` in the same batch, is dropped; numbers a map go to ``path``/counts, so ``append_counts`` tells what was dropped where. Writers are to run one at a time; a batch that
    failed before its counts were written is written anew by the next call."""
    from parcelworks.operators.match import first_wins
    from parcelworks.sources.scratch import exists

    spark, key = parcels.sparkSession, list(keys)
    counts = append_counts(spark, path)
    batch = 0 if (last := counts.agg(F.max("batch")).first()[0]) is None else last + 1
    fresh = first_wins(parcels, key, order)
    if batch and exists(spark, f"{path}/rows"):
        fresh = fresh.join(spark.read.parquet(f"{path}/rows").where(F.col("batch") < batch).select(*key), key, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    kept = spark.read.schema(parcels.schema).parquet(f"{path}/rows/batch={batch}").groupBy(key[0]).agg(F.count(F.lit(1)).alias("kept"))
    told = parcels.groupBy(key[0]).agg(F.count(F.lit(1)).alias("__n")).join(kept, key[0], "left").select(key[0], F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("__n") - F.coalesce("kept", F.lit(0))).alias("dropped"))
    told.write.mode("overwrite").parquet(f"{path}/counts/batch={batch}")
    sums = append_counts(spark, path).where(F.col("batch") == batch).agg(F.sum("kept"), F.sum("dropped")).first()
    return sums[0] or 0, sums[1] or 0


def append_counts(spark, path: str) -> DataFrame:
    """(the first key, kept, dropped, batch) of all batches that ``append_parcels`` finished."""
    from parcelworks.sources.scratch import exists

    if not exists(spark, f"{path}/counts"):
        return spark.createDataFrame([], "xml_meta_id long, kept long, dropped long, batch int")
    return spark.read.option("basePath", f"{path}/counts").parquet(f"{path}/counts")


def export_parcels(parcels: DataFrame, meta: DataFrame, oaza: str | None = None, map_ids: list[int] | DataFrame | None = None) -> DataFrame:
    """Parcels with file_name and crs_type of their map and ``wkt``, their geometry as text: those of one district, and of some maps (ids, or a table with xml_meta_id),
    where asked. A parcel without a geometry is left out. ``isEmpty()`` says whether there is anything to export."""
    found = parcels.where("geom IS NOT NULL")
    if oaza is not None:
        found = found.where(F.col("oaza_name") == oaza)
    if isinstance(map_ids, DataFrame):
        found = found.join(map_ids.select("xml_meta_id").distinct(), "xml_meta_id", "left_semi")
    elif map_ids is not None:
        found = found.where(F.col("xml_meta_id").isin(list(map_ids)))
    return with_map(found, meta, "file_name", "crs_type").withColumn("wkt", to_wkt(as_shape(found, "geom")))


def write_export(rows: DataFrame, path: str) -> bool:
    """Writes an export as Parquet without its nested geometry; an empty one writes nothing and says False."""
    if rows.isEmpty():
        return False
    rows.drop("geom").write.parquet(path)
    return True


def review_queue(parcels: DataFrame, oaza: str | None = None) -> DataFrame:
    """Parcels that need a review, by reason and number, nulls first; optionally of one district."""
    found = parcels.where("needs_review = 1")
    if oaza is not None:
        found = found.where(F.col("oaza_name") == oaza)
    return found.orderBy(F.col("review_reason").asc_nulls_first(), F.col("chiban").asc_nulls_first())


def stamped(rows: DataFrame, fresh: bool = True) -> DataFrame:
    """``rows`` with updated_date, and import_date if they are new, set to now."""
    now = F.current_timestamp()
    return rows.withColumns({"import_date": now, "updated_date": now} if fresh else {"updated_date": now})


def set_reliability(parcels: DataFrame, ids: DataFrame, reliability: str, transform_method: str | None = None, needs_review: bool = False, review_reason: str | None = None) -> DataFrame:
    """``parcels`` whose listed (xml_meta_id, fude_id) take these values; the others stay. ``updated`` says which did. The level is one of HIGH, MEDIUM and LOW."""
    if reliability not in ("HIGH", "MEDIUM", "LOW"):
        raise ValueError(f"no level of reliability: {reliability}")
    marked = parcels.join(ids.select("xml_meta_id", "fude_id").distinct().withColumn("__hit", F.lit(True)), ["xml_meta_id", "fude_id"], "left").withColumn("updated", F.coalesce("__hit", F.lit(False)))
    values = {"reliability": F.lit(reliability), "transform_method": F.lit(transform_method).cast("string"), "needs_review": F.lit(int(needs_review)), "review_reason": F.lit(review_reason).cast("string")}
    return marked.withColumns({c: F.when(F.col("updated"), v).otherwise(F.col(c)) for c, v in values.items()}).drop("__hit")


def set_geometry(parcels: DataFrame, shapes: DataFrame, coord_type: str = "変換済み") -> DataFrame:
    """``parcels`` with the polygons of ``shapes`` (xml_meta_id, fude_id, geom) in place of their own, and marked as transformed where there is one."""
    new = shapes.select("xml_meta_id", "fude_id", F.col("geom").alias("__geom"))
    joined = parcels.join(new, ["xml_meta_id", "fude_id"], "left")
    return joined.withColumns({"coord_type": F.when(F.col("__geom").isNotNull(), coord_type).otherwise(F.col("coord_type")), "geom": F.coalesce("__geom", "geom")}).drop("__geom")


def with_srid(rows: DataFrame, crs: str = "crs_type", only: str = "公共座標8系", srid: int = 6676) -> DataFrame:
    """``rows`` with srid where their coordinate system is exactly ``only``, else null."""
    return rows.withColumn("srid", F.when(F.col(crs) == only, srid))


def append_new(store: DataFrame, files: DataFrame) -> DataFrame:
    """``store`` and those of ``files`` (source_name, xml_sha256, ...) that are new to it; of files of one content or one label the smallest label counts."""
    from parcelworks.operators.match import first_wins

    fresh = first_wins(first_wins(not_yet_known(files, store), ["xml_sha256"], ["source_name"]), ["source_name"], ["xml_sha256"])
    return store.unionByName(fresh.select(store.columns))


def areas_from_wkt(rows: DataFrame, name_col: str, wkt_col: str = "wkt") -> DataFrame:
    """(admin_id, name, geom, error) of rows with a name and a polygon or several as WKT; geom is a shape (``functions.shapes``), ids are hashes of both texts, so that reads agree. A text
    that cannot be read leaves geom null and says why; rows without a name or a text are left out. Texts are dealt over all tasks before they are read."""
    named = rows.select(F.xxhash64(name_col, wkt_col).alias("admin_id"), F.col(name_col).alias("name"), F.col(wkt_col).alias("__wkt")).where("name IS NOT NULL AND __wkt IS NOT NULL")
    return dealt(named, "admin_id").select("admin_id", "name", parse_wkt(F.col("__wkt")).alias("__p")).select("admin_id", "name", "__p.geom", "__p.error")


def load_areas(spark, path: str, name_col: str, wkt_col: str = "wkt", kind: str = "parquet", **options: str) -> DataFrame:
    """``areas_from_wkt`` of a layer in files that Spark reads. Joins pass over areas without a geom; ``where("error IS NOT NULL")`` lists them."""
    return areas_from_wkt(spark.read.format(kind).options(**options).load(path), name_col, wkt_col)
