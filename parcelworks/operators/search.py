"""Searches, suggestions and orders of parcel numbers; an index of the numbers' n-grams."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcelworks.functions.numbers import natural_key
from parcelworks.operators.store import ascii_lower
from parcelworks.sources.scratch import written

#: Longest gram of the index; shorter texts are looked up by grams of their own length.
GRAM = 3


def search_numbers(parcels: DataFrame, query: str, oaza: str | None = None, limit: int = 50) -> DataFrame:
    """At most ``limit`` parcels whose number contains ``query``, by district, number, map and id; an empty query finds none. Scans the table; ``search_index`` does not."""
    found = parcels.where(F.lit(query != "") & F.contains(ascii_lower(F.col("chiban")), ascii_lower(F.lit(query))))
    if oaza is not None:
        found = found.where(F.col("oaza_name") == oaza)
    return found.orderBy("oaza_name", "chiban", "xml_meta_id", "fude_id").limit(limit)


def suggestions(parcels: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """At most ``limit`` distinct numbers with a prefix: districts by name, numbers in natural order inside."""
    found = parcels.where(F.col("chiban").startswith(prefix) & (F.col("oaza_name") != ""))
    first = found.groupBy("chiban").agg(F.min("oaza_name").alias("oaza_name"))
    return first.orderBy("oaza_name", natural_key(F.col("chiban")), "chiban").limit(limit)


def prefix_table(parcels: DataFrame, limit: int = 10) -> DataFrame:
    """(prefix, rank, oaza_name, chiban): for every prefix of every number what ``suggestions`` gives for it. Each task cuts a prefix's rows to the first ``limit`` before the shuffle, so a common
    prefix is no large group; the empty prefix is among them."""
    found = parcels.where(F.col("chiban").isNotNull() & (F.col("oaza_name") != ""))
    first = found.groupBy("chiban").agg(F.min("oaza_name").alias("oaza_name")).withColumn("__key", natural_key(F.col("chiban")))
    prefixes = F.transform(F.sequence(F.lit(0), F.length("chiban")), lambda n: F.substring("chiban", F.lit(1), n))
    rows = first.select(F.explode(prefixes).alias("prefix"), "oaza_name", "__key", "chiban")
    place = F.row_number().over(Window.partitionBy("prefix").orderBy("oaza_name", "__key", "chiban"))
    return rows.withColumn("rank", place).where(F.col("rank") <= limit).select("prefix", "rank", "oaza_name", "chiban")


def write_prefixes(parcels: DataFrame, path: str, limit: int = 10, files: int | None = None) -> None:
    """Writes ``prefix_table`` in ranges of prefixes, so that a suggestion reads one row group or two."""
    table = prefix_table(parcels, limit)
    table = table.repartitionByRange(files, "prefix") if files else table.repartitionByRange("prefix")
    table.sortWithinPartitions("prefix", "rank").write.parquet(path)


def suggest(spark: SparkSession, path: str, prefix: str, limit: int = 10) -> DataFrame:
    """(oaza_name, chiban) for a prefix, in order, from what ``write_prefixes`` wrote."""
    return spark.read.parquet(path).where(F.col("prefix") == prefix).where(F.col("rank") <= limit).orderBy("rank").select("oaza_name", "chiban")


def positions(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``n``, their place from 1 by ``order`` inside each ``group`` (the whole table if there is none); rows must differ in these columns.

    No task holds a group: rows are dealt by ranges of (group, order) into partitions, counted there, and a partition's places begin after all rows of the partitions before it. A group's first place
    is then taken off its rows. Only the window over one row a partition is a single task."""
    ranges = [*group, *order]
    dealt = rows.repartitionByRange(*ranges).withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, "ranges")  # a row's partition is fixed from here on
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = dealt.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*ranges))).join(before, "__part").withColumn("n", F.col("__before") + F.col("__in"))
    if group:
        first = placed.groupBy(*group).agg(F.min("n").alias("__first"))
        same = [F.col(f"__p.{c}").eqNullSafe(F.col(f"__f.{c}")) for c in group]
        on = same[0]
        for more in same[1:]:
            on = on & more
        placed = placed.alias("__p").join(first.alias("__f"), on).select("__p.*", "__first").withColumn("n", F.col("n") - F.col("__first") + 1).drop("__first")
    return placed.withColumn("n", F.col("n").cast("long")).drop("__part", "__before", "__in")


def natural_order(parcels: DataFrame) -> DataFrame:
    """(xml_meta_id, chiban, n): the place of each distinct number in its map, in natural order. Keys are made of distinct numbers only and give them places over all maps, by which the
    numbers of a map are then ordered."""
    pairs = written(parcels.select("xml_meta_id", "chiban").distinct(), "numbers-of-maps")
    places = positions(pairs.select("chiban").distinct().withColumn("__key", natural_key(F.col("chiban"))), [], ["__key", "chiban"])
    places = written(places.select(F.col("chiban").alias("__chiban"), F.col("n").alias("__place")), "places-of-numbers")
    placed = pairs.join(places, F.col("chiban").eqNullSafe(F.col("__chiban"))).select("xml_meta_id", "chiban", "__place")
    return positions(placed, ["xml_meta_id"], ["__place"]).select("xml_meta_id", "chiban", "n")


# An inverted index of n-grams


def _grams(text: Column, size: Column | int) -> Column:
    """Distinct runs of ``size`` signs of a text, none if it is shorter."""
    n = F.lit(size) if isinstance(size, int) else size
    count = F.length(text) - n + 1
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def postings(numbers: DataFrame) -> DataFrame:
    """(gram, number) of all grams of one to ``GRAM`` signs of each row of ``numbers`` (number, lower case)."""
    every = F.flatten(F.array(*[_grams(F.col("number"), n) for n in range(1, GRAM + 1)]))
    return numbers.select(F.explode(every).alias("gram"), "number")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_number_index(parcels: DataFrame, path: str, *columns: str, buckets: int = 64) -> None:
    """Writes an index of the parcels' numbers: ``path``/postings (gram, number) and ``path``/rows (number, chiban, ``columns``), both in folders by a hash of their first
    column and sorted by it, so that a search reads a few row groups. A folder's rows are spread over files by the other column, so a common gram is no large file."""
    rows = parcels.select(ascii_lower(F.col("chiban")).alias("number"), "chiban", *columns).where("number <> ''")
    found = postings(rows.select("number").distinct())
    for table, key, name in ((found, "gram", "postings"), (rows, "number", "rows")):
        dealt = table.withColumn("bucket", _bucket(F.col(key), buckets))
        # AQE splits what a common key makes large
        dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{path}/{name}")
    shape = rows.withColumn("bucket", F.lit(0)).schema.json()
    parcels.sparkSession.range(1).select(F.lit(buckets).alias("buckets"), F.lit(shape).alias("shape")).coalesce(1).write.parquet(f"{path}/size")


def search_index(spark: SparkSession, path: str, text: str) -> DataFrame:
    """Rows of an index whose number contains ``text`` (ASCII case aside); an empty text finds none. Postings of the text's grams are read, and the numbers that have all of them compared with
    the text; rows are then read by number. No other folder, and of the folders no other row group, is touched."""
    lower = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    size = min(len(lower), GRAM)
    grams = sorted({lower[i : i + size] for i in range(len(lower) - size + 1)}) if lower else []
    buckets, shape = spark.read.parquet(f"{path}/size").first()
    asked = [r.b for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"), buckets).alias("b")).distinct().collect()]  # a few grams of one text
    lists = spark.read.schema("gram string, number string, bucket int").parquet(f"{path}/postings").where(F.col("bucket").isin(asked) & F.col("gram").isin(grams))
    hits = lists.groupBy("number").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") == len(grams)) & F.contains("number", F.lit(lower)))
    hits = hits.select("number", _bucket(F.col("number"), buckets).alias("bucket"))
    return spark.read.schema(StructType.fromJson(json.loads(shape))).parquet(f"{path}/rows").join(hits, ["bucket", "number"], "left_semi").drop("bucket", "number")


def texts_in_numbers(numbers: DataFrame, texts: DataFrame) -> DataFrame:
    """(text, number) of all ``texts`` (text) that ``numbers`` (number, distinct) contain. A text meets the numbers that hold the rarest of its grams, and is then compared: an equi-join,
    whose hot grams AQE splits, and never of all numbers with all texts. Both in lower case; an empty text is in none."""
    lists = written(postings(numbers), "postings")
    size = F.least(F.length("text"), F.lit(GRAM))
    grams = texts.where("text <> ''").select("text", F.explode(_grams(F.col("text"), size)).alias("gram"))
    counts = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(counts, "gram", "left").groupBy("text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    rarest = rarest.where("m.n > 0").select("text", "m.gram")  # a gram that no number has: no hit
    return lists.join(rarest, "gram").where(F.contains("number", "text")).select("text", "number")


def first_places(parcels: DataFrame, texts: DataFrame) -> DataFrame:
    """(query, xml_meta_id, fude_id, cx, cy, min_x, min_y, max_x, max_y): for each query text, the first map and parcel
    whose number contains it, with the parcel's centroid and box; an empty query finds none."""
    hit = F.struct("xml_meta_id", "fude_id", "x0", "y0", "w", "h")
    listed = parcels.groupBy(ascii_lower(F.col("chiban")).alias("number")).agg(F.min(hit).alias("m")).where("number <> ''")
    listed = written(listed, "numbers")
    asked = texts.select("query", ascii_lower(F.col("query")).alias("text"))
    found = texts_in_numbers(listed.select("number"), asked.select("text").distinct())
    first = found.join(listed, "number").groupBy("text").agg(F.min("m").alias("m"))
    first = asked.join(first, "text").select("query", "m.*")
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    return first.select(
        "query", "xml_meta_id", "fude_id", (x0 + w / 2).alias("cx"), (y0 + h / 2).alias("cy"), x0.alias("min_x"), y0.alias("min_y"), (x0 + w).alias("max_x"), (y0 + h).alias("max_y")
    )
