"""A corpus pipeline of five operators: quality, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all
but the last return the columns of ``documents``. Stages are written as Parquet and read again in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelworks.llm import line_dedup, mixing, near_copies, quality, sentencepiece_nbest, simhash
from parcelworks.llm.components import connected_components
from parcelworks.llm.shared import NO_ID, stash, table, word_count

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: A row: its id and two hashes. Rows that share all three are alike in every column.
KEY = ["__row_id", "__h1", "__h2"]


def keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents with those of ``KEY``."""
    docs = docs.select(COLUMNS)
    rest = F.to_json(F.struct("lang", "source", "n_chars"))
    return docs.withColumns({"__row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__h1": F.xxhash64("text"), "__h2": F.xxhash64(F.lit("row"), "text", rest)})


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).where("kept").select(COLUMNS)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document holds; every document stays, with its new length."""
    clean = line_dedup.dedup_lines(docs)
    length = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id (null last), then the first by hash of the text. Groups are joined by links of two kinds: SimHash fingerprints within three
    bits, and sets of five-word shingles alike to 0.8 or more. Documents of no words say nothing and are all alike, so one of them stays as well. Rows of one id, or of none, stay if
    their groups differ."""
    rows = keyed(docs)
    prints = stash(simhash.simhash_groups(rows, keys=("__h1", "__h2")), "pipeline-prints")
    alike = near_copies.near_links(rows.select(F.col("__h1").alias("node"), "text"))
    held = prints.select("__h1", "__group").distinct()
    large = held.groupBy("__group").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    stars = held.join(large, "__group").select(F.col("__h1").alias("u"), F.xxhash64(F.lit("group"), "__group").alias("v"))  # a group is a node beside its texts
    found = stash(connected_components(alike.unionByName(stars)), "pipeline-groups")
    named = prints.join(found, prints["__h1"] == found["node"], "left").withColumn("__name", F.coalesce("component", "__h1"))
    first = named.groupBy("__name").agg(F.min(F.struct(F.col("__id").alias("__row_id"), "__h1", "__h2")).alias("first")).select("first.*")
    return rows.join(first, KEY, "left_semi").dropDuplicates(KEY).select(COLUMNS)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    rows = keyed(docs)
    sizes = rows.select(F.struct(KEY).alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    copies = mixing.mix_to_weights(sizes).where("copies > 0").groupBy(*[F.col(f"doc_id.{c}").alias(c) for c in KEY]).agg(F.sum("copies").cast("int").alias("copies"))
    mixed = rows.dropDuplicates(KEY).join(copies, KEY)  # rows that are alike share their copies
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the best segmentation of each document, with the scores of the four best."""
    import public_tokenizers

    return sentencepiece_nbest.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("good_quality", good_quality),
    ("unique_lines", unique_lines),
    ("one_of_each_group", one_of_each_group),
    ("target_weights", target_weights),
    ("encoded", encoded),
]

#: Trained models and an iterative fit are no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
