"""Incremental import: new files join a store and are parsed, known ones are skipped, each file's fate is told."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelworks.operators import assemble
from parcelworks.operators.match import first_wins
from parcelworks.operators.store import not_yet_known
from parcelworks.sources.archives import parse_maps, relative_to
from parcelworks.sources.scratch import exists, scope, written

STORE = "source_name string, xml_sha256 string, content binary"
STATUS = "source_name string, xml_sha256 string, status string, error string"
#: Columns of the folders that a batch of a stream writes; a batch that runs again replaces what it wrote.
_OWN = "run string, batch long"


def _read(spark: SparkSession, folder: str, columns: str) -> DataFrame:
    """Rows of a folder of batches; none if it does not exist yet."""
    return spark.read.schema(f"{columns}, {_OWN}").option("basePath", folder).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], f"{columns}, {_OWN}")


def decide(files: DataFrame, known: DataFrame) -> DataFrame:
    """(source_name, xml_sha256, status) of the distinct files (source_name, xml_sha256): ``known`` if content, label or bare name is in ``known`` (source_name, xml_sha256), else ``new``; of
    new files of one content the one of the smallest label is new, of those of one label the one of the smallest hash; the others count as known."""
    keys = files.select("source_name", "xml_sha256").distinct()
    fresh = first_wins(first_wins(not_yet_known(keys, known), ["xml_sha256"], ["source_name"]), ["source_name"], ["xml_sha256"])
    hit = fresh.select("source_name", "xml_sha256", F.lit("new").alias("status"))
    return keys.join(hit, ["source_name", "xml_sha256"], "left").withColumn("status", F.coalesce("status", F.lit("known")))


def import_new(spark: SparkSession, inbox: str, store: str, checkpoint: str, pattern: str = "*.xml", status: str | None = None, tables: str | None = None, recursive: bool = False) -> None:
    """Takes every file of ``inbox``, and of folders in it if ``recursive``, not taken before and stops. A file is skipped if its content, its label (the path below the inbox) or its bare name
    is in the Parquet folder ``store`` already; of new files of one content, the one of the smallest label is stored as (source_name, xml_sha256, content).
    With ``tables``, files are parsed and their headers and parcels written to the folders ``maps`` and ``parcels`` in there; a file that cannot be parsed is not stored, so that it may come
    again. With ``status``, a row (source_name, xml_sha256, status, error) of each file is written there: imported, known or failed.

    Each batch of a stream writes a folder of its own in all of them, the status last. A batch that runs again after a failure leaves its own folders out of what is known and
    replaces them, so nothing is stored or told twice, and a file's fate is the same. Files are compared with what has been stored, not with all that has been seen, so the comparison
    reads labels and hashes of the store (two columns), and no stream state. Contents are read again only for new files."""
    label = relative_to(inbox)
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).schema("path string, modificationTime timestamp, length long, content binary").load(inbox)
    files = files.select(label.alias("source_name"), F.sha2("content", 256).alias("xml_sha256"), "content")

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        run = json.loads(session.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        put = lambda rows, folder: rows.write.mode("overwrite").parquet(f"{folder}/run={run}/batch={number}")
        with scope(session):
            stored_before = _read(session, store, STORE).where(~((F.col("run") == run) & (F.col("batch") == number)))
            told = written(decide(batch, stored_before), "import-keys").withColumn("error", F.lit(None).cast("string"))
            fresh = batch.join(told.where("status = 'new'").select("source_name", "xml_sha256"), ["source_name", "xml_sha256"], "left_semi")
            if tables is not None:
                parsed = written(parse_maps(fresh), "import-parsed")
                bad = parsed.where("kind = 'error'").select("source_name", F.col("fields")["error"].alias("__error"))
                told = told.join(bad, "source_name", "left").withColumns({"error": F.when(F.col("status") == "new", F.col("__error")), "status": F.when((F.col("status") == "new") & F.col("__error").isNotNull(), "failed").otherwise(F.col("status"))}).drop("__error")
                told = written(told, "import-fates")
                fresh = fresh.join(told.where("status = 'new'").select("source_name", "xml_sha256"), ["source_name", "xml_sha256"], "left_semi")
            put(fresh.select("source_name", "xml_sha256", "content"), store)
            if tables is not None:
                put(assemble.headers(parsed), f"{tables}/maps")
                put(assemble.parcels(parsed), f"{tables}/parcels")
            if status is not None:
                put(told.select("source_name", "xml_sha256", F.regexp_replace("status", "^new$", "imported").alias("status"), "error"), status)

    files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stored(spark: SparkSession, store: str) -> DataFrame:
    return _read(spark, store, STORE).drop("run", "batch")


def statuses(spark: SparkSession, status: str) -> DataFrame:
    """The fate of every file of every batch, in no order."""
    return _read(spark, status, STATUS).drop("run", "batch")


def imported(spark: SparkSession, tables: str, name: str) -> DataFrame:
    """``maps`` or ``parcels`` of all imported files."""
    return spark.read.option("basePath", f"{tables}/{name}").parquet(f"{tables}/{name}").drop("run", "batch")
