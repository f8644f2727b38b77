"""What the corpus operators share: reading tables, text keys, and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all contracts: blank and \t \n \v \f \r. Python's bytes.split() splits at the same six.
SPACES = " \t\n\x0b\x0c\r"
#: Stands for a null document id, so that it can be compared, grouped and joined; no real id is larger, and one of this
#: value counts as null.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is ``spark.checkpoint.dir``; only a local
    session without that setting gets a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, so that lost
    executors cost no recomputation of what lies above, and later joins know the table's size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Removes a stash that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """``df``, with the session's Arrow batches cut to ``rows`` rows: what a Python worker holds of long texts at
    once, and keeps as its memory afterwards, stays small. A smaller setting stays as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else. ``lower`` does that to ASCII text; other text goes by ``translate``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def labelled_sample(labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, label) of at most ``most`` // 2 documents of either label (0 or 1), those of the smallest hashes of
    their ids; of several labels of one document the majority counts (ties: 1). Small by construction, so it may be broadcast."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("label"))
    halves = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for y in (0, 1)]
    return halves[0].unionByName(halves[1])
