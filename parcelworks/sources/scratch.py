"""Intermediate tables in the folder that driver and executors share, and scopes that remove them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is ``spark.checkpoint.dir``; only a local
    session without that setting gets a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A name of a new folder below the shared one; the innermost open ``scope`` removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, so that lost executors cost no recomputation of what
    lies above, costly expressions are computed once, and later joins know the table's size."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over as many tasks as a shuffle has, by ``keys`` or evenly. A file of few row groups is read by as few tasks, however costly what follows is a row; and what AQE
    joins by compressed sizes may take many times as much memory."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def drop(df: DataFrame) -> None:
    """Removes a written table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """``with scope(spark):`` removes at its end all intermediate tables written inside it. Results must have been written or collected
    by then, since they may read those tables. Scopes may lie within each other, and belong to one driver thread."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for folder in _SCOPES.pop():
            remove(spark, folder)
