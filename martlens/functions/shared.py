"""Paths in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only where that is unset and all runs in one process, below /tmp."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/martlens-checkpoints"
    return f"{root.rstrip('/')}/martlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its lineage ends there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt out by their keys to several tasks a core: a small file is read by one task, however much is then made of its rows."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def tasks_for(rows: DataFrame, each: int = 8_000_000) -> int:
    """How many tasks rows should be shuffled to: one for so many bytes of the files that they come from, so that a task's memory doesn't grow with the input."""
    spark = rows.sparkSession
    size = sum(fs.getFileStatus(at).getLen() for fs, at in (_file_system(spark, f) for f in rows.inputFiles()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def spread(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``rows`` dealt out by their keys to so many tasks; where that isn't more than a shuffle makes anyway they stay as they are. Groups and joins by these keys shuffle no more."""
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def once(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """As ``rows.select(*columns)``, but computed once a row: filters and later columns use the values, where Spark else copies what they come from into each."""
    return rows.select(F.explode(F.array(F.struct(*columns))).alias("once_")).select("once_.*")


def clear_shared(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder; DataFrames that read it can't be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "x").rpartition("/")[0])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reads; none if it isn't there."""
    fs, at = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def drop_path(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def move_path(spark: SparkSession, path: str, to: str) -> None:
    """Moves a folder; where it isn't there, ``to`` is made empty."""
    fs, at = _file_system(spark, path)
    target = _file_system(spark, to)[1]
    if not fs.exists(at):
        fs.mkdirs(target)
        return
    fs.mkdirs(target.getParent())
    if not fs.rename(at, target):
        raise OSError(f"{path} can't be moved to {to}")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file under another name first, so that it is there as a whole or not at all."""
    fs, at = _file_system(spark, f"{path}.part")
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    to = _file_system(spark, path)[1]
    if fs.exists(to):
        fs.delete(to, False)
    if not fs.rename(at, to):
        raise OSError(f"{path} can't be written")


def get_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, at = _file_system(spark, path)
    source = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
