"""What the operators share: the scratch folder, checkpoints, joins over heavy keys and blocks of text bytes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process (tests, a laptop) a folder below /tmp is chosen and set; on a cluster, whose
    machines share no /tmp, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/martlens-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one folder for each application."""
    return f"{scratch_root(spark)}/martlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder. DataFrames that the operators returned can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/martlens/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pinned(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores behind it as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_heavy(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, how: str = "inner", most: int = 1000) -> DataFrame:
    """``rows`` joined with ``table`` (one row for each key; ``count``: how many rows have it) without a task for a heavy key.

    Keys with more than a share of 1 / ``most`` of all ``total`` rows, of which there can't be more than ``most``, are sent to every
    task; the other keys are shuffled. Null keys find nothing.
    """
    heavy = F.col(count) > max(1, total // most)
    sent = F.broadcast(table.filter(heavy).withColumn("heavy_", F.lit(True)))
    marked = rows.join(sent, keys, "left")
    light = marked.filter("heavy_ IS NULL").select(*rows.columns).join(table.filter(~heavy), keys, how)
    return marked.filter("heavy_").drop("heavy_").unionByName(light)


def marks(rows: DataFrame, ids: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """``rows`` with marked, in the last place: may the doc_id be in ``ids``? Each id sets a bit of a bitmap of bounded size, whatever their number."""
    word, mask, at, marked = free_names(rows, "mark_word", "mark_mask", "mark_at", "marked")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))
    part, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    masks = ids.select(part.alias(word), bit.alias("bit")).groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias(mask))
    # At most bits / 64 rows, so that they can be sent to every task.
    hit = rows.withColumn(at, part).join(F.broadcast(masks), F.col(at) == F.col(word), "left")
    return hit.withColumn(marked, F.coalesce(F.getbit(mask, bit) == 1, F.lit(False))).select(*rows.columns, marked)


def give_back() -> None:
    """Returns freed memory to the system, where the C library has a call for it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _returning(function: Callable) -> Callable:
    """``function`` over batches, giving freed memory back to the system after each batch that it has read.

    Workers live on from task to task, next to an executor's heap: what an allocator keeps for later is missing there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from function(each())
        give_back()

    return run


def map_texts(df: DataFrame, function: Callable, schema, rows: int = 2048, megabytes: int = 4) -> DataFrame:
    """``df.mapInArrow`` for rows with whole texts: the session's Arrow batches are lowered to ``rows`` rows, the rows of a block, and ``megabytes``.

    Spark's own 10,000 rows with texts take tens of megabytes in the executor and again in its Python worker. Spark reads the setting
    when the plan runs, so it stays in the session; a lower one of the user's stays as it is.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")
    return df.mapInArrow(_returning(function), schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n + 1 bounds of its rows; a null is empty."""
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    bounds = np.frombuffer(column.buffers()[1], width, len(column) + 1, column.offset * np.dtype(width).itemsize) if len(column) else np.zeros(1, width)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, bounds.astype(np.int64)


def blocks(column: pa.Array, limit: int = 1 << 18, rows: int = 2048) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of runs of at most ``rows`` whole rows with about ``limit`` bytes, so that arrays stay small."""
    data, bounds = text_bytes(column)
    row, n = 0, len(bounds) - 1
    while row < n:
        end = min(row + rows, max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1))
        yield row, end, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def file_system(path: str):
    """The Arrow file system of a path or URI in the shared folder, and the path in it. Hadoop's names of S3 are Arrow's s3."""
    from pyarrow import fs

    for scheme in ("s3a://", "s3n://"):
        if path.startswith(scheme):
            path = "s3://" + path[len(scheme) :]
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_file(folder: str, name: str, chunks) -> str:
    """Writes the byte strings ``chunks`` to a file of a new name in ``folder``; returns its path.

    Each attempt of a task has its own file. Only the path that the committed attempt reports is ever read.
    """
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    system, inner = file_system(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    with system.open_output_stream(inner) as out:
        for chunk in chunks:
            out.write(chunk)
    return path
