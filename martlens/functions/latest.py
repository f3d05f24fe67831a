"""Latest rows of a key, and other helpers that many operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlens.functions.shared import spread, written


def latest_by(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``values`` of each key's row that is last in ``order``: a partial and a final aggregation, no sort of the rows."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("last"))
    return last.select(*keys, *[F.col(f"last.{v}").alias(v) for v in values])


def ranked(keys: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def numbered(rows: DataFrame, keys: list[str], order: list[Column], number: str, total: str, per_block: int = 100_000) -> DataFrame:
    """``rows`` with the ``number`` (from 0) of each within its key in ``order``, and the ``total`` of its key; no task gets a whole key.

    Rows are range-sorted by key and order into blocks and numbered inside a block; what blocks before it hold of the key comes from a row for each
    key and block. ``order`` should tell the rows of a key apart: rows equal in it all go to one block.
    """
    rows = written(rows, "to-number")
    blocks = max(1, -(-rows.count() // per_block))
    placed = written(rows.repartitionByRange(blocks, *[F.col(k) for k in keys], *order).withColumn("block_", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy(*keys, "block_").agg(F.count("*").alias("size_"))
    w = Window.partitionBy(*keys)
    until = F.sum("size_").over(w.orderBy("block_").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = sizes.withColumn("before_", until - F.col("size_")).withColumn(total, F.sum("size_").over(w)).drop("size_")
    # A key's row of a block comes first among the rows that it counts, so that they are sorted together and joined with nothing.
    both = spread(placed.unionByName(sizes, allowMissingColumns=True), blocks, *keys, "block_")
    w = Window.partitionBy(*keys, "block_").orderBy(F.col("before_").isNull(), *order)
    told = both.select(*rows.columns, "before_", (F.row_number().over(w) - 2 + F.first("before_").over(w)).alias(number), F.first(total).over(w).alias(total))
    return told.filter("before_ IS NULL").drop("before_")


def before(as_of: str, days: int) -> Column:
    return F.expr(f"{as_of} - INTERVAL {days} DAYS")


def upsert(state: DataFrame, batch: DataFrame, keys: list[str], keep: list[str], update: list[str]) -> DataFrame:
    """``state`` with ``batch`` merged by ``keys``: new rows are added; of known ones ``update`` is replaced where the batch has a value, ``keep`` never."""
    s, b = state.alias("s"), batch.alias("b")
    on = [F.col(f"s.{k}") == F.col(f"b.{k}") for k in keys]
    known = F.col(f"s.{keys[0]}").isNotNull()
    columns = [F.coalesce(f"s.{k}", f"b.{k}").alias(k) for k in keys]
    columns += [F.when(known, F.col(f"s.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in keep]
    columns += [F.coalesce(f"b.{c}", f"s.{c}").alias(c) for c in update]
    return s.join(b, on, "full").select(*columns)
