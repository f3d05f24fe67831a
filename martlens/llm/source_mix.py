"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a mean repetition rate: its target volume over its own. A document's number of copies is the inverse of the
Poisson distribution of that mean at a number between 0 and 1 that a hash of seed and doc_id gives; rates above ``RATE`` are
sums of independent parts. The copies are then put in the order of another hash.

Cases: documents of a null source are a source of their own. Empty and null texts have no volume, but are repeated at their
source's rate; a source without any volume has rate 0. Sources missing from given weights have rate 0. Repeated rows are drawn
alike; rows without a doc_id are drawn by their text. An empty table gives an empty result. All columns of the input are kept as they are;
where it has a ``mix_copy`` or ``mix_key`` of its own, ours get an underscore more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.llm.common import free_names, join_heavy, pinned

#: A Poisson distribution is inverted up to this mean, so that its table stays short.
RATE = 64.0
#: Sources up to which the rates are sent to every task; beyond it they are joined by a shuffle.
MOST_SENT = 50_000


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def distribution(rate: Column) -> Column:
    """Array of the Poisson distribution function at 0, 1, ... up to where it is 1 in double precision."""
    k = F.sequence(F.lit(0), F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int"))
    first = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + p)).alias("all"))

    return F.aggregate(F.slice(k, 2, 1_000_000), first, step, lambda acc: acc["all"])


def rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, volume: float | None) -> DataFrame:
    """(key, n, rate, parts, table) of every source: a struct of its name, its rows, and its distribution. Target volumes are in characters; by default as much as there is.

    weights: of each source, not necessarily summing to 1; by default in proportion to volume ** temperature.
    """
    own = docs.groupBy(F.struct("source").alias("key")).agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("v"), F.count("*").alias("n"))
    own = pinned(own, "volumes")
    if weights is None:
        goal = F.sqrt(F.col("v")) if temperature == 0.5 else F.pow(F.col("v").cast("double"), F.lit(temperature))
        own = own.withColumn("w", F.when(F.col("v") > 0, goal).otherwise(F.lit(0.0)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(x)) for k, x in weights.items()], "source string, w double")
        own = own.join(given, F.col("key.source").eqNullSafe(F.col("source")), "left").select("key", "v", "n", F.when(F.col("v") > 0, F.coalesce("w", F.lit(0.0))).otherwise(F.lit(0.0)).alias("w"))
    total = own.agg(F.sum("v").alias("all_v"), F.sum("w").alias("all_w")).first()
    wanted = float(volume if volume is not None else total.all_v or 0)
    rate = F.when(F.col("w") > 0, F.col("w") / F.lit(float(total.all_w or 1)) * F.lit(wanted) / F.col("v")).otherwise(F.lit(0.0))
    own = own.select("key", "n", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / RATE).cast("int")))
    return own.withColumn("table", distribution(F.col("rate") / F.col("parts")))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, volume: float | None = None, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text, ...), each as often as its Poisson number says, in random order.

    mix_copy numbers the copies of a row from 0; mix_key is the random key of the order.
    """
    table = pinned(rates(docs, weights, temperature, volume), "rates")
    sources, total = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text-"), F.md5(F.coalesce("text", F.lit("")))))
    # The whole row is one column, so that no name of the input meets one of ours.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct("source").alias("key"), name.alias("name"))
    rows = rows.join(F.broadcast(table), "key") if sources <= MOST_SENT else join_heavy(rows, table, ["key"], "n", total)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    u = F.conv(F.substring(_hash(F.lit(f"count-{seed}"), F.col("name"), F.col("part").cast("string")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    copies = F.when(F.col("rate") > 0, F.size(F.filter("table", lambda p: p <= u))).otherwise(F.lit(0))
    rows = rows.select("row", "name", "part", copies.alias("copies")).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rows = rows.withColumn("order", _hash(F.lit(f"order-{seed}"), F.col("name"), F.col("part").cast("string"), F.col("copy").cast("string")))
    copy, order = free_names(docs, "mix_copy", "mix_key")
    return rows.select("row", "copy", "order").repartition("order").sortWithinPartitions("order").select("row.*", F.col("copy").alias(copy), F.col("order").alias(order))
