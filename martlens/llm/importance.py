"""Quality by importance resampling: the ratio of two hashed n-gram models, of good text and of all text, and Gumbel top-k.

Features are word unigrams and pairs of neighbouring words, hashed. Words and runs of punctuation are separate; a pair's hash is
that of the two hashes in their order. The raw model counts all rows, the target model
the good ones of the labelled rows. A document's log-weight is the sum over its features of the log of the ratio, both counts
shrunk by ``prior``; to it comes Gumbel noise from a hash of seed and doc_id, and the documents of the k largest sums are kept.

k is found from labels as well: a fifth of the good labelled rows is held out of the target model, and k is the number of rows
whose log-weight isn't below the ``miss`` quantile of theirs, rounded so that no larger share of them is below it, however few they are.
A log-weight is a sum over all features of a text, so the noise, of scale 1, decides among documents of about equal weight only; which
of a hundred thousand others stay is decided by k.

Cases: a null or empty text has no features and log-weight 0. Without good labelled rows there is no target, and all rows are
kept. Rows that repeat a doc_id get the same noise. Ties at the k-th sum are all kept. Labels with null are no labels. An empty
table gives an empty result. Very long texts are counted in whole. Other columns of the input aren't read; ``selected`` keeps them as they
are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.llm.bytewords import LOWER, SPACE, mix, runs, span_hashes
from martlens.llm.common import blocks, free_names, map_texts, pinned

_U = np.uint64
#: Letters and digits; what is neither these nor white space is punctuation.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
SCORED = "doc_id long, log_weight double, n_features long"


def features(data: np.ndarray, bounds: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each row, end to end, and how many each has."""
    low = LOWER[data]
    parts = [runs(_WORD[data], bounds), runs(~_WORD[data] & ~SPACE[data], bounds)]
    starts, ends = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    one = span_hashes(low, starts, ends)
    row = np.searchsorted(bounds, starts, "right") - 1
    pair = np.flatnonzero(row[1:] == row[:-1])
    two = mix(mix(one[pair]) + one[pair + 1] + _U(0x6A09E667F3BCC909))
    every = np.concatenate([one, two]) >> _U(64 - (buckets.bit_length() - 1))
    rows = np.concatenate([row, row[pair]])
    order = np.argsort(rows, kind="stable")
    return every[order].astype(np.int64), np.bincount(rows, minlength=len(bounds) - 1)


def fit(docs: DataFrame, good: DataFrame, buckets: int, prior: float) -> np.ndarray | None:
    """The log of the ratio of every bucket; None without good rows. good: (doc_id) of the rows of the target model, a bounded number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            target = batch.column(0).to_numpy(zero_copy_only=False)
            for first, end, data, bounds in blocks(batch.column(1)):
                every, counts = features(data, bounds, buckets)
                total[0] += np.bincount(every, minlength=buckets)
                total[1] += np.bincount(every[np.repeat(target[first:end], counts)], minlength=buckets)
        for at in range(0, buckets, 1 << 16):
            b = np.arange(at, min(buckets, at + (1 << 16)))
            b = b[total[0, b] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(total[0, b]), pa.array(total[1, b])], ["bucket", "raw", "target"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = rows.join(F.broadcast(good.select(F.col("doc_id").alias("good_id")).distinct()), F.col("doc_id") == F.col("good_id"), "left")
    marked = marked.select(F.col("good_id").isNotNull().alias("target"), "text")
    table = map_texts(marked, count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    if table.num_rows:  # at most one row for each bucket
        raw[table.column("bucket").to_numpy()], target[table.column("bucket").to_numpy()] = table.column("raw").to_numpy(), table.column("target").to_numpy()
    if not target.sum():
        return None
    return np.log((target + prior) / (raw * (target.sum() / raw.sum()) + prior))


def score(docs: DataFrame, ratio: np.ndarray, seed: int) -> DataFrame:
    """``docs`` with log_weight, n_features and gumbel_key of every row, in the last places; names that ``docs`` has get underscores."""
    weight, number, key = free_names(docs, "log_weight", "n_features", "gumbel_key")
    sent = docs.sparkSession.sparkContext.broadcast(ratio)  # a double for each bucket
    schema = T.StructType([*docs.schema.fields, T.StructField(weight, T.DoubleType()), T.StructField(number, T.LongType())])
    names, text = schema.names, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in blocks(batch.column(text)):
                every, counts = features(data, bounds, len(sent.value))
                sums = np.bincount(np.repeat(np.arange(end - first), counts), sent.value[every], end - first)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, pa.array(sums.astype(np.float64)), pa.array(counts.astype(np.int64))], names)

    noise = -F.log(-F.log((_draw("gumbel", seed) + 0.5) / F.lit(float(1 << 52))))
    return map_texts(docs, run, schema).withColumn(key, F.col(weight) + noise)


def _draw(what: str, seed: int) -> Column:
    """52 bits from a hash of seed and doc_id."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{what}-{seed}"), name)), 1, 13), 16, 10).cast("long")


def kth_largest(keys: DataFrame, k: int, bins: int = 4096, few: int = 50_000) -> float:
    """The k-th largest of the doubles in column ``key``: counts of ever narrower intervals, then a sort of what is left."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while True:
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        if high <= low:
            return float(low)
        width = (high - low) / bins
        at = F.least(F.floor((F.col("key") - low) / F.lit(width)).cast("int"), F.lit(bins - 1))
        counts = sorted(((r.at, r.n, r.lo, r.hi) for r in inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()), reverse=True)
        for _, n, lo, hi in counts:
            if k <= n:
                break
            k -= n
        if n <= few:
            return float(keys.filter((F.col("key") >= lo) & (F.col("key") <= hi)).orderBy(F.col("key").desc()).limit(k).agg(F.min("key")).first()[0])
        low, high = lo, hi


def decide(docs: DataFrame, labels: DataFrame, buckets: int, prior: float, miss: float, k: int | None, seed: int, sample: int) -> tuple[np.ndarray | None, DataFrame | None, float]:
    """The ratio, the scores of all rows (doc_id, log_weight, n_features, gumbel_key), and the k-th largest key."""
    rows = labels.filter("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = pinned(rows.withColumn("draw", _draw("fold", seed)).orderBy("draw", "doc_id").limit(sample).select("doc_id", (F.col("draw") % 5 == 0).alias("out")), "good")
    ratio = fit(docs, good.filter("NOT out"), buckets, prior)
    if ratio is None:
        return None, None, -np.inf
    scored = pinned(score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ratio, seed).drop("text"), "scored")
    n = scored.count()
    if k is None:
        held = scored.join(F.broadcast(good.filter("out")), "doc_id", "left_semi").select(F.col("log_weight").alias("key"))
        m = held.count()
        k = scored.filter(F.col("log_weight") >= kth_largest(held, max(1, math.ceil(m * (1 - miss))))).count() if m else n
    if k >= n or not n:
        return ratio, scored, -np.inf
    return ratio, scored, kth_largest(scored.select(F.col("gumbel_key").alias("key")), k) if k > 0 else np.inf


def resample(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 18, prior: float = 8.0, miss: float = 0.002, k: int | None = None, seed: int = 5, sample: int = 25_000) -> DataFrame:
    """doc_id, log_weight, n_features, gumbel_key, kept of every row of ``docs`` (doc_id, text).

    labels: doc_id, quality, toxic; a row is good with quality 1 and toxic 0. k: rows to keep, by default found from the labels.
    sample: at most so many good labelled rows teach the target model (the raw model counts all rows).
    """
    ratio, scored, floor = decide(docs, labels, buckets, prior, miss, k, seed, sample)
    if ratio is None:
        zero = F.lit(0.0)
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), zero.alias("log_weight"), F.lit(0).cast("long").alias("n_features"), zero.alias("gumbel_key"), F.lit(True).alias("kept"))
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(float(floor)))


def selected(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 18, prior: float = 8.0, miss: float = 0.002, k: int | None = None, seed: int = 5, sample: int = 25_000) -> DataFrame:
    """The rows of ``docs``, all columns, that ``resample`` keeps; they are scored once more, so that no text is shuffled."""
    ratio, _, floor = decide(docs, labels, buckets, prior, miss, k, seed, sample)
    if ratio is None:
        return docs
    scored = score(docs, ratio, seed)
    return scored.filter(F.col(scored.columns[-1]) >= F.lit(float(floor))).select(*docs.columns)
