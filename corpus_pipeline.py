"""A training corpus from ``documents``: quality, language, near duplicates, source mixture, packing.

STAGES lists the stages; each takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of documents. Quality and language are decided row by row, near duplicates by doc_id: a
decision holds for all rows of the doc_id, and rows with a null doc_id stay.

Cases, for every stage: an empty table gives an empty result; very long texts are read in whole; further columns are kept as they are,
whatever their names; equal rows are treated alike. What a null does is stated with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm import importance, language_mixture, near_dedup, packing, source_mix
from martlens.llm.common import pinned

#: Share of a document's main language below which the document is rejected as mixed.
LEAST_SHARE = 0.5


def _without(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those whose doc_id has no kept row in ``kept`` (doc_id, kept).

    Rows that a bitmap of the dropped doc_ids doesn't mark stay where they are; only the marked ones are joined.
    """
    gone = kept.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("kept").alias("any")).filter(~F.col("any")).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    marked = near_dedup.marks(docs, gone)
    mark = marked.columns[-1]
    sure = marked.filter(~F.col(mark)).select(*docs.columns)
    doubtful = marked.filter(F.col(mark)).select(*docs.columns).join(gone, "doc_id", "left_anti").select(*docs.columns)
    return sure.unionByName(doubtful)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the good labelled ones selects. A null text weighs 0, like an empty one; without good labels all stay."""
    return importance.selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, mainly in one language; a null text has none. Where nothing is labelled, nothing is rejected but texts without letters."""
    model = language_mixture.learn(docs)
    if not model[0]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return language_mixture.in_one_language(docs, model, LEAST_SHARE)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more), that of the smallest doc_id.

    Of several rows of a doc_id, the one of the smallest text (a null first), then source, then lang stays; rows with a null doc_id all stay.
    """
    found = pinned(near_dedup.near_duplicates(docs, shingle_size=5, percent=80), "duplicates")
    left = _without(docs, found.select("doc_id", "kept"))
    if docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").limit(1).count():
        # A row for each doc_id, picked by its values, so that a run gives the same rows as another.
        first = F.struct(*[F.col(c) for c in ("text", "source", "lang") if c in left.columns], F.xxhash64(F.to_json(F.struct(*[c for c in left.columns if c != "doc_id"]))))
        named = left.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in left.columns if c != "doc_id"]), first).alias("row"))
        named = named.select("doc_id", "row.*").select(*left.columns)
        left = named.unionByName(left.filter(F.col("doc_id").isNull()))
    return left


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated towards the square root of their volumes, in random order. A null source is a source; rows without a doc_id are drawn by their text."""
    return source_mix.replicate(docs, temperature=0.5).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens. A null text is a document of the closing id alone."""
    return packing.pack(docs, capacity=4096, closing_id=1)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", deduplicate), ("source_mix", mix), ("packing", pack)]

#: The stages hash, fit models and tokenise; SQL can't express them. tests/llm checks each stage's rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
