"""Ingest of product rows, state tables and taxonomy."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.functions.latest import ranked, upsert
from martlens.functions.shared import tasks_for


def upsert_listings(state: DataFrame, batch: DataFrame) -> DataFrame:
    """By url: a new listing takes everything; a known one keeps sku, shop_id and first_seen. Of several rows of a url in the batch the last by last_seen counts."""
    batch = batch.withColumn("rn", ranked(["url"], F.col("last_seen").desc(), F.col("product_id").desc())).filter("rn = 1").drop("rn")
    return upsert(state, batch, ["url"], ["sku", "shop_id", "first_seen"], ["product_id", "last_seen"])


UPDATED = ["title", "brand", "category", "gtin", "mpn", "image", "attributes"]


def upsert_all_columns(state: DataFrame, batch: DataFrame) -> DataFrame:
    """As ``upsert_listings`` with every column: ``UPDATED`` takes the batch's value even where that is null; seen listings are active again."""
    tasks = max(tasks_for(state), tasks_for(batch))
    last = batch.repartition(tasks, "url").groupBy("url").agg(F.max_by(F.struct("sku", "shop_id", "first_seen", "last_seen", *UPDATED), F.struct("last_seen", "sku")).alias("b"))
    rows = state.withColumn("known", F.lit(True)).repartition(tasks, "url").join(last, "url", "full")
    keep = lambda c: F.when(F.col("known"), F.col(c)).otherwise(F.col(f"b.{c}")).alias(c)
    take = lambda c: F.when(F.col("b").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("url", *map(keep, ("sku", "shop_id", "first_seen")), *map(take, ("last_seen", *UPDATED)), (F.col("b").isNotNull() | F.col("active")).alias("active"))


def fetch_log_counters(log: DataFrame, shortest: int = 200) -> DataFrame:
    """Per run of a log (run_id, http_status, body_chars, extracted): discovered, fetched, extracted, errors.

    A status from 400 or a body below ``shortest`` is an error, but a 429 is to be tried again and counts as neither; nulls are errors.
    """
    again = F.coalesce(F.col("http_status") == 429, F.lit(False))
    good = F.coalesce((F.col("http_status") < 400) & (F.col("body_chars") >= shortest), F.lit(False))
    return log.groupBy("run_id").agg(
        F.count("*").alias("discovered"), F.count_if(good).alias("fetched"), F.count_if(good & F.coalesce("extracted", F.lit(False))).alias("extracted"), F.count_if(~good & ~again).alias("errors")
    )


def is_new(state: DataFrame, batch: DataFrame) -> DataFrame:
    return batch.join(state.select("url"), "url", "left_anti")


def price_facts(rows: DataFrame) -> DataFrame:
    """Facts of the rows (listing_id, price, list_price, ts) that have a price, in minor units; the list price may be null."""
    minor = lambda c: F.round(F.col(c) * 100).cast("long")
    return rows.filter(F.col("price").isNotNull()).select("listing_id", minor("price").alias("amount"), minor("list_price").alias("list_amount"), "ts")


def mark_stale(listings: DataFrame, cutoff: Column) -> DataFrame:
    return listings.withColumn("active", F.when(F.col("last_seen") < cutoff, F.lit(False)).otherwise(F.col("active")))


def dedupe_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("rn", ranked(keys, *[F.col(c) for c in order])).filter("rn = 1").drop("rn")


def embedding_text(products: DataFrame) -> DataFrame:
    """brand | last two categories | title, empty parts left out."""
    path = F.concat_ws(" > ", F.slice(F.split("category", "/"), -2, 2))
    parts = F.filter(F.array(F.col("brand"), path, F.col("canonical_title")), lambda p: p.isNotNull() & (p != ""))
    return products.select("product_id", F.concat_ws(" | ", parts).alias("text"))


def run_counters(counts: DataFrame) -> DataFrame:
    return counts.select("run_id", "discovered", "fetched", "extracted", "errors", F.try_divide(100 * F.col("extracted"), F.col("fetched")).alias("yield_pct"))


def finalize_runs(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Running runs that discovered something and have nothing pending are completed."""
    pending = counts.filter(F.col("fetched") + F.col("errors") < F.col("discovered")).select("run_id")
    known = counts.select("run_id")
    done = runs.filter("status = 'running'").join(known, "run_id", "left_semi").join(pending, "run_id", "left_anti").select("run_id")
    done = done.withColumn("done", F.lit(True))
    return runs.join(done, "run_id", "left").select("run_id", F.when(F.col("done"), "completed").otherwise(F.col("status")).alias("status"))


@F.pandas_udf(T.StringType())
def _without_marks(text: pd.Series) -> pd.Series:
    """NFKD without the combining marks U+0300 to U+036F; Spark has no normalisation of its own."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not "\u0300" <= c <= "\u036f"))


def slug(text: Column) -> Column:
    """Lower case without accents, every run of other characters than letters and digits one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_without_marks(F.lower(text)), "[^a-z0-9]+", "-"), "^-|-$", "")


def canonical_brands(products: DataFrame) -> DataFrame:
    raw = products.select("brand").filter("brand is not null").distinct().withColumn("slug", slug(F.col("brand")))
    return raw.groupBy("slug").agg(F.max("brand").alias("name"), F.count("*").alias("aliases")).withColumn("brand_id", F.substring(F.md5("slug"), 1, 12))


def brand_ids(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """row_id, brand_id of rows (row_id, brand): the id that its slug has in ``aliases`` (alias, brand_id; the smallest of several), else
    that of a brand of its slug; null for a null or blank brand. Each brand is turned into a slug once."""
    raw = rows.filter(F.col("brand").rlike("\\S")).select("brand").distinct().withColumn("alias", slug(F.col("brand")))
    known = aliases.groupBy("alias").agg(F.min("brand_id").alias("known"))
    ids = raw.join(known, "alias", "left").select("brand", F.coalesce("known", F.substring(F.md5("alias"), 1, 12)).alias("brand_id"))
    return rows.select("row_id", "brand").join(ids, "brand", "left").select("row_id", "brand_id")


def canonical_categories(products: DataFrame) -> DataFrame:
    """Every prefix of every category path, with its depth and parent."""
    parts = products.select(F.split("category", "/").alias("parts")).distinct()
    each = parts.select("parts", F.posexplode("parts").alias("depth", "name"))
    path = F.concat_ws("/", F.slice("parts", F.lit(1), F.col("depth") + 1))
    parent = F.when(F.col("depth") > 0, F.concat_ws("/", F.slice("parts", F.lit(1), F.col("depth"))))
    return each.select(path.alias("path"), "name", "depth", parent.alias("parent")).distinct()


def category_subtree(products: DataFrame, path: str) -> DataFrame:
    return products.filter((F.col("category") == path) | F.col("category").startswith(path + "/")).select("product_id", "category")


# The states of availability.
AVAILABILITY = ["in_stock", "out_of_stock", "preorder", "discontinued", "unknown"]


def map_availability(text: Column) -> Column:
    """Free text to a state: the first of the words in this order, else the state itself, else unknown."""
    t = F.lower(text)
    found = F.when(t.contains("instock"), "in_stock").when(t.contains("outofstock") | t.contains("soldout"), "out_of_stock").when(t.contains("preorder"), "preorder").when(t.contains("discontinued"), "discontinued")
    return found.when(t.isin(AVAILABILITY), t).otherwise("unknown")


def recipe_availability(text: Column) -> Column:
    """The rule of recipes: in stock or available, then any text with out in it, then preorder, else unknown."""
    t = F.coalesce(F.lower(text), F.lit(""))
    return F.when(t.contains("in_stock") | t.contains("instock") | (t == "available"), "in_stock").when(t.contains("out"), "out_of_stock").when(t.contains("preorder"), "preorder").otherwise("unknown")


def validate_products(rows: DataFrame) -> DataFrame:
    """Rows with the array of what is wrong with each; empty where it is valid."""
    checks = [("title", F.coalesce(F.length("title"), F.lit(0)) == 0), ("url", ~F.coalesce(F.col("url").rlike("^https?://[^/ ]+"), F.lit(False))), ("price", F.coalesce(F.col("price") < 0, F.lit(False)))]
    wrong = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]), lambda x: x.isNotNull())
    return rows.withColumn("wrong", F.concat_ws(",", wrong))
