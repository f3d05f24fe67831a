"""Catalogue, brand, search-rank and operational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.functions.latest import before, latest_by, ranked


def latest_price(price_obs: DataFrame) -> DataFrame:
    return latest_by(price_obs, ["listing_id"], ["ts", "o", "n"], ["amount", "currency", "ts"])


def product_summaries(products: DataFrame, listings: DataFrame, price_obs: DataFrame, limit: int | None = None) -> DataFrame:
    offers = listings.filter("active").join(latest_price(price_obs).select("listing_id", "amount", "currency"), "listing_id", "left")
    per = offers.groupBy("product_id").agg(F.min("amount").alias("min_price"), F.min("currency").alias("currency"), F.countDistinct("listing_id").alias("offers"))
    out = products.join(per, "product_id", "left").select("product_id", "canonical_title", "brand", "min_price", F.coalesce("currency", F.lit("CAD")).alias("currency"), F.coalesce("offers", F.lit(0)).alias("offers"))
    return out.orderBy(F.col("offers").desc(), F.col("min_price").asc_nulls_last(), "product_id").limit(limit) if limit else out


def search_products(products: DataFrame, listings: DataFrame, price_obs: DataFrame, text: str, limit: int = 24) -> DataFrame:
    """Every token of ``text`` occurs in title or brand, in any case and order."""
    hit = products
    for token in text.lower().split():
        hit = hit.filter(F.lower("canonical_title").contains(token) | F.lower("brand").contains(token))
    return product_summaries(hit, listings, price_obs, limit)


def product_offers(listings: DataFrame, price_obs: DataFrame, stock_obs: DataFrame, shops: DataFrame) -> DataFrame:
    stock = latest_by(stock_obs, ["listing_id"], ["ts", "o", "n"], ["availability"])
    out = listings.filter("active").join(latest_price(price_obs).drop("ts"), "listing_id", "left").join(stock, "listing_id", "left").join(shops.select("shop_id", "name"), "shop_id")
    out = out.withColumn("place", ranked(["product_id"], F.col("amount").asc_nulls_last(), F.col("listing_id")))
    return out.select("product_id", "place", "listing_id", "name", "amount", "currency", F.coalesce("availability", F.lit("unknown")).alias("availability"))


def price_history(listings: DataFrame, price_obs: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    rows = price_obs.filter(F.col("ts") > before(as_of, days)).join(listings.select("listing_id", "product_id"), "listing_id")
    return rows.groupBy("product_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.min("amount").alias("min_price"))


def brand_growth(listings: DataFrame, products: DataFrame, as_of: str, days: int = 30, top: int = 25) -> DataFrame:
    new = F.col("first_seen") > before(as_of, days)
    counts = listings.filter("active").join(products.select("product_id", "brand"), "product_id").groupBy("brand").agg(F.count(F.when(new, 1)).alias("added"), F.count("*").alias("total"))
    return counts.filter("added > 0").withColumn("growth", F.col("added") / F.col("total")).orderBy(F.col("added").desc(), "brand").limit(top)


def latest_rank(serp_obs: DataFrame) -> DataFrame:
    return latest_by(serp_obs, ["keyword_id", "shop_id"], ["ts", "o"], ["rank"])


def keyword_gaps(serp_obs: DataFrame, own: int, top: int = 20) -> DataFrame:
    """Keywords on which others rank up to ``top`` and ``own`` has no rank at all."""
    ranks = latest_rank(serp_obs)
    mine = ranks.filter(F.col("shop_id") == own).select("keyword_id")
    return ranks.filter((F.col("shop_id") != own) & (F.col("rank") <= top)).join(mine, "keyword_id", "left_anti").select("keyword_id", "shop_id", "rank")


def crawl_health_overview(shops: DataFrame, runs: DataFrame, listings: DataFrame) -> DataFrame:
    last = latest_by(runs, ["shop_id"], ["started_at", "run_id"], ["run_id", "status", "started_at"])
    active = listings.filter("active").groupBy("shop_id").agg(F.count("*").alias("active_listings"))
    out = shops.select("shop_id", "name").join(last, "shop_id", "left").join(active, "shop_id", "left")
    return out.select("shop_id", "name", "run_id", "status", "started_at", F.coalesce("active_listings", F.lit(0)).alias("active_listings"))


def data_freshness(shops: DataFrame, listings: DataFrame, price_obs: DataFrame, as_of: str, stale_hours: int = 36) -> DataFrame:
    newest = price_obs.groupBy("listing_id").agg(F.max("ts").alias("ts")).join(listings.select("listing_id", "shop_id"), "listing_id").groupBy("shop_id").agg(F.max("ts").alias("ts"))
    seconds = F.expr(f"timestampdiff(SECOND, ts, {as_of})")
    out = shops.select("shop_id").join(newest, "shop_id", "left").withColumn("seconds", seconds)
    return out.select("shop_id", F.floor((F.col("seconds") + 180) / 360).alias("tenth_hours"), (F.col("ts").isNull() | (F.col("seconds") > stale_hours * 3600)).alias("stale"))


def token_cost(tokens: str) -> object:
    """Millionths of a dollar at 0.15 dollars a million tokens, rounded half up; 0 for none."""
    return F.when(F.col(tokens) > 0, F.floor((F.col(tokens) * 15 + 50) / 100)).otherwise(F.lit(0)).cast("long")


def discovery_cost(runs: DataFrame, as_of: str, days: int = 30, budget_micro: int = 100_000) -> DataFrame:
    cost = runs.filter(F.col("started_at") > before(as_of, days)).withColumn("micro", token_cost("tokens"))
    return cost.agg(F.count("*").alias("runs"), F.coalesce(F.sum("micro"), F.lit(0)).alias("micro"), F.count(F.when(F.col("micro") > budget_micro, 1)).alias("over_budget"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def discovery_cost_weekly(runs: DataFrame, as_of: str, days: int = 56, newest: int = 8) -> DataFrame:
    rows = runs.filter(F.col("started_at") > before(as_of, days)).withColumn("week", F.date_format(F.date_trunc("week", "started_at"), "yyyy-MM-dd"))
    return rows.groupBy("week").agg(F.count("*").alias("runs"), F.sum(token_cost("tokens")).alias("micro")).orderBy(F.col("week").desc()).limit(newest)


def product_counts(listings: DataFrame) -> DataFrame:
    return listings.groupBy("shop_id").agg(F.count("*").alias("listings"))
