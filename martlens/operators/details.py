"""Branches of the operators on costs, health, endpoints, failures, embeddings and the feed that need their full inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.functions.latest import before, ranked
from martlens.operators import health

#: Fixed value: dollars for a million tokens where a model has no rate of its own.
DEFAULT_RATE = 0.15


def usage_cost(usage: DataFrame, rates: DataFrame, default: float = DEFAULT_RATE) -> DataFrame:
    """``usage`` (run_id, model, prompt, completion, total, ...) with tokens, cost in dollars, six places, and the same as micro, by ``rates`` (model, rate).

    Without a total the sum of prompt and completion counts, each 0 if null. No tokens cost nothing; a model without a rate has the default one.
    """
    tokens = F.coalesce("total", F.coalesce("prompt", F.lit(0)) + F.coalesce("completion", F.lit(0))).cast("long")
    priced = usage.join(rates.groupBy("model").agg(F.max("rate").alias("rate")), "model", "left").withColumn("tokens", tokens)
    # In millionths of a dollar, as whole numbers, so that halves round up everywhere.
    rate = F.round(F.coalesce("rate", F.lit(default)) * 1_000_000).cast("long")
    micro = F.when(F.col("tokens") > 0, F.floor((F.col("tokens") * rate + 500_000) / 1_000_000)).otherwise(0)
    return priced.withColumn("micro", micro.cast("long")).withColumn("cost", F.col("micro") / 1_000_000).drop("rate")


def cost_summary(costs: DataFrame, as_of: str, days: int = 30, budget: float = 0.1) -> DataFrame:
    """One row of the completed runs (started_at, status, micro, tokens) of a span: runs, cost, tokens, how many above the budget, and the average, four places, 0 without runs."""
    rows = costs.filter((F.col("started_at") > before(as_of, days)) & (F.col("status") == "completed"))
    out = rows.agg(F.count("*").alias("runs"), F.coalesce(F.sum("micro"), F.lit(0)).alias("micro"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(F.col("micro") > round(budget * 1_000_000)).alias("over_budget"))
    average = F.when(F.col("runs") > 0, F.floor((F.col("micro") + 50 * F.col("runs")) / (100 * F.col("runs"))) / 10_000).otherwise(0.0)
    return out.select("runs", (F.col("micro") / 1_000_000).alias("cost"), "tokens", "over_budget", average.alias("average"))


def anomaly_details(scored: DataFrame) -> DataFrame:
    """run_id and anomalies of each run that ``health.health_score`` has scored: structs of type, severity, what was observed and the limit or baseline it fell below.

    A run that failed or found nothing has one, whose observed value is its catalogue's size. A low score without another cause is a drop of the catalogue.
    """
    c = F.col

    def found(kind: Column | str, severity: Column | str, observed: Column, limit: Column | float) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(kind).alias("type"), lit(severity).alias("severity"), observed.cast("double").alias("observed"), lit(limit).cast("double").alias("limit"))

    checks = [
        F.when((c("baseline") > 0) & (c("catalog") < c("baseline") * 0.7), found("catalog_drop", F.when(c("catalog") < c("baseline") * 0.5, "critical").otherwise("warning"), c("catalog"), c("baseline"))),
        F.when(c("endpoint") < 0.5, found(F.when(c("errors") > 0, "endpoint_4xx").otherwise("endpoint_5xx"), F.when(c("endpoint") < 0.3, "critical").otherwise("warning"), c("endpoint"), 0.5)),
        F.when((c("extraction") < 0.5) & (c("fetched") > 0), found("extraction_rate_drop", "warning", c("extraction"), 0.5)), F.when((c("price") < 0.7) & (c("extracted") > 0), found("field_missing", "warning", c("price"), 0.7)),
        F.when((c("coverage") < 0.7) & (c("mode") == "api"), found("pagination_break", "warning", c("coverage"), 0.7)),
    ]
    have = F.array_compact(F.array(*checks))
    have = F.when((F.size(have) == 0) & (c("score") < 0.4), F.array(found("catalog_drop", "critical", c("score"), 0.4))).otherwise(have)
    broken = (c("status") == "failed") | ((c("status") == "completed") & (c("catalog") == 0))
    failed = F.array(found(F.when(c("catalog") == 0, "catalog_drop").otherwise("endpoint_5xx"), "critical", c("catalog"), c("baseline")))
    return scored.select("run_id", F.when(broken, failed).otherwise(have).alias("anomalies"))


def endpoints_to_try(endpoints: DataFrame, asked: DataFrame, own: int = 4, preferred: int = 8, others: int = 6) -> DataFrame:
    """shop_id, place, url, method, source: what each of ``asked`` (shop_id, platform, prefer_own) may try, of endpoints (shop_id, platform, url, method, reliability, active).

    The shop's own active ones by reliability; ``preferred`` of them, and nothing else if there is one, where own ones are preferred. Then the best of other shops on the platform, unless that is
    unknown, but for those that are the shop's own URL and method. A shop keeps out only its own rows, so a platform's best of each shop, twice ``others`` in all, hold what any shop can get.
    """
    live = endpoints.filter("active")
    order = [F.col("reliability").desc_nulls_first(), F.col("url"), F.col("method")]
    mine = asked.join(live.drop("platform"), "shop_id").withColumn("place", ranked(["shop_id"], *order))
    mine = mine.filter(F.col("place") <= F.when(F.col("prefer_own"), preferred).otherwise(own))
    satisfied = mine.filter("prefer_own").select("shop_id").distinct()
    open_ = asked.filter("platform IS NOT NULL AND platform <> 'unknown'").join(satisfied, "shop_id", "left_anti").select("shop_id", "platform")
    best = live.withColumn("r", ranked(["platform", "shop_id"], *order)).filter(F.col("r") <= others)
    best = best.withColumn("r", ranked(["platform"], *order, F.col("shop_id"))).filter(F.col("r") <= 2 * others).select("platform", F.col("shop_id").alias("from"), "url", "method", "reliability")
    more = open_.join(best, "platform").filter("shop_id <> from").withColumn("r", ranked(["shop_id"], *order, F.col("from"))).filter(F.col("r") <= others)
    more = more.join(mine.select("shop_id", "url", "method"), ["shop_id", "url", "method"], "left_anti")
    count = mine.groupBy("shop_id").agg(F.count("*").cast("int").alias("k"))
    more = more.join(count, "shop_id", "left").withColumn("place", ranked(["shop_id"], F.col("r")) + F.coalesce("k", F.lit(0)))
    columns = ["shop_id", "place", "url", "method"]
    return mine.select(*columns, F.lit("own").alias("source")).unionByName(more.select(*columns, F.lit("platform").alias("source")))


# What to do about a cause of failures, by the cause's name.
ADVICE = {
    "bot protection": "seed captures by hand", "no product pattern": "look for categories or sitemaps", "no catalog API": "extend endpoint patterns", "failed validation": "revise thresholds or field maps", "candidate not stronger": "capture the network anew without stored endpoints",
}


def failure_advice(runs: DataFrame, most: int = 20) -> DataFrame:
    """cause, point, runs, advice and sites, the first ``most`` in order, of runs with ``site`` that aren't a success; the number of sites is whole."""
    causes = health.run_causes(runs)
    advice = F.coalesce(*[F.when(F.col("cause") == k, v) for k, v in ADVICE.items()], F.lit("read the log, capture the network again"))
    sites = causes.select("cause", "point", "site").distinct()
    first = sites.withColumn("rn", ranked(["cause", "point"], F.col("site"))).filter(F.col("rn") <= most).groupBy("cause", "point").agg(F.array_sort(F.collect_list("site")).alias("sites"))
    per = causes.groupBy("cause", "point").agg(F.count("*").alias("runs"))
    wide = sites.groupBy("cause", "point").agg(F.count("*").alias("n_sites"))
    return per.join(wide, ["cause", "point"]).join(first, ["cause", "point"]).select("cause", "point", "runs", "n_sites", advice.alias("advice"), "sites")


def embedding_text(listings: DataFrame, most: int = 8) -> DataFrame:
    """listing_id and text of listings (listing_id, brand, category: array, title, attributes: array of key and value): brand, the last two categories, title, and the first attributes, empty parts left out."""
    path = F.concat_ws(" > ", F.slice(F.filter(F.coalesce("category", F.array().cast("array<string>")), lambda c: c != ""), -2, 2))
    path = F.when(F.size(F.filter(F.coalesce("category", F.array().cast("array<string>")), lambda c: c != "")) == 1, F.concat_ws("", F.filter("category", lambda c: c != ""))).otherwise(path)
    attributes = F.concat_ws(", ", F.transform(F.slice("attributes", 1, most), lambda a: F.concat(a["key"], F.lit(": "), a["value"])))
    parts = F.filter(F.array("brand", path, "title", attributes), lambda p: p.isNotNull() & (p != ""))
    return listings.select("listing_id", F.concat_ws(" | ", parts).alias("text"))


def upsert_embeddings(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Embeddings (vec_id, label, embedding) with those of ``batch`` (..., made_at) put in: of several for an id the one made last, whole."""
    last = batch.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.max_by(F.struct("label", "embedding"), F.struct("made_at", F.hash("embedding"))).alias("n"))
    both = state.join(last, "vec_id", "full")
    return both.select("vec_id", *[F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in ("label", "embedding")])


def sitemap_rows(products: DataFrame, base: str, most: int = 5000) -> DataFrame:
    """loc, lastmod, changefreq, priority: the home page, then the ``most`` products (product_id, updated_at) changed last; without products the home page alone."""
    newest = products.orderBy(F.col("updated_at").desc_nulls_last(), "product_id").limit(most)
    rows = newest.select(F.concat(F.lit(f"{base}/product/"), F.col("product_id").cast("string")).alias("loc"), F.date_format("updated_at", "yyyy-MM-dd").alias("lastmod"), F.lit("daily").alias("changefreq"), F.lit(0.7).alias("priority"))
    home = products.sparkSession.createDataFrame([(base, None, "daily", 1.0)], rows.schema)
    return home.unionByName(rows)
