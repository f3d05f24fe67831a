"""Crawl health, recipe versions, endpoint patterns and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlens.functions.latest import before, latest_by, ranked


# Discovery modes that take products without fetching pages.
DIRECT = ["api", "jina_categories"]


def health_inputs(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Four ratios from 0 to 1 of each run: coverage of a baseline, endpoint and extraction success, price presence.

    The baseline is the catalogue of the shop's run before, else the estimate of discovery, else none.
    """
    w = Window.partitionBy("shop_id").orderBy("started_at", "run_id")
    c = F.col
    joined = runs.join(counts, "run_id").withColumn("catalog", F.when(c("extracted") != 0, c("extracted")).otherwise(c("discovered")))
    before = F.coalesce(F.lag("catalog").over(w), F.lit(0))
    joined = joined.withColumn("baseline", F.when(before > 0, before).otherwise(F.greatest(F.coalesce("estimated_size", F.lit(0)), F.lit(0))))
    share = lambda a, b: F.least(F.lit(1.0), F.try_divide(a.cast("double"), b.cast("double")))
    direct, some = c("mode").isin(DIRECT), F.when(c("catalog") > 0, 1.0).otherwise(0.0)
    attempts = F.greatest(c("discovered"), c("catalog"), F.lit(1))
    coverage = F.when(c("baseline") > 0, share(c("catalog"), c("baseline"))).otherwise(some)
    endpoint = F.when(direct, F.greatest(F.lit(0.0), F.lit(1.0) - c("errors") / attempts)).when(c("discovered") > 0, share(c("fetched"), c("discovered"))).otherwise(1.0)
    extraction = F.when(direct, some).when(c("fetched") > 0, share(c("extracted"), c("fetched"))).otherwise(1.0)
    price = F.when(c("extracted") > 0, share(c("priced"), c("extracted"))).otherwise(0.0)
    return joined.select("run_id", "shop_id", "started_at", "status", "mode", "discovered", "fetched", "extracted", "errors", "catalog", "baseline", coverage.alias("coverage"), endpoint.alias("endpoint"), extraction.alias("extraction"), price.alias("price"))


def _degraded() -> Column:
    return (F.col("status") == "failed") | ((F.col("status") == "completed") & (F.col("catalog") == 0))


def health_score(inputs: DataFrame) -> DataFrame:
    """Weighted .3, .3, .2 and .2; 0 for failed runs and for completed ones without a product or URL."""
    score = F.col("coverage") * 0.3 + F.col("endpoint") * 0.3 + F.col("extraction") * 0.2 + F.col("price") * 0.2
    return inputs.withColumn("score", F.when(_degraded(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))))


def health_anomalies(scored: DataFrame) -> DataFrame:
    """type:severity of what is wrong with a run, in a fixed order; a failed one has a single cause."""
    c = F.col
    found = [
        F.when((c("baseline") > 0) & (c("catalog") < c("baseline") * 0.7), F.when(c("catalog") < c("baseline") * 0.5, "catalog_drop:critical").otherwise("catalog_drop:warning")),
        F.when(c("endpoint") < 0.5, F.concat(F.when(c("errors") > 0, "endpoint_4xx").otherwise("endpoint_5xx"), F.when(c("endpoint") < 0.3, ":critical").otherwise(":warning"))),
        F.when((c("extraction") < 0.5) & (c("fetched") > 0), "extraction_rate_drop:warning"), F.when((c("price") < 0.7) & (c("extracted") > 0), "field_missing:warning"),
        F.when((c("coverage") < 0.7) & (c("mode") == "api"), "pagination_break:warning"),
    ]
    have = F.array_compact(F.array(*found))
    have = F.when((F.size(have) == 0) & (c("score") < 0.4), F.array(F.lit("catalog_drop:critical"))).otherwise(have)
    failed = F.array(F.when(c("catalog") == 0, "catalog_drop:critical").otherwise("endpoint_5xx:critical"))
    return scored.select("run_id", "mode", "score", F.concat_ws(",", F.when(_degraded(), failed).otherwise(have)).alias("anomalies"))


def escalate(scored: DataFrame) -> DataFrame:
    """repair for an API recipe whose newest score is from 0.4 to below 0.7, rediscover when the last three are below 0.4, else none."""
    w = Window.partitionBy("shop_id").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    last = scored.withColumn("rn", F.row_number().over(w)).filter("rn <= 3")
    newest = lambda x: F.max(F.when(F.col("rn") == 1, x))
    per = last.groupBy("shop_id").agg(F.max("score").alias("best"), F.count("*").alias("n"), newest(F.col("score")).alias("newest"), newest(F.col("mode") == "api").alias("api"))
    action = F.when((F.col("n") == 3) & (F.col("best") < 0.4), "rediscover").when(F.col("api") & (F.col("newest") >= 0.4) & (F.col("newest") < 0.7), "repair").otherwise("none")
    return per.select("shop_id", "newest", action.alias("action"))


def jitter(key: Column) -> Column:
    """Seconds below an hour: the absolute value of a signed 32-bit hash of the key's code points, factor 31."""
    points = F.transform(F.filter(F.split(key, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("long"))
    h = F.aggregate(points, F.lit(0).cast("long"), lambda a, x: F.pmod(a * 31 + x, F.lit(1 << 32).cast("long")))
    return F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)) % 3600


def rediscovery_candidates(scored: DataFrame, shops: DataFrame, as_of: str, below: float = 0.5, days: int = 7) -> DataFrame:
    """Enabled shops (shop_id, key, enabled, last_rediscovery) with a score below ``below``, not rediscovered within ``days``."""
    last = latest_by(scored, ["shop_id"], ["started_at", "run_id"], ["score"])
    due = shops.filter(F.col("enabled") & (F.col("last_rediscovery").isNull() | (F.col("last_rediscovery") < before(as_of, days))))
    return due.join(last.filter(F.col("score") < below), "shop_id").select("shop_id", "score", jitter(F.col("key")).alias("delay_s"))


def repair_plan(anomalies: DataFrame) -> DataFrame:
    """Ordered distinct strategies for a run's anomalies; only API recipes can be repaired."""
    has = lambda *xs: F.col("anomalies").rlike("|".join(xs))
    steps = F.array_compact(F.array(
        F.when(has("endpoint_4xx", "endpoint_5xx"), "header_refresh"), F.when(has("endpoint_4xx", "endpoint_5xx"), "endpoint_swap"), F.when(has("pagination_break", "catalog_drop"), "pagination_fix"), F.when(has("field_missing"), "header_refresh"),
    ))
    steps = F.when((F.size(steps) == 0) & (F.col("anomalies") != ""), F.array(*map(F.lit, ("header_refresh", "pagination_fix", "endpoint_swap")))).otherwise(steps)
    return anomalies.select("run_id", F.when(F.col("mode") == "api", F.concat_ws(",", F.array_distinct(steps))).otherwise("").alias("plan"))


def repair_exhausted(attempts: DataFrame) -> DataFrame:
    """Shops whose last two repair attempts (shop_id, attempt_id, at, succeeded) both failed."""
    last = attempts.withColumn("rn", ranked(["shop_id"], F.col("at").desc(), F.col("attempt_id").desc())).filter("rn <= 2")
    per = last.groupBy("shop_id").agg(F.count("*").alias("n"), F.count(F.when(~F.col("succeeded"), 1)).alias("failed"))
    return per.select("shop_id", ((F.col("n") == 2) & (F.col("failed") == 2)).alias("exhausted"))


def append_versions(history: DataFrame, batch: DataFrame) -> DataFrame:
    """history (shop_id, version) with the batch (shop_id, run_id) appended: versions go on from each shop's last."""
    last = history.groupBy("shop_id").agg(F.max("version").alias("last"))
    new = batch.join(last, "shop_id", "left").withColumn("version", F.coalesce("last", F.lit(0)) + ranked(["shop_id"], F.col("run_id")))
    return history.select("shop_id", "version", "run_id").unionByName(new.select("shop_id", "version", "run_id"))


def write_versions(history: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch (shop_id, recipe_id, api_url, sitemap_urls, sample_urls, confidence) as new versions, in order of recipe_id.

    The primary endpoint is the API's, else the first sitemap, else the first sample page, else unknown; ``first`` marks a shop's first
    version, which resets its health.
    """
    last = history.groupBy("shop_id").agg(F.max("version").alias("last"))
    known = lambda c: F.nullif(c, F.lit(""))
    endpoint = F.coalesce(known(F.col("api_url")), known(F.get("sitemap_urls", F.lit(0))), known(F.get("sample_urls", F.lit(0))), F.lit("unknown"))
    version = F.coalesce("last", F.lit(0)) + ranked(["shop_id"], F.col("recipe_id"))
    rows = batch.join(last, "shop_id", "left").withColumn("version", version)
    return rows.select("shop_id", "version", "recipe_id", endpoint.alias("primary_endpoint"), "confidence", (F.col("version") == 1).alias("first"))


def shops_after_versions(shops: DataFrame, written: DataFrame) -> DataFrame:
    """shops (shop_id, health, confidence): those with new versions take the newest one's confidence, and health 1 if one was their first."""
    per = written.groupBy("shop_id").agg(F.max_by("confidence", "version").alias("newest"), F.max("version").alias("version"), F.max("first").alias("reset"))
    health = F.when(F.col("reset"), 1.0).otherwise(F.col("health"))
    return shops.join(per, "shop_id", "left").select("shop_id", health.alias("health"), F.when(F.col("version").isNotNull(), F.col("newest")).otherwise(F.col("confidence")).alias("confidence"))


def active_recipe(history: DataFrame) -> DataFrame:
    return latest_by(history, ["shop_id"], ["version"], ["version", "run_id"])


def recent_versions(history: DataFrame, newest: int = 10) -> DataFrame:
    return history.withColumn("place", ranked(["shop_id"], F.col("version").desc())).filter(F.col("place") <= newest)


def rollback_version(history: DataFrame, version: int = 1) -> DataFrame:
    """The old version of every shop once more, as its newest."""
    last = history.groupBy("shop_id").agg(F.max("version").alias("last"))
    again = history.filter(F.col("version") == version).join(last, "shop_id").select("shop_id", (F.col("last") + 1).alias("version"), "run_id")
    return history.select("shop_id", "version", "run_id").unionByName(again)


def backfill_versions(shops: DataFrame, history: DataFrame) -> DataFrame:
    """Version 1 for shops with a recipe and no history (shop_id, column_confidence, recipe_confidence, has_recipe); its confidence in percent: the shop's, else the recipe's, else 0."""
    new = shops.filter("has_recipe").join(history, "shop_id", "left_anti")
    return new.select("shop_id", F.lit(1).alias("version"), F.coalesce("column_confidence", "recipe_confidence", F.lit(0)).alias("confidence_pct"))


def promotion_guard(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """May a candidate replace what is there? Columns current, candidate (confidences), report (the candidate's validated confidence or
    null), current_size, candidate_size (catalogues), has_recipe. It must have a recipe or evidence, or the confidence itself.
    """
    c = F.col
    valid = c("has_recipe") | (c("candidate") >= least)
    better = ((c("candidate") >= least) & (c("current") < least)) | (c("candidate") > c("current") + 0.05)
    proven = (c("report") >= least) & (c("candidate_size") >= F.coalesce("current_size", F.lit(0))) & (c("candidate_size") > 0)
    return pairs.withColumn("promote", valid & (better | F.coalesce(proven, F.lit(False))))


# Segments of a path that are generalised, and what stands for them; characters that a pattern escapes.
SEGMENTS = [("^\\d+$", "\\d+"), ("(?i)^[0-9a-f-]{36}$", "[0-9a-f-]+"), ("(?i)^(?=.*\\d)[A-Z0-9_-]{8,}$", "[^/]+")]
SPECIAL = "([.*+?^${}()|\\[\\]\\\\])"


def url_shape(url: Column) -> Column:
    """A pattern of URLs like this one on any host: digits, uuids and id-like segments of the path generalised, the rest escaped."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    escaped = lambda s: F.regexp_replace(s, SPECIAL, r"\\$1")

    def part(s: Column) -> Column:
        out = None
        for pattern, put in SEGMENTS:
            out = F.when(s.rlike(pattern), put) if out is None else out.when(s.rlike(pattern), put)
        return out.otherwise(escaped(s))

    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    shape = F.concat(F.lit("https?://[^/]+/"), F.array_join(F.transform(segments, part), "/"))
    return F.when(url.rlike("^https?://[^/?#]+"), shape).otherwise(escaped(url))


def endpoint_patterns(endpoints: DataFrame, least: int = 3, success_pct: int = 80) -> DataFrame:
    """Shapes that at least ``least`` hosts share with a mean success of ``success_pct``; endpoints without a URL or with over 5 failures don't count."""
    rows = endpoints.filter((F.col("failures") <= 5) & (F.col("url") != "")).withColumn("shape", url_shape(F.col("url"))).withColumn("platform", F.coalesce("platform", F.lit("unknown")))
    success = F.greatest(F.lit(0), F.coalesce("reliability_pct", F.lit(85)) - F.least(5 * F.col("failures"), F.lit(40)))
    out = rows.groupBy("platform", "method", "endpoint_type", "shape").agg(F.countDistinct("host").alias("hosts"), F.sum(success).cast("long").alias("total"), F.count("*").alias("n"))
    return out.filter((F.col("hosts") >= least) & (F.col("total") >= success_pct * F.col("n")))


def match_patterns(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """Of each URL (page_id, url, platform) the best pattern of its platform, or of an unknown one, that matches at its start in any case.

    Patterns are few by construction (shared by several hosts); each platform's are joined by key, and the best is kept as it goes.
    """
    rank = F.struct((-F.col("total") / F.col("n")).alias("a"), (-F.col("hosts")).alias("b"), F.col("shape"), F.col("method"), F.col("endpoint_type"))
    asked = urls.select("page_id", "url", F.explode(F.array_distinct(F.array(F.coalesce("platform", F.lit("unknown")), F.lit("unknown")))).alias("platform"))
    hit = asked.join(patterns.withColumn("rank", rank), "platform").filter(F.expr("rlike(url, concat('(?i)^', shape))"))
    best = hit.groupBy("page_id").agg(F.min("rank").alias("best"))
    return best.select("page_id", F.col("best.shape").alias("shape"), F.col("best.endpoint_type").alias("endpoint_type"))


def candidate_endpoints(endpoints: DataFrame, own: int = 4, others: int = 6) -> DataFrame:
    """Of each host its own best endpoints by reliability, then the best of other hosts on its platform that aren't the same URL and method.

    A host needs at most ``others`` endpoints of any other, so twice that many of each platform hold all that a host can get.
    """
    order = [F.col("reliability_pct").desc_nulls_first(), F.col("page_id")]
    mine = endpoints.withColumn("place", ranked(["host"], *order)).filter(F.col("place") <= own).select("host", "place", "page_id", F.lit("own").alias("source"), "platform", "url", "method")
    best = endpoints.withColumn("r", ranked(["platform", "host"], *order)).filter(F.col("r") <= others)
    best = best.withColumn("r", ranked(["platform"], *order)).filter(F.col("r") <= 2 * others).select("platform", F.col("host").alias("from"), "page_id", "reliability_pct", "url", "method")
    asked = endpoints.select("platform", "host").distinct().join(best, "platform").filter("host <> from")
    asked = asked.withColumn("place", ranked(["platform", "host"], *order)).filter(F.col("place") <= others).join(mine.select("host", "url", "method"), ["host", "url", "method"], "left_anti")
    asked = asked.withColumn("place", ranked(["host"], F.col("reliability_pct").desc_nulls_first(), F.col("page_id")) + own)
    return mine.select("host", "place", "page_id", "source").unionByName(asked.select("host", "place", "page_id", F.lit("platform").alias("source")))


def classify_runs(runs: DataFrame) -> DataFrame:
    """Success, Partial Success or Failed of runs (run_id, error, generated, validated, report, coverage_pct, fingerprint)."""
    c = F.col
    validated = F.coalesce(c("validated"), F.lit(False)) | F.coalesce(c("report") >= 0.7, F.lit(False))
    failed = F.coalesce(c("error") != "", F.lit(False)) & ~c("generated")
    good = c("generated") & validated & F.coalesce(c("coverage_pct") >= 50, F.lit(True))
    partial = c("generated") | F.coalesce(c("fingerprint") >= 0.5, F.lit(False))
    return runs.withColumn("outcome", F.when(failed, "Failed").when(good, "Success").when(partial, "Partial Success").otherwise("Failed"))


def success_rates(runs: DataFrame, by: str) -> DataFrame:
    """Outcomes by platform or strategy and in all, with means that leave nulls out."""
    count = lambda outcome: F.count(F.when(F.col("outcome") == outcome, 1))
    return classify_runs(runs).rollup(by).agg(
        F.count("*").alias("runs"), count("Success").alias("success"), count("Partial Success").alias("partial"), count("Failed").alias("failed"),
        F.sum("coverage_pct").alias("coverage_sum"), F.count("coverage_pct").alias("coverage_n"),
    )


def run_causes(runs: DataFrame) -> DataFrame:
    """``runs`` that aren't a success with cause and point; runs have last_stage and stages besides."""
    c, err = F.col, F.coalesce(F.col("error"), F.lit(""))
    rows = classify_runs(runs).filter("outcome <> 'Success'")
    has = lambda s: F.array_contains(F.split("stages", ","), s)
    blocked = err.contains("Incapsula") | err.contains("bot") | err.contains("blocked")
    empty = err.contains("no products") | err.contains("Could not confirm")
    nothing = ~c("generated") & has("network")
    unproven = c("generated") & ~F.coalesce(c("validated"), F.lit(False))
    weaker = (c("outcome") == "Partial Success") & (c("mode") == "rediscover")
    kinds = [(blocked, "bot protection", F.lit("fingerprint/static")), (empty, "no product pattern", F.when(has("validate"), "validate").otherwise("static")), (nothing, "no catalog API", F.lit("network")), (unproven, "failed validation", F.lit("validate")), (weaker, "candidate not stronger", F.lit("promote"))]
    pick = lambda values, other: F.coalesce(*[F.when(k, v) for k, v in values], other)
    cause = pick([(k, F.lit(name)) for k, name, _ in kinds], F.when(err != "", err).otherwise("no promotable recipe"))
    point = pick([(k, p) for k, _, p in kinds], F.coalesce("last_stage", F.lit("unknown")))
    return rows.withColumn("cause", cause).withColumn("point", point)


def failure_causes(runs: DataFrame) -> DataFrame:
    """Cause and point of what isn't a success, with the number of runs."""
    return run_causes(runs).groupBy("cause", "point").agg(F.count("*").alias("runs"))


def stage_rollup(runs: DataFrame) -> DataFrame:
    return runs.groupBy("shop_id").agg(F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("stages"), F.max_by("status", F.struct("started_at", "run_id")).alias("current"))


def run_stages(stages: DataFrame) -> DataFrame:
    """By run (run_id, seq, stage, tokens): its stages in order, a bounded list, tokens, the current stage, and the cost in millionths of a dollar."""
    per = stages.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("seq", "stage"))).alias("s"), F.sum("tokens").cast("long").alias("tokens"), F.max(F.struct("seq", "stage"))["stage"].alias("current"))
    micro = F.when(F.col("tokens") > 0, F.floor((F.col("tokens") * 15 + 50) / 100)).otherwise(F.lit(0)).cast("long")
    return per.select("run_id", F.array_join(F.transform("s", lambda x: x["stage"]), ",").alias("stages"), "tokens", "current", micro.alias("micro"))
