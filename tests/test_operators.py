"""Edge rows that the tables don't have."""

from datetime import datetime

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from martlens.operators import catalog, extract, health, ingest, matching, mining, pages, signals, sites, state, tenancy
from martlens.streaming import jobs

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
DAY = datetime(2024, 1, 30)


def prices(spark, rows):
    return spark.createDataFrame(rows, "listing_id long, amount long, currency string, ts timestamp_ntz, o long, n int")


def test_price_change_edges(spark):
    listings = spark.createDataFrame([(i, 1, i) for i in range(6)], "listing_id long, shop_id long, product_id long")
    obs = prices(spark, [
        (0, 100, "CAD", DAY, 1, 1),  # one observation
        (1, 100, "CAD", DAY, 1, 1), (1, 85, "CAD", DAY, 2, 1),  # a tie in time
        (2, 100, "CAD", DAY, 1, 1), (2, 100, "CAD", DAY, 2, 1),  # equal prices
        (3, 0, "CAD", DAY, 1, 1), (3, 5, "CAD", DAY, 2, 1),  # a previous price of 0
        (4, 9, "CAD", datetime(2024, 1, 24), 1, 1), (4, 5, "CAD", DAY, 2, 1),  # the earlier one on the bound, so outside
    ])
    got = {r.listing_id: r for r in signals.price_changes(obs, listings, AS_OF, 7).collect()}
    assert set(got) == {1, 3}
    assert (got[1].signal_type, got[1].severity, got[1].pct) == ("price_drop", "critical", -0.15)
    assert (got[3].severity, got[3].pct) == ("critical", None)


def test_fanout_arrays_and_severity(spark):
    sig = spark.createDataFrame([("a", 7, "price_drop", "notable", DAY)], "signal_id string, shop_id long, signal_type string, severity string, ts timestamp_ntz")
    rules = spark.createDataFrame([(1, 1, "", "", "notable", True), (2, 2, "new_product", "", "info", True), (3, 3, "price_drop", "8,77", "info", True), (4, 4, "", "", "info", False), (5, 5, "", "", "critical", True), (6, 6, "", "8,7", "info", True)],
                                  "org_id long, rule_id long, signal_types string, only_shops string, min_severity string, enabled boolean")
    competitors = spark.createDataFrame([(i, 7) for i in range(1, 7)], "org_id long, shop_id long")
    assert sorted(r.rule_id for r in signals.alert_fanout(sig, rules, competitors).collect()) == [1, 6]


def test_recent_signals_of_no_shop(spark):
    sig = spark.createDataFrame([("a", 7, "price_drop", "notable", DAY)], "signal_id string, shop_id long, signal_type string, severity string, ts timestamp_ntz")
    assert signals.recent_signals(sig, []).count() == 0


def test_own_rank_below_top_is_no_gap(spark):
    serp = spark.createDataFrame([("k", 1, 90, DAY, 1), ("k", 2, 3, DAY, 2), ("j", 2, 3, DAY, 3)], "keyword_id string, shop_id long, rank int, ts timestamp_ntz, o long")
    assert [r.keyword_id for r in catalog.keyword_gaps(serp, own=1).collect()] == ["j"]


def test_malformed_json_gives_no_product(spark):
    html = spark.createDataFrame([(1, '<script type="application/ld+json">{"@type": </script>'), (2, ""), (3, '<script type="application/ld+json">{"@type":"Product","name":""}</script>')], "page_id long, html string")
    assert pages.extract_jsonld_products(html).count() == 0


def test_validation_names_what_is_wrong(spark):
    rows = spark.createDataFrame([("", "x", -1.0), ("a", "https://a.b/c", None)], "title string, url string, price double")
    assert [r.wrong for r in ingest.validate_products(rows).collect()] == ["title,url,price", ""]


def test_stream_daily_min_equals_batch(spark, tmp_path):
    rows = prices(spark, [(1, 5, "CAD", datetime(2024, 1, d, h), d, h) for d in (1, 2, 3) for h in (1, 2)] + [(1, 1, "CAD", datetime(2024, 3, 1), 9, 9)]).withColumn("ts", __import__("pyspark.sql.functions", fromlist=["x"]).col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_daily_min(jobs.source(spark, str(tmp_path / "in"), rows))
    got = jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.day, r.min_price) for r in got.collect()) == [("2024-01-01", 5), ("2024-01-02", 5), ("2024-01-03", 5)]


def test_stream_dedupe_keeps_one(spark, tmp_path):
    F = __import__("pyspark.sql.functions", fromlist=["x"])
    rows = prices(spark, [(1, 5, "CAD", DAY, 1, 1), (1, 5, "CAD", DAY, 2, 1), (2, 5, "CAD", DAY, 3, 1)]).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    got = jobs.run_available(jobs.stream_dedupe(jobs.source(spark, str(tmp_path / "in"), rows), ["listing_id"], "1 day"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert got.count() == 2


def test_entities_by_shared_keys(spark):
    rows = [(1, "a", None), (2, "a", "x"), (3, "b", "x"), (4, "b", None), (5, None, "y"), (6, None, "y"), (7, None, None), (8, None, None), (9, "x", None), (10, "", " "), (11, "", " ")]
    products = spark.createDataFrame(rows, "product_id long, gtin string, mpn string")
    got = {r.product_id: r.representative for r in matching.resolve_batch_entities(products).collect()}
    # A chain over both keys, one shared mpn, no keys, a gtin that equals an mpn, blank keys.
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9, 10: 10, 11: 11}


def test_jsonld_shapes(spark):
    block = '<script type="application/ld+json">{}</script>'
    bodies = [
        '{"@type":["Thing","Product"],"name":"a","brand":"B","productID":"7","gtin12":"12","image":["i"],"material":"oak","offers":{"price":"9.5","priceCurrency":"USD"}}',
        '[{"@type":"WebSite"},{"@graph":[{"@type":"Product","name":"b","gtin":"5","gtin13":"13","offers":[{"price":"NaN","availability":"SoldOut"}]}]}]',
        '{"@type":"Product","name":3,"offers":{"price":1}}',
        '{"@type":"Product","name":"d","offers":[{"price":"soon"}]}',
    ]
    html = spark.createDataFrame([(k, block.format("{x") + block.format(b)) for k, b in enumerate(bodies)], "page_id long, html string")
    got = {r.page_id: r for r in pages.jsonld_products(html).collect()}
    assert set(got) == {0, 1, 3}
    assert got[0][1:] == ("a", "B", "7", "12", 9.5, "USD", "unknown", "i", None, "oak", None, None)
    assert (got[1].title, got[1].gtin, got[1].price, got[1].currency, got[1].availability) == ("b", "13", None, "CAD", "out_of_stock")
    assert got[3].price is None


def test_sitemaps_and_stages_stay_bounded(spark):
    rows = spark.range(25).selectExpr("id AS page_id", "concat('https://a.example/', id, '?x=1&y=2') AS url")
    bodies = pages.sitemap_bodies(rows, 10)
    assert sorted(r.body.count("<loc>") for r in bodies.collect()) == [5, 10, 10]
    assert pages.sitemap_urls(bodies).distinct().count() == 25
    runs = spark.createDataFrame([(1, 7, DAY, "failed", 3), (2, 7, DAY, "running", 4)], "run_id long, shop_id long, started_at timestamp_ntz, status string, tokens long")
    rolled = health.stage_rollup(runs)
    assert [tuple(r) for r in rolled.collect()] == [(7, 7, 2, "running")]
    assert "collect_list" not in rolled._jdf.queryExecution().toString()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rules_by_hand(spark):
    """Rows worked out by hand, so that an operator and its SQL can't share an error."""
    assert tenancy.PLAN_LIMITS == {"trial": 1, "starter": 3, "growth": 10, "scale": 50}
    slugs = {"Café Noir": "cafe-noir", "  Ñandú -- 2 ": "nandu-2", "": ""}
    assert all(one(spark, ingest.slug(F.lit(a))) == b for a, b in slugs.items())
    states = {"instock (was outofstock)": "in_stock", "https://schema.org/SoldOut": "out_of_stock", "out_of_stock": "out_of_stock", "In Stock": "unknown", "PreOrder": "preorder"}
    assert all(one(spark, ingest.map_availability(F.lit(a))) == b for a, b in states.items())
    shapes = {"https://a.example/api/products/12345": "https?://[^/]+/api/products/\\d+", "https://a.example/v1.2/a1b2c3d4?x=1": "https?://[^/]+/v1\\.2/[^/]+", "https://a.example": "https?://[^/]+/"}
    assert all(one(spark, health.url_shape(F.lit(a))) == b for a, b in shapes.items())
    # The hash of the letter a is 97; a long key's wraps, to a negative number too, whose absolute value counts.
    assert one(spark, health.jitter(F.lit("a"))) == 97
    h = 0
    for ch in "a-long-key-of-a-shop-example-com":
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    assert one(spark, health.jitter(F.lit("a-long-key-of-a-shop-example-com"))) == abs(h - (1 << 32) if h >> 31 else h) % 3600
    masked = sites.masked_headers(F.create_map(F.lit("X-Auth-Token"), F.lit("secret")))
    assert one(spark, masked) == {"X-Auth-Token": "[REDACTED]"}
    assert one(spark, pages.with_parameter(F.lit("https://a/b?aff=1&c=2#d"), "aff", F.lit("t"))) == "https://a/b?aff=t&c=2#d"
    assert one(spark, mining.score_json(F.lit('{"a":[{"title":"x","price":1,"url":"u"},{"title":"y"}]}'))) == 0.8
    assert one(spark, mining.score_json(F.lit("{bad"))) == 0.0


def test_patterns_need_three_hosts(spark):
    row = lambda k, host, rel, fails: (k, f"https://{host}/api/items/{k}", host, "p", "GET", "catalog", rel, fails)
    schema = "page_id long, url string, host string, platform string, method string, endpoint_type string, reliability_pct int, failures int"
    rows = [row(1, "a", 90, 0), row(2, "b", None, 0), row(3, "c", 95, 1)]
    assert health.endpoint_patterns(spark.createDataFrame(rows[:2], schema)).count() == 0
    found = health.endpoint_patterns(spark.createDataFrame(rows, schema)).collect()
    assert [(r.hosts, r.total, r.n) for r in found] == [(3, 90 + 85 + 90, 3)]
    assert health.endpoint_patterns(spark.createDataFrame([row(k, h, 60, 0) for k, h in enumerate("abc")], schema)).count() == 0


def test_health_by_hand(spark):
    runs = spark.createDataFrame([(1, 7, DAY, "completed", "sitemap", 500), (2, 8, DAY, "failed", "api", 0), (3, 9, DAY, "completed", "api", 100)], "run_id long, shop_id long, started_at timestamp_ntz, status string, mode string, estimated_size long")
    counts = spark.createDataFrame([(1, 40, 40, 38, 0, 36), (2, 10, 5, 5, 5, 5), (3, 20, 0, 20, 1, 20)], "run_id long, discovered long, fetched long, extracted long, errors long, priced long")
    scored = health.health_score(health.health_inputs(runs, counts))
    got = {r.run_id: r for r in health.health_anomalies(scored).collect()}
    assert abs(got[1].score - (0.3 * 38 / 500 + 0.3 + 0.2 * 38 / 40 + 0.2 * 36 / 38)) < 1e-12 and got[1].anomalies == "catalog_drop:critical"
    assert (got[2].score, got[2].anomalies) == (0.0, "endpoint_5xx:critical")
    assert got[3].anomalies == "catalog_drop:critical,pagination_break:warning"
    plan = {r.run_id: r.plan for r in health.repair_plan(health.health_anomalies(scored)).collect()}
    assert plan == {1: "", 2: "header_refresh,endpoint_swap", 3: "pagination_fix"}


def test_promotion_by_hand(spark):
    schema = "current double, candidate double, report double, current_size long, candidate_size long, has_recipe boolean"
    rows = [(0.8, 0.5, None, 100, 50, True), (0.5, 0.72, None, 0, 0, False), (0.8, 0.86, None, 0, 0, True), (0.8, 0.8, 0.9, 10, 20, True), (0.8, 0.8, 0.9, 30, 20, True), (0.1, 0.3, None, 0, 0, False)]
    assert [r.promote for r in health.promotion_guard(spark.createDataFrame(rows, schema)).collect()] == [False, True, True, True, False, False]


def test_crashes_are_gone(spark):
    vectors = spark.createDataFrame([(0, [0.0, 0.0], 1), (10, [1.0, 0.0], 1), (20, [1.0, 0.1], 1)], "vec_id long, embedding array<float>, label int")
    assert matching.nearest_candidates(vectors).count() > 0
    counts = spark.createDataFrame([(1, 0, 0)], "run_id long, discovered long, priced long")
    assert [(r.unpriced, r.warn) for r in sites.extraction_quality(counts).collect()] == [(None, False)]
    schema = "url string, sku string, shop_id long, first_seen timestamp_ntz, product_id long, last_seen timestamp_ntz"
    batch = spark.createDataFrame([("u", "s", 1, DAY, 1, DAY), ("u", "s", 1, DAY, 2, datetime(2024, 2, 1))], schema)
    got = ingest.upsert_listings(spark.createDataFrame([], schema), batch).collect()
    assert [(r.url, r.product_id) for r in got] == [("u", 2)]
    html = spark.createDataFrame([(1, '<script type="application/ld+json">{"@type":"Product","name":"a","offers":{"price":"N/A"}}</script>')], "page_id long, html string")
    assert [r.price for r in pages.jsonld_products(html).collect()] == [None]


def test_nearest_candidates_in_blocks(spark):
    """Blocks of three rows give what all pairs give, for labels, no label, repeats, ties and vectors that can't be compared."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)], None if i % 7 == 0 else i % 3) for i in range(40)]
    rows += [(40, rows[1][1], 1), (41, rows[1][1], 1), (1, rows[1][1], 1), (42, [0.0] * 4, 1), (43, None, 1), (44, [1.0, 2.0], 1), (45, [1.0, None, 0.0, 0.0], 1), (None, [1.0] * 4, 1), (46, [], None), (47, [float("nan")] * 4, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    usable = [(i, np.array(v), b) for i, v, b in rows if i is not None and v and None not in v and np.dot(v, v) > 0]
    far = lambda v, w: round(1 - float(v @ w) / float(np.sqrt(v @ v) * np.sqrt(w @ w)), 6)
    want = []
    for q in {i for i, _, _ in usable}:
        near = [(far(v, w), j) for i, v, a in usable if i == q for j, w, b in usable if j != q and a in (None, b) and len(v) == len(w)]
        want += [(q, j, d, n) for n, (d, j) in enumerate(sorted(near)[:4], 1)]
    got = matching.nearest_candidates(vectors, k=4, queries=F.lit(True), block=3).collect()
    assert sorted((r.query, r.vec_id, r.distance + 0.0, r.place) for r in got) == sorted(want)
    assert {r["query"] for r in matching.nearest_candidates(vectors, k=4, block=3).collect()} == {0, 10, 20, 30, 40} & {q for q, *_ in want}
    assert not matching.nearest_candidates(vectors.limit(0)).collect()


def test_hard_keys_and_snapshots_by_hand(spark):
    rows = spark.createDataFrame([(1, "g1", "m1"), (2, "g2", "m1"), (3, "g9", "m1"), (4, None, None), (5, "g3", None)], "row_id long, gtin string, mpn string")
    products = spark.createDataFrame([(10, "g1", None), (9, "g1", None), (11, None, "m1")], "product_id long, gtin string, mpn string")
    matched = spark.createDataFrame([("g2", 22), ("g2", 21), ("g1", 1), (None, 1), ("g3", None)], "gtin string, product_id long")
    got = {r.row_id: (r.product_id, r.matched_by) for r in matching.hard_key_match(rows, products, matched).collect()}
    assert got == {1: (9, "gtin"), 2: (21, "listing_gtin"), 3: (11, "mpn"), 4: (None, None), 5: (None, None)}
    fetched = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "a", ""), (5, "a", None), (6, "a", None), (None, "a", "y")], "page_id long, site string, html string")
    assert {(r.page_id, r["first"]) for r in pages.record_snapshots(fetched).collect()} == {(1, True), (2, False), (3, True), (4, True), (5, False), (6, False), (None, False)}
    urls = fetched.select("site", F.col("html").alias("sitemap"), F.col("page_id").alias("url_id"))
    assert sites.sample_corpus(urls)._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") > 1


def test_brand_ids_by_hand(spark):
    rows = spark.createDataFrame([(1, "Café Noir"), (2, " CAFE noir "), (3, " "), (4, None), (5, "Other"), (6, "OTHER!")], "row_id long, brand string")
    got = {r.row_id: r.brand_id for r in ingest.brand_ids(rows, spark.createDataFrame([("cafe-noir", "b2"), ("cafe-noir", "b1")], "alias string, brand_id string")).collect()}
    assert (got[1], got[2], got[3], got[4]) == ("b1", "b1", None, None) and got[5] == got[6] != "b1"
    assert ingest.brand_ids(rows.limit(0), spark.createDataFrame([], "alias string, brand_id string")).count() == 0


def test_listing_cards_by_hand(spark):
    context = ("/pdp/", "https://shop.example", "shop.example")
    body = "[Skip](#x)\n\n[Runner Two ![a](https://c.example/a.jpg) $143.98 price was $180.00 Save 20% ($36.02)](https://shop.example/pdp/runner-two-1.html)\n\n\n\n[Jacket](/pdp/jacket-2)\n$129.99"
    rows = spark.createDataFrame([(1, body, *context)], "page_id long, markdown string, pattern string, origin string, domain string")
    got = {r.title: (r.price, r.list_price) for r in extract.extract_listing_markdown(rows).collect()}
    assert got == {"Runner Two": (143.98, 180.0), "Jacket": (129.99, None)}
    empty = spark.createDataFrame([(1, None, *context), (2, "", *context)], "page_id long, html string, pattern string, origin string, domain string")
    assert extract.extract_listing_html(empty).count() == 0


def test_decisions_by_hand(spark):
    schema = "listing_id long, hard long, candidate long, distance double, conflict boolean, same boolean, verdict double"
    rows = [(1, 5, 6, 0.1, False, None, None), (2, None, None, None, False, None, None), (3, None, 6, 0.2, True, True, 0.9), (4, None, 6, 0.28, False, True, 0.85), (5, None, 6, 0.2, False, True, 0.8), (6, None, 6, 0.2, False, None, None), (7, None, 6, 0.3, False, True, 1.0)]
    got = {r.listing_id: (r.decision, r.product_id) for r in state.decide_matches(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("confirmed", 5), 2: ("new", None), 3: ("new", None), 4: ("auto_matched", 6), 5: ("review", 6), 6: ("review", 6), 7: ("new", None)}


def test_waiting_shops_fill_the_plan(spark):
    orgs = spark.createDataFrame([(1, "starter"), (2, "trial")], "org_id long, plan string")
    tracked = spark.createDataFrame([(1, 10), (1, 11)], "org_id long, shop_id long")
    rows = [(1, 1, 11), (2, 1, 12), (3, 1, 12), (4, 1, 13), (5, 2, 10), (6, 2, 10), (7, 9, 10)]
    settled = tenancy.settle_onboarding(orgs, tracked, spark.createDataFrame(rows, "waiting_id long, org_id long, shop_id long"))
    got = {r.waiting_id: (r.status, r.error) for r in settled.collect()}
    # A tracked shop adds nothing; the third place goes to 12, so its repeat and 13 fail; an unknown org has the trial's one place.
    full = "plan_limit:starter:3"
    assert (got[1], got[2], got[3], got[4]) == (("ready", None), ("ready", None), ("failed", full), ("failed", full))
    assert (got[5][0], got[6][0], got[7][0]) == ("ready", "failed", "ready")
    assert sorted(tuple(r) for r in tenancy.links_added(tracked, settled).collect()) == [(1, 10), (1, 11), (1, 12), (2, 10), (9, 10)]
    assert tenancy.settle_onboarding(orgs, tracked, spark.createDataFrame([], "waiting_id long, org_id long, shop_id long")).count() == 0


def test_versions_by_hand(spark):
    history = spark.createDataFrame([(1, 3)], "shop_id long, version int")
    rows = [(1, 7, "", ["s"], ["p"], 0.4), (2, 8, None, [], ["p"], 0.6), (2, 9, "a", None, None, 0.7), (3, 9, None, None, None, None)]
    written = health.write_versions(history, spark.createDataFrame(rows, "shop_id long, recipe_id long, api_url string, sitemap_urls array<string>, sample_urls array<string>, confidence double"))
    assert sorted(tuple(r) for r in written.collect())[:3] == [(1, 4, 7, "s", 0.4, False), (2, 1, 8, "p", 0.6, True), (2, 2, 9, "a", 0.7, False)]
    shops = spark.createDataFrame([(k, 0.2, 0.1) for k in (1, 2, 3, 4)], "shop_id long, health double, confidence double")
    assert sorted(tuple(r) for r in health.shops_after_versions(shops, written).collect()) == [(1, 0.2, 0.4), (2, 1.0, 0.7), (3, 1.0, None), (4, 0.2, 0.1)]


def test_counters_and_digest_by_hand(spark):
    log = spark.createDataFrame([(1, 200, 200, True), (1, 200, 199, True), (1, 404, 900, None), (1, 429, 0, None), (1, None, None, None), (1, 399, 900, None)], "run_id long, http_status int, body_chars long, extracted boolean")
    assert [tuple(r) for r in ingest.fetch_log_counters(log).collect()] == [(1, 6, 2, 1, 3)]
    kinds = ["price_drop", "new_product", "low_stock", "out_of_stock", "back_in_stock", "price_increase"]
    sig = spark.createDataFrame([(f"s{k}", 7, kind, DAY) for k, kind in enumerate(kinds)], "signal_id string, shop_id long, signal_type string, ts timestamp_ntz")
    orgs = spark.createDataFrame([(1, "growth"), (2, "trial")], "org_id long, plan string")
    tracks = spark.createDataFrame([(1, 7), (2, 7)], "org_id long, shop_id long")
    [row] = signals.digest(sig, tracks, orgs).collect()
    assert (row.drops, row.added, row.inventory, row.empty, row.subject) == (1, 1, 2, False, "Weekly digest: 1 price drops, 1 new products (7d)")
    assert [r.empty for r in signals.digest(sig, tracks, orgs, since=AS_OF).collect()] == [True]
    assert {r.signal_type: r.n for r in signals.signal_summary(sig).collect()} == dict.fromkeys(kinds, 1)


def test_numbered_equals_a_window(spark):
    """Blocks of a few rows; most rows have one key, some a null one, and there are ties and nothing at all."""
    from martlens.functions.latest import numbered, ranked

    rows = spark.createDataFrame([("hot" if k % 5 else (None if k % 2 else f"s{k % 3}"), (k * 37) % 400, k) for k in range(500)], "site string, score int, id int")
    order = [F.col("score").desc(), F.col("id")]
    want = rows.withColumn("i", ranked(["site"], *order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("site")))
    for per_block in (7, 100, 100_000):
        got = numbered(rows, ["site"], order, "i", "n", per_block)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert numbered(rows.limit(0), ["site"], order, "i", "n").count() == 0
    tied = numbered(rows.select("site"), ["site"], [F.lit(1)], "i", "n", 50).filter("site = 'hot'")
    assert sorted(r.i for r in tied.collect()) == list(range(400))
