"""Registered queries of the branches that need full inputs: costs by model, anomalies with their values, endpoints by mode, advice, embeddings, the feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlens.operators import details, health, markdown, pages
from martlens.plans import registry
from martlens.plans.registry import query
from martlens.sources.tables import AS_OF

_USED = "SELECT run_id, started_at, status, CASE run_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'large' WHEN 2 THEN 'other' END AS model, CASE WHEN run_id % 5 <> 0 THEN tokens // 3 END AS prompt, CASE WHEN run_id % 7 <> 0 THEN tokens // 5 END AS completion, CASE WHEN run_id % 3 = 0 THEN tokens - 100000 END AS total FROM {crawl_runs}"
_COST = f"""SELECT run_id, started_at, status, model, tokens, CASE WHEN tokens > 0 THEN (tokens * CASE model WHEN 'small' THEN 200000 WHEN 'large' THEN 2500000 ELSE 150000 END + 500000) // 1000000 ELSE 0 END AS micro
  FROM (SELECT *, coalesce(total, coalesce(prompt, 0) + coalesce(completion, 0)) AS tokens FROM ({_USED}) u) v"""


def _costs(runs):
    r, tokens = F.col("run_id"), F.col("tokens")
    model = F.when(r % 4 == 0, "small").when(r % 4 == 1, "large").when(r % 4 == 2, "other")
    part = lambda n: F.expr(f"tokens div {n}")
    usage = runs.select("run_id", "started_at", "status", model.alias("model"), F.when(r % 5 != 0, part(3)).alias("prompt"), F.when(r % 7 != 0, part(5)).alias("completion"), F.when(r % 3 == 0, tokens - 100000).alias("total"))
    rates = runs.sparkSession.createDataFrame([("small", 0.2), ("large", 2.5)], "model string, rate double")
    return details.usage_cost(usage, rates)


@query("crawl_runs", f"SELECT run_id, model, tokens, micro / 1000000::DOUBLE AS cost FROM ({_COST}) c")
def ops06_usage_cost(runs):
    return _costs(runs).select("run_id", "model", "tokens", "cost")


@query("crawl_runs", f"SELECT runs, micro / 1000000::DOUBLE AS cost, tokens, over_budget, CASE WHEN runs > 0 THEN ((micro + 50 * runs) // (100 * runs)) / 10000::DOUBLE ELSE 0.0 END::DOUBLE AS average FROM (SELECT count(*) AS runs, coalesce(sum(micro), 0)::BIGINT AS micro, coalesce(sum(tokens), 0)::BIGINT AS tokens, count(*) FILTER (micro > 50000) AS over_budget FROM ({_COST}) c WHERE status = 'completed' AND started_at > {AS_OF} - INTERVAL 2000 DAYS) x")
def ops04_cost_summary(runs):
    return details.cost_summary(_costs(runs), AS_OF, 2000, 0.05)


_ANOMALIES = """SELECT run_id, unnest(CASE WHEN status = 'failed' OR status = 'completed' AND catalog = 0 THEN [{'type': CASE WHEN catalog = 0 THEN 'catalog_drop' ELSE 'endpoint_5xx' END, 'severity': 'critical', 'observed': catalog::DOUBLE, 'limit': baseline::DOUBLE}]
  WHEN len(a) = 0 AND score < 0.4::DOUBLE THEN [{'type': 'catalog_drop', 'severity': 'critical', 'observed': score::DOUBLE, 'limit': 0.4::DOUBLE}] ELSE a END) AS x FROM (SELECT *, list_filter([
  CASE WHEN baseline > 0 AND catalog < baseline * 0.7::DOUBLE THEN {'type': 'catalog_drop', 'severity': CASE WHEN catalog < baseline * 0.5::DOUBLE THEN 'critical' ELSE 'warning' END, 'observed': catalog::DOUBLE, 'limit': baseline::DOUBLE} END,
  CASE WHEN endpoint < 0.5::DOUBLE THEN {'type': CASE WHEN errors > 0 THEN 'endpoint_4xx' ELSE 'endpoint_5xx' END, 'severity': CASE WHEN endpoint < 0.3::DOUBLE THEN 'critical' ELSE 'warning' END, 'observed': endpoint::DOUBLE, 'limit': 0.5::DOUBLE} END,
  CASE WHEN extraction < 0.5::DOUBLE AND fetched > 0 THEN {'type': 'extraction_rate_drop', 'severity': 'warning', 'observed': extraction::DOUBLE, 'limit': 0.5::DOUBLE} END, CASE WHEN price < 0.7::DOUBLE AND extracted > 0 THEN {'type': 'field_missing', 'severity': 'warning', 'observed': price::DOUBLE, 'limit': 0.7::DOUBLE} END,
  CASE WHEN coverage < 0.7::DOUBLE AND mode = 'api' THEN {'type': 'pagination_break', 'severity': 'warning', 'observed': coverage::DOUBLE, 'limit': 0.7::DOUBLE} END], lambda y: y IS NOT NULL) AS a FROM (@SCORE) s) t""".replace("@SCORE", registry._SCORE)


@query("crawl_runs run_counts", f"SELECT run_id, x.type AS type, x.severity AS severity, x.observed AS observed, x.limit AS \"limit\" FROM ({_ANOMALIES}) z")
def hlt03_anomaly_details(runs, counts):
    found = details.anomaly_details(health.health_score(health.health_inputs(runs, counts)))
    return found.select("run_id", F.explode("anomalies").alias("x")).select("run_id", "x.*")


_E = "SELECT product_id % @N AS shop_id, CASE (product_id % @N) % 4 WHEN 0 THEN 'unknown' ELSE concat('p', (product_id % @N) % 3) END AS platform, concat('/e/', product_id % 37) AS url, CASE WHEN product_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, CASE WHEN product_id % 9 <> 0 THEN (product_id * 7) % 101 END AS reliability, product_id % 5 <> 0 AS active FROM {products}".replace("@N", "40")
_ASKED = "SELECT shop_id, CASE shop_id % 4 WHEN 0 THEN 'unknown' ELSE concat('p', shop_id % 3) END AS platform, shop_id % 6 = 1 AS prefer_own FROM (SELECT DISTINCT product_id % 44 AS shop_id FROM {products}) s"


@query("products", f"""WITH e AS (SELECT DISTINCT * FROM ({_E}) x WHERE active), a AS ({_ASKED}), m AS (SELECT * FROM (SELECT a.shop_id, a.prefer_own, url, method, row_number() OVER (PARTITION BY a.shop_id ORDER BY reliability DESC NULLS FIRST, url, method)::INT AS place FROM a JOIN e USING (shop_id)) x WHERE place <= CASE WHEN prefer_own THEN 8 ELSE 4 END),
  o AS (SELECT * FROM (SELECT a.shop_id, e.url, e.method, row_number() OVER (PARTITION BY a.shop_id ORDER BY reliability DESC NULLS FIRST, url, method, e.shop_id) AS r FROM a JOIN e ON e.platform = a.platform AND e.shop_id <> a.shop_id WHERE a.platform <> 'unknown' AND NOT EXISTS (SELECT 1 FROM m WHERE m.shop_id = a.shop_id AND m.prefer_own)) y WHERE r <= 6)
  SELECT shop_id, place, url, method, 'own' AS source FROM m UNION ALL SELECT shop_id, (row_number() OVER (PARTITION BY shop_id ORDER BY r) + (SELECT count(*) FROM m WHERE m.shop_id = o.shop_id))::INT, url, method, 'platform' FROM o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.shop_id = o.shop_id AND m.url = o.url AND m.method = o.method)""")
def end04_endpoints_to_try(products):
    """Forty shops' endpoints, of three platforms and an unknown one; some prefer their own, four have none."""
    spark = products.sparkSession
    return details.endpoints_to_try(spark.sql(_E, products=products).distinct(), spark.sql(_ASKED, products=products))


@query("crawl_runs run_counts", registry.ORACLE_SQL["ben02_failure_causes"].replace("SELECT cause, point, count(*) AS runs FROM (SELECT CASE", "SELECT cause, point, count(*) AS runs, count(DISTINCT site) AS n_sites, CASE cause WHEN 'bot protection' THEN 'seed captures by hand' WHEN 'no product pattern' THEN 'look for categories or sitemaps' WHEN 'no catalog API' THEN 'extend endpoint patterns' WHEN 'failed validation' THEN 'revise thresholds or field maps' ELSE 'read the log, capture the network again' END AS advice, array_to_string(list_sort(list(DISTINCT site))[1:20], ',') AS sites FROM (SELECT concat('s', run_id % 90) AS site, CASE"))
def ben02_failure_advice(runs, counts):
    rows = registry._bench_runs(runs, counts).withColumn("site", F.concat(F.lit("s"), (F.col("run_id") % 90).cast("string")))
    return details.failure_advice(rows).withColumn("sites", F.array_join("sites", ","))


_TEXT = "SELECT listing_id, CASE WHEN listing_id % 5 <> 0 THEN brand END AS brand, CASE WHEN listing_id % 3 = 0 THEN '' WHEN listing_id % 3 = 1 THEN category ELSE concat('all/', category) END AS category, canonical_title AS title, listing_id % 12 AS k FROM {listings} JOIN {products} USING (product_id)"


@query("listings products", f"""SELECT listing_id, concat_ws(' | ', brand, nullif(array_to_string(list_filter(string_split(category, '/'), lambda c: c <> '')[-2:], ' > '), ''), title, nullif(array_to_string(list_transform(range(least(k, 8)), lambda i: concat('a', i, ': ', i * k)), ', '), '')) AS text FROM ({_TEXT}) t""")
def ing07_listing_text(listings, products):
    """With up to eleven attributes, of which eight are used, and categories of one to three parts."""
    rows = listings.sparkSession.sql(_TEXT, listings=listings, products=products)
    i = F.expr("sequence(0, cast(k AS INT) - 1)")
    attributes = F.when(F.col("k") > 0, F.transform(i, lambda x: F.struct(F.concat(F.lit("a"), x.cast("string")).alias("key"), (x * F.col("k")).cast("string").alias("value"))))
    return details.embedding_text(rows.select("listing_id", "brand", F.split("category", "/").alias("category"), "title", attributes.alias("attributes")))


@query("embeddings", """SELECT vec_id, CASE WHEN vec_id % 3 <> 1 THEN label + 100 ELSE label END AS label, len(embedding)::INT AS dims, round((CASE WHEN vec_id % 3 <> 1 THEN -1 ELSE 1 END) * list_sum(embedding::DOUBLE[]), 6) AS total FROM {embeddings} WHERE vec_id % 3 <> 0 OR vec_id % 2 = 0""")
def ing06_replaced_embeddings(embeddings):
    """A third of the rows is only known, a third replaced by the last of two versions, of a third every second is new; label and vector are replaced."""
    n = F.col("vec_id")
    batch = embeddings.filter((n % 3 == 2) | ((n % 3 == 0) & (n % 2 == 0)))
    versions = batch.select("vec_id", F.lit(-7).alias("label"), "embedding", F.lit(1).alias("made_at")).unionByName(batch.select("vec_id", (F.col("label") + 100).alias("label"), F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(2).alias("made_at")))
    out = details.upsert_embeddings(embeddings.filter(n % 3 != 0).select("vec_id", "label", "embedding"), versions)
    return out.select("vec_id", "label", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query("products listings", "SELECT 'https://m.example' AS loc, NULL::VARCHAR AS lastmod, 'daily' AS changefreq, 1.0::DOUBLE AS priority UNION ALL SELECT * FROM (SELECT concat('https://m.example/product/', product_id), strftime(max(last_seen), '%Y-%m-%d'), 'daily', 0.7::DOUBLE FROM {listings} GROUP BY product_id ORDER BY max(last_seen) DESC, product_id LIMIT 5000) p")
def snk03_sitemap_rows(products, listings):
    return details.sitemap_rows(listings.groupBy("product_id").agg(F.max("last_seen").alias("updated_at")), "https://m.example")


@query("part", """SELECT p_partkey AS page_id, p_name AS title, p_partkey::VARCHAR AS sku, p_retailprice::DOUBLE AS price FROM {part}""")
def ext01_deep_jsonld(part):
    """Products in arrays and graphs of up to nine levels."""
    n = F.col("p_partkey")
    node = F.concat(F.lit('{"@type":"Product","name":"'), F.col("p_name"), F.lit('","sku":"'), n.cast("string"), F.lit('","offers":{"price":"'), F.col("p_retailprice").cast("string"), F.lit('"}}'))
    deep = F.concat(F.expr("repeat('[{\"@type\":\"Thing\"},', cast(p_partkey % 10 AS INT))"), F.when(n % 3 == 0, F.concat(F.lit('{"@type":"WebPage","@graph":[{"@graph":['), node, F.lit("]}]}"))).otherwise(node), F.expr("repeat(']', cast(p_partkey % 10 AS INT))"))
    html = F.concat(F.lit('<script type="application/ld+json">'), deep, F.lit("</script>"))
    return pages.jsonld_products(part.select(n.alias("page_id"), html.alias("html"))).select("page_id", "title", "sku", "price")


_LIST = "concat('https://www.s', page_id % 50, '.example/l', CASE page_id % 6 WHEN 4 THEN concat('?x=1&page=', page_id) ELSE '' END)"
_MARK = "CASE page_id % 6 WHEN 0 THEN concat('[1](/l?page=1) [Page suivante](l?page=', page_id, ')') WHEN 1 THEN '[a](/x/../n)  → [b](/b)' WHEN 2 THEN '[about](/about) [7](https://www.other.example/7)' WHEN 3 THEN '[about](/about) [12](/l/12)' WHEN 4 THEN '[next](https://www.other.example/)' ELSE '' END"


@query("pages", f"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('https://www.s', page_id % 50, '.example/l?page=', page_id) WHEN 1 THEN concat('https://www.s', page_id % 50, '.example/n') WHEN 3 THEN concat('https://www.s', page_id % 50, '.example/l/12') WHEN 4 THEN concat('https://www.s', page_id % 50, '.example/l?x=1&page=', page_id + 1) END AS next FROM {{pages}}""")
def ext18_next_markdown_pages(p):
    """Planted links before the pages' own html, which holds no markdown link."""
    rows = p.select("page_id", F.expr(_LIST).alias("url"), F.concat(F.lit("s"), (F.col("page_id") % 50).cast("string"), F.lit(".example")).alias("domain"), F.concat(F.expr(_MARK), F.lit("\n\n"), F.coalesce("html", F.lit(""))).alias("markdown"))
    return markdown.next_pages(rows)


_MANIFEST = "concat('Handles: /en/item/ and more', chr(10), '/shop/product/', shop_id, '/', chr(10), '[one](products/12345', shop_id, ') [photo](/products/a/x.png)', chr(10), CASE WHEN shop_id % 2 = 0 THEN concat('https://', domain, '/EN/about, https://', domain, '/en/product/shoe-', shop_id, '.') ELSE concat('https://', domain, '/collections/product/all') END)"
_TOKEN = "/(products|product|pdp|ip|p|item|sku|dp|pd)/"


@query("shops", rf"""SELECT site, array_to_string(list_sort(list_distinct(list_concat(list_concat(list_filter(regexp_extract_all(t, '/[a-z0-9_*-]+(?:/[a-z0-9_*-]+)+/?', 0, 'i'), lambda p: regexp_matches(lower(p), '{_TOKEN}')),
  regexp_extract_all(t, '(?:product|pdp|detail)[^\n]*?(/[\w/{{}}\[\]-]+)', 1, 'i')), ['/products/', CASE WHEN site % 2 = 0 THEN '/en/product/' ELSE '/collections/product/' END]))), ' ') AS product_patterns, CASE WHEN site % 2 = 1 THEN '/collections/product/' ELSE '' END AS listing_patterns
  FROM (SELECT shop_id AS site, {_MANIFEST} AS t FROM {{shops}}) x""")
def src05_manifest_patterns(shops):
    n, origin = F.col("shop_id"), F.concat(F.lit("https://"), "domain")
    text = F.expr(_MANIFEST)
    found = markdown.manifest_patterns(shops.select(n.alias("site"), origin.alias("origin"), text.alias("text")))
    return found.select("site", F.array_join(F.array_sort("product_patterns"), " ").alias("product_patterns"), F.array_join("listing_patterns", " ").alias("listing_patterns"))
