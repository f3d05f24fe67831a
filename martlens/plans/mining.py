"""Registered queries of the site and URL mining operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlens.functions.shared import dealt
from martlens.operators import mining
from martlens.plans.registry import query

_U = "concat('https://s', shop_id, '.example/p?a=1&b=', listing_id)"


@query("listings", f"SELECT shop_id AS site, CASE shop_id % 5 WHEN 0 THEN 'urlset' WHEN 1 THEN 'rss' WHEN 2 THEN 'atom' WHEN 3 THEN 'text' ELSE 'index' END AS kind, {_U} AS url FROM {{listings}}")
def src02_sitemap_shapes(listings):
    kind, url = F.col("shop_id") % 5, F.expr(_U)
    coded = F.replace(url, F.lit("&"), F.lit("&amp;"))
    wrap = lambda a, u, b: F.concat(F.lit(a), u, F.lit(b))
    body = F.when(kind == 0, wrap("<?xml version='1.0'?><urlset><url><loc> ", coded, " </loc><lastmod>x</lastmod></url><url><loc></loc></url></urlset>")).when(kind == 1, wrap("<rss><channel><link>https://x</link><item><title>t</title><link>", coded, "</link></item></channel></rss>"))
    body = body.when(kind == 2, wrap('<feed><link href="https://x"/><entry><link rel="self" href="https://y"/><link rel="alternate" href="', coded, '"/></entry></feed>')).when(kind == 3, wrap("# urls\n ", url, " \r\nnone\n")).otherwise(wrap("<sitemapindex><sitemap><loc>", coded, "</loc></sitemap></sitemapindex>"))
    return mining.sitemap_entries(listings.select(F.col("shop_id").alias("site"), body.alias("body")))


@query("listings", f"SELECT DISTINCT shop_id AS root, {_U} AS url FROM {{listings}} WHERE product_id % 7 <> 6")
def src03_sitemap_index_expand(listings):
    """Maps seven deep: product k of a shop stands in the map of depth k % 7, of which the last is too deep."""
    at = lambda d: F.concat(F.lit("m"), F.col("shop_id").cast("string"), F.lit("-"), d.cast("string"))
    depth = F.col("product_id") % 7
    leaf = listings.select(F.concat(at(depth), F.lit("-"), F.col("listing_id").cast("string")).alias("map"), F.concat(F.lit("<urlset><url><loc>"), F.replace(F.expr(_U), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url></urlset>")).alias("body"))
    loc = lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))
    # An index of each shop and depth names the leaves of its depth and the index below; its rows are those of the shop, in one body a product range.
    ranges = F.floor(F.col("product_id") / 500)
    lists = listings.groupBy("shop_id", depth.alias("d"), ranges.alias("part")).agg(F.collect_list("listing_id").alias("ids"))
    inner = F.array_join(F.transform("ids", lambda i: loc(F.concat(at(F.col("d")), F.lit("-"), i.cast("string")))), "")
    index = lists.select(at(F.col("d")).alias("map"), F.concat(F.lit("<sitemapindex>"), inner, F.lit("</sitemapindex>")).alias("body"))
    shops = listings.select("shop_id").distinct()
    below = shops.select("shop_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("d")).select(at(F.col("d")).alias("map"), F.concat(F.lit("<sitemapindex>"), loc(at(F.col("d") + 1)), F.lit("</sitemapindex>")).alias("body"))
    roots = shops.select(F.col("shop_id").alias("root"), at(F.lit(0)).alias("map"))
    return mining.sitemap_tree(leaf.unionByName(index).unionByName(below), roots, depth=6)


@query("shops", """SELECT shop_id AS site, concat('https://', domain, '/sitemap.xml') AS sitemaps, concat('https://', domain, '/api/items?x=1') AS apis, concat('https://', domain, '/products/a-', shop_id) AS samples, concat('https://', domain, '/collections/all') AS listings,
  CASE WHEN shop_id % 3 = 0 THEN 'next_data' ELSE 'json_ld' END AS extraction, shop_id % 2 = 0 AS browser FROM {shops}""")
def src05_agent_manifest_hints(shops):
    origin, number = F.concat(F.lit("https://"), "domain"), F.col("shop_id").cast("string")
    text = F.concat(
        F.lit("# Shop\nMap: "), origin, F.lit("/sitemap.xml.\n- [one](/products/a-"), number, F.lit(") [all](/collections/all) [photo](/products/x.png)\nAPI "), origin, F.lit("/api/items?x=1, mail\n"),
        F.when(F.col("shop_id") % 3 == 0, "Built with Next.js\n").otherwise(""), F.when(F.col("shop_id") % 2 == 0, "client-rendered").otherwise(""),
    )
    return mining.manifest_hints(shops.select(F.col("shop_id").alias("site"), origin.alias("origin"), text.alias("text")))


@query("shops", "SELECT shop_id, CASE WHEN shop_id % 3 <> 0 THEN name ELSE concat('seed ', shop_id) END AS name FROM {shops}")
def src07_load_seed_shops(shops):
    state = shops.filter("shop_id % 3 <> 0").select("shop_id", "name")
    seeds = shops.select("shop_id", F.concat(F.lit("seed "), F.col("shop_id").cast("string")).alias("name"))
    return mining.load_seeds(state, seeds.unionByName(seeds), "shop_id")


_CATS = """SELECT shop_id AS site, domain, k, CASE k % 6 WHEN 0 THEN concat('/en/cat/a/', k) WHEN 1 THEN concat('https://', domain, '/collections/c', k, '/#top') WHEN 2 THEN concat('https://other.example/cat/', k) WHEN 3 THEN concat('/cat/account/', k) WHEN 4 THEN concat('/about/', k) ELSE concat('/categories/x/y/', k, '/') END AS href FROM {shops}, (SELECT unnest(range(0, 150)) AS k) r"""


@query("shops", f"""WITH c AS ({_CATS}), g AS (SELECT site, k, concat('n ', k) AS name, regexp_replace(regexp_replace(CASE WHEN starts_with(href, '/') THEN concat('https://', domain, href) ELSE href END, '#.*$', ''), '/$', '') AS url FROM c WHERE k % 6 IN (0, 1, 5)),
  p AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY len(string_split(url, '/')) DESC, k)::INT AS place, count(*) OVER (PARTITION BY site) AS n FROM g WHERE k < CASE WHEN site % 3 = 0 THEN 150 WHEN site % 3 = 1 THEN 20 ELSE 7 END)
  SELECT site, name, url, place, CASE site % 2 WHEN 0 THEN '/pdp/' ELSE '/product/' END AS pattern, CASE WHEN n >= 20 THEN 0.85 WHEN n >= 5 THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence FROM p WHERE place <= 60""")
def url11_category_links(shops):
    k = lambda x: x.cast("string")
    href = lambda x: (
        F.when(x % 6 == 0, F.concat(F.lit("/en/cat/a/"), k(x))).when(x % 6 == 1, F.concat(F.lit("https://"), "domain", F.lit("/collections/c"), k(x), F.lit("/#top"))).when(x % 6 == 2, F.concat(F.lit("https://other.example/cat/"), k(x)))
        .when(x % 6 == 3, F.concat(F.lit("/cat/account/"), k(x))).when(x % 6 == 4, F.concat(F.lit("/about/"), k(x))).otherwise(F.concat(F.lit("/categories/x/y/"), k(x), F.lit("/")))
    )
    many = F.when(F.col("shop_id") % 3 == 0, 150).when(F.col("shop_id") % 3 == 1, 20).otherwise(7)
    links = F.transform(F.sequence(F.lit(0), many - 1), lambda x: F.concat(F.lit("* [n  "), k(x), F.lit("]("), href(x), F.lit(")\n")))
    body = F.concat(F.array_join(links, ""), F.lit("[Search](/cat/search) [n](/cat/short)\n[twice](/en/cat/a/0/)"), F.when(F.col("shop_id") % 2 == 0, "(/pdp/x) ").otherwise(""))
    return mining.category_links(dealt(shops, "shop_id").select(F.col("shop_id").alias("site"), "domain", body.alias("markdown")), 60)


@query("shops", """SELECT shop_id AS site, concat('c', k) AS name, CASE k WHEN 0 THEN concat('https://', domain, '/a') WHEN 2 THEN concat('https://m.', domain, '/b') ELSE concat('https://', regexp_replace(domain, '^www\\.', ''), '/c') END AS url FROM {shops}, (SELECT unnest([0, 2, 3]) AS k) r""")
def url12_filter_categories(shops):
    d, bare = F.col("domain"), F.regexp_replace("domain", r"^www\.", "")
    rows = shops.select(F.col("shop_id").alias("site"), d.alias("domain"), F.posexplode(F.array(F.concat(F.lit("https://"), d, F.lit("/a")), F.concat(F.lit("https://"), d, F.lit("/a/")), F.concat(F.lit("https://m."), d, F.lit("/b")), F.concat(F.lit("https://"), bare, F.lit("/c")), F.lit("https://else.example/d"), F.lit("no url"))).alias("pos", "url"))
    return mining.filter_categories(rows.withColumn("name", F.concat(F.lit("c"), F.col("pos").cast("string"))))


@query("pages", """SELECT page_id, 'https://h.example/collections/a' AS url, 'A b' AS label FROM {pages} WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'https://h.example/own/b', 'https://h.example/own/b' FROM {pages} WHERE page_id % 3 = 1 UNION ALL SELECT page_id, 'https://h.example', 'Home' FROM {pages} WHERE page_id % 3 = 2""")
def url13_listing_page_candidates(p):
    n = F.col("page_id") % 3
    html = F.when(n == 0, '<a class="x" href="/collections/a"> A  <i>b</i></a><a href="/about">x</a>').when(n == 1, "<a href='/own/b'></a>").otherwise("<a href='/about'>x</a>")
    return mining.listing_candidates(p.select("page_id", F.lit("https://h.example/").alias("url"), html.alias("html"), F.when(n == 1, "/OWN/").alias("listing_pattern")))


@query("pages", """SELECT page_id AS site, CASE page_id % 9 WHEN 0 THEN 'shopify_hydrogen' WHEN 1 THEN 'shopify' WHEN 2 THEN 'bigcommerce' WHEN 3 THEN 'salesforce' WHEN 4 THEN 'magento' WHEN 5 THEN 'woocommerce' WHEN 6 THEN 'custom_nextjs' WHEN 7 THEN 'shopify' ELSE 'unknown' END AS platform,
  CASE page_id % 9 WHEN 0 THEN 0.45 WHEN 1 THEN 0.35 WHEN 2 THEN 0.65 WHEN 3 THEN 0.35 WHEN 4 THEN 0.2 WHEN 5 THEN 0.55 WHEN 6 THEN 0.15 WHEN 7 THEN 0.45 ELSE 0 END::DOUBLE AS confidence,
  CASE page_id % 9 WHEN 0 THEN 'shopify' WHEN 1 THEN 'shopify' WHEN 2 THEN 'bigcommerce' WHEN 3 THEN 'demandware' WHEN 4 THEN 'magento' WHEN 5 THEN 'woocommerce' WHEN 7 THEN 'shopify' END AS engine, CASE page_id % 9 WHEN 0 THEN 'hydrogen' WHEN 2 THEN 'stencil' WHEN 6 THEN 'nextjs' WHEN 8 THEN 'react' ELSE 'unknown' END AS framework,
  CASE page_id % 9 WHEN 1 THEN 'cloudflare' WHEN 3 THEN 'incapsula' WHEN 5 THEN 'akamai' WHEN 6 THEN 'cloudflare' ELSE 'none' END AS protection FROM {pages}""")
def url16_fingerprint_sites(p):
    marks = ["@Shopify/Hydrogen", "x cdn.shopify.com", "BigCommerce window.BCData", "on/demandware.store _Incapsula_resource", "plain", "wp-content Akamai", "/_next/static/ cf-browser-verification", "MyShopify.com", "uses React"]
    at = (F.col("page_id") % 9).cast("int")
    urls = F.when(at == 4, F.array(F.lit("https://x/REST/V1/products"))).when(at == 5, F.array(F.lit("https://x/wp-json/wc/store/products"))).when(at == 7, F.array(F.lit("https://x/products.json")))
    headers = F.when(at == 1, F.create_map(F.lit("Server"), F.lit("Cloudflare")))
    return mining.fingerprint_sites(p.select(F.col("page_id").alias("site"), F.get(F.array(*map(F.lit, marks)), at).alias("html"), urls.alias("urls"), headers.alias("headers")))


@query("part", "SELECT p_partkey // 24 AS page, CASE WHEN p_partkey // 24 % 4 = 3 THEN 0.0 WHEN count(*) < 2 THEN 0.0 ELSE round(CASE p_partkey // 24 % 4 WHEN 0 THEN 0.6 WHEN 1 THEN 0.8 ELSE 0.0 END + CASE WHEN count(*) >= 5 THEN 0.15 ELSE 0 END + CASE WHEN count(*) >= 10 THEN 0.05 ELSE 0 END, 6) END::DOUBLE AS score FROM {part} GROUP BY 1")
def url19_score_json_bodies(part):
    page, kind = F.floor(F.col("p_partkey") / 24), F.floor(F.col("p_partkey") / 24) % 4
    item = F.when(kind == 0, F.concat(F.lit('{"Title":"x","money":{"value":'), F.col("p_size").cast("string"), F.lit("}}"))).when(kind == 1, F.lit('{"name":"x","price":1,"slug":"s"}')).otherwise(F.lit('{"id":1}'))
    per = part.groupBy(page.alias("page"), kind.alias("kind")).agg(F.array_join(F.collect_list(item), ",").alias("items"))
    body = F.concat(F.lit('{"data":{"list":['), "items", F.when(F.col("kind") == 3, "").otherwise("]}}"))
    return per.select("page", mining.score_json(body).alias("score"))


@query("captures", """SELECT min(event_id) AS event_id, session % 2 AS odd, cookie, k FROM {captures} WHERE k % 10 <> 9 AND NOT (k % 10 = 8) GROUP BY session % 2, cookie, k""")
def url20_usable_captures(captures):
    rows = captures.select(
        F.col("event_id").alias("capture_id"), F.when(F.col("session") % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("https://x.example/api/"), "cookie").alias("url"), F.concat(F.lpad(F.col("k").cast("string"), 128, "0"), F.col("event_id").cast("string")).alias("request_body"),
        F.when(F.col("k") % 10 == 9, 404).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"), F.when(F.col("k") % 10 == 8, "{}").otherwise(F.repeat(F.lit("x"), 80)).alias("body"), F.col("session"), "cookie", "k",
    )
    return mining.usable_captures(rows).select(F.col("capture_id").alias("event_id"), (F.col("session") % 2).alias("odd"), "cookie", "k")


@query("captures", """WITH c AS (SELECT event_id, session, k, concat('https://x.example/api/', cookie, CASE WHEN k % 2 = 0 THEN '?q=1' ELSE '/more' END) AS url FROM {captures}), b AS (SELECT DISTINCT session, concat('https://x.example/api/', CASE session % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'none' ELSE 'purchase' END, '?page=1') AS base_url FROM {captures})
  SELECT session, base_url, event_id AS capture_id, m AS match FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY m DESC, k DESC, event_id) AS rn FROM (SELECT b.session, base_url, event_id, k, split_part(url, '?', 1) = split_part(base_url, '?', 1) OR starts_with(url, split_part(base_url, '?', 1)) OR starts_with(base_url, split_part(url, '?', 1)) AS m FROM b JOIN c USING (session)) x) y WHERE rn = 1""")
def url23_capture_for_recipe(captures):
    url = F.concat(F.lit("https://x.example/api/"), "cookie", F.when(F.col("k") % 2 == 0, "?q=1").otherwise("/more"))
    rows = captures.select("session", F.col("event_id").alias("capture_id"), url.alias("url"), F.col("k").alias("score"))
    base = F.concat(F.lit("https://x.example/api/"), F.when(F.col("session") % 3 == 0, "click").when(F.col("session") % 3 == 1, "none").otherwise("purchase"), F.lit("?page=1"))
    return mining.capture_for_recipe(captures.select("session", base.alias("base_url")).distinct(), rows)


@query("captures", "SELECT event_id, CASE k % 3 WHEN 0 THEN concat('a=', k, ',b=2') WHEN 1 THEN 'a=1,b=2' ELSE 'a=1,b=2,c=3' END AS headers, k % 3 <> 1 AND NOT (k % 3 = 0 AND k = 1) AS changed FROM {captures}")
def url25_merge_headers(captures):
    own = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    new = F.when(F.col("k") % 3 == 0, F.create_map(F.lit("a"), F.col("k").cast("string"), F.lit("Authorization"), F.lit("x"))).when(F.col("k") % 3 == 1, F.create_map(F.lit("a"), F.lit("1"), F.lit("z"), F.lit(""))).otherwise(F.create_map(F.lit("c"), F.lit("3")))
    out = mining.merge_headers(captures.select("event_id", own.alias("own"), new.alias("captured")))
    pairs = F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return out.select("event_id", F.array_join(pairs, ",").alias("headers"), "changed")


@query("listings", """WITH u AS (SELECT DISTINCT shop_id AS site, concat('https://s.example/en/shoe-long-name-', product_id, '.html') AS url FROM {listings} WHERE product_id % 4 = 0), n AS (SELECT *, count(*) OVER (PARTITION BY site) AS n, row_number() OVER (PARTITION BY site ORDER BY url) - 1 AS i FROM u)
  SELECT site, url FROM n WHERE n >= 5 AND (n <= 10 OR list_contains(list_transform(range(10), lambda k: k * n // 10), i))""")
def url08_html_product_evidence(listings):
    number, kind = F.col("product_id").cast("string"), F.col("product_id") % 4
    url = F.when(kind == 0, F.concat(F.lit("https://s.example/en/shoe-long-name-"), number, F.lit(".html"))).when(kind == 1, F.concat(F.lit("https://s.example/sale/shoe-long-name-"), number, F.lit(".html"))).when(kind == 2, F.lit("https://s.example/en/x.html")).otherwise(F.lit("https://s.example/a/b/c/d/long-long-name.html"))
    return mining.html_product_evidence(listings.select(F.col("shop_id").alias("site"), url.alias("url")))


@query("listings", """WITH u AS (SELECT shop_id AS site, lpad(product_id::VARCHAR, 7, '0') AS key, CASE WHEN max(product_id % 2) = 0 THEN concat('https://s.example/cat/p/a-', lpad(product_id::VARCHAR, 7, '0'), '.html') ELSE concat('https://s.example/p/', lpad(product_id::VARCHAR, 7, '0')) END AS url, CASE WHEN max(product_id % 2) = 0 THEN 66 ELSE 7 END + 0 AS score FROM {listings} GROUP BY 1, product_id),
  n AS (SELECT *, count(*) OVER (PARTITION BY site) AS n, row_number() OVER (PARTITION BY site ORDER BY score DESC, url) - 1 AS i FROM u) SELECT site, url, score FROM n WHERE n >= 3 AND (n <= 10 OR list_contains(list_transform(range(10), lambda k: k * n // 10), i))""")
def url07_best_candidates(listings):
    number = F.lpad(F.col("product_id").cast("string"), 7, "0")
    short, nested = F.concat(F.lit("https://s.example/p/"), number), F.concat(F.lit("https://s.example/cat/p/a-"), number, F.lit(".html"))
    urls = F.when(F.col("product_id") % 2 == 0, F.array(short, nested, F.lit("https://s.example/about"))).otherwise(F.array(short))
    return mining.best_candidates(listings.select(F.col("shop_id").alias("site"), F.explode(urls).alias("url"), F.lit("https://s.example/product-map.xml").alias("sitemap")))


@query("listings", "SELECT shop_id AS site, CASE shop_id % 7 WHEN 0 THEN '/shop/item/' WHEN 1 THEN '/cat/' WHEN 2 THEN '/p-/' WHEN 3 THEN '/product/' WHEN 4 THEN '/x/' WHEN 5 THEN '/cat/' END AS pattern FROM {listings} GROUP BY 1")
def url09_derive_product_pattern(listings):
    kind, number = F.col("shop_id") % 7, F.col("product_id").cast("string")
    two = F.when(F.col("product_id") % 2 == 0, "a").otherwise("b")
    path = F.when(kind == 0, F.concat(F.lit("/en-ca/Shop/item/"), number)).when(kind == 1, F.concat(F.lit("/"), number, F.lit("/cat/"), number, F.lit("/x.html"))).when(kind == 2, F.concat(F.lit("/"), number, F.lit("/p-"), number, F.lit("/"), number))
    path = path.when(kind == 3, F.concat(F.lit("/"), number, F.lit("/product/"), number)).when(kind == 4, F.concat(F.lit("/x/"), number)).when(kind == 5, F.concat(F.lit("/"), number, F.lit("/cat/men/"), number)).otherwise(F.concat(F.lit("/"), two, number))
    return mining.derive_product_pattern(listings.select(F.col("shop_id").alias("site"), F.concat(F.lit("https://s.example"), path).alias("url")))


@query("shops", """SELECT shop_id AS id, page, CASE shop_id % 6 WHEN 0 THEN 'https://a.example/l' WHEN 1 THEN concat('https://a.example/l?x=1&page=', page) WHEN 2 THEN CASE WHEN page = 2 THEN 'https://a.example/l/' ELSE concat('https://a.example/l/page/', page) END WHEN 3 THEN concat('https://a.example/l?page=', page, '&y=2') WHEN 4 THEN concat('https://a.example/l?start=', (page - 1) * 24) ELSE 'https://a.example/l' END AS url
  FROM (SELECT shop_id, unnest(CASE WHEN shop_id % 6 IN (0, 5) THEN [2] ELSE range(2, 2 + (shop_id % 3)) END)::INT AS page FROM {shops}) x""")
def url14_page_urls(shops):
    kind = F.col("shop_id") % 6
    style = F.when(kind == 0, "none").when(kind == 2, "path_segment").when(kind == 4, "offset").when(kind == 5, "link_rel").otherwise("query_param")
    url = F.when(kind == 1, "https://a.example/l?x=1").when(kind == 2, "https://a.example/l/").when(kind == 3, "https://a.example/l?page=9&y=2").otherwise("https://a.example/l")
    rows = shops.select(F.col("shop_id").alias("id"), url.alias("url"), style.alias("style"), F.when(kind == 4, "start").otherwise("page").alias("param"), F.lit("page/{n}").alias("template"), F.lit(2).alias("start"), (F.col("shop_id") % 3).cast("int").alias("pages"), F.lit(24).alias("per_page"))
    return mining.page_urls(rows)
