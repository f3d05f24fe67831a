"""Registered queries of the extraction operators; pages are made from the tables by the query itself, in all shapes that an operator reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from martlens.functions.shared import dealt
from martlens.operators import extract
from martlens.plans.registry import query

_q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("part", """SELECT p_partkey AS page_id, p_name AS title, CASE WHEN p_partkey % 4 <> 2 THEN p_brand END AS brand, CASE p_partkey % 4 WHEN 0 THEN 'K' WHEN 1 THEN 'C' END AS sku, CASE WHEN p_partkey % 4 = 1 THEN 'short' END AS description,
  CASE WHEN p_partkey % 4 = 0 THEN 'A/B' ELSE '' END AS category, CASE WHEN p_partkey % 8 = 0 THEN 1.5 ELSE p_retailprice END::DOUBLE AS price, CASE p_partkey % 4 WHEN 1 THEN 'out_of_stock' ELSE 'in_stock' END AS availability,
  CASE p_partkey % 4 WHEN 0 THEN 'https://s.example/i.png' WHEN 1 THEN 'https://x.example/i.png' ELSE 'https://s.example/j.png' END AS image FROM {part} WHERE p_partkey % 4 <> 3""")
def ext04_extract_next_data_products(part):
    key = F.col("p_partkey")
    cost_text = F.col("p_retailprice").cast("string")
    name, brand, n = _q(F.col("p_name")), _q(F.col("p_brand")), key % 4
    cost = F.when(key % 8 == 0, '"cost":{"now":1.5},').otherwise("")
    a = _text('{"product":{"name":', name, ',"brand":', brand, ',"code":"K",', cost, '"price":{"value":', cost_text, '},"images":[{"url":"/i.png"}],"breadcrumbs":[{"name":"A"},{"label":"B"},{"name":""}],"availabilityStatus":"IN_STOCK"}}')
    b = _text('{"productCode":"C","productData":{"name":', name, ',"brand":{"name":', brand, '},"shortDescription":"short","description":"long","price":', cost_text, ',"images":[{"urlOriginal":"https://x.example/i.png"}],"availabilityStatus":"Out of stock"}}')
    c = _text('{"customerGroupPrices":{"guest":{"price":{"lowPrice":{"value":', cost_text, '}}}},"product":{"name":', name, ',"media":["j.png"],"availabilityStatus":"Available"}}')
    props = F.when(n == 0, a).when(n == 1, b).when(n == 2, c).otherwise(F.lit('{"product":{"name":5}}'))
    html = _text('<p><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":', props, "}}</script>")
    return extract.next_data_products(part.select(key.alias("page_id"), F.lit("https://s.example/a/b").alias("url"), html.alias("html")), ["cost.now"], ["media.0"])


@query("part", "SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat('https://s.example/', p_partkey) END AS title, 'https://c.example/i.png' AS image FROM {part} WHERE p_partkey % 3 <> 2")
def ext06_extract_og_fallback(part):
    key = F.col("p_partkey")
    number = F.col("p_partkey").cast("string")
    title = F.when(key % 3 == 0, _text('<meta property="og:title" content=" ', F.col("p_name"), ' ">')).otherwise("")
    image = F.when(key % 3 == 2, '<meta property="og:image" content="/i.png">').otherwise('<meta property="OG:image" content="https://c.example/i.png">')
    return extract.og_products(part.select(key.alias("page_id"), _text("https://s.example/", number).alias("url"), F.concat(title, image).alias("html")))


_LAYERS = """SELECT *, k % 2 = 0 AS c, k % 4 <> 0 AS cp, k % 3 = 0 AS ci, k % 5 <> 0 AS j, k % 7 <> 0 AS jp, k % 2 = 1 OR k % 8 = 0 AS r, k % 11 = 0 AS m FROM (SELECT p_partkey AS k, p_name AS n, p_retailprice AS p FROM {part}) x"""


@query("part", f"""WITH l AS ({_LAYERS}), a AS (SELECT *, j AND (NOT c OR NOT cp) AS uj FROM l), b AS (SELECT *, CASE WHEN c AND cp THEN p WHEN uj AND jp THEN p + 1 END AS p1, CASE WHEN c AND ci THEN 'c.png' END AS i1 FROM a),
  d AS (SELECT *, r AND (p1 IS NULL OR i1 IS NULL) AS ur FROM b), e AS (SELECT *, coalesce(p1, CASE WHEN ur THEN p + 2 END) AS p2, coalesce(i1, CASE WHEN ur THEN 'r.png' END) AS i2 FROM d), g AS (SELECT *, m AND p2 IS NULL AS um FROM e)
  SELECT k AS page_id, CASE WHEN c THEN n WHEN uj THEN concat(n, ' j') WHEN ur THEN concat(n, ' r') ELSE concat(n, ' m') END AS title, CASE WHEN uj THEN 'jb' END AS brand, coalesce(p2, CASE WHEN um THEN p + 3 END) AS price, i2 AS image,
  CASE WHEN uj THEN 'a/b' ELSE '' END AS category, concat(CASE WHEN c THEN 'own' WHEN uj THEN 'j' WHEN ur THEN 'r' ELSE 'm' END, CASE WHEN uj THEN '+' ELSE '' END) AS attributes FROM g WHERE c OR uj OR ur OR um""")
def ext07_merge_extractions(part):
    key = F.col("p_partkey")
    base = part.select(key.alias("page_id"), F.col("p_name").alias("n"), F.col("p_retailprice").alias("p"), key.alias("k"))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")

    def layer(where, title, brand, price, image, category, attributes):
        return base.filter(where).select("page_id", title.alias("title"), brand.alias("brand"), price.alias("price"), image.alias("image"), category.alias("category"), attributes.alias("attributes"))

    named = lambda s: F.concat("n", F.lit(s))
    who = lambda s: F.create_map(F.lit("who"), F.lit(s))
    custom = layer("k % 2 = 0", F.col("n"), none, F.when(F.col("k") % 4 != 0, F.col("p")), F.when(F.col("k") % 3 == 0, "c.png"), empty, who("own"))
    json_ld = layer("k % 5 <> 0", named(" j"), F.lit("jb"), F.when(F.col("k") % 7 != 0, F.col("p") + 1), none, F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit("who"), F.lit("j"), F.lit("more"), F.lit("+")))
    recipe = layer("k % 2 = 1 OR k % 8 = 0", named(" r"), none, F.col("p") + 2, F.lit("r.png"), empty, who("r"))
    model = layer("k % 11 = 0", named(" m"), none, F.col("p") + 3, none, empty, who("m"))
    out = extract.merge_extractions(custom, json_ld, recipe, model)
    return out.select("page_id", "title", "brand", "price", "image", F.array_join("category", "/").alias("category"), F.concat(F.col("attributes")["who"], F.coalesce(F.try_element_at("attributes", F.lit("more")), F.lit(""))).alias("attributes"))


@query("part", """SELECT p_partkey AS page_id, concat_ws(',', CASE WHEN p_partkey % 11 = 0 THEN 'title' END, CASE WHEN p_partkey % 7 = 0 THEN 'url' END, CASE WHEN p_partkey % 5 = 0 THEN 'price' END, CASE WHEN p_partkey % 13 IN (0, 1) THEN 'stock_qty' END,
  CASE WHEN p_partkey % 17 = 0 THEN 'currency' END, CASE WHEN p_partkey % 19 = 0 THEN 'availability' END) AS wrong, CASE p_partkey % 17 WHEN 0 THEN 'EUR' WHEN 1 THEN 'CAD' ELSE 'USD' END AS currency FROM {part}
  WHERE p_partkey % 11 = 0 OR p_partkey % 7 = 0 OR p_partkey % 5 = 0 OR p_partkey % 13 < 2 OR p_partkey % 17 = 0 OR p_partkey % 19 = 0""")
def ext08_quarantine(part):
    key = F.col("p_partkey")
    rows = part.select(
        key.alias("page_id"), F.when(key % 11 != 0, F.col("p_name")).alias("title"), F.when(key % 7 == 0, "not a url").otherwise("https://a.example.com/p").alias("url"), F.when(key % 5 == 0, -1.0).otherwise(F.col("p_retailprice")).alias("price"),
        F.when(key % 13 == 0, -1.0).when(key % 13 == 1, 1.5).when(key % 13 == 2, 4.0).alias("stock_qty"), F.when(key % 17 == 0, "EUR").when(key % 17 != 1, "USD").alias("currency"), F.when(key % 19 == 0, "maybe").when(key % 19 == 1, "preorder").alias("availability"),
    )
    _, aside = extract.gate(rows)
    return aside.select("page_id", F.array_join("wrong", ",").alias("wrong"), "currency")


_PLATFORMS = list(extract.PLATFORM_FIELDS)
_BY_NUMBER = " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_PLATFORMS))


def _platform():
    key = F.col("p_partkey")
    return F.get(F.array(*map(F.lit, _PLATFORMS)), (key % 7).cast("int"))


@query("part", f"""SELECT p_partkey AS page_id, CASE p_partkey % 7 {_BY_NUMBER} END AS platform, 0 AS pos, p_name AS title, CASE p_partkey % 7 WHEN 2 THEN concat('https://w.example/', p_partkey) ELSE concat('https://s.example/p/', p_partkey) END AS url,
  CASE WHEN p_partkey % 7 IN (0, 1, 3, 4, 5) THEN p_brand END AS brand, concat('s', p_partkey) AS sku, p_retailprice AS price, concat('i', p_partkey) AS image, 'all' AS category, CASE WHEN p_partkey % 7 IN (0, 2, 3, 4) AND p_partkey % 2 = 0 THEN p_retailprice + 1 END AS list_price FROM {{part}}""")
def ext11_map_api_records(part):
    key = F.col("p_partkey")
    number = F.col("p_partkey").cast("string")
    cost_text = F.col("p_retailprice").cast("string")
    name, brand, sku, image = _q(F.col("p_name")), _q(F.col("p_brand")), _q(F.concat(F.lit("s"), number)), _q(F.concat(F.lit("i"), number))
    listed = F.when(key % 2 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice") - 1).cast("string")
    bodies = [
        _text('{"products":[{"title":', name, ',"handle":', _q(number), ',"vendor":', brand, ',"variants":[{"sku":', sku, ',"price":', _q(cost_text), ',"compare_at_price":', _q(listed), '}],"images":[{"src":', image, "}]}]}"),
        _text('{"items":[{"name":', name, ',"sku":', sku, ',"price":', cost_text, ',"custom_attributes":{"manufacturer":', brand, ',"url_key":', _q(number), '},"media_gallery_entries":[{"file":', image, "}]}]}"),
        _text('[{"name":', name, ',"sku":', sku, ',"prices":{"price":', _q(cost_text), ',"regular_price":', _q(listed), '},"permalink":', _q(F.concat(F.lit("https://w.example/"), number)), ',"images":[{"src":', image, "}]}]"),
        _text('{"data":[{"name":', name, ',"brand":{"name":', brand, '},"sku":', sku, ',"price":{"value":', cost_text, '},"retail_price":{"value":', listed, '},"path":', _q(F.concat(F.lit("/"), number)), ',"default_image":{"url":', image, "}}]}"),
        _text('{"hits":[{"productName":"","name":', name, ',"link":', _q(number), ',"id":', sku, ',"minPrice":', cost_text, ',"listPrice":', listed, ',"image":{"url":', image, '},"manufacturerName":', brand, "}]}"),
        _text('{"data":{"products":{"edges":[{"node":{"title":', name, ',"vendor":', brand, ',"handle":', _q(number), ',"variants":{"edges":[{"node":{"sku":', sku, ',"price":{"amount":', _q(cost_text), '}}}]},"featuredImage":{"url":', image, "}}}]}}}"),
        _text('{"data":{"products":{"results":[{"masterData":{"current":{"name":{"en":', name, '},"slug":{"en":', _q(number), '},"masterVariant":{"sku":', sku, ',"prices":[{"value":{"centAmount":', cost_text, '}}],"images":[{"url":', image, "}]}}}}]}}}"),
    ]
    body = F.coalesce(*[F.when(key % 7 == k, b) for k, b in enumerate(bodies)])
    rows = dealt(part, "p_partkey").select(key.alias("page_id"), _platform().alias("platform"), body.alias("body"), F.lit("https://s.example/p").alias("prefix"), F.lit("all").alias("label"))
    return extract.map_api_records(rows, extract.platform_field_maps(part.sparkSession))


@query("part", """SELECT p_partkey AS page_id, CASE p_partkey % 7 WHEN 4 THEN 'offset' WHEN 5 THEN 'cursor' WHEN 6 THEN 'offset' ELSE 'page' END AS style, CASE p_partkey % 7 WHEN 0 THEN 250 WHEN 1 THEN 20 WHEN 2 THEN 20 WHEN 6 THEN 20 ELSE 24 END::INT AS per_page,
  CASE p_partkey % 7 WHEN 0 THEN 'title' WHEN 4 THEN 'productName' WHEN 5 THEN 'node.title' WHEN 6 THEN 'masterData.current.name.en' ELSE 'name' END AS title_path FROM {part}""")
def ext12_platform_field_maps(part):
    key = F.col("p_partkey")
    maps = F.broadcast(extract.platform_field_maps(part.sparkSession))  # seven rows
    return part.select(key.alias("page_id"), _platform().alias("platform")).join(maps, "platform").select("page_id", "style", "per_page", F.col("fields")["title"][0].alias("title_path"))


@query("part", "SELECT p_partkey AS page_id, p_partkey % 7 IN (0, 1, 4) AS product_page FROM {part}")
def ext14_classify_product_pages(part):
    key = F.col("p_partkey")
    cost_text = F.col("p_retailprice").cast("string")
    ld = lambda *body: _text('<script type="application/ld+json">', *body, "</script>")
    shapes = [
        ld('{"@type":"Product","offers":{"price":', _q(cost_text), "}}"), ld('{"@graph":[{"@type":"WebPage"},{"@type":["ProductGroup"],"hasVariant":[{"offers":[{"lowPrice":', cost_text, "}]}]}]}"), ld('{"@type":"Product","name":', _q(F.col("p_name")), ',"offers":{"price":" "}}'),
        ld('{"@type":"ItemList","itemListElement":[{"@type":"Product","offers":{"price":', cost_text, "}}]}"), F.lit('<meta property="og:type" content="og:Product"><meta property="product:price:amount" content="3">'), ld("{bad"), F.lit('<meta property="og:type" content="product">'),
    ]
    return extract.classify_product_pages(part.select(key.alias("page_id"), F.coalesce(*[F.when(key % 7 == k, s) for k, s in enumerate(shapes)]).alias("html")))


@query("part", "SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 2 THEN '' ELSE concat('Home,', p_type) END AS names FROM {part}")
def ext02_extract_breadcrumbs(part):
    key = F.col("p_partkey")
    trail = _text("<a>Home</a> / <a> ", F.col("p_type"), " </a><a>", F.col("p_type"), "</a><a> </a>")
    html = F.when(key % 3 == 0, _text('<nav class="x breadcrumb">', trail, "</nav><a>Other</a>")).when(
        key % 3 == 1, _text('<ol itemtype="https://schema.org/BreadcrumbList"><li><span itemprop="name">Home</span><li><b itemprop="name"><i>', F.col("p_type"), '</i></b></ol><b itemprop="name">x</b>')
    ).otherwise(_text('<div class="breadcrumb">', trail, "</div>"))
    return extract.extract_breadcrumbs(part.select(key.alias("page_id"), html.alias("html"))).select("page_id", F.array_join("names", ",").alias("names"))


def _context(part, column, body):
    key = F.col("p_partkey")
    return dealt(part, "p_partkey").select(key.alias("page_id"), body.alias(column), F.lit("/(p|pdp)/").alias("pattern"), F.lit("https://shop.example").alias("origin"), F.lit("shop.example").alias("domain"))


@query("part", """SELECT p_partkey AS page_id, concat('https://shop.example/p/', p_partkey, '?x=1') AS url, p_name AS title, p_size + 0.5::DOUBLE AS price, p_size + 1.0::DOUBLE AS list_price, concat('https://shop.example/i/', p_partkey, '.png') AS image FROM {part}
  UNION ALL SELECT p_partkey, concat('https://shop.example/p/red_shoe-', p_partkey, '.html'), concat('red shoe ', p_partkey), NULL, NULL, NULL FROM {part}""")
def ext09_extract_listing_html(part):
    number = F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("string")
    html = _text(
        '<ul><li class="c"><a class="q" href="/p/', number, '?x=1"> <b>', F.col("p_name"), "</b>\n</a><p>NOW$", size, ".50 was $", F.expr("cast(p_size + 1 AS string)"), '.00</p><img alt="" src="i/', number, '.png"></li><li><a href="https://other.example/p/1">x</a></li><li><a href="/p/', number, '">again $1</a>',
        '<li><a href="/about">$5</a><article><a href="https://shop.example/p/red_shoe-', number, '.html"><img data-x="1"></a></article></ul><script>"<a href=/p/9>"</script>',
    )
    return extract.extract_listing_html(_context(part, "html", html))


@query("part", """SELECT p_partkey AS page_id, concat('https://shop.example/pdp/a-', p_partkey, '.html') AS url, p_name AS title, 56.97::DOUBLE AS price, p_size + 100.25::DOUBLE AS list_price, 'https://c.example/a.png' AS image FROM {part}
  UNION ALL SELECT p_partkey, concat('https://shop.example/pdp/b-', p_partkey), concat('Boot ', p_name), p_size + 2.5::DOUBLE, p_size + 3.5::DOUBLE, NULL FROM {part} UNION ALL SELECT p_partkey, concat('https://shop.example/pdp/warm-sock-', p_partkey, '?c=2'), 'Warm Sock', NULL, NULL, NULL FROM {part}""")
def ext10_extract_listing_markdown(part):
    number = F.col("p_partkey").cast("string")
    money = lambda add: F.expr(f"format_string('%d.{add[1]}', p_size + {add[0]})")
    body = _text(
        "[Skip](#main) [Other](https://other.example/pdp/x)\n\n[", F.col("p_name"), " * ![one](https://c.example/s.svg) ![two](https://c.example/a.png) NOW$56.97 price was $", money((100, "25")), " Save 40% ($38.02)](https://shop.example/pdp/a-", number, ".html#top)\n\n\n",
        "## Boot ", F.col("p_name"), "\n[](/pdp/b-", number, ")\nCA$", money((2, "50")), " or $", money((3, "50")), " Save 10% ($1.00)\n\n\n\n[ ](/pdp/warm-sock-", number, "?c=2)\n",
    )
    return extract.extract_listing_markdown(_context(part, "markdown", body))


@query("pages", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://s.example/l?page=2' WHEN 1 THEN 'https://s.example/n' WHEN 2 THEN 'https://s.example/l?a=1&page=8&b=2' WHEN 3 THEN 'https://s.example/m/2' END AS next FROM {pages}""")
def ext18_next_page_links(p):
    n = F.col("page_id") % 5
    url = F.when(n == 2, "https://s.example/l?a=1&page=7&b=2").otherwise("https://s.example/l")
    html = F.when(n == 0, '<link href="?page=2" rel="next">').when(n == 1, '<a href="https://other.example/" rel="next">x</a><a class="b next" href="/n">x</a>').when(n == 3, "<a aria-label='Go to Next page' href='m/2'>").otherwise("<a href='/x'>next</a>")
    html = F.when(n == 0, '<link href="l?page=2" rel="next">').otherwise(html)
    return extract.next_page_links(p.select("page_id", url.alias("url"), html.alias("html")))


@query("pages", r"""WITH l AS (SELECT page_id, url, unnest(list_concat(list_filter(regexp_extract_all(html, '<a\b[^>]*?\bhref\s*=\s*["'']([^"''#]*)', 1, 'is'), lambda h: h <> '' AND NOT regexp_matches(h, '^(mailto|tel|javascript):', 'i')), regexp_extract_all(html, '/(?:[a-z]{2}-[A-Z]{2}/)?p-[a-z0-9][\w-]*(?:/\d+)+', 0, 'i'))) AS h FROM {pages}),
  r AS (SELECT page_id, url, CASE WHEN regexp_matches(h, '^https?://', 'i') THEN h WHEN starts_with(h, '//') THEN concat(regexp_extract(url, '^(https?:)', 1), h) WHEN starts_with(h, '/') THEN concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), h) ELSE concat(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/', h) END AS link FROM l)
  SELECT DISTINCT page_id, link FROM r WHERE lower(regexp_extract(link, '^https?://([^/?#]+)', 1)) = lower(regexp_extract(url, '^https?://([^/?#]+)', 1))""")
def ext21_resolved_links(p):
    return extract.resolved_links(p)
