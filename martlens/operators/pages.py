"""Pages and URLs: links, shapes, classes, extraction from embedded JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.functions.latest import numbered, ranked
from martlens.functions.shared import once


def normalize_domain(url: Column) -> Column:
    """Host in lower case, without www. and port."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:https?://)?([^/?#:]+)", 1)), r"^www\.", "")


def shop_key(url: Column) -> Column:
    dashed = F.regexp_replace(normalize_domain(url), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, 64)


def domains(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", normalize_domain(F.col("url")).alias("domain"), shop_key(F.col("url")).alias("shop_key"))


def record_snapshots(pages: DataFrame) -> DataFrame:
    """Every fetch (page_id, site, html) with its content hash and whether it is the first of its site and hash.

    The smallest page_id of a hash is found by an aggregation and looked up by its id, so that no task takes all fetches of one hash.
    Without a page_id or html a fetch is no first one.
    """
    hashed = pages.select("page_id", "site", F.sha2("html", 256).alias("content_hash"))
    known = hashed.filter(F.col("content_hash").isNotNull())
    firsts = known.groupBy("site", "content_hash").agg(F.min("page_id").alias("page_id")).select("page_id", F.lit(True).alias("first"))
    return hashed.join(firsts.filter("page_id is not null").distinct(), "page_id", "left").withColumn("first", F.coalesce("first", F.lit(False)))


# What challenge pages and pages of closed shops have near their beginning.
BOT_WALL = ["just a moment", "cf-browser-verification", "verify your identity", "captcha", "px-captcha", "access denied", "robot or human", "_incapsula_resource", "incapsula incident id"]
SHUTDOWN = ["consolidation notice", "no longer operating"]


def flag_bot_walls(pages: DataFrame) -> DataFrame:
    """page_id, bot_wall and shutdown of pages (page_id, html, and, if known, final_url)."""
    has = lambda n, marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(F.lower(F.substring("html", 1, n)), m))
    blocked = F.coalesce(F.col("final_url").rlike(r"(?i)/blocked(\?|$)"), F.lit(False)) if "final_url" in pages.columns else F.lit(False)
    return pages.select("page_id", (blocked | F.coalesce(has(4000, BOT_WALL), F.lit(False))).alias("bot_wall"), F.coalesce(has(8000, SHUTDOWN), F.lit(False)).alias("shutdown"))


def condense_text(pages: DataFrame, cap: int = 6000, least: int = 40) -> DataFrame:
    """Text without scripts, styles and markup; white space collapsed; short ones left out."""
    text = F.regexp_replace("html", r"(?s)<(script|style|nav)[^>]*>.*?</(script|style|nav)>", " ")
    text = F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), "[ \t\n\r]+", " ")), 1, cap)
    return pages.select("page_id", text.alias("text")).filter(F.length("text") >= least)


def condensed_pages(pages: DataFrame, cap: int = 6000, least: int = 40) -> DataFrame:
    """Headline, social title, price and brand of each page (page_id, html), a line each where there is one, and below them its body's text.

    Scripts, styles, frames, headers, footers and navigation are left out first; the whole is cut to ``cap`` characters, and pages of
    fewer than ``least``, or without html, give no row. Entities stay as they are written.
    """
    gone = r"(?is)<(script|style|noscript|svg|iframe|header|footer|nav)\b[^>]*>.*?</\1\s*>|<!--.*?-->"
    plain = lambda c: F.regexp_replace(c, "<[^>]*>", "")
    first = lambda pattern, group: F.trim(plain(F.regexp_extract("html", pattern, group)))
    meta = lambda name: first(f'(?is)<meta\\b[^>]*property="{name}"[^>]*content="([^"]*)"', 1)
    marked = lambda word: first(rf'(?s)<([a-zA-Z][a-zA-Z0-9]*)\b[^>]*\bclass="[^"]*{word}[^"]*"[^>]*>(.*?)</\1\s*>', 2)
    heads = [first(r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1), meta("og:title"), meta("product:price:amount"), marked("price"), marked("brand")]
    inside = F.regexp_replace("html", r"(?is)^.*?<body\b[^>]*>|</body\s*>.*$|<head\b[^>]*>.*?</head\s*>", "")
    body = F.trim(F.regexp_replace(plain(inside), r"\s+", " "))
    lines = F.array_join(F.filter(F.array(*heads), lambda h: h != ""), "\n")
    cleaned = once(pages, "page_id", F.regexp_replace("html", gone, "").alias("html"))
    return once(cleaned, "page_id", F.substring(F.concat(lines, F.lit("\n"), body), 1, cap).alias("text")).filter(F.length("text") >= least)


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, host, link) of every anchor, fragments dropped."""
    link = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"#]*)'), F.lit(1))).alias("link")
    return pages.select("page_id", F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)).alias("host"), link)


def same_host_links(pages: DataFrame) -> DataFrame:
    a = anchors(pages)
    target = F.lower(F.regexp_extract("link", r"^https?://([^/?#:]+)", 1))
    return a.filter((F.col("link") != "") & (F.col("link").startswith("/") | (target == F.col("host")))).groupBy("page_id").agg(F.countDistinct("link").alias("links"))


def page_profile(pages: DataFrame) -> DataFrame:
    count = lambda p: F.size(F.regexp_extract_all("html", F.lit(f"({p})"), F.lit(1))).cast("long")
    return pages.select("page_id", count("<a ").alias("links"), count("<p>").alias("paragraphs"), count("<li>").alias("items"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def product_url_score(url: Column, sitemap: Column | None = None) -> Column:
    """Path depth up to 10; +50 for a category path, +8 for .html or .htm, -35 for a short /pdp/, +5 from a product sitemap; -100 for no URL."""
    path = F.lower(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    score = F.least(F.size(segments), F.lit(10)) + F.when(F.array_contains(segments, "cat"), 50).otherwise(0) + F.when(path.rlike(r"\.html?$"), 8).otherwise(0)
    score = score - F.when(path.contains("/pdp/") & (F.size(segments) <= 3), 35).otherwise(0)
    if sitemap is not None:
        score = score + F.when(sitemap.rlike("(?i)product"), 5).otherwise(0)
    return F.when(url.rlike("^https?://[^/?#]+"), score).otherwise(F.lit(-100))


def best_url_per_product(pages: DataFrame, least: int = 3, most: int = 10, per_block: int = 100_000) -> DataFrame:
    """Per site the best URL of each product key (a trailing number of six digits, else the last segment), for sites with enough."""
    host = normalize_domain(F.col("url"))
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    number, leaf = F.regexp_extract(path, r"([0-9]{6,})/?$", 1), F.regexp_extract(path, r"([^/]*)/?$", 1)
    rows = pages.select("page_id", host.alias("site"), F.when(number != "", number).otherwise(leaf).alias("product"), product_url_score(F.col("url")).alias("score"))
    best = rows.withColumn("rn", ranked(["site", "product"], F.col("score").desc(), F.col("page_id"))).filter("rn = 1")
    best = numbered(best.drop("rn"), ["site"], [F.col("score").desc(), F.col("page_id")], "place", "n", per_block)
    return best.filter((F.col("n") >= least) & (F.col("place") < most)).select("site", (F.col("place") + 1).cast("int").alias("place"), "page_id", "product", "score")


def product_segments(pages: DataFrame) -> DataFrame:
    """Share of each first path segment in its site: what a product pattern is derived from."""
    rows = pages.select(normalize_domain(F.col("url")).alias("site"), F.regexp_extract("url", r"^https?://[^/?#]+/([^/?#]*)", 1).alias("segment"))
    per = rows.groupBy("site", "segment").agg(F.count("*").alias("n"))
    w = Window.partitionBy("site")
    return per.withColumn("total", F.sum("n").over(w)).withColumn("majority", 2 * F.col("n") > F.col("total"))


def expand_pagination(listings: DataFrame, pages_each: int = 3) -> DataFrame:
    return listings.select("shop_id", F.explode(F.sequence(F.lit(1), F.lit(pages_each))).alias("page"), "domain").select("shop_id", "page", F.concat(F.lit("https://"), "domain", F.lit("/list?page="), F.col("page").cast("string")).alias("url"))


def dedupe_captures(captures: DataFrame) -> DataFrame:
    """First capture of each session and cookie."""
    return captures.withColumn("rn", ranked(["session", "cookie"], F.col("ts"), F.col("event_id"))).filter("rn = 1").select("session", "cookie", "event_id", "k")


def capture_dependencies(captures: DataFrame) -> DataFrame:
    """Of each request, how many responses of its session at or before it set the cookie that it sends.

    A running count in one pass over (session, cookie) in order of time, not a join of requests with responses.
    """
    w = Window.partitionBy("session", "cookie").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return captures.select("event_id", F.count(F.when(F.col("k") % 2 == 0, 1)).over(w).alias("setters"))


def rank_captures(captures: DataFrame, top: int = 5, least: int = 40) -> DataFrame:
    return captures.filter(F.col("k") >= least).withColumn("place", ranked(["session"], F.col("k").desc(), F.col("event_id"))).filter(F.col("place") <= top).select("session", "place", "event_id", "k")


def jsonld_pages(parts: DataFrame) -> DataFrame:
    """Product pages with a JSON-LD block, from the rows of a catalogue."""
    offer = F.struct(F.col("p_retailprice").cast("string").alias("price"), F.when(F.col("p_partkey") % 2 == 0, "USD").alias("priceCurrency"), F.when(F.col("p_partkey") % 3 == 0, "https://schema.org/OutOfStock").otherwise("https://schema.org/InStock").alias("availability"))
    node = F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"), F.col("p_partkey").cast("string").alias("sku"), F.array(offer).alias("offers"))
    body = F.concat(F.lit("<html><head><script type=\"application/ld+json\">"), F.to_json(node), F.lit("</script></head></html>"))
    return parts.select(F.col("p_partkey").alias("page_id"), body.alias("html"))


@F.pandas_udf(T.StringType())
def _first_product(blocks: pd.Series) -> pd.Series:
    """Of JSON-LD blocks the first node whose @type is or holds Product, as JSON: through arrays and @graph of any depth, what is in a node before it."""

    def one(text: str | None) -> str | None:
        try:
            open_ = [json.loads(text)]
        except (TypeError, ValueError, RecursionError):
            return None
        open_ = [(open_[0], False)]
        while open_:
            node, searched = open_.pop()
            if isinstance(node, list):
                open_ += [(x, False) for x in reversed(node)]
            elif isinstance(node, dict):
                graph = node.get("@graph")
                if isinstance(graph, list) and not searched:
                    open_ += [(node, True), *((x, False) for x in reversed(graph))]
                elif node.get("@type") == "Product" or isinstance(node.get("@type"), list) and "Product" in node["@type"]:
                    return json.dumps(node)
        return None

    return blocks.map(one, na_action=None)


def _nested(block: Column) -> Column:
    """May a block hold its product below an array in an array, or in @graph? Most hold it at the top."""
    return block.rlike(r"[\[,]\s*\[") | block.contains("@graph")


def jsonld_products(pages: DataFrame) -> DataFrame:
    """The first JSON-LD product with a title of each page, all fields, from any of the usual shapes.

    The first node of a block whose @type is or holds Product counts, in arrays and @graph of any depth; the first offer, alone or of a list;
    a price that is a finite number, also as text; USD only if stated, else CAD. Blocks that are an object or a flat list stay column expressions.
    """
    blocks = F.regexp_extract_all("html", F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    rows = pages.select("page_id", F.posexplode(blocks).alias("pos", "json"))
    deep = rows.filter(_nested(F.col("json"))).withColumn("json", _first_product("json"))
    rows = rows.filter(~_nested(F.col("json"))).unionByName(deep).withColumn("v", F.try_parse_json("json"))
    rows = rows.withColumn("nodes", F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))).drop("v")
    kind = lambda v: F.coalesce(F.array_contains(F.try_variant_get(v, "$['@type']", "array<string>"), "Product"), F.try_variant_get(v, "$['@type']", "string") == "Product", F.lit(False))
    rows = rows.select("page_id", "pos", F.filter("nodes", kind).alias("nodes")).filter(F.size("nodes") > 0).select("page_id", "pos", F.col("nodes")[0].alias("v"))
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    text = lambda path: F.when(F.schema_of_variant(get(path, "variant")) == "STRING", get(path))
    known = lambda path: F.nullif(F.trim(get(path)), F.lit(""))
    rows = rows.filter(F.length(text("$.name")) > 0).withColumn("rn", ranked(["page_id"], F.col("pos"))).filter("rn = 1")
    offer = lambda name: F.coalesce(get(f"$.offers[0].{name}"), get(f"$.offers.{name}"))
    price = F.trim(offer("price")).try_cast("double")
    finite = F.when(~F.isnan(price) & (F.abs(price) < float("inf")), price)
    state = F.lower(offer("availability"))
    state = F.when(state.contains("instock"), "in_stock").when(state.contains("outofstock") | state.contains("soldout"), "out_of_stock").when(state.contains("preorder"), "preorder").when(state.contains("discontinued"), "discontinued").otherwise("unknown")
    return rows.select(
        "page_id", text("$.name").alias("title"), F.coalesce(text("$.brand"), text("$.brand.name")).alias("brand"), F.coalesce(known("$.sku"), known("$.productID")).alias("sku"),
        F.coalesce(known("$.gtin13"), known("$.gtin"), known("$.gtin12")).alias("gtin"), finite.alias("price"), F.when(offer("priceCurrency") == "USD", "USD").otherwise("CAD").alias("currency"), state.alias("availability"),
        F.coalesce(text("$.image"), text("$.image[0]"), text("$.image.url")).alias("image"), text("$.color").alias("color"), text("$.material").alias("material"),
        F.nullif(text("$.description"), F.lit("")).alias("description"), F.nullif(text("$.mpn"), F.lit("")).alias("mpn"),
    )


def extract_jsonld_products(pages: DataFrame) -> DataFrame:
    """Of ``jsonld_products`` title, brand, sku, first offer."""
    return jsonld_products(pages).select("page_id", "title", "brand", "sku", "price", "currency", "availability")


def jsonld_shapes(parts: DataFrame) -> DataFrame:
    """Product pages in several shapes by the row's number: object, array, @graph, list of types; offers, brand, image and price vary too."""
    n, num = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    price = F.when(F.col("p_partkey") % 5 == 0, F.lit('"on request"')).when(n < 2, quoted(F.col("p_retailprice").cast("string"))).otherwise(F.col("p_retailprice").cast("string"))
    offer = F.concat(F.lit('{"price":'), price, F.lit(',"priceCurrency":"USD","availability":"https://schema.org/InStock"}'))
    fields = F.concat(
        F.lit('"name":'), quoted(F.col("p_name")), F.lit(',"brand":'), F.when(n % 2 == 0, quoted(F.col("p_brand"))).otherwise(F.concat(F.lit('{"name":'), quoted(F.col("p_brand")), F.lit("}"))),
        F.when(n == 3, F.lit(',"productID":')).otherwise(F.lit(',"sku":')), quoted(num), F.when(n == 1, F.lit(',"gtin12":')).otherwise(F.lit(',"gtin13":')), quoted(F.concat(F.lit("g"), num)),
        F.lit(',"image":'), F.when(n == 0, '"i.png"').when(n == 1, '["i.png","j.png"]').otherwise('{"url":"i.png"}'), F.when(n < 2, F.concat(F.lit(',"description":"d","mpn":'), quoted(F.concat(F.lit("m"), num)))).otherwise(F.lit(',"description":"","mpn":5')), F.lit(',"color":"red","offers":'), F.when(n == 2, F.concat(F.lit("["), offer, F.lit("]"))).otherwise(offer),
    )
    node = F.concat(F.lit('{"@type":'), F.when(n == 3, '["Thing","Product"]').otherwise('"Product"'), F.lit(","), fields, F.lit("}"))
    body = F.when(n == 1, F.concat(F.lit('[{"@type":"WebSite"},'), node, F.lit("]"))).when(n == 2, F.concat(F.lit('{"@graph":[{"@type":"WebPage"},'), node, F.lit("]}"))).otherwise(node)
    return parts.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit('<script type="application/ld+json">{bad</script><script type="application/ld+json">'), body, F.lit("</script>")).alias("html"))


def api_pages(parts: DataFrame, per_page: int = 24) -> DataFrame:
    """Captured API bodies: the catalogue's rows by the page."""
    item = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"), F.col("p_retailprice").alias("price"))
    per = parts.groupBy(F.floor(F.col("p_partkey") / per_page).alias("page")).agg(F.sort_array(F.collect_list(item)).alias("products"))
    return per.select("page", F.to_json(F.struct("products", F.size("products").alias("total"))).alias("body"))


def crawl_api_records(bodies: DataFrame) -> DataFrame:
    """A row for each record at ``products`` of each body."""
    schema = "struct<products:array<struct<id:bigint,title:string,vendor:string,price:double>>>"
    rows = bodies.select("page", F.explode(F.from_json("body", schema)["products"]).alias("p"))
    return rows.select("page", "p.id", "p.title", "p.vendor", "p.price")


def records_at(bodies: DataFrame, path: str) -> DataFrame:
    """(page, pos, record) for each record of the array at the dotted ``path`` of each body (page, body); an empty path is the body itself."""
    at = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(".") if p)
    return bodies.select("page", F.posexplode(F.try_variant_get(F.try_parse_json("body"), at, "array<variant>")).alias("pos", "record"))


def markdown_profile(pages: DataFrame) -> DataFrame:
    """Of each page (page_id, markdown): product links, links, prices in dollars and images; null is an empty page."""
    patterns = {"product_links": "(?i)/pdp/", "links": r"\[[^\]]+\]\([^)]+\)", "prices": r"\$[0-9,]+", "images": r"!\[[^\]]*\]\([^)]+\)"}
    return pages.select("page_id", *[F.regexp_count(F.coalesce("markdown", F.lit("")), F.lit(p)).alias(name) for name, p in patterns.items()])


def sitemap_bodies(pages: DataFrame, ids: int = 10_000) -> DataFrame:
    """Sitemap bodies (site, body) of the pages' URLs, one for each run of ``ids`` page ids of a site, so that none grows with its site."""
    entry = lambda u: F.concat(F.lit("<url><loc> "), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    body = F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.collect_list("url"), entry), ""), F.lit("</urlset>"))
    return pages.groupBy(normalize_domain(F.col("url")).alias("site"), F.floor(F.col("page_id") / ids).alias("run")).agg(body.alias("body")).select("site", "body")


def sitemap_urls(bodies: DataFrame) -> DataFrame:
    """A row for each <loc> of each sitemap body (site, body)."""
    return bodies.select("site", F.explode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))


def robots_sitemaps(bodies: DataFrame) -> DataFrame:
    return bodies.select("site", F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)\s*$"), F.lit(1))).alias("sitemap"))


def with_parameter(url: Column, name: str, value: Column) -> Column:
    """The URL with the query parameter set: in place of one of this name, else behind the others; the fragment stays last."""
    fragment = F.regexp_extract(url, "#.*$", 0)
    bare = F.regexp_replace(url, "#.*$", "")
    pair = F.concat(F.lit(f"{name}="), value)
    there = bare.rlike(rf"[?&]{name}=")
    put = F.when(there, F.concat(F.regexp_extract(bare, rf"^(.*?[?&]){name}=", 1), pair, F.regexp_extract(bare, rf"[?&]{name}=[^&]*(.*)$", 1)))
    return F.concat(put.otherwise(F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), pair)), fragment)


def outbound_links(listings: DataFrame, tag: str = "tag") -> DataFrame:
    """The listing's URL with its shop's tag (column ``tag``) as parameter aff; unchanged where there is none."""
    return listings.select("listing_id", F.when(F.col(tag).isNotNull(), with_parameter(F.col("url"), "aff", F.col(tag))).otherwise(F.col("url")).alias("link"))
