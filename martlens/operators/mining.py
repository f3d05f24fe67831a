"""Site and URL mining: sitemaps in every shape, manifests, categories, fingerprints, captures, product evidence."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.functions.latest import numbered, ranked
from martlens.functions.shared import once, spread, tasks_for, written
from martlens.functions.urls import let
from martlens.operators.extract import resolve
from martlens.operators.pages import normalize_domain, product_url_score


def _plain(text: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(text)


def _inside(text: Column, tag: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))


def sitemap_entries(bodies: DataFrame) -> DataFrame:
    """(site, kind, url) of sitemap bodies (site, body): urlset, index, RSS items, Atom entries (the alternate link first), plain text, else any <loc>."""
    b = F.col("body")
    loc = lambda x: F.get(_inside(x, "loc"), F.lit(0))
    link = F.transform(_inside(b, "item"), lambda x: F.get(_inside(x, "link"), F.lit(0)))

    def atom(x: Column) -> Column:
        tags = F.regexp_extract_all(x, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
        href = lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']([^"']*)["']""", 1)
        good = F.filter(tags, lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']alternate["']""") | ~t.rlike(r"(?i)\brel\s*="))
        first = F.coalesce(F.get(good, F.lit(0)), F.get(tags, F.lit(0)))
        return F.coalesce(F.nullif(href(first), F.lit("")), F.get(_inside(x, "link"), F.lit(0)))

    lines = F.filter(F.transform(F.split(b, "\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike("(?i)^https?://"))
    kinds = [
        ("text", ~F.ltrim(F.substring(b, 1, 512)).startswith("<"), lines), ("index", b.rlike(r"(?i)<sitemapindex\b"), F.transform(_inside(b, "sitemap"), loc)), ("urlset", b.rlike(r"(?i)<urlset\b"), F.transform(_inside(b, "url"), loc)),
        ("rss", b.rlike(r"(?i)<rss\b"), link), ("atom", b.rlike(r"(?i)<feed\b"), F.transform(_inside(b, "entry"), atom)), ("loc", F.lit(True), _inside(b, "loc")),
    ]
    some = lambda name, urls: let(urls, lambda u: F.when(F.size(u) > 0, F.struct(F.lit(name).alias("kind"), u.alias("urls"))))
    found = once(bodies, "site", F.coalesce(*[F.when(test, some(name, urls)) for name, test, urls in kinds]).alias("f"))
    rows = found.select("site", F.col("f.kind").alias("kind"), F.explode("f.urls").alias("url"))
    return once(rows, "site", "kind", F.when(F.col("kind") == "text", F.col("url")).otherwise(_plain(F.col("url"))).alias("url")).filter(F.length("url") > 0)


def sitemap_tree(maps: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """(root, url) of all pages that the root sitemaps (root, map) lead to, over indexes at most ``depth`` deep. maps: map, body.

    Bodies are read once. Rounds follow only what leads from one index to another, which is little; the last round is that which finds none, or the one
    before ``depth``. All maps that the indexes found by then name are opened together, so each entry is shuffled a fixed number of times, whatever the depth.
    """
    every = written(sitemap_entries(maps.withColumnRenamed("map", "site")).withColumnRenamed("site", "map"), "entries")
    tasks = tasks_for(every)
    links, pages = every.filter("kind = 'index'").select("map", F.col("url").alias("to")), every.filter("kind <> 'index'").select("map", "url")
    opened = open_ = seen = written(roots.select("root", "map").distinct(), "maps")
    if depth > 0:
        indexes = written(links.select("map").distinct(), "indexes")
        between = written(spread(links, tasks, "to").join(indexes.select(F.col("map").alias("to")), "to", "left_semi"), "between")
        for _ in range(depth - 1):
            found = open_.join(between, "map").select("root", F.col("to").alias("map")).distinct()
            open_ = written(found.join(seen, ["root", "map"], "left_anti"), "maps")
            if not open_.limit(1).count():
                break
            seen = seen.unionByName(open_)
        opened = opened.unionByName(seen.join(spread(links, tasks, "map"), "map").select("root", F.col("to").alias("map")))
    out = spread(opened, tasks, "map").distinct().join(spread(pages, tasks, "map"), "map").select("root", "url")
    return spread(out, tasks, "root", "url").distinct()


# Path tokens of product pages, and files that are no pages.
PRODUCT_TOKENS = ["products", "product", "pdp", "ip", "p", "item", "sku", "dp", "pd"]
MEDIA = r"(?i)\.(png|jpe?g|webp|gif|svg|glb|avif|mp4)(\?|$)"


def manifest_hints(texts: DataFrame) -> DataFrame:
    """By site what a manifest for agents (site, origin, text) tells: sitemaps, API URLs, up to 8 product samples, listing URLs, and two flags."""
    direct = F.transform(F.regexp_extract_all("text", F.lit(r"https?://[^\s)\]>\"']+"), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;]+$", ""))
    linked = F.transform(F.regexp_extract_all("text", F.lit(r"\]\(([^)]+)\)"), F.lit(1)), lambda h: resolve(F.trim(h), F.col("origin")))
    urls = F.filter(F.array_distinct(F.concat(direct, linked)), lambda u: u.startswith("http"))
    path = lambda u: F.lower(F.regexp_extract(u, r"^https?://[^/?#]+([^?#]*)", 1))
    sitemap = lambda u: u.rlike(r"(?i)sitemap") | u.rlike(r"(?i)\.xml(?:\.gz)?(?:\?|$)")
    product = lambda u: ~path(u).rlike(MEDIA) & (path(u).rlike("/p-[^/]+") | path(u).rlike(f"/({'|'.join(PRODUCT_TOKENS)})/"))
    lower = F.lower("text")
    joined = lambda a: F.array_join(a, " ")
    rows = texts.select("site", urls.alias("urls"), (lower.contains("__next_data__") | lower.contains("next.js")).alias("next_data"), (lower.contains("javascript") | lower.contains("client-rendered") | lower.contains("playwright")).alias("browser"))
    return rows.select(
        "site", joined(F.filter("urls", sitemap)).alias("sitemaps"), joined(F.filter("urls", lambda u: u.rlike(r"(?i)/api/|graphql|\.json(?:\?|$)"))).alias("apis"), joined(F.slice(F.filter("urls", product), 1, 8)).alias("samples"),
        joined(F.filter("urls", lambda u: u.rlike("(?i)/(collections?|categories|shop|browse)/"))).alias("listings"), F.when(F.col("next_data"), "next_data").otherwise("json_ld").alias("extraction"), "browser",
    )


def load_seeds(state: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """``state`` with the seed rows of keys that it lacks; of seeds that repeat a key one stays."""
    return state.unionByName(seeds.dropDuplicates([key]).join(state.select(key), key, "left_anti").select(*state.columns))


# Paths of category pages, what none has, names of links that are none, and paths of other listings.
CATEGORY = r"(?i)/(cat|categories|collections|category|shop/all|shop-all)/|/en/cat/|/c/(?!lp/)"
NO_CATEGORY = r"(?i)(cart|wishlist|account|login|sign-?in|customer-service|check-order|/pdp/|truefit|affiliate|privacy|terms|robots|sitemap|/lp/|about-|application|sustainability|innovation)"
NO_NAME = r"(?i)^(skip|search|sign in|wishlist|support|email sign up|order status)$"
LISTING = r"(?i)/(collections?|categories|shop|browse)/"


def category_links(pages: DataFrame, most: int = 120) -> DataFrame:
    """site, name, url, place, pattern, confidence of category links in navigation markdown (site, domain, markdown): deepest first, each once, at most ``most``."""
    links = F.regexp_extract_all("markdown", F.lit(r"\[([^\]]{1,120})\]\(([^)]+)\)"), F.lit(1))
    targets = F.regexp_extract_all("markdown", F.lit(r"\[([^\]]{1,120})\]\(([^)]+)\)"), F.lit(2))
    count = lambda p: F.size(F.regexp_extract_all("markdown", F.lit(f"(?i)({p})"), F.lit(1)))
    pattern = F.when((count("/pdp/") >= count("/products/")) & (count("/pdp/") > 0), "/pdp/").when(count("/products/") > 0, "/products/").otherwise("/product/")
    root = F.array_join(F.slice(F.split("domain", r"\."), -2, 2), ".")
    root = F.when(F.size(F.split("domain", r"\.")) > 1, root).otherwise(F.col("domain"))
    rows = once(pages, "site", root.alias("root"), F.concat(F.lit("https://"), "domain").alias("origin"), pattern.alias("pattern"), F.arrays_zip(links.alias("name"), targets.alias("href")).alias("links"))
    rows = once(rows.select("site", "root", "origin", "pattern", F.posexplode("links").alias("pos", "l")), "site", "root", "pattern", "pos", F.regexp_replace(F.trim("l.name"), r"\s+", " ").alias("name"), resolve(F.trim("l.href"), F.col("origin")).alias("url"))
    good = (F.length("name") >= 2) & ~F.col("name").rlike(NO_NAME) & F.contains(F.regexp_extract("url", r"^https?://([^/?#]+)", 1), F.col("root")) & ~F.col("url").rlike(NO_CATEGORY) & F.col("url").rlike(CATEGORY)
    rows = rows.filter(good).withColumn("url", F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/$", ""))
    first = rows.groupBy("site", "url").agg(F.min_by(F.struct("name", "pos", "pattern"), "pos").alias("r")).select("site", "url", "r.*")
    first = first.withColumn("place", ranked(["site"], F.size(F.split("url", "/")).desc(), F.col("pos"))).filter(F.col("place") <= most)
    n = F.count("*").over(Window.partitionBy("site"))
    return first.select("site", "name", "url", "place", "pattern", F.when(n >= 20, 0.85).when(n >= 5, 0.7).otherwise(0.4).alias("confidence"))


def filter_categories(categories: DataFrame) -> DataFrame:
    """Categories (site, domain, name, url, pos) whose host holds the domain or is held by it, once each but for a last slash."""
    bare = lambda c: F.regexp_replace(c, r"^www\.", "")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    kept = categories.filter((host != "") & (F.contains(host, bare(F.col("domain"))) | F.contains(F.col("domain"), bare(host))))
    kept = kept.withColumn("key", F.regexp_replace("url", "/$", ""))
    return kept.withColumn("rn", ranked(["site", "key"], F.col("pos"))).filter("rn = 1").select("site", "name", "url")


def listing_candidates(pages: DataFrame) -> DataFrame:
    """(page_id, url, label) of links on homepages (page_id, url, html, listing_pattern) to listings; the homepage itself where there is none."""
    tags = F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""), F.lit(2))
    rows = pages.select("page_id", F.regexp_replace("url", "/$", "").alias("home"), F.lower(F.coalesce("listing_pattern", F.lit("/collections/"))).alias("pattern"), F.posexplode_outer(F.arrays_zip(tags.alias("href"), texts.alias("text"))).alias("pos", "l"))
    url = resolve(F.col("l.href"), F.col("home"))
    label = F.substring(F.trim(F.regexp_replace(F.regexp_replace("l.text", "<[^>]*>", ""), r"\s+", " ")), 1, 120)
    rows = rows.select("page_id", "home", "pos", url.alias("url"), F.coalesce(F.nullif(label, F.lit("")), url).alias("label"), F.coalesce(F.contains(F.lower(url), F.col("pattern")) | url.rlike(LISTING), F.lit(False)).alias("good"))
    found = rows.groupBy("page_id", "home", "url").agg(F.max_by("label", "pos").alias("label"), F.bool_or("good").alias("good"))
    none = found.groupBy("page_id", "home").agg(F.bool_or("good").alias("any")).filter("NOT any").select("page_id", F.col("home").alias("url"), F.lit("Home").alias("label"))
    return found.filter("good").select("page_id", "url", "label").unionByName(none)


# Markers of platforms: in the page's lower-case text, or in one of its URLs, with the platform and the weight.
MARKERS = [
    ("shopify_hydrogen", 0.45, ["@shopify/hydrogen", "shopify hydrogen"], []), ("shopify", 0.35, ["cdn.shopify.com", "shopify.theme"], []), ("shopify", 0.25, ["myshopify.com"], ["myshopify.com"]), ("shopify", 0.2, ["/products.json"], ["/products.json"]),
    ("shopify", 0.15, ["shopify-storefront-access-token"], []), ("bigcommerce", 0.4, ["bigcommerce"], ["bigcommerce.com"]), ("bigcommerce", 0.25, ["window.bcdata", "stencilbootstrap"], []),
    ("salesforce", 0.35, ["salesforce", "demandware", "dw.ac", "/on/demandware.store/"], ["/on/demandware.store/"]), ("magento", 0.35, ["mage/", "data-mage-init"], []), ("magento", 0.2, [], ["/rest/v1/"]), ("woocommerce", 0.3, ["wp-content", "woocommerce"], []),
    ("woocommerce", 0.25, [], ["/wp-json/wc/store/"]), ("commercetools", 0.35, ["commercetools"], []), ("custom_nextjs", 0.15, ["__next_data__", "/_next/static/"], []),
]
# The engine behind a platform, where it has another name or one of its own.
ENGINES = {"shopify": "shopify", "shopify_hydrogen": "shopify", "salesforce": "demandware", "bigcommerce": "bigcommerce", "magento": "magento", "woocommerce": "woocommerce", "commercetools": "commercetools"}


def fingerprint_sites(sites: DataFrame) -> DataFrame:
    """site, platform, confidence, engine, framework, protection of homepages (site, html, urls, headers): rules over one row, no join."""
    lower, urls = F.lower("html"), F.coalesce(F.transform("urls", lambda u: F.lower(u)), F.array().cast("array<string>"))
    any_of = lambda text, marks: F.coalesce(*[F.when(text.contains(m), True) for m in marks], F.lit(False)) if marks else F.lit(False)
    scores: dict[str, list[Column]] = {}
    linked_by = lambda marks: F.exists(urls, lambda u: any_of(u, marks))
    for platform, weight, inside, linked in MARKERS:
        hit = any_of(lower, inside) | linked_by(linked)
        scores.setdefault(platform, []).append(F.when(hit, weight).otherwise(0.0))
    rows = sites.withColumn("scores", F.array(*[F.struct(sum(s[1:], s[0]).alias("score"), F.lit(-k).alias("k"), F.lit(p).alias("platform")) for k, (p, s) in enumerate(scores.items())]))
    best = F.array_max("scores")
    some = best["score"] > 0
    engine = F.coalesce(*[F.when(F.col("platform") == p, e) for p, e in ENGINES.items()])
    # Markers of frameworks and of bot protection.
    framework = F.when(any_of(lower, ["@shopify/hydrogen", "shopify hydrogen"]), "hydrogen").when(any_of(lower, ["stencilbootstrap", "window.bcdata"]), "stencil").when(any_of(lower, ["__next_data__", "/_next/static/"]), "nextjs").when(lower.contains("react"), "react").otherwise("unknown")
    blob = F.lower(F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), " "))
    blob = F.coalesce(blob, F.lit(""))
    protection = F.when(blob.contains("cloudflare") | lower.contains("cf-browser-verification"), "cloudflare").when(lower.contains("incapsula"), "incapsula").when(blob.contains("akamai") | lower.contains("akamai"), "akamai").otherwise("none")
    rows = rows.select("site", F.when(some, best["platform"]).otherwise("unknown").alias("platform"), F.least(F.lit(1.0), best["score"]).alias("confidence"), framework.alias("framework"), protection.alias("protection"))
    return rows.select("site", "platform", "confidence", engine.alias("engine"), "framework", "protection")


# Keys of titles, prices and URLs in product lists.
_TITLE, _PRICE, _URL = (re.compile(p, re.I) for p in (r"(title|name|productname|displayname)", r"(price|currentprice|saleprice|amount|lowprice)", r"(url|link|slug|producturl|pdpurl|path)"))


def _likeness(node: object, depth: int = 0) -> float:
    """The best score of a list of objects in the node: what the first one's keys say, and how many there are."""
    if depth > 8 or not isinstance(node, dict | list):
        return 0.0
    best = max((_likeness(n, depth + 1) for n in (node if isinstance(node, list) else node.values())), default=0.0)
    rows = [n for n in node if isinstance(n, dict | list) and n is not None] if isinstance(node, list) and len(node) > 1 else []
    if len(rows) > 1:
        first = rows[0] if isinstance(rows[0], dict) else {}
        inner = lambda v: isinstance(v, dict) and any(_PRICE.fullmatch(k) or k == "value" for k in v)
        score = 0.3 * any(map(_TITLE.fullmatch, first)) + 0.3 * any(_PRICE.fullmatch(k) or inner(v) for k, v in first.items()) + 0.2 * any(map(_URL.fullmatch, first)) + 0.15 * (len(rows) >= 5) + 0.05 * (len(rows) >= 10)
        best = max(best, min(1.0, score))
    return best


@F.pandas_udf(T.DoubleType())
def score_json(bodies: pd.Series) -> pd.Series:
    """How like a list of products each JSON text is, from 0 to 1."""

    def one(text: str | None) -> float:
        try:
            return round(_likeness(json.loads(text or "")), 6)
        except (ValueError, RecursionError):
            return 0.0

    return bodies.map(one)


def usable_captures(captures: DataFrame) -> DataFrame:
    """First of each method, URL and beginning of the body, of answers that are fine, look like JSON and aren't short (capture_id, method, url, request_body, status, content_type, body)."""
    fine = F.col("status").between(200, 299) & (F.length("body") >= 80)
    looks = F.contains(F.coalesce("content_type", F.lit("")), F.lit("json")) | F.col("url").rlike(r"(?i)/(search|catalog|products|api|graphql)\b")
    rows = captures.filter(fine & looks).withColumn("head", F.substring(F.coalesce("request_body", F.lit("")), 1, 128))
    return rows.withColumn("rn", ranked(["method", "url", "head"], F.col("capture_id"))).filter("rn = 1").drop("rn", "head")


def capture_for_recipe(recipes: DataFrame, captures: DataFrame) -> DataFrame:
    """Of each recipe (session, base_url) the capture of its session (session, capture_id, url, score) with the best score whose path is or begins its own, or the other way round, else the best of all."""
    bare = lambda c: F.regexp_extract(c, r"^[^?]*", 0)
    both = recipes.join(captures, "session")
    match = (bare(F.col("url")) == bare(F.col("base_url"))) | F.startswith(F.col("url"), bare(F.col("base_url"))) | F.startswith(F.col("base_url"), bare(F.col("url")))
    best = both.groupBy("session", "base_url").agg(F.max_by(F.struct("capture_id", match.alias("match")), F.struct(match, "score", -F.col("capture_id"))).alias("c"))
    return best.select("session", "base_url", "c.capture_id", "c.match")


def merge_headers(rows: DataFrame) -> DataFrame:
    """``rows`` (own, captured: maps) with merged and changed: captured headers over the own ones, but secrets and empty values."""
    new = F.map_filter("captured", lambda k, v: ~F.lower(k).rlike("^(authorization|set-cookie|content-length)$") & F.coalesce(v != "", F.lit(False)))
    differ = F.map_filter(new, lambda k, v: ~F.coalesce(F.try_element_at("own", k) == v, F.lit(False)))
    merged = F.map_concat(F.map_filter("own", lambda k, v: ~F.map_contains_key(new, k)), new)
    return rows.withColumn("merged", merged).withColumn("changed", F.size(differ) > 0)


# Paths of flat .html pages that are no products.
HTML_CATEGORY = r"/(brands|sale|apparel|gear|men|women|kids|accessories|nutrition|clearance|store-locator|our-story|rr)/"
HTML_OTHER = r"/(c/|category|catalogsearch|checkout|customer|cart|account)/"


def html_product_evidence(urls: DataFrame, least: int = 5, most: int = 10, per_block: int = 100_000) -> DataFrame:
    """site, url: an even spread of at most ``most`` of a site's flat .html URLs (site, url) that look like products, where there are ``least``."""
    path = F.lower(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    leaf = F.element_at(segments, -1)
    good = path.rlike(r"\.html?$") & ~path.rlike(HTML_CATEGORY) & ~path.rlike(HTML_OTHER) & F.size(segments).between(2, 4) & (F.length(leaf) >= 12) & ~leaf.rlike(r"^(brands|sale|index)\.html$")
    rows = urls.filter(good).select("site", "url").distinct()
    rows = numbered(rows, ["site"], [F.col("url")], "i", "n", per_block).filter(F.col("n") >= least)
    k = F.expr(f"(i * {most} + n - 1) div n")
    return rows.withColumn("k", k).filter((F.col("n") <= most) | (F.expr(f"(k * n) div {most}") == F.col("i"))).select("site", "url")


def best_candidates(urls: DataFrame, least: int = 3, most: int = 10, per_block: int = 100_000) -> DataFrame:
    """site, url: the best URL of each product of a site (site, url, sitemap), an even spread of at most ``most``; a product is told by an id of six digits, else by its last segment."""
    # Fixed value: paths of products.
    product = F.col("url").rlike(r"(?i)/(?:p-|p/|pdp/|products?/|ip/|item/|sku/)")
    score = product_url_score(F.col("url"), F.col("sitemap"))
    known = (F.coalesce("sitemap", F.lit("")) == "") | F.col("sitemap").rlike("(?i)product") | F.contains(F.col("url"), F.lit("/cat/")) | (score >= 10)
    leaf = F.lower(F.regexp_extract("url", r"^https?://[^/?#]+[^?#]*?([^/?#]*)/?(?:[?#].*)?$", 1))
    number = F.regexp_extract(leaf, r"([0-9]{6,}[a-z]?)(?:\.html?)?$", 1)
    key = F.coalesce(F.nullif(number, F.lit("")), F.nullif(leaf, F.lit("")), F.col("url"))
    rows = urls.filter(product & known).select("site", "url", key.alias("key"), score.alias("score"))
    best = spread(rows, tasks_for(urls), "site", "key").groupBy("site", "key").agg(F.max_by(F.struct("url", "score"), F.struct("score", "url")).alias("b")).select("site", "b.url", "b.score")
    rows = numbered(best, ["site"], [F.col("score").desc(), F.col("url")], "i", "n", per_block).filter(F.col("n") >= least)
    k = F.expr(f"(i * {most} + n - 1) div n")
    return rows.withColumn("k", k).filter((F.col("n") <= most) | (F.expr(f"(k * n) div {most}") == F.col("i"))).select("site", "url", "score")


# Tokens of product paths, in order of preference.
PRIORS = ["products", "product", "prod", "pd", "dp", "ip", "item", "items", "shop", "buy", "detail", "pdp", "sku", "p"]


def derive_product_pattern(urls: DataFrame) -> DataFrame:
    """site, pattern from confirmed product URLs (site, url): what they share, by a fixed order of rules.

    The longest common beginning, if it is specific; the one after a category segment; slugs that begin with p-; a known token of the
    majority; any common beginning; any segment of the majority. Segments are counted by site and place, so a site is never one list.
    """
    path = F.lower(F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    drop = (F.size(segments) > 1) & F.get(segments, F.lit(0)).rlike("^[a-z]{2}([-_][a-z]{2})?$")
    rows = written(urls.select("site", F.when(drop, F.slice(segments, 2, 1000)).otherwise(segments).alias("s")), "paths")
    tasks = max(tasks_for(urls), tasks_for(rows))
    totals = rows.groupBy("site").agg(F.count("*").alias("n"), F.min(F.size("s")).alias("least"), F.max(F.size("s")).alias("most"), F.count_if(F.array_contains("s", "cat")).alias("cats"), F.count_if(F.exists("s", lambda x: x.startswith("p-"))).alias("slugs"))
    totals = written(totals, "totals")

    def common(parts: DataFrame, number: str, name: str) -> DataFrame:
        """The beginning that all of ``number`` lists of a site share, as far as every place has one value."""
        # Least and greatest texts are found by sorting; dealt out first, a task's rows are few whatever files they are read from.
        at = spread(parts, tasks, "site", "s").select("site", F.posexplode("s").alias("i", "x")).groupBy("site", "i").agg(F.count("*").alias("k"), F.min("x").alias("x"), F.max("x").alias("y")).filter(F.col("x") == F.col("y"))
        good = at.join(totals.select("site", number), "site").filter(F.col("k") == F.col(number)).groupBy("site").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("all"))
        run = F.filter("all", lambda e, j: e["i"] == j)
        return good.select("site", F.transform(run, lambda e: e["x"]).alias(name))

    whole = common(rows, "n", "prefix")
    at = F.greatest(F.lit(1), F.array_position("s", "cat").cast("int"))
    nested = rows.filter(F.array_contains("s", "cat")).select("site", F.slice("s", at, F.greatest(F.lit(0), F.least(F.lit(2), F.size("s") - at))).alias("s"))
    nested_sizes = nested.groupBy("site").agg(F.min(F.size("s")).alias("c_least"), F.max(F.size("s")).alias("c_most"))
    under = common(nested, "cats", "cat_prefix")
    # A segment found once is of the majority only where a site has at most two URLs, so the many that are found once meet no other site's total.
    found = spread(rows.select("site", F.explode(F.array_distinct("s")).alias("x")), tasks, "site", "x").groupBy("site", "x").agg(F.count("*").alias("k"))
    few = rows.join(totals.filter("n <= 2").select("site"), "site", "left_semi").select("site", F.explode(F.array_distinct("s")).alias("x")).groupBy("site", "x").agg(F.count("*").alias("k")).filter("k = 1")
    counts = found.filter("k > 1").unionByName(few).join(totals.select("site", "n"), "site").filter(F.col("k") >= F.ceil(F.col("n") / 2))
    prior = F.array_position(F.array(*map(F.lit, PRIORS)), F.col("x"))
    tokens = counts.filter(prior > 0).groupBy("site").agg(F.max_by("x", F.struct("k", -prior)).alias("token"))
    shared = counts.filter(F.length("x") >= 2).groupBy("site").agg(F.max_by("x", F.struct("k", "x")).alias("segment"))
    all_ = totals.join(whole, "site", "left").join(under, "site", "left").join(nested_sizes, "site", "left").join(tokens, "site", "left").join(shared, "site", "left")
    none = F.array().cast("array<string>")
    # A beginning that is a whole path isn't one.
    cut = lambda p, least: F.when(F.size(p) >= least, F.slice(p, 1, F.greatest(least - 1, F.lit(0)))).otherwise(p)
    prefix = F.coalesce(cut(F.col("prefix"), F.col("least")), none)
    all_ = all_.withColumn("p", prefix).withColumn("c", F.coalesce(cut(F.col("cat_prefix"), F.col("c_least")), none))
    majority = F.ceil(F.col("n") / 2)
    joined = lambda p: F.concat(F.lit("/"), F.array_join(p, "/"), F.lit("/"))
    specific = (F.size("p") >= 2) | ((F.size("p") == 1) & (F.length(F.get("p", F.lit(0))) >= 4))
    pattern = F.when(specific, joined("p")).when(F.col("cats") >= majority, F.when(F.size("c") > 0, joined("c")).otherwise("/cat/")).when(F.col("slugs") >= majority, "/p-/")
    pattern = pattern.when(F.col("token").isNotNull(), F.concat(F.lit("/"), "token", F.lit("/"))).when(F.size("p") > 0, joined("p")).when(F.col("segment").isNotNull(), F.concat(F.lit("/"), "segment", F.lit("/")))
    return all_.select("site", pattern.alias("pattern"))


def page_urls(listings: DataFrame) -> DataFrame:
    """id, page, url of paginated listings (id, url, style, param, template, start, pages): none, link_rel, query_param, path_segment, page, offset, cursor."""
    many = F.col("style").isin("query_param", "path_segment", "page", "offset")
    last = F.when(many, F.col("start") + F.col("pages") - 1).otherwise(F.col("start"))
    rows = listings.filter(~many | (F.col("pages") > 0)).withColumn("page", F.explode(F.sequence(F.col("start"), last)))
    value = F.when(F.col("style") == "offset", (F.col("page") - 1) * F.coalesce("per_page", F.lit(24))).otherwise(F.col("page")).cast("string")
    bare = F.regexp_replace("url", "#.*$", "")
    key = F.concat(F.col("param"), F.lit("="))
    there = F.regexp_replace(bare, F.concat(F.lit("([?&])"), key, F.lit("[^&]*")), F.concat(F.lit("$1"), key, value))
    put = F.when(F.rlike(bare, F.concat(F.lit("[?&]"), key)), there).otherwise(F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), key, value))
    segment = F.replace(F.col("template"), F.lit("{n}"), F.col("page").cast("string"))
    path = F.when(F.col("page") == F.col("start"), F.col("url")).otherwise(F.concat(F.regexp_replace("url", "/$", ""), F.when(F.startswith(segment, F.lit("/")), "").otherwise("/"), segment))
    url = F.when(F.col("style").isin("query_param", "page", "offset") & F.col("param").isNotNull(), put).when((F.col("style") == "path_segment") & F.col("template").isNotNull(), path).otherwise(F.col("url"))
    return rows.select("id", "page", url.alias("url"))


def hosts(pages: DataFrame) -> DataFrame:
    return pages.select("*", normalize_domain(F.col("url")).alias("site"))
