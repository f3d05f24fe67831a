"""Links in markdown with what stands around them: next pages of listings, and path patterns that a manifest suggests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.functions.urls import let
from martlens.operators.extract import resolve
from martlens.operators.mining import MEDIA, PRODUCT_TOKENS
from martlens.operators.paths import with_param

# What the label of a link to the next page holds, what may stand behind such a link, and parameters that count pages.
NEXT_LABEL, NEXT_BEHIND, PAGE_PARAMS = r"(?i)next|suivant|→|»|>", r"(?i)^\s*(?:next|→|»)", ["page", "p", "pg", "pagenumber"]


def links_in(text: Column) -> Column:
    """Array of (label, href, behind) of the links of a markdown text in order; behind: up to 32 characters that follow."""
    whole = F.regexp_extract_all(text, F.lit(r"(?s)\[[^\]]*\]\([^)]+\)(?=(.{0,32}))"), F.lit(0))
    behind = F.regexp_extract_all(text, F.lit(r"(?s)\[[^\]]*\]\([^)]+\)(?=(.{0,32}))"), F.lit(1))
    label = lambda w: F.regexp_extract(w, r"(?s)^\[([^\]]*)\]", 1)
    return F.transform(F.arrays_zip(whole.alias("w"), behind.alias("b")), lambda x: F.struct(label(x["w"]).alias("label"), F.regexp_extract(x["w"], r"(?s)^\[[^\]]*\]\(([^)]+)\)", 1).alias("href"), x["b"].alias("behind")))


def next_pages(pages: DataFrame) -> DataFrame:
    """page_id, next of listings in markdown (page_id, url, domain, markdown).

    In order: the first link whose label speaks of a next page, the first with such a word behind it, the first whose label is a number; each only if it leads to another page of the domain.
    Else the URL with its page parameter counted up, else null.
    """
    first = lambda test: F.get(F.filter("links", test), F.lit(0))["href"]
    tests = [lambda x: x["label"].rlike(NEXT_LABEL), lambda x: x["behind"].rlike(NEXT_BEHIND), lambda x: x["label"].rlike(r"^\d+$")]
    rows = pages.withColumn("links", links_in(F.col("markdown")))
    to = F.transform(F.array(*[first(t) for t in tests]), lambda h: resolve(h, F.col("url")))
    good = F.get(F.filter(to, lambda u: (u != F.col("url")) & F.contains(u, F.col("domain"))), F.lit(0))
    value = lambda name: F.regexp_extract("url", rf"[?&]{name}=([^&#]*)", 1)
    name = F.coalesce(*[F.when(F.col("url").rlike(rf"[?&]{p}="), p) for p in PAGE_PARAMS])
    number = F.regexp_extract(F.coalesce(*[F.when(name == p, value(p)) for p in PAGE_PARAMS]), r"^\s*(-?\d+)", 1).try_cast("long")
    counted = F.when(name.isNotNull() & number.isNotNull(), with_param(F.col("url"), name, (number + 1).cast("string")))
    return rows.select("page_id", F.coalesce(good, counted).alias("next"))


def path_pattern(url: Column) -> Column:
    """What the pages of a URL's kind have in common: a known segment, or the first two segments if they hold a product token and no long number; null where nothing tells."""
    tokens = F.array(*[F.lit(t) for t in PRODUCT_TOKENS])

    def of_parts(parts: Column, low: Column) -> Column:
        anchor = F.concat_ws("/", F.slice(parts, 1, 2))
        token = F.exists(tokens, lambda t: F.contains(anchor, F.concat(t, F.lit("/"))) | F.endswith(anchor, F.concat(F.lit("/"), t)) | F.array_contains(parts, t))
        own = F.get(F.filter(parts, lambda p: p.isin(PRODUCT_TOKENS)), F.lit(0))
        general = F.when((F.length(anchor) > 24) | anchor.rlike(r"\d{5,}") | ~token, F.when(own.isNotNull(), F.concat(F.lit("/"), own, F.lit("/")))).otherwise(F.concat(F.lit("/"), anchor, F.lit("/")))
        return F.when(low.contains("/cat/"), "/cat/").when(low.contains("/pdp/"), F.when(F.size(parts) > 3, "/pdp/")).when(low.rlike("/p-[^/]+"), "/p-/").when(F.size(parts) >= 2, general)

    return let(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1), lambda path: let(F.filter(F.split(path, "/"), lambda p: p != ""), lambda parts: of_parts(parts, F.lower(path))))


def manifest_patterns(texts: DataFrame) -> DataFrame:
    """site, product_patterns, listing_patterns of manifests (site, origin, text), each once in the order of their first sight.

    Product patterns are paths in the text with a product token, of 40 characters at most; paths that stand behind a word for product pages, without placeholders; and what the URLs of product pages have in common.
    """
    direct = F.transform(F.regexp_extract_all("text", F.lit(r"https?://[^\s)\]>\"']+"), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;]+$", ""))
    linked = F.transform(F.regexp_extract_all("text", F.lit(r"\]\(([^)]+)\)"), F.lit(1)), lambda h: resolve(h, F.col("origin")))
    urls = F.filter(F.array_distinct(F.concat(direct, linked)), lambda u: u.startswith("http"))
    path = lambda u: F.lower(F.regexp_extract(u, r"^https?://[^/?#]+([^?#]*)", 1))
    token = f"/({'|'.join(PRODUCT_TOKENS)})/"
    product = lambda u: ~path(u).rlike(MEDIA) & (path(u).rlike("/p-[^/]+") | path(u).rlike(token)) & ~u.rlike(r"(?i)sitemap|\.xml(?:\.gz)?(?:\?|$)")
    spoken = F.filter(F.regexp_extract_all("text", F.lit(r"(?i)/[a-z0-9_*-]+(?:/[a-z0-9_*-]+)+/?"), F.lit(0)), lambda p: F.lower(p).rlike(token))
    named = F.regexp_extract_all("text", F.lit(r"(?i)(?:product|pdp|detail)[^\n]*?(/[\w/{}\[\]-]+)"), F.lit(1))
    rows = texts.select("site", urls.alias("urls"), F.transform(spoken, lambda p: F.substring(p, 1, 40)).alias("spoken"), F.transform(named, lambda p: F.regexp_replace(p, r"\{[^}]+\}", "")).alias("named"))
    once = lambda a: F.array_distinct(F.filter(a, lambda p: p.isNotNull() & (p != "")))
    patterns = lambda test: F.transform(F.filter("urls", test), path_pattern)
    listing = lambda u: u.rlike(r"(?i)/(collections?|categories|shop|browse)/")
    return rows.select("site", once(F.concat("spoken", "named", patterns(product))).alias("product_patterns"), once(patterns(listing)).alias("listing_patterns"))
