"""Products out of pages: embedded state, social tags, API records, layered merge, listing pages; and what kind of page it is."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlens.functions.shared import once
from martlens.functions.urls import host_of, normal_url, resolve_reference
from martlens.operators.ingest import AVAILABILITY, recipe_availability
from martlens.operators.pages import jsonld_products


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def resolve(href: Column, base: Column) -> Column:
    """The absolute URL, normalised, of a link on the site of ``base``; a path without a leading slash starts at the site's root."""
    return normal_url(resolve_reference(href, F.concat(origin_of(base), F.lit("/"))))


def _path(dotted: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split("."))


def _pick(value: str, paths: list[str]) -> Column:
    """The first of the paths with a value that isn't empty, as text."""
    return F.coalesce(*[F.nullif(F.try_variant_get(value, _path(p), "string"), F.lit("")) for p in paths], F.lit(None).cast("string"))


def _number(text: Column) -> Column:
    n = F.trim(text).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def next_data_products(pages: DataFrame, price_paths: list[str] | None = None, image_paths: list[str] | None = None) -> DataFrame:
    """Products of the state that a page embeds as __NEXT_DATA__ (page_id, url, html); the paths are a site's hints, tried first."""
    block = F.regexp_extract("html", r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    rows = pages.select("page_id", "url", F.try_variant_get(F.try_parse_json(block), "$.props.pageProps", "variant").alias("props"))
    rows = rows.withColumn("product", F.coalesce(F.try_variant_get("props", "$.product", "variant"), F.try_variant_get("props", "$.productData", "variant")))
    rows = rows.filter(F.schema_of_variant(F.try_variant_get("product", "$.name", "variant")) == "STRING")
    hints = image_paths or []
    image = F.coalesce(_pick("product", hints), _pick("props", hints), _pick("product", ["images.0.urlOriginal", "images.0.url_standard", "images.0.url"]))
    guest = [f"customerGroupPrices.guest.price.{p}" for p in ("lowPrice.value", "price.value")]
    price = F.coalesce(_pick("product", price_paths or []), _pick("props", guest), _pick("product", ["price.value"]), _pick("product", ["price"]))
    crumbs = F.transform(F.try_variant_get("product", "$.breadcrumbs", "array<variant>"), lambda b: F.coalesce(F.try_variant_get(b, "$.name", "string"), F.try_variant_get(b, "$.label", "string")))
    brand = F.try_variant_get("product", "$.brand", "variant")
    return rows.select(
        "page_id", F.try_variant_get("product", "$.name", "string").alias("title"), F.when(F.schema_of_variant(brand) == "STRING", F.try_variant_get("product", "$.brand", "string")).otherwise(_pick("product", ["brand.name"])).alias("brand"),
        F.coalesce(_pick("product", ["code"]), _pick("props", ["productCode"])).alias("sku"), F.coalesce(_pick("product", ["shortDescription"]), _pick("product", ["description"])).alias("description"),
        F.coalesce(F.array_join(F.filter(crumbs, lambda c: c != ""), "/"), F.lit("")).alias("category"), _number(price).alias("price"), recipe_availability(_pick("product", ["availabilityStatus"])).alias("availability"), resolve(image, F.col("url")).alias("image"),
    )


def og_products(pages: DataFrame) -> DataFrame:
    """A minimal row from social tags: only pages with an absolute og:image; the title falls back to the URL."""
    tag = lambda name: F.nullif(F.trim(F.regexp_extract("html", f'(?i)property="og:{name}" content="([^"]+)"', 1)), F.lit(""))
    return pages.select("page_id", F.coalesce(tag("title"), "url").alias("title"), tag("image").alias("image")).filter(F.col("image").startswith("http"))


FIELDS = ["title", "brand", "price", "image"]


def _merged(first: Column, second: Column) -> Column:
    """``first`` with what it lacks from ``second``; a map keeps its own values where both have a key."""
    fields = [F.coalesce(first[c], second[c]).alias(c) for c in FIELDS]
    category = F.when(F.size(first["category"]) > 0, first["category"]).otherwise(F.coalesce(second["category"], first["category"])).alias("category")
    more = F.map_filter(second["attributes"], lambda k, v: ~F.coalesce(F.map_contains_key(first["attributes"], k), F.lit(False)))
    attributes = F.coalesce(F.map_concat(more, first["attributes"]), first["attributes"], second["attributes"]).alias("attributes")
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(F.struct(*fields, category, attributes))


def merge_extractions(custom: DataFrame, json_ld: DataFrame, recipe: DataFrame, model: DataFrame) -> DataFrame:
    """Layers (page_id, title, brand, price, image, category, attributes), earlier ones preferred.

    JSON-LD and the model are asked only while the price is missing, the recipe also while the image is. Layers meet in one grouping by
    page. ``model`` is any table of an external extractor.
    """
    row = F.struct(*FIELDS, "category", "attributes")
    layers = [custom, json_ld, recipe, model]
    both = None
    for k, layer in enumerate(layers):
        part = layer.select("page_id", F.lit(k).alias("k"), row.alias("row"))
        both = part if both is None else both.unionByName(part)
    pick = lambda k: F.max_by(F.when(F.col("k") == k, F.col("row")), F.when(F.col("k") == k, 1))
    rows = both.groupBy("page_id").agg(*[pick(k).alias(f"l{k}") for k in range(4)])
    step = lambda df, k, need: df.withColumn("r", F.when(F.col("r").isNull() | need, _merged(F.col("r"), F.col(f"l{k}"))).otherwise(F.col("r")))
    rows = rows.withColumn("r", F.col("l0"))
    rows = step(rows, 1, F.col("r.price").isNull())
    rows = step(rows, 2, F.col("r.price").isNull() | F.col("r.image").isNull())
    rows = step(rows, 3, F.col("r.price").isNull())
    return rows.select("page_id", *[f"r.{c}" for c in (*FIELDS, "category", "attributes")])


# Where the APIs of each platform keep the fields of a product, in order of preference.
PLATFORM_FIELDS = {
    "shopify": {"title": ["title"], "description": ["body_html"], "brand": ["vendor"], "sku": ["variants[0].sku"], "price": ["variants[0].price"], "listPrice": ["variants[0].compare_at_price"], "url": ["handle"], "image": ["images[0].src"]},
    "magento": {"title": ["name"], "description": ["custom_attributes.description"], "brand": ["custom_attributes.manufacturer"], "sku": ["sku"], "price": ["price"], "url": ["custom_attributes.url_key"], "image": ["media_gallery_entries[0].file"]},
    "woocommerce": {"title": ["name"], "description": ["description"], "sku": ["sku"], "price": ["prices.price"], "listPrice": ["prices.regular_price"], "url": ["permalink"], "image": ["images[0].src"]},
    "bigcommerce": {"title": ["name"], "description": ["description"], "brand": ["brand.name"], "sku": ["sku"], "price": ["price.value"], "listPrice": ["retail_price.value"], "url": ["path"], "image": ["default_image.url"]},
    "salesforce": {"title": ["productName", "name", "title"], "url": ["productUrl", "url", "link"], "sku": ["productId", "id", "sku"], "price": ["price.sales.value", "price", "minPrice"], "listPrice": ["price.list.value", "listPrice"], "image": ["image.url", "image", "images[0].url"], "brand": ["brand", "manufacturerName"]},
    "shopify_hydrogen": {"title": ["node.title"], "brand": ["node.vendor"], "sku": ["node.variants.edges[0].node.sku"], "price": ["node.variants.edges[0].node.price.amount"], "url": ["node.handle"], "image": ["node.featuredImage.url"]},
    "commercetools": {"title": ["masterData.current.name.en"], "sku": ["masterData.current.masterVariant.sku"], "price": ["masterData.current.masterVariant.prices[0].value.centAmount"], "url": ["masterData.current.slug.en"], "image": ["masterData.current.masterVariant.images[0].url"]},
}
# Path of the products, style and parameter of pages, and products a page, of each platform's API.
PLATFORM_PAGES = {
    "shopify": ("products", "page", "page", 250), "magento": ("items", "page", "searchCriteria[currentPage]", 20), "woocommerce": ("", "page", "page", 20), "bigcommerce": ("data", "page", "page", 24),
    "salesforce": ("hits", "offset", "start", 24), "shopify_hydrogen": ("data.products.edges", "cursor", "after", 24), "commercetools": ("data.products.results", "offset", "offset", 20),
}


def platform_field_maps(spark) -> DataFrame:
    """(platform, products_path, style, page_param, per_page, fields) of the seven platforms."""
    rows = [(p, *PLATFORM_PAGES[p], fields) for p, fields in PLATFORM_FIELDS.items()]
    return spark.createDataFrame(rows, "platform string, products_path string, style string, page_param string, per_page int, fields map<string,array<string>>")


def map_api_records(bodies: DataFrame, recipes: DataFrame) -> DataFrame:
    """Product rows of API bodies (page_id, platform, body, prefix, label) by the field maps of ``recipes``, a small table.

    Title and URL are required; a relative URL gets the prefix; a list price counts only above the price.
    """
    where = F.when(F.col("products_path") == "", "$").otherwise(F.concat(F.lit("$."), "products_path"))
    rows = bodies.join(F.broadcast(recipes.select("platform", "products_path", "fields")), "platform")
    rows = rows.select("page_id", "platform", "prefix", "label", "fields", F.posexplode(F.from_json(F.call_function("get_json_object", F.col("body"), where), "array<string>")).alias("pos", "record"))

    def field(name: str) -> Column:
        found = F.transform(F.try_element_at("fields", F.lit(name)), lambda p: F.call_function("get_json_object", F.col("record"), F.concat(F.lit("$."), p)))
        return F.get(F.filter(found, lambda x: x.isNotNull() & (x != "")), F.lit(0))

    number = lambda name: F.regexp_extract(F.trim(field(name)), r"^[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", 0).try_cast("double")
    url = F.trim(field("url"))
    full = F.when(url.startswith("http"), url).otherwise(F.concat(F.coalesce("prefix", F.lit("")), F.when(url.startswith("/"), "").otherwise("/"), url))
    out = once(
        rows, "page_id", "platform", "pos", F.trim(field("title")).alias("title"), F.when(url != "", full).alias("url"), field("brand").alias("brand"), field("sku").alias("sku"), number("price").alias("price"), number("listPrice").alias("listed"), field("image").alias("image"), F.coalesce("label", F.lit("")).alias("category")
    )
    return out.filter((F.col("title") != "") & F.col("url").isNotNull()).withColumn("list_price", F.when(F.col("listed") > F.col("price"), F.col("listed"))).drop("listed")


def checked_products(rows: DataFrame) -> DataFrame:
    """Rows (title, url, price, stock_qty, currency, availability) with defaults, and with ``wrong``: what the gate has against each; null-free rows pass."""
    c = F.col
    rows = rows.withColumn("currency", F.coalesce("currency", F.lit("CAD"))).withColumn("availability", F.coalesce("availability", F.lit("unknown")))
    checks = {
        "title": F.coalesce(F.length("title"), F.lit(0)) == 0, "url": ~F.coalesce(c("url").rlike(r"^[a-z][a-z0-9+.-]*://[^/\s]+"), F.lit(False)), "price": F.coalesce(c("price") < 0, F.lit(False)),
        "stock_qty": F.coalesce((c("stock_qty") < 0) | (c("stock_qty") != F.floor("stock_qty")), F.lit(False)), "currency": ~c("currency").isin("CAD", "USD"), "availability": ~c("availability").isin(AVAILABILITY),
    }
    return rows.withColumn("wrong", F.array_compact(F.array(*[F.when(bad, name) for name, bad in checks.items()])))


def gate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that pass, and those kept aside with their reasons."""
    checked = checked_products(rows)
    return checked.filter(F.size("wrong") == 0).drop("wrong"), checked.filter(F.size("wrong") > 0)


def _priced(node: object, depth: int = 0) -> bool:
    """Is there a price in the node, its offers or variants?"""
    if depth > 6 or not isinstance(node, dict | list):
        return False
    if isinstance(node, list):
        return any(_priced(n, depth + 1) for n in node)
    for key in ("price", "lowPrice", "highPrice"):
        v = node.get(key)
        if isinstance(v, int | float) and not isinstance(v, bool) or isinstance(v, str) and v.strip():
            return True
    return any(_priced(node[k], depth + 1) for k in ("offers", "hasVariant", "aggregateOffer", "aggregateOffers") if k in node)


def _sells(node: object, depth: int = 0) -> bool:
    """Is the node, or one in its list or @graph, a product with a price?"""
    if depth > 7 or not isinstance(node, dict | list):
        return False
    if isinstance(node, list):
        return any(_sells(n, depth + 1) for n in node)
    kinds = node.get("@type")
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if any(isinstance(k, str) and re.fullmatch("(?i)Product(Group|Model)?", k) for k in kinds) and _priced(node):
        return True
    return _sells(node.get("@graph"), depth + 1)


@F.pandas_udf(T.BooleanType())
def _any_sells(blocks: pd.Series) -> pd.Series:
    def one(texts) -> bool:
        for t in texts if texts is not None else ():
            try:
                if _sells(json.loads(t)):
                    return True
            except ValueError:
                pass
        return False

    return blocks.map(one)


def classify_product_pages(pages: DataFrame) -> DataFrame:
    """page_id and whether the page shows one product that can be bought: a priced product in JSON-LD, or a product's social tags with a price."""
    blocks = F.regexp_extract_all("html", F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    social = F.col("html").rlike(r'(?i)property="og:type"\s+content="[^"]*product') & F.col("html").rlike('(?i)property="(product|og):price:amount"')
    return pages.select("page_id", (F.coalesce(_any_sells(blocks), F.lit(False)) | F.coalesce(social, F.lit(False))).alias("product_page"))


class _Cards(HTMLParser):
    """Links of a page with their text, and the text and first image of the nearest card around each; breadcrumb names."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict]] = []
        self.links: list[dict] = []
        self.crumbs: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        kind = a.get("class", "")
        node = {"text": [], "image": None, "card": tag in ("article", "li") or tag == "div" and ("product" in kind or "item" in kind), "link": tag == "a" and "href" in a, "href": a.get("href", "").strip(), "around": None, "crumb": False}
        near = [n for _, n in self.open]
        if tag == "img":
            src = a.get("src") or a.get("data-src")
            for n in near:
                n["image"] = n["image"] or src
            return
        if node["link"]:
            node["around"] = next((n for n in reversed(near) if n["card"]), None)
            self.links.append(node)
        kinds = lambda n: n.get("kinds", ())
        inside = any("breadcrumbs" in kinds(n) or n.get("nav") and "breadcrumb" in kinds(n) for n in near)
        listed = any("BreadcrumbList" in n.get("itemtype", "") for n in near)
        node |= {"kinds": kind.split(), "nav": tag == "nav", "itemtype": a.get("itemtype", ""), "crumb": tag == "a" and inside or a.get("itemprop") == "name" and listed}
        if tag not in ("br", "hr", "meta", "link", "input", "source"):
            self.open.append((tag, node))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                for _, n in self.open[k:]:
                    if n["crumb"]:
                        self.crumbs.append("".join(n["text"]).strip())
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if not any(t in ("script", "style") for t, _ in self.open):
            for _, n in self.open:
                n["text"].append(data)


# Prices in a card's text, and the words before a former price, on HTML and on markdown pages.
PRICE = re.compile(r"(?:NOW)?(?:CA\$|CAD|\$)\s*([\d,]+(?:\.\d{2})?)|([\d,]+(?:\.\d{2})?)\s*(?:CA\$|CAD|\$)", re.I)
WAS_HTML = re.compile(r"(?:was|list|regular)\s*(?:CA\$|CAD|\$)?\s*([\d,]+(?:\.\d{2})?)", re.I)
WAS_MARKDOWN = re.compile(r"price\s+was\s+(?:CA\$|CAD|\$)?\s*([\d,]+(?:\.\d{2})?)", re.I)
SALE = re.compile(r"(?:NOW)?\$([\d,]+\.\d{2})\s+price\s+was", re.I)
SAVED = re.compile(r"Save\s+\d+%\s*\([^)]*\)", re.I)


def _amount(text: str | None) -> float | None:
    try:
        return float((text or "").replace(",", ""))
    except ValueError:
        return None


def _amounts(text: str) -> list[float]:
    return [v for m in PRICE.finditer(text) if (v := _amount(m[1] or m[2])) is not None]


CARD = "page_id long, url string, title string, price double, list_price double, image string"


def _absolute(href: str, origin: str) -> str:
    return href if re.match("(?i)https?://", href) else origin + ("" if href.startswith("/") else "/") + href


def _html_cards(html: str, pattern: str, origin: str, domain: str) -> Iterator[tuple]:
    parser, seen = _Cards(), set()
    parser.feed(html)
    parser.close()
    for link in parser.links:
        url = _absolute(link["href"], origin)
        key = url.split("?")[0]
        if not link["href"] or domain not in url or not re.search(pattern, url) or key in seen:
            continue
        seen.add(key)
        around = link["around"]
        title = " ".join("".join(link["text"]).split())
        text = "".join(around["text"]) if around else title
        leaf = re.sub(r"\.\w+$", "", re.sub("[-_]+", " ", [*filter(None, re.sub(r"^https?://[^/]+|[?#].*$", "", url).split("/")), ""][-2 if url.count("/") > 2 else -1])).strip()
        was = WAS_HTML.search(text)
        image = around["image"] if around else None
        if title or leaf:
            yield url, title or leaf, next(iter(_amounts(text)), None), _amount(was[1]) if was else None, _absolute(image, origin) if image else None


def _links(text: str) -> Iterator[tuple[int, str, str]]:
    """(start, text, target) of every markdown link, brackets balanced, inner links before the ones around them."""
    starts = []
    for m in re.finditer(r"\[|\](?:\(([^()\s]*)\))?", text):
        if m[0] == "[":
            starts.append(m.start())
        elif starts:
            start = starts.pop()
            if m[1] is not None and text[start - 1 : start] != "!":
                yield start, text[start + 1 : m.start()], m[1]


def _title(link: str, lines: list[str], url: str) -> str | None:
    head = re.sub(r"\s*\*\s*$", "", link.split("![")[0].strip()).strip()
    if 3 <= len(head) < 200 and not head.startswith("$") and not head.upper().startswith("NOW"):
        return head
    if 2 <= len(link) < 200 and not link.startswith("![") and link.lower() not in ("view", "shop", "buy", "see"):
        return link
    for line in lines:
        if m := re.match(r"#{1,4}\s+(.+)", line):
            return m[1].strip()
    m = re.search("(?i)/pdp/([^/?#]+)", url)
    words = [w for w in re.sub("(?i)-[a-f0-9]{6,}[a-z]?$", "", m[1]).split("-") if w and not w.isdigit()] if m else []
    return " ".join(w[0].upper() + w[1:] for w in words) if len(words) > 1 else None


def _markdown_cards(body: str, pattern: str, origin: str, domain: str) -> Iterator[tuple]:
    root, best = ".".join(domain.split(".")[-2:]), {}
    for start, text, target in _links(body):
        host = re.match("https?://([^/?#]+)", target)
        if not (root in host[1] if host else target.startswith("/")):
            continue
        url = (target if host else origin + target).split("#")[0]
        key = url.split("?")[0]
        if re.search(pattern, url) and (key not in best or "![" in text and len(text.strip()) > len(best[key][1])):
            best[key] = (body.count("\n", 0, start), text.strip(), url)
    hits, lines = sorted(best.values(), key=lambda h: h[0]), body.split("\n")
    for k, (at, link, url) in enumerate(hits):
        near = lines[max(0, at - 2) : hits[k + 1][0] if k + 1 < len(hits) else len(lines)]
        text = link if "![" in link and re.search(r"\$\d", link) else "\n".join(near)
        title = _title(link, near, url)
        if not title:
            continue
        sale, values = SALE.search(text), [v for v in _amounts(SAVED.sub("", text)) if v > 1]
        price = _amount(sale[1]) if sale and (_amount(sale[1]) or 0) > 1 else min(values, default=None)
        was = WAS_MARKDOWN.search(text)
        listed = _amount(was[1]) if was else None
        if listed is None or price is not None and listed <= price:
            every = [v for v in _amounts(text) if v > 1]
            listed = max(every) if len(every) > 1 and price is not None and max(every) > price else None
        image = next((u for u in re.findall(r"!\[[^\]]*\]\(([^)\s]+)\)", text) if u.startswith("http") and not re.search(r"(?i)\.svg(\?|$)", u)), None)
        yield url, title, price, listed, image


def _cards(pages: DataFrame, column: str, find) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CARD.split(", ")]
        for frame in frames:
            rows = [(r.page_id, *card) for r in frame.itertuples() if r.body for card in find(r.body, r.pattern, r.origin, r.domain)]
            yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", F.col(column).alias("body"), "pattern", "origin", "domain").mapInPandas(run, CARD)


def extract_listing_html(pages: DataFrame) -> DataFrame:
    """CARD rows of category pages (page_id, html, pattern, origin, domain): links that match the product pattern, each once but for its query."""
    return _cards(pages, "html", _html_cards)


def extract_listing_markdown(pages: DataFrame) -> DataFrame:
    """CARD rows of category pages as markdown (page_id, markdown, pattern, origin, domain), nested cards too."""
    return _cards(pages, "markdown", _markdown_cards)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _breadcrumbs(html: pd.Series) -> pd.Series:
    def one(text) -> list[str]:
        parser = _Cards()
        parser.feed(text or "")
        return list(dict.fromkeys(filter(None, parser.crumbs)))

    return html.map(one)


def full_products(pages: DataFrame) -> DataFrame:
    """The JSON-LD products of pages (page_id, html) with their breadcrumbs as category path, by page_id, which is unique."""
    return jsonld_products(pages).join(extract_breadcrumbs(pages).withColumnRenamed("names", "category"), "page_id")


def extract_breadcrumbs(pages: DataFrame) -> DataFrame:
    """page_id and the distinct names of the page's breadcrumbs, in order."""
    return pages.select("page_id", _breadcrumbs("html").alias("names"))


def next_page_links(pages: DataFrame) -> DataFrame:
    """page_id, next of listing pages (page_id, url, html): a link marked next, else the page parameter of the URL plus one."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:a|link)\b[^>]*>"), F.lit(0))
    href = lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']([^"']+)["']""", 1)
    first = lambda mark: F.get(F.filter(F.transform(F.filter(tags, lambda t: t.rlike(mark)), href), lambda h: h != ""), F.lit(0))
    marks = [r"""(?i)\brel\s*=\s*["']next["']""", r"""(?i)^<a\b[^>]*class\s*=\s*["'](?:[^"']*\s)?next(?:\s[^"']*)?["']""", r"""(?i)^<a\b[^>]*aria-label\s*=\s*["'][^"']*next""", r"""(?i)^<a\b[^>]*class\s*=\s*["'](?:[^"']*\s)?pagination-next(?:\s[^"']*)?["']"""]
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    links = [resolve(first(m), F.col("url")) for m in marks]
    found = F.coalesce(*[F.when(F.contains(x, host) & (x != F.col("url")), x) for x in links])
    number = F.regexp_extract("url", r"[?&](?:page|p|pg|pagenumber)=(\d+)", 1)
    head = F.regexp_extract("url", r"^(.*?[?&](?:page|p|pg|pagenumber)=)\d+", 1)
    rest = F.regexp_extract("url", r"[?&](?:page|p|pg|pagenumber)=\d+(.*)$", 1)
    counted = F.when(number != "", F.concat(head, (number.try_cast("long") + 1).cast("string"), rest))
    return pages.select("page_id", F.coalesce(found, counted).alias("next"))


def resolved_links(pages: DataFrame) -> DataFrame:
    """(page_id, link): links to the page's own host, resolved, without fragments, and product paths in its scripts.

    An href may stand in quotes of either kind or in none, its name and scheme in any case.
    """
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<a\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), F.lit(0))
    value = lambda t: F.concat(*[F.regexp_extract(t, r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", k) for k in (1, 2, 3)])
    hrefs = F.filter(F.transform(tags, value), lambda h: (h != "") & ~h.startswith("#") & ~h.rlike("(?i)^(mailto|tel|javascript):"))
    # Fixed value: product paths that stand in scripts.
    paths = F.regexp_extract_all("html", F.lit(r"(?i)/(?:[a-z]{2}-[A-Z]{2}/)?p-[a-z0-9][\w-]*(?:/\d+)+"), F.lit(0))
    links = F.transform(F.concat(hrefs, paths), lambda h: F.regexp_replace(resolve(h, F.col("url")), "#.*$", ""))
    every = pages.select("page_id", host_of(normal_url(F.col("url"))).alias("host"), F.explode(F.array_distinct(links)).alias("link"))
    return every.filter(host_of(F.col("link")) == F.col("host")).select("page_id", "link").distinct()
