"""Fields at paths that a table names: embedded state, API bodies, probes and pages of an API, each row of JSON read once as a variant.

A path is dotted, with indexes in brackets (``images[0].url``); an empty one is the whole. Paths of a field are tried in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.functions.shared import once
from martlens.functions.urls import let, resolve_reference
from martlens.operators.ingest import recipe_availability


def path_of(dotted: Column) -> Column:
    return F.when(dotted == "", "$").otherwise(F.concat(F.lit("$."), dotted))


def _at(value: Column, dotted: Column, kind: str) -> Column:
    return F.call_function("try_variant_get", value, path_of(dotted), F.lit(kind))


def text_at(value: Column, paths: Column) -> Column:
    """The first of the paths that has a string, number or boolean that isn't empty, as text."""

    def one(path: Column) -> Column:
        kind = lambda v: F.schema_of_variant(v)
        return let(_at(value, path, "variant"), lambda v: F.when(~kind(v).startswith("OBJECT") & ~kind(v).startswith("ARRAY") & (kind(v) != "VOID"), v.cast("string")))

    return F.get(F.filter(F.transform(paths, one), lambda t: t.isNotNull() & (t != "")), F.lit(0))


def number_at(value: Column, paths: Column) -> Column:
    """The first of the paths that has a value, as a finite number; a text may hold more behind it."""
    return let(F.regexp_extract(F.trim(text_at(value, paths)), r"^[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", 0).try_cast("double"), lambda n: F.when(F.abs(n) < float("inf"), n))


def records_at(value: Column, dotted: Column) -> Column:
    """The objects of the array at a path; none if there is no array."""
    items = F.coalesce(_at(value, dotted, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(items, lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))


def _paths(fields: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(fields, F.lit(name)), F.array().cast("array<string>"))


PRODUCT = ["title", "brand", "sku", "description", "price", "list_price", "image", "url", "availability"]


def product_at(value: Column, fields: Column) -> Column:
    """Struct of PRODUCT from an object by ``fields`` (map of a name to its paths). A list price counts only above the price."""
    text = lambda name: text_at(value, _paths(fields, name))
    prices = let(F.struct(number_at(value, _paths(fields, "price")).alias("p"), number_at(value, _paths(fields, "list_price")).alias("l")), lambda x: F.struct(x["p"].alias("price"), F.when(x["l"] > x["p"], x["l"]).alias("list_price")))
    image = F.get(F.filter(F.transform(_paths(fields, "image"), lambda p: text_at(value, F.array(p))), lambda t: t.startswith("http")), F.lit(0))
    return let(
        prices,
        lambda x: F.struct(
            *[text(c).alias(c) for c in ("title", "brand", "sku", "description")], x["price"].alias("price"), x["list_price"].alias("list_price"), F.coalesce(image, text("image")).alias("image"), text("url").alias("url"),
            recipe_availability(text("availability")).alias("availability"),
        ),
    )


def state_products(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Products of the state that pages (page_id, site, url, html) embed, each by its site's row of ``sites`` (site, block, root, fields, crumbs, crumb_names, currency).

    block: id of the script; root: path of the object that fields, a map of names to paths, start from; crumbs, crumb_names: path of the breadcrumbs and where each has its name. An
    image is the first absolute one in the order of its paths, else the page's og:image; a relative one is resolved. No title, no row.
    """
    script = F.call_function("regexp_extract", F.col("html"), F.concat(F.lit('(?s)<script id="'), F.col("block"), F.lit('"[^>]*>(.*?)</script>')), F.lit(1))
    rows = once(pages.join(F.broadcast(sites), "site"), "page_id", "site", "url", "html", "fields", "crumbs", "crumb_names", "currency", _at(F.try_parse_json(script), F.col("root"), "variant").alias("v"))
    rows = once(rows.filter("v IS NOT NULL"), "*", product_at(F.col("v"), F.col("fields")).alias("p")).filter("p.title IS NOT NULL")
    names = F.filter(F.transform(F.coalesce(_at(F.col("v"), F.col("crumbs"), "array<variant>"), F.array().cast("array<variant>")), lambda b: text_at(b, F.col("crumb_names"))), lambda n: n.isNotNull())
    og = F.regexp_extract("html", '(?i)property="og:image" content="(http[^"]*)"', 1)
    image = F.when(F.col("p.image").startswith("http"), F.col("p.image")).otherwise(F.coalesce(F.nullif(og, F.lit("")), resolve_reference(F.col("p.image"), F.col("url"))))
    own = [F.col(f"p.{c}").alias(c) for c in PRODUCT if c not in ("image", "url")]
    return rows.select("page_id", "site", *own, F.array_join(names, "/").alias("category"), image.alias("image"), "currency")


def body_products(bodies: DataFrame, sites: DataFrame) -> DataFrame:
    """Product rows of API bodies (page_id, site, body), by each site's row (site, products_path, fields): page_id, pos and PRODUCT; without title and URL no row."""
    rows = bodies.join(sites, "site").select("page_id", "fields", F.posexplode(records_at(F.try_parse_json("body"), F.col("products_path"))).alias("pos", "v"))
    return rows.select("page_id", "pos", product_at(F.col("v"), F.col("fields")).alias("p")).filter("p.title IS NOT NULL AND p.url IS NOT NULL").select("page_id", "pos", "p.*")


# Parameters and paths that are tried, in this order.
PAGE_PARAMS, OFFSET_PARAMS, CURSOR_PARAMS = ["page", "p", "pageNumber", "page_no", "pg"], ["offset", "start", "from", "skip"], ["cursor", "after", "page_cursor", "next_cursor"]
CURSOR_PATHS = ["page_info.end_cursor", "pagination.endCursor", "meta.next_cursor", "cursor", "pageInfo.endCursor", "data.pageInfo.endCursor"]
NEXT_PATHS = ["links.next", "pagination.next", "next", "meta.next", "_links.next.href"]


def with_param(url: Column, name: Column, value: Column) -> Column:
    """``url`` with a query parameter, in place of one of that name; the first in its place, further ones of that name are dropped."""

    def put(u: Column) -> Column:
        head, query = F.regexp_extract(u, r"^([^?#]*)", 1), F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
        pairs = F.filter(F.split(query, "&"), lambda p: p != "")
        own = lambda p: F.split_part(p, F.lit("="), F.lit(1)) == name
        new = F.concat(name, F.lit("="), F.call_function("url_encode", value))
        kept = F.filter(F.transform(pairs, lambda p, i: F.when(own(p) & (i == F.array_position(F.transform(pairs, own), True) - 1), new).when(~own(p), p)), lambda p: p.isNotNull())
        return F.concat(head, F.lit("?"), F.array_join(F.when(F.exists(pairs, own), kept).otherwise(F.concat(kept, F.array(new))), "&"))

    return let(url, put)


def _ids(v: Column, products: Column, id_path: Column) -> Column:
    return F.transform(records_at(v, products), lambda r: F.coalesce(text_at(r, F.array(id_path)), F.lit("")))


def followed_pagination(recipes: DataFrame, answers: DataFrame) -> DataFrame:
    """recipe, style, param, per_page, cursor_path, next_path: how each recipe's API gives its second page, read from recorded answers.

    recipes (recipe, base_url, products_path, id_path, style, param, per_page); answers (recipe, url, body). A page counts if it has a product that page 1 lacks. Tried in
    order: the configured style, page parameters, offsets, then what a body says itself: a cursor, whose value the next request must carry, and a URL of the next page. The
    answers that trials lead to are found by equality of recipe and URL; no recipe has more trials than the fixed lists name.
    """
    read = answers.select("recipe", "url", F.try_parse_json("body").alias("v"))
    start = with_param(F.col("base_url"), F.lit("page"), F.lit("1"))
    trial = lambda k, style, param: F.struct(F.lit(k).alias("turn"), style.alias("style"), param.alias("param"))
    fixed = [("page", p) for p in PAGE_PARAMS] + [("offset", p) for p in OFFSET_PARAMS]
    trials = [F.when(F.col("style").isin("page", "offset"), trial(0, F.col("style"), F.col("param")))] + [trial(k + 1, F.lit(s), F.lit(p)) for k, (s, p) in enumerate(fixed)]
    known = recipes.withColumnsRenamed({"style": "own_style", "param": "own_param"})
    counted = recipes.select("*", F.explode(F.array_compact(F.array(*trials))).alias("t")).drop("style", "param").select("*", "t.*").drop("t")
    first = F.when(F.col("style") == "page", "1").otherwise("0")
    one = counted.withColumn("url", with_param(F.col("base_url"), F.col("param"), first)).join(read, ["recipe", "url"]).withColumnRenamed("v", "v1")
    size = F.size(records_at(F.col("v1"), F.col("products_path")))
    one = one.withColumn("n1", size).filter("n1 > 0")
    step = F.when(F.col("style") == "page", "2").otherwise(F.coalesce("per_page", "n1").cast("string"))
    two = one.withColumn("url2", with_param(F.col("base_url"), F.col("param"), step)).withColumns({"cursor_path": F.lit(None).cast("string"), "next_path": F.lit(None).cast("string")})

    # What page 1 of the recipe's own form says.
    own_first = F.when(F.col("own_style") == "offset", with_param(F.col("base_url"), F.col("own_param"), F.lit("0"))).when(F.col("own_style") == "page", with_param(F.col("base_url"), F.col("own_param"), F.lit("1"))).otherwise(F.col("base_url"))
    said = known.withColumn("url", own_first).join(read, ["recipe", "url"]).withColumnRenamed("v", "v1").withColumn("n1", size)
    pick = lambda paths, good: F.get(F.filter(F.array(*[F.struct(F.lit(p).alias("path"), F.try_variant_get("v1", f"$.{p}", "string").alias("value"), F.schema_of_variant(F.try_variant_get("v1", f"$.{p}", "variant")).alias("kind")) for p in paths]), lambda x: (x["kind"] == "STRING") & good(x["value"])), F.lit(0))
    said = said.withColumn("c", pick(CURSOR_PATHS, lambda t: F.trim(t) != "")).withColumn("l", pick(NEXT_PATHS, lambda t: t.startswith("http")))
    cursors = said.filter("c IS NOT NULL AND n1 > 0").select("*", F.posexplode(F.array(*[F.lit(p) for p in CURSOR_PARAMS])).alias("k", "param"))
    cursors = cursors.withColumns({"turn": F.col("k") + 20, "style": F.lit("cursor"), "url2": with_param(F.col("url"), F.col("param"), F.col("c.value")), "cursor_path": F.col("c.path"), "next_path": F.lit(None).cast("string")})
    links = said.filter("l IS NOT NULL AND n1 > 0").withColumns({"turn": F.lit(30), "style": F.lit("link_rel"), "param": F.lit(None).cast("string"), "url2": F.col("l.value"), "cursor_path": F.lit(None).cast("string"), "next_path": F.col("l.path")})
    columns = ["recipe", "products_path", "id_path", "turn", "style", "param", "n1", "v1", "url2", "cursor_path", "next_path"]
    every = two.select(*columns).unionByName(cursors.select(*columns)).unionByName(links.select(*columns))
    met = every.join(read.withColumnsRenamed({"url": "url2", "v": "v2"}), ["recipe", "url2"])
    fresh = F.exists(F.array_except(_ids(F.col("v2"), F.col("products_path"), F.col("id_path")), _ids(F.col("v1"), F.col("products_path"), F.col("id_path"))), lambda i: i != "")
    good = met.filter(fresh).groupBy("recipe").agg(F.min_by(F.struct("style", "param", F.col("n1").alias("per_page"), "cursor_path", "next_path"), "turn").alias("b"))
    return good.select("recipe", "b.*")


# Where an answer may state how many products there are.
TOTALS = ["total", "count", "total_count", "pagination.total", "pagination.totalResults", "meta.total", "data.total"]


def validate_recipes(recipes: DataFrame, answers: DataFrame, least_size: int = 10, samples: int = 3) -> DataFrame:
    """Report of each recipe (recipe, products_path, fields, per_page) from its answers (recipe, kind, body): kind ``attempt`` (three tries of page 1), ``page1``, ``page2``.

    reliability, size, paged, samples, the shares of samples with title, price, url and sku, failures in order, confidence, ok. Without an answer for page 1, or one that is no JSON,
    the report is empty but for its reliability, and page1_fetch_failed.
    """
    read = recipes.join(answers, "recipe", "left").withColumn("v", F.try_parse_json("body"))
    items = F.transform(records_at(F.col("v"), F.col("products_path")), lambda r: product_at(r, F.col("fields")))
    total = F.coalesce(*[F.when(F.try_variant_get("v", f"$.{p}", "double") > 0, F.try_variant_get("v", f"$.{p}", "double")) for p in TOTALS])
    read = read.withColumn("items", items).withColumn("total", total)
    mapped = lambda items: F.filter(items, lambda x: x["title"].isNotNull() & x["price"].isNotNull() & x["url"].isNotNull())
    per = read.groupBy("recipe").agg(
        F.first("per_page").alias("asked"), F.count_if((F.col("kind") == "attempt") & (F.size("items") > 0)).alias("fine"),
        *[F.max_by(F.when(F.col("kind") == k, F.struct(F.col("items").alias("items"), F.col("total").alias("total"))), F.when((F.col("kind") == k) & F.col("v").isNotNull(), 1)).alias(k) for k in ("page1", "page2")],
    )
    none = F.array().cast(per.schema["page1"].dataType["items"].dataType)
    per = per.withColumn("i1", F.coalesce("page1.items", none)).withColumn("i2", F.coalesce("page2.items", none)).withColumn("n1", F.size("i1"))
    # The second page is told from the first by the first fifty products of each.
    fifty = lambda c: F.transform(F.slice(mapped(F.col(c)), 1, 50), lambda x: x["url"])
    per_page = F.coalesce("asked", F.greatest("n1", F.lit(1)))
    per = per.withColumn("per_page", per_page).withColumn("sample", F.slice(mapped(F.col("i1")), 1, samples))
    size = F.coalesce(F.col("page1.total").cast("long"), F.when(F.col("n1") >= F.col("per_page"), F.greatest(F.col("n1"), 2 * F.col("per_page"))).otherwise(F.col("n1")).cast("long"))
    paged = (F.col("n1") == 0) | (F.col("n1") < F.col("per_page")) | (F.size(F.array_except(fifty("i2"), fifty("i1"))) > 0)
    share = lambda c: F.when(F.size("sample") > 0, F.size(F.filter("sample", lambda x: x[c].isNotNull())) / F.size("sample")).otherwise(0.0)
    found = F.col("page1").isNotNull()
    out = per.select("recipe", found.alias("found"), (F.col("fine") / 3).alias("reliability"), F.when(found, size).otherwise(0).alias("size"), (found & paged).alias("paged"), F.size("sample").alias("samples"), *[share(c).alias(f"with_{c}") for c in ("title", "price", "url", "sku")])
    c = F.col
    complete = (c("with_title") >= 0.9) & (c("with_price") >= 0.9)
    score = c("reliability") * 0.35 + F.when(c("size") >= least_size, 0.35).otherwise(0.0) + F.when(c("paged"), 0.15).otherwise(0.0) + F.when(complete, 0.15).otherwise(0.0)
    out = out.withColumn("confidence", F.when(c("found"), F.least(F.lit(1.0), score)).otherwise(0.0))
    fails = [(c("reliability") < 0.9, "low_reliability"), (c("size") < least_size, "catalog_too_small"), (~c("paged"), "pagination_not_verified"), (c("samples") < min(2, samples), "insufficient_samples"), (~complete, "incomplete_fields"), (c("confidence") < 0.7, "low_confidence")]
    failures = F.when(c("found"), F.array_join(F.array_compact(F.array(*[F.when(t, n) for t, n in fails])), ",")).otherwise("page1_fetch_failed")
    return out.withColumn("failures", failures).withColumn("ok", F.col("failures") == "").drop("found")
