"""Paths that a table names, and pages that answers lead to."""

import json

from martlens.operators import paths

SITES = "site string, block string, root string, fields map<string,array<string>>, crumbs string, crumb_names array<string>, currency string"
GUEST = "customerGroupPrices.guest.price"
FIELDS = {
    "title": ["product.name"], "brand": ["product.brand", "product.brand.name"], "sku": ["product.code", "productCode"], "price": [f"{GUEST}.lowPrice.value", f"{GUEST}.price.value"], "list_price": [f"{GUEST}.baseHighPrice.value", f"{GUEST}.highPrice.value"],
    "image": [f"product.images[0].{k}" for k in ("urlOriginal", "url_zoom", "url")], "availability": ["product.availabilityStatus"],
}


def page(k, site, props, more="", block="STATE"):
    return (k, site, f"https://{site}/x/y", f'{more}<script id="{block}" type="a">{json.dumps(props) if not isinstance(props, str) else props}</script>')


def test_state_by_the_site_s_own_paths(spark):
    price = lambda **v: {"guest": {"price": {k: {"value": x} for k, x in v.items()}}}
    product = {"name": "Tent", "brand": {"name": "B"}, "images": [{"url": "/rel.png", "url_zoom": "https://c/z.png", "urlOriginal": ""}], "breadcrumbs": [{"name": "A"}, {"label": "C"}, {}], "availabilityStatus": "In Stock"}
    pages = [
        page(1, "a", {"p": {"product": product, "productCode": 77, "customerGroupPrices": price(lowPrice=10, highPrice=12.5)}}),
        page(2, "a", {"p": {"product": {**product, "code": "k", "brand": "Plain", "images": [{"url": "/rel.png"}]}, "customerGroupPrices": price(price=10, baseHighPrice=10)}}, '<meta property="og:image" content="https://o/g.png">'),
        page(3, "a", {"p": {"product": {"name": "N", "images": [{"url": "../r.png"}]}}}), page(4, "a", {"p": {"product": {"name": ""}}}), page(5, "a", "{bad"), page(6, "a", {"p": {}}, block="OTHER"), page(7, "none", {"p": {"product": product}}),
        page(8, "b", {"q": [{"t": "T", "c": 5}]}, block="B"), (9, "a", "https://a", None),
    ]
    sites = [("a", "STATE", "p", FIELDS, "product.breadcrumbs", ["name", "label"], "CAD"), ("b", "B", "q[0]", {"title": ["t"], "price": ["c"]}, "none", [], "USD")]
    got = {r.page_id: r for r in paths.state_products(spark.createDataFrame(pages, "page_id long, site string, url string, html string"), spark.createDataFrame(sites, SITES)).collect()}
    assert sorted(got) == [1, 2, 3, 8]
    assert (got[1].brand, got[1].sku, got[1].price, got[1].list_price, got[1].image, got[1].category, got[1].currency) == ("B", "77", 10.0, 12.5, "https://c/z.png", "A/C", "CAD")
    assert (got[2].brand, got[2].sku, got[2].price, got[2].list_price, got[2].image) == ("Plain", "k", 10.0, None, "https://o/g.png")
    assert (got[3].price, got[3].image, got[3].category) == (None, "https://a/r.png", "")
    assert (got[8].title, got[8].price, got[8].image, got[8].currency) == ("T", 5.0, None, "USD")


def test_parameters_of_urls(spark):
    from pyspark.sql import functions as F

    cases = [("https://a/x", "https://a/x?page=2"), ("https://a/x?q=1#f", "https://a/x?q=1&page=2"), ("https://a/x?page=1&q=1&page=7", "https://a/x?page=2&q=1"), ("https://a/x?pages=1", "https://a/x?pages=1&page=2"), (None, None)]
    df = spark.createDataFrame(cases, "u string, w string").select(paths.with_param(F.col("u"), F.lit("page"), F.lit("2")).alias("g"), "w")
    assert [(r.g) for r in df.collect()] == [w for _, w in cases]


RECIPES = "recipe long, base_url string, products_path string, id_path string, style string, param string, per_page int"


def body(ids, **more):
    return json.dumps({"d": {"items": [{"i": i} for i in ids]}, **more})


def test_pages_that_answers_lead_to(spark):
    base = "https://s/api"
    recipe = lambda k, style="none", param=None, per=None: (k, base, "d.items", "i", style, param, per)
    recipes = [recipe(1, "page", "seite"), recipe(2), recipe(3), recipe(4), recipe(5), recipe(6, "page", "page"), recipe(7), recipe(8)]
    answers = [
        (1, f"{base}?seite=1", body([1, 2])), (1, f"{base}?seite=2", body([3])), (1, f"{base}?page=1", body([1])), (1, f"{base}?page=2", body([9])),
        (2, f"{base}?p=1", body([1, 2])), (2, f"{base}?p=2", body([1, 2])), (2, f"{base}?start=0", body([1, 2])), (2, f"{base}?start=2", body([2, 3])),
        (3, base, body([1, 2], page_info={"end_cursor": "t k"}, links={"next": "https://s/n"})), (3, f"{base}?after=t+k", body([3])), (3, "https://s/n", body([4])),
        (4, base, body([1], cursor=" ", meta={"next": "https://s/n?2"})), (4, "https://s/n?2", body([2])),
        (5, base, body([1], cursor=7, next="/rel")), (6, f"{base}?page=1", body([])), (6, f"{base}?page=2", body([2])), (7, f"{base}?page=1", "{bad"), (7, base, None), (8, f"{base}?offset=0", body(["", "a"])), (8, f"{base}?offset=2", body(["", "a"])),
    ]
    got = {r.recipe: tuple(r)[1:] for r in paths.followed_pagination(spark.createDataFrame(recipes, RECIPES), spark.createDataFrame(answers, "recipe long, url string, body string")).collect()}
    assert got == {1: ("page", "seite", 2, None, None), 2: ("offset", "start", 2, None, None), 3: ("cursor", "after", 2, "page_info.end_cursor", None), 4: ("link_rel", None, 1, None, "meta.next")}


def test_reports_of_recipes(spark):
    item = lambda i, price=1.5, **m: {"n": f"t{i}", "u": f"/{i}", "c": price, **m}
    wrap = lambda items, **m: json.dumps({"x": {"y": items}, **m})
    fields = {"title": ["n"], "price": ["p", "c"], "url": ["u"], "sku": ["s"]}
    recipes = [(k, "x.y", fields, 2 if k != 4 else None) for k in range(1, 7)]
    whole, second = wrap([item(1, s="a"), item(2)], meta={"total": 40}), wrap([item(3)])
    answers = [(1, k, whole) for k in ("attempt", "attempt", "attempt", "page1")] + [(1, "page2", second)]
    answers += [(2, "attempt", whole), (2, "attempt", "{bad"), (2, "attempt", None), (2, "page1", whole), (2, "page2", whole)]
    answers += [(3, "attempt", whole)] * 3 + [(3, "page1", "{bad")]
    answers += [(4, "attempt", second)] * 3 + [(4, "page1", wrap([item(1, None), item(2)])), (4, "page2", None)]
    answers += [(6, "attempt", second), (6, "page1", wrap([]))]
    got = {r.recipe: r for r in paths.validate_recipes(spark.createDataFrame(recipes, "recipe long, products_path string, fields map<string,array<string>>, per_page int"), spark.createDataFrame(answers, "recipe long, kind string, body string")).collect()}
    one = got[1]
    assert (one.reliability, one.size, one.paged, one.samples, one.with_title, one.with_sku, one.failures, one.ok) == (1.0, 40, True, 2, 1.0, 0.5, "", True) and abs(one.confidence - 1) < 1e-12
    assert (round(got[2].reliability, 3), got[2].paged, got[2].failures, got[2].ok) == (0.333, False, "low_reliability,pagination_not_verified,low_confidence", False)
    assert (got[3].reliability, got[3].size, got[3].failures, got[3].confidence) == (1.0, 0, "page1_fetch_failed", 0.0)
    assert (got[4].size, got[4].paged, got[4].samples, got[4].failures) == (4, False, 1, "catalog_too_small,pagination_not_verified,insufficient_samples,low_confidence")
    assert got[5].failures == "page1_fetch_failed" and got[5].reliability == 0.0
    assert (got[6].size, got[6].paged, got[6].failures.split(",")[0]) == (0, True, "low_reliability")


def test_json_ld_of_any_depth(spark):
    from martlens.operators import pages

    node = lambda name: {"@type": ["Thing", "Product"], "name": name, "offers": {"price": "5"}}
    deep = node("deep")
    for k in range(40):
        deep = [{"@type": "Thing"}, deep] if k % 2 else {"@graph": [deep]}
    blocks = [
        [deep], [[[[[[node("five")]]]]]], [node("flat"), node("second")], [{"@type": "Product", "name": "outer", "@graph": [node("inner")]}], [{"@graph": {"@type": "Product", "name": "no list"}}], [7, None, "x", [[]]],
    ]
    html = lambda b: f'<script type="application/ld+json">{json.dumps(b if len(b) > 1 else b[0])}</script>'
    rows = [(k, html(b)) for k, b in enumerate(blocks)] + [(10, '<script type="application/ld+json">[[bad</script>'), (11, None)]
    got = {r.page_id: r.title for r in pages.jsonld_products(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got == {0: "deep", 1: "five", 2: "flat", 3: "inner"}
