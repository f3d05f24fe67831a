"""Next pages and path patterns in markdown."""

import pytest

from martlens.operators import markdown

U = "https://s.example/list?page=3&x=1"


@pytest.mark.parametrize(
    "text, url, want",
    [
        ("[1](/list?page=1) [Next page](/list?page=4)", U, "https://s.example/list?page=4"), ("[a](/x)  » [2](/list?page=2)", U, "https://s.example/x"), ("[about](/about) [12](list?page=12)", U, "https://s.example/list?page=12"),
        ("[next](https://other.example/) [7](/p7)", U, "https://s.example/p7"), ("[next](/list?page=3&x=1)", U, "https://s.example/list?page=4&x=1"), ("no links", "https://s.example/list?pg=2&p=9", "https://s.example/list?pg=2&p=10"),
        ("no links", "https://s.example/list?page=x", None), (None, "https://s.example/list", None), ("[Suivant\n>](../up)", U, "https://s.example/up"),
    ],
)
def test_next_pages(spark, text, url, want):
    rows = spark.createDataFrame([(1, url, "s.example", text)], "page_id long, url string, domain string, markdown string")
    assert markdown.next_pages(rows).first().next == want


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://a/en/cat/x", "/cat/"), ("https://a/en/us/pdp/shoe.html", "/pdp/"), ("https://a/pdp/shoe.html", None), ("https://a/en/p-shoe/1", "/p-/"), ("https://a/one", None), ("https://a/en/product/shoe-1", "/en/product/"), ("https://a/products/a-very-long-name-of-a-shoe", "/products/"),
        ("https://a/products/12345", "/products/"), ("https://a/about/us", None), ("https://a/x/y/dp/1", "/x/y/"), (None, None),
    ],
)
def test_path_patterns(spark, url, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(url,)], "u string").select(markdown.path_pattern(F.col("u")).alias("p")).first().p == want


def test_manifest_patterns(spark):
    text = "Product pages: /en/item/{sku}/\nSee /shop/product/list/ and [one](/products/a-1) [pic](/products/x.png) https://a/collections/product/all, https://a/collections/shop/all, https://a/sitemap/products/1.xml"
    rows = spark.createDataFrame([(1, "https://a", text), (2, "https://a", None), (3, "https://a", "")], "site long, origin string, text string")
    got = {r.site: r for r in markdown.manifest_patterns(rows).collect()}
    assert "/shop/product/list/" in got[1].product_patterns and "/en/item//" in got[1].product_patterns and "/products/a-1/" in got[1].product_patterns
    assert not any("png" in p or "xml" in p for p in got[1].product_patterns[3:]) and got[1].listing_patterns == ["/collections/product/"]
    assert got[3].product_patterns == []
