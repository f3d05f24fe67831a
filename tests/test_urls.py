"""URL references: the examples of RFC 3986, section 5.4, and what browsers make of a URL."""

import pytest
from pyspark.sql import functions as F

from martlens.functions.urls import normal_url, resolve_reference
from martlens.operators import extract

BASE = "http://a/b/c/d;p?q"
# Reference and target of the RFC's examples, normal ones, then abnormal ones.
RFC = [
    ("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"), ("g#s", "http://a/b/c/g#s"),
    ("g?y#s", "http://a/b/c/g?y#s"), (";x", "http://a/b/c/;x"), ("g;x", "http://a/b/c/g;x"), ("g;x?y#s", "http://a/b/c/g;x?y#s"), ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../", "http://a/b/"),
    ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../", "http://a/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("../../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), (".g", "http://a/b/c/.g"),
    ("g..", "http://a/b/c/g.."), ("..g", "http://a/b/c/..g"), ("./../g", "http://a/b/g"), ("./g/.", "http://a/b/c/g/"), ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"), ("g;x=1/./y", "http://a/b/c/g;x=1/y"), ("g;x=1/../y", "http://a/b/c/y"),
    ("g?y/./x", "http://a/b/c/g?y/./x"), ("g?y/../x", "http://a/b/c/g?y/../x"), ("g#s/./x", "http://a/b/c/g#s/./x"), ("g#s/../x", "http://a/b/c/g#s/../x"), ("http:g", "http:g"),
]


def test_examples_of_the_rfc(spark):
    df = spark.createDataFrame(RFC, "ref string, want string").select("ref", "want", resolve_reference(F.col("ref"), F.lit(BASE)).alias("got"))
    assert [(r.ref, r.got) for r in df.collect()] == RFC


@pytest.mark.parametrize(
    "href, base, want",
    [
        ("HTTPS://Shop.Example:443/A/../p", "https://s.example", "https://shop.example/p"), ("//CDN.example", "http://s.example/x", "http://cdn.example/"), (" /a b\n ", "https://s.example/x/y", "https://s.example/a b"), ("p/1", "https://s.example/x/y", "https://s.example/p/1"),
        ("/../d", "https://S.example:8443", "https://s.example:8443/d"), ("http://u:P@H.example:80?q=A", "https://s.example", "http://u:P@h.example/?q=A"), ("mailto:A@b", "https://s.example", "mailto:A@b"), (None, "https://s.example", None),
    ],
)
def test_links_of_a_site(spark, href, base, want):
    row = spark.createDataFrame([(href, base)], "h string, b string").select(extract.resolve(F.col("h"), F.col("b")).alias("u"), normal_url(extract.resolve(F.col("h"), F.col("b"))).alias("again")).first()
    assert (row.u, row.again) == (want, want)


def test_links_in_any_spelling(spark):
    html = """<a href=/q>1</a> <A class='x>y' HREF="HTTPS://S.Example/p#top">2</A> <a data-href="/no" href='a/../b'>3</a> <a href="#x"></a> <a href="mailto:a@b">4</a> <a href="https://s.example:443">5</a> <a href="http://other.example/">6</a> <script>"/en-CA/p-shoe/12/3"</script>"""
    rows = spark.createDataFrame([(1, "https://www.other.example/x", html), (2, "https://s.example/x/y", html), (3, "https://s.example", None)], "page_id long, url string, html string")
    got = {(r.page_id, r.link) for r in extract.resolved_links(rows).collect()}
    own = {(2, f"https://s.example/{p}") for p in ("q", "p", "b", "", "en-CA/p-shoe/12/3")}
    assert got == own | {(1, f"https://www.other.example/{p}") for p in ("q", "b", "en-CA/p-shoe/12/3")}
