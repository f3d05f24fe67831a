"""Work on a row is done once and is dealt out to many tasks, told from the plans."""

import pytest

from martlens.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ext17_condensed_pages", "ext05_state_products", "url11_category_links", "ext09_extract_listing_html", "ext10_extract_listing_markdown", "ext11_map_api_records"])
def test_rows_of_a_small_file_are_dealt_out(spark, name):
    assert "REPARTITION_BY_NUM" in plan(spark, name)


@pytest.mark.parametrize("name, mark, times", [("ext17_condensed_pages", "(script|style|noscript|svg", 1), ("src02_sitemap_shapes", "<rss", 2)])
def test_values_that_a_filter_reads_are_computed_once(spark, name, mark, times):
    assert plan(spark, name).count(mark) == times


def test_tasks_grow_with_the_files_that_rows_come_from(spark, tmp_path):
    from martlens.functions.shared import tasks_for
    from martlens.operators import ingest

    spark.range(5000).selectExpr("concat('u', id) AS url", "'s' AS sku", "1L AS shop_id", "timestamp'2020-01-01' AS first_seen", "timestamp'2020-01-01' AS last_seen", *[f"'x' AS {c}" for c in ingest.UPDATED], "true AS active").write.parquet(f"{tmp_path}/l")
    rows = spark.read.parquet(f"{tmp_path}/l")
    assert tasks_for(rows) == 4 == tasks_for(spark.range(3).toDF("x")) and tasks_for(rows, 1000) > 20
    assert ingest.upsert_all_columns(rows, rows)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2


def brute_tree(maps, roots, depth):
    """(root, url) by breadth first; maps: {map: [(is an index, url)]}."""
    out = set()
    for root, start in roots:
        level, seen = {start}, {start}
        for _ in range(depth + 1):
            out |= {(root, u) for m in level for index, u in maps.get(m, []) if not index}
            level = {u for m in level for index, u in maps.get(m, []) if index} - seen
            seen |= level
    return out


@pytest.mark.parametrize("depth", [0, 1, 2, 4])
def test_sitemap_tree_reads_entries_a_fixed_number_of_times(spark, depth):
    """Circles, maps named twice or by themselves, maps that are index and page list at once, names without a map; the last query reads the entries twice at any depth."""
    from martlens.operators.mining import sitemap_tree

    maps = {f"m{k}": [(True, f"m{k * 7 % 23}"), (True, f"m{k + 1}"), (True, "none")] if k % 3 else [(False, f"u{k}"), (False, f"u{k // 2}")] for k in range(23)}
    maps["m4"] += [(False, "u4"), (False, "u4")]
    roots = [("a", "m1"), ("a", "m6"), ("b", "m4"), ("b", "none"), ("c", "m22")]
    body = lambda index, urls: f"<{'sitemapindex' if index else 'urlset'}>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" if index else f"<url><loc>{u}</loc></url>" for u in urls) + f"</{'sitemapindex' if index else 'urlset'}>"
    bodies = [(m, body(index, urls)) for m, all_ in maps.items() for index in (True, False) if (urls := [u for i, u in all_ if i == index])]
    got = sitemap_tree(spark.createDataFrame(bodies, "map string, body string"), spark.createDataFrame(roots, "root string, map string"), depth)
    assert sorted(map(tuple, got.collect())) == sorted(brute_tree(maps, roots, depth))
    scans = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in line and "kind#" in line]
    assert len(scans) <= 2


def test_listings_are_dealt_by_the_size_of_their_files(spark):
    from martlens.sources.tables import load

    few = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert "REPARTITION_BY_NUM" in load(spark, "/root/testdata/sf0.1", "listings")[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)
    assert "REPARTITION_BY_NUM" not in load(spark, SF, "listings")[0]._jdf.queryExecution().executedPlan().toString()


def spread_over(spark, rows, path):
    """``rows`` in files and a session of one shuffle partition, so that even small tables are dealt out by size."""
    rows.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def one_partition(spark, monkeypatch):
    from martlens.operators import mining

    few = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(mining, "tasks_for", lambda rows: 3)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", few)


def test_urls_of_products_are_numbered_without_a_join(spark, tmp_path, one_partition):
    """Sites across blocks, ties in the key, a site that is null: the spread is the same, no task's share is a fixed part of the table."""
    from martlens.functions.latest import numbered
    from martlens.operators import mining

    rows = spark.range(500).selectExpr("CASE WHEN id % 7 < 5 THEN 'a' WHEN id % 7 = 5 THEN 'b' END AS site", "concat('https://x/p/', lpad(cast(id AS string), 7, '0')) AS url", "CAST(NULL AS string) AS sitemap")
    rows = spread_over(spark, rows, f"{tmp_path}/u")
    from pyspark.sql import functions as F

    got = numbered(rows, ["site"], [F.col("url")], "i", "n", 100)
    plan_ = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan_ and plan_.count("REPARTITION_BY_NUM") == 1
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r.url):
        want.setdefault(r.site, []).append(r.url)
    assert sorted((str(r.site), r.url, r.i, r.n) for r in got.collect()) == sorted((str(s), u, i, len(us)) for s, us in want.items() for i, u in enumerate(us))
    seen = []
    mining_numbered = mining.numbered
    try:
        mining.numbered = lambda rows, *a: (seen.append(rows._jdf.queryExecution().executedPlan().toString()), mining_numbered(rows, *a))[1]
        assert mining.best_candidates(rows.filter("site IS NOT NULL")).count() == 20
    finally:
        mining.numbered = mining_numbered
    assert "REPARTITION_BY_NUM" in seen[0]


def test_patterns_of_few_urls_and_of_many(spark, tmp_path, one_partition):
    """A segment found once counts where a site has one or two URLs, also under /cat/; segments are dealt out."""
    from martlens.operators.mining import derive_product_pattern

    urls = {"one": ["zz1/qq"], "two": ["aaa/b1", "ccc/b2"], "three": ["a/x1", "b/x2", "c/x3"], "major": ["xxx/q1", "xxx/q2", "yyy/q3"], "token": ["k/item/1", "l/item/2", "m/z/3"], "cat": ["u/cat/men/1", "v/other/2"], "tie": ["p/a1", "p/a2", "b/c"]}
    rows = spread_over(spark, spark.createDataFrame([(s, f"https://h/{u}") for s, us in urls.items() for u in us], "site string, url string"), f"{tmp_path}/u")
    df = derive_product_pattern(rows)
    assert {r.site: r.pattern for r in df.collect()} == {"one": "/zz1/", "two": "/ccc/", "three": None, "major": "/xxx/", "token": "/item/", "cat": "/cat/", "tie": "/p/"}
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
