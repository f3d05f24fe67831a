"""Chains of any length and loops, sitemaps that name each other, prefixes of setters, merged shops, against plain Python."""

import random

from martlens.functions.hierarchy import ancestor_paths
from martlens.operators import dependencies, mining, state, taxonomy


def brute_paths(nodes):
    by = {i: (p, label) for i, p, label in nodes}
    out = {}
    for i in by:
        chain, at = [], i
        while at in by and at not in chain:
            chain.append(at)
            at = by[at][0]
        out[i] = [by[k][1] for k in reversed(chain)]
    return out


def test_chains_of_any_length_and_loops(spark):
    rng = random.Random(0)
    nodes = [(i, i - 1 if i else None, f"l{i}") for i in range(1000)]
    nodes += [(2000 + i, 2000 + (i + 1) % 37, f"c{i}") for i in range(37)] + [(3000 + i, 3000 + i + 1 if i < 49 else 2005, f"t{i}") for i in range(50)]
    nodes += [(4000, 4000, "self"), (4001, 4000, "below"), (4002, 9999, "dangling"), (4003, None, None)]
    nodes += [(5000 + i, 5000 + rng.randrange(40), f"r{i}") for i in range(40)]
    got = {r.id: r.path for r in ancestor_paths(spark.createDataFrame(nodes, "id long, parent_id long, label string")).collect()}
    assert got == brute_paths(nodes)
    assert ancestor_paths(spark.createDataFrame([], "id long, parent_id long, label string")).count() == 0


def test_sitemaps_that_name_each_other(spark):
    index = lambda *maps: "<sitemapindex>" + "".join(f"<sitemap><loc>{m}</loc></sitemap>" for m in maps) + "</sitemapindex>"
    leaf = lambda *urls: "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"
    maps = [("a", index("b", "leaf1", "a")), ("b", index("a", "c")), ("c", index("d")), ("d", index("e")), ("e", index("f", "leaf2")), ("f", index("leaf3")), ("leaf1", leaf("u1")), ("leaf2", leaf("u2")), ("leaf3", leaf("u3"))]
    df = spark.createDataFrame(maps, "map string, body string")
    roots = spark.createDataFrame([(1, "a"), (2, "c"), (3, "none")], "root long, map string")
    assert {(r.root, r.url) for r in mining.sitemap_tree(df, roots).collect()} == {(1, "u1"), (1, "u2"), (2, "u2"), (2, "u3")}


def test_dependencies_equal_every_pair(spark):
    rng = random.Random(4)
    names = ["sid", "cart", "ab", "x"]
    rows = []
    for s in range(4):
        for k in range(60 if s else 300):
            cookie = "; ".join(f"{n}={k}" for n in rng.sample(names, rng.randrange(4))) or rng.choice([None, "", " ;"])
            sets = [f"{n}=1; Path=/" for n in rng.sample(names, rng.choice([0, 0, 0, 1, 2]))] or rng.choice([None, []])
            rows.append((s, k, f"https://a/{rng.randrange(20)}", cookie, sets))
    setters, requests = dependencies.dependency_prefixes(spark.createDataFrame(rows, "session long, seq long, url string, cookie string, set_cookie array<string>"), slices=7)
    got = {(r.session, r.seq): (r.cookies_required, r.depends_on) for r in dependencies.depends_on(setters, requests).collect()}
    want = {}
    for s in range(4):
        sources = []
        for _, k, url, cookie, sets in (r for r in rows if r[0] == s):
            sources += [(n.split("=")[0], url) for n in sets or []]
            sent = {p.split("=")[0].strip() for p in (cookie or "").split(";")} - {""}
            if sent:
                want[(s, k)] = (sorted(sent), sorted({u for n, u in sources if n in sent}))
    assert got == want
    assert setters.count() + requests.count() < 3 * len(rows)


def test_shops_of_a_domain_are_merged(spark):
    shops = spark.createDataFrame([(1, "https://WWW.a.com/x", 5), (2, "a.com", 3), (3, "www.A.com:443", None), (4, "b.com", 1), (5, None, 1), (6, "", 1)], "shop_id long, domain string, created long")
    tables = {
        "listing_pages": spark.createDataFrame([(1, 1, "u"), (2, 2, "u"), (3, 3, "v"), (4, 1, "v"), (5, 4, "u"), (6, 3, None), (7, 1, None)], "id long, shop_id long, url string"),
        "recipe_versions": spark.createDataFrame([(1, 1), (2, 2), (3, 4)], "id long, shop_id long"), "signals": spark.createDataFrame([(1, 1), (2, 3), (3, None)], "id long, shop_id long"),
        "orgs": spark.createDataFrame([(1, 3), (2, None)], "id long, own_shop_id long"), "other": spark.createDataFrame([(1, 1)], "id long, shop_id long"),
    }
    out = {k: sorted((tuple(r) for r in v.collect()), key=repr) for k, v in state.merge_by_catalogue(shops, tables).items()}
    assert [r[0] for r in out["shops"]] == [2, 4, 5, 6]
    assert out["listing_pages"] == [(2, 2, "u"), (3, 2, "v"), (5, 4, "u"), (6, 2, None), (7, 2, None)]
    assert out["recipe_versions"] == [(2, 2), (3, 4)] and out["signals"] == [(1, 2), (2, 2), (3, None)]
    assert out["orgs"] == [(1, 2), (2, None)] and out["other"] == [(1, 1)]


def test_taxonomy_over_two_batches_is_that_of_one(spark):
    rng = random.Random(6)
    brands = ["The North  Face", " the north face ", "Café Ñandú", "CAFE NANDU", "Arc'teryx", " ", None, "???"]
    rows = [(k, rng.choice(brands), k) for k in range(80)]
    frame = lambda part: spark.createDataFrame(part, "row_id long, brand string, ts long")
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    none = taxonomy.no_brands(spark)
    whole = taxonomy.resolve_brands(*none, frame(rows))
    first = taxonomy.resolve_brands(*none, frame(rows[:30]))
    second = taxonomy.resolve_brands(first[0], first[1], frame(rows[30:]))
    assert plain(second[0]) == plain(whole[0]) and plain(second[1]) == plain(whole[1])
    assert plain(first[2].union(second[2])) == plain(whole[2])
    names = {r.slug: r.name for r in whole[0].collect()}
    first_seen = {}
    for _, raw, _ in rows:
        if raw and raw.strip():
            first_seen.setdefault({"T": "the-north-face", "t": "the-north-face", "C": "cafe-nandu", "A": "arc-teryx", "?": ""}[raw.strip()[0]], raw.strip())
    assert names == first_seen
    # A brand that is known without this alias takes the name that came.
    known = spark.createDataFrame([("b7", "arc-teryx", "old name")], "brand_id string, slug string, name string")
    moved = taxonomy.resolve_brands(known, none[1], frame([(1, "Arc'teryx", 1)]))
    assert plain(moved[0]) == [("b7", "arc-teryx", "Arc'teryx")] and plain(moved[2]) == [(1, "b7")]


def test_categories_over_two_batches_are_those_of_one(spark):
    rng = random.Random(7)
    parts = [["Men", "men "], ["Shoes", "SHOES", " "], ["Run", "Trail", None]]
    rows = [(k, rng.randrange(3), [rng.choice(p) for p in parts[: rng.randrange(4)]], k) for k in range(60)]
    frame = lambda part: spark.createDataFrame(part, "row_id long, shop_id long, category array<string>, ts long")
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    none = taxonomy.no_categories(spark)
    whole = taxonomy.resolve_categories(*none, frame(rows))
    first = taxonomy.resolve_categories(*none, frame(rows[:25]))
    second = taxonomy.resolve_categories(first[0], first[1], frame(rows[25:]))
    assert plain(second[0]) == plain(whole[0]) and plain(second[1]) == plain(whole[1]) and plain(first[2].union(second[2])) == plain(whole[2])
    maps, names = {}, {}
    for _, shop, path, _ in rows:
        clean = [x.strip() for x in path if x and x.strip()]
        if clean and (shop, " / ".join(clean)) not in maps:
            slugs = [x.lower() for x in clean]
            maps[shop, " / ".join(clean)] = "/".join(slugs)
            names |= {"/".join(slugs[: i + 1]): clean[i] for i in range(len(slugs))}
    assert {r.path: (r.name, r.depth) for r in whole[0].collect()} == {p: (n, p.count("/")) for p, n in names.items()}
    ids = {r.path: r.category_id for r in whole[0].collect()}
    assert {(r.shop_id, r.raw_path): r.category_id for r in whole[1].collect()} == {k: ids[v] for k, v in maps.items()}
    assert all(r.parent_id == ids.get(r.path.rpartition("/")[0]) for r in whole[0].collect())


def test_jumps_send_no_table_through_the_driver(spark):
    from martlens.functions.hierarchy import _jump

    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, up long")
    jumped = _jump(rows)
    assert "BroadcastExchange" not in jumped._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in jumped.collect()} == {(1, None), (2, None), (3, 1)}
