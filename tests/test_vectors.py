"""The search by inverted lists and the clusters made with it, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlens.operators import matching, vectors

VECTORS = "vec_id long, label int, embedding array<float>"


def brute_nearest(rows, asked, k):
    unit = lambda v: (x := np.array(v, np.float32).astype(float)) / np.sqrt((x * x).sum())
    out = []
    for q, label, v in asked:
        far = sorted((round(1 - float(unit(v) @ unit(x)), 6) + 0.0, r) for r, other, x in rows if r != q and len(x) == len(v) and (label is None or other == label))
        out += [(q, r, d, p + 1) for p, (d, r) in enumerate(far[:k])]
    return sorted(out)


def found(df):
    return sorted((r.query, r.vec_id, round(r.distance, 6) + 0.0, r.place) for r in df.collect())


@pytest.fixture(scope="module")
def spread(spark):
    """Groups of near rows, rows without structure, equal rows, rows without a label and of another length."""
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(30, 16)) * 4
    rows = [(k, int(k % 3) if k % 10 else None, (middle[k % 30] + rng.normal(size=16)).tolist()) for k in range(900)]
    rows += [(k, 7, rng.normal(size=16).tolist()) for k in range(900, 1000)] + [(k, 8, rows[0][2]) for k in range(1000, 1020)] + [(k, 1, rng.normal(size=5).tolist()) for k in range(1020, 1030)]
    odd = [(2000, 1, None), (2001, 1, []), (2002, 1, [0.0] * 16), (2003, 1, [float("nan")] * 16), (2004, 1, [None] * 16), (None, 1, rows[0][2])]
    return rows, spark.createDataFrame(rows + odd, VECTORS).repartition(4)


def test_lists_end_exact_and_find_most_before(spark, spread):
    rows, df = spread
    index = vectors.build_index(df, k=5, cells=24)
    asked = df.filter("vec_id % 4 = 0")
    want = brute_nearest(rows, [r for r in rows if r[0] % 4 == 0], 5)
    for lists_from in (0, None, 1 << 62):
        assert found(vectors.search(index, asked, 5, lists_from=lists_from, block=100)) == want
    probed = found(vectors.search(index, asked, 5, exact=False, lists_from=0))
    pairs = lambda rows: {r[:2] for r in rows}
    assert len(pairs(probed) & pairs(want)) >= 0.9 * len(want)
    assert index.probes < 12  # of 24: the rows have structure


def test_lists_without_rows(spark, spread):
    empty = vectors.build_index(spread[1].limit(0))
    assert vectors.search(empty, spread[1].limit(0)).count() == 0
    assert vectors.search(empty, spread[1]).count() == 0
    one = vectors.build_index(spread[1].filter("vec_id = 3"))
    assert found(vectors.search(one, spread[1].filter("vec_id IN (3, 33)"), lists_from=0)) == brute_nearest([r for r in spread[0] if r[0] == 3], [spread[0][33]], 5)


def brute_clusters(links, members):
    at = {m[0]: m[0] for m in members}
    own = {}
    for i, shop, sku in members:
        if shop is not None:
            own.setdefault(i, {}).setdefault(shop, set()).add(sku or None)
    for _, a, b in sorted((d, min(a, b), max(a, b)) for a, b, d in links):
        x, y = at[a], at[b]
        if x == y:
            continue
        both = set(own.get(x, {})) & set(own.get(y, {}))
        if any(None in (s := own[x][k] | own[y][k]) or len(s) > 1 for k in both):
            continue
        keep, gone = min(x, y), max(x, y)
        at = {i: keep if c == gone else c for i, c in at.items()}
        for shop, skus in own.pop(gone, {}).items():
            own.setdefault(keep, {}).setdefault(shop, set()).update(skus)
    return at


@pytest.mark.parametrize("seed", range(3))
def test_clusters_equal_one_merge_after_the_other(spark, seed):
    rng = np.random.default_rng(seed)
    members = [(int(i), int(s) if s < 6 else None, rng.choice(["a", "b", "", None])) for i in range(60) for s in rng.integers(0, 8, 2)]
    links = {tuple(sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(150)}
    links = [(a, b, float(rng.integers(1, 30)) / 100) for a, b in sorted(links)]
    frame = spark.createDataFrame([links[i] for i in rng.permutation(len(links))], "a long, b long, distance double")
    got = {r.id: r.cluster for r in vectors.cluster_apart(frame, spark.createDataFrame(members, "id long, shop long, sku string")).collect()}
    assert got == brute_clusters(links, members)
    assert 1 < len(set(got.values())) < 60


def test_a_round_writes_three_tables_of_linked_ids(spark, monkeypatch):
    """A chain of ever longer links takes a round each; ids without links aren't carried along."""
    links = [(i, i + 1, (10 - i) / 100) for i in range(9)]
    members = [(i, i, "s") for i in range(200)] + [(300, None, None), (5, 100, "s")]
    frame, own = spark.createDataFrame(links, "a long, b long, distance double"), spark.createDataFrame(members, "id long, shop long, sku string")
    calls = []
    monkeypatch.setattr(vectors, "written", lambda df, name, real=vectors.written: (calls.append((name, out := real(df, name))), out)[1])
    got = {r.id: r.cluster for r in vectors.cluster_apart(frame, own).collect()}
    assert got == brute_clusters([(a, b, d) for a, b, d in links], members)
    assert len(calls) <= 3 * 9 + 10
    assert max(df.count() for _, df in calls) <= 11
    none = vectors.cluster_apart(frame.limit(0), own)
    assert none.filter("id <> cluster").count() == 0 and none.count() == 201


def test_near_entities_with_keys(spark):
    products = spark.createDataFrame([(1, "g", None), (2, "g", None), (3, None, "m"), (4, None, "m"), (5, None, None), (6, None, None), (7, None, None)], "product_id long, gtin string, mpn string")
    vecs = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 0, [1.0, 0.1]), (5, 0, [1.0, 0.05]), (6, 0, [-1.0, 0.0]), (7, 1, [1.0, 0.0])], VECTORS)
    members = spark.createDataFrame([(1, 10, "a"), (3, 11, "b"), (4, 12, "c"), (5, 12, "d"), (6, 13, "e")], "id long, shop long, sku string")
    got = {r.product_id: r.representative for r in matching.resolve_near_entities(products, vecs, members, near=0.1).collect()}
    # 5 is nearest to 1 and 3; 4, which shares a key with 3, is of the shop of 5 with another sku.
    assert got in ({1: 1, 2: 1, 3: 3, 4: 3, 5: 1, 6: 6, 7: 7}, {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7})
    links = [(1, 5, round(1 - 1 / np.sqrt(1 + 0.05**2), 6)), (1, 3, round(1 - 1 / np.sqrt(1 + 0.1**2), 6)), (3, 5, round(1 - (1 + 0.005) / np.sqrt(1.0025 * 1.01), 6))]
    assert {k: v for k, v in got.items() if k in (1, 3, 5, 6, 7)} == {k: v for k, v in brute_clusters(links, [(1, 10, "a"), (3, 11, "b"), (3, 12, "c"), (5, 12, "d"), (6, 13, "e"), (7, None, None)]).items()}


def test_recall_on_the_given_rows(spark):
    """Ids divisible by 100 of the largest table of tests, against all rows of their label and of all labels."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = vectors.build_index(df)
    asked = df.filter("vec_id % 100 = 0").withColumn("label", F.when(F.col("vec_id") % 200 == 0, F.col("label")))
    exact = {r[:2] for r in found(vectors.search(index, asked, lists_from=1 << 62))}
    assert len(exact & {r[:2] for r in found(vectors.search(index, asked, exact=False, lists_from=0))}) >= 0.9 * len(exact)


def test_saved_index_grows_by_loads(spark, spread, tmp_path):
    """Rows come, change and go in three loads; searches stay exact, by lists and without, and after the segments are made one."""
    rows, df = spread
    path = f"file://{tmp_path}/index"
    with pytest.raises(FileNotFoundError):
        vectors.load_index(spark, path)
    n = F.col("vec_id")
    vectors.save_index(vectors.build_index(df.filter("vec_id < 600"), cells=24), path)
    vectors.add_rows(spark, path, df.filter("vec_id >= 600 OR vec_id IS NULL"))
    moved = df.filter("vec_id % 20 = 3").withColumn("embedding", F.when(n % 40 == 3, F.reverse("embedding")))
    vectors.add_rows(spark, path, moved)
    vectors.add_rows(spark, path, df.limit(0))
    left = [(i, label, v[::-1] if i % 20 == 3 else v) for i, label, v in rows if i % 40 != 23]
    want = brute_nearest(left, [r for r in rows if r[0] % 4 == 0], 5)
    asked = df.filter("vec_id % 4 = 0")
    index = vectors.load_index(spark, path)
    for lists_from in (0, 1 << 62):
        assert found(vectors.search(index, asked, 5, lists_from=lists_from, block=100)) == want
    vectors.save_index(index, path)
    again = vectors.load_index(spark, path)
    assert again.rows.count() == len(left) and found(vectors.search(again, asked, 5, lists_from=0)) == want


def test_saved_index_of_nothing(spark, spread, tmp_path):
    path = f"file://{tmp_path}/none"
    vectors.save_index(vectors.build_index(spread[1].limit(0)), path)
    assert vectors.search(vectors.load_index(spark, path), spread[1]).count() == 0
    vectors.add_rows(spark, path, spread[1].filter("vec_id = 3"))
    one = vectors.load_index(spark, path)
    assert found(vectors.search(one, spread[1].filter("vec_id = 33"), lists_from=0)) == brute_nearest([r for r in spread[0] if r[0] == 3], [spread[0][33]], 5)
