"""Matching of listings to products across shops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.functions.components import components
from martlens.functions.latest import ranked
from martlens.functions.shared import written


def hard_key_match(rows: DataFrame, products: DataFrame, matched: DataFrame) -> DataFrame:
    """The product of each row (row_id, gtin, mpn) by the gtin of a product, else that of a matched listing (gtin, product_id), else by mpn; the smallest id of several."""
    by_gtin = products.filter("gtin is not null").groupBy("gtin").agg(F.min("product_id").alias("g"))
    by_mpn = products.filter("mpn is not null").groupBy("mpn").agg(F.min("product_id").alias("m"))
    by_listing = matched.filter("gtin is not null and product_id is not null").groupBy("gtin").agg(F.min("product_id").alias("l"))
    found = rows.join(by_gtin, "gtin", "left").join(by_listing, "gtin", "left").join(by_mpn, "mpn", "left")
    by = F.when(F.col("g").isNotNull(), "gtin").when(F.col("l").isNotNull(), "listing_gtin").when(F.col("m").isNotNull(), "mpn")
    return found.select("row_id", F.coalesce("g", "l", "m").alias("product_id"), by.alias("matched_by"))


def block_nearest(k: int):
    def nearest(asked: pa.Table, rows: pa.Table) -> pa.Table:
        """The k nearest rows of a block to each query of a block, the smaller id first where distances agree in six places."""

        def units(t: pa.Table) -> np.ndarray:
            v = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(t.num_rows, -1)
            return v / np.sqrt((v * v).sum(axis=1, keepdims=True))

        if not asked.num_rows or not rows.num_rows:
            return pa.table({"query": pa.array([], "int64"), "vec_id": pa.array([], "int64"), "distance": pa.array([], "float64")})
        rows = rows.sort_by("vec_id")
        q, r = asked["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
        far = np.round(1 - units(asked) @ units(rows).T, 6) + 0.0
        far[q[:, None] == r[None, :]] = np.inf
        at = np.argsort(far, axis=1, kind="stable")[:, :k]
        d = np.take_along_axis(far, at, axis=1)
        ok = np.isfinite(d)
        return pa.table({"query": np.broadcast_to(q[:, None], d.shape)[ok], "vec_id": r[at][ok], "distance": d[ok]})

    return nearest


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding, dims of rows with an id and a finite vector that isn't zero, empty or null and holds no null."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", F.size("embedding").alias("dims")).filter(F.col("vec_id").isNotNull() & (norm > 0) & (norm < float("inf")))


def nearest_candidates(vectors: DataFrame, k: int = 5, every: int = 10, queries: Column | None = None, block: int = 2000) -> DataFrame:
    """The k nearest of the same label, by cosine distance, of the rows of ``queries``, by default those whose id is divisible by ``every``.

    A query without a label searches the whole table. The search is exact: queries and rows of a label are dealt by hash into blocks of
    about ``block``, each block of queries meets each block of rows in a task of its own, and only its k best of each query leave it. Vectors
    meet those of their own length; rows whose id or vector is null, or whose vector is empty, zero, not finite or holds a null, neither
    search nor are found.
    """
    usable = usable_vectors(vectors)
    asked = usable.filter(F.col("vec_id") % every == 0 if queries is None else queries)
    rows = usable.withColumn("label", F.explode(F.array_distinct(F.array("label", F.lit(None)))))
    count = lambda df, q: df.select(F.col("label").alias("of"), F.col("dims").alias("long"), F.lit(q).alias("q"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    sizes = count(asked, 1).unionAll(count(rows, 0)).groupBy("of", "long").agg(blocks(F.sum("q")).alias("nq"), blocks(F.sum(1 - F.col("q"))).alias("nr")).filter("nq > 0 and nr > 0")

    def dealt(side: DataFrame, own: str, of: str, other: str, to: str) -> DataFrame:
        one = F.pmod(F.xxhash64("vec_id"), F.col(of)).cast("int").alias(own)
        joined = side.join(sizes, F.col("label").eqNullSafe(F.col("of")) & (F.col("dims") == F.col("long")))
        named = [F.col(c).alias(c) for c in ("dims", "label", "vec_id", "embedding")]
        return joined.select(*named, one, F.explode(F.sequence(F.lit(0), F.col(to) - 1)).alias(other))

    keys = ["dims", "label", "qb", "rb"]
    both = dealt(asked, "qb", "nq", "rb", "nr").groupBy(*keys).cogroup(dealt(rows, "rb", "nr", "qb", "nq").groupBy(*keys))
    best = both.applyInArrow(block_nearest(k), "query long, vec_id long, distance double")
    return best.withColumn("place", ranked(["query"], F.col("distance"), F.col("vec_id"))).filter(F.col("place") <= k)


def sku_conflicts(rows: DataFrame, listings: DataFrame) -> DataFrame:
    """listing_id, conflict of ``rows`` (listing_id, shop_id, sku, candidate): has the shop another active listing on the candidate product?

    It is a conflict if the row has no sku, or another one a sku that differs. Listings are folded to a row for each shop and product
    first, from which a row's own share is taken out again, so that no pairs are made.
    """
    known = F.when(F.col("sku") != "", F.col("sku"))
    per = listings.filter("active").groupBy("shop_id", F.col("product_id").alias("candidate")).agg(F.count("*").alias("n"), F.min(known).alias("low"), F.max(known).alias("high"))
    own = listings.filter("active").select("listing_id", F.col("product_id").alias("own_product"))
    joined = rows.join(per, ["shop_id", "candidate"], "left").join(own, "listing_id", "left")
    others = F.coalesce("n", F.lit(0)) - F.when(F.col("own_product") == F.col("candidate"), 1).otherwise(0)
    blank = F.coalesce(F.col("sku") == "", F.lit(True))
    differs = F.coalesce((F.col("low") != F.col("sku")) | (F.col("high") != F.col("sku")), F.lit(False))
    return joined.select("listing_id", ((others > 0) & (blank | differs)).alias("conflict"))


def decide_match(nearest: DataFrame, near: float = 0.70, sure: float = 0.5) -> DataFrame:
    """Of each query's nearest candidate: auto_matched, review or new."""
    first = nearest.filter("place = 1")
    status = F.when(F.col("distance") <= sure, "auto_matched").when(F.col("distance") <= near, "review").otherwise("new")
    return first.select("query", F.col("vec_id").alias("candidate"), "distance", status.alias("status"))


def backfill_products(products: DataFrame, listings: DataFrame) -> DataFrame:
    """Products with a null mpn get the sku of their first listing."""
    first = listings.groupBy("product_id").agg(F.min_by("sku", "listing_id").alias("sku"))
    return products.join(first, "product_id", "left").select("product_id", F.coalesce("mpn", "sku").alias("mpn"))


def resolve_entities(products: DataFrame) -> DataFrame:
    """One representative for products that share a gtin: the smallest id."""
    rep = products.filter("gtin is not null").groupBy("gtin").agg(F.min("product_id").alias("rep"))
    return products.join(rep, "gtin", "left").select("product_id", F.coalesce("rep", "product_id").alias("representative"))


def resolve_batch_entities(products: DataFrame) -> DataFrame:
    """The representative of each product: the smallest id that shared gtins and mpns lead to, over any number of products.

    Each key links its products to its smallest one, so that a key of many products makes as many edges, not pairs.
    """
    key = lambda c: F.when(F.trim(c) != "", F.struct(F.lit(c).alias("kind"), F.trim(c).alias("value")))
    keyed = products.filter("product_id is not null").select(F.col("product_id").cast("long").alias("b"), F.explode(F.array_compact(F.array(key("gtin"), key("mpn")))).alias("key"))
    links = keyed.join(keyed.groupBy("key").agg(F.min("b").alias("a")), "key").filter("a <> b").select("a", "b")
    found = components(links).select(F.col("v").alias("product_id"), "component")
    return products.join(found, "product_id", "left").select("product_id", F.coalesce("component", "product_id").alias("representative"))


def review_backlog(decisions: DataFrame) -> DataFrame:
    return decisions.filter("status = 'review'").agg(F.count("*").alias("open"))


def resolve_near_entities(products: DataFrame, vectors: DataFrame, members: DataFrame, near: float, k: int = 5, lists_from: int | None = None) -> DataFrame:
    """product_id, representative: products that share keys first, then representatives whose vectors are near, but for what a shop tells apart.

    products (product_id, gtin, mpn); vectors (vec_id: a product, label, embedding); members (id: a product, shop, sku). Both steps end in components or
    clusters that don't depend on the order of the rows.
    """
    from martlens.operators.vectors import build_index, cluster_apart, mutual_links

    by_key = written(resolve_batch_entities(products).distinct(), "representatives")
    first = vectors.join(by_key.filter("product_id = representative").select(F.col("product_id").alias("vec_id")), "vec_id", "left_semi")
    links = mutual_links(build_index(first, k), first, near, k, lists_from=lists_from)
    own = by_key.join(members.withColumnRenamed("id", "product_id"), "product_id", "left").select(F.col("representative").alias("id"), "shop", "sku")
    clusters = cluster_apart(links, own)
    return by_key.join(clusters.withColumnRenamed("id", "representative"), "representative").select("product_id", F.col("cluster").alias("representative"))


def match_listings(new: DataFrame, index, products: DataFrame, listings: DataFrame, verdicts: DataFrame, near: float, sure: float, k: int = 5, lists_from: int | None = None) -> DataFrame:
    """listing_id, decision, product_id, confidence of ``new`` listings (listing_id, shop_id, sku, gtin, mpn, label, embedding).

    A shared key decides; without one the nearest of the matched listings whose vectors ``index`` holds, unless the shop tells the two apart; then what
    ``verdicts`` (listing_id, same, verdict) say. products (product_id, gtin, mpn); listings: the matched ones (listing_id, shop_id, product_id, sku, gtin, active).
    """
    from martlens.operators.state import decide_matches
    from martlens.operators.vectors import search

    hard = hard_key_match(new.select(F.col("listing_id").alias("row_id"), "gtin", "mpn"), products, listings).select(F.col("row_id").alias("listing_id"), F.col("product_id").alias("hard"))
    asked = new.join(hard.filter("hard IS NULL"), "listing_id", "left_semi").select(F.col("listing_id").alias("vec_id"), "label", "embedding")
    best = search(index, asked, k, lists_from=lists_from).filter("place = 1").select(F.col("query").alias("listing_id"), F.col("vec_id").alias("nearest"), "distance")
    best = best.join(listings.select(F.col("listing_id").alias("nearest"), F.col("product_id").alias("candidate")), "nearest")
    rows = new.select("listing_id", "shop_id", "sku").join(hard, "listing_id", "left").join(best.drop("nearest"), "listing_id", "left")
    rows = written(rows, "matched")
    conflicts = sku_conflicts(rows.filter("candidate IS NOT NULL").select("listing_id", "shop_id", "sku", "candidate"), listings)
    told = rows.join(conflicts, "listing_id", "left").join(verdicts, "listing_id", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    return decide_matches(told, near, sure)
