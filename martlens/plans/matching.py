"""Registered queries of the search by inverted lists and of what is decided with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from martlens.functions.shared import shared_path, written
from martlens.operators import matching, state, vectors
from martlens.plans.registry import query

_PAIRS = "SELECT q.vec_id AS query, v.vec_id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS distance FROM {embeddings} q JOIN {embeddings} v ON (q.vec_id % 300 = 0 OR q.label = v.label) AND q.vec_id <> v.vec_id"
_HUNDREDTH = f"SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id)::INT AS place FROM ({_PAIRS} WHERE q.vec_id % 100 = 0) n QUALIFY place <= 5"


def _asked(embeddings):
    """Every hundredth row; of these every third without a label."""
    return embeddings.filter("vec_id % 100 = 0").withColumn("label", F.when(F.col("vec_id") % 300 != 0, F.col("label")))


@query("embeddings", _HUNDREDTH)
def mat02_index_search(embeddings):
    """By lists whatever the size of a label, to the exact end."""
    return vectors.search(vectors.build_index(embeddings), _asked(embeddings), lists_from=0)


@query("embeddings", f"SELECT count(*) AS pairs, true AS enough FROM ({_HUNDREDTH}) n")
def mat02_index_recall(embeddings):
    """Of the exact pairs at least nine of ten are in the probed cells."""
    index = vectors.build_index(embeddings)
    exact = vectors.search(index, _asked(embeddings), lists_from=1 << 62)
    probed = vectors.search(index, _asked(embeddings), exact=False, lists_from=0).select("query", "vec_id", F.lit(1).alias("hit"))
    return exact.join(probed, ["query", "vec_id"], "left").agg(F.count("*").alias("pairs"), (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count("*")).alias("enough"))


@query("embeddings", f"SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id)::INT AS place FROM ({_PAIRS} WHERE q.vec_id % 100 = 0 AND v.vec_id % 7 <> 3) n QUALIFY place <= 5")
def mat02_index_loads(embeddings):
    """A saved index of two thirds of the rows, a fifth of them with an old vector; a load adds the others, a second one puts new vectors in place and removes rows."""
    spark, n = embeddings.sparkSession, F.col("vec_id")
    path = shared_path(spark, "vector-index")
    old = embeddings.withColumn("embedding", F.when(n % 5 == 0, F.reverse("embedding")).otherwise(F.col("embedding")))
    vectors.save_index(vectors.build_index(old.filter(n % 3 != 0)), path)
    vectors.add_rows(spark, path, old.filter(n % 3 == 0))
    vectors.add_rows(spark, path, embeddings.filter((n % 5 == 0) | (n % 7 == 3)).withColumn("embedding", F.when(n % 7 != 3, F.col("embedding"))))
    return vectors.search(vectors.load_index(spark, path), _asked(embeddings), lists_from=0)


_N = "(SELECT count(*) FROM {shops})"
_LISTED = f"SELECT vec_id AS listing_id, vec_id % {_N} AS shop_id, vec_id % 50 AS product_id, CASE WHEN vec_id % 11 <> 0 THEN concat('s', vec_id % 4) END AS sku, CASE WHEN vec_id % 13 = 1 THEN concat('x', vec_id % 30) END AS gtin, vec_id % 17 <> 0 AS active FROM {{embeddings}} WHERE vec_id % 3 <> 0"
_FRESH = f"SELECT vec_id AS listing_id, vec_id % {_N} AS shop_id, CASE WHEN vec_id % 11 <> 0 THEN concat('s', vec_id % 5) END AS sku, CASE WHEN vec_id % 4 = 0 THEN concat('x', vec_id % 40) ELSE gtin END AS gtin, mpn, label, embedding FROM {{embeddings}} LEFT JOIN {{products}} ON product_id = vec_id + 1 WHERE vec_id % 3 = 0"
_HARD = f"""SELECT listing_id, coalesce(g, l, m) AS hard FROM ({_FRESH}) f LEFT JOIN (SELECT gtin, min(product_id) AS g FROM {{products}} GROUP BY 1) a USING (gtin) LEFT JOIN (SELECT gtin, min(product_id) AS l FROM ({_LISTED}) k GROUP BY 1) b USING (gtin)
  LEFT JOIN (SELECT mpn, min(product_id) AS m FROM {{products}} GROUP BY 1) c USING (mpn)"""
_NEXT = f"SELECT f.listing_id, l.listing_id AS nearest, l.product_id AS candidate, round(1 - list_cosine_similarity(f.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS distance FROM ({_FRESH}) f JOIN {{embeddings}} v ON v.label = f.label JOIN ({_LISTED}) l ON l.listing_id = v.vec_id"
_TOLD = f"""SELECT f.listing_id, hard, candidate, distance, EXISTS (SELECT 1 FROM ({_LISTED}) o WHERE o.shop_id = f.shop_id AND o.product_id = candidate AND o.active AND (f.sku IS NULL OR o.sku <> f.sku)) AS conflict,
  CASE WHEN f.listing_id % 4 <> 1 THEN f.listing_id % 5 <> 0 END AS same, CASE WHEN f.listing_id % 4 <> 1 THEN (f.listing_id % 100) / 100 END AS verdict
  FROM ({_FRESH}) f JOIN ({_HARD}) h USING (listing_id) LEFT JOIN (SELECT * FROM ({_NEXT}) n QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY distance, nearest) = 1) b USING (listing_id)"""


_MATCHED = f"""SELECT listing_id, decision, CASE WHEN hard IS NOT NULL THEN hard WHEN decision IN ('auto_matched', 'review') THEN candidate END AS product_id,
  CASE WHEN hard IS NOT NULL OR candidate IS NULL THEN 1.0 WHEN distance <= 0.7 AND NOT conflict THEN coalesce(verdict, 0.0) ELSE 1 - distance END::DOUBLE AS confidence FROM (SELECT *,
  CASE WHEN hard IS NOT NULL THEN 'confirmed' WHEN candidate IS NULL THEN 'new' WHEN distance <= 0.7 AND NOT conflict THEN CASE WHEN coalesce(same, false) AND coalesce(verdict >= 0.5, false) THEN 'auto_matched' ELSE 'review' END ELSE 'new' END AS decision FROM ({_TOLD}) r) x"""


def _matched(embeddings, products, shops):
    n, shops_n = F.col("vec_id"), shops.count()
    listed = embeddings.filter(n % 3 != 0)
    listings = listed.select(n.alias("listing_id"), (n % shops_n).alias("shop_id"), (n % 50).alias("product_id"), F.when(n % 11 != 0, F.concat(F.lit("s"), (n % 4).cast("string"))).alias("sku"), F.when(n % 13 == 1, F.concat(F.lit("x"), (n % 30).cast("string"))).alias("gtin"), (n % 17 != 0).alias("active"))
    keys = products.select((F.col("product_id") - 1).alias("vec_id"), F.col("gtin").alias("g"), "mpn")
    new = embeddings.filter(n % 3 == 0).join(keys, "vec_id", "left").select(
        n.alias("listing_id"), (n % shops_n).alias("shop_id"), F.when(n % 11 != 0, F.concat(F.lit("s"), (n % 5).cast("string"))).alias("sku"), F.when(n % 4 == 0, F.concat(F.lit("x"), (n % 40).cast("string"))).otherwise(F.col("g")).alias("gtin"), "mpn", "label", "embedding"
    )
    verdicts = embeddings.filter((n % 3 == 0) & (n % 4 != 1)).select(n.alias("listing_id"), (n % 5 != 0).alias("same"), ((n % 100) / 100).alias("verdict"))
    return matching.match_listings(new, vectors.build_index(listed), products, listings, verdicts, near=0.7, sure=0.5)


@query("embeddings products shops", _MATCHED)
def mat04_match_listings(embeddings, products, shops):
    """A third of the rows are new listings, the others are matched; keys, nearest and conflicts are found by their operators, verdicts are given."""
    return _matched(embeddings, products, shops)


_MADE = "concat('new-', substr(sha256(listing_id::VARCHAR), 1, 16))"


def _applied(embeddings, products, shops):
    new = embeddings.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("listing_id"), F.concat(F.lit("item "), F.col("vec_id").cast("string")).alias("title"), F.col("label").alias("brand"))
    return state.apply_matches(new, written(_matched(embeddings, products, shops), "decisions"))


@query("embeddings products shops", f"""SELECT listing_id, CASE WHEN decision = 'new' THEN {_MADE} WHEN decision <> 'review' THEN product_id::VARCHAR END AS product, CASE decision WHEN 'confirmed' THEN 'confirmed' WHEN 'review' THEN 'needs_review' ELSE 'auto_matched' END AS status,
  CASE WHEN decision = 'new' THEN 1.0 ELSE confidence END::DOUBLE AS confidence FROM ({_MATCHED}) d""")
def mat05_listing_states(embeddings, products, shops):
    """What becomes of each new listing, by keys, index, conflicts and verdicts."""
    return _applied(embeddings, products, shops)[0]


@query("embeddings products shops", f"SELECT {_MADE} AS product, concat('item ', listing_id) AS title, label AS brand FROM ({_MATCHED}) d JOIN {{embeddings}} e ON e.vec_id = d.listing_id WHERE decision = 'new'")
def mat05_catalogue_additions(embeddings, products, shops):
    """The products made of listings that match none."""
    return _applied(embeddings, products, shops)[1]


@query("embeddings products shops", f"SELECT listing_id, product_id AS candidate, confidence FROM ({_MATCHED}) d WHERE decision = 'review'")
def mat08_match_reviews(embeddings, products, shops):
    """The listings whose nearest product waits for a person."""
    return _applied(embeddings, products, shops)[2]


@query("embeddings products")
def mat07_near_entities(embeddings, products):
    """Products that share keys, then the near ones of the representatives, but for what a shop's own listings tell apart; no SQL, tested by brute force."""
    n = F.col("vec_id")
    members = embeddings.select((n + 1).alias("id"), (n % 7).alias("shop"), F.when(n % 5 != 0, F.concat(F.lit("s"), (n % 3).cast("string"))).alias("sku"))
    return matching.resolve_near_entities(products, embeddings.withColumn("vec_id", n + 1), members, near=0.7)
