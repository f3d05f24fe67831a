"""Brands and categories with ids that last: made at first sight, kept over runs, names by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.operators.ingest import slug

BRANDS, ALIASES = "brand_id string, slug string, name string", "alias string, brand_id string"
CATEGORIES, MAPS = "category_id string, path string, slug string, name string, parent_id string, depth int", "shop_id long, raw_path string, category_id string"


def no_brands(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], BRANDS), spark.createDataFrame([], ALIASES)


def no_categories(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], CATEGORIES), spark.createDataFrame([], MAPS)


def _id(kind: str, text: Column) -> Column:
    """An id from what it names, so that every run and every order of rows gives the same."""
    return F.substring(F.sha2(F.concat(F.lit(f"{kind}|"), text), 256), 1, 16)


def _trimmed(text: Column) -> Column:
    """Without white space at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def resolve_brands(brands: DataFrame, aliases: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(brands, aliases, resolved) after ``rows`` (row_id, brand, ts), as if these came one by one in order of ts; resolved: row_id, brand_id.

    A known alias, the slug of the trimmed name, names its brand. An unknown one makes an alias, and a brand unless one has that slug, which then takes the row's name.
    A null or blank brand has none.
    """
    named = rows.select("row_id", "ts", _trimmed(F.col("brand")).alias("name"))
    spelled = named.filter("name IS NOT NULL").groupBy("name").agg(F.min("ts").alias("ts")).withColumn("alias", slug(F.col("name")))
    fresh = spelled.groupBy("alias").agg(F.min_by("name", F.struct("ts", "name")).alias("new")).join(aliases.select("alias"), "alias", "left_anti")
    both = brands.join(fresh.withColumnRenamed("alias", "slug"), "slug", "full")
    out = both.select(F.coalesce("brand_id", _id("brand", F.col("slug"))).alias("brand_id"), "slug", F.coalesce("new", "name").alias("name"))
    made = fresh.select("alias").join(out.select(F.col("slug").alias("alias"), "brand_id"), "alias")
    known = aliases.select("alias", "brand_id").unionByName(made)
    by_name = spelled.select("name", "alias").join(known, "alias", "left").select("name", "brand_id")
    return out, known, named.join(by_name, "name", "left").select("row_id", "brand_id")


def resolve_categories(categories: DataFrame, maps: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(categories, maps, resolved) after ``rows`` (row_id, shop_id, category: an array of names, ts), as if these came one by one; resolved: row_id, category_id.

    A path that its shop has used before is known by the map. Another makes each of its ancestors and itself, by slugs, and names those that are there as it spells them.
    """
    clean = F.filter(F.transform("category", _trimmed), lambda x: x.isNotNull())
    paths = rows.select("row_id", "shop_id", "ts", clean.alias("names")).withColumn("raw_path", F.when(F.size("names") > 0, F.array_join("names", " / ")))
    used = paths.filter("raw_path IS NOT NULL").groupBy("shop_id", "raw_path").agg(F.min("ts").alias("ts"), F.min("names").alias("names"))
    known = maps.select(F.col("shop_id").alias("s"), F.col("raw_path").alias("p"))
    fresh = used.join(known, F.col("shop_id").eqNullSafe(F.col("s")) & (F.col("raw_path") == F.col("p")), "left_anti")
    each = fresh.select("shop_id", "raw_path", "ts", F.posexplode("names").alias("depth", "name"))
    slugs = each.select("name").distinct().withColumn("slug", slug(F.col("name")))
    each = each.join(slugs, "name")
    chain = each.groupBy("shop_id", "raw_path", "ts").agg(F.array_sort(F.collect_list(F.struct("depth", "slug", "name"))).alias("c"))
    path = lambda n: F.array_join(F.transform(F.slice("c", F.lit(1), n), lambda x: x["slug"]), "/")
    steps = chain.select("shop_id", "raw_path", "ts", F.explode(F.transform("c", lambda x: F.struct(path(x["depth"] + 1).alias("path"), F.when(x["depth"] > 0, path(x["depth"])).alias("parent"), x["slug"].alias("slug"), x["name"].alias("name"), x["depth"].alias("depth")))).alias("x"))
    new = steps.groupBy("x.path").agg(F.max_by(F.struct("x.parent", "x.slug", "x.name", "x.depth"), F.struct("ts", "raw_path", F.coalesce("shop_id", F.lit(-1).cast("long")), "x.name")).alias("n"))
    both = categories.withColumn("there", F.lit(True)).join(new, "path", "full")
    mine = lambda c, made: F.when(F.col("there"), F.col(c)).otherwise(made).alias(c)
    ids = both.select(F.coalesce("category_id", _id("category", F.col("path"))).alias("category_id"), "path", mine("slug", F.col("n.slug")), F.coalesce("n.name", "name").alias("name"), "parent_id", F.col("n.parent").alias("parent"), mine("depth", F.col("n.depth")), "there")
    above = ids.select(F.col("path").alias("parent"), F.col("category_id").alias("above"))
    out = ids.join(above, "parent", "left").select("category_id", "path", "slug", "name", F.when(F.col("there"), F.col("parent_id")).otherwise(F.col("above")).alias("parent_id"), F.col("depth").cast("int").alias("depth"))
    leaf = chain.select("shop_id", "raw_path", path(F.size("c")).alias("path")).join(out.select("path", "category_id"), "path")
    mapped = maps.select("shop_id", "raw_path", "category_id").unionByName(leaf.select("shop_id", "raw_path", "category_id"))
    by = mapped.select(F.col("shop_id").alias("s"), F.col("raw_path").alias("p"), "category_id")
    found = paths.join(by, F.col("shop_id").eqNullSafe(F.col("s")) & (F.col("raw_path") == F.col("p")), "left")
    return out, mapped, found.select("row_id", "category_id")
