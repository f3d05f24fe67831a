"""State tables: listing pages, endpoints, observations, match decisions, recipe candidates and probes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlens.functions.hierarchy import ancestor_paths
from martlens.functions.latest import ranked
from martlens.functions.shared import tasks_for, written
from martlens.operators.pages import normalize_domain


def append_observations(rows: DataFrame, path: str, by: str = "yyyy-MM-dd") -> None:
    """Appends facts with a time ``ts`` to the Parquet table at ``path``, in a folder for each day (or other span) of capture."""
    rows.withColumn("capture_date", F.date_format("ts", by)).write.mode("append").partitionBy("capture_date").parquet(path)


def save_results(rows: DataFrame, path: str) -> DataFrame:
    """Result rows as lines of JSON at ``path``, and these read again."""
    rows.write.mode("append").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def upsert_listing_pages(state: DataFrame, found: DataFrame) -> DataFrame:
    """Listing pages (shop_id, url, label, parent, active) after what discovery found (shop_id, url, name, parent_name).

    Found pages are active again and take label and parent, the page of that name found in the same shop; others stay as they are. Of
    several found rows of a URL the last name counts.
    """
    tasks = max(tasks_for(state), tasks_for(found))
    last = found.repartition(tasks, "shop_id", "url").groupBy("shop_id", "url").agg(F.max_by("parent_name", "name").alias("parent_name"), F.max("name").alias("name"))
    names = last.groupBy("shop_id", F.col("name").alias("parent_name")).agg(F.max("url").alias("new_parent"))
    new = last.repartition(tasks, "shop_id", "parent_name").join(names.repartition(tasks, "shop_id", "parent_name"), ["shop_id", "parent_name"], "left").repartition(tasks, "shop_id", "url").select("shop_id", "url", F.col("name").alias("new_label"), "new_parent")
    both = state.repartition(tasks, "shop_id", "url").join(new, ["shop_id", "url"], "full")
    return both.select("shop_id", "url", F.coalesce("new_label", "label").alias("label"), F.coalesce("new_parent", "parent").alias("parent"), (F.col("new_label").isNotNull() | F.coalesce("active", F.lit(False))).alias("active"))


def category_breadcrumbs(pages: DataFrame) -> DataFrame:
    """id and path of labels from the root of each page (id, parent_id, label), however deep; a chain that comes back to a page it has seen ends there."""
    return ancestor_paths(pages)


def upsert_endpoints(state: DataFrame, recipes: DataFrame, captures: DataFrame, most: int = 5, least: int = 40) -> DataFrame:
    """Endpoints (shop_id, url, method, score, active) after a discovery: each shop's recipe (shop_id, url, method, score) and its best captures.

    At most ``most`` captures of a score from ``least`` on, other than the recipe's URL; of several of a URL and method the best stays.
    """
    top = captures.filter(F.col("score") >= least).withColumn("place", ranked(["shop_id"], F.col("score").desc(), F.col("url"), F.col("method"))).filter(F.col("place") <= most)
    top = top.join(recipes.select("shop_id", "url"), ["shop_id", "url"], "left_anti").groupBy("shop_id", "url", "method").agg(F.max("score").alias("score"))
    new = recipes.select("shop_id", "url", "method", "score").unionByName(top.select("shop_id", "url", "method", "score")).withColumn("is_new", F.lit(True)).withColumnRenamed("score", "new_score")
    both = state.join(new, ["shop_id", "url", "method"], "full")
    return both.select("shop_id", "url", "method", F.when(F.col("is_new"), F.col("new_score")).otherwise(F.col("score")).alias("score"), (F.coalesce("is_new", F.lit(False)) | F.coalesce("active", F.lit(False))).alias("active"))


def sync_endpoints(state: DataFrame, recipes: DataFrame) -> DataFrame:
    """Endpoints after a change of the active recipe: of the shops of ``recipes`` only the recipe's endpoint is active."""
    changed = recipes.select("shop_id").distinct().withColumn("changed", F.lit(True))
    idle = state.join(changed, "shop_id", "left").withColumn("active", F.col("active") & F.col("changed").isNull()).drop("changed")
    return upsert_endpoints(idle, recipes, recipes.select("shop_id", "url", "method", "score").limit(0))


def route_adapters(shops: DataFrame) -> DataFrame:
    """shop_id, adapter, sitemaps of shops (shop_id, mode, listing_pages, has_api, built_in, sitemap, pattern): which way their products are taken."""
    c = F.col
    lists = c("mode").isin("listing_pages", "jina_categories") & (F.coalesce("listing_pages", F.lit(0)) > 0)
    adapter = F.when(lists, c("mode")).when((c("mode") == "api") & c("has_api"), "api").when(c("built_in"), "built_in").when((c("sitemap") != "") & (c("pattern") != ""), "sitemap").otherwise("none")
    maps = F.filter(F.transform(F.split(F.coalesce("sitemap", F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return shops.select("shop_id", adapter.alias("adapter"), F.when(adapter == "sitemap", F.size(maps)).otherwise(0).alias("sitemaps"))


# The largest distance that is looked at, and the confidence from which a verdict counts.
REVIEW_DISTANCE, CONFIRMED = 0.28, 0.85


def decide_matches(rows: DataFrame, near: float = REVIEW_DISTANCE, sure: float = CONFIRMED) -> DataFrame:
    """listing_id, decision, product_id, confidence of rows (listing_id, hard, candidate, distance, conflict, same, verdict).

    hard: a product by a shared key; candidate, distance: the nearest product; same, verdict: what an external judge says of it, null
    where it says nothing.
    """
    c = F.col
    agreed = F.coalesce(c("same"), F.lit(False)) & F.coalesce(c("verdict") >= sure, F.lit(False))
    hard, none, close = c("hard").isNotNull(), c("candidate").isNull(), c("distance") <= near
    decision = F.when(hard, "confirmed").when(none, "new").when(close & ~c("conflict"), F.when(agreed, "auto_matched").otherwise("review")).otherwise("new")
    confidence = F.when(hard | none, 1.0).when(close & ~c("conflict"), F.coalesce("verdict", F.lit(0.0))).otherwise(1 - c("distance"))
    return rows.select("listing_id", decision.alias("decision"), F.when(hard, c("hard")).when(decision.isin("auto_matched", "review"), c("candidate")).alias("product_id"), confidence.alias("confidence"))


def apply_matches(listings: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Listings with product, status and confidence; the products made of new listings, named by a hash of the listing; the review rows."""
    made = F.concat(F.lit("new-"), F.substring(F.sha2(F.col("listing_id").cast("string"), 256), 1, 16))
    known = F.col("product_id").cast("string")
    linked = F.when(F.col("decision") == "new", made).when(F.col("decision") != "review", known)
    status = F.when(F.col("decision") == "confirmed", "confirmed").when(F.col("decision") == "review", "needs_review").otherwise("auto_matched")
    state = listings.join(decisions, "listing_id").select("listing_id", linked.alias("product"), status.alias("status"), F.when(F.col("decision") == "new", 1.0).otherwise(F.col("confidence")).alias("confidence"))
    new = listings.join(decisions.filter("decision = 'new'").select("listing_id"), "listing_id").select(made.alias("product"), "title", "brand")
    review = decisions.filter("decision = 'review'").select("listing_id", F.col("product_id").alias("candidate"), "confidence")
    return state, new, review


def backfill(products: DataFrame, listings: DataFrame, columns: list[str]) -> DataFrame:
    """Products with null ``columns`` filled from the first of their listings (product_id, listing_id, ...) that has a value; others stay."""
    first = listings.groupBy("product_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("listing_id"))).alias(f"{c}_") for c in columns])
    joined = products.join(first, "product_id", "left")
    return joined.select("product_id", *[F.coalesce(c, f"{c}_").alias(c) for c in columns])


def select_candidates(rows: DataFrame, least: float = 0.7) -> DataFrame:
    """site, chosen, score of rows (site, mode, confidence, sitemaps, pattern, pack_used, pack_confidence): the platform's pack or static discovery.

    A static discovery with sitemaps and a pattern counts 0.6 at least. A validated pack wins over sitemaps alone, and over a static API
    recipe if it is not worse.
    """
    c = F.col
    static = F.when((c("mode") != "api") & (c("sitemaps") > 0) & (F.coalesce("pattern", F.lit("")) != ""), F.greatest(c("confidence"), F.lit(0.6))).otherwise(c("confidence"))
    pack = c("pack_used") & F.coalesce(c("pack_confidence") >= least, F.lit(False)) & ((c("mode") != "api") | (c("pack_confidence") >= static))
    return rows.select("site", F.when(pack, "platform_pack").otherwise("static_site").alias("chosen"), F.when(pack, c("pack_confidence")).otherwise(static).alias("score"))


# Where an answer may state how many products there are.
TOTALS = ["total", "count", "total_count", "pagination.total", "pagination.totalResults", "meta.total", "data.total"]


def validate_probes(probes: DataFrame, per_page: int, least_size: int = 10, samples: int = 3) -> DataFrame:
    """Report by recipe of its probe answers (recipe, kind, page, body): reliability, size, pagination, fields, confidence, what fails, ok.

    kind attempt: the three tries of page 1; kind page: pages 1 and 2. A body is {"products": [{id, title, price, url}], ...}.
    """
    item = "array<struct<id:string,title:string,price:double,url:string>>"
    total = F.coalesce(*[F.try_variant_get(F.try_parse_json("body"), f"$.{p}", "long") for p in TOTALS])
    rows = probes.select("recipe", "kind", "page", F.coalesce(F.from_json(F.get_json_object("body", "$.products"), item), F.array().cast(item)).alias("p"), F.when(total > 0, total).alias("total"))
    good = F.filter("p", lambda x: (x["title"] != "") & x["price"].isNotNull() & (x["url"] != ""))
    one = (F.col("kind") == "page") & (F.col("page") == 1)
    two = (F.col("kind") == "page") & (F.col("page") == 2)
    pick = lambda test, value: F.max_by(F.when(test, value), F.when(test, 1))
    per = rows.groupBy("recipe").agg(
        F.count(F.when((F.col("kind") == "attempt") & (F.size("p") > 0), 1)).alias("fine"), pick(one, F.size("p")).alias("n1"), pick(one, F.col("total")).alias("total"), pick(one, F.transform(good, lambda x: x["url"])).alias("u1"), pick(two, F.transform(good, lambda x: x["url"])).alias("u2"),
        pick(one, F.size(good)).alias("samples"),
    )
    c = F.col
    n1 = F.coalesce("n1", F.lit(0))
    size = F.coalesce("total", F.when(n1 >= per_page, F.greatest(n1, F.lit(2 * per_page))).otherwise(n1)).cast("long")
    paged = (n1 == 0) | (n1 < per_page) | (F.size(F.array_except(F.coalesce("u2", F.array().cast("array<string>")), F.coalesce("u1", F.array().cast("array<string>")))) > 0)
    complete = F.coalesce(c("samples") > 0, F.lit(False))
    out = per.select("recipe", (c("fine") / 3).alias("reliability"), size.alias("size"), paged.alias("paged"), F.least(F.coalesce("samples", F.lit(0)), F.lit(samples)).alias("samples"), complete.alias("complete"))
    confidence = c("reliability") * 0.35 + F.when(c("size") >= least_size, 0.35).otherwise(0.0) + F.when(c("paged"), 0.15).otherwise(0.0) + F.when(c("complete"), 0.15).otherwise(0.0)
    out = out.withColumn("confidence", F.least(F.lit(1.0), confidence))
    fails = [(c("reliability") < 0.9, "low_reliability"), (c("size") < least_size, "catalog_too_small"), (~c("paged"), "pagination_not_verified"), (c("samples") < min(2, samples), "insufficient_samples"), (~c("complete"), "incomplete_fields"), (c("confidence") < 0.7, "low_confidence")]
    return out.withColumn("failures", F.array_join(F.array_compact(F.array(*[F.when(t, n) for t, n in fails])), ",")).withColumn("ok", F.col("failures") == "")


# Parameters of pages, offsets and cursors that are tried, in this order.
TRIALS = [("page", p) for p in ("page", "p", "pageNumber", "page_no", "pg")] + [("offset", p) for p in ("offset", "start", "from", "skip")] + [("cursor", p) for p in ("cursor", "after", "page_cursor", "next_cursor")] + [("link_rel", "")]


def detect_pagination(trials: DataFrame) -> DataFrame:
    """recipe, style, param: the first trial in the fixed order whose page 2 has an id that page 1 lacks (recipe, style, param, page, id)."""
    order = F.coalesce(*[F.when((F.col("style") == s) & (F.col("param") == p), k) for k, (s, p) in enumerate(TRIALS)])
    rows = trials.filter(F.coalesce(F.col("id") != "", F.lit(False))).withColumn("ordinal", order)
    # One aggregation by id, then one by trial: no join, so that nothing is sent to the tasks whole.
    ids = rows.groupBy("recipe", "ordinal", "style", "param", "id").agg(F.max(F.col("page") == 1).alias("one"), F.max(F.col("page") == 2).alias("two"))
    tried = ids.groupBy("recipe", "ordinal", "style", "param").agg(F.max("one").alias("answered"), F.max(F.col("two") & ~F.col("one")).alias("more")).filter("answered AND more")
    best = tried.groupBy("recipe").agg(F.min_by(F.struct("style", "param"), "ordinal").alias("b"))
    return best.select("recipe", "b.style", "b.param")


def merge_shops(shops: DataFrame, children: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shops (shop_id, domain, created), one for each normalised domain, the oldest; children (child_id, shop_id, unique_key) repointed, versions of winners.

    Where several children of a winner share a unique key, the winner's own stays, else that of the smallest id.
    """
    domain = normalize_domain(F.lower("domain"))
    w = Window.partitionBy("d").orderBy("created", "shop_id")
    named = shops.withColumn("d", domain).withColumn("winner", F.first("shop_id").over(w)).select("shop_id", "winner")
    moved = children.join(named, "shop_id").withColumn("rn", ranked(["winner", "unique_key"], (F.col("shop_id") != F.col("winner")).cast("int"), F.col("child_id"))).filter("rn = 1")
    winners = named.filter("shop_id = winner").select("shop_id")
    return shops.join(winners, "shop_id"), moved.select("child_id", F.col("winner").alias("shop_id"), "unique_key"), versions.join(winners, "shop_id", "left_semi")


@dataclass(frozen=True)
class Child:
    """A table with rows of a shop: its key, the column that names the shop, and which further columns make a row unique within one.

    purged: rows of shops that go are dropped, not given to the winner. unique: null if rows never collide.
    """

    table: str
    key: str
    shop: str = "shop_id"
    unique: tuple[str, ...] | None = None
    purged: bool = False


# The tables that name a shop, and their unique columns beside it.
CHILDREN = [
    Child("org_competitors", "id", unique=("org_id",)), Child("listing_pages", "id", unique=("url",)), Child("endpoints", "id", unique=("url", "method")), Child("shop_categories", "id", unique=("raw_path",)), Child("recipe_versions", "id", purged=True),
    Child("health_reports", "id"), Child("repairs", "id"), Child("crawl_runs", "id"), Child("listings", "id"), Child("signals", "id"), Child("onboarding", "id"), Child("orgs", "id", shop="own_shop_id"),
]


def shop_winners(shops: DataFrame) -> DataFrame:
    """from_id, to_id of shops (shop_id, domain, created) whose normalised domain an older one has; without a time a shop is the youngest.

    The winner of a domain is the least of an aggregation, so that a domain of very many shops makes no task of its own.
    """
    named = shops.withColumn("d", normalize_domain(F.lower("domain"))).filter("d IS NOT NULL AND d <> ''")
    first = named.groupBy("d").agg(F.min_by("shop_id", F.struct(F.col("created").isNull(), "created", "shop_id")).alias("to_id"))
    return named.join(first, "d").filter("shop_id <> to_id").select(F.col("shop_id").alias("from_id"), "to_id")


def merge_by_catalogue(shops: DataFrame, tables: dict[str, DataFrame], catalogue: list[Child] = CHILDREN) -> dict[str, DataFrame]:
    """``tables`` and "shops" after shops of one domain are merged: one mapping, applied to each table of ``catalogue`` by its own rule.

    Of rows that would share their unique columns the winner's own stay, else that with the least key. Tables that ``catalogue`` doesn't name stay.
    """
    mapping = written(shop_winners(shops), "merged-shops")
    moved = mapping.select(F.col("from_id").alias("gone"), "to_id")
    out = {name: df for name, df in tables.items()} | {"shops": shops.join(mapping.select(F.col("from_id").alias("shop_id")), "shop_id", "left_anti")}
    for child in catalogue:
        if child.table not in tables:
            continue
        df = tables[child.table]
        rows = df.join(moved, F.col(child.shop) == F.col("gone"), "left")
        if child.purged:
            out[child.table] = rows.filter("gone IS NULL").select(*df.columns)
            continue
        to = rows.withColumn(child.shop, F.coalesce("to_id", child.shop)).withColumn("came", F.col("gone").isNotNull())
        if child.unique:
            # Only rows whose winner takes others in can collide, and, as in SQL, none with a null among the unique columns.
            taking = moved.select(F.col("to_id").alias("taking")).distinct()
            marked = to.join(taking, F.col(child.shop) == F.col("taking"), "left").withColumn("can", F.col("taking").isNotNull())
            for c in child.unique:
                marked = marked.withColumn("can", F.col("can") & F.col(c).isNotNull())
            still, met = marked.filter("NOT can").select(*df.columns), marked.filter("can")
            best = met.groupBy(child.shop, *child.unique).agg(F.min(F.struct("came", F.col(child.key).alias("k"))).alias("best"))
            same = [F.col(f"m.{c}") == F.col(f"b.{c}") for c in (child.shop, *child.unique)]
            kept = met.alias("m").join(best.alias("b"), same).filter((~F.col("came")) | (F.col("best.came") & (F.col(f"m.{child.key}") == F.col("best.k"))))
            to = still.unionByName(kept.select(*[F.col(f"m.{c}").alias(c) for c in df.columns]))
        out[child.table] = to.select(*df.columns)
    return out
