"""Which responses set the cookies that a request sends: shared prefixes of an ordered list of setters, expanded only on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlens.functions.shared import written

_NAME = r"^\s*([^=;\s]+)"


def _names(text: F.Column) -> F.Column:
    return F.array_distinct(F.filter(F.transform(text, lambda part: F.regexp_extract(part, _NAME, 1)), lambda n: n != ""))


def capture_cookies(captures: DataFrame) -> DataFrame:
    """captures (session, seq, url, cookie: the request's header, set_cookie: the response's values) with sends and sets, the names in them."""
    sends = F.coalesce(_names(F.split("cookie", ";")), F.array().cast("array<string>"))
    return captures.select("session", "seq", "url", sends.alias("sends"), F.coalesce(_names(F.col("set_cookie")), F.array().cast("array<string>")).alias("sets"))


def dependency_prefixes(captures: DataFrame, slices: int = 64) -> tuple[DataFrame, DataFrame]:
    """setters (session, cookie, place, url) and requests (session, seq, url, cookie, n_setters).

    A request that sends a cookie depends on the first ``n_setters`` setters of it: those up to its own response. So all dependencies of a session are held in as many
    rows as it has cookies sent and set, not in one for each pair. Places and lengths are counted within slices of a session's time, plus what the slices before
    hold, so that a hot session isn't sorted in one task.
    """
    rows = capture_cookies(captures)
    sent = rows.select("session", "seq", "url", F.explode("sends").alias("cookie"), F.lit(0).alias("sets"))
    found = sent.unionByName(rows.select("session", "seq", "url", F.explode("sets").alias("cookie"), F.lit(1).alias("sets")))
    span = rows.groupBy("session").agg(F.min("seq").alias("low"), (F.max("seq") - F.min("seq") + 1).alias("long"))
    found = found.join(span, "session").withColumn("slice", F.floor((F.col("seq") - F.col("low")) * slices / F.col("long")).cast("int")).drop("low", "long")
    found = written(found, "cookies")
    per = found.groupBy("session", "cookie", "slice").agg(F.sum("sets").alias("k"))
    before = per.withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy("session", "cookie").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    # A response counts for its own request, as it is noted first.
    order = Window.partitionBy("session", "cookie", "slice").orderBy("seq", F.desc("sets"), "url").rowsBetween(Window.unboundedPreceding, 0)
    placed = found.withColumn("n", F.sum("sets").over(order)).join(before, ["session", "cookie", "slice"]).withColumn("n", F.col("n") + F.col("before"))
    setters = placed.filter("sets = 1").select("session", "cookie", F.col("n").alias("place"), "url")
    return setters, placed.filter("sets = 0").select("session", "seq", "url", "cookie", F.col("n").alias("n_setters"))


def depends_on(setters: DataFrame, requests: DataFrame) -> DataFrame:
    """session, seq, cookies_required, depends_on: of each of ``requests`` the cookies that it sends and the URLs that have set them, by name.

    The prefixes are written out here; ask for the requests that are needed, not for a whole hot session.
    """
    pairs = requests.join(setters.withColumnRenamed("url", "setter"), ["session", "cookie"], "left").filter("setter IS NULL OR place <= n_setters OR n_setters = 0")
    used = F.when((F.col("n_setters") > 0) & (F.col("place") <= F.col("n_setters")), F.col("setter"))
    return pairs.groupBy("session", "seq").agg(F.array_sort(F.collect_set("cookie")).alias("cookies_required"), F.array_sort(F.collect_set(used)).alias("depends_on"))
