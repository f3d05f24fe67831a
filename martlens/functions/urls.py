"""URL references resolved as RFC 3986 (section 5.2) says, and normalised as browsers do: column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: it becomes the variable of a lambda, where a column's tree would be copied at each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(url: Column) -> Column:
    """Struct of scheme, authority with its slashes, path, query with its mark, fragment with its mark; each empty where it isn't there."""
    part = lambda rest, pattern: F.regexp_extract(rest, pattern, 1)

    def split(s: Column) -> Column:
        return F.struct(
            s["scheme"].alias("scheme"), part(s["rest"], "^(//[^/?#]*)").alias("authority"), part(s["rest"], "^(?://[^/?#]*)?([^?#]*)").alias("path"),
            part(s["rest"], r"^[^?#]*(\?[^#]*)").alias("query"), part(s["rest"], "(?s)^[^#]*(#.*)$").alias("fragment"),
        )

    def cut(url: Column) -> Column:
        return let(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1), lambda scheme: let(F.struct(scheme.alias("scheme"), F.when(scheme == "", url).otherwise(F.substr(url, F.length(scheme) + 2)).alias("rest")), split))

    return let(url, cut)


def without_dots(path: Column) -> Column:
    """A path that begins with a slash without its segments ``.`` and ``..``; others as they are."""
    none = F.array().cast("array<string>")

    def folded(segments: Column) -> Column:
        step = lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
        kept = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), none, step)
        folder = F.get(segments, F.size(segments) - 1).isin(".", "..")
        return let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(folder & (F.size(k) > 0), "/").otherwise("")))

    return let(path, lambda p: F.when(p.startswith("/") & p.contains("/."), let(F.split(p, "/"), folded)).otherwise(p))


def resolve_reference(reference: Column, base: Column) -> Column:
    """The target of ``reference`` on the page ``base``, an absolute URL; its fragment is kept."""
    ref = F.regexp_replace(F.regexp_replace(reference, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), "[\\t\\n\\r]", "")

    def target(r: Column, b: Column) -> Column:
        merged = F.when((b["authority"] != "") & (b["path"] == ""), F.concat(F.lit("/"), r["path"])).otherwise(F.concat(F.regexp_replace(b["path"], "[^/]*$", ""), r["path"]))
        rooted = without_dots(F.when((r["scheme"] != "") | (r["authority"] != "") | r["path"].startswith("/"), r["path"]).otherwise(merged))
        same = (r["scheme"] == "") & (r["authority"] == "") & (r["path"] == "")
        scheme = F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"])
        authority = F.when((r["scheme"] != "") | (r["authority"] != ""), r["authority"]).otherwise(b["authority"])
        query = F.when(same & (r["query"] == ""), b["query"]).otherwise(r["query"])
        return F.concat(scheme, F.lit(":"), authority, F.when(same, b["path"]).otherwise(rooted), query, r["fragment"])

    return let(_parts(ref), lambda r: let(_parts(base), lambda b: target(r, b)))


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, a slash for an empty path; for http and https, other URLs only their scheme."""

    def normal(u: Column, p: Column) -> Column:
        low = F.lower(p["scheme"])
        user, host = F.regexp_extract(p["authority"], "^//(.*@)?[^@]*$", 1), F.lower(F.regexp_extract(p["authority"], "([^/@]*)$", 1))
        host = F.regexp_replace(host, F.when(low == "https", r":(443)?$").otherwise(r":(80)?$"), "")
        web = F.concat(low, F.lit("://"), user, host, F.when(p["path"] == "", "/").otherwise(without_dots(p["path"])), p["query"], p["fragment"])
        return F.when(low.isin("http", "https") & (p["authority"] != ""), web).when(low != "", F.concat(low, F.substr(u, F.length(low) + 1))).otherwise(u)

    return let(url, lambda u: let(_parts(u), lambda p: normal(u, p)))


def host_of(url: Column) -> Column:
    """Host of a normalised URL, with its port where that isn't the default."""
    return F.regexp_extract(url, "^https?://(?:[^/?#@]*@)?([^/?#]+)", 1)
