"""One query for each operator, over its whole table, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm import importance, language_mixture, license_index, line_index, media_jpeg, merkle, near_dedup, packing, runs, source_mix, token_scan, warc_zip, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = language_mixture.identify(docs, language_mixture.learn(docs))
    return found.select("doc_id", language_mixture.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "shares")


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_zip.archive_round_trip(_read(spark, sf_dir, "pages"), min_bytes=0)
    whole = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record was read back damaged")))
    return read.select("page_id", "payload_bytes", whole.alias("payload_digest"), "record_type", "refers_to")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), capacity=4096, closing_id=1)


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_jpeg.media_round_trip(_read(spark, sf_dir, "documents"))


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_study(_read(spark, sf_dir, "documents"))


def op5_merkle_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the trees of texts and edited texts differ, and how alike their nodes are."""
    return merkle.difference_study(_read(spark, sf_dir, "documents"))


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.replicate(_read(spark, sf_dir, "documents"), temperature=0.5)


def op7_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), shingle_size=4, percent=80)


def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.count_tokens(_read(spark, sf_dir, "documents")).select("doc_id", "document", "start", "n_tokens")


def op9_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.find_licenses(_read(spark, sf_dir, "documents"))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resampled documents: those of the k largest perturbed log-weights."""
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).filter("kept").select("doc_id", "log_weight", "n_features", "gumbel_key")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_index.dedup_lines(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", runs.looped(F.col("doc_id"), F.col("text")).alias("text"))
    # The greatest length; of several the smallest start, then period: runs come in this order, and the first of equals is taken.
    best = F.get(F.filter("runs", lambda r: r["length"] == F.array_max(F.transform("runs", lambda x: x["length"]))), 0)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (
        runs.find_runs(docs).withColumn("best", best)
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
            F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_mixture, op2_warc_zip, op3_best_fit_packing, op4_jpeg_media, op5_merkle_fingerprints, op6_poisson_mix, op7_minmax_dedup, op8_separator_scan,
        op9_license_index, op10_importance_resampling, op11_line_dedup, op12_whitened_embeddings, op13_periodic_runs, op5_merkle_differences,
    )
}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLE_SQL: dict[str, str] = {
    "op2_warc_zip": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS top, sha1(h) AS x FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', ((('0x' || substr(x, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM q""",
    "op5_merkle_fingerprints": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nx FROM d),
e AS (SELECT doc_id, t, nx, substr(t, 1, length(t) - length(t) // 4) || substr(nx, 1, length(t) // 4) AS x FROM n),
v AS (SELECT doc_id, unnest(['t', 'x', 'nx']) AS which, unnest([t, x, nx]) AS t FROM e),
s AS (SELECT doc_id, which, t, list_transform(string_split(t, chr(10)), lambda l: list_transform(regexp_extract_all(l, '[^.!?|]*[.!?|]+[ \t]*|[^.!?|]+'), lambda y: sha256(y))) AS s FROM v),
p AS (SELECT *, list_transform(s, lambda y: sha256(array_to_string(y, ','))) AS p FROM s),
c AS (SELECT *, list_transform(range((len(p) + 7) // 8), lambda k: sha256(array_to_string(p[k * 8 + 1 : k * 8 + 8], ','))) AS c FROM p),
r AS (SELECT doc_id, which, t, p, sha256(array_to_string(c, ',')) AS r, flatten(s) || p || c || [sha256(array_to_string(c, ','))] AS nodes FROM c),
h AS (SELECT doc_id, which, h, count(*) AS k FROM (SELECT doc_id, which, unnest(nodes) AS h FROM r) GROUP BY 1, 2, 3),
b AS (SELECT a.doc_id, z.which, sum(least(a.k, z.k)) AS b FROM h a JOIN h z ON a.doc_id = z.doc_id AND a.h = z.h AND a.which = 't' AND z.which <> 't' GROUP BY 1, 2)
SELECT t.doc_id, length(t.t)::BIGINT AS n_chars, sha256(x.t) AS edited_sha256, t.r AS fingerprint, x.r AS edited_fingerprint,
  list_filter(range(greatest(len(t.p), len(x.p))), lambda i: t.p[i + 1] IS DISTINCT FROM x.p[i + 1])::INT[] AS changed,
  2.0::DOUBLE * coalesce(bx.b, 0) / (len(t.nodes) + len(x.nodes)) AS near_edited, 2.0::DOUBLE * coalesce(bn.b, 0) / (len(t.nodes) + len(y.nodes)) AS near_next
FROM r t JOIN r x ON x.doc_id = t.doc_id AND x.which = 'x' JOIN r y ON y.doc_id = t.doc_id AND y.which = 'nx'
LEFT JOIN b bx ON bx.doc_id = t.doc_id AND bx.which = 'x' LEFT JOIN b bn ON bn.doc_id = t.doc_id AND bn.which = 'nx' WHERE t.which = 't'""",
    "op6_poisson_mix": """
WITH RECURSIVE v AS (SELECT source, sum(length(text)) AS v FROM documents GROUP BY 1),
r AS (SELECT source, sqrt(v) / sum(sqrt(v)) OVER () * sum(v) OVER () / v AS rate FROM v),
g AS (SELECT source, rate, greatest(1, ceil(rate / 64.0))::INT AS parts FROM r),
c AS (SELECT source, parts, rate / parts AS m, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS cdf FROM g
  UNION ALL SELECT source, parts, m, k + 1, p * m / (k + 1), cdf + p * m / (k + 1) FROM c WHERE k < m + 12 * sqrt(m) + 20),
t AS (SELECT source, any_value(parts) AS parts, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
d AS (SELECT documents.*, cdf, unnest(range(parts)) AS part FROM documents JOIN t USING (source)),
u AS (SELECT *, ('0x' || substr(md5('count-11|' || doc_id || '|' || part), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM d),
x AS (SELECT *, len(list_filter(cdf, lambda q: q <= u)) AS copies FROM u),
y AS (SELECT *, unnest(range(copies))::INT AS mix_copy FROM x)
SELECT doc_id, text, lang, source, n_chars, mix_copy, md5('order-11|' || doc_id || '|' || part || '|' || mix_copy) AS mix_key FROM y""",
    "op7_minmax_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS v, a AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a),
k AS (SELECT v, min(u) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.c, w.doc_id)::BIGINT AS component_id, w.doc_id = coalesce(k.c, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.v = w.doc_id""",
    "op11_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT doc_id, i, l, translate(regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
f AS (SELECT k, min(doc_id) AS first FROM k WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
x AS (SELECT doc_id, i, l, coalesce(doc_id > f.first, false) AS gone FROM k LEFT JOIN f USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM x GROUP BY doc_id""",
}
ORACLE_SQL["op5_merkle_differences"] = f"SELECT doc_id, fingerprint, edited_fingerprint, changed, near_edited, near_next FROM ({ORACLE_SQL['op5_merkle_fingerprints']})"
