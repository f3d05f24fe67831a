"""The operators against brute force, and on the rows that tables rarely have."""

import base64
import hashlib
import io
import math
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from martlens.llm import common, importance, language_mixture, license_index, media_jpeg, merkle, near_dedup, packing, source_mix, token_scan, tokens, warc_zip

DOCS = "doc_id long, text string, lang string, source string, n_chars long, page_id string, kept string"
LONG = " ".join(f"word{i} and" for i in range(6000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, a null and a repeated doc_id, clashing columns."""
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (5, "one two"), (5, "Three other words here now"), (None, "one two"), (6, LONG), (7, LONG + " tail"), (8, "日本語 ½ İx <|endoftext|>"), (9, "a\nb\n\nc | d. e")]
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, None if k % 3 else "s", 1, "x", "y") for k, (i, t) in enumerate(texts)], DOCS)


def brute_sets(texts, size):
    out = []
    for t in texts:
        ws = bytes((t or "").encode()).lower().split()
        out.append({tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set())
    return out


def brute_components(ids, sets, percent=80):
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if ids[i] is not None and ids[j] is not None and (ids[i] == ids[j] and sets[i] and sets[j] or both and 100 * both >= percent * len(sets[i] | sets[j])):
                label[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [d if d is None or not sets[i] else best[find(i)] for i, d in enumerate(ids)]


@pytest.mark.parametrize("small", [24, 2])
def test_near_duplicates_odd_rows(spark, odd, small):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd, 4, small=small).collect())
    rows = odd.select("doc_id", "text").collect()
    sets = brute_sets([r.text for r in rows], 4)
    comp = brute_components([r.doc_id for r in rows], sets)
    assert got == sorted((r.doc_id is not None, r.doc_id or 0, len(s), c, r.doc_id == c or r.doc_id is None) for r, s, c in zip(rows, sets, comp, strict=True))


def test_near_duplicates_chain_and_large_group(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(80):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(1, 8)):
            w[k] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 4, small=4, wave_pairs=500).collect()}
    assert got == dict(enumerate(brute_components(list(range(80)), brute_sets(texts, 4))))


def test_near_duplicates_main_component_changes(spark):
    """A bucket whose main component changes after the first wave: the only link of the first main one is due to one of its rows then."""
    scale, shift = np.random.default_rng(7).integers(0, 1 << 63, (2, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    vocabulary = [f"w{i}" for i in range(300)]
    bounds = np.cumsum([0, *map(len, vocabulary)])
    hashes, _ = near_dedup.shingles(*near_dedup.words(np.frombuffer("".join(vocabulary).encode(), np.uint8), bounds), 1)
    order = [vocabulary[i] for i in np.argsort(hashes * scale[0] + shift[0])]
    ends, line = [order[0], order[-1]], order[1:-1]  # with both ends, all sets are in the one bucket
    turn = {r.id: r.t for r in spark.range(2000).select("id", F.expr("pmod(xxhash64(id), 2)").alias("t")).collect()}
    first = iter([i for i in range(1, 1000) if turn[i] == 0])
    second = iter([i for i in range(1000, 2000) if turn[i] == 1])
    text = lambda at, own=None: " ".join(ends + line[at : at + 60] + ([line[200 + own]] if own is not None else []))
    texts = {0: text(0), next(first): text(5), next(second): text(10)}
    texts |= {next(first): text(0, k) for k in range(10)}
    texts |= {next(first if k % 2 else second): text(15, 20 + k) for k in range(40)}
    ids = sorted(texts)
    want = dict(zip(ids, brute_components(ids, brute_sets([texts[i] for i in ids], 1)), strict=True))
    assert set(want.values()) == {0}
    df = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    # 53 sets, 41 of them outside the main component: two waves.
    found = near_dedup.near_duplicates(df, 1, bands=1, width=2, small=4, wave_pairs=53 * 41 // 2 + 1)
    assert {r.doc_id: r.component_id for r in found.collect()} == want


def test_odd_width_is_refused(spark, odd):
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(odd, width=3)


def packed(df):
    rows = sorted(df.collect(), key=lambda r: (r.sequence_id, r.offset))
    at = {}
    for r in rows:
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(v <= 4096 for v in at.values())
    return rows, len(at)


def test_packing_odd_rows(spark, odd):
    rows, n = packed(packing.pack(odd, rows_per_task=3))
    encoder = tokens.Encoder(tokens.default_path())
    want = []
    for r in odd.collect():
        raw = encoder.whole([r.text or ""])[0] + np.array([1], "<u4").tobytes()
        want += [(r.doc_id or 0, k, 4096 * k, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(raw[a : a + 4 * 4096] for a in range(0, len(raw), 4 * 4096))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert n <= -(-sum(w[3] for w in want) // 4096) + 1


def test_packing_many_tiny(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    rows, n = packed(packing.pack(df, rows_per_task=700))
    assert len(rows) == 3000 and n <= 4


def test_tokens_equal_the_tokenizer():
    texts = ["a'b it's 'sun !!'s", "x²y ½", "İstanbul", "日本語 12a3", "", "ﬁn Ångström ×÷", "a_b__c-_d", None, "don't we'll I'D", "naïve\x1c x", "<|endoftext|> x"]
    encoder = tokens.Encoder(tokens.default_path())
    got = []
    for _, _, ids, counts in encoder.encode(pa.array(texts)):
        cut = np.concatenate([[0], np.cumsum(counts)])
        got += [ids[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)]
    assert got == [np.frombuffer(x, "<u4").tolist() for x in encoder.whole([t or "" for t in texts])]


def test_languages(spark, odd):
    texts = {"en": "the cat sat on the mat with the other animals ", "de": "der hund und die katze sind nicht über ßtraße ", "fr": "le chat est très près de là où étaient "}
    rows = [(i, t * 8, k) for i, (k, t) in enumerate(list(texts.items()) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_mixture.learn(docs)
    got = {r.doc_id: r for r in language_mixture.identify(docs, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows)
    mixed = spark.createDataFrame([(0, texts["en"] * 20 + texts["de"] * 20), (1, "12 !"), (2, None), (3, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in language_mixture.identify(mixed, model).collect()}
    assert set(out[0].languages) == {"en", "de"} and 0.3 < out[0].score < 0.7
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (1, 2, 3))
    assert language_mixture.identify(odd, ([], language_mixture.Table(*[np.zeros(0)] * 4))).filter("lang_pred <> 'und'").count() == 0
    assert language_mixture.identify(odd, model).count() == odd.count()
    assert language_mixture.in_one_language(odd, model).columns == odd.columns


def test_zip_directories():
    for wide in (True, False):
        w = warc_zip.ZipWriter(wide)
        raw = b"".join([*w.member("a", iter([b"xx", b"yy"])), *w.member("b/c", iter([b"PK\x05\x06", b"123"])), w.close()])
        assert zipfile.ZipFile(io.BytesIO(raw)).read("b/c") == b"PK\x05\x06123"
        with pa.BufferReader(raw) as f:
            for name, method, offset, size in warc_zip.central_directory(f, f.size()):
                start = warc_zip.member_start(f, offset)
                assert method == 0 and raw[start : start + size] == zipfile.ZipFile(io.BytesIO(raw)).read(name)


def test_warc_odd_rows(spark):
    rows = [(1, "http://a\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (4, "u", ""), (None, "u", "alone"), (None, "u", "same"), (5, "u", "ünï" * 50000)]
    got = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in warc_zip.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want, payloads = [], [(p, (h or "").encode()) for p, _, h in rows]
    for p, h in payloads:
        top = max((q for q, g in payloads if g == h and q is not None), default=None)
        revisit = top is not None and p != top
        want.append((p or 0, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", top if revisit else None, True))
    assert got == sorted(want)


def test_jpeg_round_trip_and_generic_decoder(spark, odd, monkeypatch):
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, 576 * k, np.uint8).tobytes() for k in (1, 2, 9)] + [b"\xff" * 576, bytes(range(256)) * 9]
    for rows in (8191, 4):
        monkeypatch.setattr(media_jpeg, "_ROWS", rows)
        assert [b"".join(i.tobytes() for i in own) for own in media_jpeg.thumbnails(media_jpeg.write(payloads))] == payloads
    monkeypatch.undo()
    for r, got in zip(odd.select("text").collect(), media_jpeg.media_features(media_jpeg.store_texts(odd.coalesce(1))).collect(), strict=True):
        raw = (r.text or "").encode()
        whole = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))


def test_merkle_edits(spark, odd):
    rows = merkle.edit_study(odd, rows_per_task=3).collect()
    assert len(rows) == odd.count()
    ordered = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, len(r.text or "")))
    texts = [r.text or "" for r in ordered]
    want = sorted(((r.doc_id or 0), hashlib.sha256((t[: len(t) - len(t) // 4] + texts[(k + 1) % len(texts)][: len(t) // 4]).encode()).hexdigest()) for k, (r, t) in enumerate(zip(ordered, texts, strict=True)))
    assert sorted(((r.doc_id or 0), r.edited_sha256) for r in rows) == want
    # A row of each odd one, equal rows too; equal texts have equal fingerprints.
    by_text = {}
    for r in rows:
        by_text.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by_text[4] <= by_text[None] and len(by_text[5]) == 2


def test_merkle_differences(spark, odd):
    import duckdb

    from martlens.llm.queries import ORACLE_SQL, op5_merkle_differences

    want = duckdb.sql(ORACLE_SQL["op5_merkle_differences"].replace("FROM documents", "FROM '/root/testdata/sf0.001/documents.parquet'")).fetchall()
    plain = lambda r: (r[0], r[1], r[2], list(r[3]), round(r[4], 9), round(r[5], 9))
    got = op5_merkle_differences(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(plain, got)) == sorted(map(plain, want))
    assert merkle.difference_study(odd, rows_per_task=3).count() == odd.count()
    # A sentence changed in paragraph 17, sentences repeated, sentences in another order.
    lines = [f"p{i}. q{i}. r{i}" for i in range(30)]
    cases = [(lines, lines, [], 1.0), (lines, [*lines[:17], "p17. new. r17", *lines[18:]], [17], None), (["a. b"], ["a. a. b"], [0], None), (["a. b. c"], ["b. a. c"], [0], None)]
    df = spark.createDataFrame([(k, "\n".join(a), "\n".join(b)) for k, (a, b, _, _) in enumerate(cases)], "k int, a string, b string")
    parts = lambda c: merkle.paragraph_nodes(merkle.sentence_nodes(F.col(c)))
    nodes = lambda c: merkle.tree_nodes(merkle.sentence_nodes(F.col(c)), parts(c))
    for r in df.select("k", merkle.changed_paragraphs(parts("a"), parts("b")).alias("c"), merkle.tree_likeness(nodes("a"), nodes("b"), merkle.repeats(nodes("a")), merkle.repeats(nodes("b"))).alias("n")).collect():
        assert r.c == cases[r.k][2] and (r.n == 1.0) == (cases[r.k][3] == 1.0)


def test_poisson_mix(spark, odd):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), F.lit(1).alias("mix_copy"))
    got = source_mix.replicate(docs, weights={"a": 0.5, "b": 0.5}).groupBy("source").count().collect()
    assert all(abs(r["count"] - 2000) < 200 for r in got)
    heavy = source_mix.replicate(docs.filter("doc_id < 4"), weights={"a": 1.0}, volume=10.0 * 1000)
    assert abs(heavy.count() - 1000) < 150 and heavy.select("source").distinct().count() == 1
    out = source_mix.replicate(odd)
    assert set(out.columns) == {*odd.columns, "mix_copy", "mix_key"}


def test_separator_scan(spark, odd):
    encoder = tokens.Encoder(tokens.default_path(), plain=True)
    want = sorted((r.doc_id or 0, len(encoder.whole([r.text or ""])[0]) // 4) for r in odd.collect())
    for size in (7, 1 << 20):
        assert sorted((r.doc_id or 0, r.n_tokens) for r in token_scan.count_tokens(odd, block_tokens=size).collect()) == want


def test_unclosed_tail_is_a_document(spark, tmp_path):
    (tmp_path / "f").write_bytes(np.array([5, 9, 0, 9, 9, 4, 4], "<u2").tobytes())
    files = spark.createDataFrame([(str(tmp_path / "f"), 2)], "path string, width int")
    for size in (1, 2, 3, 50):
        got = [(r.document, r.start, r.n_tokens, r.closed) for r in token_scan.scan(files, 9, size).orderBy("document").collect()]
        assert got == [(0, 0, 1, True), (1, 2, 1, True), (2, 4, 0, True), (3, 5, 2, False)]


def test_licenses(spark, odd):
    rows = [(1, "x MIT License, the mit-license"), (2, "Licensed under CC BY-NC 4.0."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, None), (5, "license mit")]
    got = {r.doc_id: r for r in license_index.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (6, 2, 1, 4, "mit")
    assert (got[2].base_labels, got[2].labels) == ("", "cc-by-nc")
    assert (got[3].base_labels, got[3].labels, got[3].first_word) == ("gpl", "gpl", 7)
    assert (got[4].n_words, got[4].labels, got[4].score, got[5].n_base) == (0, "", 0.0, 0)
    assert license_index.find_licenses(odd).count() == odd.count()


M64 = (1 << 64) - 1


def brute_mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def brute_features(text, buckets=1 << 18):
    """Buckets of words, runs of punctuation, and ordered pairs of neighbours, one by one."""
    ones = []
    for w in re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x09-\x0d ]+", text.encode().lower()):
        x = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(w)) + len(w)
        ones.append(brute_mix(x & M64))
    twos = [brute_mix((brute_mix(a) + b + 0x6A09E667F3BCC909) & M64) for a, b in zip(ones, ones[1:], strict=False)]
    return [x >> (64 - 18) for x in ones + twos]


def brute_draw(what, doc_id):
    return int(hashlib.md5(f"{what}-5|{doc_id}".encode()).hexdigest()[:13], 16)


def brute_weights(texts, good, prior=8.0):
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(brute_features(t))
        if i in good and brute_draw("fold", i) % 5:
            target.update(brute_features(t))
    scale = sum(target.values()) / sum(raw.values())
    return {i: sum(math.log((target[f] + prior) / (raw[f] * scale + prior)) for f in brute_features(t)) for i, t in texts.items()}


def brute_kept(texts, good, k, miss=0.002):
    weights = brute_weights(texts, good)
    keys = {i: w - math.log(-math.log((brute_draw("gumbel", i) + 0.5) / (1 << 52))) for i, w in weights.items()}
    if k is None:
        held = sorted((weights[i] for i in good if brute_draw("fold", i) % 5 == 0), reverse=True)
        least = held[math.ceil(len(held) * (1 - miss)) - 1]
        k = sum(w >= least - 1e-9 for w in weights.values())
    return set(sorted(keys, key=keys.get, reverse=True)[:k])


def test_pairs_are_ordered():
    assert sorted(brute_features("sun rain")) != sorted(brute_features("rain sun"))
    for text in ("sun rain", "rain rain rain", "a!! b", "Ünï co-de 12 x"):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert sorted(importance.features(raw, np.array([0, len(raw)]), 1 << 18)[0].tolist()) == sorted(brute_features(text))


def test_importance(spark, odd):
    rng = np.random.default_rng(3)
    good = [" ".join(rng.choice(["sun", "rain", "wind", "snow", "fog"], 40)) for _ in range(300)]
    bad = [" ".join(w + "!!" for w in rng.choice(["buy", "win", "cash"], 40)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in importance.resample(docs, labels).filter("kept").collect()}
    assert not kept & set(range(300, 400))
    assert kept == brute_kept(dict(enumerate(good + bad)), set(range(0, 300, 2)), None)
    rows = importance.resample(docs, labels, k=7).collect()
    assert {r.doc_id for r in rows if r.kept} == brute_kept(dict(enumerate(good + bad)), set(range(0, 300, 2)), 7)
    want = brute_weights(dict(enumerate(good + bad)), set(range(0, 300, 2)))
    assert all(abs(r.log_weight - want[r.doc_id]) < 1e-6 for r in rows)
    assert importance.resample(odd, labels.limit(0)).filter("kept").count() == odd.count()
    assert importance.selected(odd, labels).columns == odd.columns


def test_importance_few_held_out(spark):
    """With few held-out documents none is below the threshold: a share of 0.002 of them is none."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["sun", "rain", "wind", "snow", "fog", "buy", "win"], rng.integers(5, 60))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id < 50 AS int) AS quality", "0 AS toxic")
    out = {r.doc_id for r in docs.filter("doc_id < 50").filter(importance._draw("fold", 5) % 5 == 0).collect()}
    rows = importance.resample(docs, labels).collect()
    least = min(r.log_weight for r in rows if r.doc_id in out)
    assert 1 < len(out) and sum(r.kept for r in rows) == sum(r.log_weight >= least for r in rows)


def test_kth_largest(spark):
    keys = spark.range(1000).select((F.col("id") % 100).cast("double").alias("key"))
    want = sorted((i % 100 for i in range(1000)), reverse=True)
    for k in (1, 10, 11, 555, 1000):
        assert importance.kth_largest(keys, k, bins=4, few=20) == want[k - 1]


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = language_mixture.learn(none)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        language_mixture.identify(none, model), warc_zip.archive_round_trip(pages), packing.pack(none), media_jpeg.media_features(media_jpeg.store_texts(none)), merkle.edit_study(none),
        source_mix.replicate(none), near_dedup.near_duplicates(none), token_scan.count_tokens(none), license_index.find_licenses(none), importance.resample(none, labels),
    ):
        assert df.count() == 0


NAMES = ["log_weight", "n_features", "gumbel_key", "good_id", "mix_key", "mix_copy", "mix_rate", "mix_table", "mark_word", "mark_mask", "marked", "gone", "row", "name", "key", "copies"]


def test_pipeline_stages(spark, odd, tmp_path):
    """Every stage keeps the columns of the input as they are, whatever their names, and takes an empty table."""
    import corpus_pipeline

    spark.createDataFrame([(4, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, str(tmp_path))
        assert left.columns == docs.columns
        assert left.select(*NAMES).distinct().collect() in ([], [tuple(range(len(NAMES)))])
        docs = left
        assert stage(spark, none, str(tmp_path)).count() == 0
    rows, _ = packed(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)))
    assert sum(r.piece == 0 for r in rows) == docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    words = {"en": "the cat sat on a mat with other animals near home".split(), "de": "der hund und die katze sind nicht über straßen gelaufen".split()}
    texts, langs, sources = [], [], []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        texts.append(" ".join(rng.choice(words[lang], 40)) if i < 90 else " ".join(w + "!!" for w in rng.choice(["buy", "win", "cash"], 40)))
        langs.append(lang if i < 90 else None)
        sources.append("ab"[i % 4 == 0])
    texts[7], texts[8], texts[11] = texts[5], texts[5] + " more", "12 34 56"
    rows = [(i, t, l, s, len(t)) for i, (t, l, s) in enumerate(zip(texts, langs, sources, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 90), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(stages["quality"](spark, docs, str(tmp_path))) == brute_kept(dict(enumerate(texts)), set(range(0, 90, 2)), None)
    model = brute_languages({i: (t, l) for i, (t, l) in enumerate(zip(texts, langs, strict=True))})
    want = {i for i, t in enumerate(texts) if any(c.isalpha() for c in t) and brute_mixture(t, model)[0][1] >= 0.5}
    assert ids(stages["language"](spark, docs, str(tmp_path))) == want and 11 not in want
    comp = brute_components(list(range(120)), brute_sets(texts, 5))
    assert ids(stages["near_duplicates"](spark, docs, str(tmp_path))) == {i for i, c in enumerate(comp) if i == c} and comp[8] == 5
    volumes = Counter()
    for t, s in zip(texts, sources, strict=True):
        volumes[s] += len(t)
    roots = sum(math.sqrt(v) for v in volumes.values())
    copies = Counter()
    for i, s in enumerate(sources):
        rate = math.sqrt(volumes[s]) / roots * sum(volumes.values()) / volumes[s]
        u, p, cdf, k = int(hashlib.md5(f"count-11|{i}|0".encode()).hexdigest()[:13], 16) / 2**52, math.exp(-rate), math.exp(-rate), 0
        while cdf <= u:
            k += 1
            p *= rate / k
            cdf += p
        copies[i] = k
    got = Counter(r.doc_id for r in stages["source_mix"](spark, docs, str(tmp_path)).collect())
    assert got == +copies
    # run() applies the stages one to the other.
    run_rows, _ = packed(corpus_pipeline.run(spark, str(tmp_path)))
    assert {r.doc_id for r in run_rows} <= set(range(90)) - {7, 11}


def brute_trigrams(text):
    """Trigrams of letters, all else one space, as strings."""
    return Counter(re.findall("(?=(...))", re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")))


def brute_languages(docs):
    counts = {}
    for i, (t, lang) in docs.items():
        if lang is not None and t and zlib.crc32(str(i).encode()) % 5:
            counts.setdefault(lang, Counter()).update(brute_trigrams(t))
    return {lang: (c, sum(c.values()) + 0.5 * language_mixture.BUCKETS) for lang, c in sorted(counts.items())}


def brute_mixture(text, model, penalty=2.0):
    """(language, share) of the best penalised set, by plain expectation maximisation over dictionaries."""
    grams = brute_trigrams(text)
    n = sum(grams.values())
    p = {lang: {g: (c[g] + 0.5) / total for g in grams} for lang, (c, total) in model.items()}

    def em(share):
        for _ in range(200):
            new = dict.fromkeys(share, 0.0)
            for g, k in grams.items():
                mix = sum(share[a] * p[a][g] for a in share)
                for a in share:
                    new[a] += k * share[a] * p[a][g] / mix / n
            share = new
        return share, sum(k * math.log(sum(share[a] * p[a][g] for a in share)) for g, k in grams.items())

    share, _ = em(dict.fromkeys(model, 1 / len(model)))
    order = sorted(model, key=lambda a: (-share[a], a))
    best, value = None, -math.inf
    for size in range(1, len(order) + 1):
        s, like = em(dict.fromkeys(order[:size], 1 / size))
        like -= penalty * (size - 1) * math.log(n)
        if like <= value:
            break
        best, value = s, like
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))


def test_languages_against_brute_force(spark):
    words = {"en": "the cat sat on a mat with other animals near home", "de": "der hund und die katze sind nicht über straßen gelaufen", "fr": "le chat est très près de là où étaient les autres"}
    rng = np.random.default_rng(2)
    docs = {i: (" ".join(rng.choice(words[k].split(), 30)), k) for i, k in enumerate(list(words) * 10)}
    docs[100] = (docs[0][0] + " " + docs[1][0], None)
    docs[101] = (docs[0][0] + " " + docs[1][0] + ", " + docs[2][0] + " 42!", None)
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in docs.items()], "doc_id long, text string, lang string")
    model = brute_languages(docs)
    for r in language_mixture.identify(df, language_mixture.learn(df), rounds=200).collect():
        want = brute_mixture(docs[r.doc_id][0], model)
        assert r.languages == [a for a, _ in want] and all(abs(x - y) < 0.02 for x, (_, y) in zip(r.shares, want, strict=True))
    # Any number of languages.
    many = spark.range(600).selectExpr("id AS doc_id", "concat('abc', translate(cast(id AS string), '0123456789', 'qwertzuiop')) AS text", "cast(id AS string) AS lang")
    langs, table = language_mixture.learn(many)
    assert len(langs) > 400 and table.rows(np.arange(5)).shape == (5, len(langs))


def bits_of(values):
    """A byte string of (value, length) pairs, stuffed and padded with ones."""
    text = "".join(f"{v:0{n}b}" for v, n in values if n)
    text += "1" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def hand_made(width, height, sampling, interval, rng):
    """A baseline image of random coefficients, block by block: (file, DC of the first component's blocks by row)."""
    size = lambda v: abs(v).bit_length()
    raw = lambda v: (v if v >= 0 else v + (1 << size(v)) - 1, size(v))
    acs = [(r << 4) | s for r in range(16) for s in range(1, 11)] + [0x00, 0xF0]
    dc_code = lambda s: (s, 4)
    ac_code = {s: (k, 8) for k, s in enumerate(acs)}
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    dc = np.zeros((down * sampling[0][1], across * sampling[0][0]), int)
    scan, part, before = b"", [], [0] * len(sampling)
    for m in range(across * down):
        if interval and m and m % interval == 0:
            scan, part, before = scan + bits_of(part) + bytes([0xFF, 0xD0 + (m // interval - 1) % 8]), [], [0] * len(sampling)
        for c, (h, v) in enumerate(sampling):
            for y in range(v):
                for x in range(h):
                    value = int(rng.integers(-60, 60))
                    if c == 0:
                        dc[m // across * v + y, m % across * h + x] = value
                    d, before[c] = value - before[c], value
                    part += [dc_code(size(d)), raw(d)]
                    at = 1
                    for k in sorted(rng.choice(np.arange(1, 64), rng.integers(0, 6), replace=False).tolist()):
                        while k - at > 15:
                            part.append(ac_code[0xF0])
                            at += 16
                        ac = int(rng.choice([-900, -3, -1, 1, 2, 77]))
                        part += [ac_code[((k - at) << 4) | size(ac)], raw(ac)]
                        at = k + 1
                    if at < 64:
                        part.append(ac_code[0])
    scan += bits_of(part)
    seg = lambda mark, body: bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body
    n = len(sampling)
    out = b"\xff\xd8" + seg(0xFE, b"made by hand") + seg(0xDB, bytes([0, *[8] * 64]))
    out += seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([c + 1, 16 * h + v, 0]) for c, (h, v) in enumerate(sampling)))
    out += seg(0xC4, bytes([0x00, 0, 0, 0, 12, *[0] * 12, *range(12)])) + seg(0xC4, bytes([0x10, *[0] * 7, len(acs), *[0] * 8, *acs]))
    if interval:
        out += seg(0xDD, interval.to_bytes(2, "big"))
    out += seg(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + bytes([0, 63, 0])) + scan + b"\xff\xd9"
    return out, dc


@pytest.mark.parametrize(("sampling", "interval"), [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2), ([(1, 1)] * 3, 0)])
def test_jpeg_images_made_by_hand(sampling, interval):
    rng = np.random.default_rng(5)
    files = [hand_made(w, h, sampling, interval, rng) for w, h in ((8, 8), (50, 33), (97, 16))]
    for (data, dc), own, (w, h) in zip(files, media_jpeg.thumbnails([f for f, _ in files]), ((8, 8), (50, 33), (97, 16)), strict=True):
        want = np.clip(np.floor(dc * 8 / 8 + 0.5) + 128, 0, 255)[: -(-h // 8), : -(-w // 8)]
        assert len(own) == 1 and np.array_equal(own[0], want)


def test_license_base_equals_sql(spark):
    import duckdb

    from martlens.llm.queries import op9_license_index

    want = duckdb.sql(r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM '/root/testdata/sf0.001/documents.parquet'),
      p AS (SELECT * FROM (VALUES ('mit', ['mit', 'license']), ('apache', ['apache', 'license']), ('gpl', ['general', 'public', 'license'])) t(label, phrase)),
      f AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), p WHERE ws[i : i + len(phrase) - 1] = phrase)
      SELECT w.doc_id, len(ws), count(label), min(place), max(place), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM w LEFT JOIN f USING (doc_id) GROUP BY 1, 2""").fetchall()
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in op9_license_index(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want) and any(r[2] for r in got)


def test_license_index_equals_brute_force(spark):
    """Whole, cut, changed and shifted notices, and such with words put in and left out: every band of places of a text against every template."""
    rng = np.random.default_rng(6)
    texts = []
    for _, notice, _ in license_index.TEMPLATES:
        ws = notice.split()
        changed = [w if rng.random() > 0.05 else "other" for w in ws]
        half = len(ws) // 2
        texts += [notice, "Some words, then: " + notice.upper() + " and more", " ".join(changed), " ".join(ws[:half]), " ".join(ws[::-1]), " ".join([*ws[:half], "new", *ws[half:]]), " ".join(ws[:half] + ws[half + 1 :])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def chain(t, ws, low, high):
        """The longest common subsequence, by a table, of words whose places are in the band."""
        best = np.zeros((len(t) + 1, len(ws) + 1), int)
        for i, w in enumerate(t):
            for j, x in enumerate(ws):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + 1 if w == x and low <= j - i <= high else 0)
        return best[-1, -1]

    for r in license_index.find_licenses(df).collect():
        ws, found = texts[r.doc_id].lower().replace(",", "").replace(":", "").split(), {}
        for label, notice, phrase in license_index.TEMPLATES:
            t, must = notice.split(), phrase.split()
            if len(set(t) & set(ws)) < 0.5 * len(set(t)) or not any(ws[k : k + len(must)] == must for k in range(len(ws))):
                continue
            wide = max(2, len(t) // 8)
            step = max(1, wide // 2)  # a wider band holds every one of the index
            share = max(chain(t, ws, low, low + 2 * wide + step) for low in range(-2 * wide, len(ws), step)) / len(t)
            if share >= 0.7:
                found[label] = max(share, found.get(label, 0))
        own, labels = texts[r.doc_id - r.doc_id % 7], set(filter(None, r.labels.split(",")))
        # The index asks for some agreement among the rare words, so that it may miss a place, never make one up.
        assert labels - set(filter(None, r.base_labels.split(","))) <= set(found)
        if r.doc_id % 7 < 2:
            assert set(found) <= labels
        if r.doc_id % 7 == 5 and license_index.TEMPLATES[r.doc_id // 7][2] in texts[r.doc_id]:
            assert license_index.TEMPLATES[r.doc_id // 7][0] in labels, own


def test_license_chain_of_many_words():
    """One rare word ten thousand times, and a notice among them."""
    index = license_index.Index({w.encode(): 1.0 for _, notice, _ in license_index.TEMPLATES for w in notice.split()})
    ws = b" ".join([b"software"] * 10_000 + license_index.TEMPLATES[5][1].encode().split() + [b"version"] * 10_000).split()
    base, scores = index.find(ws, 0.7)
    assert base == [(10_007, "gpl")] and scores["gpl"] == 1.0


def test_likeness_counts_repeats(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.integers(0, 9, 1 + k % 30).tolist(), rng.integers(0, 12, 1 + k % 17).tolist()) for k in range(200)] + [(200, list(range(40)), list(range(20, 60)))]
    df = spark.createDataFrame(rows, "k int, a array<long>, b array<long>")
    for r in df.select("k", merkle.tree_likeness(F.col("a"), F.col("b"), merkle.repeats(F.col("a")), merkle.repeats(F.col("b"))).alias("n")).collect():
        a, b = rows[r.k][1:]
        assert r.n == 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


def test_hot_payload_and_hot_ids(spark):
    """One payload, one null doc_id, one text of half of the rows."""
    pages = spark.range(400).selectExpr("id AS page_id", "concat('u', id) AS url", "CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('p', id) END AS html")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc_zip.archive_round_trip(pages).collect()}
    assert got == {i: ("revisit", 398) if i % 2 == 0 and i != 398 else ("response", None) for i in range(400)}
    docs = spark.range(300).selectExpr("CASE WHEN id % 2 = 0 THEN NULL ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one two three four five six' ELSE concat('w', id, ' a b c d e f') END AS text", "'s' AS source")
    rows = merkle.edit_study(docs, rows_per_task=7).collect()
    assert len(rows) == 300 and sum(r.near_next == 1.0 for r in rows if r.doc_id is None) >= 49
    assert len({r.mix_key for r in source_mix.replicate(docs, volume=20000.0).collect()}) > 300
    marked = near_dedup.near_duplicates(docs, 4)
    comp = brute_components([r.doc_id for r in docs.collect()], brute_sets([r.text for r in docs.collect()], 4))
    assert sorted((r.component_id is None, r.component_id or 0) for r in marked.collect()) == sorted((c is None, c or 0) for c in comp)


def test_more_than_seven_words(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "a b c d e f g h i k")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 9).collect()} == {1: 1, 2: 1, 3: 3}


def test_scratch_folder_is_refused_on_a_cluster():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(ValueError):
        common.scratch_root(Session())


def test_32_bit_token_files(spark, tmp_path):
    (tmp_path / "f").write_bytes(np.array([70000, 9, 0, 70000, 70000, 4], "<u4").tobytes())
    files = spark.createDataFrame([(str(tmp_path / "f"), 4)], "path string, width int")
    for size in (1, 2, 50):
        assert [(r.start, r.n_tokens, r.closed) for r in token_scan.scan(files, 70000, size).orderBy("document").collect()] == [(0, 0, True), (1, 2, True), (4, 0, True), (5, 1, False)]
    assert token_scan.end_id_of(tokens.default_path()) == 49407
