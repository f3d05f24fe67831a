"""Line index, whitening and runs against brute force, and on the rows that tables rarely have."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlens.llm import line_index, queries, runs, whitening

DOCS = "doc_id long, text string, h1 string, drop string, first string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, null and repeated ids, clashing columns."""
    line = "a line of many words that come back"
    long = "\n".join(f"line number {i % 700} of a long text" for i in range(3000))
    texts = [
        (1, None), (2, ""), (3, " \n\t\n"), (4, f"{line}\nshort\n{line}"), (5, f"  {line.upper()}\t\nown line of five"), (5, f"{line}\nonly document five has this"), (5, "only document five has this"),
        (None, line), (None, line), (6, long), (7, long + "\nend"), (8, "äöüäöüäöü\näöüäöüäöüä"), (9, "äöüäöüäöü\nÄöüäöüäöüä\näöüäöüäöüä\x0b"), (10, "last\n"), (0, "short\nshort"),
    ]
    return spark.createDataFrame([(i, t, "x", None, "y") for i, t in texts], DOCS)


def brute_lines(rows, least=10):
    key = lambda line: (k if len((k := "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r")))) >= least else None)
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and key(line) is not None:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or key(x) is None or len(holders.get(key(x), ())) < 2 or d == min(holders[key(x)])]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def cleaned(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize("loads", [1, 3])
def test_lines_odd_rows(odd, loads):
    assert cleaned(line_index.dedup_lines(odd, loads)) == brute_lines([(r.doc_id, r.text) for r in odd.collect()])


def test_lines_come_and_go(spark):
    """Loads, deletions and a second coming give at every step what the documents that are there give at once; the filters hold their keys."""
    rng = np.random.default_rng(3)
    texts = {d: "\n".join(f"this is line {x}" for x in rng.integers(0, 60, rng.integers(1, 12))) for d in range(60)}
    frame = lambda ids: spark.createDataFrame([(d, texts[d]) for d in ids], "doc_id long, text string")
    index, there = line_index.LineIndex(spark, shard_keys=16), set()
    steps = [("insert", range(20, 40)), ("insert", range(0, 20)), ("delete", range(0, 10)), ("insert", range(40, 60)), ("delete", [*range(15, 30), 999]), ("insert", range(0, 10)), ("delete", range(60))]
    for what, ids in steps:
        if what == "insert":
            index, there = index.insert(frame(ids)), there | set(ids)
        else:
            index, there = index.delete(spark.createDataFrame([(d,) for d in ids], "doc_id long")), there - set(ids)
        if there:
            assert cleaned(index.clean(frame(sorted(there)))) == brute_lines([(d, texts[d]) for d in sorted(there)])
        keys = index.references().select("h1", "h2").distinct()
        assert index.n_keys == keys.count()
        assert index.shards >= index.n_keys / 16
        if index.n_keys:
            assert index._asked(keys).count() == index.n_keys
        slots = sum(int(np.count_nonzero(np.frombuffer(r.table, np.uint16))) + len(r.rest) // 8 for r in index._read(line_index._FILTERS, index.filters).collect())
        assert slots == index.n_keys


def test_a_deletion_gives_lines_back(spark):
    docs = spark.createDataFrame([(1, "the same long line"), (2, "the same long line\nand one of its own"), (3, "the same long line")], "doc_id long, text string")
    index = line_index.LineIndex(spark).insert(docs)
    assert [r.kept for r in index.clean(docs).orderBy("doc_id").collect()] == ["the same long line", "and one of its own", ""]
    less = index.delete(docs.filter("doc_id = 1"))
    assert [r.kept for r in less.clean(docs.filter("doc_id > 1")).orderBy("doc_id").collect()] == ["the same long line\nand one of its own", ""]
    assert [r.kept for r in index.clean(docs).orderBy("doc_id").collect()][2] == ""


def test_lines_of_an_empty_table(spark, odd):
    assert line_index.dedup_lines(odd.limit(0)).count() == 0


def test_cuckoo_filter_beyond_its_room():
    """Nothing is lost where slots run out or hashes agree; what is removed goes, one for one."""
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    own = line_index.CuckooFilter.empty(1000)
    for part in np.split(h, 6):
        own.add(part)
    assert own.has(h).all() and len(own.rest) == len(h) - np.count_nonzero(own.table) > 0
    own.remove(h[:1500])
    assert own.has(h[1500:]).all()
    assert np.count_nonzero(own.table) + len(own.rest) == 1500
    own.remove(h[1500:])
    assert not own.has(h).any() and not len(own.rest)
    few = line_index.CuckooFilter.empty(20000)
    few.add(h)
    assert not len(few.rest) and few.has(rng.integers(0, 1 << 63, 100000).astype(np.uint64) * np.uint64(2) + np.uint64(1)).mean() < 0.001
    twice = line_index.CuckooFilter.empty(4)
    twice.add(np.full(20, 7, np.uint64))
    twice.remove(np.full(19, 7, np.uint64))
    assert twice.has(np.array([7], np.uint64)).all()


def matrix_of(values, seed=0):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ ((np.eye(d, dtype=np.longdouble) - q.T @ q) / 2)
    a = q @ np.diag(np.array(values, np.longdouble)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize(
    "values, close",
    [
        (np.linspace(1, 9, 40), 1e-17), ([100, 100 - 1e-9, 100 - 2e-9, 50, 50 + 1e-12, *range(1, 30)], 1e-7), (1 + np.arange(12) * 1e-9, 1e-9), ([1e-9, 1e-3, 1.0, 1e3], 1e-9), ([3.0] * 3 + [1.0] * 20, None), ([0.0] * 5, None), ([4.0], 0),
    ],
)
def test_eigenvectors_of_close_values(values, close):
    a, q = matrix_of(values)
    found, x = whitening.eigen(a)
    top = max(1e-300, float(np.abs(values).max()))
    assert float(np.abs(a @ x - x * found).max()) / top < 1e-17
    assert float(np.abs(x.T @ x - np.eye(len(values))).max()) < 1e-17
    assert float(np.abs(found - np.sort(values)).max()) / top < 1e-17
    if close is not None:
        assert float(np.abs(1 - np.abs((q[:, np.argsort(values)] * x).sum(axis=0))).max()) <= close


def test_single_precision_alone_is_not_enough():
    a, _ = matrix_of([100, 100 - 1e-5, 50, *range(1, 30)])
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    error = lambda x: float(np.abs(x.T @ a @ x - np.diag(np.diag(x.T @ a @ x))).max())
    refined = whitening.refine(a, rough)[1]
    # The two values that are 1e-5 apart need a solve of their own.
    assert error(rough) > 1e-6 > error(refined) > 1e-12 > 1e-16 > error(whitening.eigen(a)[1])


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = (rng.normal(size=(40, 5)) * [1, 2, 3, 4, 5]).tolist()
    odd_rows = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [-0.0, 0.0, 0.0, 0.0, 0.0]]
    rows = [(k, v, "x") for k, v in enumerate(good + odd_rows)] + [(None, good[0], "x"), (3, good[3], "y"), (3, good[4], "y")]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string")).collect()
    x = np.floor(256 * np.array([*good, odd_rows[-1]]))
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh((fit - s / n).T @ (fit - s / n) / n)
    assert len(got) == 4 * (41 + 3) and {r.n for r in got} == {n} and {r.component for r in got} == {1, 2, 3, 4}
    assert sorted({(r.vec_id is None, r.vec_id or 0) for r in got}) == [*((False, k) for k in range(40)), (False, 46), (True, 0)]
    assert max(r.identity_error for r in got) < 1e-9
    own = {r.component: r for r in got if r.vec_id == 7}
    for c in range(1, 5):
        want = (x[7] - s / n) @ vectors[:, -c] / np.sqrt(values[-c])
        assert abs(abs(own[c].whitened) - abs(want)) < 1e-9
        assert abs(own[c].explained - values[-c] / values.sum()) < 1e-9
    assert own[1].deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[7], s, strict=True))


def test_whitening_without_variance(spark):
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")).collect()
    assert len(same) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, 0.0)}
    line = whitening.whiten(spark.createDataFrame([(k, [k / 256, 2 * k / 256, 1.0]) for k in range(9)], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in line if r.whitened is None} == {2, 3} and all(r.identity_error < 1e-9 for r in line)
    big = whitening.whiten(spark.createDataFrame([(1, [1e15]), (2, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert [r.deviation for r in big] == [None, None]
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")).count() == 0


def brute_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j + q - i >= max(least, 2 * q) and all(any(w[x] != w[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_all_runs_of_small_strings():
    rng = np.random.default_rng(0)
    for t in range(800):
        w = rng.integers(1, rng.integers(2, 6), rng.integers(0, 40))
        if len(w) and t % 2:
            w = np.resize(w[: rng.integers(1, len(w) + 1)], len(w))
        assert [tuple(r) for r in runs.all_runs(w).tolist()] == brute_runs(w.tolist(), 2)


@pytest.mark.parametrize("least", [2, 3, 7, 12])
def test_runs_of_texts(spark, least):
    rng = np.random.default_rng(least)
    texts = [None, "", " \n\t ", "a " * 4000, " ".join(["x y"] * 3), "one two three", "ab\x0bab\x0cab\rab " * 5, "é ß " * 9 + "\x1c é"]
    for _ in range(60):
        w = [f"w{i}" for i in rng.integers(0, rng.choice([2, 5, 1000]), rng.integers(1, 200))]
        for _ in range(3):
            a = int(rng.integers(len(w)))
            p = int(rng.integers(1, 20))
            w[a:a] = (w[a : a + p] * int(rng.integers(1, 5)))[: int(rng.integers(1, 60))]
        texts.append(rng.choice(["\t", " ", " \n"]).join(w))
    rows = [(k if k % 7 else None, t, k, "r") for k, t in enumerate(texts)]
    got = runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string, n_words long, runs string"), least).collect()
    want = []
    for k, t, *_ in rows:
        w = (t or "").encode().split()
        found = brute_runs(w, least) if len(w) < 1000 else [(0, len(w), 1)]
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        want.append((k, len(w), found, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(want, key=repr)


def test_runs_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    texts = [(d, " ".join(f"w{i}" for i in rng.integers(0, 50, rng.integers(0, 120)))) for d in range(300)] + [(301, None), (302, "  ")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    looped = 0
    for d, t in texts:
        w, h = (t or "").split(), zlib.crc32(str(d).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            looped += 1
        found = brute_runs(w)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (best[1] and 1000 * best[1] // best[2])
        assert (r.runs_sha256, r.collapsed_sha256) == (sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    assert len(got) == len(texts) and looped > 15


def test_runs_and_whitening_of_empty_tables(spark, odd):
    assert runs.find_runs(odd.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert runs.find_runs(odd).filter(F.col("n_words") == 0).count() == 3
    with pytest.raises(ValueError):
        runs.find_runs(odd, 1)
