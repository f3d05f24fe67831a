"""Near duplicates by min-max hashing.

Each permutation of the shingle hashes is evaluated once and gives two values, its minimum and its maximum, which agree between
two sets with the probability of their similarity. Bands of these values give candidates, full shingle sets confirm them, and
confirmed links join documents into components.

Copies (equal shingle sets) are first folded into one representative. In a band's bucket of few representatives all pairs are
candidates; in a larger one each is first compared with the bucket's smallest, and when components are known, only pairs of
different components are left. They are compared in waves of bounded size, those that parity bitmaps refute not in full, until every bucket's pairs are confirmed, refuted or connected. So no group is ever expanded into all its pairs, and no link is dropped.

Cases: a null, empty or blank text has no shingles and no links. A row with a null doc_id can't be named by a link: it stays
alone, component_id null, kept. Rows that repeat a doc_id are one vertex of the graph. Other columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.llm.bytewords import mix, shingles, words
from martlens.llm.common import blocks, join_heavy, map_texts, marks, pinned

_U = np.uint64
SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, odd array<long>"
#: Longs of a set's parity bitmap.
ODD = 16


def _sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and how many."""
    hashes, counts = shingles(*words(data, bounds), size)
    cut = np.concatenate([[0], np.cumsum(counts)])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[cut[:-1][counts > 0]] = True
    return hashes[new], np.add.reduceat(np.append(new, False).astype(np.int64), cut[:-1]) * (counts > 0) if len(counts) else counts


def sketch(docs: DataFrame, size: int, bands: int, width: int, seed: int) -> DataFrame:
    """SKETCH of every row: size of its set, 128 bits that name the set, the hashes of its bands, and the parity bitmap.

    In the bitmap every shingle flips one bit, so two bitmaps differ in no more bits than their sets differ in shingles.
    """
    permutations = bands * width // 2
    rng = np.random.default_rng(seed)
    scale, shift = rng.integers(0, 1 << 63, (2, permutations), _U) * _U(2) + _U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in blocks(batch.column(1)):
                sets, counts = _sets(data, bounds, size)
                have = np.flatnonzero(counts)
                starts = np.concatenate([[0], np.cumsum(counts)])[:-1][have]
                names = np.zeros((2, end - first), _U)
                out = np.zeros((end - first, bands), _U)
                if len(have):
                    names[0, have] = np.add.reduceat(mix(sets), starts)
                    names[1, have] = np.add.reduceat(mix(sets ^ _U(0x5851F42D4C957F2D)), starts)
                    folded = np.empty((len(have), bands), _U)
                    folded[:] = np.arange(1, bands + 1, dtype=_U)
                    for k in range(permutations):
                        values = sets * scale[k] + shift[k]
                        band = 2 * k // width
                        folded[:, band] = mix(folded[:, band] ^ np.minimum.reduceat(values, starts))
                        folded[:, band] = mix(folded[:, band] ^ np.maximum.reduceat(values, starts))
                    out[have] = folded
                bits = np.repeat(np.arange(end - first), counts) * (64 * ODD) + (sets >> _U(40)).astype(np.int64) % (64 * ODD)
                odd = np.packbits((np.bincount(bits, minlength=(end - first) * 64 * ODD) & 1).astype(bool)).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, k, dtype=np.int32)), pa.array(v)) for v, k in ((out.reshape(-1).view(np.int64), bands), (odd, ODD))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(counts.astype(np.int64)), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)), *lists],
                    ["doc_id", "n_shingles", "s1", "s2", "bands", "odd"],
                )

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, SKETCH)


def _sliced(pairs: DataFrame, side: str, other: str, total: int, each: int = 256) -> DataFrame:
    """``pairs`` with slice_<side>: the partners of a vertex are dealt to as many slices as ``each`` of them need."""
    k = f"k_{side}"
    counts = pairs.groupBy(side).agg(F.count("*").alias(k))
    slices = F.ceil(F.col(k) / each)
    return join_heavy(pairs, counts, [side], k, total).withColumn(f"slice_{side}", F.pmod(F.xxhash64(other), slices)).drop(k)


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` whose documents' full sets have 100 * intersection >= percent * union.

    A document of very many pairs has its text sent once for each slice of them, so that they don't meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = batch.column(2), batch.column(3)
            for at in range(0, batch.num_rows, 256):
                n = min(256, batch.num_rows - at)
                sides = []
                for column in (ta, tb):
                    parts = [_sets(d, b, size) for _, _, d, b in blocks(column.slice(at, n))]
                    sides.append((np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]))])))
                (sa, ca), (sb, cb) = sides
                ok = []
                for k in range(n):
                    x, y = sa[ca[k] : ca[k + 1]], sb[cb[k] : cb[k + 1]]
                    both = len(x) + len(y)
                    z = np.concatenate([x, y])
                    z.sort()
                    common = int((z[1:] == z[:-1]).sum())
                    ok.append(common > 0 and 100 * common >= percent * (both - common))
                keep = np.flatnonzero(ok)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, n).take(pa.array(keep)) for c in (0, 1)], ["a", "b"])

    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    # Only the texts that the joins need are shuffled, and the few others that share a bit with one.
    texts = marks(docs.select(F.col("doc_id").cast("long"), "text"), needed).filter("marked").select("doc_id", "text")
    total = pairs.count()
    placed = pinned(_sliced(_sliced(pairs, "a", "b", total), "b", "a", total), "slices")
    both = placed
    for side in ("b", "a"):
        own = placed.select(side, f"slice_{side}").distinct().join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"t{side}")), side)
        both = both.join(own, [side, f"slice_{side}"])
    return map_texts(both.select("a", "b", "ta", "tb"), run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex that each vertex of ``links`` (a, b) reaches.

    Rounds of the smallest label among the neighbours, then of the label's own label, so that paths halve; each is written to
    the shared folder.
    """
    edges = pinned(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = pinned(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), "component"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "v").select("v", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        lower = pinned(lower, "labels")
        if not lower.filter(F.col("new") < F.col("old")).limit(1).count():
            return labels
        jump = lower.select(F.col("v").alias("new"), F.col("new").alias("next"))
        labels = pinned(lower.join(jump, "new", "left").select("v", F.least("new", "next").alias("component")), "labels")


def close(x: Column, y: Column, percent: int) -> Column:
    """May sets of these sizes be linked?"""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def possible(nx: str, x: str, ny: str, y: str, percent: int) -> Column:
    """May these sets be linked? Linked ones differ in few shingles, so their parity bitmaps differ in few bits; none is lost."""
    differ = sum(F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(ODD))
    return close(F.col(nx), F.col(ny), percent) & (differ * (100 + percent) <= (100 - percent) * (F.col(nx) + F.col(ny)))


def _unresolved(named: DataFrame, total: int) -> DataFrame:
    """Rows of (bucket, rep, component, ...) in buckets of several components, with main: the bucket's component of the most."""
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("in_bucket"), F.count("*").alias("parts")).filter("parts > 1")
    return join_heavy(named, main.select("bucket", "main", "in_bucket"), ["bucket"], "in_bucket", total)


def _merged(found: DataFrame, fresh: DataFrame) -> DataFrame:
    """``found`` (v, component) after the links ``fresh`` (a, b): only the components that these join are labelled anew."""
    named = lambda side: found.select(F.col("v").alias(side), F.col("component").alias(f"c{side}"))
    of = lambda side: F.coalesce(f"c{side}", side)
    ends = fresh.join(named("a"), "a", "left").join(named("b"), "b", "left")
    moved = components(ends.select(of("a").alias("a"), of("b").alias("b")).filter("a <> b")).select(F.col("v").alias("component"), F.col("component").alias("to"))
    every = found.union(fresh.select(F.col("a").alias("v")).union(fresh.select("b")).distinct().join(found, "v", "left_anti").select("v", F.col("v").alias("component")))
    return pinned(every.join(moved, "component", "left").select("v", F.coalesce("to", "component").alias("component")), "labels")


def near_duplicates(
    docs: DataFrame, shingle_size: int = 5, percent: int = 80, bands: int = 24, width: int = 4, small: int = 24, wave_pairs: int = 50_000_000, slice_rows: int = 256, seed: int = 7
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    bands of ``width`` values each: with 24 bands of 4, a pair at similarity 0.8 is no candidate with probability 3e-6.
    small: largest bucket whose pairs are all candidates at once. wave_pairs: pairs looked at at a time in what larger buckets leave,
    where ``slice_rows`` rows of a bucket meet in a task. An empty table gives an empty result.
    """
    if width % 2:
        raise ValueError("a band holds minima with their maxima: width must be even")
    rows = pinned(sketch(docs, shingle_size, bands, width, seed), "sketch")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    real = rows.filter(linked)
    sets = real.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("odd", "doc_id").alias("odd"))
    sets = pinned(sets, "sets")
    n_rows, n_sets = rows.count(), sets.count()
    # A doc_id that stands for several sets joins them.
    named = real.select("doc_id", "s1", "s2").distinct()
    repeated = named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    same = named.join(repeated, "doc_id").join(sets, ["s1", "s2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).filter("a <> b").distinct()

    entries = sets.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("m"), F.min("rep").alias("least"), F.min_by("n", "rep").alias("least_n")).filter("m > 1")
    entries = pinned(join_heavy(entries, pinned(buckets, "buckets"), ["bucket"], "m", n_sets * bands), "entries")
    few, many = entries.filter(F.col("m") <= small), entries.filter(F.col("m") > small)
    other = few.select("bucket", F.col("rep").alias("rep2"), F.col("n").alias("n2"))
    pairs = few.join(other, "bucket").filter((F.col("rep") < F.col("rep2")) & close(F.col("n"), F.col("n2"), percent)).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    stars = many.filter((F.col("rep") > F.col("least")) & close(F.col("n"), F.col("least_n"), percent)).select(F.col("least").alias("a"), F.col("rep").alias("b"))
    pairs = pinned(pairs.union(stars).distinct(), "candidates")
    side = lambda k: sets.select(F.col("rep").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("odd").alias(f"odd{k}"))
    total = pairs.count()
    placed = _sliced(_sliced(pairs, "a", "b", total), "b", "a", total)
    placed = pinned(placed, "slices")
    narrow = placed
    for k in ("b", "a"):
        narrow = narrow.join(placed.select(k, f"slice_{k}").distinct().join(side(k), k), [k, f"slice_{k}"])
    pairs = pinned(narrow.filter(possible("na", "odda", "nb", "oddb", percent)).select("a", "b"), "pairs")
    links = pinned(confirm(pairs, docs, shingle_size, percent).union(same), "links")
    found = components(links)

    # Larger buckets: what isn't in the component of the most is compared with all of other components.
    many = many.select("bucket", "rep", "n", "m")
    n_many = many.count()
    if n_many:
        many = pinned(many.join(sets.select("rep", "odd"), "rep"), "many")
        # Which rows are outside their bucket's main component is fixed before the first wave: were it told anew in each, a change of
        # the main component would leave pairs out, one side of which was main when it was due and is due no more.
        found_now = lambda rows: pinned(rows.join(found.withColumnRenamed("v", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "named")
        fixed = _unresolved(found_now(many), n_many).withColumn("outside", F.col("component") != F.col("main")).drop("component", "main", "in_bucket")
        fixed = pinned(fixed, "outside")
        sizes = fixed.groupBy("bucket").agg(F.count("*").alias("m"), F.count(F.when(F.col("outside"), 1)).alias("stray"))
        waves = -(-(sizes.agg(F.sum(F.col("m") * F.col("stray"))).first()[0] or 0) // wave_pairs)
        for wave in range(waves):
            open_ = pinned(_unresolved(found_now(fixed), n_many), "open")
            turn = F.pmod(F.xxhash64("rep"), F.lit(waves)) == wave
            slices = F.ceil(F.col("m") / slice_rows)
            stray = open_.filter(F.col("outside") & turn).select(
                "bucket", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("odd").alias("oddx"), F.col("component").alias("cx"), F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice")
            )
            dealt = open_.withColumn("slice", F.pmod(F.xxhash64("rep", F.lit(1)), slices))
            more = stray.join(dealt, ["bucket", "slice"]).filter((F.col("cx") != F.col("component")) & possible("nx", "oddx", "n", "odd", percent))
            more = more.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
            fresh = pinned(confirm(pinned(more, "pairs"), docs, shingle_size, percent), "links")
            if fresh.limit(1).count():
                found = _merged(found, fresh)

    vertex = sets.select("s1", "s2", "copies", "rep").join(found.withColumnRenamed("v", "rep"), "rep", "left").select("s1", "s2", "copies", F.coalesce("component", "rep").alias("component"))
    out = join_heavy(rows.filter(linked).select("doc_id", "n_shingles", "s1", "s2"), pinned(vertex, "vertices"), ["s1", "s2"], "copies", n_rows)
    named = out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
    return named.unionByName(rows.filter(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))
