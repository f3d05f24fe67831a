"""Best-fit packing of documents into fixed-length token sequences, in bulk-synchronous rounds.

Every round range-sorts the open pieces and the gaps of the begun sequences together by size. Each task sweeps its range for
successors: from the large end, a piece takes the smallest free gap before it that holds it, and of several pieces that want a
gap the one of the highest rank gets it. What a range leaves over is matched across ranges by its nesting level, from a prefix
sum of two counts a range. Then the gaps are updated and the next round begins. Pieces that fit no gap begin sequences. A bundle of tiny pieces counts as a
piece.

Cases: a null or empty text is a document of the closing id alone. Repeated rows and repeated or null doc_ids are packed row by
row. An empty table gives an empty result. Other columns of the input aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlens.llm.common import map_texts, pinned
from martlens.llm.tokens import Encoder, default_path

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
SPOTS = "id long, sequence_id long, offset long"
BUNDLED = "uid long, length long, item long, inner long"
_SWEPT = "kind int, id long, size long, seq long, off long, part int, rank long"
#: kind: a free gap, an open piece, a placed piece, a gap that a placed piece has left.
GAP, PIECE, PLACED, REST = 0, 1, 2, 3


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, closing_id: int) -> DataFrame:
    """PIECES of every document: its ids and the closing id, cut only where longer than ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(tokenizer)
        uid = TaskContext.get().partitionId() << 40
        close = np.array([closing_id], "<u4").tobytes()
        for batch in batches:
            ids_of = batch.column(0)
            for first, _, ids, counts in encoder.encode(batch.column(1)):
                raw, rows, at = ids.astype("<u4").tobytes(), [], 0
                for row, n in enumerate(counts.tolist()):
                    whole = raw[at : at + 4 * n] + close
                    at += 4 * n
                    for k, start in enumerate(range(0, n + 1, capacity)):
                        part = whole[4 * start : 4 * (start + capacity)]
                        rows.append((first + row, k, start, len(part) // 4, zlib.crc32(part)))
                row, k, start, length, crc = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                uids = pa.array(np.arange(uid, uid + len(rows)))
                uid += len(rows)
                yield pa.RecordBatch.from_arrays([uids, ids_of.take(row), k.cast(pa.int32()), start, length, crc], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), cut, PIECES)


def _read_all(batches: Iterator[pa.RecordBatch], n: int) -> list[np.ndarray]:
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * n


def _rows(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32() if x.endswith(" int") else pa.int64() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _next_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the bin and the place in it of each size, in the given order."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    cuts = [0]
    while cuts[-1] < len(sizes):
        cuts.append(int(np.searchsorted(total, total[cuts[-1]] + capacity, "right")) - 1)
    bins = np.searchsorted(cuts, np.arange(len(sizes)), "right") - 1
    return bins, total[:-1] - total[np.array(cuts, np.int64)[bins]] if len(sizes) else total[:-1]


def _match(kind: np.ndarray, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gaps, pieces, free) of one range, sorted from the largest, gaps before pieces of their size: places of matched pairs, and what stays."""
    depth = np.cumsum(np.where(kind == GAP, 1, -1))
    level = np.where(kind == GAP, depth, depth + 1)
    order = np.argsort(level, kind="stable")
    pair = np.flatnonzero((level[order[:-1]] == level[order[1:]]) & (kind[order[:-1]] == GAP) & (kind[order[1:]] == PIECE))
    gap, piece = order[pair], order[pair + 1]
    free = np.ones(len(kind), bool)
    free[gap] = free[piece] = False
    return gap, piece, free


def _sweep(capacity: int):
    """Successor sweep of one range."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, ids, size = _read_all(batches, 3)
        if not len(kind):
            return
        part = TaskContext.get().partitionId()
        gap, piece, free = _match(kind, ids, size)
        none = lambda n: np.full(n, -1)
        here = lambda n: np.full(n, part)
        n = len(gap)
        yield _rows(_SWEPT, np.full(n, PLACED), ids[piece], size[piece], ids[gap], capacity - size[gap], here(n), none(n))
        yield _rows(_SWEPT, np.full(n, REST), ids[gap], size[gap] - size[piece], none(n), none(n), here(n), none(n))
        for k in (GAP, PIECE):
            at = np.flatnonzero(free & (kind == k))
            n = len(at)
            yield _rows(_SWEPT, np.full(n, k), ids[at], size[at], none(n), none(n), here(n), np.arange(n))

    return sweep


def _begin(capacity: int):
    """New sequences for pieces that fit no gap: next fit over each task's pieces, the largest first."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, size = _read_all(batches, 2)
        if len(ids):
            bins, off = _next_fit(size, capacity)
            first = ids[np.searchsorted(bins, np.arange(bins[-1] + 1))]
            n, m = len(ids), len(first)
            yield _rows(_SWEPT, np.full(n, PLACED), ids, size, first[bins], off, np.zeros(n), np.zeros(n))
            yield _rows(_SWEPT, np.full(m, REST), first, capacity - np.bincount(bins, size).astype(np.int64), np.full(m, -1), np.full(m, -1), np.zeros(m), np.zeros(m))

    return begin


def _rounds(capacity: int, need: int):
    """All rounds that are left, of items that fit one range: the same sweeps and beginnings, one round after another in the task."""

    def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, ids, size = _read_all(batches, 3)
        first = need > 0
        while (kind == PIECE).any():
            order = np.lexsort((ids, kind, -size))
            kind, ids, size = kind[order], ids[order], size[order]
            gap, piece, free = _match(kind, ids, size)
            placed, rest = [(ids[piece], ids[gap], capacity - size[gap])], [(ids[gap], size[gap] - size[piece])]
            open_, gaps = np.flatnonzero(free & (kind == PIECE)), np.flatnonzero(free & (kind == GAP))
            rest.append((ids[gaps], size[gaps]))
            if first:
                begun, left = open_[:need], open_[need:]
                placed.append((ids[begun], ids[begun], np.zeros(len(begun), np.int64)))
                rest.append((ids[begun], capacity - size[begun]))
            else:
                widest = max((r[1].max() for r in rest if len(r[1])), default=0)
                over, left = open_[size[open_] > widest], open_[size[open_] <= widest]
                bins, off = _next_fit(size[over], capacity)
                if len(over):
                    head = ids[over][np.searchsorted(bins, np.arange(bins[-1] + 1))]
                    placed.append((ids[over], head[bins], off))
                    rest.append((head, capacity - np.bincount(bins, size[over]).astype(np.int64)))
            for item, sequence, at in placed:
                if len(item):
                    yield _rows(SPOTS, item, sequence, at)
            least = size[left].min() if len(left) else capacity + 1
            gap_ids, gap_sizes = (np.concatenate([r[k] for r in rest]) for k in (0, 1))
            keep = gap_sizes >= least
            kind = np.concatenate([np.full(len(left), PIECE), np.full(int(keep.sum()), GAP)])
            ids, size = np.concatenate([ids[left], gap_ids[keep]]), np.concatenate([size[left], gap_sizes[keep]])
            first = False

    return rounds


def _bundles(limit: int):
    """Items of many tiny pieces: next fit over each task's pieces up to ``limit``."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, size = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            bins, off = _next_fit(size, limit)
            yield _rows(BUNDLED, uid, size, uid[np.searchsorted(bins, np.arange(bins[-1] + 1))][bins] if len(uid) else uid, off)

    return bundle


def place(items: DataFrame, capacity: int = 4096, rows_per_task: int = 200_000) -> DataFrame:
    """(id, sequence_id, offset) of every item (id long unique, size long from 1 to ``capacity``).

    Rounds over several ranges are jobs. Once pieces and gaps are few enough for one range, the same rounds go on in its task.
    """
    spark = items.sparkSession
    is_ = lambda k: F.col("kind") == k
    pieces, gaps = items.select("id", "size"), None
    n_pieces, total, large = items.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.count(F.when(F.col("size") > capacity // 2, 1))).first()
    # As many sequences as the lengths or the large pieces need at least; the largest pieces begin them.
    need = max(-(-total // capacity), large)
    placed: list[DataFrame] = []
    n_gaps, first = 0, True
    while n_pieces:
        both = pieces.select(F.lit(PIECE).alias("kind"), "id", "size")
        if gaps is not None:
            both = both.unionByName(gaps.select(F.lit(GAP).alias("kind"), "id", "size"))
        tasks = max(1, -(-(n_pieces + n_gaps) // rows_per_task))
        if tasks == 1:
            placed.append(pinned(both.coalesce(1).mapInArrow(_rounds(capacity, need if first else 0), SPOTS), "pack-rounds"))
            break
        by = [F.col("size").desc(), F.col("kind"), F.col("id")]
        swept = pinned(both.repartitionByRange(tasks, *by).sortWithinPartitions(*by).mapInArrow(_sweep(capacity), _SWEPT), "pack-sweep")
        ranges = swept.groupBy("part").agg(
            F.count(F.when(is_(PIECE), 1)).alias("pieces"), F.count(F.when(is_(GAP), 1)).alias("gaps"), F.count(F.when(is_(PLACED), 1)).alias("placed"),
            F.max(F.when(is_(GAP) | is_(REST), F.col("size"))).alias("gap"), F.min(F.when(is_(PIECE), F.col("size"))).alias("least"),
        ).orderBy("part").collect()  # a row for each range, not for each piece
        depth = opened = across = 0
        scan = []
        for r in ranges:
            match = min(r.pieces, depth)
            scan.append((r.part, depth, match, opened))
            depth, opened, across = depth - match + r.gaps, opened + r.pieces - match, across + match
        left, rest = swept.filter(is_(PIECE)), swept.filter(is_(REST)).select("id", "size")
        placed.append(swept.filter(is_(PLACED)).select("id", F.col("seq").alias("sequence_id"), F.col("off").alias("offset")))
        ranks = F.broadcast(spark.createDataFrame(scan, "part int, depth long, match long, before long"))
        if across:
            level = F.when(is_(PIECE), F.col("depth") - F.col("rank")).otherwise(F.col("depth") - F.col("match") + F.col("rank") + 1)
            open_ = swept.filter(is_(GAP) | is_(PIECE)).join(ranks, "part").filter(is_(GAP) | (F.col("rank") < F.col("match")))
            w = Window.partitionBy("level").orderBy("part", F.col("kind").desc())
            nested = open_.withColumn("level", level).select(
                "kind", "id", "size", F.lag("id").over(w).alias("seq"), F.lag("size").over(w).alias("gap"), (F.lead("kind").over(w) == PIECE).alias("taken")
            )
            nested = pinned(nested, "pack-across")
            hit = nested.filter(is_(PIECE))
            placed.append(hit.select("id", F.col("seq").alias("sequence_id"), (capacity - F.col("gap")).alias("offset")))
            rest = rest.unionByName(hit.select(F.col("seq").alias("id"), (F.col("gap") - F.col("size")).alias("size")))
            rest = rest.unionByName(nested.filter(is_(GAP) & ~F.coalesce("taken", F.lit(False))).select("id", "size"))
        else:
            rest = rest.unionByName(swept.filter(is_(GAP)).select("id", "size"))
        left = left.join(ranks, "part").filter(F.col("rank") >= F.col("match")).withColumn("order", F.col("before") + F.col("rank") - F.col("match"))
        n_gaps = depth + sum(r.placed for r in ranges) + across
        if first:
            begun = left.filter(F.col("order") < need)
            placed.append(begun.select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
            rest = rest.unionByName(begun.select("id", (capacity - F.col("size")).alias("size")))
            left = left.filter(F.col("order") >= need)
            n_gaps, n_pieces = n_gaps + min(need, opened), max(0, opened - need)
        else:
            widest = max((r.gap or 0 for r in ranges), default=0)
            over = left.filter(F.col("size") > widest)
            tasks = max(1, -(-opened // rows_per_task))
            begun = pinned((over.repartition(tasks, "part") if tasks > 1 else over.coalesce(1)).sortWithinPartitions("order").select("id", "size").mapInArrow(_begin(capacity), _SWEPT), "pack-begin")
            placed.append(begun.filter(is_(PLACED)).select("id", F.col("seq").alias("sequence_id"), F.col("off").alias("offset")))
            rest = rest.unionByName(begun.filter(is_(REST)).select("id", "size"))
            left = left.filter(F.col("size") <= widest)
            n_pieces = left.count()
        least = min((r.least for r in ranges if r.least is not None), default=1)
        gaps, pieces = rest.filter(F.col("size") >= least), left.select("id", "size")
        first = False
    out = placed[0] if placed else items.select("id", F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, closing_id: int = 1, rows_per_task: int = 200_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text).

    Pieces up to a 32nd of ``capacity`` are first bundled, up to that length, so that the number of rounds, which is about that
    of the items of a sequence, doesn't follow the number of tiny documents.
    """
    pieces = pinned(cut_pieces(docs, tokenizer or default_path(), capacity, closing_id), "pack-pieces")
    limit = max(1, capacity // 32)
    tiny = pinned(pieces.filter(F.col("length") <= limit).select("uid", "length").mapInArrow(_bundles(limit), BUNDLED), "pack-bundles")
    items = tiny.groupBy("item").agg(F.sum("length").alias("size")).select(F.col("item").alias("id"), "size")
    items = pinned(items.unionByName(pieces.filter(F.col("length") > limit).select(F.col("uid").alias("id"), F.col("length").alias("size"))), "pack-items")
    inner = tiny.select("uid", "item", "inner").unionByName(pieces.filter(F.col("length") > limit).select("uid", F.col("uid").alias("item"), F.lit(0).cast("long").alias("inner")))
    spots = inner.join(place(items, capacity, rows_per_task).withColumnRenamed("id", "item"), "item").select("uid", "sequence_id", (F.col("offset") + F.col("inner")).alias("offset"))
    return pieces.join(spots, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
