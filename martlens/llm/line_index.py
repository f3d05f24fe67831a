"""Line deduplication that can be undone: cuckoo filters in shards before exact tables of references.

A line's key is the line without white space at both ends, A-Z lower-cased. A ``LineIndex`` has tables in the shared folder:

* refs: a row for each key of each inserted document (h1, h2, doc_id), one folder a load;
* counts: of each load, how many references each key has in it, its smallest and its largest document;
* repeated: of the keys that at least two documents hold, the number of references and the smallest document;
* filters: for each shard of the keys a cuckoo filter of all keys that any document holds.

``insert`` asks the filters which keys of a load may be known. Only for those the counts of earlier loads are consulted: what a filter
denies is new, and what it takes for known by mistake is put right by the exact counts. New keys go into the filters. ``delete`` takes back
the references of documents, counts their keys anew and removes from the filters those that have none left, so that all is as if the
documents had never come. An index isn't changed: both return another one, which shares the tables that they left alone.

The keys of a shard are distinct, so a line that a third of the documents hold is one key in one shard. When shards would hold more than
``shard_keys`` keys on average, the filters are built anew, from the counts, for as many shards as it takes.

Cases: a null or empty text is one empty line. Rows that repeat a doc_id are one document: a key that only they hold isn't repeated. A
row without a doc_id is no document: it isn't counted, keeps all its lines and is never deleted. A document that is inserted again has its
references twice. Ids that aren't there are deleted without effect. A document that isn't in the index keeps all its lines. Keys are
compared by 128 bits of their BLAKE2b hash. Other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.llm.common import blocks, join_heavy, map_texts, marks, pinned, scratch_path

KEPT = "doc_id long, n_lines long, n_dropped long, kept string"
_KEY = ["h1", "h2"]
_SPACE = b" \t\n\x0b\x0c\r"
_U = np.uint64
SLOTS = 4


def _key(line: bytes, least: int) -> bytes | None:
    """The hash of a line's key; None if the key has fewer than ``least`` code points."""
    key = line.strip(_SPACE).lower()
    if len(key) < 4 * least and (len(key) < least or len(key.decode()) < least):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Which 64-bit hashes are in a set: never a wrong no, seldom a wrong yes. Any number of hashes is added or removed at a time.

    A hash has 16 bits as its print and two buckets, each told from the other and the print. What finds no slot after ``kicks`` rounds of
    moving others is kept in ``rest`` as it is, so that nothing is lost.
    """

    def __init__(self, table: np.ndarray, rest: np.ndarray):
        self.table, self.rest = table, rest

    @classmethod
    def empty(cls, hashes: int) -> CuckooFilter:
        """For so many hashes, at a load of 0.7 at most."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, hashes) / (0.7 * SLOTS)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16), np.zeros(0, _U))

    @classmethod
    def load(cls, table: bytes, rest: bytes) -> CuckooFilter:
        return cls(np.frombuffer(table, np.uint16).reshape(-1, SLOTS).copy(), np.frombuffer(rest, _U).copy())

    def dump(self) -> tuple[bytes, bytes]:
        return self.table.tobytes(), self.rest.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (hashes >> _U(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, (hashes & _U(len(self.table) - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        turn = (prints.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(32)
        return bucket ^ (turn & _U(len(self.table) - 1)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        prints, one = self._places(hashes)
        found = (self.table[one] == prints[:, None]).any(axis=1) | (self.table[self._other(prints, one)] == prints[:, None]).any(axis=1)
        return found | np.isin(hashes, self.rest) if len(self.rest) else found

    def _put(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Places prints in free slots of the buckets; which of them found one."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        free = self.table[b] == 0
        ok = rank < free.sum(axis=1)
        slot = np.argmax(np.cumsum(free[ok], axis=1) == rank[ok][:, None] + 1, axis=1)
        self.table[b[ok], slot] = prints[order][ok]
        done = np.zeros(len(b), bool)
        done[order[ok]] = True
        return done

    def add(self, hashes: np.ndarray, kicks: int = 200) -> None:
        """Adds hashes that aren't in the set."""
        prints, bucket = self._places(hashes)
        left = np.flatnonzero(~self._put(prints, bucket))
        left = left[~self._put(prints[left], self._other(prints[left], bucket[left]))]
        stuck = [h for h in left if not self._kick(prints[h : h + 1], bucket[h : h + 1], kicks)]
        self.rest = np.concatenate([self.rest, hashes[stuck]])

    def _kick(self, p: np.ndarray, b: np.ndarray, kicks: int) -> bool:
        """A print takes the place of another, which goes on to its other bucket, and so on; a chain without an end is taken back."""
        chain = []
        for k in range(kicks):
            if self._put(p, b)[0]:
                return True
            slot = (int(p[0]) + k) % SLOTS
            old = self.table[b, slot]
            chain.append((b[0], slot, old[0]))
            self.table[b[0], slot] = p[0]
            p, b = old, self._other(old, b)
        for at, slot, old in reversed(chain):
            self.table[at, slot] = old
        return False

    def remove(self, hashes: np.ndarray) -> None:
        """Removes hashes that are in the set."""
        for h in hashes[np.isin(hashes, self.rest)] if len(self.rest) else ():
            at = np.flatnonzero(self.rest == h)
            if len(at):
                self.rest = np.delete(self.rest, at[0])
                hashes = np.delete(hashes, np.flatnonzero(hashes == h)[0])
        prints, one = self._places(hashes)
        two = self._other(prints, one)
        pair = np.minimum(one, two) * (1 << 16) + prints
        left = np.arange(len(hashes))
        while len(left):  # of those that share print and buckets one a round
            now = left[np.unique(pair[left], return_index=True)[1]]
            left = np.setdiff1d(left, now)
            for bucket in (one, two):
                hit = self.table[bucket[now]] == prints[now][:, None]
                some = hit.any(axis=1)
                self.table[bucket[now[some]], hit[some].argmax(axis=1)] = 0
                now = now[~some]


def references(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, h1, h2): each key with at least ``least`` code points of each document, once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in blocks(batch.column(1)):
                raw, keys, sizes = data.tobytes(), [], []
                for k in range(b - a):
                    own = {_key(line, least) for line in raw[bounds[k] : bounds[k + 1]].split(b"\n")} - {None}
                    keys += own
                    sizes.append(len(own))
                h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                ids = batch.column(0).slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), sizes)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", *_KEY])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    return map_texts(docs, run, "doc_id long, h1 long, h2 long")


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy(*_KEY).agg(F.count("*").alias("refs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def _united(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*_KEY).agg(F.sum("refs").alias("refs"), F.min("first").alias("first"), F.max("last").alias("last"))


_REPEATED = "h1 long, h2 long, refs long, first long"
_FILTERS = "shard long, table binary, rest binary"


@dataclass(frozen=True)
class LineIndex:
    """Folders of the tables, the number of keys, shards (a filter each) and what a key needs to count."""

    spark: SparkSession
    refs: tuple[str, ...] = ()
    counts: tuple[str, ...] = ()
    repeated: str = ""
    filters: str = ""
    n_keys: int = 0
    shards: int = 0
    least: int = 10
    shard_keys: int = 1 << 17

    def _read(self, schema: str, *folders: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if any(folders) else self.spark.createDataFrame([], schema)

    def references(self) -> DataFrame:
        return self._read("doc_id long, h1 long, h2 long", *self.refs)

    def key_counts(self) -> DataFrame:
        """(h1, h2, refs, first, last), a row for each key and load that has it."""
        return self._read(f"{_REPEATED}, last long", *self.counts)

    def repeated_keys(self) -> DataFrame:
        return self._read(_REPEATED, self.repeated)

    def _shard(self) -> Column:
        return F.pmod("h1", F.lit(self.shards)).alias("shard")

    def _by_shard(self, keys: DataFrame, function, schema: str) -> DataFrame:
        """``function`` of each shard's filter and its rows of ``keys``."""
        filters, rows = self._read(_FILTERS, self.filters), keys.select(self._shard(), *_KEY)

        def one(own: pa.Table, asked: pa.Table) -> pa.Table:
            shard = (asked if asked.num_rows else own)["shard"][0].as_py()
            found = CuckooFilter.load(own["table"][0].as_py(), own["rest"][0].as_py()) if own.num_rows else CuckooFilter.empty(self_keys)
            return function(shard, found, asked)

        self_keys = self.shard_keys
        return filters.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(one, schema)

    def _asked(self, keys: DataFrame) -> DataFrame:
        """The ``keys`` (h1, h2) that the filters hold, and by mistake a few others."""

        def ask(_shard: int, own: CuckooFilter, asked: pa.Table) -> pa.Table:
            return asked.select(_KEY).filter(pa.array(own.has(_hashes(asked))))

        return self._by_shard(keys, ask, "h1 long, h2 long")

    def _changed(self, keys: DataFrame, remove: bool = False) -> str:
        """The folder of the filters after ``keys`` (h1, h2) were added or removed."""

        def change(shard: int, own: CuckooFilter, asked: pa.Table) -> pa.Table:
            (own.remove if remove else own.add)(_hashes(asked))
            table, rest = own.dump()
            return pa.table({"shard": [shard], "table": pa.array([table], pa.binary()), "rest": pa.array([rest], pa.binary())})

        return _written(self._by_shard(keys, change, _FILTERS), "filters")

    def _with_room(self, more: int) -> LineIndex:
        """The index with shards for ``more`` keys, its filters built anew if they are too few."""
        shards = max(1, self.shards)
        while shards * self.shard_keys < self.n_keys + more:
            shards *= 2
        if shards == self.shards:
            return self
        wide = replace(self, shards=shards, filters="")
        return replace(wide, filters=wide._changed(self.key_counts().select(*_KEY).distinct())) if self.n_keys else wide

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the documents ``docs`` (doc_id, text)."""
        refs = _written(references(docs, self.least), "refs")
        counts = _written(_counted(self._read("doc_id long, h1 long, h2 long", refs)), "counts")
        load = self._read(f"{_REPEATED}, last long", counts)
        n_load = load.count()
        if not n_load:
            return replace(self, refs=(*self.refs, refs))
        room = self._with_room(n_load)
        if room.n_keys:
            # Known by the filters, then by the exact counts of earlier loads.
            asked = pinned(room._asked(load), "asked")
            before = _united(room.key_counts().join(asked, _KEY, "left_semi"))
            known = pinned(before.join(load.select(*_KEY, F.col("refs").alias("more"), F.col("first").alias("low"), F.col("last").alias("high")), _KEY), "known")
            fresh = load.join(known.select(*_KEY), _KEY, "left_anti")
            both = known.select(*_KEY, (F.col("refs") + F.col("more")).alias("refs"), F.least("first", "low").alias("first"), F.greatest("last", "high").alias("last"))
            rows, n_known = fresh.unionByName(both), known.count()
            kept = room.repeated_keys().join(known.select(*_KEY), _KEY, "left_anti")
        else:
            fresh, rows, n_known, kept = load, load, 0, room.repeated_keys()
        filters = room._changed(fresh) if n_known < n_load else room.filters
        repeated = _written(kept.unionByName(rows.filter("first < last").select(*_KEY, "refs", "first")), "repeated")
        return replace(room, refs=(*room.refs, refs), counts=(*room.counts, counts), filters=filters, repeated=repeated, n_keys=room.n_keys + n_load - n_known)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of ``ids`` (doc_id)."""
        ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        gone = pinned(self.references().join(ids, "doc_id", "left_semi").select(*_KEY).distinct(), "gone")
        n_gone = gone.count()
        if not n_gone:
            return self
        refs = _written(self.references().join(ids, "doc_id", "left_anti"), "refs")
        # Summed up before they are joined, so that the references of a common key don't meet in a task.
        left = _counted(self._read("doc_id long, h1 long, h2 long", refs))
        now = pinned(gone.join(left, _KEY, "left"), "recounted")
        counts = _written(self.key_counts().join(gone, _KEY, "left_anti").unionByName(now.filter("refs IS NOT NULL")), "counts")
        lost = now.filter("refs IS NULL").select(*_KEY)
        n_lost = lost.count()
        filters = self._changed(lost, remove=True) if n_lost else self.filters
        repeated = _written(self.repeated_keys().join(gone, _KEY, "left_anti").unionByName(now.filter("first < last").select(*_KEY, "refs", "first")), "repeated")
        return replace(self, refs=(refs,), counts=(counts,), filters=filters, repeated=repeated, n_keys=self.n_keys - n_lost)

    def clean(self, docs: DataFrame) -> DataFrame:
        """KEPT of each row of ``docs`` (doc_id, text): the text without lines that a smaller document of the index holds too.

        Of a key that at least two documents hold, only the smallest of them keeps its lines, all of them.
        """
        least, refs = self.least, self.references()
        repeated = self.repeated_keys().withColumnRenamed("refs", "n")
        held = join_heavy(refs, repeated, _KEY, "n", refs.count()).filter("doc_id > first")
        drops = pinned(held.groupBy("doc_id").agg(F.collect_set(F.struct(*_KEY)).alias("drop")), "drops")
        # Only the texts that lose lines are shuffled, and the few others that share a bit with one.
        texts = marks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), drops).withColumn("marked", F.col("marked") & F.col("doc_id").isNotNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                each = pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy()
                keys = batch.column(2).flatten()
                keys = np.stack([keys.field(0).to_numpy(), keys.field(1).to_numpy()], axis=1).astype(np.int64).tobytes() if len(keys) else b""
                ends = np.concatenate([[0], np.cumsum(each)]).tolist()
                for a, b, data, bounds in blocks(batch.column(1)):
                    raw, n_lines, n_dropped, kept = data.tobytes(), [], [], []
                    for k in range(b - a):
                        text = raw[bounds[k] : bounds[k + 1]]
                        drop = {keys[16 * i : 16 * i + 16] for i in range(ends[a + k], ends[a + k + 1])}
                        lines = text.split(b"\n")
                        stay = [line for line in lines if _key(line, least) not in drop] if drop else lines
                        n_lines.append(len(lines))
                        n_dropped.append(len(lines) - len(stay))
                        kept.append(b"\n".join(stay))
                    out = [batch.column(0).slice(a, b - a), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_lines", "n_dropped", "kept"])

        whole = texts.filter(~F.col("marked")).select("doc_id", "text", F.lit(None).cast(drops.schema["drop"].dataType).alias("drop"))
        joined = texts.filter("marked").join(drops, "doc_id", "left").select("doc_id", "text", "drop")
        return map_texts(whole, run, KEPT).unionByName(map_texts(joined, run, KEPT))


def _hashes(keys: pa.Table) -> np.ndarray:
    return keys["h2"].to_numpy().astype(np.int64).view(_U)


def _written(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def dedup_lines(docs: DataFrame, loads: int = 2, least: int = 10) -> DataFrame:
    """KEPT of each row of ``docs`` (doc_id, text), which come to the index in so many loads, dealt by a hash of doc_id."""
    index = LineIndex(docs.sparkSession, least=least)
    for k in range(loads):
        index = index.insert(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(loads)) == k))
    return index.clean(docs)
