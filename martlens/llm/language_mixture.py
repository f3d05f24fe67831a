"""Languages of documents by multilingual mixture inference.

A language is a distribution over hashed character trigrams, learned from labelled texts. A document is a mixture: expectation
maximisation estimates the proportions of all languages from the likelihoods of its trigrams, then nested sets of the likeliest
languages are refitted and the set with the highest penalised likelihood stays.

Cases: a null text or one without letters is ``und`` with score 0. Rows whose lang is null teach nothing. Where no row teaches
anything, every text is ``und``. Repeated rows count as often as they stand. Only doc_id, text and lang are read, and of these a
prediction uses the text alone. Ties go to the language that sorts first. Very long texts are counted in whole, in blocks. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.llm.common import map_texts

BUCKETS = 1 << 15
PREDICTED = "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>"


class Table(NamedTuple):
    """Logs of trigram distributions, by bucket: of bucket b the languages at[first[b] : first[b + 1]] with logs there; others have ``rest``.

    It takes 12 bytes for each pair of a language and a bucket seen in it, 390 KB a language at the most.
    """

    first: np.ndarray
    at: np.ndarray
    logs: np.ndarray
    rest: np.ndarray

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        """The logs of all languages for each of ``buckets``."""
        out = np.repeat(self.rest[None, :], len(buckets), 0)
        n = self.first[buckets + 1] - self.first[buckets]
        row = np.repeat(np.arange(len(buckets)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[buckets], n)
        out[row, self.at[place]] = self.logs[place]
        return out


_fold: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Of every code point: itself where it is a letter, else a space."""
    if not _fold:
        _fold.append(np.fromiter((i if chr(i).isalpha() else 32 for i in range(0x110000)), np.uint32, 0x110000))
    return _fold[0]


def trigrams(text: str, block: int = 1 << 20) -> np.ndarray | None:
    """Counts of the text's hashed trigrams (lower case, all but letters as one space); None without letters."""
    counts, tail, any_letter = np.zeros(BUCKETS, np.int64), np.array([32], np.uint32), False
    for at in range(0, len(text), block):
        points = _letters()[np.frombuffer(text[at : at + block].lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        points = np.concatenate([tail, points, [np.uint32(32)]] if at + block >= len(text) else [tail, points])
        space = points == 32
        points = points[~(space & np.concatenate([[False], space[:-1]]))]
        any_letter |= bool((points != 32).any())
        if len(points) > 2:
            h = (points[:-2] * np.uint32(0x9E3779B1)) ^ (points[1:-1] * np.uint32(0x85EBCA77)) ^ (points[2:] * np.uint32(0xC2B2AE3D))
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(17), minlength=BUCKETS)
        tail = points[-2:]
    return counts if any_letter else None


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame) -> tuple[list[str], Table]:
    """The languages, any number of them, and their trigram distributions, from all labelled rows that aren't held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = trigrams(text)
                if c is not None:
                    total[lang] = total[lang] + c if lang in total else c
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", F.col("lang").cast("string"))
    table = map_texts(rows, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = table.orderBy("bucket", "lang").toArrow()
    langs = sorted(table.column("lang").unique().to_pylist())
    which = pc.index_in(table.column("lang"), pa.array(langs, pa.string())).to_numpy().astype(np.int32)
    n, bucket = table.column("n").to_numpy(), table.column("bucket").to_numpy()
    total = np.bincount(which, n, len(langs)) + 0.5 * BUCKETS
    return langs, Table(np.searchsorted(bucket, np.arange(BUCKETS + 1)), which, np.log((n + 0.5) / total[which]), np.log(0.5 / total))


def _em(p: np.ndarray, c: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``p`` in trigrams counted ``c``, and the log-likelihood that they give."""
    n = c.sum()
    for _ in range(rounds):
        new = share * ((c / (p @ share)) @ p) / n
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-3:
            break
    return share, float(c @ np.log(p @ share))


def mixture(counts: np.ndarray, table: Table, penalty: float, rounds: int) -> tuple[list[int], np.ndarray]:
    """Languages (the likeliest first) and shares of a document by the best penalised likelihood."""
    at = np.flatnonzero(counts)
    c, n = counts[at].astype(float), counts.sum()
    p = table.rows(at)
    p = np.exp(p - p.max(1, keepdims=True))
    k = p.shape[1]
    share, _ = _em(p, c, np.full(k, 1 / k), rounds)
    order = np.lexsort((np.arange(k), -share))
    best, value = None, -np.inf
    for size in range(1, k + 1):
        chosen = order[:size]
        part = np.ascontiguousarray(p[:, chosen])
        part = np.maximum(part, 1e-300)
        s, like = (np.ones(1), float(c @ np.log(part[:, 0]))) if size == 1 else _em(part, c, share[chosen] / max(share[chosen].sum(), 1e-300) * 0.9 + 0.1 / size, rounds)
        like -= penalty * (size - 1) * np.log(n)
        if like <= value:
            break
        best, value = (chosen, s), like
    chosen, s = best
    o = np.lexsort((chosen, -s))
    return chosen[o].tolist(), s[o]


def identify(docs: DataFrame, model: tuple[list[str], Table], penalty: float = 2.0, rounds: int = 20) -> DataFrame:
    """PREDICTED of every row of ``docs`` (doc_id, text): the language of the largest share, that share, and the whole mixture.

    penalty: for each further language, times the log of the number of trigrams (one half is the Bayesian criterion; trigrams of
    a text hang together, so that more is asked for).
    """
    langs, _ = model
    sent = docs.sparkSession.sparkContext.broadcast((langs, tuple(model[1]))) if langs else None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                counts = trigrams(text) if text and sent else None
                if counts is None:
                    out.append(("und", 0.0, [], []))
                    continue
                names, table = sent.value
                chosen, shares = mixture(counts, Table(*table), penalty, rounds)
                shares = np.clip(shares, 0, 1)
                out.append((names[chosen[0]], float(shares[0]), [names[k] for k in chosen], shares.tolist()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "lang_pred", "score", "languages", "shares"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), predict, PREDICTED)


def in_one_language(docs: DataFrame, model: tuple[list[str], Table], least: float = 0.5, penalty: float = 2.0, rounds: int = 20) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has letters and a language with a share of at least ``least``."""
    sent, text = docs.sparkSession.sparkContext.broadcast(tuple(model[1])), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (trigrams(t) if t else None for t in batch.column(text).to_pylist())
            keep = [c is not None and bool(mixture(c, Table(*sent.value), penalty, rounds)[1][0] >= least) for c in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_texts(docs, run, docs.schema)
