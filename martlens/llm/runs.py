"""Periodic runs of words: suffix trees of a document and of its reversal, Lyndon roots, extension to both sides.

A run is a stretch of consecutive words with smallest period q and at least ``max(least, 2 * q)`` words that no neighbouring word
extends keeping q. For each of the two orders of the words (one the other's reverse) the longest Lyndon word at every place is a
candidate for a run's root. How far it repeats is the longest common extension of two suffixes, to the right in the tree of the
document, to the left in that of the reversal: the depth of the lowest common ancestor of two leaves, found in constant time by
the least depth in an Euler tour.

Only the words that can be in a run enter a tree. With ``least`` at 12, a run has six words in a row that stand again q words later; so
each of its words lies in a run of six that occurs twice in the document. The maximal stretches of such words, each closed by a symbol of
its own, make up the string. Nothing is lost by that, and no run crosses such a symbol.

Cases: a null, empty or blank text has no words, no runs and an empty collapsed text. Rows are taken one by one, whatever doc_id they
have, null or repeated; other columns aren't read. An empty table gives an empty result. A document is worked on in one task: its tree takes about
500 bytes for each word that lies in such a stretch. Words are compared by 64-bit hashes (see ``bytewords``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.llm.bytewords import shingles, words
from martlens.llm.common import blocks, map_texts

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class SuffixTree:
    """Ukkonen's suffix tree of a list of symbols from 1 on; a closing symbol 0 is added."""

    def __init__(self, symbols: list[int]):
        s = [*symbols, 0]
        n, width = len(s), max(s) + 1
        start, stop, link, child_of = [0], [0], [0], {}
        node = edge = length = due = 0
        for i, c in enumerate(s):
            due += 1
            fresh = 0  # the inner node that waits for its suffix link
            while due:
                if not length:
                    edge = i
                key = node * width + s[edge]
                child = child_of.get(key)
                if child is None:
                    child_of[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    span = stop[child] - start[child]
                    if length >= span:
                        node, edge, length = child, edge + span, length - span
                        continue
                    at = start[child] + length
                    if s[at] == c:
                        length += 1
                        if fresh:
                            link[fresh] = node
                        break
                    inner = len(start)
                    start += (start[child], i)
                    stop += (at, n)
                    link += (0, 0)
                    child_of[key] = inner
                    start[child] = at
                    child_of[inner * width + s[at]] = child
                    child_of[inner * width + c] = inner + 1
                    if fresh:
                        link[fresh] = inner
                    fresh = inner
                due -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - due + 1
        keys = np.fromiter(child_of.keys(), np.int64, len(child_of))
        kids = np.fromiter(child_of.values(), np.int64, len(child_of))
        order = np.argsort(keys)
        kids, (owner, symbol) = kids[order], np.divmod(keys[order], width)
        self.rising, self.falling = kids, kids[np.argsort(owner * width + np.where(symbol > 0, width - symbol, 0))]
        self.first = np.searchsorted(owner, np.arange(len(start) + 1))
        parent = np.zeros(len(start), np.int64)
        parent[kids] = owner
        begin = np.array(start)
        span = np.array(stop) - begin
        span[0] = 0
        self.depth, up = span.copy(), parent.copy()
        while up.any():
            self.depth += self.depth[up]
            up = up[up]
        self.parent, self.n = parent, n
        leaf = np.diff(self.first) == 0
        self.suffix = np.where(leaf, n - self.depth, -1)

    def tour(self, falling: bool = False) -> tuple[list[int], np.ndarray]:
        """Euler tour: the nodes as they are passed, and the leaves in order of their suffixes; falling: the larger symbols first.

        In both orders the closing symbol is the smallest, so that a prefix comes before what it begins.
        """
        kids = (self.falling if falling else self.rising).tolist()
        place, end, parent = self.first[:-1].tolist(), self.first[1:].tolist(), self.parent.tolist()
        out, node = [], 0
        add = out.append
        while True:
            add(node)
            k = place[node]
            if k < end[node]:
                place[node] = k + 1
                node = kids[k]
            elif node:
                node = parent[node]
            else:
                break
        passed = np.array(out)
        return passed, passed[self.suffix[passed] >= 0]


class Extensions:
    """Longest common extensions of two places, any number at a time: least depths between two leaves of an Euler tour."""

    def __init__(self, tree: SuffixTree, passed: np.ndarray):
        depth = tree.depth[passed].astype(np.int32)
        self.place = np.zeros(tree.n, np.int64)
        at = np.flatnonzero(tree.suffix[passed] >= 0)
        self.place[tree.suffix[passed[at]]] = at
        self.table = [depth]
        step = 1
        while 2 * step <= len(depth):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at i and at j (i and j differ) have in common."""
        a, b = np.minimum(self.place[i], self.place[j]), np.maximum(self.place[i], self.place[j]) + 1
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            m = level == k
            row = self.table[k]
            out[m] = np.minimum(row[a[m]], row[b[m] - (1 << k)])
        return out


def lyndon_ends(rank: list[int]) -> list[int]:
    """For each place the end of the longest Lyndon word that starts there: the next place of a smaller suffix."""
    n = len(rank)
    out, stack = [n] * n, []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return out


def all_runs(symbols: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of a string of symbols from 1 on with at least two periods, by start, then period."""
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    tree, back = SuffixTree(symbols.tolist()), SuffixTree(symbols[::-1].tolist())
    passed, rising = tree.tour()
    right, left = Extensions(tree, passed), Extensions(back, back.tour()[0])
    found = []
    for leaves in (rising, tree.tour(falling=True)[1]):
        rank = np.zeros(tree.n, np.int64)
        rank[tree.suffix[leaves]] = np.arange(tree.n)
        j = np.array(lyndon_ends(rank[:n].tolist()))
        i = np.flatnonzero(j < n)
        j = j[i]
        more, less = right(i, j), np.zeros(len(i), np.int64)
        inside = i > 0
        less[inside] = left(n - i[inside], n - j[inside])  # i - 1 and j - 1, counted from the end
        q = j - i
        length = q + more + less
        ok = length >= 2 * q
        found.append(np.stack([i - less, length, q], axis=1)[ok])
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _stretches(hashes: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """Which words of the rows ending at ``bounds`` can be in a run: those in ``least // 2`` words in a row that a row has twice."""
    size = least // 2
    grams, counts = shingles(hashes, np.diff(bounds), size)
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[row]
    order = np.lexsort((grams, row))
    same = (grams[order][1:] == grams[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(hashes) + size + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + size, -1)
    return np.cumsum(change[: len(hashes)]) > 0


def word_runs(hashes: np.ndarray, covered: np.ndarray, least: int) -> np.ndarray:
    """(start, length, period) of the runs among the words of a document, of which only ``covered`` ones can be in a run."""
    place = np.flatnonzero(covered)
    if len(place) < least:
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero(np.diff(place) > 1) + 1
    _, ids = np.unique(hashes[place], return_inverse=True)
    top = int(ids.max()) + 2
    symbols = np.insert(ids + 1, cut, top + np.arange(len(cut)))
    origin = np.insert(place, cut, -1)
    found = all_runs(symbols)
    found = found[found[:, 1] >= np.maximum(least, 2 * found[:, 2])]
    found[:, 0] = origin[found[:, 0]]
    return found


def find_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed of each row of ``docs`` (doc_id, text).

    collapsed: the words joined by one space, without those that a run holds after its first period. least: smallest length of a run,
    from 2 on. One pass over the texts, no shuffle.
    """
    if least < 2:
        raise ValueError("a run has two words at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for a, b, data, bounds in blocks(batch.column(1)):
                hashes, per_row = words(data, bounds)
                ends = np.concatenate([[0], np.cumsum(per_row)])
                covered = _stretches(hashes, ends, least)
                some = np.diff(np.concatenate([[0], np.cumsum(covered)])[ends])
                raw = data.tobytes()
                runs, texts = [], []
                for k in range(b - a):
                    tokens = raw[bounds[k] : bounds[k + 1]].split()
                    found = word_runs(hashes[ends[k] : ends[k + 1]], covered[ends[k] : ends[k + 1]], least) if some[k] >= least else ()
                    if len(found):
                        change = np.zeros(len(tokens) + 1, np.int64)
                        np.add.at(change, found[:, 0] + found[:, 2], 1)
                        np.add.at(change, found[:, 0] + found[:, 1], -1)
                        tokens = [tokens[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                    runs.append([{"start": x, "length": y, "period": z} for x, y, z in found.tolist()] if len(found) else [])
                    texts.append(b" ".join(tokens))
                out = [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(per_row, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "runs", "collapsed"])

    return map_texts(docs.select("doc_id", "text"), run, RUNS)


def looped(doc_id: Column, text: Column) -> Column:
    """``text`` with a loop at the end, for one doc_id of ten: from word a on it repeats p words, both fixed by a hash of doc_id."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    tokens = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = lambda w: F.size(w).cast("long")

    def turned(w: Column) -> Column:
        a = F.pmod(g, n(w))
        p = 1 + F.floor((n(w) - a) / (3 + g % 8)).cast("long")
        return F.transform(w, lambda x, i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))

    # The words are bound once: higher-order functions give a name to a value.
    edited = F.get(F.transform(F.array(tokens), lambda w: F.when(n(w) > 0, F.array_join(turned(w), " ")).otherwise("")), 0)
    return F.when(h % 10 == 0, edited).otherwise(text)
