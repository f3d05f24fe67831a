"""Token ids by a public tokenizer, with a bounded table of white-space chunks.

The normaliser and the pre-tokenizer of the word BPE never join anything across white space, so the ids of a text are those
of its chunks, and the ids of a chunk those of its pre-tokens, one after another. The chunks of a block of texts are found,
hashed and looked up with numpy; only chunks not yet in the table go to the tokenizer. Texts with characters for which that
isn't plain (controls, anything beyond Latin letters, a special token's opening) go through the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from martlens.llm.bytewords import SPACE, runs, span_hashes
from martlens.llm.common import blocks

#: The tokenizer's own pre-tokens, for lower-case chunks of plain characters.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Bytes that no plain text has: controls, and the leading bytes of what lies beyond U+024F.
_ODD = np.zeros(256, bool)
_ODD[[*range(9), 11, 12, *range(14, 32), 127, *range(0xCA, 256)]] = True
#: Second bytes after 0xC2 that aren't plain: controls, the no-break space, digits and fractions.
_ODD_C2 = np.zeros(256, bool)
_ODD_C2[[*range(0x80, 0xA1), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def odd_rows(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows that have to be encoded whole."""
    after = np.append(data[1:], np.uint8(0))
    odd = _ODD[data] | ((data == 0xC2) & _ODD_C2[after]) | ((data == 0xC4) & (after == 0xB0)) | ((data == 0xC9) & (after >= 0x90)) | ((data == 0x3C) & (after == 0x7C))
    return np.unique(np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1)


class Encoder:
    """Unsigned 32-bit ids of texts. At most ``most`` chunks are kept, then the table starts anew."""

    _made: dict[tuple[str, bool], Encoder] = {}
    SLOTS = 1 << 20
    _SHIFT = np.uint64(64 - 20)

    def __init__(self, path: str, plain: bool = False, most: int = 500_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; every further thread would keep memory of its own
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        self.pool, self.starts, self.sizes = np.zeros(1 << 20, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.filled = self.entries = 0
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def get(cls, path: str, plain: bool = False) -> Encoder:
        """One for each worker process. plain: a special token's string in a text is ordinary text."""
        if (path, plain) not in cls._made:
            cls._made[path, plain] = cls(path, plain)
        return cls._made[path, plain]

    def whole(self, texts: list[str], limit: int = 1 << 16) -> list[bytes]:
        """Ids of whole texts, about ``limit`` characters at a time: an encoding takes over a hundred bytes for each token."""
        out, part, size = [], [], 0
        for k, text in enumerate(texts):
            part.append(text)
            size += len(text)
            if size >= limit or k == len(texts) - 1:
                out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                part, size = [], 0
        return out

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens, many at a time: each ends with the only token that closes a word."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 4000):
            part = pieces[at : at + 4000]
            lines = [" ".join(part[k : k + 400]) for k in range(0, len(part), 400)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                out += self.whole(part)
                continue
            raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        parts = [_PIECE.findall(c) for c in chunks]
        known = self.pieces
        fresh = list({p for ps in parts for p in ps if p not in known})
        known.update(zip(fresh, self._encode_pieces(fresh), strict=True))
        out = [known[ps[0]] if len(ps) == 1 else b"".join(map(known.__getitem__, ps)) for ps in parts]
        if len(known) > self.most // 4:
            self.pieces = {}
        return out

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        slot = (hashes >> self._SHIFT).astype(np.int64)
        found = np.where(self.keys[slot] == hashes, self.at[slot], -1)
        left = np.flatnonzero((found < 0) & (self.keys[slot] != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (self.SLOTS - 1)
            key = self.keys[slot[left]]
            hit = key == hashes[left]
            found[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (key != 0)]
        return found

    def _add(self, hashes: np.ndarray, values: list[bytes]) -> None:
        ids = np.frombuffer(b"".join(values), "<u4")
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        n, end = len(values), self.filled + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        if self.entries + n > len(self.starts):
            more = np.zeros(max(len(self.starts), n), np.int64)
            self.starts, self.sizes = np.concatenate([self.starts, more]), np.concatenate([self.sizes, more])
        self.pool[self.filled : end] = ids
        new = np.arange(self.entries, self.entries + n)
        self.starts[new], self.sizes[new] = self.filled + np.cumsum(sizes) - sizes, sizes
        self.filled, self.entries = end, self.entries + n
        slot, left = (hashes >> self._SHIFT).astype(np.int64), np.arange(n)
        while len(left):
            empty = left[self.keys[slot[left]] == 0]
            self.keys[slot[empty]] = hashes[empty]
            done = empty[self.keys[slot[empty]] == hashes[empty]]
            self.at[slot[done]] = new[done]
            left = np.setdiff1d(left, done, assume_unique=True)
            slot[left] = (slot[left] + 1) & (self.SLOTS - 1)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, all ids, ids of each row) for blocks of whole rows; a null text is empty."""
        lower = pc.utf8_lower(column)
        dotted = np.flatnonzero(pc.fill_null(pc.match_substring(column, "\u0130"), False).to_numpy(zero_copy_only=False))  # the one letter whose lower case has two characters
        for first, end, data, bounds in blocks(lower):
            odd = np.union1d(odd_rows(data, bounds), dotted[(dotted >= first) & (dotted < end)] - first).astype(np.int64)
            inside = ~SPACE[data]
            for r in odd:
                inside[bounds[r] : bounds[r + 1]] = False
            starts, ends = runs(inside, bounds)
            per_row = np.diff(np.searchsorted(starts, bounds))
            hashes = span_hashes(data, starts, ends) | np.uint64(1)
            if self.entries > self.most:
                self._clear()
            entry = self._find(hashes)
            missing = np.flatnonzero(entry < 0)
            if len(missing):
                fresh, at = np.unique(hashes[missing], return_index=True)
                at = missing[at]
                raw = data.tobytes()
                self._add(fresh, self._encode_chunks([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
                entry[missing] = self._find(hashes[missing])
            sizes = self.sizes[entry]
            total = np.cumsum(sizes)
            ids = self.pool[np.repeat(self.starts[entry] - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)]
            row_end = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(per_row)])]
            counts = np.diff(row_end)
            if len(odd):
                whole = dict(zip(odd.tolist(), self.whole([column[first + r].as_py() or "" for r in odd.tolist()]), strict=True))
                ids = np.concatenate([np.frombuffer(whole[r], "<u4") if r in whole else ids[row_end[r] : row_end[r + 1]] for r in range(end - first)])
                counts = np.array([len(whole[r]) // 4 if r in whole else counts[r] for r in range(end - first)])
            yield first, end, ids, counts
