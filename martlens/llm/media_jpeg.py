"""Baseline JPEG columns: a parser and Huffman decoder for DC-only luminance thumbnails, and a writer whose thumbnails are data.

A baseline image's DC coefficients are an eighth-size thumbnail. The writer stores bytes as such a thumbnail: with a DC
quantiser of 8, the mean of block b is exactly the byte b, so the bytes come back without loss from any baseline decoder. Each
row of blocks is a restart interval. The reader parses markers and decodes all intervals of many images in step with numpy, one
block of each at a time; images with other components, sampling or AC coefficients are read the same way.

Cases: a null text is empty. Payloads of any length are stored: one image of 576 blocks a row for every 8191 rows, further images
follow it in the stored form. Equal texts and repeated rows have equal values; an empty table gives an empty result. Other columns of the input aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.llm.common import map_texts

UNIT = 576
_ROWS = 8191
# Code lengths and symbols of the usual table for luminance DC differences; one code that ends a block's AC.
_DC_COUNTS, _DC_SYMBOLS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))
_AC_COUNTS, _AC_SYMBOLS = bytes([1, *[0] * 15]), bytes([0])
#: Place in the block, row by row, of the k-th coefficient: diagonals, up and down in turn.
ZIGZAG = np.array([8 * y + x for s in range(15) for y, x in ((s - x, x) if s % 2 == 0 else (x, s - x) for x in range(s + 1)) if x < 8 and y < 8])


def codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in the order of a DHT segment."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """Of every 16 bits: length << 8 | symbol of the code that they begin with; 0 where none does."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, code, length in codes(counts, symbols):
        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return table


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits (with the block's end) and their number for DC differences -255 to 255."""
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    table = {s: (c, n) for s, c, n in codes(_DC_COUNTS, _DC_SYMBOLS)}
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = table[size]
        bits[d + 255] = (code << size | (d if d > 0 else d + (1 << size) - 1) & ((1 << size) - 1)) << 1
        sizes[d + 255] = n + size + 1
    return bits, sizes


_BITS, _SIZES = _difference_codes()
_segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scans(rows: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded bytes of each row of samples, stuffed, end to end, and their bounds."""
    values = rows.astype(np.int64) - 128
    step = np.diff(values, axis=1, prepend=0) + 255
    sizes = _SIZES[step]
    total = sizes.sum(1)
    n_bytes = -(-total // 8)
    start = 8 * (np.cumsum(n_bytes) - n_bytes)
    at = (start[:, None] + np.cumsum(sizes, 1) - sizes).reshape(-1)
    sizes, bits = sizes.reshape(-1), _BITS[step].reshape(-1)
    pad = 8 * n_bytes - total
    at = np.concatenate([at, start + total])  # a row ends with ones
    sizes, bits = np.concatenate([sizes, pad]), np.concatenate([bits, (1 << pad) - 1])
    word, shifted = at >> 4, bits << (32 - (at & 15) - sizes)  # a code has at most 16 bits, so it lies in two words of 16
    n_words = int(n_bytes.sum() // 2 + 2)
    words = np.bincount(word, shifted >> 16, n_words + 1)[: n_words + 1] + np.bincount(word + 1, shifted & 0xFFFF, n_words + 1)[: n_words + 1]
    raw = words.astype(np.uint16).astype(">u2").tobytes()[: int(n_bytes.sum())]
    bounds = np.concatenate([[0], np.cumsum(n_bytes)])
    data = np.frombuffer(raw, np.uint8)
    full = np.flatnonzero(data == 0xFF)
    return np.insert(data, full + 1, 0).tobytes(), bounds + np.searchsorted(full, bounds)


def write(payloads: list[bytes]) -> list[bytes]:
    """Stored forms of payloads (a multiple of UNIT bytes, at least one)."""
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    scan, bounds = _scans(rows)
    bounds, out, row = bounds.tolist(), [], 0
    quantiser = bytes([8, *[1] * 63])
    for payload in payloads:
        parts, end = [], row + len(payload) // UNIT
        while row < end:
            n = min(_ROWS, end - row)
            parts += [
                b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xDB, b"\0" + quantiser), _segment(0xC0, struct.pack(">BHHB", 8, 8 * n, 8 * UNIT, 1) + b"\1\x11\0"),
                _segment(0xC4, b"\x00" + _DC_COUNTS + _DC_SYMBOLS), _segment(0xC4, b"\x10" + _AC_COUNTS + _AC_SYMBOLS), _segment(0xDD, struct.pack(">H", UNIT)), _segment(0xDA, b"\1\1\0\0\x3f\0"),
            ]
            for k in range(n):
                parts.append(scan[bounds[row + k] : bounds[row + k + 1]])
                if k < n - 1:
                    parts.append(bytes([0xFF, 0xD0 + k % 8]))
            parts.append(b"\xff\xd9")
            row += n
        out.append(b"".join(parts))
    return out


class Image:
    """What the markers of one baseline image say; scan: its entropy-coded bytes."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        self.quantisers: dict[int, int] = {}
        self.tables: dict[int, np.ndarray] = {}
        self.interval = 0
        while True:
            while data[at + 1] == 0xFF:
                at += 1
            marker, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    self.quantisers[body[k] & 15] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                    k += 1 + 64 * (1 + wide)
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    n = sum(body[k + 1 : k + 17])
                    self.tables[body[k]] = _cached_lookup(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                    k += 17 + n
            elif marker == 0xDD:
                (self.interval,) = struct.unpack(">H", body)
            elif marker == 0xC0:
                precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if precision != 8:
                    raise ValueError("only 8-bit samples are baseline")
                self.parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError("not a baseline image")
            elif marker == 0xDA:
                self.order = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                break
        end = at
        while True:
            end = data.index(b"\xff", end)
            if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                end += 2
            else:
                break
        self.scan, self.end = data[at:end], end
        while self.end + 1 < len(data) and data[self.end : self.end + 2] != b"\xff\xd9":
            self.end += 1
        self.end += 2

    def layout(self) -> tuple[list[tuple[int, int, int]], int, int, tuple[int, int]]:
        """(component, DC table, AC table) of each block of an MCU, MCUs across and down, luminance blocks of an MCU."""
        first = self.order[0][0]
        if len(self.order) == 1:
            return [(first, *self.order[0][1:])], -(-self.width // 8), -(-self.height // 8), (1, 1)
        h, v = max(p[0] for p in self.parts.values()), max(p[1] for p in self.parts.values())
        blocks = [(c, dc, ac) for c, dc, ac in self.order for _ in range(self.parts[c][0] * self.parts[c][1])]
        return blocks, -(-self.width // (8 * h)), -(-self.height // (8 * v)), self.parts[first][:2]


_known: dict[tuple[bytes, bytes], np.ndarray] = {}


def _cached_lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    if len(_known) > 64:
        _known.clear()
    return _known.setdefault((counts, symbols), lookup(counts, symbols)) if (counts, symbols) not in _known else _known[counts, symbols]


def _decode(images: list[Image]) -> list[np.ndarray]:
    """DC values, dequantised, of each image's first component: (MCUs, blocks of it in an MCU). All have one layout and tables."""
    blocks, _, _, luma = images[0].layout()
    n_luma = luma[0] * luma[1] if len(images[0].order) > 1 else 1
    tables, pieces, steps, owner = images[0].tables, [], [], []
    for k, image in enumerate(images):
        _, across, down, _ = image.layout()
        mcus, interval = across * down, image.interval or across * down
        scan = np.frombuffer(image.scan, np.uint8)
        full = np.flatnonzero(scan[:-1] == 0xFF) if len(scan) else np.zeros(0, np.int64)
        after = scan[full + 1]
        cuts = full[(after >= 0xD0) & (after <= 0xD7)]
        keep = np.ones(len(scan), bool)
        keep[full[after == 0] + 1] = False
        keep[cuts] = keep[cuts + 1] = False
        clean = scan[keep]
        ends = np.cumsum(keep)
        bounds = [0, *(ends[cuts].tolist()), len(clean)]
        pieces += [clean[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        steps += [min(interval, mcus - s) for s in range(0, mcus, interval)]
        owner += [k] * -(-mcus // interval)
        if len(pieces) != len(steps):
            raise ValueError("restart intervals don't fit the image")
    sizes = np.array([len(p) + 8 for p in pieces])
    flat = np.full(int(sizes.sum()), 0xFF, np.uint8)
    start = np.cumsum(sizes) - sizes
    inside = np.arange(len(flat)) - np.repeat(start, sizes) < np.repeat(sizes - 8, sizes)
    flat[inside] = np.concatenate(pieces)
    wide = flat.astype(np.uint32)
    window = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]  # 32 bits from each byte on
    pos, last = 8 * start, 8 * (start + sizes) - 32
    steps_of = np.array(steps)
    order = np.argsort(-steps_of, kind="stable")
    pos, last, sorted_steps = pos[order], last[order], steps_of[order]
    out = np.zeros((len(pieces), int(steps_of.max()), n_luma), np.int32)
    before = {c: np.zeros(len(pieces), np.int64) for c, _, _ in blocks}

    def peek(p: np.ndarray) -> np.ndarray:
        return (window[p >> 3] >> (16 - (p & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF

    def code(p: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = table[peek(p)]
        if not got.all():
            raise ValueError("a code that no table has")
        return got & 255, p + (got >> 8)

    for step in range(int(steps_of.max())):
        live = int(np.searchsorted(-sorted_steps, -step, "left"))  # intervals with more blocks than step
        p = pos[:live]
        seen = 0
        for c, dc, ac in blocks:
            size, p = code(p, tables[dc])
            raw = peek(p) >> (16 - size)
            value = np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)
            p = p + size
            before[c][:live] += value
            if c == images[0].order[0][0]:
                out[order[:live], step, seen] = before[c][:live]
                seen += 1
            symbol, p = code(p, tables[16 + ac])
            todo = np.flatnonzero(symbol)
            if len(todo):
                k = np.ones(len(todo), np.int64)
                s, q = symbol[todo], p[todo]
                while len(todo):
                    q = q + (s & 15)
                    k += (s >> 4) + 1
                    p[todo] = q
                    more = k < 64
                    todo, k, q = todo[more], k[more], q[more]
                    if len(todo):
                        s, q = code(q, tables[16 + ac])
                        p[todo] = q
                        on = s != 0
                        todo, k, s, q = todo[on], k[on], s[on], q[on]
            if (p > last[:live] + 32).any():
                raise ValueError("the scan ends too early")
        pos[:live] = p
    result, at = [], 0
    for image in images:
        _, across, down, _ = image.layout()
        n = -(-across * down // (image.interval or across * down))
        rows = [out[at + j, : steps[at + j]] for j in range(n)]
        result.append(np.concatenate(rows) * image.quantisers[image.parts[image.order[0][0]][2]])
        at += n
    return result


def thumbnails(stored: list[bytes]) -> list[list[np.ndarray]]:
    """The DC-only luminance thumbnail of every image of every stored form."""
    images: list[list[Image]] = []
    for data in stored:
        own, at = [], 0
        while at < len(data):
            own.append(Image(data, at))
            at = own[-1].end
        images.append(own)
    groups: dict[tuple, list[Image]] = {}
    for image in (i for own in images for i in own):
        groups.setdefault((tuple(image.layout()[0]), tuple(sorted((k, id(t)) for k, t in image.tables.items())), image.layout()[3]), []).append(image)
    made: dict[int, np.ndarray] = {}
    for group in groups.values():
        for image, dc in zip(group, _decode(group), strict=True):
            _, across, down, (h, v) = image.layout()
            mean = np.clip(np.floor(dc / 8 + 0.5) + 128, 0, 255).astype(np.uint8)
            full = mean.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            p = image.parts[image.order[0][0]]
            hm, vm = max(x[0] for x in image.parts.values()), max(x[1] for x in image.parts.values())
            made[id(image)] = full[: -(-(-(-image.height * p[1] // vm)) // 8), : -(-(-(-image.width * p[0] // hm)) // 8)]
    return [[made[id(i)] for i in own] for own in images]


def difference_hash(thumbnail: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 cells is brighter than the next of 8 x 9, the cells' means over the whole thumbnail."""
    rows, columns = (np.arange(n) * size // n for n, size in ((8, thumbnail.shape[0]), (9, thumbnail.shape[1])))
    cells = []
    for at, axis in ((rows, 0), (columns, 1)):
        edge = np.append(at, thumbnail.shape[axis])
        cells.append(np.maximum(np.diff(edge), 1))
    total = np.zeros((thumbnail.shape[0] + 1, thumbnail.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(thumbnail, 0, dtype=np.int64), 1, out=total[1:, 1:])
    r2, c2 = np.minimum(rows + cells[0], thumbnail.shape[0]), np.minimum(columns + cells[1], thumbnail.shape[1])
    sums = total[np.ix_(r2, c2)] - total[np.ix_(rows, c2)] - total[np.ix_(r2, columns)] + total[np.ix_(rows, columns)]
    means = sums / np.outer(np.maximum(r2 - rows, 1), np.maximum(c2 - columns, 1))
    return np.packbits(means[:, :-1] > means[:, 1:]).tobytes().hex()


STORED = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, feature string"


def _groups(sizes: list[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end] <= limit):
            total += sizes[end]
            end += 1
        yield at, end
        at = end


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for a, b in _groups(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            raw = [t or b"" for t in texts.slice(a, b - a).to_pylist()]
            media = write([t + b"\xff" * (UNIT * max(1, -(-len(t) // UNIT)) - len(t)) for t in raw])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column(2)
        for a, b in _groups(pc.binary_length(media).to_pylist()):
            rows, stored = [], media.slice(a, b - a).to_pylist()
            for data, images in zip(stored, thumbnails(stored), strict=True):
                payload = b"".join(i.tobytes() for i in images)
                height, width = 8 * sum(i.shape[0] for i in images), 8 * images[0].shape[1]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), width, height, f"{width}x{height}:" + ".".join(map(difference_hash, images))))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
                [x.split()[0] for x in FEATURES.split(", ")],
            )


def store_texts(docs: DataFrame) -> DataFrame:
    """STORED of every row of ``docs`` (doc_id, text): the text's UTF-8, padded with bytes 255, as a column of JPEG files."""
    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), _store, STORED)


def media_features(stored: DataFrame) -> DataFrame:
    """FEATURES of every row of ``stored`` (doc_id, n_bytes, media), from the stored bytes alone but for n_bytes."""
    return map_texts(stored.select("doc_id", "n_bytes", "media"), _features, FEATURES)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """FEATURES of every row of ``docs``: its texts stored as a column of media, and what is read from that column.

    The media are larger than the texts and hardly compress, so the column is streamed from the writer to the reader, not kept in a table.
    """
    return media_features(store_texts(docs))
