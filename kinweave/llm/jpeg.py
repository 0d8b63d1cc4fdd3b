"""Media columns: baseline JPEG in numpy.

The writer stores bytes losslessly: every 64 bytes are the 64 quantised coefficients of
one 8x8 block (each byte less a constant), Huffman-coded without loss, a restart marker
after every block, the number of stored blocks in a comment. The reader is that of any
baseline JPEG: it parses markers, Huffman-decodes the scan, and rebuilds a luminance
thumbnail from the DC coefficients alone. Restart intervals are independent, so all
intervals of a batch of images are decoded in lockstep, one symbol of each per step.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import map_texts, table

BLOCK, SHIFT, THUMB = 64, 96, 8
#: Blocks whose bits the writer spreads at once.
SPREAD = 2048


class MediaError(ValueError):
    """A stream that isn't a baseline JPEG that this reader knows."""


# --- Huffman tables -----------------------------------------------------------------


def _writer_tables() -> tuple[tuple[list[int], list[int]], tuple[list[int], list[int]]]:
    """Counts by code length and symbols, for DC and AC. Rule: sizes without a run of zeros
    and the block's end get 4 bits, what is left gets 9."""
    dc = [0] * 16
    dc[3] = 9
    common = [*range(1, 9), 0x00]
    rare = [run << 4 | size for run in range(1, 16) for size in range(1, 9)] + [0xF0]
    ac = [0] * 16
    ac[3], ac[8] = len(common), len(rare)
    return (dc, list(range(9))), (ac, common + rare)


def _codes(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """Canonical ``(symbol, code, length)``."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            out.append((symbol, code, length))
            code += 1
        at += n
        code <<= 1
    return out


def _lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """By the next 16 bits: ``length << 8 | symbol``, 0 if no code begins so."""
    found = np.zeros(1 << 16, np.int32)
    for symbol, code, length in _codes(counts, symbols):
        if code >= 1 << length:
            raise MediaError("a Huffman table is too full")
        found[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return found


# --- writer -------------------------------------------------------------------------


class Writer:
    """Encodes payloads (each a positive multiple of 64 bytes) as grey baseline JPEGs."""

    def __init__(self):
        (dc, dc_symbols), (ac, ac_symbols) = _writer_tables()
        self.dc_code, self.dc_size = np.zeros(16, np.uint64), np.zeros(16, np.int64)
        for s, code, n in _codes(dc, dc_symbols):
            self.dc_code[s], self.dc_size[s] = code, n
        self.ac_code, self.ac_size = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        for s, code, n in _codes(ac, ac_symbols):
            self.ac_code[s], self.ac_size[s] = code, n
        tables = b"".join(bytes([kind]) + bytes(counts) + bytes(symbols) for kind, counts, symbols in ((0x00, dc, dc_symbols), (0x10, ac, ac_symbols)))
        self.fixed = b"\xff\xdb" + struct.pack(">HB", 67, 0) + b"\x01" * 64
        self.coding = b"\xff\xc4" + struct.pack(">H", 2 + len(tables)) + tables + b"\xff\xdd" + struct.pack(">HH", 4, 1)
        self.scan = b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 0, 63, 0])

    def _bits(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and lengths of the 65 parts of each block: DC, 63 AC, its end."""
        v = blocks.astype(np.int64) - SHIFT
        size = np.zeros(v.shape, np.int64)
        m = np.abs(v)
        for b in range(8):
            size += m >= 1 << b
        value = np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)
        codes, lengths = np.zeros((len(v), 65), np.uint64), np.zeros((len(v), 65), np.int64)
        codes[:, 0] = self.dc_code[size[:, 0]] << size[:, 0].astype(np.uint64) | value[:, 0]
        lengths[:, 0] = self.dc_size[size[:, 0]] + size[:, 0]
        some = v != 0
        some[:, 0] = True
        last = np.maximum.accumulate(np.where(some, np.arange(64), 0), axis=1)
        run = np.arange(1, 64) - last[:, :-1] - 1
        far, symbol = run >> 4, (run & 15) << 4 | size[:, 1:]
        code, n = self.ac_code[symbol], self.ac_size[symbol]
        if far.any():  # runs of 16 zeros come first
            for _ in range(3):
                more = (far > 0) & some[:, 1:]
                code = np.where(more, self.ac_code[0xF0] << n.astype(np.uint64) | code, code)
                n = np.where(more, n + self.ac_size[0xF0], n)
                far = far - 1
        codes[:, 1:64] = np.where(some[:, 1:], code << size[:, 1:].astype(np.uint64) | value[:, 1:], 0)
        lengths[:, 1:64] = np.where(some[:, 1:], n + size[:, 1:], 0)
        ended = last[:, 63] < 63
        codes[:, 64] = np.where(ended, self.ac_code[0], 0)
        lengths[:, 64] = np.where(ended, self.ac_size[0], 0)
        return codes, lengths

    def _segments(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entropy-coded bytes of all blocks, each padded and stuffed, and where each ends."""
        data, ends, size = [], [], 0
        for at in range(0, len(blocks), SPREAD):
            out, stops = self._stuffed(blocks[at : at + SPREAD])
            data.append(out), ends.append(stops + size)
            size += len(out)
        return np.concatenate(data), np.concatenate(ends)

    def _stuffed(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, lengths = self._bits(blocks)
        total = lengths.sum(axis=1)
        room = -(-total // 8)
        first = (np.cumsum(room) - room) * 8
        lengths = lengths.ravel()
        n = int(lengths.sum())
        stop = np.cumsum(lengths)
        within = np.arange(n) - np.repeat(stop - lengths, lengths)
        bit = (np.repeat(codes.ravel(), lengths) >> (np.repeat(lengths, lengths) - 1 - within).astype(np.uint64)).astype(np.uint8) & 1
        bits = np.ones(int(room.sum()) * 8, np.uint8)  # padding is ones
        bits[np.arange(n) + np.repeat(first - (np.cumsum(total) - total), total)] = bit
        packed = np.packbits(bits)
        full = packed == 0xFF
        place = np.arange(len(packed)) + np.cumsum(full) - full
        out = np.zeros(len(packed) + int(full.sum()), np.uint8)
        out[place] = packed
        ends = np.cumsum(room)
        return out, ends + np.concatenate(([0], np.cumsum(full)))[ends]

    def encode(self, payloads: list[bytes]) -> list[bytes]:
        shapes = []
        parts = []
        for p in payloads:
            n = len(p) // BLOCK
            wide = int(np.ceil(np.sqrt(n)))
            high = -(-n // wide)
            shapes.append((n, wide, high))
            parts += [p, bytes([SHIFT]) * (BLOCK * (wide * high - n))]  # filler blocks of zero coefficients
        data, ends = self._segments(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, BLOCK))
        out, at, begin = [], 0, 0
        for n, wide, high in shapes:
            count = wide * high
            stops = ends[at : at + count] - begin
            body = data[begin : begin + int(stops[-1])]
            marks = np.zeros(len(body) + 2 * (count - 1), np.uint8)
            shift = np.zeros(len(body), np.int64)
            shift[stops[:-1]] = 2
            marks[np.arange(len(body)) + np.cumsum(shift)] = body
            after = stops[:-1] + 2 * np.arange(count - 1)
            marks[after], marks[after + 1] = 0xFF, 0xD0 + np.arange(count - 1) % 8
            comment = b"blocks=%d" % n
            frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 8 * high, 8 * wide, 1) + bytes([1, 0x11, 0])
            out.append(b"\xff\xd8\xff\xfe" + struct.pack(">H", 2 + len(comment)) + comment + self.fixed + frame + self.coding + self.scan + marks.tobytes() + b"\xff\xd9")
            at, begin = at + count, begin + int(stops[-1])
        return out


# --- reader -------------------------------------------------------------------------


@dataclass
class Image:
    """What the markers say, and after decoding the coefficients of each component."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    components: list = field(default_factory=list)  # (id, horizontal, vertical, quantiser)
    quantisers: dict = field(default_factory=dict)
    huffman: dict = field(default_factory=dict)
    interval: int = 0
    selectors: list = field(default_factory=list)  # (component index, DC table, AC table)
    segments: list = field(default_factory=list)  # unstuffed bytes
    program: tuple = ()
    mcus: tuple = (0, 0)
    blocks: list = field(default_factory=list)  # by component: rows, columns, 64 in zigzag order


def parse(data: bytes) -> Image:
    """Read the markers of a baseline JPEG and cut its scan at the restart markers."""
    if data[:2] != b"\xff\xd8":
        raise MediaError("no start of image")
    image, at = Image(), 2
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise MediaError("a marker is missing")
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise MediaError("a segment is cut off")
        at += 2 + size
        if kind == 0xFE:
            image.comment = body
        elif kind == 0xDB:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                image.quantisers[n] = np.frombuffer(body[1 : 1 + 64 * (wide + 1)], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + 64 * (wide + 1) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                image.huffman[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif kind == 0xC0:
            bits, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not image.height or not image.width:
                raise MediaError("not 8-bit samples of a known size")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise MediaError("not baseline")
        elif kind == 0xDD:
            image.interval = struct.unpack(">H", body)[0]
        elif kind == 0xDA:
            index = {c[0]: i for i, c in enumerate(image.components)}
            image.selectors = [(index[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            break
    if len(image.selectors) != len(image.components):
        raise MediaError("more than one scan")
    raw = np.frombuffer(data, np.uint8, offset=at)
    marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0) & (raw[1:] != 0xFF))
    again = (raw[marks + 1] & 0xF8) == 0xD0
    stop = int(np.argmin(again)) if not again.all() else len(marks)
    edges = marks[: stop + 1] if stop < len(marks) else np.append(marks, len(raw))
    stuffed = np.concatenate(([False], (raw[:-1] == 0xFF) & (raw[1:] == 0)))
    begin = np.concatenate(([0], edges[:-1] + 2))
    kept = np.concatenate(([0], np.cumsum(~stuffed)))
    plain = raw[~stuffed]
    image.segments = [plain[kept[a] : kept[b]] for a, b in zip(begin.tolist(), edges.tolist())]
    one = len(image.components) == 1
    high = 1 if one else max(c[1] for c in image.components)
    tall = 1 if one else max(c[2] for c in image.components)
    image.mcus = (-(-image.height // (8 * tall)), -(-image.width // (8 * high)))
    image.program = tuple(
        (i, y, x, image.huffman[dc], image.huffman[0x10 | ac])
        for i, dc, ac in image.selectors
        for y in range(1 if one else image.components[i][2]) for x in range(1 if one else image.components[i][1])
    )
    return image


_TABLES: dict[tuple, np.ndarray] = {}


def _table(key: tuple) -> np.ndarray:
    if key not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[key] = _lookup(*map(list, key))
    return _TABLES[key]


def _decode_group(images: list[Image]) -> None:
    """Decode images of one program: every restart interval is a lane."""
    program = images[0].program
    steps = len(program)
    lanes, first, count, total = [], [], [], 0
    for image in images:
        mcus = image.mcus[0] * image.mcus[1]
        each = image.interval or mcus
        want = -(-mcus // each)
        if len(image.segments) < want:
            raise MediaError("a restart interval is missing")
        lanes += image.segments[:want]
        first += [total + each * i for i in range(want)]
        count += [min(each, mcus - each * i) for i in range(want)]
        total += mcus
    sizes = np.array([len(x) for x in lanes])
    stream = np.concatenate([*lanes, np.full(16, 0xFF, np.uint8)])
    end = np.cumsum(sizes)
    bit = (end - sizes) * 8
    limit = end * 8
    wide = np.zeros(len(stream) - 8, np.uint64)  # the eight bytes from each place on
    for k in range(8):
        wide = wide << np.uint64(8) | stream[k : k + len(wide)]
    first, count = np.array(first), np.array(count)
    order = np.argsort(-count, kind="stable")
    first, count, bit, limit = first[order], count[order], bit[order], limit[order]
    out = np.zeros((total * steps, 64), np.int16)
    components = max(p[0] for p in program) + 1
    before = np.zeros((components, len(first)), np.int64)

    def symbol(which: np.ndarray, table: np.ndarray):
        """The next code of lanes, and the value bits behind it."""
        at = bit[which]
        window = wide[at >> 3] << (at & 7).astype(np.uint64)
        found = table[(window >> np.uint64(48)).astype(np.int64)]
        length, sym = found >> 8, found & 255
        if not length.all():
            raise MediaError("no such code")
        size = sym & 15
        raw = ((window << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where((size > 0) & (raw < (1 << size >> 1)), raw - (1 << size) + 1, raw)
        bit[which] = at + length + size
        return sym, value

    for mcu in range(int(count.max())):
        n = int(np.searchsorted(-count, -mcu, "left"))
        active = np.arange(n)
        for s, (component, _, _, dc, ac) in enumerate(program):
            row = (first[:n] + mcu) * steps + s
            _, value = symbol(active, _table(dc))
            before[component, :n] += value
            out[row, 0] = before[component, :n]
            k, which, table = np.ones(n, np.int64), active, _table(ac)
            while len(which):
                sym, value = symbol(which, table)
                size, run = sym & 15, sym >> 4
                k = k + run
                put = size > 0
                if (k[put] > 63).any():
                    raise MediaError("a block is too long")
                out[row[which[put]], k[put]] = value[put]
                k = np.where(put | (run == 15), k + 1, 64)
                more = k < 64
                if not more.all():
                    which, k = which[more], k[more]
    if (bit > limit).any():
        raise MediaError("the scan is cut off")
    at = 0
    for image in images:
        rows, columns = image.mcus
        mine = out[at * steps : (at + rows * columns) * steps].reshape(rows, columns, steps, 64)
        at += rows * columns
        image.blocks = []
        for i in range(len(image.components)):
            own = [(s, p[1], p[2]) for s, p in enumerate(program) if p[0] == i]
            v, h = max(y for _, y, _ in own) + 1, max(x for _, _, x in own) + 1
            grid = np.zeros((rows * v, columns * h, 64), np.int16)
            for s, y, x in own:
                grid[y::v, x::h] = mine[:, :, s]
            image.blocks.append(grid)


def decode(data: list[bytes]) -> list[Image]:
    """Parse and Huffman-decode; images whose tables and layout agree go together."""
    images = [parse(d) for d in data]
    groups: dict[tuple, list[Image]] = {}
    for image in images:
        groups.setdefault(image.program, []).append(image)
    for group in groups.values():
        _decode_group(group)
    return images


def luminance(image: Image) -> np.ndarray:
    """The first component at an eighth of its size, from DC coefficients only."""
    step = image.quantisers[image.components[0][3]][0]
    grid = image.blocks[0][:, :, 0].astype(np.int64) * step
    tall = max(c[2] for c in image.components) if len(image.components) > 1 else image.components[0][2]
    high = max(c[1] for c in image.components) if len(image.components) > 1 else image.components[0][1]
    rows = -(-(image.height * image.components[0][2]) // (8 * tall))
    columns = -(-(image.width * image.components[0][1]) // (8 * high))
    return np.clip(128 + grid[:rows, :columns] / 8, 0, 255)


def thumbnail_hash(grey: np.ndarray, side: int = THUMB) -> str:
    """Mean luminance of a ``side`` x ``side`` raster against its mean, as hex digits."""
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)

    def cuts(n: int) -> tuple[np.ndarray, np.ndarray]:
        a = np.arange(side) * n // side
        return a, np.maximum(a + 1, (np.arange(side) + 1) * n // side)

    (r0, r1), (c0, c1) = cuts(grey.shape[0]), cuts(grey.shape[1])
    area = (r1 - r0)[:, None] * (c1 - c0)
    mean = (total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]) / area
    return np.packbits((mean > mean.mean() + 1e-9).ravel()).tobytes().hex()


def payload_of(image: Image) -> bytes:
    """The bytes that :class:`Writer` stored."""
    n = int(image.comment.removeprefix(b"blocks="))
    return (image.blocks[0].reshape(-1, 64)[:n] + SHIFT).astype(np.uint8).tobytes()


def with_media(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text's UTF-8 bytes, padded with 0 to a positive
    multiple of 64, as a JPEG. Null text is empty; a null doc_id stays null."""

    def make():
        writer = Writer()

        def batch_of(texts, batch):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            media = writer.encode([r + bytes(-len(r) % BLOCK or (BLOCK if not r else 0)) for r in raw])
            return {"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(r) for r in raw], pa.int64()), "media": pa.array(media, pa.binary())}

        return batch_of

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read stored JPEGs back: dimensions, thumbnail hash, digests of media and payload."""

    def make():
        def batch_of(stored, batch):
            images = decode(stored)
            payloads = [payload_of(i) for i in images]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            long = lambda x: pa.array(list(x), pa.int64())
            return {
                "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "payload_bytes": long(map(len, payloads)),
                "payload_sha256": [sha(p) for p in payloads], "tail_crc32": long(zlib.crc32(p[-64:]) for p in payloads),
                "media_bytes": long(map(len, stored)), "media_sha256": [sha(m) for m in stored],
                "feature": [f"{i.width}x{i.height}:{thumbnail_hash(luminance(i))}" for i in images],
            }

        return batch_of

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_texts(media, make, schema, column="media")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(with_media(table(spark, sf_dir, "documents")))
