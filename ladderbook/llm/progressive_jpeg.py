"""Progressive JPEG: coefficients to files and back, and files to RGB tensors, many images at a time.

The decoder takes each file's scans in turn. A scan sends a band of coefficients (spectral selection)
or one more bit of them (successive approximation); it is added to the coefficient arrays. Scans of
one kind are decoded together: every restart interval of every image is a lane, and numpy takes one
symbol of each lane at a step. Then the coefficients are scaled and inverse-transformed by one
matrix product, chroma is upsampled to full resolution, and colours are converted.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np

from .common import ragged

# fixed values: markers
SOI, EOI, SOF2, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE

#: place of the k-th coefficient in zigzag order, row by row
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else i % 8)))
_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _transform() -> np.ndarray:
    """64 coefficients in zigzag order times this are 64 samples, row by row."""
    u = np.arange(8)
    basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]
    return np.einsum("uy,vx->uvyx", basis, basis).reshape(64, 64)[ZIGZAG]


TRANSFORM = _transform()


def codes(counts: list[int], values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by symbol of a Huffman table."""
    code, at = 0, 0
    out, sizes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for length, n in enumerate(counts, 1):
        for value in values[at : at + n]:
            out[value], sizes[value] = code, length
            code += 1
        at += n
        code <<= 1
    return out, sizes


def _lookup(counts: list[int], values: list[int]) -> np.ndarray:
    """By the next 16 bits: length << 8 | symbol; length 0 where there is no code."""
    table = np.zeros(1 << 16, np.int32)
    code, sizes = codes(counts, values)
    for value in values:
        n = int(sizes[value])
        first = int(code[value]) << (16 - n)
        table[first : first + (1 << (16 - n))] = n << 8 | value
    return table


# ---------------------------------------------------------------- reading


@dataclass
class Scan:
    parts: list[int]
    low: int
    high: int
    before: int
    bit: int
    dc: tuple
    ac: tuple
    restart: int
    data: bytes


@dataclass
class Image:
    width: int = 0
    height: int = 0
    factors: list[tuple[int, int]] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)
    quant: list[int] = field(default_factory=list)
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""
    across: int = 0  # MCUs
    down: int = 0
    first: list[int] = field(default_factory=list)  # first block of each component in the batch


_READ: dict[bytes, dict] = {}


def parse(blob: bytes) -> Image:
    """A file's frame and scans; ValueError if it isn't a progressive JPEG of 8-bit samples."""
    if blob[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    image, huff, restart, at = Image(), {}, 0, 2
    try:
        while True:
            while blob[at] != 0xFF or blob[at + 1] in (0xFF, 0):
                at += 1
            marker = blob[at + 1]
            if marker == EOI:
                break
            size = blob[at + 2] << 8 | blob[at + 3]
            body = blob[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == DQT:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    image.tables[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.float32)
                    k += 129 if wide else 65
            elif marker == DHT:
                k = 0
                while k < len(body):
                    counts = body[k + 1 : k + 17]
                    n = sum(counts)
                    huff[body[k]] = (counts, body[k + 17 : k + 17 + n])
                    k += 17 + n
            elif marker == DRI:
                restart = body[0] << 8 | body[1]
            elif marker == COM:
                image.comment = body
            elif marker == SOF2:
                if body[0] != 8 or body[5] not in (1, 3):
                    raise ValueError("samples of 8 bits in one or three components are read")
                image.height, image.width = body[1] << 8 | body[2], body[3] << 8 | body[4]
                for c in range(body[5]):
                    k = 6 + 3 * c
                    image.ids.append(body[k])
                    image.factors.append((body[k + 1] >> 4, body[k + 1] & 15))
                    image.quant.append(body[k + 2])
                if len(image.factors) == 1:
                    image.factors = [(1, 1)]
            elif marker in (0xC0, 0xC1, *range(0xC5, 0xD0)) and marker not in (DHT, 0xC8, 0xCC):
                raise ValueError("not progressive")
            elif marker == SOS:
                n = body[0]
                parts = [image.ids.index(body[1 + 2 * k]) for k in range(n)]
                pick = [body[2 + 2 * k] for k in range(n)]
                low, high, approx = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
                end = _END.search(blob, at)
                stop = end.start() if end else len(blob)
                dc = tuple(huff.get(p >> 4, (b"", b"")) for p in pick) if low == 0 else ()
                ac = huff.get(0x10 | pick[0] & 15, (b"", b"")) if low else ()
                image.scans.append(Scan(parts, low, high, approx >> 4, approx & 15, dc, ac, restart, blob[at:stop]))
                at = stop
    except IndexError:
        pass  # cut off: what is there is shown
    if not image.factors or not image.width or not image.height:
        raise ValueError("no frame")
    h, v = max(f[0] for f in image.factors), max(f[1] for f in image.factors)
    image.across, image.down = -(-image.width // (8 * h)), -(-image.height // (8 * v))
    return image


_TABLES: dict[tuple, np.ndarray] = {}


def _table(spec: tuple) -> np.ndarray:
    key = (bytes(spec[0]), bytes(spec[1]))
    if key not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[key] = _lookup(list(key[0]), list(key[1]))
    return _TABLES[key]


class _Bits:
    """The scans' bytes without stuffing, as lanes: one a restart interval."""

    def __init__(self, scans: list[bytes]):
        lengths = np.array([len(s) for s in scans], np.int64)
        raw = np.frombuffer(b"".join(scans) + b"\0", np.uint8)
        mark = np.flatnonzero(raw[:-1] == 0xFF)
        follow = raw[mark + 1]
        keep = np.ones(len(raw), bool)
        keep[mark[follow == 0] + 1] = False
        reset = mark[(follow >= 0xD0) & (follow <= 0xD7)]
        keep[reset] = keep[reset + 1] = False
        place = np.cumsum(keep) - keep
        begin = np.cumsum(lengths) - lengths
        at = np.r_[begin, reset + 2]
        owner = np.r_[np.arange(len(scans)), np.searchsorted(begin, reset, "right") - 1]
        order = np.lexsort((at, owner))
        self.owner = owner[order]
        self.start = place[at[order]] * 8
        b = np.concatenate([raw[:-1][keep[:-1]], np.zeros(16, np.uint8)]).astype(np.uint64)
        w = b[:-4]
        for k in range(1, 5):
            w = (w << np.uint64(8)) | b[k : len(b) - 4 + k]
        self.window = w.astype(np.int64)
        self.end = (len(self.window) - 1) * 8
        self.nth = np.arange(len(self.owner)) - np.searchsorted(self.owner, self.owner)

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        return (self.window[at >> 3] >> (40 - (at & 7) - n)) & ((1 << n) - 1)


def _extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size) >> 1, bits - (1 << size) + 1, bits)


def _dc_scan(images: list[Image], scans: list[Scan], coef: np.ndarray) -> None:
    bits = _Bits([s.data for s in scans])
    s = scans[0]
    single = len(s.parts) == 1
    own = [images[k] for k in bits.owner.tolist()]
    spots = []  # (component, x, y) of an MCU's blocks
    for c in s.parts:
        h, v = (1, 1) if single else own[0].factors[c]
        spots += [(c, x, y) for y in range(v) for x in range(h)]
    across = np.array([_own_blocks(i, s.parts[0])[0] if single else i.across for i in images])[bits.owner]
    total = np.array([np.prod(_own_blocks(i, s.parts[0])) if single else i.across * i.down for i in images])[bits.owner]
    step = np.array([x.restart for x in scans])[bits.owner]
    begin = bits.nth * step
    count = np.where(step > 0, np.minimum(step, total - begin), total)
    first = {c: np.array([i.first[c] for i in images])[bits.owner] for c in s.parts}
    wide = {c: np.array([i.across * i.factors[c][0] for i in images])[bits.owner] for c in s.parts}
    at = bits.start.copy()
    last = {c: np.zeros(len(at), np.int64) for c in s.parts}
    tables = dict(zip(s.parts, map(_table, s.dc))) if s.before == 0 else {}
    live = np.flatnonzero(count > 0)
    for m in range(int(count.max(initial=0))):
        live = live[(count[live] > m) & (at[live] < bits.end)]
        if not len(live):
            break
        row, col = np.divmod(begin[live] + m, across[live])
        for c, x, y in spots:
            h, v = (1, 1) if single else own[0].factors[c]
            block = (first[c][live] + (row * v + y) * wide[c][live] + col * h + x) * 64
            here = at[live]
            if s.before:
                coef[block] |= bits.peek(here, 1) << s.bit
                at[live] = np.minimum(here + 1, bits.end)
                continue
            hit = tables[c][bits.peek(here, 16)].astype(np.int64)
            size, n = hit & 15, hit >> 8
            here = np.minimum(here + n, bits.end)
            last[c][live] += np.where(size > 0, _extended(bits.peek(here, size), size), 0)
            coef[block] = last[c][live] << s.bit
            at[live] = np.minimum(here + size, bits.end)


def _own_blocks(image: Image, c: int) -> tuple[int, int]:
    """Blocks across and down that a component has by itself."""
    hm, vm = max(f[0] for f in image.factors), max(f[1] for f in image.factors)
    h, v = image.factors[c]
    return -(-(-(-image.width * h // hm)) // 8), -(-(-(-image.height * v // vm)) // 8)


class _Lanes:
    """Where each lane of an AC scan stands: the block it is in and the next ones."""

    def __init__(self, images: list[Image], scans: list[Scan], bits: _Bits):
        c = scans[0].parts[0]
        dims = np.array([_own_blocks(i, c) for i in images]).reshape(-1, 2)[bits.owner]
        self.across = dims[:, 0]
        self.wide = np.array([i.across * i.factors[c][0] for i in images])[bits.owner]
        self.first = np.array([i.first[c] for i in images])[bits.owner]
        step = np.array([x.restart for x in scans])[bits.owner]
        total = dims.prod(1)
        self.n = bits.nth * step
        self.last = np.where(step > 0, np.minimum(self.n + step, total), total)

    def address(self, lanes: np.ndarray) -> np.ndarray:
        row, col = np.divmod(self.n[lanes], self.across[lanes])
        return (self.first[lanes] + row * self.wide[lanes] + col) * 64


def _ac_first(images: list[Image], scans: list[Scan], coef: np.ndarray) -> None:
    bits, s = _Bits([x.data for x in scans]), scans[0]
    table = _table(s.ac)
    lanes = _Lanes(images, scans, bits)
    lane = np.flatnonzero(lanes.n < lanes.last)
    at, base = bits.start[lane], lanes.address(lane)
    k = np.full(len(lane), s.low, np.int64)
    window, end = bits.window, bits.end
    while len(lane):
        w, skip = window[at >> 3], at & 7
        hit = table[(w >> (24 - skip)) & 0xFFFF]
        n, size, run = hit >> 8, hit & 15, (hit >> 4) & 15
        got = size > 0
        extra = np.where(got, size, np.where(run == 15, 0, run)).astype(np.int64)
        value = (w >> (40 - skip - n - extra)) & ((1 << extra) - 1)
        at = np.minimum(at + n + extra, end)
        k += run
        full = got.all()
        g = slice(None) if full else np.flatnonzero(got & (k <= s.high))
        v, e = value[g], extra[g]
        coef[base[g] + np.minimum(k[g], 63)] = np.where(v < (1 << e) >> 1, v - (1 << e) + 1, v) << s.bit if s.bit == 0 else np.sign(x := np.where(v < (1 << e) >> 1, v - (1 << e) + 1, v)) * (np.abs(x) << s.bit)
        k += 1
        skipped = np.zeros(len(k), np.int64)
        if not full:
            stop = np.flatnonzero(~got & (run < 15))
            k[stop] = 64
            skipped[stop] = (1 << extra[stop]) + value[stop] - 1
        over = np.flatnonzero((k > s.high) | (at >= end))
        if len(over):
            who = lane[over]
            lanes.n[who] += 1 + skipped[over]
            k[over] = s.low
            more = (lanes.n[who] < lanes.last[who]) & (at[over] < end)
            base[over[more]] = lanes.address(who[more])
            if not more.all():
                keep = np.ones(len(lane), bool)
                keep[over[~more]] = False
                lane, at, base, k = lane[keep], at[keep], base[keep], k[keep]


def _ac_refine(images: list[Image], scans: list[Scan], coef: np.ndarray) -> None:
    bits, s = _Bits([x.data for x in scans]), scans[0]
    table, one = _table(s.ac), 1 << s.bit
    lanes = _Lanes(images, scans, bits)
    lane = np.flatnonzero(lanes.n < lanes.last)
    at, base = bits.start[lane], lanes.address(lane)
    k = np.full(len(lane), s.low, np.int64)
    run, fresh, ends = (np.zeros(len(lane), np.int64) for _ in range(3))  # zeros to pass; value to place; blocks without symbols
    asks = np.ones(len(lane), bool)
    while len(lane):
        a = np.flatnonzero(asks)
        if len(a):
            here = at[a]
            hit = table[bits.peek(here, 16)].astype(np.int64)
            here = np.minimum(here + (hit >> 8), bits.end)
            size, r = hit & 15, (hit >> 4) & 15
            stop = (size == 0) & (r < 15)
            extra = np.where(size > 0, 1, np.where(stop, r, 0))
            value = bits.peek(here, extra)
            at[a] = np.minimum(here + extra, bits.end)
            run[a] = np.where(stop, 64, r)
            fresh[a] = np.where(size > 0, np.where(value == 1, one, -one), 0)
            ends[a] = np.where(stop, (1 << r) + value, 0)
            asks[a] = False
        spot = base + k
        old = coef[spot]
        known = old != 0
        q = np.flatnonzero(known)
        if len(q):
            add = bits.peek(at[q], 1)
            at[q] = np.minimum(at[q] + 1, bits.end)
            grow = q[(add == 1) & ((np.abs(old[q]) & one) == 0)]
            coef[spot[grow]] += np.sign(old[grow]) * one
        z = ~known
        put = np.flatnonzero(z & (run == 0))
        coef[spot[put]] += fresh[put]
        asks[put] = True
        run[z] -= 1
        k += 1
        over = np.flatnonzero((k > s.high) | (at >= bits.end))
        if len(over):
            who = lane[over]
            lanes.n[who] += 1
            k[over] = s.low
            ends[over] = np.maximum(ends[over] - 1, 0)
            asks[over] = ends[over] == 0
            run[over] = 64
            more = (lanes.n[who] < lanes.last[who]) & (at[over] < bits.end + (ends[over] > 0))
            base[over[more]] = lanes.address(who[more])
            if not more.all():
                keep = np.ones(len(lane), bool)
                keep[over[~more]] = False
                lane, at, base, k, run, fresh, ends, asks = (x[keep] for x in (lane, at, base, k, run, fresh, ends, asks))


def coefficients(images: list[Image]) -> np.ndarray:
    """The coefficients of all images, (blocks, 64) in zigzag order; sets where each component's blocks start."""
    n = 0
    for image in images:
        image.first = []
        for h, v in image.factors:
            image.first.append(n)
            n += image.across * h * image.down * v
    coef = np.zeros(n * 64, np.int64 if n < 1 << 16 else np.int32)
    for nth in range(max((len(i.scans) for i in images), default=0)):
        kinds: dict[tuple, list[Image]] = {}
        for image in images:
            if nth < len(image.scans):
                s = image.scans[nth]
                layout = tuple(image.factors[c] for c in s.parts) if s.low == 0 else ()
                key = (tuple(s.parts), s.low, s.high, s.before, s.bit, s.dc if s.before == 0 else (), s.ac, layout)
                kinds.setdefault(key, []).append(image)
        for (_, low, _, before, *_), some in kinds.items():
            step = _dc_scan if low == 0 else _ac_refine if before else _ac_first
            step(some, [i.scans[nth] for i in some], coef)
    return coef.reshape(-1, 64)


def tiles(images: list[Image], coef: np.ndarray):
    """Per group of images of one layout: (their numbers, MCUs of each, RGB of all their MCUs)."""
    groups: dict[tuple, list[int]] = {}
    for k, image in enumerate(images):
        groups.setdefault(tuple(image.factors), []).append(k)
    for factors, members in groups.items():
        count = np.array([images[k].across * images[k].down for k in members])
        across = np.repeat([images[k].across for k in members], count)
        mcu = np.arange(len(across)) - np.repeat(np.cumsum(count) - count, count)
        row, col = np.divmod(mcu, across)
        hm, vm = max(f[0] for f in factors), max(f[1] for f in factors)
        planes = []
        for c, (h, v) in enumerate(factors):
            first = np.repeat([images[k].first[c] for k in members], count)
            y, x = np.arange(v)[:, None], np.arange(h)[None, :]
            block = first[:, None, None] + (row[:, None, None] * v + y) * (across[:, None, None] * h) + col[:, None, None] * h + x
            flat = coef[block.reshape(-1)].astype(float)
            quant = np.stack([images[k].tables.get(images[k].quant[c], np.ones(64, np.float32)) for k in members])
            if (quant != 1).any():
                flat *= np.repeat(quant, count * h * v, axis=0)
            # the small bias keeps halves from falling either way with the order of a sum: equal files, equal samples
            samples = np.clip(np.rint(flat @ TRANSFORM + (128 + 1e-6)), 0, 255).astype(np.float32).reshape(-1, v, h, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, v * 8, h * 8)
            if v < vm:
                samples = np.repeat(samples, vm // v, axis=1)
            if h < hm:
                samples = np.repeat(samples, hm // h, axis=2)
            planes.append(samples)
        if len(planes) == 1:
            rgb = np.repeat(planes[0][..., None], 3, axis=3)
        else:
            luma, blue, red = planes[0], planes[1] - 128, planes[2] - 128
            rgb = np.empty((*luma.shape, 3), np.float32)
            # fixed values: the colour conversion of JFIF
            rgb[..., 0] = luma + 1.402 * red
            rgb[..., 1] = luma - 0.344136 * blue - 0.714136 * red
            rgb[..., 2] = luma + 1.772 * blue
        yield members, count, np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def tensors(images: list[Image], coef: np.ndarray) -> list[np.ndarray]:
    """Each image's (height, width, 3) samples."""
    out: list = [None] * len(images)
    for members, count, rgb in tiles(images, coef):
        at = 0
        for k, n in zip(members, count.tolist()):
            i = images[k]
            part = rgb[at : at + n].reshape(i.down, i.across, *rgb.shape[1:]).transpose(0, 2, 1, 3, 4)
            out[k] = np.ascontiguousarray(part.reshape(i.down * rgb.shape[1], i.across * rgb.shape[2], 3)[: i.height, : i.width])
            at += n
    return out


# ---------------------------------------------------------------- writing

RESTART = 8
ACROSS = 64  # MCUs
#: tables of our own: four bits for a size without zeros before it, nine for what is rare
_DC_VALUES = list(range(12))
_DC_COUNTS = [0, 0, 0, 12, *[0] * 12]
_AC_SHORT = [0, *range(1, 9)]
_AC_LONG = [r << 4 | s for r in range(1, 16) for s in range(1, 9)] + [0xF0, *(r << 4 for r in range(1, 15))]
_AC_COUNTS = [0, 0, 0, len(_AC_SHORT), 0, 0, 0, 0, len(_AC_LONG), *[0] * 7]
_DC_CODE, _DC_LEN = codes(_DC_COUNTS, _DC_VALUES)
_AC_CODE, _AC_LEN = codes(_AC_COUNTS, _AC_SHORT + _AC_LONG)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEAD = b"\xff\xd8" + _segment(DQT, bytes([0] + [1] * 64)) + _segment(DHT, bytes([0x00, *_DC_COUNTS, *_DC_VALUES])) + _segment(DHT, bytes([0x10, *_AC_COUNTS, *_AC_SHORT, *_AC_LONG])) + _segment(DRI, struct.pack(">H", RESTART))
#: (components, low, high, before, bit) of our scans
_SCANS = [((0, 1, 2), 0, 0, 0, 1), *(((c,), 1, 5, 0, 1) for c in range(3)), *(((c,), 6, 63, 0, 0) for c in range(3)), ((0, 1, 2), 0, 0, 1, 0), *(((c,), 1, 5, 1, 0) for c in range(3))]


def _bodies(value: np.ndarray, size: np.ndarray, lane: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all lanes after one another, restart markers between those of one image.

    value, size: bits of each symbol; lane: its lane, ascending; first: whether a lane starts an image.
    Returns the bytes and where each lane's start.
    """
    bits = np.bincount(lane, size, len(first)).astype(np.int64)
    room = (bits + 7) // 8
    begin = np.cumsum(room) - room
    where = np.cumsum(size) - size
    spot = where + (begin * 8 - (np.cumsum(bits) - bits))[lane]
    pad = room * 8 - bits
    value = np.r_[value, (1 << pad) - 1]
    spot = np.r_[spot, begin * 8 + bits]
    size = np.r_[size, pad]
    wide = value.astype(np.uint64) << (64 - (spot & 31) - size).clip(0, 63).astype(np.uint64)
    wide[size == 0] = 0
    word = spot >> 5
    n = int(room.sum()) // 4 + 3
    total = np.bincount(word, (wide >> np.uint64(32)).astype(float), n) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(float), n)
    raw = total.astype(np.uint64).astype(">u4").view(np.uint8)[: int(room.sum())]
    full = raw == 0xFF
    extra = np.r_[0, np.cumsum(full)]
    stuffed = room + extra[begin + room] - extra[begin]
    start = np.cumsum(stuffed + 2 * ~first) - stuffed
    out = np.zeros(int((stuffed + 2 * ~first).sum()), np.uint8)
    place = np.arange(len(raw)) + extra[:-1] + np.repeat(np.cumsum(2 * ~first), room)
    out[place] = raw
    nth = np.arange(len(first)) - np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    later = np.flatnonzero(~first)
    out[start[later] - 2] = 0xFF
    out[start[later] - 1] = 0xD0 + (nth[later] - 1) % 8
    return out, start - 2 * ~first


def _lanes(blocks: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray]:
    """(lane of every unit, whether each lane starts an image) where image k has blocks[k] units and a lane `per`."""
    lanes = -(-blocks // per)
    nth = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = np.zeros(int(lanes.sum()), bool)
    first[np.cumsum(lanes) - lanes] = True
    return nth // per + np.repeat(np.cumsum(lanes) - lanes, blocks), first


def _size_of(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def _bits_of(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def _write_ac_first(x: np.ndarray, lane: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, size, lane) of the symbols of blocks x, (blocks, band), already shifted."""
    n, band = x.shape
    block, k = np.nonzero(x)
    v = x[block, k].astype(np.int64)
    new = np.r_[True, block[1:] != block[:-1]] if len(block) else np.empty(0, bool)
    run = k - np.r_[0, k[:-1] + 1] if len(k) else k
    run = np.where(new, k, run)
    zrl = run >> 4
    size = _size_of(v)
    symbol = (run & 15) << 4 | size
    final = np.full(n, -1)
    final[block] = k  # the last of a block stays
    eob = final < band - 1
    per = np.bincount(block, 1 + zrl, n).astype(np.int64) + eob
    ends = np.cumsum(per)
    value, bits = np.full(int(per.sum()), _AC_CODE[0xF0]), np.full(int(per.sum()), _AC_LEN[0xF0])
    own = np.cumsum(1 + zrl) - 1 + (np.cumsum(eob) - eob)[block]
    value[own] = _AC_CODE[symbol] << size | _bits_of(v, size)
    bits[own] = _AC_LEN[symbol] + size
    value[ends[eob] - 1], bits[ends[eob] - 1] = _AC_CODE[0], _AC_LEN[0]
    return value, bits, np.repeat(lane, per)


def _write_ac_refine(x: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, band = x.shape
    value, bits = np.zeros((n, band + 1), np.int64), np.zeros((n, band + 1), np.int64)
    run, pend, held = (np.zeros(n, np.int64) for _ in range(3))
    for k in range(band):
        v = x[:, k].astype(np.int64)
        m = np.abs(v)
        old = m > 1
        pend = np.where(old, pend << 1 | m & 1, pend)
        held += old
        new = m == 1
        symbol = run << 4 | 1
        value[:, k] = np.where(new, ((_AC_CODE[symbol] << 1 | (v > 0)) << held) | pend, 0)
        bits[:, k] = np.where(new, _AC_LEN[symbol] + 1 + held, 0)
        run = np.where(new, 0, run + (m == 0))
        pend, held = np.where(new, 0, pend), np.where(new, 0, held)
    rest = (run > 0) | (held > 0)
    value[:, band] = np.where(rest, _AC_CODE[0] << held | pend, 0)
    bits[:, band] = np.where(rest, _AC_LEN[0] + held, 0)
    some = bits.ravel() > 0
    return value.ravel()[some], bits.ravel()[some], np.repeat(lane, (bits > 0).sum(1))


def store(payload: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One file a payload: its bytes, less 128, are the coefficients of the blocks of luma, then blue, then red chroma.

    Luma has twice the chroma's samples across. A comment holds the payload's length.
    """
    lengths = np.diff(offsets)
    blocks = -(-lengths // 64)
    mcus = np.maximum(1, -(-blocks // 4))
    across = np.maximum(np.minimum(mcus, ACROSS), -(-mcus // 8000))
    down = -(-mcus // across)
    mcus = across * down
    first = np.cumsum(mcus * 4) - mcus * 4
    coef = np.zeros(int(mcus.sum()) * 256, np.int16)
    coef[np.repeat(first * 64 - offsets[:-1], lengths) + np.arange(len(payload))] = payload.astype(np.int16) - 128
    coef = coef.reshape(-1, 64)
    luma, lane2, first2 = ragged(first, 2 * mcus), *_lanes(2 * mcus, RESTART)
    lane1, first1 = _lanes(mcus, RESTART)
    where = [(luma, lane2, first2), (ragged(first + 2 * mcus, mcus), lane1, first1), (ragged(first + 3 * mcus, mcus), lane1, first1)]
    # MCUs in order: the luma blocks of a row lie side by side, so an MCU's are neighbours
    mcu = np.arange(int(mcus.sum())) - np.repeat(np.cumsum(mcus) - mcus, mcus)
    start = np.repeat(first, mcus)
    each = np.repeat(mcus, mcus)
    order = np.stack([start + 2 * mcu, start + 2 * mcu + 1, start + 2 * each + mcu, start + 3 * each + mcu], 1)
    dc_lane = np.repeat(lane1, 4)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for comps, low, high, before, bit in _SCANS:
        if low == 0:
            dc = coef[order.ravel(), 0].astype(np.int64).reshape(-1, 4)
            if before:
                body, at = _bodies((dc & 1).ravel(), np.ones(dc.size, np.int64), dc_lane, first1)
            else:
                dc >>= bit
                back = np.zeros_like(dc)
                back[:, 1] = dc[:, 0]
                same = np.r_[False, lane1[1:] == lane1[:-1]]
                for c, prior in ((0, 1), (2, 2), (3, 3)):
                    back[1:, c] = np.where(same[1:], dc[:-1, prior], 0)
                diff = (dc - back).ravel()
                size = _size_of(diff)
                body, at = _bodies(_DC_CODE[size] << size | _bits_of(diff, size), _DC_LEN[size] + size, dc_lane, first1)
            starts = first1
        else:
            own, lane, starts = where[comps[0]]
            x = coef[own, low : high + 1]
            if before:
                body, at = _bodies(*_write_ac_refine(x, lane), starts)
            else:
                x = np.where(x < 0, -(-x >> bit), x >> bit) if bit else x
                body, at = _bodies(*_write_ac_first(x, lane, high), starts)
        cut = np.r_[at[starts], len(body)]
        head = _segment(SOS, bytes([len(comps), *(b for c in comps for b in (c + 1, 0)), low, high, before << 4 | bit]))
        parts.append((head, body.tobytes(), cut.tolist()))
    out = []
    for k, (n, w, h) in enumerate(zip(lengths.tolist(), (across * 16).tolist(), (down * 8).tolist())):
        frame = _segment(SOF2, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0]))
        file = [_HEAD, _segment(COM, b"%d" % n), frame]
        for head, body, cut in parts:
            file += (head, body[cut[k] : cut[k + 1]])
        out.append(b"".join((*file, b"\xff\xd9")))
    return out


def load(images: list[Image], coef: np.ndarray) -> list[np.ndarray]:
    """The payloads that store() wrote."""
    raw = (coef + 128).astype(np.uint8).reshape(-1)
    out = []
    for image in images:
        n = int(image.comment)
        out.append(raw[image.first[0] * 64 : image.first[0] * 64 + n])
    return out
