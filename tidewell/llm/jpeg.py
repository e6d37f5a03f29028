"""Progressive JPEG, written and read in batches with numpy.

A file holds 8x8 blocks of quantised coefficients of Y, Cb and Cr (4:2:0) in five kinds of scans:
DC and AC bands first (all bits but the last), then a refinement of each. Restart markers make the
segments of a scan independent, so the decoder advances all segments of all images of a batch one
symbol at a time. Files without restart markers decode the same way, one lane for each scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: The order in which the coefficients of a block are stored.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
BITS = np.array([int(i).bit_length() for i in range(1 << 12)], np.int64)
SAMPLING = ((2, 2), (1, 1), (1, 1))
SCANS = (((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0), ((0, 1, 2), 0, 0, 1, 0))


def _basis() -> np.ndarray:
    """64 x 64: a block of stored coefficients times this gives its 64 samples."""
    u = np.arange(8)
    one = np.cos((2 * u[:, None] + 1) * u[None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("xu,yv->uvxy", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = _basis()


def canonical(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol of a Huffman table given by counts per length."""
    code, length, value, at = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            code[s], length[s] = value, bits
            value += 1
        value <<= 1
        at += n
    return code, length


def _table(symbols: list[int], short: int) -> tuple[list[int], list[int]]:
    """A complete-enough table: the first ``short`` symbols get four bits, the rest nine."""
    counts = [0] * 16
    counts[3], counts[8] = short, len(symbols) - short
    return counts, symbols


DC_TABLE = _table(list(range(12)), 10)
AC_TABLE = _table([0x06, 0x05, 0x00, 0x07, 0x01, 0x02, 0x03, 0x04, 0xF0, 0x11, *[r << 4 | s for r in range(16) for s in range(1, 11) if not (r == 0 and s < 8) and not (r == 1 and s == 1)], *[r << 4 for r in range(1, 15)]], 10)


def geometry(blocks: int) -> tuple[int, int]:
    """Columns and rows of 16x16 units of six blocks that hold at least ``blocks`` blocks, about square."""
    wide = max(1, int(np.sqrt(blocks / 6)))
    return wide, max(1, -(-blocks // (6 * wide)))


# Writing


def _pack(code: np.ndarray, length: np.ndarray, segment: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments end to end, each filled up with ones, and bytes per segment."""
    bits = np.bincount(segment, weights=length, minlength=segments).astype(np.int64)
    size = -(-bits // 8)
    first = np.cumsum(size) - size
    begin = np.cumsum(length) - length
    at = begin - (np.cumsum(bits) - bits)[segment] + first[segment] * 8
    total = int(size.sum())
    wide = code.astype(np.uint64) << (np.uint64(40) - (length + (at & 7)).astype(np.uint64))
    out = np.zeros(total + 5, np.float64)
    for j in range(5):
        part = (wide >> np.uint64(32 - 8 * j)) & np.uint64(255)
        some = np.flatnonzero(part)
        out += np.bincount((at[some] >> 3) + j, weights=part[some], minlength=total + 5)
    raw = out[:total].astype(np.uint8)
    spare = size * 8 - bits
    has = np.flatnonzero(size > 0)
    raw[(first + size - 1)[has]] |= ((1 << spare[has]) - 1).astype(np.uint8)
    return raw, size


def _mark(raw: np.ndarray, size: np.ndarray, images: np.ndarray) -> list[bytes]:
    """Stuffed bytes with restart markers, cut by image; ``images``: segments of each image."""
    owner = np.repeat(np.arange(len(size)), size)
    full = np.flatnonzero(raw == 255)
    raw = np.insert(raw, full + 1, 0)
    size = size + np.bincount(owner[full], minlength=len(size))
    last = np.cumsum(images) - 1
    begin = np.repeat(last - images + 1, images)
    inner = np.setdiff1d(np.arange(len(size)), last)
    ends = np.cumsum(size)
    marks = np.empty(2 * len(inner), np.uint8)
    marks[0::2], marks[1::2] = 255, 0xD0 + (inner - begin[inner]) % 8
    raw = np.insert(raw, np.repeat(ends[inner], 2), marks)
    size[inner] += 2
    cut = np.append(0, np.cumsum(np.add.reduceat(size, begin[last])))
    return [raw[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]


def _signed(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(value < 0, value + (1 << size) - 1, value)


def _dc_first(values: np.ndarray, per: int, kinds: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, lengths, segments; ``values``: DC of the blocks in scan order, ``per`` blocks a segment."""
    v = (values >> low).reshape(-1, per)
    diff = v.copy()
    for c in np.unique(kinds):
        mine = np.flatnonzero(kinds == c)
        diff[:, mine[1:]] -= v[:, mine[:-1]]
    diff = diff.ravel()
    size = BITS[np.abs(diff)]
    code, length = canonical(*DC_TABLE)
    return code[size] << size | _signed(diff, size), length[size] + size, np.repeat(np.arange(len(v)), per)


def _ac_first(blocks: np.ndarray, ss: int, se: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    band = blocks[:, ss : se + 1].astype(np.int64)
    band = np.sign(band) * (np.abs(band) >> low)
    row, col = np.nonzero(band)
    code, length = canonical(*AC_TABLE)
    head = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    run = col - np.where(head, -1, np.append(0, col[:-1])) - 1
    value = band[row, col]
    size = BITS[np.abs(value)]
    symbol = (run % 16) << 4 | size
    codes, lengths = code[symbol] << size | _signed(value, size), length[symbol] + size
    long = np.flatnonzero(run >= 16)
    where = np.repeat(long, run[long] // 16)
    end = np.full(len(band), -1)
    end[row] = col
    short = np.flatnonzero(end < se - ss)
    behind = np.searchsorted(row, short, side="right")
    place = np.concatenate([behind, where])  # at one place, the end of a block stands before a run of the next
    fill = np.concatenate([np.zeros(len(short), np.int64), np.full(len(where), 0xF0)])
    return np.insert(codes, place, code[fill]), np.insert(lengths, place, length[fill]), np.insert(row, place, np.concatenate([short, row[where]]))


def _ac_refine(blocks: np.ndarray, ss: int, se: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    band = np.abs(blocks[:, ss : se + 1].astype(np.int64)) >> low
    sign = blocks[:, ss : se + 1] < 0
    code, length = canonical(*AC_TABLE)
    old, bit = band > 1, band & 1
    full, fresh = old.all(axis=1), (band == 1).any(axis=1)
    out = []
    f = np.flatnonzero(full)
    width = band.shape[1]
    out.append((np.full(len(f), code[0]), np.full(len(f), length[0]), f, np.zeros(len(f))))
    for j, a in enumerate(range(0, width, 21)):
        part = bit[f, a : a + 21]
        out.append((part @ (1 << np.arange(part.shape[1])[::-1]), np.full(len(f), part.shape[1]), f, np.full(len(f), 1 + j)))
    s = np.flatnonzero(~full & ~fresh)
    out.append((np.full(len(s), code[0]), np.full(len(s), length[0]), s, np.zeros(len(s))))
    r, c = np.nonzero(old[s])
    out.append((bit[s[r], c], np.ones(len(r), np.int64), s[r], 1.0 + c))
    for b in np.flatnonzero(fresh & ~full).tolist():
        rows, pend, run, at = [], [], 0, 0
        last = int(np.flatnonzero(band[b] == 1)[-1])
        for k in range(width):
            if old[b, k]:
                pend.append((int(bit[b, k]), 1))
            elif band[b, k]:
                rows += [(int(code[run << 4 | 1]), int(length[run << 4 | 1])), (0 if sign[b, k] else 1, 1), *pend]
                pend, run = [], 0
            elif k < last:
                if run == 15:
                    rows += [(int(code[0xF0]), int(length[0xF0])), *pend]
                    pend, run = [], 0
                else:
                    run += 1
        if last < width - 1:
            rows += [(int(code[0]), int(length[0])), *pend]
        at = np.arange(len(rows), dtype=float)
        out.append((np.array([x for x, _ in rows]), np.array([x for _, x in rows]), np.full(len(rows), b), at))
    codes, lengths, row, order = (np.concatenate([np.asarray(o[i]) for o in out]) for i in range(4))
    by = np.lexsort((order, row))
    return codes[by].astype(np.int64), lengths[by].astype(np.int64), row[by].astype(np.int64)


@lru_cache(maxsize=4096)
def interleaved(wide: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Component and block number of the blocks of a scan over all three components, unit by unit."""
    y, x = np.divmod(np.arange(wide * high), wide)
    luma = np.stack([(2 * y + j) * 2 * wide + 2 * x + i for j in (0, 1) for i in (0, 1)], axis=1)
    both = np.concatenate([luma, np.repeat(np.arange(wide * high)[:, None], 2, axis=1)], axis=1)
    return np.tile([0, 0, 0, 0, 1, 2], wide * high), both.ravel()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def write(planes: list[tuple[tuple[int, int], list[np.ndarray]]]) -> list[bytes]:
    """Files of images given as ((units across, units down), [coefficients of Y, Cb, Cr]), zigzag order."""
    if not planes:
        return []
    sizes = [g for g, _ in planes]
    parts = [np.concatenate([p[c] for _, p in planes]) for c in range(3)]
    counts = [np.array([len(p[c]) for _, p in planes]) for c in range(3)]
    base = [np.cumsum(n) - n for n in counts]
    orders = [interleaved(*g) for g in sizes]
    flat = np.concatenate([np.concatenate([parts[c][:, 0]]) for c in range(3)]).astype(np.int64)
    shift = np.cumsum([0, len(parts[0]), len(parts[1])])
    units = np.array([w * h for w, h in sizes])
    dc = np.concatenate([shift[k] + np.array([b[i] for b in base])[k] + n for i, (k, n) in enumerate(orders)])
    bodies = []
    for comps, ss, se, high, low in SCANS:
        if ss == 0 and not high:
            coded, images = _dc_first(flat[dc], 6, np.array([0, 0, 0, 0, 1, 2]), low), units
        elif ss == 0:
            coded, images = ((flat[dc] >> low) & 1, np.ones(len(dc), np.int64), np.repeat(np.arange(len(dc) // 6), 6)), units
        else:
            coded, images = (_ac_refine if high else _ac_first)(parts[comps[0]], ss, se, low), counts[comps[0]]
        bodies.append(_mark(*_pack(*coded, int(images.sum())), images))
    head = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1] * 64))
    tables = b"".join(_segment(0xC4, bytes([kind << 4, *t[0], *t[1]])) for kind, t in ((0, DC_TABLE), (1, AC_TABLE))) + _segment(0xDD, (1).to_bytes(2, "big"))
    out = []
    for i, (w, h) in enumerate(sizes):
        frame = bytes([8]) + (16 * h).to_bytes(2, "big") + (16 * w).to_bytes(2, "big") + bytes([3]) + b"".join(bytes([c + 1, s[0] << 4 | s[1], 0]) for c, s in enumerate(SAMPLING))
        scans = b"".join(_segment(0xDA, bytes([len(c), *[x for k in c for x in (k + 1, 0)], ss, se, high << 4 | low])) + b[i] for (c, ss, se, high, low), b in zip(SCANS, bodies))
        out.append(head + _segment(0xC2, frame) + tables + scans + b"\xff\xd9")
    return out


# Reading


@dataclass
class Image:
    """What a file's headers say, and its coefficients per component in zigzag order."""

    width: int = 0
    height: int = 0
    sampling: list[tuple[int, int]] = field(default_factory=list)
    quant: list[np.ndarray] = field(default_factory=list)
    grid: list[tuple[int, int]] = field(default_factory=list)
    base: list[int] = field(default_factory=list)


@dataclass
class Scan:
    image: int
    comps: list[tuple[int, int, int]]
    band: tuple[int, int, int, int]
    restart: int
    body: tuple[int, int]


class Lanes:
    """The segments of scans as lanes: a bit position and a list of blocks each."""

    def __init__(self, raw: np.ndarray, scans: list[Scan], orders: list[np.ndarray], per: list[int]) -> None:
        body = np.concatenate([raw[s.body[0] : s.body[1]] for s in scans])
        size = np.array([s.body[1] - s.body[0] for s in scans])
        full = np.flatnonzero(body == 255)
        after = body[np.minimum(full + 1, len(body) - 1)]
        stuffed, marks = full[after == 0], full[(after & 0xF8) == 0xD0]
        drop = np.sort(np.concatenate([stuffed + 1, marks, marks + 1]))
        starts = np.sort(np.concatenate([np.cumsum(size) - size, marks + 2]))
        begin = starts - np.searchsorted(drop, starts)
        joined = np.concatenate([np.delete(body, drop), np.full(8, 255, np.uint8)]).astype(np.uint64)
        many = np.array([len(o) for o in orders])
        step = np.array([s.restart * u if s.restart else n for s, u, n in zip(scans, per, many)])
        lanes = -(-many // step)
        owner = np.repeat(np.arange(len(scans)), lanes)
        inner = (np.arange(len(owner)) - (np.cumsum(lanes) - lanes)[owner]) * step[owner]
        n = len(joined) - 4
        self.bytes40 = joined[:n] << np.uint64(32) | joined[1 : n + 1] << np.uint64(24) | joined[2 : n + 2] << np.uint64(16) | joined[3 : n + 3] << np.uint64(8) | joined[4 : n + 4]
        self.blocks, self.first, self.count = np.concatenate(orders), inner + (np.cumsum(many) - many)[owner], np.minimum(step[owner], many[owner] - inner)
        self.pos = begin * 8

    def window(self, lanes: np.ndarray) -> np.ndarray:
        """The next 32 bits of each lane."""
        p = self.pos[lanes]
        return ((self.bytes40[p >> 3] >> (8 - (p & 7)).astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def ragged(self, lanes: np.ndarray, many: np.ndarray) -> np.ndarray:
        """The next ``many`` single bits of each lane, end to end."""
        begin = self.pos[lanes]
        at = np.arange(many.sum()) + np.repeat(begin - (np.cumsum(many) - many), many)
        self.pos[lanes] += many
        return ((self.bytes40[at >> 3] >> (39 - (at & 7)).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


def _look(tables: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each table and each 16 bits: the symbol they begin with, and the length of its code."""
    symbol, bits = np.zeros((len(tables), 65536), np.int64), np.ones((len(tables), 65536), np.int64)
    for i, (counts, symbols) in enumerate(tables):
        code, length = canonical(list(counts), list(symbols))
        for s in set(symbols):
            a = int(code[s]) << (16 - int(length[s]))
            symbol[i, a : a + (1 << (16 - int(length[s])))] = s
            bits[i, a : a + (1 << (16 - int(length[s])))] = length[s]
    return symbol, bits


def _extend(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)


def _symbols(lanes: Lanes, on: np.ndarray, look: tuple[np.ndarray, np.ndarray], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next symbol of each lane, and the bits behind it (32 less its code)."""
    w = lanes.window(on)
    symbol, bits = look[0][table, w >> 16], look[1][table, w >> 16]
    lanes.pos[on] += bits
    return symbol, (w << bits) & 0xFFFFFFFF


def _read_dc(lanes: Lanes, out: np.ndarray, kinds: np.ndarray, tables: np.ndarray, look: tuple[np.ndarray, np.ndarray], low: int) -> None:
    last = np.zeros((len(lanes.first), 4), np.int64)
    for i in range(int(lanes.count.max(initial=0))):
        on = np.flatnonzero(lanes.count > i)
        at = lanes.first[on] + i
        size, rest = _symbols(lanes, on, look, tables[at])
        lanes.pos[on] += size
        last[on, kinds[at]] += _extend(rest >> (32 - size), size)
        out[lanes.blocks[at], 0] = last[on, kinds[at]] << low


def _read_ac(lanes: Lanes, out: np.ndarray, tables: np.ndarray, look: tuple[np.ndarray, np.ndarray], ss: int, se: int, low: int) -> None:
    n = len(lanes.first)
    k, done, skip = np.full(n, ss), np.zeros(n, np.int64), np.zeros(n, np.int64)
    on = np.flatnonzero(lanes.count > 0)
    while len(on):
        jump = np.minimum(skip[on], lanes.count[on] - done[on])
        if jump.any():  # whole blocks inside a run of ends
            done[on] += jump
            skip[on] -= jump
            on = on[done[on] < lanes.count[on]]
            continue
        at = lanes.first[on] + done[on]
        symbol, rest = _symbols(lanes, on, look, tables[at])
        run, size = symbol >> 4, symbol & 15
        end = (size == 0) & (run < 15)
        extra = np.where(end, run, size)
        lanes.pos[on] += extra
        value = rest >> (32 - extra)
        k[on] += np.where(end, 0, run)
        put = np.flatnonzero(size)
        where = on[put]
        out[lanes.blocks[at[put]], k[where]] = _extend(value[put], size[put]) << low
        k[on] += ~end
        ends = on[end]
        skip[ends] = (1 << run[end]) + value[end] - 1
        over = end | (k[on] > se)
        fin = on[over]
        done[fin] += 1
        k[fin] = ss
        on = on[done[on] < lanes.count[on]]


def _read_refine(lanes: Lanes, out: np.ndarray, tables: np.ndarray, look: tuple[np.ndarray, np.ndarray], ss: int, se: int, low: int) -> None:
    n = len(lanes.first)
    k, done, skip = np.full(n, ss), np.zeros(n, np.int64), np.zeros(n, np.int64)
    on = np.flatnonzero(lanes.count > 0)
    column = np.arange(64)

    def correct(lane: np.ndarray, block: np.ndarray, low_k: np.ndarray, high_k: np.ndarray) -> None:
        mask = (out[block] != 0) & (column >= low_k[:, None]) & (column <= high_k[:, None])
        bits = lanes.ragged(lane, mask.sum(axis=1))
        r, c = np.nonzero(mask)
        value = out[block[r], c]
        out[block[r], c] = value + np.where(bits == 1, np.sign(value) << low, 0)

    while len(on):
        ended = skip[on] > 0
        if ended.any():
            lane = on[ended]
            block = lanes.blocks[lanes.first[lane] + done[lane]]
            correct(lane, block, k[lane], np.full(len(lane), se))
            skip[lane] -= 1
            done[lane] += 1
            k[lane] = ss
            on = on[done[on] < lanes.count[on]]
            continue
        at = lanes.first[on] + done[on]
        symbol, rest = _symbols(lanes, on, look, tables[at])
        run, size = symbol >> 4, symbol & 15
        end = (size == 0) & (run < 15)
        extra = np.where(end, run, size)
        lanes.pos[on] += extra
        value = rest >> (32 - extra)
        skip[on[end]] = (1 << run[end]) + value[end]
        more = np.flatnonzero(~end)
        if len(more):
            lane, block = on[more], lanes.blocks[at[more]]
            zero = (out[block] == 0) & (column >= k[lane][:, None]) & (column <= se)
            nth = np.cumsum(zero, axis=1) == (run[more] + 1)[:, None]
            target = np.where((zero & nth).any(axis=1), (zero & nth).argmax(axis=1), se)
            correct(lane, block, k[lane], target)
            new = np.flatnonzero(size[more])
            out[block[new], target[new]] = np.where(value[more[new]] == 1, 1, -1) << low
            k[lane] = target + 1
            fin = lane[k[lane] > se]
            done[fin] += 1
            k[fin] = ss
            on = on[done[on] < lanes.count[on]]


def read(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Headers of progressive files, and all coefficients; a component's begin at ``image.base``."""
    images, scans, tables, names, total = [], [], [], {}, 0
    raw = np.frombuffer(b"".join(files), np.uint8)
    marks = np.flatnonzero((raw[:-1] == 255) & (raw[1:] != 0) & ((raw[1:] & 0xF8) != 0xD0))
    start = 0
    for f in files:
        img, quants, huff, restart, ids, at = Image(), {}, {}, 0, [], 2
        while at < len(f):
            marker = f[at + 1]
            if marker == 0xD9:
                break
            size = int.from_bytes(f[at + 2 : at + 4], "big")
            body = f[at + 4 : at + 2 + size]
            if marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    quants[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.float32)
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    table = (body[1:17], body[17 : 17 + n])
                    if table not in names:
                        names[table] = len(tables)
                        tables.append(table)
                    huff[body[0]] = names[table]
                    body = body[17 + n :]
            elif marker == 0xDD:
                restart = int.from_bytes(body[:2], "big")
            elif marker == 0xC2:
                img.height, img.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])]
                ids = [p[0] for p in parts]
                img.sampling = [(p[1] >> 4, p[1] & 15) for p in parts]
                img.quant = [p[2] for p in parts]
                hm, vm = max(s[0] for s in img.sampling), max(s[1] for s in img.sampling)
                across, down = -(-img.width // (8 * hm)), -(-img.height // (8 * vm))
                for h, v in img.sampling:
                    img.grid.append((across * h, down * v))
                    img.base.append(total)
                    total += across * h * down * v
            elif marker == 0xDA:
                comps = [(ids.index(body[1 + 2 * i]), huff.get(body[2 + 2 * i] >> 4, 0), huff.get(0x10 | body[2 + 2 * i] & 15, 0)) for i in range(body[0])]
                ss, se, bits = body[1 + 2 * body[0] : 4 + 2 * body[0]]
                end = int(marks[np.searchsorted(marks, start + at + 2 + size)])
                scans.append(Scan(len(images), comps, (ss, se, bits >> 4, bits & 15), restart, (start + at + 2 + size, end)))
                at = end - start
                continue
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("not a progressive file")
            at += 2 + size
        img.quant = [quants[q] for q in img.quant]
        images.append(img)
        start += len(f)
    out, look = np.zeros((total, 64), np.int64), _look(tables)
    turn: dict[int, int] = {}
    rounds: dict[tuple, list[Scan]] = {}
    for s in scans:  # scans of one image keep their order; equal ones of many images run together
        turn[s.image] = turn.get(s.image, 0) + 1
        rounds.setdefault((turn[s.image], *s.band), []).append(s)
    for (_, ss, se, high, low), some in sorted(rounds.items(), key=lambda x: x[0][0]):
        orders, kinds, dc, ac, per = [], [], [], [], []
        for s in some:
            order, kind, unit = _order(images[s.image], [c for c, _, _ in s.comps])
            orders.append(order)
            kinds.append(kind)
            per.append(unit)
            pick = np.zeros((4, 2), np.int64)
            for c, d, a in s.comps:
                pick[c] = d, a
            dc.append(pick[kind, 0])
            ac.append(pick[kind, 1])
        lanes = Lanes(raw, some, orders, per)
        if ss == 0 and high:
            bits = lanes.ragged(np.arange(len(lanes.first)), lanes.count)
            out[lanes.blocks, 0] |= bits << low
        elif ss == 0:
            _read_dc(lanes, out, np.concatenate(kinds), np.concatenate(dc), look, low)
        else:
            (_read_refine if high else _read_ac)(lanes, out, np.concatenate(ac), look, ss, se, low)
    return images, out


def _order(img: Image, comps: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks of a scan in order, their component, and blocks per unit."""
    place, kind, unit = _layout(img.width, img.height, tuple(img.sampling), tuple(img.grid), tuple(comps))
    return place + np.array(img.base)[kind], kind, unit


@lru_cache(maxsize=4096)
def _layout(width: int, height: int, sampling: tuple, grid: tuple, comps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    if len(comps) == 1:
        c = comps[0]
        h, v = sampling[c]
        hm, vm = max(s[0] for s in sampling), max(s[1] for s in sampling)
        wide, high = -(-width * h // (8 * hm)), -(-height * v // (8 * vm))
        y, x = np.divmod(np.arange(wide * high), wide)
        return y * grid[c][0] + x, np.full(wide * high, c), 1
    across, down = grid[comps[0]][0] // sampling[comps[0]][0], grid[comps[0]][1] // sampling[comps[0]][1]
    y, x = np.divmod(np.arange(across * down), across)
    cols, kind = [], []
    for c in comps:
        h, v = sampling[c]
        for j in range(v):
            for i in range(h):
                cols.append((v * y + j) * grid[c][0] + h * x + i)
                kind.append(c)
    return np.stack(cols, axis=1).ravel(), np.tile(kind, across * down), len(cols)


def doubled(plane: np.ndarray, axis: int) -> np.ndarray:
    """Twice the samples along an axis: each new one takes three quarters of the nearest and one of the next nearest."""
    plane = np.moveaxis(plane, axis, 0)
    near = 0.75 * plane
    out = np.empty((2 * len(plane), *plane.shape[1:]), plane.dtype)
    out[0::2], out[1::2] = near, near
    out[2::2] += 0.25 * plane[:-1]
    out[1:-1:2] += 0.25 * plane[1:]
    out[0] += 0.25 * plane[0]
    out[-1] += 0.25 * plane[-1]
    return np.moveaxis(out, 0, axis)


def upsampled(plane: np.ndarray, times: tuple[int, int]) -> np.ndarray:
    """A component at full resolution: between samples by :func:`doubled` where halved, else by repetition."""
    for axis, n in enumerate(times):
        plane = doubled(plane, axis) if n == 2 else plane.repeat(n, axis=axis) if n > 1 else plane
    return plane


def pixels(img: Image, samples: np.ndarray) -> np.ndarray:
    """The full-resolution RGB tensor of an image; ``samples``: the inverse transform of all blocks."""
    planes = []
    hm, vm = max(s[0] for s in img.sampling), max(s[1] for s in img.sampling)
    for base, (w, h), (sh, sv) in zip(img.base, img.grid, img.sampling):
        plane = samples[base : base + w * h].reshape(h, w, 8, 8).transpose(0, 2, 1, 3).reshape(8 * h, 8 * w)
        planes.append(upsampled(plane, (vm // sv, hm // sh))[: img.height, : img.width])
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, axis=2).round().clip(0, 255).astype(np.uint8)
    y, b, r = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=-1)
    return rgb.round().clip(0, 255).astype(np.uint8)


def samples(images: list[Image], coefficients: np.ndarray) -> np.ndarray:
    """Inverse transform of all blocks, with each component's quantisation, in one product."""
    c = coefficients.astype(np.float32)
    for img in images:
        for base, (w, h), q in zip(img.base, img.grid, img.quant):
            if (q != 1).any():
                c[base : base + w * h] *= q
    return c @ BASIS + 128
