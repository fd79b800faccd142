"""Media columns in lossless WebP (VP8L): a full decoder and an encoder for 8-bit sample arrays.

``decode`` reads any VP8L stream: simple and normal prefix codes, meta prefix images, back-references
with the two-dimensional distance map, the colour cache, and the inverse predictor, cross-colour,
subtract-green and palette transforms.

``encode_samples`` stores bytes as grey pixels and picks for each array what makes it small (``plan``):
a palette that packs up to eight pixels into one where few values occur, else a predictor (left or top
neighbour) where its differences have less entropy; then back-references to earlier stretches, and a
prefix code fitted to what is left. Cross-colour and the colour cache have nothing to give grey pixels.

Where one code carries the whole image, as in these files, all prefix codes are looked up at every bit
of the stream as array operations and the places that really begin a symbol follow from pointer jumps;
other streams are decoded symbol by symbol.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts_of

WIDTH = 64
MAX_SIDE = 1 << 14
_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
_NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


class Bits:
    """Reads bits from the lowest of each byte upward."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        a, s = self.at >> 3, self.at & 7
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return int.from_bytes(self.data[a : (self.at + 7) >> 3], "little") >> s & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        """The next n bits, zeros beyond the end, without moving on."""
        a = self.at >> 3
        return int.from_bytes(self.data[a : (self.at + n + 7) >> 3], "little") >> (self.at & 7) & ((1 << n) - 1)


_REVERSED: dict[int, np.ndarray] = {}


def _reversed(n: int) -> np.ndarray:
    """All numbers of n bits with their bits in the other order."""
    if n not in _REVERSED:
        x, out = np.arange(1 << n), np.zeros(1 << n, np.int64)
        for i in range(n):
            out = out << 1 | x >> i & 1
        _REVERSED[n] = out
    return _REVERSED[n]


class Code:
    """A canonical prefix code from the lengths of its symbols."""

    def __init__(self, lengths: list[int]):
        x = np.asarray(lengths, np.int64)
        used = np.flatnonzero(x)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        self.symbols = used[np.argsort(x[used], kind="stable")]
        self.lengths = x[self.symbols]
        self.only = int(used[0]) if len(used) == 1 else None
        self.longest = int(self.lengths[-1])
        if self.only is None and int((1 << self.longest - self.lengths).sum()) != 1 << self.longest:
            raise ValueError("a prefix code that is not complete")
        self._plain = None

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, length) by the next ``longest`` bits of the stream."""
        if self.only is not None:
            return np.array([self.only]), np.array([0])
        many, back = 1 << self.longest - self.lengths, _reversed(self.longest)
        return np.repeat(self.symbols, many)[back], np.repeat(self.lengths, many)[back]

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self._plain is None:
            self._plain = [t.tolist() for t in self.tables()]
        i = bits.peek(self.longest)
        bits.read(self._plain[1][i])
        return self._plain[0][i]


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    meta = [0] * 19
    for i in range(4 + bits.read(4)):
        meta[_ORDER[i]] = bits.read(3)
    code = Code(meta)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    i, last = 0, 8
    while i < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[i] = s
            last, i = s or last, i + 1
            continue
        n, v = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
        if i + n > size:
            raise ValueError("code lengths beyond the alphabet")
        lengths[i : i + n] = [v] * n
        i += n
    return Code(lengths)


def _length(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


#: Bytes of a stream that are looked at together, and bits that the longest symbol with all it carries may take.
_STRETCH, _SPAN = 1 << 16, 80
_EXTRA = np.maximum((np.arange(40) - 2) >> 1, 0)
_BASE = np.where(np.arange(40) < 4, np.arange(40) + 1, ((2 + (np.arange(40) & 1)) << _EXTRA) + 1)


def _greens(bits: Bits, green: Code, dist: Code, width: int, total: int) -> np.ndarray:
    """``total`` samples of one channel, the only one with bits of its own: literals and back-references."""
    out, done = np.zeros(total, np.uint8), 0
    sym_of, len_of = (t.astype(np.int16) for t in green.tables())
    dsym_of, dlen_of = dist.tables()
    refers = int(green.symbols.max()) >= 256
    size = 8 * len(bits.data)
    while done < total:
        a = bits.at >> 3
        raw = np.frombuffer(bits.data, np.uint8, min(_STRETCH + 16, len(bits.data) - a), a)
        raw = np.concatenate([raw, np.zeros(16, np.uint8)])
        n = 8 * min(_STRETCH, len(bits.data) - a)  # bit places at which a symbol may begin in this stretch
        # 8 bytes from every byte on, or 4 where no symbol carries more than itself
        wide = np.dtype("<u8" if refers else "<u4")
        w = np.ndarray(len(raw) - 7, wide, raw, 0, (1,))[: (n + _SPAN >> 3) + 1]
        places = (w[:, None] >> np.arange(8, dtype=wide)).ravel()
        code = (places & wide.type((1 << green.longest) - 1)).astype(np.int32)
        sym, step = sym_of[code], len_of[code]
        nxt = np.arange(len(sym), dtype=np.int32) + step
        if refers:
            at = np.flatnonzero(sym >= 256)
            at = at[at < n]
            k = sym[at].astype(np.int64) - 256
            more = _EXTRA[k]
            field = places[at] >> step[at].astype(np.uint64)
            length = _BASE[k] + (field & ((np.uint64(1) << more.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            q = np.minimum(at + step[at] + more, len(places) - 1)
            d = (places[q] & np.uint64((1 << dist.longest) - 1)).astype(np.int64) if dist.only is None else np.zeros(len(at), np.int64)
            ds, dl = dsym_of[d], dlen_of[d]
            far = _EXTRA[np.minimum(ds, 39)]
            field = places[q] >> dl.astype(np.uint64)
            away = _BASE[np.minimum(ds, 39)] + (field & ((np.uint64(1) << far.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            nxt[at] = q + dl + far
        nxt[n:] = np.arange(n, len(nxt))
        np.minimum(nxt, len(nxt) - 1, out=nxt)
        two = nxt[nxt]
        four = two[two]
        eight = four[four]
        p, heads = bits.at & 7, []
        while p < n and len(heads) * 8 < total - done:
            heads.append(p)
            p = int(eight[p])
        x = np.array(heads, np.int64)[:, None]
        for jump in (nxt, two, four):
            x = np.concatenate([x, jump[x]], axis=1)
        x = x.ravel()
        x = x[x < n]
        s = sym[x]
        many = np.ones(len(x), np.int64)
        if refers:
            copies = np.flatnonzero(s >= 256)
            which = np.searchsorted(at, x[copies])
            many[copies] = length[which]
        ends = done + np.cumsum(many)
        need = int(np.searchsorted(ends, total)) + 1  # symbols up to the one that fills the image
        x, s, many, ends = x[:need], s[:need], many[:need], ends[:need]
        if len(ends) and ends[-1] > total:
            raise ValueError("a back-reference outside the image")
        begin = ends - many
        plain = s < 256
        out[begin[plain]] = s[plain]
        for i in np.flatnonzero(~plain).tolist():
            j = int(np.searchsorted(at, x[i]))
            c, e, d = int(begin[i]), int(ends[i]), int(away[j])
            if d > 120:
                d -= 120
            else:
                dx, dy = _NEAR[d - 1]
                d = max(1, dx + dy * width)
            if d > c:
                raise ValueError("a back-reference outside the image")
            while c < e:  # a stretch may reach into itself
                m = min(d, e - c)
                out[c : c + m] = out[c - d : c - d + m]
                c += m
                d += m
        if len(x):
            bits.at = 8 * a + int(nxt[x[-1]])
            done = int(ends[-1])
        if bits.at > size or (not len(x) and done < total):
            raise ValueError("the stream ends early")
    return out


def _image(bits: Bits, width: int, height: int, outer: bool) -> np.ndarray:
    """One entropy-coded image as uint32 ARGB of width * height; ``outer``: it may have a meta prefix image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, shift, across = None, 0, 0
    n_groups = 1
    if outer and bits.read(1):
        shift = bits.read(3) + 2
        across = (width + (1 << shift) - 1) >> shift
        groups = _image(bits, across, (height + (1 << shift) - 1) >> shift, False) >> 8 & 0xFFFF
        n_groups = int(groups.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[_read_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(n_groups)]
    total = width * height
    green, red, blue, alpha, dist = codes[0]
    if n_groups == 1 and not cache_bits and all(c.only is not None for c in (red, blue, alpha)) and (green.only is None or green.only < 256):
        g = np.full(total, green.only, np.uint8) if green.only is not None else _greens(bits, green, dist, width, total)
        return np.uint32(alpha.only << 24 | red.only << 16 | blue.only) | g.astype(np.uint32) << np.uint32(8)
    out, cache = [0] * total, [0] * cache_size
    i = 0

    def remember(v: int) -> None:
        if cache_size:
            cache[(0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v

    while i < total:
        y, x = divmod(i, width)
        green, red, blue, alpha, dist = codes[int(groups[(y >> shift) * across + (x >> shift)])] if groups is not None else codes[0]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[i] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            remember(out[i])
            i += 1
        elif s < 280:
            n = _length(bits, s - 256)
            d = _length(bits, dist.read(bits))
            if d > 120:
                d -= 120
            else:
                dx, dy = _NEAR[d - 1]
                d = max(1, dx + dy * width)
            if d > i or i + n > total:
                raise ValueError("a back-reference outside the image")
            for _ in range(n):
                out[i] = out[i - d]
                remember(out[i])
                i += 1
        else:
            out[i] = cache[s - 280]
            remember(out[i])
            i += 1
    return np.array(out, np.uint32)


def _channels(argb: int) -> tuple[int, int, int, int]:
    return argb >> 24, argb >> 16 & 255, argb >> 8 & 255, argb & 255


def _predict(mode: int, left: int, top: int, tr: int, tl: int) -> tuple[int, ...]:
    lc, tc, rc, dc = _channels(left), _channels(top), _channels(tr), _channels(tl)
    if mode == 0 or mode > 13:
        return 255, 0, 0, 0
    if mode < 5:
        return (lc, tc, rc, dc)[mode - 1]
    if mode == 11:
        p = [a + b - c for a, b, c in zip(lc, tc, dc)]
        return lc if sum(abs(a - b) for a, b in zip(p, lc)) < sum(abs(a - b) for a, b in zip(p, tc)) else tc
    mean = lambda a, b: tuple((p + q) >> 1 for p, q in zip(a, b))
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 12:
        return tuple(clamp(a + b - c) for a, b, c in zip(lc, tc, dc))
    if mode == 13:
        m = mean(lc, tc)
        return tuple(clamp(a + int((a - c) / 2)) for a, c in zip(m, dc))
    return {5: lambda: mean(mean(lc, rc), tc), 6: lambda: mean(lc, dc), 7: lambda: mean(lc, tc), 8: lambda: mean(dc, tc), 9: lambda: mean(tc, rc), 10: lambda: mean(mean(lc, dc), mean(tc, rc))}[mode]()


def _undo_predictor(px: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    used = np.unique(modes >> 8 & 15)
    if len(used) == 1 and used[0] in (1, 2):  # the left or the top neighbour all over: running sums
        c = px.view(np.uint8).reshape(height, width, 4).copy()
        c[0, 0, 3] = (int(c[0, 0, 3]) + 255) & 255
        if used[0] == 1:
            c[:, 0] = np.cumsum(c[:, 0], 0, dtype=np.uint8)
            c = np.cumsum(c, 1, dtype=np.uint8)
        else:
            c[0] = np.cumsum(c[0], 0, dtype=np.uint8)
            c = np.cumsum(c, 0, dtype=np.uint8)
        return np.ascontiguousarray(c).view(np.uint32).ravel()
    out, across = px.tolist(), (width + (1 << bits) - 1) >> bits
    mode_of = (modes >> 8 & 15).tolist()
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not i:
                p = (255, 0, 0, 0)
            elif not y:
                p = _channels(out[i - 1])
            elif not x:
                p = _channels(out[i - width])
            else:  # beyond the right edge, the next pixel in memory: the first of this row
                p = _predict(mode_of[(y >> bits) * across + (x >> bits)], out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
            a, r, g, b = (u + v & 255 for u, v in zip(_channels(out[i]), p))
            out[i] = a << 24 | r << 16 | g << 8 | b
    return np.array(out, np.uint32)


def _undo_cross(px: np.ndarray, width: int, height: int, bits: int, elements: np.ndarray) -> np.ndarray:
    across = (width + (1 << bits) - 1) >> bits
    yy, xx = np.divmod(np.arange(width * height), width)
    e = elements[(yy >> bits) * across + (xx >> bits)]
    s8 = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    delta = lambda t, c: s8(t) * s8(c) >> 5
    green = px >> 8
    red = (px >> 16 & 255).astype(np.int32) + delta(e, green) & 255
    blue = (px & 255).astype(np.int32) + delta(e >> 8, green) + delta(e >> 16, red.astype(np.uint32)) & 255
    return px & np.uint32(0xFF00FF00) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def _undo_green(px: np.ndarray) -> np.ndarray:
    g = px >> 8 & 255
    return px & np.uint32(0xFF00FF00) | ((px >> 16) + g & 255) << np.uint32(16) | (px & 255) + g & 255


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels (height, width) uint32 of a lossless WebP file; ValueError where it is damaged."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    size = struct.unpack_from("<I", data, 16)[0]
    bits = Bits(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, w = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform appears twice")
        seen.add(kind)
        if kind < 2:
            b = bits.read(3) + 2
            side = lambda v: (v + (1 << b) - 1) >> b  # noqa: B023, E731
            inner = _image(bits, side(w), side(height), False)
            undo.append((_undo_predictor if kind == 0 else _undo_cross, w, b, inner))
        elif kind == 2:
            undo.append((None, w, 0, None))
        else:
            n = bits.read(8) + 1
            flat = _image(bits, n, 1, False).view(np.uint8).reshape(-1, 4)
            palette = np.cumsum(flat, 0, dtype=np.uint8).view(np.uint32).ravel()
            b = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(("palette", w, b, palette))
            w = (w + (1 << b) - 1) >> b
    px = _image(bits, w, height, True)
    for f, w, b, inner in reversed(undo):
        if f is None:
            px = _undo_green(px)
        elif f == "palette":
            g = (px >> 8 & 255).reshape(height, -1)
            if b:
                each = 8 >> b
                g = np.stack([g >> (each * i) & ((1 << each) - 1) for i in range(1 << b)], 2).reshape(height, -1)[:, :w]
            full = np.zeros(256, np.uint32)
            full[: len(inner)] = inner
            px = full[g.ravel()]
        else:
            px = f(px, w, height, b, inner)
    return px.reshape(height, width)


class _Writer:
    """Bits, the lowest first."""

    def __init__(self):
        self.bits: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.bits += [value >> i & 1 for i in range(n)]

    def array(self) -> np.ndarray:
        return np.array(self.bits, np.uint8)


def _container(stream: bytes) -> bytes:
    pad = len(stream) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + pad) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + bytes(pad)


def _code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code; counts are flattened until no length is above ``limit``."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    c = counts[used].astype(np.int64)
    while True:
        heap = [(n, i) for i, n in enumerate(c.tolist())]
        heapq.heapify(heap)
        up, k = [0] * (2 * len(used)), len(used)
        while len(heap) > 1:
            n, i = heapq.heappop(heap)
            m, j = heap[0]
            up[i] = up[j] = k
            heapq.heapreplace(heap, (n + m, k))
            k += 1
        depth = [0] * k
        for i in range(k - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth[: len(used)]) <= limit:
            out[used] = depth[: len(used)]
            return out
        c = (c + 1) // 2


def _codes(lengths: np.ndarray) -> np.ndarray:
    """The bits of every symbol of a canonical code, the first bit of the code lowest; none where one symbol has them all."""
    out, used = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths)
    if len(used) > 1:
        order = used[np.argsort(lengths[used], kind="stable")]
        n, top = lengths[order], int(lengths.max())
        first = np.concatenate([[0], np.cumsum(1 << top - n)[:-1]]) >> top - n
        out[order] = _reversed(top)[first] >> top - n
    return out


def _put_code(w: _Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist() or [0]
    if len(used) <= 2 and used[-1] < 256:
        w.put(1 | (len(used) - 1) << 1 | 1 << 2, 3)  # a simple code; symbols take 8 bits
        for v in used:
            w.put(v, 8)
        return
    w.put(0, 1)
    x = lengths.tolist()
    tokens: list[tuple[int, int, int]] = []  # (symbol, extra bits, how many of them)
    i = 0
    while i < len(x):
        j = i
        while j < len(x) and x[j] == x[i]:
            j += 1
        n = j - i
        if x[i]:
            tokens.append((x[i], 0, 0))
            n -= 1
            while n >= 3:
                m = min(n, 6)
                tokens.append((16, m - 3, 2))
                n -= m
            tokens += [(x[i], 0, 0)] * n
        else:
            while n >= 3:
                m = min(n, 138)
                tokens.append((18, m - 11, 7) if m > 10 else (17, m - 3, 3))
                n -= m
            tokens += [(0, 0, 0)] * n
        i = j
    meta = _code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    bits, size = _codes(meta).tolist(), (meta if np.count_nonzero(meta) > 1 else meta * 0).tolist()
    count = max(4, max(k for k, v in enumerate(_ORDER) if meta[v]) + 1)
    w.put(count - 4, 4)
    for v in _ORDER[:count]:
        w.put(int(meta[v]), 3)
    w.put(0, 1)  # the lengths of all symbols follow
    for t, extra, n in tokens:
        w.put(bits[t], size[t])
        w.put(extra, n)


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbol, extra bits, how many of them) of lengths or distances."""
    v = values - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    large = v >= 4
    n = np.where(large, top - 1, 0)
    return np.where(large, 2 * top + (v >> n & 1), v), v & (1 << n) - 1, n


#: Bytes that must be equal at least, and the longest stretch and distance of a back-reference.
SHORTEST, LONGEST, FARTHEST = 16, 4096, 1_000_000


def _references(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of stretches that repeat earlier ones, apart and in order."""
    if len(x) < 2 * SHORTEST:
        return []
    g = np.ndarray(len(x) - 7, "<u8", np.ascontiguousarray(x), 0, (1,)).copy()
    bits = max(10, min(20, (len(g) - 1).bit_length()))
    slot = (g * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
    at = np.arange(len(g))
    first = np.zeros(1 << bits, np.int64)
    first[slot[::-1]] = at[::-1]
    away = at - first[slot]
    away[(g != g[at - away]) | (away > FARTHEST)] = 0
    ends = np.flatnonzero(np.diff(away)) + 1
    begin, stop = np.concatenate([[0], ends]), np.concatenate([ends, [len(away)]])
    good = (away[begin] > 0) & (stop - begin + 7 >= SHORTEST)
    out, free = [], 0
    for i, e, d in zip(begin[good].tolist(), (stop[good] + 7).tolist(), away[begin[good]].tolist()):
        i = max(i, free)
        while e - i >= SHORTEST:
            n = min(e - i, LONGEST)
            out.append((i, n, d))
            i = free = i + n
    return out


def _entropy(x: np.ndarray) -> float:
    n = np.bincount(x.ravel(), minlength=256)
    n = n[n > 0].astype(np.float64)
    return float(x.size * np.log2(x.size) - (n * np.log2(n)).sum())


def plan(samples: np.ndarray) -> tuple[str, np.ndarray, list[tuple[int, int, int]]]:
    """(transform, its image, back-references): "palette", "left", "top" or "none"."""
    values = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    if len(values) <= 16:
        index = np.zeros(256, np.uint8)
        index[values] = np.arange(len(values))
        pack = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
        each, wide = 8 >> pack, -(-samples.shape[1] // (1 << pack)) << pack
        x = np.zeros((samples.shape[0], wide), np.uint8)
        x[:, : samples.shape[1]] = index[samples]
        x = x.reshape(len(x), -1, 1 << pack) << (each * np.arange(1 << pack)).astype(np.uint8)
        name, out = "palette", np.bitwise_or.reduce(x, axis=2).astype(np.uint8)
    else:
        left, top = np.empty_like(samples), np.empty_like(samples)
        left[:, 1:], top[1:] = samples[:, 1:] - samples[:, :-1], samples[1:] - samples[:-1]
        left[1:, 0], top[0, 1:] = samples[1:, 0] - samples[:-1, 0], samples[0, 1:] - samples[0, :-1]
        left[0, 0] = top[0, 0] = samples[0, 0]
        name, out = min((("none", samples), ("left", left), ("top", top)), key=lambda c: _entropy(c[1]))
    return name, out, _references(out.ravel())


def encode_samples(samples: np.ndarray) -> bytes:
    """A grey image (height, width) uint8 as a lossless WebP file."""
    height, width = samples.shape
    name, image, copies = plan(samples)
    w = _Writer()
    w.put(0x2F | (width - 1) << 8 | (height - 1) << 22, 40)  # no alpha, version 0
    single = lambda v: w.put(0b101 | v << 3, 11)  # noqa: E731  a simple code of one symbol
    if name == "palette":
        values = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
        w.put(0b111 | (len(values) - 1) << 3, 11)
        w.put(0, 1)  # no colour cache
        steps = np.diff(values, prepend=0)
        alpha = np.zeros(len(values), np.int64)
        alpha[0] = 255  # alphas are stored as differences, too
        lengths = []
        for c, size in ((steps, 280), (steps, 256), (steps, 256), (alpha, 256)):
            lengths.append(_code_lengths(np.bincount(c, minlength=size), 15))
            _put_code(w, lengths[-1])
        single(0)
        bits = [_codes(n) for n in lengths]
        size = [n if np.count_nonzero(n) > 1 else n * 0 for n in lengths]
        for s, a in zip(steps.tolist(), alpha.tolist()):
            for k, v in enumerate((s, s, s, a)):
                w.put(int(bits[k][v]), int(size[k][v]))
        rest = 0, 0, 255
    else:
        if name != "none":
            w.put(0b001 | 7 << 3, 6)  # a predictor with blocks of 512 pixels
            w.put(0, 1)
            for v in (1 if name == "left" else 2, 0, 0, 255, 0):
                single(v)
        w.put(0b101, 3)  # subtract green
        rest = 0, 0, 255 if name == "none" else 0
    w.put(0, 3)  # no more transforms, no colour cache, one prefix group
    flat = image.ravel()
    start, length, away = (np.array(c, np.int64) for c in (zip(*copies) if copies else ((), (), ())))
    begins = np.ones(len(flat), bool)
    for i, n, _ in copies:
        begins[i + 1 : i + n] = False
    at = np.flatnonzero(begins)
    sym = flat[at].astype(np.int64)
    which = np.searchsorted(at, start)
    kind, extra, n_extra = _prefixed(length)
    far, far_extra, n_far = _prefixed(away + 120)
    sym[which] = 256 + kind
    green, dist = _code_lengths(np.bincount(sym, minlength=280), 15), _code_lengths(np.bincount(far, minlength=40), 15)
    _put_code(w, green)
    for v in rest:
        single(v)
    _put_code(w, dist)
    none = lambda n: n if np.count_nonzero(n) > 1 else n * 0
    size, value = none(green)[sym], _codes(green)[sym]
    if copies:  # a symbol, the rest of its length, a distance and the rest of that
        fields = np.zeros((len(sym), 4), np.int64)
        sizes = np.zeros((len(sym), 4), np.int64)
        fields[:, 0], sizes[:, 0] = value, size
        fields[which, 1], sizes[which, 1] = extra, n_extra
        fields[which, 2], sizes[which, 2] = _codes(dist)[far], none(dist)[far]
        fields[which, 3], sizes[which, 3] = far_extra, n_far
        there = sizes.ravel() > 0
        value, size = fields.ravel()[there], sizes.ravel()[there]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    offset = np.arange(total) - np.repeat(ends - size, size)
    body = (np.repeat(value, size) >> offset & 1).astype(np.uint8)
    return _container(np.packbits(np.concatenate([w.array(), body]), bitorder="little").tobytes())


def store(payload: bytes) -> bytes:
    """Payload (a positive multiple of WIDTH bytes) as one or, above 1 MiB, several WebP files in a row."""
    out, step = [], WIDTH * MAX_SIDE
    for i in range(0, len(payload), step):
        out.append(encode_samples(np.frombuffer(payload, np.uint8, min(step, len(payload) - i), i).reshape(-1, WIDTH)))
    return b"".join(out)


def read_back(media: bytes) -> np.ndarray:
    """The samples of all files of ``media``, one after the other."""
    parts, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        parts.append((decode(media[at:end]) >> 8 & 255).astype(np.uint8).ravel())
        at = end
    return np.concatenate(parts)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, mean step between neighbours, number of values."""
    n = np.bincount(samples, minlength=256)
    v, p = np.arange(256), n / len(samples)
    mean = float(p @ v)
    dev = float(max(p @ (v * v) - mean * mean, 0.0)) ** 0.5
    q = p[p > 0]
    step = float(np.abs(np.diff(samples.astype(np.int16))).mean()) if len(samples) > 1 else 0.0
    return f"mean={mean:.4f};dev={dev:.4f};entropy={abs(float(-(q @ np.log2(q)))):.4f};step={step:.4f};values={len(q)}"


def media_row(text: bytes) -> tuple:
    payload = text + bytes(-len(text) % WIDTH if text else WIDTH)
    media = store(payload)
    back = read_back(media)
    raw = back.tobytes()
    return len(text), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(back)


FIELDS = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]


def with_media(docs: DataFrame, media: bool = False) -> DataFrame:
    """doc_id and the columns of FIELDS for every row; with ``media`` also the stored files.

    The bytes of the text (null: empty) are padded with zeros to a positive multiple of 64, stored, and
    all that is returned is computed from the stored form read back. Equal texts give equal values.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = texts_of(b.column(b.schema.get_field_index("text")))
            ids = b.column(b.schema.get_field_index("doc_id"))
            for i in range(0, len(texts), 512):
                part = texts[i : i + 512]
                cols = list(zip(*map(media_row, part)))
                arrays = [pa.array(c, pa.int64() if k == "long" else pa.string()) for c, (_, k) in zip(cols, FIELDS)]
                names = ["doc_id", *(n for n, _ in FIELDS)]
                if media:
                    arrays.append(pa.array([store(t + bytes(-len(t) % WIDTH if t else WIDTH)) for t in part], pa.binary()))
                    names.append("media")
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(part)), *arrays], names)

    schema = ", ".join([f"doc_id {kind}", *(f"{n} {k}" for n, k in FIELDS)] + ["media binary"] * media)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sizes, hashes, checksum and feature of every text stored as lossless WebP and read back."""
    return with_media(table(spark, sf_dir, "documents"))
