"""SentencePiece encoding and decoding by a max-plus scan.

An encoding is the best path through the lattice of pieces that match the text. Weights add along a
path and the best path wins, so the lattice between two cuts of a text is a max-plus matrix from the
states at the one cut to the states at the other, and matrices combine associatively. A state at a
cut is the piece that covers the character before it. Texts above CHUNK characters are cut into chunks
that are shuffled as rows of their own; each gives its matrix, a scan over the few matrices of a text
fixes the state at every cut, and each chunk is then traced back on its own (``encode_giants``). A cut
moves to the next word start where one is near, so that most have a single state.

* Unigram models: the weight of a piece is its score.
* BPE models: the weight is 0 and a piece may follow another only if the model's merges leave just
  these two on their joined text (``Model.may_follow``); all else weighs minus infinity. Exactly one
  path is left, which is what greedy merging gives: merges at a border of two pieces depend on these
  two alone, and merges inside a piece on that piece alone.

Where no piece crosses a word start there is one state only, so words are independent matrices of one
entry; they are worked out many at a time as array operations and remembered.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, thrifty

#: The public model file; pass another path to use another model.
MODEL = os.environ.get("ARBORA_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Characters of a chunk; words above LONG characters are scanned chunk by chunk, too.
CHUNK = 1 << 16
LONG = 40
#: How far a cut looks for a word start, and the characters kept before a chunk (above the longest piece).
LOOK, PAD = 4096, 64
#: Words of a generation; a worker remembers two, so a word is forgotten only if it is not met for as many new ones.
REMEMBERED = 150_000
#: Words that are worked out at once, and rows that are encoded at once.
BATCH, ROWS = 10_000, 1000
#: Chunks of a block: their matrices are multiplied in one task, the products of blocks are then scanned.
BLOCK = 64
SPACE = "▁"
_R = np.uint64(0x9E3779B97F4A7C15)
LOW = float("-inf")


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message: ints, or bytes of strings, messages and floats."""
    i = 0

    def varint():
        nonlocal i
        v = s = 0
        while True:
            b = data[i]
            i += 1
            v |= (b & 127) << s
            s += 7
            if b < 128:
                return v

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[i : i + n]
            i += n


class Table:
    """Open-addressing map from uint64 keys to int32 values for arrays of keys; missing keys give -1."""

    def __init__(self, bits: int):
        self.bits, self.size, self.n = bits, 1 << bits, 0
        self.keys = np.zeros(self.size, np.uint64)
        self.values = np.full(self.size, -1, np.int32)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        x = keys * _R
        x ^= x >> np.uint64(32)
        return (x * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table."""
        at, left = self._at(keys), np.arange(len(keys))
        self.n += len(keys)
        while len(left):
            here = at[left]
            free = self.values[here] < 0
            self.keys[here[free]] = keys[left[free]]
            self.values[here[free]] = values[left[free]]
            stay = ~(free & (self.keys[here] == keys[left]))
            left = left[stay]
            at[left] = at[left] + 1 & self.size - 1

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        out = self.values[at]
        left = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(left):
            at[left] = at[left] + 1 & self.size - 1
            v = self.values[at[left]]
            out[left] = v
            left = left[(v >= 0) & (self.keys[at[left]] != keys[left])]
        return out


class Model:
    """A SentencePiece model: pieces, scores, kind, and what the scan needs."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, types = [], []
        self.kind, self.byte_fallback, dummy, squeeze = 1, False, True, True
        for f, v in _fields(data):
            if f == 1:
                d = dict(_fields(v))
                self.pieces.append(d.get(1, b"").decode())
                scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                types.append(d.get(3, 1))
            elif f == 2:
                d = dict(_fields(v))
                self.kind, self.byte_fallback = d.get(3, 1), bool(d.get(35, 0))
            elif f == 3:
                d = dict(_fields(v))
                dummy, squeeze = bool(d.get(3, 1)), bool(d.get(4, 1))
                if d.get(2):
                    raise ValueError("only models with the identity normaliser are supported")
        if self.kind not in (1, 2) or squeeze or not dummy or any(t in (4, 5) for t in types):
            raise ValueError("an unsupported kind of model")
        n = len(self.pieces)
        self.size = n
        self.unk = types.index(2)
        self.byte_ids = np.full(256, self.unk, np.int32)
        self.id_of: dict[str, int] = {}
        self.text: list[bytes] = []  # what an id decodes to
        for i, (p, t) in enumerate(zip(self.pieces, types)):
            if t == 6:
                self.byte_ids[int(p[3:5], 16)] = i
                self.text.append(bytes([int(p[3:5], 16)]))
            else:
                self.text.append(p.replace(SPACE, " ").encode() if t == 1 else b"")
            if t == 1:
                self.id_of[p] = i
        self.score = scores
        self.unk_score = min((scores[i] for i in self.id_of.values()), default=0.0) - 10
        # characters inside pieces that are no piece themselves still are symbols of the merges
        self.symbols = list(self.pieces)
        self.symbol_of = dict(self.id_of)
        for c in sorted({c for p in self.id_of for c in p} - self.id_of.keys()):
            self.symbol_of[c] = len(self.symbols)
            self.symbols.append(c)
        self.longest = max(map(len, self.id_of), default=1)
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        if self.crossing:
            raise ValueError("pieces that hold a space after a letter are not supported")
        self._prepare()

    def _prepare(self) -> None:
        n = len(self.symbols)
        self.whole = np.ones(n, bool)  # the merges give this piece on its own text
        if self.kind == 2:
            pairs = {}
            for p, i in self.id_of.items():
                for k in range(1, len(p)):
                    a, b = self.symbol_of.get(p[:k]), self.symbol_of.get(p[k:])
                    if a is not None and b is not None:
                        pairs[a, b] = i
            m = self.longest
            self.rank = np.full((n, m), LOW, np.float32)  # score of the k-th merge inside a piece
            self.head = np.zeros((n, m), np.int32)  # first and last symbol before the k-th merge
            self.tail = np.zeros((n, m), np.int32)
            for p, i in self.symbol_of.items():
                now = [self.symbol_of[c] for c in p]
                k = 0
                while True:
                    self.head[i, k:], self.tail[i, k:] = now[0], now[-1]
                    best = max(((self.score[pairs[ab]], -j) for j, ab in enumerate(zip(now, now[1:])) if ab in pairs), default=None)
                    if best is None:
                        break
                    j = -best[1]
                    self.rank[i, k] = best[0]
                    now[j : j + 2] = [pairs[now[j], now[j + 1]]]
                    k += 1
                self.whole[i] = len(now) == 1
            self.merge = Table(20)
            keys = np.array([a * n + b for a, b in pairs], np.uint64)
            self.merge.add(keys, np.array(list(pairs.values()), np.int32))
            self.scores32 = np.array(self.score + [0.0] * (n - len(self.score)), np.float32)
        self.lookup = Table(17 if n < 60_000 else n.bit_length() + 2)
        self.lookup.add(np.array([self._hash(p) for p in self.symbol_of], np.uint64), np.array(list(self.symbol_of.values()), np.int32))
        self.maybe = np.zeros(1 << 20, bool)  # small enough for the cache: most strings are no piece
        self.maybe[(self.lookup.keys[self.lookup.values >= 0] >> np.uint64(44)).astype(np.int64)] = True
        self.fine = np.append(self.whole, True)
        self.weight = np.array([self.score[i] if i < self.size else 0.0 for i in range(n)])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, symbols) of those hashes that are a symbol's."""
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        t = self.lookup.get(h[at])
        hit = t >= 0
        return at[hit], t[hit]

    @staticmethod
    def _mix(code: np.ndarray) -> np.ndarray:
        x = code.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + _R
        x ^= x >> np.uint64(32)
        return x * np.uint64(0xBF58476D1CE4E5B9)

    def _hash(self, p: str) -> int:
        h = 0
        for x in self._mix(np.array([ord(c) for c in p])).tolist():
            h = (h * int(_R) + x) & (2**64 - 1)
        return h

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined text of symbols a and b leaves a, b (for arrays of symbols)."""
        n = len(self.symbols)
        out = np.ones(len(a), bool)
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        m = self.longest - 1
        while len(live):
            x, y, p, q = a[live], b[live], i[live], j[live]
            left, right = self.rank[x, p], self.rank[y, q]
            made = self.merge.get((self.tail[x, p].astype(np.uint64) * np.uint64(n)) + self.head[y, q].astype(np.uint64))
            cross = np.where(made >= 0, self.scores32[made], np.float32(LOW))
            joins = (made >= 0) & (cross > left) & (cross >= right)
            out[live[joins]] = False
            over = joins | ((left == LOW) & (right == LOW))
            go_left = ~over & (left >= right)
            go_right = ~over & ~go_left
            i[live[go_left]] += 1
            j[live[go_right]] += 1
            np.minimum(i, m, out=i)
            np.minimum(j, m, out=j)
            live = live[~over]
        return out


class Encoder:
    """Encodes with a model; remembers words and pairs of pieces. One to a worker."""

    def __init__(self, model: Model):
        self.m = model
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known = Table(21)

    def _allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.m.kind == 1 or not len(a):
            return np.ones(len(a), bool)
        n = len(self.m.symbols)
        plain = (a < n) & (b < n)  # an unknown character borders on anything
        out = np.ones(len(a), bool)
        at = np.flatnonzero(plain)
        keys = a[at].astype(np.uint64) * np.uint64(n) + b[at].astype(np.uint64) + np.uint64(1)
        got = self.known.get(keys)
        new = np.unique(keys[got < 0])
        if len(new):
            if self.known.n + len(new) > self.known.size // 2:
                self.known = Table(self.known.bits)
            pair = new - np.uint64(1)
            ok = self.m.may_follow((pair // np.uint64(n)).astype(np.int64), (pair % np.uint64(n)).astype(np.int64))
            if self.known.n + len(new) > self.known.size // 2:  # more new pairs than the memory holds
                out[at] = ok[np.searchsorted(new, keys)] if len(new) == len(np.unique(keys)) else self.m.may_follow(a[at], b[at])
                return out
            self.known.add(new, ok.astype(np.int32))
            got = self.known.get(keys)
            if (got < 0).any():  # forgotten above
                lost = got < 0
                got[lost] = self.m.may_follow(a[at[lost]], b[at[lost]])
        out[at] = got > 0
        return out

    def _paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of words of one length one after the other, number of symbols of each), all at once.

        An unknown character is -1 minus the place where it stands.
        """
        m, length, n = self.m, len(words[0]), len(words)
        none = len(m.symbols)
        x = m._mix(np.array(words).view(np.uint32).reshape(n, length))
        prefix = np.zeros((n, length + 1), np.uint64)
        for e in range(length):
            prefix[:, e + 1] = prefix[:, e] * _R + x[:, e]
        power = np.ones(length + 1, np.uint64)
        power[1:] = np.cumprod(np.full(length, _R))
        found = []  # (row, start, end, symbol) of every piece in every word
        for k in range(1, min(m.longest, length) + 1):
            wide = length + 1 - k
            h = (prefix[:, k:] - prefix[:, :wide] * power[k]).ravel()
            at, t = m.find(h)
            if k == 1:
                all_t = np.full(n * length, none, np.int32)
                all_t[at] = t
                at, t = np.arange(n * length), all_t
            ok = m.fine[t]
            at, t = at[ok], t[ok]
            row = at // wide
            start = at - row * wide
            found.append((row, start, (start + k).astype(np.int16), t))
        row, start, end, sym = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(end, kind="stable")
        row, start, sym = row[order], start[order], sym[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=length + 1))])
        reached, last, back = np.zeros((n, length + 1), bool), np.zeros((n, length + 1), np.int64), np.zeros((n, length + 1), np.int64)
        reached[:, 0] = True
        best = np.zeros((n, length + 1)) if m.kind == 1 else None
        for e in range(1, length + 1):
            r, s, t = (c[ends[e] : ends[e + 1]] for c in (row, start, sym))
            ok = reached[r, s]
            inner = np.flatnonzero(ok & (s > 0))
            ok[inner] = self._allowed(last[r[inner], s[inner]], t[inner].astype(np.int64))
            r, s, t = r[ok], s[ok], t[ok]
            if m.kind == 1:
                v = best[r, s] + np.where(t < m.size, m.weight[np.minimum(t, len(m.weight) - 1)], m.unk_score)
                up = np.lexsort((s, v))  # the best is written last, of equals the shortest piece
                r, s, t = r[up], s[up], t[up]
                best[r, e] = v[up]
            reached[r, e], last[r, e], back[r, e] = True, t, s
        out, used = np.zeros((n, length), np.int32), np.zeros((n, length), bool)
        r, p = np.arange(n), np.full(n, length)
        while len(r):
            v, s = last[r, p], back[r, p]
            out[r, s] = np.where(v < m.size, v, -1 - s)
            used[r, s] = True
            more = s > 0
            r, p = r[more], s[more]
        return out[used], used.sum(1)

    def _batch(self, words: list[str]) -> list[list[int]]:
        """Symbols of words of one length; an unknown character is -1 minus its place."""
        flat, counts = self._paths(words)
        return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]

    def _ids(self, word: str, symbols: list[int]) -> bytes:
        if min(symbols, default=0) >= 0:
            return np.array(symbols, np.int32).tobytes()
        ids: list[int] = []
        for s in symbols:
            ids += self.m.byte_ids[list(word[-1 - s].encode())].tolist() if s < 0 else [s]
        return np.array(ids, np.int32).tobytes()

    def learn(self, words: set[str]) -> None:
        """Works out what is not remembered: words without their leading space, or units that begin with one."""
        by: dict[int, list[str]] = {}
        for w in words:
            if len(w) < LONG:
                by.setdefault(len(w) + (w[:1] != SPACE), []).append(w)
            else:
                self.words[w] = self.scan(w if w[0] == SPACE else SPACE + w)
        for length, ws in by.items():
            step = max(500, BATCH * 8 // length)
            for i in range(0, len(ws), step):
                part = ws[i : i + step]
                flat, counts = self._paths([w if w[:1] == SPACE else SPACE + w for w in part])
                blob, ends = flat.tobytes(), (4 * np.cumsum(counts)).tolist()
                a = 0
                for w, b in zip(part, ends):
                    self.words[w] = blob[a:b]
                    a = b
                for i_ in np.unique(np.repeat(np.arange(len(part)), counts)[flat < 0]).tolist():
                    w, stop = part[i_], ends[i_] // 4
                    self.words[w] = self._ids(w if w[:1] == SPACE else SPACE + w, flat[stop - counts[i_] : stop].tolist())

    def recall(self, words: set[str]) -> None:
        """Makes sure that all these words and units are in ``words``, from the older generation or by working them out."""
        if len(self.words) > REMEMBERED:
            self.older, self.words = self.words, {}
        new = words - self.words.keys()
        again = new & self.older.keys()
        for w in again:
            self.words[w] = self.older[w]
        self.learn(new - again)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        split = []
        new: set[str] = set()
        for t in texts:
            if SPACE in t or "  " in t or t[-1:] == " " or t[:1] == " ":
                words = units(SPACE + t.replace(" ", SPACE))
            else:
                words = t.split(" ") if t else []
            split.append(words)
            new.update(words)
        self.recall(new)
        return [np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32) for words in split]

    # Section: the scan over chunks

    def _at(self, text: str, e: int) -> list[tuple[int, int]]:
        """(start, symbol) of the pieces of ``text`` that end at e; an unknown character is one, too."""
        m, out = self.m, []
        for s in range(max(0, e - m.longest), e):
            i = m.symbol_of.get(text[s:e])
            if i is None:
                if s == e - 1:
                    out.append((s, len(m.symbols)))
            elif m.whole[i]:
                out.append((s, i))
        return out

    def states(self, text: str, cut: int) -> list[tuple[int, int, int]]:
        """States at a cut: (start, end, symbol) of the pieces that cover the character before it."""
        if cut == 0:
            return [(0, 0, -1)]
        last = len(text) if cut < len(text) else cut
        return [(s, e, i) for e in range(cut, min(cut + self.m.longest, last + 1)) for s, i in self._at(text, e) if s < cut]

    def _follow(self, text: str, state: tuple[int, int, int], to: int) -> dict[int, tuple[float, int, int]]:
        """Best (weight, start, symbol) of a piece at every end up to just beyond ``to``, from a state on."""
        m = self.m
        best = {state[1]: (0.0, state[0], state[2])}
        for e in range(state[1] + 1, min(to + m.longest, len(text) + 1)):
            found = [(s, i) for s, i in self._at(text, e) if s in best and s >= state[1]]
            if state[2] >= 0 or any(s > state[1] for s, _ in found):
                a = np.array([best[s][2] for s, _ in found], np.int64)
                ok = (a < 0) | self._allowed(np.maximum(a, 0), np.array([i for _, i in found], np.int64)) if found else []
            else:
                ok = [True] * len(found)
            for (s, i), fine in zip(found, ok):
                if fine and s < to:
                    w = 0.0 if m.kind == 2 else best[s][0] + (m.unk_score if i >= m.size else m.score[i])
                    if e not in best or w > best[e][0]:
                        best[e] = (w, s, i)
        return best

    def matrix(self, text: str, a: int, b: int) -> np.ndarray:
        """Max-plus transfer matrix of the chunk [a, b): from the states at a to the states at b."""
        rows, cols = self.states(text, a), self.states(text, b)
        out = np.full((len(rows), len(cols)), LOW)
        for r, state in enumerate(rows):
            best = self._follow(text, state, b)
            for c, (s, e, i) in enumerate(cols):
                if state == (s, e, i) and state[1] >= b:
                    out[r, c] = 0.0
                elif e in best and e > state[1] and best[e][1:] == (s, i):
                    out[r, c] = best[e][0]
        return out

    def scan(self, text: str, chunk: int = CHUNK) -> bytes:
        """Ids of a text by matrices of its chunks, their product and a trace of each chunk."""
        chunk = max(chunk, self.m.longest)
        cuts = [*range(0, len(text), chunk), len(text)]
        matrices = [self.matrix(text, a, b) for a, b in zip(cuts, cuts[1:])] if len(cuts) > 2 else []
        state_at: list[tuple[int, int, int] | None] = [(0, 0, -1)] + [None] * (len(cuts) - 1)
        for k, (_, c) in enumerate(chain(matrices) if matrices else [], 1):
            state_at[k] = self.states(text, cuts[k])[c]
        symbols: list[int] = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            start = state_at[k]
            best = self._follow(text, start, b)
            end = state_at[k + 1][1] if matrices else len(text)
            part, e = [], end
            while e > start[1]:
                _, s, i = best[e]
                part.append(i if i < self.m.size else -1 - s)
                e = s
            symbols += reversed(part)
        return self._ids(text, symbols)


    # Section: one chunk of a giant text

    @staticmethod
    def place(piece: str, cut: int, edge: bool, look: int = LOOK) -> tuple[int, bool]:
        """Where a cut lies: at the next word start within ``look`` (one state), else where it is."""
        if edge:
            return cut, True
        p = word_start(piece, cut, cut + look)
        return (cut, False) if p < 0 else (p, True)

    def _ends(self, piece: str, a: tuple[int, bool], b: tuple[int, bool]):
        """States before and after, and the first and last word start between (-1: none)."""
        before = [(a[0], a[0], -1)] if a[1] else self.states(piece, a[0])
        after = [(b[0], b[0], -1)] if b[1] else self.states(piece, b[0])
        first = a[0] if a[1] else word_start(piece, a[0], b[0])
        last = b[0] if b[1] else last_start(piece, max(first, a[0]), b[0]) if first >= 0 else -1
        if first >= 0 and last < first:
            last = first
        return before, after, first, last

    def _reach(self, piece: str, state: tuple[int, int, int], to: list[tuple[int, int, int]], cut: int, aligned: bool) -> list[tuple[float, dict]]:
        best = self._follow(piece[:cut] if aligned else piece, state, cut)
        out = []
        for s, e, i in to:
            if aligned:
                out.append((best[cut][0] if cut in best else LOW, best))
            elif state == (s, e, i):
                out.append((0.0, best))
            else:
                out.append((best[e][0] if e in best and e > state[1] and best[e][1:] == (s, i) else LOW, best))
        return out

    def chunk_matrix(self, piece: str, a: tuple[int, bool], b: tuple[int, bool]) -> np.ndarray:
        """Max-plus matrix of the chunk between two places."""
        before, after, first, last = self._ends(piece, a, b)
        if a[1] and b[1]:
            return np.zeros((1, 1))
        if first < 0:
            return np.array([[w for w, _ in self._reach(piece, r, after, b[0], b[1])] for r in before]).reshape(len(before), len(after))
        head = np.array([0.0 if a[1] else self._reach(piece, r, [(first, first, -1)], first, True)[0][0] for r in before])
        tail = np.zeros(1) if b[1] else np.array([w for w, _ in self._reach(piece, (last, last, -1), after, b[0], False)])
        return head[:, None] + tail[None]

    def chunk_ids(self, piece: str, a: tuple[int, bool], b: tuple[int, bool], r: int, c: int) -> bytes:
        """Ids of the chunk from state r before it to state c after it, that of r left out."""
        before, after, first, last = self._ends(piece, a, b)

        def trace(state, target, cut, aligned) -> bytes:
            w, best = self._reach(piece, state, [target], cut, aligned)[0]
            part, e = [], cut if aligned else target[1]
            while e > state[1]:
                _, s, i = best[e]
                part.append(i if i < self.m.size else -1 - s)
                e = s
            return self._ids(piece, part[::-1])

        if first < 0:
            return trace(before[r], after[c], b[0], b[1])
        out = b"" if a[1] else trace(before[r], (first, first, -1), first, True)
        if last > first:
            words = units(piece[first:last])
            self.recall(set(words))
            out += b"".join(map(self.words.__getitem__, words))
        return out if b[1] else out + trace((last, last, -1), after[c], b[0], False)


def units(text: str) -> list[str]:
    """Stretches of a text that no piece enters or leaves: words without their leading space, and other runs of spaces with a word.

    The text begins with a space, and so does every stretch."""
    return [u if SPACE in u[1:] else u[1:] for u in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)]


def word_start(text: str, lo: int, hi: int) -> int:
    """First place from lo on, before hi, where a space follows another character; -1 if there is none."""
    p = text.find(SPACE, max(lo, 1), hi)
    while p >= 0 and text[p - 1] == SPACE:
        p = text.find(SPACE, p + 1, hi)
    return p


def last_start(text: str, lo: int, hi: int) -> int:
    p = text.rfind(SPACE, max(lo, 1), hi)
    while p >= 0 and text[p - 1] == SPACE:
        p = text.rfind(SPACE, max(lo, 1), p)
    return p


def decode(model: Model, ids) -> str:
    """The text of ids; the leading space that encoding adds goes."""
    raw = b"".join(map(model.text.__getitem__, ids)).decode("utf-8", "replace")
    return raw[1:] if raw[:1] == " " else raw


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder of a model file (the path must exist on every executor)."""
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            _ENCODERS[path] = Encoder(Model(f.read()))
    return _ENCODERS[path]


def _cut_up(chunk: int, look: int):
    """Chunks of texts: (k, i, n, a, b, piece); the chunk is piece[a:b], with what its cuts may need around it."""

    def run(batches):
        import pyarrow as pa

        kinds = pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()
        for batch in batches:
            for k, t in zip(batch.column(batch.schema.get_field_index("k")).to_pylist(), batch.column(batch.schema.get_field_index("text")).to_pylist()):
                text = SPACE + t.replace(" ", SPACE)
                n = -(-len(text) // chunk)
                for i in range(n):
                    lo, a, b = max(0, i * chunk - PAD), i * chunk, min(len(text), (i + 1) * chunk)
                    row = k, i, n, a - lo, b - lo, text[lo : b + look]
                    yield pa.RecordBatch.from_arrays([pa.array([v], w) for v, w in zip(row, kinds)], ["k", "i", "n", "a", "b", "piece"])

    return run


def encode_giants(texts: DataFrame, path: str = MODEL, chunk: int = CHUNK, look: int = LOOK) -> DataFrame:
    """(k, ids) of rows (k, text) with distinct keys: ids as packed 32-bit numbers, by a scan over chunks.

    The matrices of BLOCK chunks are multiplied, pair by pair, in a task of their own; the products of the
    blocks of a text fix the states at the blocks' ends, and then every block fixes those inside it.
    """
    from ..runtime import cut

    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, so that few but dear rows are not put together
    chunks = cut(texts.mapInArrow(_cut_up(chunk, look), "k long, i int, n int, a int, b int, piece string").repartition(n, "k", "i"))

    def places(enc: Encoder, r) -> tuple:
        return enc.place(r.piece, r.a, r.i == 0, look), enc.place(r.piece, r.b, r.i == r.n - 1, look)

    def matrices(batches):
        enc = _encoder(path)
        for pdf in batches:
            m = [enc.chunk_matrix(r.piece, *places(enc, r)) for r in pdf.itertuples()]
            yield pd.DataFrame({"k": pdf.k, "i": pdf.i, "block": pdf.i // BLOCK, "rows": [x.shape[0] for x in m], "cols": [x.shape[1] for x in m], "m": [x.tobytes() for x in m]})

    def unpack(pdf: pd.DataFrame) -> list[np.ndarray]:
        return [np.frombuffer(m).reshape(r, c) for m, r, c in zip(pdf.m, pdf.rows, pdf.cols)]

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        x = tree_product(unpack(pdf.sort_values("i")))
        return pd.DataFrame({"k": pdf.k[:1], "block": pdf.block[:1], "rows": [x.shape[0]], "cols": [x.shape[1]], "m": [x.tobytes()]})

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        x = chain(unpack(pdf))
        return pd.DataFrame({"k": pdf.k, "block": pdf.block, "r0": [e[0] for e in x], "c0": [e[1] for e in x]})

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x = chain(unpack(pdf), int(pdf.r0.iat[0]), int(pdf.c0.iat[0]))
        return pd.DataFrame({"k": pdf.k, "i": pdf.i, "r": [e[0] for e in x], "c": [e[1] for e in x]})

    def traces(batches):
        enc = _encoder(path)
        for pdf in batches:
            ids = [enc.chunk_ids(r.piece, *places(enc, r), r.r, r.c) for r in pdf.itertuples()]
            yield pd.DataFrame({"k": pdf.k, "i": pdf.i, "part": ids})

    got = cut(chunks.mapInPandas(thrifty(matrices), "k long, i int, block int, rows int, cols int, m binary"))
    products = got.groupBy("k", "block").applyInPandas(product, "k long, block int, rows int, cols int, m binary")
    fixed = products.groupBy("k").applyInPandas(ends, "k long, block int, r0 int, c0 int")
    chosen = got.join(fixed, ["k", "block"]).groupBy("k", "block").applyInPandas(inside, "k long, i int, r int, c int")
    parts = chunks.join(chosen, ["k", "i"]).repartition(n, "k", "i").mapInPandas(thrifty(traces), "k long, i int, part binary")
    whole = parts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("p"))

    def join(batches):
        for pdf in batches:
            yield pd.DataFrame({"k": pdf.k, "ids": [b"".join(bytes(x["part"]) for x in p) for p in pdf.p]})

    return whole.mapInPandas(join, "k long, ids binary")


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two matrices."""
    return (a[:, :, None] + b[None]).max(1)


def tree_product(ms: list[np.ndarray]) -> np.ndarray:
    """Max-plus product of matrices in order, pair by pair."""
    while len(ms) > 1:
        ms = [multiply(*ms[i : i + 2]) if i + 1 < len(ms) else ms[i] for i in range(0, len(ms), 2)]
    return ms[0]


def chain(ms: list[np.ndarray], first: int | None = None, last: int | None = None) -> list[tuple[int, int]]:
    """(row, column) of each matrix on the best way through all of them, from row ``first`` to column ``last`` if they are given."""
    start = np.zeros(ms[0].shape[0])
    if first is not None:
        start[:] = LOW
        start[first] = 0.0
    ahead = [start]
    for x in ms:
        ahead.append((ahead[-1][:, None] + x).max(0))
    at, out = int(ahead[-1].argmax()) if last is None else last, []
    for x, w in zip(reversed(ms), reversed(ahead[:-1])):
        up = int((w + x[:, at]).argmax())
        out.append((up, at))
        at = up
    return out[::-1]


def _with_ids(docs: DataFrame, path: str, keep: list[str], finish, schema: str) -> DataFrame:
    """The columns ``keep`` of docs and those that ``finish(ids of rows)`` makes: (names, Arrow arrays).

    Encoding and finishing share one worker, as each keeps the model in memory.
    """
    name, key, got = fresh(docs, "_text", "_k", "_ids")
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), schema])

    def rows(b, i, n, ids):
        import pyarrow as pa

        names, arrays = finish(ids)
        return pa.RecordBatch.from_arrays([*(b.column(c).slice(i, n) for c in keep), *arrays], [*keep, *names])

    def encode(batches):
        for b in batches:
            text = b.column(b.schema.get_field_index(name))
            for i in range(0, len(text), ROWS):
                yield rows(b, i, ROWS, _encoder(path).encode([t or "" for t in text.slice(i, ROWS).to_pylist()]))

    def attach(batches):
        for b in batches:
            ids = [np.frombuffer(x, np.int32) for x in b.column(b.schema.get_field_index(got)).to_pylist()]
            yield rows(b, 0, len(ids), ids)

    giant = F.coalesce(F.length("text") >= CHUNK, F.lit(False))
    if "text" in keep:
        name = "text"  # sent once
    small = docs.where(~giant).select(*keep, *([F.col("text").alias(name)] if name != "text" else [])).mapInArrow(thrifty(encode), fields)
    ids = encode_giants(docs.where(giant).select(F.xxhash64("text").alias("k"), "text").dropDuplicates(["k"]), path)
    ids = ids.select(F.col("k").alias(key), F.col("ids").alias(got))
    large = docs.where(giant).select(*keep, F.xxhash64("text").alias(key)).join(ids, key).mapInArrow(thrifty(attach), fields)
    return small.unionByName(large)


def encode_column(docs: DataFrame, path: str = MODEL, decoded: bool = False, keep: list[str] | None = None) -> DataFrame:
    """docs, or its columns ``keep``, with ``tokens``: array of the ids of text (null text: empty), and with ``decoded`` also decoded_hash:
    the 64-bit hash, as ``xxhash64`` of a column gives it, of the text that these ids decode to.

    Columns that bear these names are replaced, all others stay as they are.
    """
    keep = [c for c in keep or docs.columns if c != "tokens" and not (decoded and c == "decoded_hash")]

    def finish(ids):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else [], pa.int32()))]
        if decoded:
            model = _encoder(path).m
            back = [xxh64_intdigest(decode(model, x.tolist()).encode(), 42) for x in ids]
            out.append(pa.array(np.array(back, np.uint64).view(np.int64)))
        return ["tokens", "decoded_hash"][: len(out)], out

    return _with_ids(docs, path, keep, finish, "tokens array<int>" + ", decoded_hash long" * decoded)


def op4_pieces(spark: SparkSession, sf_dir: str, path: str = MODEL) -> DataFrame:
    """doc_id, n_chars (of the decoded text), n_tokens, ids_sha256 (of the ids as 32-bit little-endian) and decoded_sha256.

    The decoded text is that of the ids; it is the text itself, but for U+2581, which the format keeps for spaces.
    """

    def finish(ids):
        import pyarrow as pa

        model = _encoder(path).m
        back = [decode(model, x.tolist()) for x in ids]
        return ["n_chars", "n_tokens", "ids_sha256", "decoded_sha256"], [
            pa.array([len(t) for t in back], pa.int64()),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
        ]

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _with_ids(docs, path, ["doc_id"], finish, "n_chars long, n_tokens long, ids_sha256 string, decoded_sha256 string")
