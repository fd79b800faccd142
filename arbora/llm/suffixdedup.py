"""Exact substring dedup with suffix arrays.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts somewhere else. The corpus is
never sorted as one text; equal windows are brought together first:

1. Every window is assigned to its minimizer, the ``GRAM``-byte string in it with the smallest hash.
   Equal windows have equal minimizers at equal offsets, so windows that share a minimizer form runs,
   and the shuffle carries one short row a run (about one per 70 bytes) instead of one per byte.
2. A run whose whole content occurs again is a repeat as it stands. Only minimizers that have runs of
   different contents are left; these begin or end a repeated passage.
3. The contents of such a minimizer are cut to what can match, and windows that occur twice among
   them are found by a suffix array of the rest. It is built in linear time by grouping: suffixes that
   share their Lyndon prefix form groups, groups are processed in descending order with pointers to
   the previous smaller suffix, and the order inside the groups follows from one pass without
   renaming or recursion (``suffix_array``).

A minimizer with more than ``CROWD`` different contents is not gathered in one task: its windows are
hashed and counted by a distributed aggregation, which decides the same.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from .common import cut, row_key, table, texts_of

WINDOW = 400
#: Length of a minimizer, a power of two.
GRAM = 256
CROWD = 256
#: Bytes that are hashed at once in a task; positions must fit in 24 bits.
CHUNK = 2_000_000
_R = 0x9E3779B97F4A7C15
_RI = pow(_R, -1, 1 << 64)
_TOP = np.iinfo(np.uint64).max


def suffix_array(t: list[int]) -> list[int]:
    """Suffix array of a sequence of non-negative integers by linear grouping construction."""
    n = len(t)
    if n < 2:
        return list(range(n))
    t = [*(v + 1 for v in t), 0]  # a sentinel below all others
    n += 1
    # phase 1: groups, at first by first value; `start[i]` is the first place of the group of suffix i
    sa = sorted(range(n), key=t.__getitem__)
    place, start = [0] * n, [0] * n
    end = [0] * n  # by first place: the last place of a group
    s = 0
    for p, i in enumerate(sa):
        if t[i] != t[sa[s]]:
            s = p
        place[i], start[i] = p, s
        end[s] = p
    prev = [-1] * n  # nearest suffix to the left in a smaller group; set once the own group is processed
    done = [False] * n
    hi = n - 1
    while hi >= 0:
        lo = start[sa[hi]]
        members = sa[lo : hi + 1]
        for i in members:
            done[i] = True
        members.sort()
        count: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and start[p] >= lo:
                p = prev[p] if done[p] else -1
            prev[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        # suffixes that more of this group hang on are larger: move them behind their own group
        if count:
            by_count: dict[int, list[int]] = {}
            for p, c in count.items():
                by_count.setdefault(c, []).append(p)
            for c in sorted(by_count, reverse=True):
                touched: dict[int, int] = {}
                for p in by_count[c]:
                    g = start[p]
                    e = end[g]
                    q, at = sa[e], place[p]
                    sa[at], sa[e] = q, p
                    place[q], place[p] = at, e
                    end[g] = e - 1
                    touched[g] = e
                    # members of one class of a group stay together, the lowest place names the class
                for p in by_count[c]:
                    g = start[p]
                    first = touched[g]
                    start[p] = first
                    if end[first] < place[p]:
                        end[first] = place[p]
        hi = lo - 1
    # phase 2: nearest smaller suffix to the right ends the Lyndon prefix; its order orders the group
    free = list(range(n))  # by first place of a group: the next free place in it
    placed = [False] * n
    out = [-1] * n
    out[0] = n - 1
    placed[n - 1] = True
    for r in range(n):
        i = out[r] - 1
        while i >= 0 and not placed[i]:
            g = start[i]
            out[free[g]] = i
            free[g] += 1
            placed[i] = True
            i = prev[i]
    return out[1:]


def repeated_windows(texts: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each text the starts of windows that also start elsewhere in these texts, by a suffix array."""
    flat: list[int] = []
    starts = []
    for k, t in enumerate(texts):
        starts.append(len(flat))
        flat += t
        flat.append(256 + k)  # separators differ, so no match crosses them
    joined = b"\0".join(texts) + b"\0"
    ends = np.array(starts) + np.array([len(t) for t in texts])
    sa = np.array(suffix_array(flat), np.int64)
    of = np.searchsorted(np.array(starts), sa, side="right") - 1
    sa = sa[sa + window <= ends[of]].tolist()
    hit = [False] * len(flat)
    last, before = None, -1
    for i in sa:
        w = joined[i : i + window]
        if w == last:
            hit[i] = hit[before] = True
        last, before = w, i
    found = np.flatnonzero(np.array(hit, bool))
    return [found[(found >= a) & (found < b)] - a for a, b in zip(starts, ends)]


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from every position, by doubling."""
    h = x.astype(np.uint64) + np.uint64(_R)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    s = 1
    while s < GRAM:
        g = h[:-s] * np.uint64(_R)
        g += h[s:]
        g ^= g >> np.uint64(32)
        h, s = g, 2 * s
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of windows that share a minimizer, over all texts (each of at least WINDOW bytes).

    (hash of the minimizer, hash of the content, text, first window, number of windows, minimizer).
    """
    lens = np.array([len(t) for t in texts], np.int64)
    x = np.frombuffer(b"".join(texts), np.uint8)
    h = gram_hashes(x)
    m, w, nw = len(h), WINDOW - GRAM + 1, len(x) - WINDOW + 1
    a = np.concatenate([h >> np.uint64(24) << np.uint64(24) | np.arange(m, dtype=np.uint64), np.full(-m % w, _TOP)]).reshape(-1, w)
    ahead = np.minimum.accumulate(a, axis=1).ravel()
    behind = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    low = (np.minimum(behind[:nw], ahead[w - 1 : w - 1 + nw]) & np.uint64(0xFFFFFF)).astype(np.int64)
    ends = np.cumsum(lens)
    text = np.repeat(np.arange(len(lens)), lens)[:nw]
    valid = np.arange(nw) + WINDOW <= ends[text]
    change = np.ones(nw, bool)
    change[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], nw) - 1
    ok = valid[first]
    first, last = first[ok], last[ok]
    at = low[first]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(np.full(m, _R, np.uint64)))])
    back = np.cumprod(np.full(m, _RI, np.uint64))
    content = (sums[last + WINDOW - GRAM + 1] - sums[first]) * back[first]
    # the place of the minimizer in the run and the run's length belong to its identity
    content = (content ^ (at - first).astype(np.uint64) << np.uint64(50)) * np.uint64(_R) + (last - first).astype(np.uint64)
    begin = (ends - lens)[text[first]]
    return h[at], content, text[first], first - begin, last - first + 1, at - begin


def _pieces(texts: list[bytes]):
    """(number, offset, piece): texts long enough for a window, giant ones in overlapping pieces."""
    for i, t in enumerate(texts):
        for a in range(0, max(len(t) - WINDOW + 1, 0), CHUNK):
            yield i, a, t[a : a + CHUNK + WINDOW - 1]


def _runs(batches):
    import pyarrow as pa

    for b in batches:
        keys = b.column(b.schema.get_field_index("k")).to_numpy(zero_copy_only=False)
        held, size = [], 0
        for piece in [*_pieces(texts_of(b.column(b.schema.get_field_index("text")))), None]:
            if held and (piece is None or size + len(piece[2]) > 2 * CHUNK):
                g, c, t, i, n, at = runs_of([p for _, _, p in held])
                doc, off = np.array([d for d, _, _ in held]), np.array([o for _, o, _ in held])
                packed = (i + off[t]) << 24 | n << 12 | (at - i)  # n and at - i stay below WINDOW
                cols = [keys[doc[t]], g.view(np.int64), c.view(np.int64), packed]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], ["k", "g", "c", "run"])
                held, size = [], 0
            if piece is not None:
                held.append(piece)
                size += len(piece[2])


def _contents(batches):
    """The bytes of every wanted run: (g, c, kinds, at, x)."""
    for pdf in batches:
        g, c, kinds, at, x = [], [], [], [], []
        for text, want in zip(pdf.text, pdf.want):
            raw = text.encode()
            for w in want:
                g.append(w["g"])
                c.append(w["c"])
                kinds.append(w["kinds"])
                at.append(w["at"])
                x.append(raw[w["i"] : w["i"] + w["n"] + WINDOW - 1])
        yield pd.DataFrame({"g": g, "c": c, "kinds": kinds, "at": at, "x": x})


def _common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while n - lo > 1:
        m = (lo + n) // 2
        if a[lo:m] == b[lo:m]:
            lo = m
        else:
            n = m
    return lo


def _longest(parts: list[bytes]) -> list[int]:
    """For each string the longest prefix it shares with another (a neighbour in their order)."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for p, q in zip(order, order[1:]):
        n = _common_prefix(parts[p], parts[q])
        out[p], out[q] = max(out[p], n), max(out[q], n)
    return out


def resolve(contents: list[tuple[int, bytes]], window: int = WINDOW, gram: int = GRAM) -> list[np.ndarray]:
    """For each (minimizer's offset, bytes) the starts of windows with that minimizer that another holds too.

    The contents differ from one another and have the minimizer in common. Each is cut to the longest
    stretch around it that any other can share; equal cuts are one text.
    """
    right = _longest([x[at + gram :] for at, x in contents])
    left = _longest([x[:at][::-1] for at, x in contents])
    out = [np.empty(0, np.int64)] * len(contents)
    cuts: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    for j, (at, x) in enumerate(contents):
        if left[j] + gram + right[j] >= window:
            cuts.setdefault((left[j], x[at - left[j] : at + gram + right[j]]), []).append((j, at - left[j]))
    texts = list(cuts)
    found = repeated_windows([x for _, x in texts], window) if len(texts) > 1 else [np.empty(0, np.int64)] * len(texts)
    for (at, x), hit in zip(texts, found):
        owners = cuts[at, x]
        if len(owners) > 1:
            hit = np.arange(len(x) - window + 1)
        hit = hit[(hit <= at) & (hit + window >= at + gram)]  # those that hold the minimizer
        for j, off in owners:
            out[j] = hit + off
    return out


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, count)."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) != 1) + 1
    return [(int(p[0]), len(p)) for p in np.split(starts, cuts)]


def _resolve_sorted(batches):
    """(g, c, a, n): the windows of every content that another of its minimizer holds, for rows in order of g, c.

    A minimizer's contents (at most CROWD, and repetitions of them) follow one another; they are resolved
    as soon as the next one begins.
    """
    import pyarrow as pa

    now, held, rows = None, {}, ([], [], [], [])

    def close():
        if len(held) > 1:
            for c, hit in zip(held, resolve(list(held.values()))):
                for a, n in _spans(hit):
                    for col, v in zip(rows, (now, c, a, n)):
                        col.append(v)
        held.clear()

    def hand_on():
        b = pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int32())], ["g", "c", "a", "n"])
        for col in rows:
            col.clear()
        return b

    for b in batches:
        for g, c, at, x in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("g", "c", "at", "x"))):
            if g != now:
                close()
                now = g
            held[c] = (at, x)
        if len(rows[0]) > 10_000:
            yield hand_on()
    close()
    yield hand_on()


def _window_hashes(batches):
    """Hash of every window of a content that holds its minimizer: (g, c, a, h)."""
    for pdf in batches:
        for g, c, at, x in zip(pdf.g, pdf.c, pdf["at"], pdf.x):
            raw = bytes(x)
            a = np.arange(max(0, at + GRAM - WINDOW), min(at, len(raw) - WINDOW) + 1)
            h = [int.from_bytes(hashlib.blake2b(raw[i : i + WINDOW], digest_size=8).digest(), "little", signed=True) for i in a.tolist()]
            yield pd.DataFrame({"g": g, "c": c, "a": a, "h": np.array(h, np.int64), "off": at - a})


def repeats(docs: DataFrame) -> DataFrame:
    """(k, i, n): n windows from i on, in the row with key k, that also start elsewhere; spans may repeat."""
    base = docs.select(row_key().alias("k"), "text")
    long_ones = base.where(F.octet_length("text") >= WINDOW)
    # texts are hashed once; most minimizers occur once and are told apart by their counts alone, only the rest is shuffled whole
    found = runtime.cut(long_ones.mapInArrow(_runs, "k long, g long, c long, run long"))
    often = found.groupBy("g").agg(F.count("*").alias("total")).where("total > 1").select("g")
    runs = cut(found.join(often, "g", "left_semi"))
    kinds = runs.groupBy("g", "c").agg(F.count("*").alias("copies"), F.min(F.struct("k", "run")).alias("one"))
    groups = kinds.groupBy("g").agg(F.count("*").alias("kinds"))
    kinds = cut(kinds.join(groups, "g").select("g", "c", "copies", "kinds", "one"))
    # contents of runs that share a minimizer but differ: one representative of each
    mixed = kinds.where("kinds > 1").withColumn("run", F.col("one.run"))
    part = lambda s, w: F.shiftright("run", s).bitwiseAND(F.lit((1 << w) - 1)).cast("int")
    w = F.struct("g", "c", "kinds", F.shiftright("run", 24).cast("int").alias("i"), part(12, 12).alias("n"), part(0, 12).alias("at"))
    want = mixed.select("one.k", w.alias("w")).groupBy("k").agg(F.collect_list("w").alias("want"))
    # rows that repeat give their contents again; those count once below
    contents = want.join(long_ones, "k").select("text", "want").mapInPandas(_contents, "g long, c long, kinds long, at int, x binary")
    contents = cut(contents)
    few = contents.where(F.col("kinds") <= CROWD).repartition("g").sortWithinPartitions("g", "c").mapInArrow(_resolve_sorted, "g long, c long, a int, n int")
    hashed = contents.where(F.col("kinds") > CROWD).dropDuplicates(["g", "c"]).mapInPandas(_window_hashes, "g long, c long, a int, h long, off int")
    twice = hashed.groupBy("g", "off", "h").agg(F.count("*").alias("m")).where("m > 1").select("g", "off", "h")
    many = hashed.join(twice, ["g", "off", "h"]).select("g", "c", "a", F.lit(1).alias("n"))
    # a content that occurs again is a repeat as a whole
    whole = kinds.where("copies > 1").select("g", "c", F.lit(0).alias("a"), F.lit(-1).alias("n"))
    parts = few.union(many).join(whole, ["g", "c"], "left_anti").union(whole)
    n = F.when(F.col("m") < 0, part(12, 12)).otherwise(F.col("m"))
    return runs.join(parts.withColumnRenamed("n", "m"), ["g", "c"]).select("k", (F.shiftright("run", 24).cast("int") + F.col("a")).alias("i"), n.alias("n"))


def removed_bytes(i: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (first, end) of bytes covered by windows i .. i + n - 1."""
    order = np.argsort(i, kind="stable")
    a, b = i[order], np.maximum.accumulate(i[order] + n[order] - 1 + WINDOW)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    return list(zip(a[first].tolist(), b[last].tolist()))


def dedup_substrings(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes of every row; with ``texts`` also kept, the bytes left.

    Texts count as UTF-8 bytes, null as empty. Matches never cross rows; a string that starts twice in
    one row is a repeat as well. Rows that repeat exactly are repeats of one another and lose the same.
    """
    kind = dict(docs.dtypes)["doc_id"]
    spans = repeats(docs).groupBy("k").agg(F.collect_list(F.struct("i", "n")).alias("spans"))
    keyed = docs.select("doc_id", "text", row_key().alias("k")).join(spans, "k", "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"] + ["kept"] * texts

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            lists = b.column(b.schema.get_field_index("spans"))
            for raw, x in zip(texts_of(b.column(b.schema.get_field_index("text"))), lists):
                gone = []
                if x.is_valid:
                    f = x.values
                    gone = removed_bytes(f.field("i").to_numpy().astype(np.int64), f.field("n").to_numpy().astype(np.int64))
                kept, p = [], 0
                for s, e in gone:
                    kept.append(raw[p:s])
                    p = e
                rest = b"".join([*kept, raw[p:]])
                for c, v in zip(cols, (len(raw), len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), len(rest), rest)):
                    c.append(v)
            arrays = [b.column(b.schema.get_field_index("doc_id"))]
            arrays += [pa.array(c, t) for c, t in zip(cols[: 5 + texts], [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.binary()])]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return keyed.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes long" + ", kept binary" * texts)


def op8_suffixdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes of every document."""
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Counts every 400-byte string of every text; what is kept is cut out of the text's hexadecimal form.
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(hex(encode(text)), '') AS h, encode(text) AS x FROM documents),
w AS (SELECT r, i, md5(x[i + 1 : i + {WINDOW}]) AS m FROM (SELECT r, x, unnest(range(len(h) // 2 - {WINDOW - 1})) AS i FROM d WHERE len(h) >= {2 * WINDOW})),
hit AS (SELECT r, i FROM w SEMI JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) q USING (m)),
isle AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, (i - lag(i, 1, -{2 * WINDOW}) OVER (PARTITION BY r ORDER BY i) > {WINDOW})::INT AS fresh FROM hit)),
span AS (SELECT r, g, min(i) AS a, max(i) + {WINDOW} AS e FROM isle GROUP BY r, g),
gap AS (SELECT r, a, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY a) AS p FROM span),
rest AS (
  SELECT d.r, any_value(doc_id) AS doc_id, any_value(h) AS h, count(a) AS n_spans, coalesce(sum(e - a), 0) AS n_removed,
         coalesce(string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a), '') || substr(any_value(h), 2 * coalesce(max(e), 0) + 1) AS kept
  FROM d LEFT JOIN gap ON gap.r = d.r GROUP BY d.r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256, (len(kept) // 2)::BIGINT AS kept_bytes FROM rest
"""
