"""Line dedup by pairwise alignment.

Documents that share a line are found through hashes of lines; a pair of them is aligned by patience
diff over the sequences of line hashes, and blocks of aligned lines are deleted from the later one.

* Pairs: a document whose lines equal those of an earlier one goes as a whole. Of the others, each later
  one is first paired with the first holder of each run of lines (a star, not all pairs). What it then
  keeps of a run that other earlier documents hold is tried with the next holders, more in each round,
  until no earlier holder of a kept run is left. So the result is that of all pairs. A later document
  and an earlier one form one pair in a round however many lines they share.
* Rare hashes find the pairs: a line of ``min_words`` words or more is hashed alone, a shorter one
  together with the lines after it, and with those before it, until the run has so many words. Every
  line with words of a block that may be deleted is in such a run of the block, while common short lines
  alone never pair documents. No hash is left out because many documents hold it.
* Alignment: lines that occur once in either document are anchors, their longest increasing chain
  is kept and grown to both sides over equal lines; the gaps are aligned in the same way, from the first
  common line on where none occurs once.
* A block is deleted if it has at least ``min_words`` words (MIN_WORDS, 25, where nothing else is said; with 1
  every aligned line that has a word goes). A document with fewer words is deleted only as a whole, if an
  earlier one has the same lines.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, table, thrifty

MIN_WORDS = 25
#: Base of the polynomial hash of a run of lines, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned blocks (start in a, start in b, length) of two sequences, in order, by patience diff."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {h: j for j, h in enumerate(b[b0:b1], b0) if cb[h] == 1 and ca[h] == 1}
        pairs = [(i, where[a[i]]) for i in range(a0, a1) if a[i] in where]
        chain = _increasing(pairs)
        if not chain:
            # no unique line: common runs anchor each other from the front; then the rest is looked at anew, at
            # least half as long, so that a text that repeats itself takes n log n steps
            common = ca.keys() & cb.keys()
            places: dict[int, list[int]] = {}
            for j in range(b0, b1):
                if b[j] in common:
                    places.setdefault(b[j], []).append(j)
            i, j, stop = a0, b0, a0 + max(16, (a1 - a0) // 2) if common else a1
            while i < min(stop, a1):
                at = places.get(a[i], ())
                k = bisect_left(at, j)
                if k == len(at):
                    i += 1
                    continue
                j = at[k]
                while i < a1 and j < b1 and a[i] == b[j]:
                    out.append((i, j))
                    i, j = i + 1, j + 1
            if common:
                todo.append((i, a1, j, b1))
            continue
        pa, pb = a0, b0
        for i, j in chain:
            if i < pa or j < pb:
                continue  # taken by the growth of the anchor before
            s, t = i, j
            while s > pa and t > pb and a[s - 1] == b[t - 1]:
                s, t = s - 1, t - 1
            todo.append((pa, s, pb, t))
            e, f = i, j
            while e < a1 and f < b1 and a[e] == b[f]:
                e, f = e + 1, f + 1
            out += [(s + k, t + k) for k in range(e - s)]
            pa, pb = e, f
        todo.append((pa, a1, pb, b1))
    out.sort()
    blocks: list[tuple[int, int, int]] = []
    for i, j in out:
        if blocks and (k := blocks[-1])[0] + k[2] == i and k[1] + k[2] == j:
            blocks[-1] = (k[0], k[1], k[2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain that rises in both coordinates; pairs come in order of the first."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back[k] = at[p - 1] if p else -1
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned_lines(first: list[int], later: list[int], words: list[int], least: int = MIN_WORDS) -> list[int]:
    """Positions of lines of ``later`` in deleted blocks of its alignment with ``first``."""
    gone: list[int] = []
    for _, j, n in patience(first, later):
        if sum(words[j : j + n]) >= max(least, 1):
            gone += range(j, j + n)
    return gone


def _hashes(blob: bytes) -> list[int]:
    return np.frombuffer(blob, np.int64).tolist()


def _align(least: int):
    def run(batches):
        for pdf in batches:
            gone = [np.array(aligned_lines(_hashes(a), _hashes(b), np.frombuffer(w, np.int32).tolist(), least), np.int32).tobytes() for a, b, w in zip(pdf.first_lines, pdf.later_lines, pdf.later_words)]
            yield pd.DataFrame({"k": pdf.later, "gone": gone})

    return run


def _pack(batches):
    """Lists of line hashes and word counts as bytes, half the size of lists and read without a copy."""
    import pyarrow as pa

    for b in batches:
        h = [np.array(x, np.int64).tobytes() for x in b.column("h").to_pylist()]
        w = [np.array(x, np.int32).tobytes() for x in b.column("w").to_pylist()]
        n = pa.array([sum(x) for x in b.column("w").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), pa.array(h, pa.binary()), pa.array(w, pa.binary()), n], ["doc_id", "k", "lines", "words", "n_words"])


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, k, lines, words, n_words) of every document: packed line hashes and words of each line, and words in all."""
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    # a line without a word is hash 0, whatever white space it has
    h = F.transform(split, lambda x: F.when(x.rlike("[^\\x20\\x09-\\x0D]"), F.xxhash64(x)).otherwise(F.lit(0).cast("long")))
    w = F.transform(split, lambda x: F.regexp_count(x, F.lit(WORD)).cast("int"))
    base = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), h.alias("h"), w.alias("w"))
    return base.mapInArrow(thrifty(_pack), f"doc_id {dict(docs.dtypes)['doc_id']}, k long, lines binary, words binary, n_words long")


def runs(h: np.ndarray, words: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the shortest runs of lines with ``least`` words that begin or end at each line."""
    n = len(h)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    if total[-1] < least:
        none = np.empty(0, np.int64)
        return none, none, none
    spoken = np.arange(n)[words > 0]
    start = spoken[total[spoken] + least <= total[-1]]
    end = np.searchsorted(total, total[start] + least)
    last = spoken[total[spoken + 1] >= least] + 1
    first = np.searchsorted(total, total[last] - least, side="right") - 1
    start, end = np.unique(np.stack([np.concatenate([start, first]), np.concatenate([end, last])]), axis=1)
    x = h.view(np.uint64) ^ (h.view(np.uint64) >> np.uint64(31))
    power = np.cumprod(np.full(n, _BASE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power)])
    back = np.cumprod(np.full(n, _INVERSE, np.uint64))
    return ((sums[end] - sums[start]) * back[start]).view(np.int64), start, end


def _occurrences(least: int):
    """Hashes of the runs of each document; with a column gone, only of runs that keep a line with words."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lines, words = b.column("lines").to_pylist(), b.column("words").to_pylist()
            lost = b.column("gone").to_pylist() if "gone" in b.schema.names else [None] * len(lines)
            found = []
            for x, w, g in zip(lines, words, lost):
                w = np.frombuffer(w, np.int32)
                h, start, end = runs(np.frombuffer(x, np.int64), w, least)
                if g is not None:
                    kept = w > 0
                    if g:
                        kept[_union_positions(g)] = False
                    many = np.concatenate([[0], np.cumsum(kept)])
                    h = h[many[end] > many[start]]
                found.append(np.unique(h))
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            flat = np.concatenate(found) if len(found) else np.empty(0, np.int64)
            take = pa.array(at)
            rest = [c for c in ("doc_id", "k") if c in b.schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(flat), *(b.column(c).take(take) for c in rest)], ["h", *rest])

    return run


def _all_lines(batches):
    for pdf in batches:
        yield pd.DataFrame({"k": pdf.k, "gone": [np.arange(len(x) // 8, dtype=np.int32).tobytes() for x in pdf.lines]})


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, gone): packed positions, from 0, of lines that are deleted from the row with key k, one row a pair.

    The earlier of two documents is the one with the smaller id (null ids last; equal ids by the hash
    of the row). A row that repeats exactly is one document here, so both its copies are treated alike
    with regard to others; of the two themselves neither is deleted.
    """
    packed = cut(lines_of(docs).dropDuplicates(["k"]))
    kind = dict(docs.dtypes)["doc_id"]
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("k").alias("k"))
    # documents with the same lines: all but the first go
    packed = packed.withColumn("c", F.xxhash64("lines"))
    firsts = packed.where("n_words > 0").groupBy("c").agg(F.min(order).alias("first")).select("c", F.col("first.k").alias("fk"))
    marked = cut(packed.join(firsts.hint("merge"), "c"))
    copies = marked.where("k <> fk").select("k", "lines").mapInPandas(_all_lines, "k long, gone binary")
    side = marked.where("k = fk").select("doc_id", "k", "lines", "words")

    occ = side.mapInArrow(thrifty(_occurrences(max(min_words, 1))), f"h long, doc_id {kind}, k long")
    holders = Window.partitionBy("h")
    ranked = occ.withColumn("rank", F.row_number().over(holders.orderBy(order))).withColumn("hi", F.max("k").over(holders)).withColumn("lo", F.min("k").over(holders))
    ranked = cut(ranked.where("hi <> lo").select("h", "k", "rank"))
    open_runs, low, high, gone = ranked.where("rank > 1"), 1, 2, [None]
    while True:
        # the holders of ranks from low to high that are earlier; those of lower ranks were tried before
        earlier = ranked.where((F.col("rank") >= low) & (F.col("rank") < high)).select("h", F.col("k").alias("earlier"), F.col("rank").alias("of"))
        pairs = open_runs.join(earlier.hint("merge"), "h").where("of < rank").select("earlier", F.col("k").alias("later")).distinct()
        both = pairs.join(side.select(F.col("k").alias("later"), F.col("lines").alias("later_lines"), F.col("words").alias("later_words")).hint("merge"), "later")
        both = both.join(side.select(F.col("k").alias("earlier"), F.col("lines").alias("first_lines")).hint("merge"), "earlier")
        got = both.select("later", "first_lines", "later_lines", "later_words").mapInPandas(thrifty(_align(min_words)), "k long, gone binary")
        gone.append(cut(got.where(F.length("gone") > 0)))
        low, high = high, high * 4
        left = open_runs.where(F.col("rank") > low)
        so_far = gone[1]
        for g in gone[2:]:
            so_far = so_far.unionByName(g)
        lost = so_far.groupBy("k").agg(F.collect_list("gone").alias("gone"))
        todo = side.join(left.select("k").distinct().hint("merge"), "k").join(lost.hint("merge"), "k", "left")
        todo = todo.select("k", "lines", "words", F.coalesce("gone", F.array().cast("array<binary>")).alias("gone"))
        kept = todo.mapInArrow(thrifty(_occurrences(max(min_words, 1))), "h long, k long")
        open_runs = cut(left.join(kept.hint("merge"), ["h", "k"]))
        if open_runs.isEmpty():
            return so_far.unionByName(copies)


def _union_positions(blobs: list[bytes]) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(x, np.int32) for x in blobs]))


def dedup_lines(docs: DataFrame, digest: bool = False, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with aligned common blocks of ``min_words`` words or more deleted from the later document of every pair.

    ``text`` loses whole lines with their line feeds; a document of which every line goes stays with an
    empty text, a null text stays null. With ``digest`` two columns are added: n_lines and n_removed,
    which replace columns of these names. Other columns stay as they are, whatever their names.
    """
    key, lists, flags = fresh(docs, "_row", "_gone", "_lost")
    gone = deletions(docs, min_words).groupBy("k").agg(F.collect_list("gone").alias(lists)).withColumnRenamed("k", key)
    both = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(gone, key, "left")

    @F.pandas_udf("array<boolean>")
    def removed(blobs: pd.Series, n: pd.Series) -> pd.Series:
        """For each line of a document that loses any, whether it goes."""

        def mark(x, size):
            if x is None:
                return None
            out = np.zeros(size, bool)
            out[_union_positions(list(x))] = True
            return out

        return pd.Series([mark(x, size) for x, size in zip(blobs, n)], dtype=object)

    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    both = both.withColumn(flags, removed(lists, F.size(split)))
    kept = F.concat_ws("\n", F.filter(split, lambda x, i: ~F.get(F.col(flags), i)))
    new = F.when(F.col("text").isNull() | F.col(flags).isNull(), F.col("text")).otherwise(kept)
    names = [new.alias("text") if c == "text" else F.col(c) for c in docs.columns if not (digest and c in ("n_lines", "n_removed"))]
    if digest:
        lost = F.coalesce(F.size(F.filter(flags, lambda x: x)), F.lit(0))
        names += [F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).alias("n_lines"), F.when(F.col(flags).isNull(), 0).otherwise(lost).alias("n_removed")]
    return both.select(*names)


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_bytes and sha256 of the text that is kept, for every document."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.octet_length(text).cast("long").alias("kept_bytes"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
