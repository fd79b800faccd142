"""SimHash near-duplicates through pivot distance tables.

Texts become 64-bit fingerprints of their three-word shingles. Equal fingerprints are one class.
Classes are compared by their distances to a table of reference fingerprints (pivots): by the
triangle inequality two fingerprints within ``RADIUS`` bits differ by at most ``RADIUS`` in every
coordinate of the table, so pairs whose largest coordinate difference is above it are discarded and
only the survivors are verified on all 64 bits.

Which pairs meet is decided by an equi-join, never by a cross join: of six blocks of a fingerprint
at most three hold a differing bit, so every near pair agrees on three whole blocks (about 32 bits).
A class is listed under its 20 block triples and a pair is looked at only in the first triple it
agrees on.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, cut, fresh, table, texts_of, thrifty

RADIUS = 3
#: 64 bits in six blocks: (shift, width)
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
TRIPLES = list(combinations(range(6), 3))
#: Pivots, eight distances to a packed long.
PIVOTS = 16


def pivots() -> list[int]:
    """Reference fingerprints: outputs of a fixed mixing sequence, as signed 64-bit numbers."""
    out, x = [], 0
    for _ in range(PIVOTS):
        x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        z ^= z >> 31
        out.append(z - 2**64 if z >= 2**63 else z)
    return out


def fingerprint(text: bytes) -> int:
    """The fingerprint of one UTF-8 text (see ``op6_simhash``), unsigned."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not w:
        return 0
    if len(w) < 3:
        return xxh64_intdigest(b" ".join(w), 42)
    n = len(w) - 2
    h = np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(w, w[1:], w[2:])), [42] * n), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # a very long text is counted in pieces
        bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of docs and ``fp``, the signed 64-bit fingerprint of text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    (text,) = fresh(docs.select(*keep), "_text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            i = b.schema.get_field_index(text)
            fp = np.array([fingerprint(t) for t in texts_of(b.column(i))], np.uint64).view(np.int64)
            names = [n for n in b.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(fp, pa.int64())], [*names, "fp"])

    return docs.select(*keep, F.col("text").alias(text)).mapInArrow(thrifty(run), f"{fields}, fp long")


def _block(fp: Column, i: int) -> Column:
    s, w = BLOCKS[i]
    return F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1))


def near_pairs(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b, distance), a < b, of the distinct fingerprints in ``classes.fp`` within ``radius`` <= 3 bits."""
    if radius > 3:
        raise ValueError("block triples find distances up to 3")
    fp = F.col("fp")
    packed = []
    for k in range(0, PIVOTS, 8):
        parts = [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), 8 * j) for j, p in enumerate(pivots()[k : k + 8])]
        packed.append(reduce(lambda x, y: x.bitwiseOR(y), parts).alias(f"p{k // 8}"))
    keys = [
        F.shiftleft(F.lit(t).cast("long"), 40)
        .bitwiseOR(F.shiftleft(_block(fp, i), 22))
        .bitwiseOR(F.shiftleft(_block(fp, j), 11))
        .bitwiseOR(_block(fp, k))
        for t, (i, j, k) in enumerate(TRIPLES)
    ]
    listed = classes.select("fp", *packed).select(F.explode(F.array(*keys)).alias("key"), "*")
    x, y = listed.alias("x"), listed.alias("y")
    diff = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    near = [
        F.abs(F.shiftright(F.col(f"x.p{k}"), 8 * j).bitwiseAND(F.lit(255)) - F.shiftright(F.col(f"y.p{k}"), 8 * j).bitwiseAND(F.lit(255))) <= radius
        for k in range(PIVOTS // 8)
        for j in range(8)
    ]
    survives = reduce(lambda p, q: p & q, near)
    first = F.lit(True)
    for t, triple in reversed(list(enumerate(TRIPLES))):
        earlier = [b for b in range(triple[2]) if b not in triple]
        here = reduce(lambda p, q: p & q, [_block(diff, b) != 0 for b in earlier], F.lit(True))
        first = F.when(F.shiftright(F.col("x.key"), 40) == t, here).otherwise(first)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & survives & (F.bit_count(diff) <= radius))
    return pairs.where(first).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), F.bit_count(diff).alias("distance"))


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, n_near, component_id) for rows (doc_id, fp).

    Null ids take part like others but never name a component unless all its ids are null. Rows that
    repeat count as documents of their own. Only classes of equal fingerprints are compared, so
    thousands of copies cost one comparison; every link between different fingerprints is kept.
    """
    docs = cut(docs)
    classes = cut(docs.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")))
    pairs = cut(near_pairs(classes))
    comp = components(pairs).withColumnRenamed("node", "fp")
    both = pairs.select(F.col("a").alias("fp"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("fp"), F.col("a").alias("other")))
    linked = both.join(classes.select(F.col("fp").alias("other"), "n"), "other").groupBy("fp").agg(F.sum("n").alias("linked"))
    c = classes.join(linked, "fp", "left").join(comp, "fp", "left")
    c = cut(c.select("fp", "low", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_near"), F.coalesce("component", "fp").alias("component")))
    low = c.groupBy("component").agg(F.min("low").alias("component_id"))
    c = c.join(low, "component").select("fp", "n_near", "component_id")
    return docs.join(c, "fp").select("doc_id", "fp", "n_near", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), n_near and component_id of every document.

    Texts are lower-cased in A-Z and split into words at ASCII white space; an empty or null text has
    fingerprint zero, one of fewer than three words is a single shingle.
    """
    docs = with_fingerprints(table(spark, sf_dir, "documents"), "doc_id")
    out = near_classes(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Of rows that share that id one stays. Rows without an id stay only where their whole group has none.
    Texts without a word are near duplicates of one another. Columns are those of ``docs``.
    """
    key, nth = fresh(docs, "_key", "_nth")
    keyed = docs.withColumn(key, F.xxhash64(*docs.columns))
    prints = cut(with_fingerprints(keyed.select("doc_id", "text", F.col(key).alias("k")), "doc_id", "k"))
    comp = near_classes(prints.select("doc_id", "fp")).select("fp", "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k"))
    lead = prints.join(comp, "fp").groupBy("component_id").agg(first.alias("first"))
    stay = cut(lead.select(F.col("first.k").alias(key)).distinct())
    kept = keyed.join(stay, key, "left_semi")
    w = Window.partitionBy(key).orderBy(key)
    return kept.withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).select(*docs.columns)
