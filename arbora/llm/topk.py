"""Exact top-k inner products by three-phase uniform threshold.

Vectors are cut into ``LISTS`` runs of dimensions; each run gives one list of partial scores per query
and block of candidates.

1. Gather: a block takes of one list, that in which the query is longest, the ``k`` best entries, scores
   these candidates in full and sends their ``k`` best scores. The k-th best over all blocks is a score that
   k candidates really reach, so it is a safe cutoff for the query.
2. Collect: the cutoff goes back to every block. The uniform threshold is its share cutoff / LISTS a
   list: a candidate that reaches the cutoff has the seen lists above their shares by what the unseen
   ones fall short of theirs, and these give at most the product of the lengths there. So after half of
   the lists only candidates are collected whose seen sum and that product reach the cutoff.
3. Resolve: what the other lists add is worked out for the collected ones alone, and those at or above
   the cutoff are ranked over all blocks.

Every candidate is shuffled once, to its block of about ``ROW_BLOCK`` rows; queries are sent to every block
and stream past it, ``QUERY_BLOCK`` at a time, so a task holds one block and one strip.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

LISTS = 4
ROW_BLOCK = 16384
#: Queries scored together inside a task.
QUERY_BLOCK = 128


def quantised(df: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; rows with a null vector or a null or non-finite component go."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    ok = x.isNotNull() & F.coalesce(~bad, F.lit(False))
    return df.where(ok & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long")).alias("v"))


def _pack(batches):
    """Vectors as bytes: 2 or, where a component needs it, 8 to a component, after one byte that tells which."""
    import pyarrow as pa

    for b in batches:
        v = b.column(b.schema.get_field_index("v"))
        flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))])
        out = []
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
            x = flat[i:j]
            small = not len(x) or (x.min() >= -(2**15) and x.max() < 2**15)
            out.append(b"\x02" + x.astype("<i2").tobytes() if small else b"\x08" + x.astype("<i8").tobytes())
        rest = [n for n in b.schema.names if n != "v"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), pa.array(out, pa.binary())], [*rest, "x"])


def _matrix(blobs: list[bytes], dims: int = 0) -> np.ndarray:
    """Rows of packed vectors, padded with zeros to the longest, or to ``dims``."""
    if not blobs:
        return np.zeros((0, dims), np.int64)
    if dims * 2 + 1 <= len(blobs[0]) and all(len(x) == len(blobs[0]) and x[0] == 2 for x in blobs):
        return np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)[:, 1:].copy().view("<i2").astype(np.int64)
    rows = [np.frombuffer(x, "<i2" if x[0] == 2 else "<i8", offset=1) for x in blobs]
    out = np.zeros((len(rows), max(dims, *map(len, rows))), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


class Block:
    """A block of candidates; ``scored`` counts the partial scores that it worked out."""

    def __init__(self, ids: np.ndarray, blobs: list[bytes], k: int):
        self.ids, self.rows, self.k, self.scored = ids, _matrix(blobs), k, 0
        dims = self.rows.shape[1]
        self.cuts = np.array_split(np.arange(dims), LISTS)
        square = self.rows.astype(np.float64) ** 2
        lengths = np.stack([square[:, d].sum(1) for d in self.cuts])
        self.rest = np.sqrt(lengths[LISTS // 2 :].sum(0))
        self.top = float(np.abs(self.rows).max(initial=0))
        self.kinds: dict = {}

    def _lists(self, q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], type]:
        """(queries, candidates of each list, kind of number in which all scores are exact)."""
        dims = self.rows.shape[1]
        q = q[:, :dims] if q.shape[1] >= dims else np.pad(q, ((0, 0), (0, dims - q.shape[1])))
        top = float(np.abs(q).max(initial=0)) * self.top * max(dims, 1)
        kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
        if kind not in self.kinds:
            self.kinds[kind] = [np.ascontiguousarray(self.rows[:, d].T.astype(kind)) for d in self.cuts]
        return q.astype(kind), self.kinds[kind], kind

    def _rows(self, kind: type) -> np.ndarray:
        if (kind, "rows") not in self.kinds:
            self.kinds[kind, "rows"] = self.rows.astype(kind)
        return self.kinds[kind, "rows"]

    def gather(self, qids: np.ndarray, q: np.ndarray) -> list[list[int]]:
        """The k best scores of each query among the best entries of the list in which it is longest."""
        q, lists, kind = self._lists(q)
        telling = np.stack([(q[:, d].astype(np.float64) ** 2).sum(1) for d in self.cuts]).argmax(0)
        most = min(self.k + 1, len(self.ids))  # one more: the query itself may be among them
        best = np.zeros((len(q), most), np.int64)
        for n, (d, c) in enumerate(zip(self.cuts, lists)):
            at = np.flatnonzero(telling == n)
            if len(at):
                part = q[at][:, d] @ c
                self.scored += part.size
                best[at] = np.argpartition(-part, most - 1, axis=1)[:, :most] if most < len(self.ids) else np.arange(len(self.ids))
        s = (self._rows(kind)[best] * q[:, None]).sum(2, dtype=kind)
        self.scored += (LISTS - 1) * s.size
        other = self.ids[best] != qids[:, None]
        return [np.sort(x[ok])[::-1][: self.k].astype(np.int64).tolist() for x, ok in zip(s, other)]

    def collect(self, qids: np.ndarray, q: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of all that reach the cutoff (nan: all do), the k best of each query."""
        q, lists, kind = self._lists(q)
        half = LISTS // 2
        seen = sum(q[:, d] @ c for d, c in zip(self.cuts[:half], lists))
        self.scored += half * seen.size
        least = np.where(np.isnan(cutoff), -np.inf, cutoff)
        late = np.concatenate(self.cuts[half:])
        length = np.sqrt((q[:, late].astype(np.float64) ** 2).sum(1)) * (1 + 1e-6)
        # a little room for rounding: bounds may be too high, never too low
        need = least[:, None] - length[:, None] * self.rest[None] * (1 + 1e-6) - 1e-3 * (1 + np.abs(np.where(np.isinf(least), 0, least)))[:, None]
        i, j = np.nonzero(seen >= need)
        if len(i) * 8 > seen.size:  # many are left: whole lists are cheaper than rows of them
            score = (seen + sum(q[:, d] @ c for d, c in zip(self.cuts[half:], lists[half:])))[i, j]
            self.scored += (LISTS - half) * seen.size
        else:
            rest = self._rows(kind)[:, late]
            score = seen[i, j]
            for a in range(0, len(i), 1 << 16):
                part = slice(a, a + (1 << 16))
                score[part] += (q[:, late][i[part]] * rest[j[part]]).sum(1, dtype=kind)
            self.scored += (LISTS - half) * len(i)
        ok = (score >= least[i]) & (self.ids[j] != qids[i])
        i, ids, score = i[ok], self.ids[j[ok]], score[ok].astype(np.int64)
        order = np.lexsort((ids, -score, i))
        i, ids, score = i[order], ids[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        first = place < self.k
        return qids[i[first]], ids[first], score[first]


def _stream(k: int, handle):
    """Runs ``handle(block, query ids, queries, cutoffs)`` over rows in order of (rb, kind): a block's candidates, then queries."""

    def run(batches):
        now, held, block = None, [], None
        for b in batches:
            rb, kind, ids = (b.column(b.schema.get_field_index(n)).to_numpy() for n in ("rb", "kind", "vec_id"))
            x = b.column(b.schema.get_field_index("x"))
            cutoff = b.column(b.schema.get_field_index("cutoff")).to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.flatnonzero((np.diff(rb) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *ends.tolist()], [*ends.tolist(), len(rb)]):
                if i == j:
                    continue
                if rb[i] != now:
                    now, held, block = rb[i], [], None
                if kind[i] == 0:
                    held.append((ids[i:j], x.slice(i, j - i).to_pylist()))
                    continue
                if not held:
                    continue  # a block without candidates
                if block is None:
                    block = Block(np.concatenate([h[0] for h in held]), [v for h in held for v in h[1]], k)
                for a in range(i, j, QUERY_BLOCK):
                    e = min(a + QUERY_BLOCK, j)
                    yield handle(block, ids[a:e], _matrix(x.slice(a, e - a).to_pylist()), cutoff[a:e])

    return run


def _gathered(block: Block, qids, q, _):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(qids), pa.array(block.gather(qids, q), pa.list_(pa.int64()))], ["query_id", "scores"])


def _collected(block: Block, qids, q, cutoff):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in block.collect(qids, q, cutoff)], ["query_id", "vec_id", "score"])


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query, ties to the smaller id.

    Both sides are (vec_id, v array<long>). A query never meets a candidate of its own id; vectors of
    unequal length count as padded with zeros; repeated rows are candidates of their own, a query that
    repeats is answered once, by its first row in order of the components. With fewer than k candidates
    all are returned.
    """
    spark = rows.sparkSession
    n_rows = rows.count()
    # blocks for all cores, but not below 2048 rows
    blocks = max(1, -(-n_rows // ROW_BLOCK), min(spark.sparkContext.defaultParallelism, n_rows // 2048))
    c = rows.select(F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("double").alias("cutoff"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("rb"))
    q = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    pack = "kind int, vec_id long, cutoff double, rb int, x binary"
    candidates = cut(c.mapInArrow(_pack, pack))
    asked = cut(q.select(F.lit(1).alias("kind"), "vec_id", "v", F.lit(None).cast("double").alias("cutoff"), F.lit(0).alias("rb")).mapInArrow(_pack, pack))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb")

    def meet(q: DataFrame) -> DataFrame:
        sent = q.select("kind", "vec_id", "cutoff", everywhere, "x")
        return candidates.unionByName(sent).repartitionById(blocks, F.col("rb")).sortWithinPartitions("rb", "kind")

    lists = meet(asked).mapInArrow(_stream(k, _gathered), "query_id long, scores array<long>")
    # the k best of a query are kept before and after its lists meet, so no task gathers them all
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    best = lists.select("query_id", F.explode("scores").alias("score")).withColumn("place", place).where(F.col("place") <= k)
    found = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    cutoff = found.where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), F.col("kth").cast("double").alias("cutoff"))
    told = cut(asked.drop("cutoff").join(cutoff, "vec_id", "left"))
    kept = meet(told).mapInArrow(_stream(k, _collected), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best of all other vectors for every vec_id divisible by 20."""
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where("vec_id % 20 = 0"), rows, 20)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 20
"""
