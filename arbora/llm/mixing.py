"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a token budget. Whole epochs of a source are taken first; what then is left of its
budget is filled by weighted sampling without replacement: a document draws the exponential key
``-ln(u) / quality`` and the smallest keys of a source are taken until the budget is reached.

The prefix sum that finds the end never sorts a source: keys fall into ``BUCKETS`` ranges, sizes are
summed per (source, range) with map-side combining, and the short list of ranges is prefix-summed. Rows
in ranges before or after the one that holds the end of the budget are decided by a comparison, where
they stand; only the rows inside that one range of a source are shuffled and sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, table

#: Key ranges of a source; the one that is sorted holds about 1/2000 of the source at most, whatever the qualities.
BUCKETS = 4096
#: Sources whose plans (a row each) are broadcast; beyond that they are joined by a shuffle.
BROADCAST = 100_000
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) fixed by the id: the leading 52 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(16**13))


def quality(size: Column, n_chars: Column) -> Column:
    """Weight of a document in (0.1, 1]: short ones and those of odd word lengths count less."""
    long_enough = F.least(F.lit(1.0), size.cast("double") / F.lit(200.0))
    mean = n_chars.cast("double") / F.greatest(size, F.lit(1)).cast("double")
    usual = F.when((mean >= 3.0) & (mean <= 13.0), 1.0).otherwise(0.5)
    return F.lit(0.1) + F.lit(0.9) * long_enough * usual


def key_of(doc_id: Column, size: Column, chars: Column) -> Column:
    """The exponential key of a document."""
    return -F.log(uniform(doc_id)) / quality(size, chars)


def range_of(key: Column) -> Column:
    """The range of a key: the mean of two scales that are even for the qualities 1 and 0.1."""
    even = (F.lit(2.0) - F.exp(-key) - F.exp(-key / F.lit(10.0))) / F.lit(2.0)
    # known not to be null: else joins by it filter for that first, and work the whole key out once more for it
    return F.coalesce(F.floor(even * BUCKETS).cast("int"), F.lit(0))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) for rows (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. A target is ``level * weight``, at
    most ``MAX_EPOCHS`` sizes; the level is raised until all is shared. Only totals reach the driver,
    so the number of sources is not bounded by it.
    """
    spark = sizes.sparkSession
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_i", F.monotonically_increasing_id())
    ordered = cut(ordered)
    ahead = ordered.groupBy(F.shiftright("_i", 33).alias("_p")).count().orderBy("_p").collect()  # one row a partition
    offsets, n = [], 0
    for r in ahead:
        offsets.append((r["_p"], n))
        n += r["count"]
    if not offsets:
        return sizes.select("source", "source_size", F.lit(1).alias("weight"), F.lit(0.0).alias("target"))
    first = spark.createDataFrame(offsets, "_p long, _first long")
    s = ordered.withColumn("_p", F.shiftright("_i", 33)).join(F.broadcast(first), "_p")
    rank = F.col("_first") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    s = cut(s.select("source", "source_size", (rank % 3 + 1).cast("int").alias("weight")))
    cap = F.col("source_size") * MAX_EPOCHS
    level, full = None, -1
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("weight") >= cap
        r = s.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(over, cap).otherwise(0)).alias("capped"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open"),
            F.sum(F.when(over, 1).otherwise(0)).alias("n"),
        ).first()
        if r["n"] == full or not r["open"]:
            break
        full = r["n"]
        level = (r["total"] - r["capped"]) / r["open"]
    return s.withColumn("target", F.least(F.lit(float(level or 0.0)) * F.col("weight"), cap.cast("double")))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with size, source_size, target, copies (0 to 3) and taken.

    Size is the number of words (null text: 0). Documents of size 0 are never short of budget and
    are taken in every epoch and, in the fractional one, if their key comes before its end. Ties of
    keys (equal ids) fall to the smaller size. An empty table gives an empty result. Columns of the
    input that bear one of the new names are replaced; all others stay.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    n = dict(zip(_INNER, fresh(docs, *_INNER)))
    base = docs.select(*own, word_count(F.col("text")).alias(n["_size"]), F.coalesce(F.length("text"), F.lit(0)).alias(n["_chars"]))
    base = base.withColumn(n["_key"], key_of(F.col("doc_id"), F.col(n["_size"]), F.col(n["_chars"])))
    return _select(base.withColumn(n["_range"], range_of(F.col(n["_key"]))), own, n)


_INNER = ["_size", "_chars", "_key", "_range", "_s", "_epochs", "_left", "_end", "_first", "_before"]


def _select(base: DataFrame, keep: list[str], n: dict[str, str]) -> DataFrame:
    """``n`` gives the names of the inner columns, as they may not clash with the user's."""
    per = cut(base.groupBy("source", F.col(n["_range"]).alias("range")).agg(F.sum(n["_size"]).alias("sum")))
    goal = targets(per.groupBy("source").agg(F.sum("sum").alias("source_size")))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    w = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("ahead", F.coalesce(F.sum("sum").over(w), F.lit(0)))
    both = per.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source")))
    # the one range of a source that holds the end of its budget; all of a range before it is taken, nothing of one behind it
    holds = (F.col("ahead") <= F.col("left")) & (F.col("left") < F.col("ahead") + F.col("sum"))
    plan = both.groupBy(F.col("g.source").alias(n["_s"]), "source_size", "target", F.col("epochs").alias(n["_epochs"]), F.col("left").alias(n["_left"])).agg(
        F.coalesce(F.min(F.when(holds, F.col("range"))), F.lit(BUCKETS + 1)).alias(n["_end"]), F.min(F.when(holds, F.col("ahead"))).alias(n["_first"])
    )
    plan = cut(plan)
    plan = F.broadcast(plan) if plan.count() <= BROADCAST else plan.hint("merge")
    rows = base.join(plan, F.col("source").eqNullSafe(F.col(n["_s"])))
    at, end = F.col(n["_range"]), F.col(n["_end"])
    inside = Window.partitionBy("source").orderBy(n["_key"], "doc_id", n["_size"]).rowsBetween(Window.unboundedPreceding, -1)
    some = rows.where(at == end).withColumn(n["_before"], F.coalesce(F.sum(n["_size"]).over(inside), F.lit(0)))
    fits = 2 * (F.col(n["_first"]) + F.col(n["_before"])) + F.col(n["_size"]) <= 2 * F.col(n["_left"])

    def taken(d: DataFrame, more: Column) -> DataFrame:
        copies = (F.col(n["_epochs"]) + F.when(more & (F.col(n["_epochs"]) < MAX_EPOCHS), 1).otherwise(0)).cast("int")
        size = F.col(n["_size"])
        return d.select(*keep, size.alias("size"), "source_size", "target", copies.alias("copies"), (size * copies).alias("taken"))

    return taken(rows.where(at != end), at < end).unionByName(taken(some, fits))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    docs = table(spark, sf_dir, "documents")
    size = word_count(F.col("text"))
    base = docs.select("doc_id", "source", size.alias("_size"), F.coalesce(F.length("text"), F.lit(0)).alias("_chars"))
    base = base.withColumn("_key", key_of(F.col("doc_id"), F.col("_size"), F.col("_chars")))
    base = cut(base.withColumn("_range", range_of(F.col("_key"))))
    return _select(base, ["doc_id", "source"], {k: k for k in _INNER}).select("doc_id", "source", "size", "source_size", "target", "taken")


OP10_SQL = f"""
WITH w AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text), 0) AS chars,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
q AS (
  SELECT doc_id, source, size,
         -ln(u) / (0.1::DOUBLE + 0.9::DOUBLE * least(1.0::DOUBLE, size::DOUBLE / 200.0::DOUBLE)
           * CASE WHEN chars::DOUBLE / greatest(size, 1)::DOUBLE BETWEEN 3.0 AND 13.0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS key
  FROM w),
s AS (
  SELECT source, source_size, cap, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap FROM q GROUP BY source)),
o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY cap / weight, weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         sum(source_size) OVER () AS total, row_number() OVER (ORDER BY cap / weight, weight, source) AS n
  FROM s),
l AS (SELECT coalesce(arg_min((total - capped)::DOUBLE / open::DOUBLE, n) FILTER ((total - capped)::DOUBLE / open::DOUBLE * weight < cap), max(cap / weight)) AS level FROM o),
t AS (
  SELECT source, source_size, least(level * weight, cap::DOUBLE) AS target,
         CASE WHEN source_size > 0 THEN floor(least(level * weight, cap::DOUBLE) / source_size)::BIGINT ELSE 0 END AS epochs
  FROM s, l),
p AS (
  SELECT q.*, t.source_size, t.target, t.epochs,
         coalesce(sum(q.size) OVER (PARTITION BY q.source ORDER BY key, doc_id, q.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (size * (epochs + CASE WHEN epochs < 3 AND 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
