"""URL filter: rules first, then the ratio of two character language models.

Rules name a host and a path prefix; the longest that fits decides. Other URLs are decided by two
variable-order Markov models of characters, one of accepted and one of rejected URLs, both learned
from all URLs that the rules decide. A context that was seen rarely leans on the next shorter one
(Witten-Bell smoothing). The score is the difference of log-likelihoods per character; the threshold
is calibrated on a fold of the labelled URLs that the models did not see.

Contexts are counted, and the fold is scored and ordered, where the URLs are; the driver gets at most
``4 * SIZE`` counts and a few rows a partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import runtime
from .common import cut, fresh, table

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Longest context, in characters; the tables have SIZE entries.
ORDER = 3
SYMBOLS = 40
SIZE = SYMBOLS ** (ORDER + 1)


def _symbol_table() -> np.ndarray:
    """Byte -> symbol: letters without case, digits in one class, the usual marks, all else together."""
    t = np.full(256, 39, np.int64)
    for i in range(26):
        t[97 + i] = t[65 + i] = i + 1
    for d in b"0123456789":
        t[d] = 27
    for i, c in enumerate(b"/.-_:?#=&%+"):
        t[c] = 28 + i
    return t


TABLE = _symbol_table()


def host_path(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: both empty for null or where there is no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, say in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _symbols(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all URLs, each led by ORDER marks of the start, and the number of symbols of each."""
    raw = [u.encode() for u in urls]
    lens = np.array([len(r) for r in raw], np.int64)
    flat = TABLE[np.frombuffer(b"".join(raw), np.uint8)]
    out = np.zeros(int(lens.sum()) + ORDER * len(raw), np.int64)
    shift = np.repeat(ORDER * np.arange(1, len(raw) + 1), lens)
    out[np.arange(len(flat)) + shift] = flat
    return out, lens


def _positions(lens: np.ndarray) -> np.ndarray:
    return np.arange(int(lens.sum())) + np.repeat(ORDER * np.arange(1, len(lens) + 1), lens)


def _codes(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code of every symbol with the ORDER ones before it, below SIZE, and the number of symbols of each URL."""
    sym, lens = _symbols(urls)
    at = _positions(lens)
    code = np.zeros(len(at), np.int64)
    for back in range(ORDER, -1, -1):
        code = code * SYMBOLS + sym[at - back]
    return code, lens


class Markov:
    """Counts of contexts up to ORDER and their Witten-Bell mixture, as one dense table of log-probabilities.

    Learns from URLs, or from how often each code (see ``_codes``) stands in them; shorter contexts are sums of those.
    """

    def __init__(self, learned: list[str] | np.ndarray):
        n = learned if isinstance(learned, np.ndarray) else np.bincount(_codes(learned)[0], minlength=SIZE)
        longest = n.reshape((SYMBOLS,) * (ORDER + 1)).astype(np.float64)
        prob = np.full(SYMBOLS, 1 / SYMBOLS)
        for order in range(ORDER + 1):
            n = longest.sum(axis=tuple(range(ORDER - order))).reshape(-1, SYMBOLS)
            total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
            shorter = np.tile(prob.reshape(-1, SYMBOLS), (SYMBOLS if order else 1, 1))
            prob = np.where(total > 0, (n + kinds * shorter) / np.maximum(total + kinds, 1), shorter)
        self.log = np.log(prob).ravel()


def score_urls(urls: list[str], ratio: np.ndarray) -> np.ndarray:
    """Mean log-likelihood difference (accepted minus rejected) a character; 0 for empty ones. No URL's score depends on the others."""
    code, lens = _codes(urls)
    out, full = np.zeros(len(lens)), lens > 0
    if full.any():
        out[full] = np.add.reduceat(ratio[code], (np.cumsum(lens) - lens)[full]) / lens[full]
    return out


def held_back(url: Column) -> Column:
    """Whether a labelled URL calibrates the threshold: about every fifth, by its MD5."""
    return F.conv(F.substring(F.md5(url), 1, 8), 16, 10).cast("long") % 5 == 0


def _counts(batches):
    """(code, n) of the URLs of every batch; the code of a kind k of URLs is raised by k * SIZE."""
    import pyarrow as pa

    for b in batches:
        code, lens = _codes(b.column(b.schema.get_field_index("u")).to_pylist())
        kind = b.column(b.schema.get_field_index("kind")).to_numpy(zero_copy_only=False).astype(np.int64)
        code, n = np.unique(code + SIZE * np.repeat(kind, lens), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])


def best_threshold(scores: DataFrame) -> float:
    """The threshold with the best mean of both classes' accuracies; ties: the middle of the best intervals.

    ``scores`` has s, good and bad: a score, each once, and how many of both classes bear it. Scores are
    ordered by ranges and counted up within each; one row a range reaches the driver.
    """
    spark = scores.sparkSession
    ordered = cut(scores.orderBy("s").withColumn("p", F.spark_partition_id()))
    ranges = ordered.groupBy("p").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("s").alias("s")).orderBy("p").collect()
    heads, good, bad = [], 0, 0
    for r, behind in zip(ranges, [*ranges[1:], None]):
        heads.append((r["p"], good, bad, behind and behind["s"]))
        good, bad = good + r["good"], bad + r["bad"]
    first = spark.createDataFrame(heads, "p int, g long, b long, behind double")
    inside = Window.partitionBy("p").orderBy("s")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    x = ordered.join(F.broadcast(first), "p")
    g, b = F.col("g") + F.sum("good").over(upto), F.col("b") + F.sum("bad").over(upto)
    behind = F.coalesce(F.lead("s").over(inside), F.col("behind"))
    # between a score and the next one, or beyond the last; and one below all
    edges = x.select("p", F.coalesce((F.col("s") + behind) / 2, F.col("s") + 1).alias("e"), ((F.lit(good) - g) / F.lit(good) + b / F.lit(bad)).alias("right"))
    edges = cut(edges.unionByName(spark.createDataFrame([(-1, ranges[0]["s"] - 1, 1.0)], "p int, e double, right double")))
    best = edges.where(F.col("right") >= edges.agg(F.max("right")).first()[0] - 1e-12)
    per = best.groupBy("p").count().orderBy("p").collect()
    left = sum(r["count"] for r in per) // 2
    for r in per:
        if left < r["count"]:
            break
        left -= r["count"]
    place = F.row_number().over(Window.partitionBy("p").orderBy("e"))
    return best.where(F.col("p") == r["p"]).withColumn("n", place).where(F.col("n") == left + 1).first()["e"]


def fit(seen: DataFrame) -> tuple[np.ndarray, float]:
    """(table of log ratios, threshold) from all labelled URLs, each once: u and say.

    URLs that are held back are kept from a first pair of models and used to calibrate the threshold (see
    ``best_threshold``). The final models learn from all. Where a class has fewer than five URLs, or none is held
    back, there is no ratio: all scores are 0 and the threshold is 0, so every URL passes.
    """
    # kinds: accepted 0, held back 1; rejected 2, held back 3
    seen = runtime.cut(seen.select("u", (F.when(F.col("say") == "allow", 0).otherwise(2) + held_back(F.col("u")).cast("int")).alias("kind")))
    sizes = {r["kind"]: r["count"] for r in seen.groupBy("kind").count().collect()}
    if any(not sizes.get(k + 1) or sizes.get(k, 0) + sizes[k + 1] < 5 for k in (0, 2)):
        return np.zeros(SIZE), 0.0
    counted = seen.mapInArrow(_counts, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(4 * SIZE, np.int64)
    n[counted["code"].to_numpy()] = counted["n"].to_numpy()
    n = n.reshape(4, SIZE)
    shared = seen.sparkSession.sparkContext.broadcast(Markov(n[0]).log - Markov(n[2]).log)

    @F.pandas_udf("double")
    def score(u: pd.Series) -> pd.Series:
        return pd.Series(np.round(score_urls(u.tolist(), shared.value), 9))

    fold = seen.where("kind % 2 = 1").select(score("u").alias("s"), "kind")
    threshold = best_threshold(fold.groupBy("s").agg(F.count_if(F.col("kind") == 1).alias("good"), F.count_if(F.col("kind") == 3).alias("bad")))
    shared.destroy()
    return Markov(n[0] + n[1]).log - Markov(n[2] + n[3]).log, threshold


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``pages`` with host, path, rule, verdict and score (null where a rule decides).

    The models learn from and score the whole URL as it stands, with its scheme and query; a null URL
    counts as empty and scores 0. URLs that repeat are judged alike and learned from once.
    Columns of the input with one of these names are replaced. An empty table gives an empty result.
    """
    host, path = host_path(F.col("url"))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    url, said = fresh(pages, "_url", "_said")
    base = pages.select(*keep, F.coalesce("url", F.lit("")).alias(url), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn(said, verdict)
    seen = base.where("rule IS NOT NULL").select(F.col(url).alias("u"), F.col(said).alias("say")).distinct()
    ratio, threshold = fit(seen)
    shared = pages.sparkSession.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def score(u: pd.Series) -> pd.Series:
        return pd.Series(score_urls(u.tolist(), shared.value))

    base = base.withColumn("score", F.when(F.col("rule").isNull(), score(url)))
    judged = F.coalesce(said, F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return base.withColumn("verdict", judged).drop(said, url)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page's URL."""
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def _sql() -> str:
    """The rules, the models of both classes (0: without what is held back, 1: of all) and the threshold."""
    fits = lambda r: (lambda h, p: f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '/{p}'))")(*r.split("/", 1))
    rules = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    pick = lambda k: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[k]}'" for r in rules) + " END"
    context = lambda k: "".join(f", a{i}" for i in range(1, k + 1))
    on = lambda k, t: " AND ".join(f"{t}.{c} = x.{c}" for c in ["m", "say", *(f"a{i}" for i in range(1, k + 1))])
    counts = "".join(
        f"""
n{k} AS (SELECT m, say{context(k)}, c, count(*) AS n FROM learned GROUP BY ALL),
t{k} AS (SELECT m, say{context(k)}, sum(n) AS t, count(*) AS kinds FROM n{k} GROUP BY ALL),"""
        for k in range(ORDER + 1)
    )
    prob = f"(1.0 / {SYMBOLS}::DOUBLE)"
    for k in range(ORDER + 1):
        prob = f"(CASE WHEN t{k}.t > 0 THEN (coalesce(n{k}.n, 0) + t{k}.kinds * {prob}) / (t{k}.t + t{k}.kinds) ELSE {prob} END)"
    joins = "".join(f" LEFT JOIN n{k} ON {on(k, f'n{k}')} AND n{k}.c = x.c LEFT JOIN t{k} ON {on(k, f't{k}')}" for k in range(ORDER + 1))
    return f"""
WITH pg AS (SELECT page_id, coalesce(url, '') AS u, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
hp AS (SELECT page_id, u, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM pg),
ru AS (SELECT *, {pick(0)} AS rule, {pick(1)} AS said FROM hp),
lab AS (SELECT DISTINCT u, said AS say, ('0x' || substr(md5(u), 1, 8))::BIGINT % 5 = 0 AS held FROM ru WHERE rule IS NOT NULL),
bt AS (SELECT u, p, ([{', '.join(map(str, TABLE.tolist()))}])[('0x' || substr(h, 2 * p - 1, 2))::INT + 1] AS c FROM (SELECT u, hex(encode(u)) AS h, unnest(range(1, len(hex(encode(u))) // 2 + 1)) AS p FROM (SELECT DISTINCT u FROM ru))),
sy AS (SELECT u, p, c, {', '.join(f'lag(c, {i}, 0) OVER (PARTITION BY u ORDER BY p) AS a{i}' for i in range(1, ORDER + 1))} FROM bt),
learned AS (SELECT m, say, sy.* FROM sy JOIN lab USING (u) JOIN (VALUES (0), (1)) g(m) ON m = 1 OR NOT held),{counts}
lp AS (SELECT x.m, x.say, x.u, avg(ln({prob})) AS v FROM (SELECT m, say, sy.* FROM sy, (VALUES (0), (1)) g(m), (VALUES ('allow'), ('block')) f(say)) x{joins} GROUP BY ALL),
sc AS (SELECT a.m, a.u, a.v - b.v AS s FROM lp a JOIN lp b ON a.m = b.m AND a.u = b.u AND a.say = 'allow' AND b.say = 'block'),
ok AS (SELECT coalesce(bool_and(n >= 5 AND k > 0) AND count(*) = 2, false) AS fits FROM (SELECT say, count(*) AS n, sum(held::INT) AS k FROM lab GROUP BY say)),
cal AS (SELECT say, round(s, 9) AS s FROM sc JOIN lab USING (u) WHERE m = 0 AND held),
pl AS (SELECT s, lead(s) OVER (ORDER BY s) AS nx, lag(s) OVER (ORDER BY s) AS pv FROM (SELECT DISTINCT s FROM cal)),
ed AS (SELECT CASE WHEN nx IS NULL THEN s + 1 ELSE (s + nx) / 2 END AS e FROM pl UNION ALL SELECT s - 1 FROM pl WHERE pv IS NULL),
rt AS (SELECT e, avg((s >= e)::INT) FILTER (say = 'allow') + avg((s < e)::INT) FILTER (say = 'block') AS r FROM ed CROSS JOIN cal GROUP BY e),
th AS (SELECT CASE WHEN (SELECT fits FROM ok) THEN list(e ORDER BY e)[len(list(e)) // 2 + 1] ELSE 0 END AS threshold FROM rt WHERE r >= (SELECT max(r) FROM rt) - 1e-12),
fin AS (SELECT page_id, host, path, rule, said, CASE WHEN rule IS NULL THEN CASE WHEN (SELECT fits FROM ok) THEN coalesce(s, 0) ELSE 0 END END AS score FROM ru LEFT JOIN sc ON sc.m = 1 AND sc.u = ru.u)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score >= coalesce((SELECT threshold FROM th), 0) THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score FROM fin
"""


OP5_SQL = _sql()
