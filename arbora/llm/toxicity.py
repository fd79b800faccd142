"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features are rates of a whole text: how dense words of a lexicon are, how often a second-person word
stands near one of them, capitals, punctuation and obfuscated words. The lexicon has a built-in seed
and the words that training rows use far more in toxic texts. Trees are grown on quantile bins with
second-order logistic loss; a held-back fold of the training rows calibrates the raw score.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table, texts_of, thrifty

#: Labelled rows that are learned from, at most: those with the smallest hashes of their id.
SAMPLE = 8_000
#: Words of the learned lexicon, at most.
LEXICON = 400
FOLDS = 4
SEED = frozenset("idiot idiots moron morons stupid dumb fool scum trash pathetic loser losers worthless disgusting hate kill die shut garbage clown ugly filthy vermin coward liar freak pig".encode().split())
SECOND_PERSON = frozenset("you your yours yourself you're youre u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted su vosotros os".encode().split())
#: Stand-ins for letters in disguised words.
LEET = bytes.maketrans(b"013457@$!", b"oleastasi")
EDGE = b".,;:!?\"'()[]{}<>|*_~#-\xc2\xab\xbb"
NEAR = 4

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_REPEAT = re.compile(rb"([a-zA-Z!?])\1{2,}")
_DISGUISED = re.compile(rb"[A-Za-z][0-9@$!*]+[A-Za-z]")
FEATURES = ["log_words", "lexicon", "lexicon_hits", "learned", "learned_hits", "seed_kinds", "near_you", "second_person", "capitals", "shouted", "punctuation", "exclaims", "repeats", "disguised", "leet_lexicon", "mean_word", "digits", "top_weight"]


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words without the marks at their edges."""
    return [w.strip(EDGE) for w in text.lower().split()]


def features(text: bytes, learned: dict[bytes, float]) -> list[float]:
    """The values of FEATURES for one text; an empty text gives zeros."""
    words = words_of(text)
    n, size = len(words), max(len(text), 1)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = set(words)
    seed = kinds & SEED
    found = kinds & learned.keys()
    hits = [i for i, w in enumerate(words) if w in SEED or learned.get(w, 0.0) > 1.5] if seed or found else []
    n_seed = sum(map(words.count, seed))
    weights = sum(learned[w] * words.count(w) for w in found)
    you = kinds & SECOND_PERSON
    n_you = sum(map(words.count, you))
    near = 0
    if you and hits:
        near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    upper = size - len(text.translate(None, _UPPER))
    letters = upper + size - len(text.translate(None, _LOWER))
    punct = size - len(text.translate(None, _PUNCT))
    digits = size - len(text.translate(None, _DIGIT))
    masked = _DISGUISED.findall(text) if digits or b"@" in text or b"$" in text or b"*" in text or b"!" in text else []
    leet = 0
    if masked:
        leet = sum(1 for w in words if not w.isalpha() and (u := w.translate(LEET)) != w and (u in SEED or learned.get(u, 0.0) > 1.5))
    shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if upper > 2 else 0
    return [
        float(np.log1p(n)), n_seed / n, float(np.log1p(n_seed)), weights / n, weights, float(len(seed)),
        near / n, n_you / n, upper / max(letters, 1), shouted / n, punct / size, (text.count(b"!") + text.count(b"?")) / size,
        len(_REPEAT.findall(text)) / n, len(masked) / n, leet / n, size / n, digits / size, max((learned[w] for w in found), default=0.0),
    ]


def _word_sets(batches):
    """(w, cell): every distinct word of a training text with 2 * fold + label."""
    import pyarrow as pa

    for b in batches:
        cells = b.column(b.schema.get_field_index("cell")).to_pylist()
        for t, cell in zip(texts_of(b.column(b.schema.get_field_index("text"))), cells):
            w = [x for x in set(words_of(t)) if 2 < len(x) < 40]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array([cell] * len(w), pa.int32())], ["w", "cell"])


def learn_lexicons(train: DataFrame, sizes: np.ndarray) -> list[dict[bytes, float]]:
    """Words far more frequent in toxic texts -> log-odds of a document holding them.

    ``train``: rows (text, cell) with cell = 2 * fold + label; ``sizes``: rows of each cell. One lexicon
    without each fold and one of all rows, the LEXICON best words of each; counting is distributed.
    """
    n = [F.sum(F.when(F.col("cell") == c, 1).otherwise(0)).alias(f"n{c}") for c in range(2 * FOLDS)]
    counts = cut(train.mapInArrow(_word_sets, "w binary, cell int").groupBy("w").agg(*n).where(" + ".join(f"n{c}" for c in range(1, 2 * FOLDS, 2)) + " >= 5"))
    out = []
    for left in range(FOLDS + 1):
        folds = [f for f in range(FOLDS) if f != left]
        k1, k0 = (sum((F.col(f"n{2 * f + y}") for f in folds), F.lit(0)) for y in (1, 0))
        n1, n0 = (max(int(sum(sizes[2 * f + y] for f in folds)), 1) for y in (1, 0))
        odds = F.log((k1 + 0.5) / (n1 + 1)) - F.log((k0 + 0.5) / (n0 + 1))
        best = counts.select("w", odds.alias("odds"), (odds * F.sqrt(k1)).alias("gain"), k1.alias("k1")).where("k1 >= 5 AND odds > 1.0")
        out.append({bytes(r["w"]): float(r["odds"]) for r in best.orderBy(F.desc("gain"), "w").limit(LEXICON).collect()})
    return out


class Boosted:
    """Gradient-boosted regression trees of fixed depth on quantile bins (logistic loss)."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 1.0, least: float = 1.0):
        self.trees_, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        p0 = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(p0 / (1 - p0)))
        raw, self.trees = np.full(n, self.base), []
        for _ in range(self.trees_ if n else 0):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            splits: list[tuple[int, float]] = []
            for level in range(self.depth):
                k = 1 << level
                best_gain, best = np.full(k, 1e-6), [(0, np.inf)] * k
                for j in range(d):
                    m = len(self.edges[j]) + 1
                    if m < 2:
                        continue
                    code = node * m + b[:, j]
                    gs = np.bincount(code, g, k * m).reshape(k, m).cumsum(1)
                    hs = np.bincount(code, h, k * m).reshape(k, m).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hs < self.least) | (ht - hs < self.least)] = -np.inf
                    at = gain[:, :-1].argmax(1)
                    for q in range(k):
                        if gain[q, at[q]] > best_gain[q]:
                            best_gain[q], best[q] = gain[q, at[q]], (j, float(self.edges[j][at[q]]))
                splits += best
                feat, thr = np.array([s[0] for s in best]), np.array([s[1] for s in best])
                node = node * 2 + (x[np.arange(n), feat[node]] > thr[node])
            leaf = -np.bincount(node, g, 1 << self.depth) / (np.bincount(node, h, 1 << self.depth) + self.l2)
            raw += self.rate * leaf[node]
            self.trees.append((np.array([s[0] for s in splits]), np.array([s[1] for s in splits]), leaf * self.rate))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feat, thr, leaf in self.trees:
            node, first = np.zeros(len(x), np.int64), 0
            for level in range(self.depth):
                at = first + node
                node = node * 2 + (x[rows, feat[at]] > thr[at])
                first += 1 << level
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: points (score, probability), non-decreasing, to interpolate between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, lowest score, highest score
    for s, v in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, w2, _, hi = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += w2
            blocks[-1][3] = hi
    xs, ps = [], []
    for v, w, lo, hi in blocks:
        p = (v + 0.25) / (w + 0.5)  # never quite 0 or 1
        xs += [lo, hi] if hi > lo else [lo]
        ps += [p, p] if hi > lo else [p]
    return np.array(xs), np.maximum.accumulate(np.array(ps))


class Scorer:
    """Lexicon, trees and calibration learned from labelled texts."""

    def __init__(self, learned: dict[bytes, float], x: list[np.ndarray], y: np.ndarray, fold: np.ndarray):
        """x[f]: features by the lexicon learned without fold f; x[FOLDS]: by the one of all rows."""
        self.learned, self.constant = learned, None
        if len(y) < 20 or y.min() == y.max():
            self.constant = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.0
            return
        out = np.zeros(len(y))
        for f in range(FOLDS):  # every row is scored by trees and a lexicon that have not seen it
            out[fold == f] = Boosted().fit(x[f][fold != f], y[fold != f]).raw(x[f][fold == f])
        self.points = isotonic(out, y.astype(float))
        self.model = Boosted().fit(x[FOLDS], y)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        raw = self.model.raw(np.array([features(t, self.learned) for t in texts], np.float64))
        xs, ps = self.points
        p = np.interp(raw, xs, ps)
        # inside a level block the raw order still counts, by a sliver that never crosses 0.5
        sliver = 1e-4 / (1 + np.exp(-np.clip(raw, -30, 30)))
        return np.where(p >= 0.5, np.minimum(p + sliver, 1.0), np.minimum(p + sliver, np.nextafter(0.5, 0)))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Learns from at most ``sample`` labelled documents that are not held out.

    Labels other than 0 and 1, and ids that are null, are not learned from. Of rows that share an id
    one is used. The sample is the rows with the smallest hashes of their ids, so reruns agree.
    """
    lab = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lab = lab.where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    lab = cut(lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # ids and labels only: bounded by the sample
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int")
    train = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    train = cut(train.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (2 * fold + F.col("toxic")).cast("int").alias("cell")))
    sizes = np.zeros(2 * FOLDS, np.int64)
    for r in train.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    lexicons = learn_lexicons(train, sizes)
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            texts = texts_of(b.column(b.schema.get_field_index("text")))
            x = [[v for lex in shared.value for v in features(t, lex)] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("cell")), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "cell", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    got = train.mapInArrow(thrifty(rows), f"doc_id {kind}, cell int, x array<double>").collect()  # numbers only, `sample` rows
    got.sort(key=lambda r: r["doc_id"])
    cell = np.array([r["cell"] for r in got], np.int64)
    x = np.array([r["x"] for r in got], np.float64).reshape(len(got), FOLDS + 1, len(FEATURES))
    return Scorer(lexicons[FOLDS], [x[:, f] for f in range(FOLDS + 1)], cell % 2, cell // 2)


def with_scores(docs: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """docs with one more column: the score of the whole text (null and empty ones too), however long it is.

    A column that bears the new name is replaced; all others stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    keep = [c for c in docs.columns if c != name]
    whole = "text" if "text" in keep else fresh(docs, "_text")[0]  # sent once
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            text = b.column(b.schema.get_field_index(whole))
            got = np.concatenate([shared.value.score(texts_of(text.slice(i, 256))) for i in range(0, len(text), 256)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(got, pa.float64())], [*keep, name])

    return docs.select(*keep, *([F.col("text").alias(whole)] if whole != "text" else [])).mapInArrow(thrifty(run), f"{fields}, `{name}` double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose calibrated score stays below ``threshold``; columns are those of docs."""
    (name,) = fresh(docs, "_toxicity")
    scored = with_scores(docs, fit(docs, labels), name)
    return scored.where(F.col(name) < threshold).select(*docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Only labels of rows that are not held out are learned from. A null text scores as an empty one. A
    null id is not held out. Without labels of both classes every score is the share of toxic labels.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = fit(docs, table(spark, sf_dir, "labels"))
    out = with_scores(docs, scorer)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
