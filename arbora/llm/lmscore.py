"""Language-model scores by cross-entropy difference.

Two bigram models share one vocabulary and one way of smoothing: the target model learns from the
documents of a wanted kind, the background model from the whole corpus. A document's score is the
mean over its tokens of the target's loss minus the background's: the lower, the more it is like the
target. A wanted document is scored by models that have both learned from it. Counts cover every
token of the corpus; every word has counts of its own, so what is gathered grows with the corpus.

Counts meet documents by two exchanges of sparse tables, and no table of the whole model exists:

1. Documents fall into buckets of about ``BUCKET`` bytes by the hash of their id. Each bucket counts its
   words and pairs and sends every distinct one once, however often it occurs, to the range that the
   key's hash lies in (``_ask``). So the commonest pair is sent as often as any other.
2. A range adds up what all buckets sent and answers each of them in the order of its keys (``_answer``).
3. The bucket counts again, now holds the corpus counts of all its words and pairs, and scores (``_score``).

Texts are shuffled once, to their buckets, and read twice from there. Words and pairs are told apart by
64-bit hashes. With ``vocab`` the words beyond so many are 64 unknown words by their hash instead, and
the model is one table of at most (vocab + 65) ** 2 entries that is broadcast.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_buffers, cut, table, texts_of

VOCAB = 2000
UNKNOWN = 64
#: Bytes of text in a bucket, and of the texts whose keys are in a range, about; a task holds about 30 times that
#: for a moment. Beyond BUCKETS of them they grow with the root of the corpus, as the tables sent are buckets times ranges.
BUCKET = 8_000_000
BUCKETS = 100_000
#: Weight of the shorter model in the mixture, in counts (Dirichlet smoothing).
PRIOR = 50.0
#: Distinct words or pairs a task holds before it hands its counts on.
HELD = 400_000


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of a text."""
    return text.lower().split()


def unknown(word: bytes) -> int:
    """Which of the unknown words a word outside the vocabulary is."""
    from xxhash import xxh32_intdigest

    return xxh32_intdigest(word) % UNKNOWN


class _Ids(dict):
    """Word -> id; unknown words are added as they are met, up to a bound."""

    def __init__(self, words: list[bytes]):
        super().__init__({w: i + 1 + UNKNOWN for i, w in enumerate(words)})

    def __missing__(self, word: bytes) -> int:
        i = 1 + unknown(word)
        if len(self) < 400_000:
            self[word] = i
        return i


def _word_counts(batches):
    import pyarrow as pa

    held: Counter = Counter()

    def hand_on():
        b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["w", "n"])
        held.clear()
        return b

    for b in batches:
        for t in texts_of(b.column(0)):
            held.update(tokens(t))
            if len(held) > HELD:
                yield hand_on()
    yield hand_on()


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, n) of every word of all texts."""
    return docs.select("text").mapInArrow(_word_counts, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, size: int = VOCAB) -> list[bytes]:
    """The ``size`` most frequent words of (w, n); ties by the bytes of the word."""
    return [bytes(r["w"]) for r in counts.orderBy(F.desc("n"), "w").limit(size).collect()]


def pair_codes(ids: _Ids, text: bytes, width: int) -> np.ndarray:
    """previous * width + token for every token; 0 stands before the first."""
    t = tokens(text)
    if not t:
        return np.empty(0, np.int64)
    a = np.fromiter(map(ids.__getitem__, t), np.int64, len(t))
    out = a.copy()
    out[1:] += a[:-1] * width
    return out


def pair_counts(docs: DataFrame, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(background, target) counts of pairs, of all rows (text, target boolean): arrays (width, width)."""
    width = len(words) + UNKNOWN + 1
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import pyarrow as pa

        ids = _Ids(shared.value)
        held, size = [], 0

        def hand_on():
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])

        for b in batches:
            wanted = b.column(b.schema.get_field_index("target")).to_pylist()
            for t, y in zip(texts_of(b.column(b.schema.get_field_index("text"))), wanted):
                c = pair_codes(ids, t, width)
                held.append(c * 2 + bool(y))
                size += len(c)
                if size > 4_000_000:
                    yield hand_on()
                    held, size = [], 0
        if held:
            yield hand_on()

    got = docs.select("text", "target").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    # a row of the model for each previous word, packed: at most `width` rows reach the driver
    row = F.floor(F.col("code") / (2 * width)).cast("int")
    rows = got.groupBy(row.alias("row")).agg(F.collect_list(F.struct((F.col("code") % (2 * width)).cast("int").alias("c"), "n")).alias("x"))

    def pack(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for x in pdf.x:
                dense = np.zeros((width, 2), np.float32)
                for e in x:
                    dense[e["c"] >> 1, e["c"] & 1] = e["n"]
                out.append(dense.tobytes())
            yield pd.DataFrame({"row": pdf.row, "x": out})

    counts = np.zeros((width, width, 2), np.float32)
    for r in rows.mapInPandas(pack, "row int, x binary").toLocalIterator():
        counts[r["row"]] = np.frombuffer(bytes(r["x"]), np.float32).reshape(width, 2)
    return counts.sum(2), counts[:, :, 1]


def log_model(n: np.ndarray) -> np.ndarray:
    """log p(token | previous): pair counts mixed with token counts, those with a uniform share."""
    uni = n.sum(0, dtype=np.float64)
    uni = (uni + 1.0) / (uni.sum() + len(uni))
    total = n.sum(1, dtype=np.float64)
    out = np.empty(n.shape, np.float32)
    for i in range(len(n)):  # row by row, to hold one table only
        out[i] = np.log((n[i] + PRIOR * uni) / (total[i] + PRIOR))
    return out


def score_documents(docs: DataFrame, words: list[bytes], loss: np.ndarray) -> DataFrame:
    """doc_id, n_tokens and score (mean loss difference a token; 0 without tokens) of every row."""
    width = len(loss)
    shared = docs.sparkSession.sparkContext.broadcast((words, np.ascontiguousarray(loss).ravel()))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import pyarrow as pa

        words, flat = shared.value
        ids = _Ids(words)
        for b in batches:
            n, s = [], []
            for t in texts_of(b.column(b.schema.get_field_index("text"))):
                c = pair_codes(ids, t, width)
                n.append(len(c))
                s.append(float(flat[c].sum(dtype=np.float64)) / len(c) if len(c) else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(s, pa.float64())], ["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, score double")


# Section: every word for itself

_R = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)
_START = np.uint64(0x2545F4914F6CDD1D)
#: Bytes that are hashed at once.
_PIECE = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _byte_codes() -> np.ndarray:
    """A number for each byte; A-Z count as a-z, white space is 0."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(_R)) ^ np.uint64(_R >> 7)
    x *= _M1
    x ^= x >> np.uint64(29)
    x |= np.uint64(1)
    x[65:91] = x[97:123]
    x[[9, 10, 11, 12, 13, 32]] = 0
    return x


_CODES = _byte_codes()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least n of each."""
    size = max(_PIECE, 1 << (n - 1).bit_length()) if n else _PIECE
    if size not in _POWERS:
        if len(_POWERS) > 1:
            _POWERS.clear()
        _POWERS[size] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, v, np.uint64))]) for v in (_R, pow(_R, -1, 1 << 64)))
    return _POWERS[size]


def _last_break(data: np.ndarray, starts: np.ndarray, a: int, b: int) -> int:
    """Last place from a to before b where a word cannot go on: a space, or the first byte of a text; -1 if there is none."""
    space = np.flatnonzero(_CODES[data[a:b]] == 0)
    text = np.searchsorted(starts, b) - 1
    return max(int(space[-1]) + a if len(space) else -1, int(starts[text]) if text >= 0 and starts[text] >= a else -1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word of the texts ``data[offsets[i]:offsets[i + 1]]``, in order."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    hashes, at = [], []
    pos, stop = int(offsets[0]), int(offsets[-1])
    while pos < stop:
        end = min(pos + _PIECE, stop)
        if end < stop:  # a piece ends before a space or the first byte of a text
            back = _last_break(data, starts, pos + 1, end)
            while back < 0:  # one word longer than a piece
                ahead = min(end + _PIECE, stop)
                back = stop if ahead == stop and _last_break(data, starts, end, ahead) < 0 else _last_break(data, starts, end, ahead)
                end = ahead
            end = back
        v = _CODES[data[pos:end]]
        word = v != 0
        first, last = word.copy(), word.copy()
        cut_at = starts[np.searchsorted(starts, pos) : np.searchsorted(starts, end)] - pos
        inner = np.zeros(len(v) + 1, bool)  # where a text begins
        inner[cut_at] = True
        first[1:] &= ~word[:-1] | inner[1:-1]
        last[:-1] &= ~word[1:] | inner[1:-1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers(len(v))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * up[: len(v)])])
        h = (sums[b] - sums[a]) * down[a]
        h ^= h >> np.uint64(31)
        h *= _M1
        h ^= h >> np.uint64(29)
        hashes.append(h)
        at.append(np.searchsorted(offsets, a + pos, side="right") - 1)
        pos = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(at)


class _Bucket:
    """The words and pairs of some texts."""

    def __init__(self, texts):
        data, offsets = byte_buffers(texts)
        self.n = len(offsets) - 1
        h, self.doc = word_hashes(data, offsets)
        opens = np.ones(len(h), bool)
        opens[1:] = self.doc[1:] != self.doc[:-1]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[opens] = _START
        pair = (before ^ before >> np.uint64(32)) * _M2 + h
        pair ^= pair >> np.uint64(29)
        pair *= _M1
        pair ^= pair >> np.uint64(32)
        # words, as a token and as the one before; the start is a word that only comes before
        self.words, where = np.unique(np.concatenate([h, before]), return_inverse=True)
        self.word, self.before = where[: len(h)], where[len(h) :]
        self.pairs, self.pair = np.unique(pair, return_inverse=True)

    def counts(self, wanted: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per word: as a token in all texts and in the wanted ones, as the one before likewise; per pair: in all, in the wanted."""
        y = wanted[self.doc].astype(np.float64)
        many = lambda at, k: [np.bincount(at, minlength=k), np.bincount(at, y, k).astype(np.int64)]
        return many(self.word, len(self.words)) + many(self.before, len(self.words)), many(self.pair, len(self.pairs))


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Ends of the n ranges among sorted keys."""
    at = (keys >> np.uint64(40)).astype(np.int64) * n >> 24
    return np.searchsorted(at, np.arange(n), side="right")


def _squeeze(columns: list[np.ndarray]) -> bytes:
    """64-bit columns byte plane by byte plane, compressed: small numbers take next to nothing."""
    import pyarrow as pa

    raw = b"".join(c.astype(np.uint64, copy=False).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
    return pa.Codec("zstd").compress(raw, asbytes=True)


def _expand(blob: bytes, sizes: list[int]) -> list[np.ndarray]:
    import pyarrow as pa

    raw = np.frombuffer(pa.Codec("zstd").decompress(blob, decompressed_size=8 * sum(sizes), asbytes=True), np.uint8)
    out, at = [], 0
    for n in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 8 * n].reshape(8, n).T).view(np.uint64).ravel())
        at += 8 * n
    return out


def _ask(ranges: int):
    """A bucket's distinct words and pairs with their counts, a row for each range."""

    def run(docs, wanted):
        import pyarrow as pa
        import pyarrow.compute as pc

        b = _Bucket(docs["text"])
        flag = pc.is_in(docs["doc_id"], value_set=wanted["doc_id"].combine_chunks()) if len(wanted) else pa.array(np.zeros(len(docs), bool))
        words, pairs = b.counts(np.asarray(flag))
        ends = [_ranges(k, ranges).tolist() for k in (b.words, b.pairs)]
        rows, a = [], [0, 0]
        for g in range(ranges if b.n else 0):
            e = [x[g] for x in ends]
            keys = [np.diff(k[i:j], prepend=k.dtype.type(0)) for k, i, j in zip((b.words, b.pairs), a, e)]
            columns = [keys[0], *(c[a[0] : e[0]] for c in words), keys[1], *(c[a[1] : e[1]] for c in pairs)]
            rows.append((g, e[0] - a[0], e[1] - a[1], _squeeze(columns)))
            a = e
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        bucket = docs["bucket"][0].as_py() if len(docs) else 0
        kinds = pa.int32(), pa.int64(), pa.int64(), pa.binary()
        return pa.table([pa.array([bucket] * len(rows), pa.int32()), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["bucket", "range", "words", "pairs", "blob"])

    return run


def _answer(group):
    """Corpus counts for what each bucket asked of a range, in the order of its keys; the range's words and tokens go along."""
    import pyarrow as pa

    sizes = list(zip(group["words"].to_pylist(), group["pairs"].to_pylist()))
    asked = [_expand(b.as_py(), [n] * 5 + [m] * 3) for b, (n, m) in zip(group["blob"], sizes)]

    def total(first: int, kinds: int, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        key = np.concatenate([np.cumsum(x[first]) for x in asked])
        distinct, at = np.unique(key, return_inverse=True)
        sums = [np.bincount(at, np.concatenate([x[first + 1 + c] for x in asked]).astype(np.float64), len(distinct)).astype(np.int64) for c in range(kinds)]
        return sums, [np.split(s[at], ends[:-1]) for s in sums]

    words, for_words = total(0, 4, np.cumsum([n for n, _ in sizes]))
    _, for_pairs = total(5, 2, np.cumsum([m for _, m in sizes]))
    blobs = [_squeeze([*(c[i] for c in for_words), *(c[i] for c in for_pairs)]) for i in range(len(sizes))]
    n = len(sizes)
    sums = [np.full(n, v, np.int64) for v in (int((words[0] > 0).sum()), int(words[0].sum()), int(words[1].sum()))]
    return pa.table([group["bucket"], group["range"], group["words"], group["pairs"], pa.array(blobs, pa.binary()), *map(pa.array, sums)], ["bucket", "range", "words", "pairs", "blob", "distinct", "tokens", "wanted"])


def _score(docs, answers):
    """doc_id, n_tokens and score of the texts of a bucket."""
    import pyarrow as pa

    b = _Bucket(docs["text"])
    n = np.bincount(b.doc, minlength=b.n) if b.n else np.empty(0, np.int64)
    score = np.zeros(b.n)
    if len(b.doc):
        answers = answers.sort_by("range")
        size = sum(answers["distinct"].to_pylist()) + 1
        sums = [float(sum(answers[c].to_pylist())) for c in ("tokens", "wanted")]
        got = [_expand(x.as_py(), [i] * 4 + [j] * 2) for x, i, j in zip(answers["blob"], answers["words"].to_pylist(), answers["pairs"].to_pylist())]
        word = [np.concatenate([x[c] for x in got]).astype(np.float64) for c in range(4)]
        pair = [np.concatenate([x[c] for x in got]).astype(np.float64) for c in (4, 5)]
        gain = np.zeros(len(b.doc))
        for c, sign in ((0, 1.0), (1, -1.0)):
            uni = PRIOR * (word[c] + 1.0) / (sums[c] + size)
            gain += sign * (np.log(pair[c][b.pair] + uni[b.word]) - np.log(word[2 + c] + PRIOR)[b.before])
        score = np.bincount(b.doc, gain, b.n) / np.maximum(n, 1)
    return pa.table([docs["doc_id"], pa.array(n.astype(np.int64)), pa.array(score)], ["doc_id", "n_tokens", "score"])


def score_all_words(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens and score of every row (doc_id, text); no word stands for another."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BUCKET)
    n = max(1, n if n <= BUCKETS else int((n * BUCKETS) ** 0.5))
    kind = dict(docs.dtypes)["doc_id"]
    # rows without an id are never wanted and spread by their text
    bucket = lambda text: F.pmod(F.xxhash64("doc_id", text), F.lit(n)).cast("int").alias("bucket")
    rows = docs.select(bucket(F.when(F.col("doc_id").isNull(), F.col("text"))), "doc_id", "text")
    wanted = target.select(F.col("doc_id").cast(kind).alias("doc_id")).where("doc_id IS NOT NULL")
    wanted = wanted.select(bucket(F.lit(None).cast("string")), "doc_id")
    asked = rows.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(_ask(n), "bucket int, range int, words long, pairs long, blob binary")
    answers = asked.groupBy("range").applyInArrow(_answer, "bucket int, range int, words long, pairs long, blob binary, distinct long, tokens long, wanted long")
    return rows.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_score, f"doc_id {kind}, n_tokens long, score double")


def cross_entropy_difference(docs: DataFrame, target: DataFrame, vocab: int | None = None) -> DataFrame:
    """doc_id, n_tokens, score for every row of ``docs``; ``target`` has the ids (doc_id) of wanted documents.

    Null and empty texts have no tokens and score 0. Null ids are scored but never wanted. If no
    document is wanted, the target model is the uniform one mixed as usual, so scores stay defined.
    Every word counts for itself, unless ``vocab`` bounds their number.
    """
    if vocab is None:
        return score_all_words(docs.select("doc_id", "text"), target)
    # ids only; one row each, so the join keeps the rows of docs as they are
    wanted = target.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("_wanted", F.lit(True))
    wanted = cut(wanted)
    words = vocabulary(word_counts(docs), vocab)
    # the list of wanted ids grows with the corpus, so it is never broadcast
    flagged = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left")
    flagged = flagged.select("doc_id", "text", F.coalesce("_wanted", F.lit(False)).alias("target"))
    everything, some = pair_counts(flagged, words)
    loss = log_model(everything)
    loss -= log_model(some)
    return score_documents(docs, words, loss)


def op2_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and score of every document; documents labelled as of good quality are the target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return cross_entropy_difference(docs, good).select("doc_id", "n_tokens", F.round("score", 7).alias("score"))


OP2_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
k AS (
  SELECT r, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false)::INT AS y,
         words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] ELSE '' END AS v
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM t)),
u AS (SELECT w, count(*) AS c, sum(y) AS m FROM k GROUP BY w),
h AS (SELECT v, count(*) AS c, sum(y) AS m FROM k GROUP BY v),
b AS (SELECT v, w, count(*) AS c, sum(y) AS m FROM k GROUP BY v, w),
z AS (SELECT sum(c)::DOUBLE AS n, sum(m)::DOUBLE AS nm, count(*) + 1 AS size FROM u),
s AS (
  SELECT k.r, ln(b.c + {PRIOR}::DOUBLE * (u.c + 1) / (n + size)) - ln(h.c + {PRIOR}::DOUBLE) - ln(b.m + {PRIOR}::DOUBLE * (u.m + 1) / (nm + size)) + ln(h.m + {PRIOR}::DOUBLE) AS g
  FROM k JOIN b ON b.v = k.v AND b.w = k.w JOIN u ON u.w = k.w JOIN h ON h.v = k.v CROSS JOIN z)
SELECT any_value(t.doc_id) AS doc_id, any_value(len(t.words))::BIGINT AS n_tokens, round(coalesce(avg(g), 0), 7) AS score FROM t LEFT JOIN s ON s.r = t.r GROUP BY t.r
"""
