"""Each operator against a brute-force version, and its edge cases: nulls, empty and long texts, ties,
repeated rows, empty tables and columns with clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arbora.llm import linededup, lmscore, mixing, pieces, simhash, suffixdedup, topk, toxicity, urls, webp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(5)
    texts = [words(rng, rng.randrange(3, 120)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[7].replace("w1", "W1")]
    passage = "\n".join(words(rng, 12) for _ in range(6))
    texts += [words(rng, 30) + "\n" + passage + "\n" + words(rng, 20) for _ in range(4)]
    texts += [None, "", " \t\n", "one", "two words", "é" * 50, "ab" * 3000, words(rng, 9000)]
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[2], rows[2], (None, "no id here", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).withColumn("score", F.lit("clash")).withColumn("tokens", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Section: 1: line dedup


def test_patience_keeps_order_and_finds_blocks():
    a, b = [1, 2, 3, 4, 5, 6], [9, 2, 3, 8, 5, 6]
    assert linededup.patience(a, b) == [(1, 1, 2), (4, 4, 2)]
    assert linededup.patience([1, 2, 1], [2, 1, 2]) in ([(1, 0, 2)], [(0, 1, 2)])
    assert linededup.patience([], [1]) == [] and linededup.patience([7, 7], [7, 7]) == [(0, 0, 2)]


@pytest.mark.parametrize("seed", range(30))
def test_patience_is_a_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(6) for _ in range(rng.randrange(20))] for _ in range(2))
    pa = pb = 0
    for i, j, n in linededup.patience(a, b):
        assert i >= pa and j >= pb and a[i : i + n] == b[j : j + n]
        pa, pb = i + n, j + n


def test_line_dedup(docs, corpus, empty):
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(corpus)
    kept = {r.doc_id: r.text for r in out.collect()}
    by = {r[0]: r[1] for r in corpus}
    assert kept[3] == by[3] and kept[40] == "" and kept[41] == ""  # the first of exact copies stays
    shared = [i for i, t in by.items() if t and t.count("\n") == 7]
    assert kept[shared[0]] == by[shared[0]]
    for i in shared[1:]:
        lines = by[i].split("\n")
        assert kept[i].split("\n") == [lines[0], lines[-1]]
    clean = set(by) - {40, 41, *shared[1:]}
    assert all(kept[i] == by[i] for i in clean)
    assert linededup.dedup_lines(empty).count() == 0


def test_line_dedup_is_that_of_all_pairs(spark):
    rng = random.Random(2)
    x, y, z, *more = (words(rng, 26, 10**6) for _ in range(8))
    texts = [f"{x}\n{y}", f"{y}\n{x}", f"{y}\n{x}", f"{x}\n{y}\nshort", f"{y}\n{x}\nend", f"{z}\n{x}", f"{x}\n{z}"]
    short = [words(rng, 5) for _ in range(6)]
    for _ in range(40):  # blocks and short lines in any order, so that pairs with the first holder cross
        texts.append("\n".join(rng.choice([x, y, z, *more, *short, ""]) for _ in range(rng.randrange(2, 9))))
    split = [t.split("\n") for t in texts]
    kept = []
    for b, later in enumerate(split):
        n = [len(t.split()) for t in later]
        gone = {j for a in range(b) if sum(n) for j in linededup.aligned_lines(split[a], later, n) if n[j]}
        kept.append([t for j, t in enumerate(later) if n[j] and j not in gone])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [t for t in r.text.split("\n") if t] for r in linededup.dedup_lines(docs).collect()}
    assert got[2] == []
    # documents under 25 words are left out: they go only as copies
    assert [got[i] for i, t in enumerate(texts) if len(t.split()) >= 25] == [kept[i] for i, t in enumerate(texts) if len(t.split()) >= 25]


# Section: 2: language-model scores


def test_cross_entropy_difference(spark, docs, corpus, empty):
    target = spark.createDataFrame([(i,) for i in range(0, 20)] + [(None,), (3,)], "doc_id long")
    got = {(r.doc_id, r.n_tokens): r.score for r in lmscore.cross_entropy_difference(docs, target, 50).collect()}
    texts = [(r[0], (r[1] or "").encode().lower().split()) for r in corpus]
    count = {}
    for _, t in texts:
        for w in t:
            count[w] = count.get(w, 0) + 1
    vocab = sorted(count, key=lambda w: (-count[w], w))[:50]
    idx = {w: 65 + k for k, w in enumerate(vocab)}
    size = 50 + 65
    n = [np.zeros((size, size)), np.zeros((size, size))]
    seqs = [(i, [0] + [idx.get(w, 1 + xxhash.xxh32_intdigest(w) % 64) for w in t]) for i, t in texts]
    for i, s in seqs:
        for a, b in zip(s, s[1:]):
            n[0][a, b] += 1
            if i is not None and i < 20:
                n[1][a, b] += 1

    def loss(m, a, b):
        uni = (m[:, b].sum() + 1) / (m.sum() + size)
        return -np.log((m[a, b] + 50 * uni) / (m[a].sum() + 50))

    for i, s in seqs:
        want = np.mean([loss(n[1], a, b) - loss(n[0], a, b) for a, b in zip(s, s[1:])]) if len(s) > 1 else 0.0
        assert got[i, len(s) - 1] == pytest.approx(want, abs=1e-4)
    assert lmscore.cross_entropy_difference(empty, target).count() == 0


def test_every_word_counts_for_itself(spark, empty, monkeypatch):
    monkeypatch.setattr(lmscore, "BUCKET", 500)
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(1, 400), 6000 if i % 2 else 300)) for i in range(60)]
    rows += [rows[3], rows[3], (60, None), (61, "only"), (None, "w1 nobody w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    seqs = [(i, ["", *(t or "").split()]) for i, t in rows]
    n, m = [{}, {}], [{}, {}]
    for i, s in seqs:
        for c in [0, 1] if i is not None and i < 20 else [0]:
            for a, b in zip(s, s[1:]):
                n[c][a, b] = n[c].get((a, b), 0) + 1
                for key in ((0, a), (1, b)):
                    m[c][key] = m[c].get(key, 0) + 1
    size = len({w for _, s in seqs for w in s[1:]}) + 1
    assert size > lmscore.VOCAB

    def loss(c, a, b):
        uni = (m[c].get((1, b), 0) + 1) / (sum(n[c].values()) + size)
        return -np.log((n[c].get((a, b), 0) + 50 * uni) / (m[c].get((0, a), 0) + 50))

    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens), r.score) for r in lmscore.cross_entropy_difference(docs, target).collect())
    want = sorted(((i is None, i or 0, len(s) - 1), np.mean([loss(1, a, b) - loss(0, a, b) for a, b in zip(s, s[1:])]) if len(s) > 1 else 0.0) for i, s in seqs)
    assert [k for k, _ in got] == [k for k, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-5)
    assert lmscore.cross_entropy_difference(empty, target).count() == 0


# Section: 3: exact top-k


def test_top_k_is_exact_with_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(0)
    vecs = [(i, (rng.integers(-3, 4, 12) / 3).tolist()) for i in range(150)]
    vecs += [(150, None), (151, [1.0, None] * 6), (152, [float("nan")] * 12), (153, [float("inf")] * 12), (None, [1.0] * 12), (154, []), (7, vecs[7][1])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    rows = topk.quantised(df)
    got = topk.top_k(rows.where("vec_id % 20 = 0"), rows, 5).orderBy("query_id", "rank").collect()
    ok = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in vecs if i is not None and v is not None and i not in (151, 152, 153)]
    pad = {k: np.pad(v, (0, 12 - len(v))) for k, (_, v) in enumerate(ok)}
    for q in sorted({i for i, _ in ok if i % 20 == 0}):
        v = next(pad[k] for k, (i, _) in enumerate(ok) if i == q)
        want = sorted(((-int(pad[k] @ v), i) for k, (i, _) in enumerate(ok) if i != q))[:5]
        assert [(-r.score, r.vec_id) for r in got if r.query_id == q] == want
    few = rows.where("vec_id < 3")
    assert topk.top_k(few, few, 5).count() == 6
    assert topk.top_k(few.where("false"), few, 5).count() == 0


# Section: 4: SentencePiece

HARD = ["", " ", "  a", "a  b   c ", "日本語 and 한국 ☃ 🎉", "x" * 500, "\n\n a\tb\r\n", "<0x41> <s>", "ab" * 700, "the quick brown fox " * 200]


@pytest.fixture(scope="module")
def encoder():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Encoder(pieces.Model(f.read()))


def test_encoding_equals_the_library(encoder):
    sp = __import__("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    for t, ids in zip(HARD, encoder.encode(HARD)):
        assert ids.tolist() == sp.encode(t)
        assert pieces.decode(encoder.m, ids.tolist()) == t


@pytest.mark.parametrize("chunk", [16, 33, 100])
def test_chunks_give_the_same_path(encoder, chunk):
    rng = random.Random(chunk)
    t = pieces.SPACE + "".join(rng.choice("theraionsxé") for _ in range(400))
    whole = np.frombuffer(encoder.scan(t, 10**9), np.int32).tolist()
    assert np.frombuffer(encoder.scan(t, chunk), np.int32).tolist() == whole
    a, b, c = (encoder.matrix(t, i, j) for i, j in ((0, 100), (100, 250), (250, len(t))))
    left = ((a[:, :, None] + b[None]).max(1)[:, :, None] + c[None]).max(1)
    right = (a[:, :, None] + (b[:, :, None] + c[None]).max(1)[None]).max(1)
    assert np.array_equal(left, right)


def test_unigram_kind_takes_the_best_path(encoder):
    with open(pieces.MODEL, "rb") as f:
        m = pieces.Model(f.read())
    m.kind, m.whole = 1, np.ones_like(m.whole)
    e = pieces.Encoder(m)
    w = pieces.SPACE + "thereation"
    best = {0: (0.0, ())}
    for end in range(1, len(w) + 1):
        best[end] = max((best[s][0] + m.score[m.id_of[w[s:end]]], (*best[s][1], m.id_of[w[s:end]])) for s in range(max(0, end - m.longest), end) if w[s:end] in m.id_of)
    assert e._batch([w])[0] == list(best[len(w)][1])
    assert np.frombuffer(e.scan(w, 16), np.int32).tolist() == list(best[len(w)][1])


def test_encode_column(docs, corpus, empty):
    rows = pieces.encode_column(docs).collect()
    assert len(rows) == len(corpus) and all(len(r.tokens) == 0 for r in rows if not r.text)
    assert pieces.encode_column(empty).columns[-1] == "tokens" and pieces.encode_column(empty).count() == 0


# Section: 5: URLs


def test_urls(spark):
    rng = random.Random(1)
    data = ["https://a.Example.ORG/en/2?x", "http://x.example.org/es/9#t", "https://example.org/en/15", "http://z.com/fr/1", "http://z.com/de/1", "http://z.com/frx", "nothing", None, "", "http://y.org", "http://com.evil/fr/", "ftp://h.net:80/a?b/c", "a://b://c/d"]
    data += [f"http://good{rng.randrange(99)}.example.org/fr/{rng.randrange(99)}" for _ in range(60)] + [f"http://spam-pills{rng.randrange(99)}.com/de/{rng.randrange(99)}" for _ in range(60)]
    data += ["http://good7.example.net/fr/5", "http://spam-pills5.example.net/de/5"]
    df = spark.createDataFrame(list(enumerate(data)), "page_id long, url string").withColumn("host", F.lit("clash"))
    r = {x.page_id: x for x in urls.judge(df).collect()}
    assert [(r[i].host, r[i].path) for i in (0, 6, 7, 9, 11, 12)] == [("a.example.org", "/en/2"), ("", ""), ("", ""), ("y.org", ""), ("h.net:80", "/a"), ("b:", "//c/d")]
    assert [(r[i].rule, r[i].verdict) for i in range(5)] == [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
    assert r[5].rule is None and r[9].rule is None and r[10].rule is None
    assert {x.verdict for x in r.values()} == {"allow", "block"}
    assert (r[len(data) - 2].verdict, r[len(data) - 1].verdict) == ("allow", "block")
    assert urls.judge(df.where("false")).count() == 0
    assert {x.verdict for x in urls.judge(df.where("page_id = 6")).collect()} == {"allow"}  # nothing to learn from


def test_markov_is_a_distribution():
    m = urls.Markov(["abc.com/x", "abd.org/y1"])
    assert np.allclose(np.exp(m.log).reshape(-1, urls.SYMBOLS).sum(1), 1, atol=1e-4)


# Section: 6: SimHash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, corpus, empty):
    got = simhash.near_classes(simhash.with_fingerprints(docs, "doc_id")).collect()
    fp = [brute_fingerprint(r[1]) for r in corpus]
    near = [[(a ^ b).bit_count() <= 3 for b in fp] for a in fp]
    ids = [r[0] for r in corpus]
    lab = [i if i is not None else 10**9 for i in ids]
    for _ in range(len(lab)):
        lab = [min(lab[j] for j in range(len(lab)) if near[i][j]) for i in range(len(lab))]
    want = sorted((str(i), f, sum(n) - 1, str(c if c < 10**9 else None)) for i, f, n, c in zip(ids, fp, near, lab))
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1), r.n_near, str(r.component_id)) for r in got) == want
    assert simhash.near_classes(simhash.with_fingerprints(empty, "doc_id")).count() == 0


def test_near_pairs_loses_none(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for k in (1, 2, 3, 3, 4):
            x = b
            for bit in rng.sample(range(64), k):
                x ^= 1 << bit
            fps.add(x)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    df = spark.createDataFrame([(signed(v),) for v in fps], "fp long")
    got = sorted((r.a, r.b, r.distance) for r in simhash.near_pairs(df).collect())
    v = sorted(map(signed, fps))
    want = sorted((a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for i, a in enumerate(v) for b in v[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert got == want


def test_drop_near_duplicates(docs, corpus, empty):
    kept = simhash.drop_near_duplicates(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    assert 3 in ids and 40 not in ids and 41 not in ids and ids.count(2) == 1 and None in ids
    assert simhash.drop_near_duplicates(empty).count() == 0


# Section: 7: WebP


@pytest.mark.parametrize("text", [b"", b"a", b"a" * 64, b"ab" * 32, bytes(range(256)), "é日本".encode() * 99, bytes(64)])
def test_webp_round_trip(text):
    n, size, sha, crc, media, _, feature = webp.media_row(text)
    p = text + bytes(-len(text) % 64 if text else 64)
    assert (n, size, sha, crc) == (len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert webp.read_back(webp.store(p)).tobytes() == p and feature == webp.media_row(text)[6]


def test_webp_several_files(monkeypatch):
    monkeypatch.setattr(webp, "MAX_SIDE", 4)
    p = bytes(random.Random(0).randrange(256) for _ in range(64 * 11))
    assert webp.store(p).count(b"RIFF") == 3 and webp.read_back(webp.store(p)).tobytes() == p


def test_webp_columns(docs, corpus, empty):
    rows = {r.doc_id: r for r in webp.with_media(docs, media=True).collect()}
    assert rows[3].media_sha256 == rows[40].media_sha256 == hashlib.sha256(rows[3].media).hexdigest()
    assert webp.with_media(empty).count() == 0 and len(rows) == len({r[0] for r in corpus})


class Stream:
    """Writes VP8L streams by hand, with normal prefix codes of eight bits for every channel."""

    def __init__(self, w, h):
        self.w = webp._Writer()
        self.w.put(0x2F, 8)
        self.w.put(w - 1, 14)
        self.w.put(h - 1, 14)
        self.w.put(0, 4)

    def code(self, lengths):
        """A normal code: lengths are written with a fixed four-bit code of the values 0 .. 15."""
        self.w.put(0, 1)
        self.w.put(18 - 4 + 1, 4)
        for v in webp._ORDER:
            self.w.put(4 if v < 16 else 0, 3)
        self.w.put(0, 1)
        for n in lengths:
            self.w.bits += [n >> k & 1 for k in (3, 2, 1, 0)]
        out, code, last = {}, 0, 0
        for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
            code <<= n - last if last else 0
            out[s], last = (code, n), n
            code += 1
        return out

    def one(self, symbol):
        self.w.put(0b01, 2)
        self.w.put(1, 1)
        self.w.put(symbol, 8)

    def sym(self, table, s):
        code, n = table[s]
        self.w.bits += [code >> k & 1 for k in range(n - 1, -1, -1)]

    def small(self, values):
        """An inner image whose pixels differ in green only (no colour cache)."""
        self.w.put(0, 1)
        g = self.code([8] * 256 + [0] * 24)
        for v in (0, 0, 255, 0):
            self.one(v)
        for v in values:
            self.sym(g, v)

    def bytes(self):
        return webp._container(np.packbits(np.array(self.w.bits, np.uint8), bitorder="little").tobytes())


def literals(s, pixels, cache=0, size=280):
    """The four channel codes of a main image, then its literals."""
    g = s.code([9 if i >= 280 - 24 and False else 8 if i < 256 else 0 for i in range(size)])
    r, b, a = (s.code([8] * 256) for _ in range(3))
    s.one(0)
    for p in pixels:
        for t, shift in ((g, 8), (r, 16), (b, 0), (a, 24)):
            s.sym(t, p >> shift & 255)


def test_webp_decodes_literals_and_transforms():
    rng = random.Random(2)
    px = [rng.getrandbits(32) for _ in range(12)]
    s = Stream(4, 3)
    s.w.put(0, 3)  # no transform, no cache, one group
    literals(s, px)
    assert webp.decode(s.bytes()).ravel().tolist() == px
    s = Stream(4, 3)
    s.w.put(0b101, 3)  # subtract green
    s.w.put(0, 3)
    literals(s, px)
    want = [(p & 0xFF00FF00) | ((p >> 16) + (p >> 8) & 255) << 16 | ((p & 255) + (p >> 8 & 255) & 255) for p in px]
    assert webp.decode(s.bytes()).ravel().tolist() == want


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictors(mode):
    """Residuals made with the predictor of one mode come back to the pixels."""
    rng = random.Random(mode)
    w, h = 5, 4
    px = [rng.getrandbits(32) for _ in range(w * h)]
    res = []
    for i, p in enumerate(px):
        y, x = divmod(i, w)
        if not i:
            q = (255, 0, 0, 0)
        elif not y:
            q = webp._channels(px[i - 1])
        elif not x:
            q = webp._channels(px[i - w])
        else:
            q = webp._predict(mode, px[i - 1], px[i - w], px[i - w + 1], px[i - w - 1])
        a, r, g, b = (u - v & 255 for u, v in zip(webp._channels(p), q))
        res.append(a << 24 | r << 16 | g << 8 | b)
    s = Stream(w, h)
    s.w.put(0b001, 3)  # predictor
    s.w.put(1, 3)  # blocks of 8
    s.small([mode])
    s.w.put(0, 3)
    literals(s, res)
    assert webp.decode(s.bytes()).ravel().tolist() == px


def test_webp_cross_colour_and_palette():
    s = Stream(2, 1)
    s.w.put(0b011, 3)
    s.w.put(0, 3)
    s.small([32])  # green to blue: 32 / 32 = 1
    s.w.put(0, 3)
    literals(s, [0xFF000A03, 0xFF00FF10])
    assert webp.decode(s.bytes()).ravel().tolist() == [0xFF000A0D, 0xFF00FF0F]
    s = Stream(5, 1)
    s.w.put(0b111, 3)
    s.w.put(1, 8)  # two colours: eight pixels to a byte
    s.small([7, 9])
    s.w.put(0, 3)
    literals(s, [0xFF000000 | 0b10110 << 8])
    a, b = 0xFF000700, (0xFF000700 + 0x00000900 & 0xFFFFFFFF) & 0x00FFFFFF | ((255 + 255) & 255) << 24
    assert webp.decode(s.bytes()).ravel().tolist() == [a, b, b, a, b]


def test_webp_back_references_and_cache():
    s = Stream(4, 2)
    s.w.put(0, 1)  # no transform
    s.w.put(1, 1)  # a colour cache of 2 entries
    s.w.put(1, 4)
    s.w.put(0, 1)
    lengths = [0] * 282
    for sym in (10, 20, 256, 258, 280, 281):
        lengths[sym] = 3
    lengths[10] = lengths[20] = 2
    g = s.code(lengths)
    for v in (0, 0, 255):
        s.one(v)
    d = s.code([1, 1] + [0] * 38)
    p, q = 0xFF000A00, 0xFF001400
    s.sym(g, 10)
    s.sym(g, 20)
    slot = (0x1E35A7BD * p & 0xFFFFFFFF) >> 31
    s.sym(g, 280 + slot)  # from the cache
    got = p if slot != (0x1E35A7BD * q & 0xFFFFFFFF) >> 31 else q
    s.sym(g, 256)  # one pixel from distance code 2: the pixel before
    s.sym(d, 1)
    s.sym(g, 258)  # three from distance code 1: the row above
    s.sym(d, 0)
    s.sym(g, 20)
    assert webp.decode(s.bytes()).ravel().tolist() == [p, q, got, got, p, q, got, q]


def test_webp_damage_is_an_error():
    good = webp.encode_samples(np.arange(64, dtype=np.uint8).reshape(1, 64))
    for bad in (b"", good[:30], b"X" + good[1:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


# Section: 8: suffix arrays


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    rng = random.Random(seed)
    t = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(60))]
    assert suffixdedup.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_repeats_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "CROWD", 3)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    p = [text(700) for _ in range(3)]
    data = [text(100) + p[0] + text(50), text(30) + p[0][100:650], p[1] + text(20) + p[1], p[1][:390], p[1][:405], "z" * 900, None, "", text(500), p[2], p[2]]
    data += [text(40) + p[0][k * 9 : k * 9 + 480] + text(40) for k in range(12)]
    rows = list(enumerate(data)) + [(9, p[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.dedup_substrings(df).collect())
    raw = [(t or "").encode() for _, t in rows]
    count = {}
    for t in raw:
        for i in range(len(t) - 399):
            count[t[i : i + 400]] = count.get(t[i : i + 400], 0) + 1
    want = []
    for (i, _), t in zip(rows, raw):
        m = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if count[t[k : k + 400]] > 1:
                m[k : k + 400] = True
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        want.append((i, len(t), int(m.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()))
    assert got == sorted(want)
    assert suffixdedup.dedup_substrings(df.where("false")).count() == 0


# Section: 9: toxicity


def test_isotonic_and_trees():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.1 * rng.random(600) > 0.6).astype(int)
    m = toxicity.Boosted(trees=20).fit(x, y)
    assert ((m.raw(x) > 0) == y).mean() > 0.97
    xs, ps = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(ps) >= 0).all() and (np.diff(xs) > 0).all()


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        bad = rng.random() < 0.3
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 80))]
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "zzgrub", "scum"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "an idiot"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels + [(1002, None), (None, 1), (5, None)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, lab)
    out = toxicity.with_scores(docs, scorer).collect()
    truth = dict(labels)
    held = [r for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.95
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.drop_toxic(docs, lab).columns == docs.columns
    assert toxicity.with_scores(docs, toxicity.fit(docs, lab.where("false"))).agg(F.max("score")).first()[0] == 0
    assert toxicity.with_scores(docs.where("false"), scorer).count() == 0


# Section: 10: mixing


def test_targets_fill_by_weight(spark):
    s = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(s).collect()}
    # b and c are short of room at first: weights 1, 2, 3, 1 over 1110 words, a stops at 30, b at 300
    assert got == {"a": 30.0, "b": 300.0, "c": pytest.approx(780.0), None: 0.0}


def test_mix(spark, docs, corpus, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus) and all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in rows)
    size = {}
    for r in corpus:
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").split())
    top = max(r.size for r in rows)
    for s, n in size.items():
        mine = [r for r in rows if r.source == s]
        assert mine[0].source_size == n and abs(sum(r.taken for r in mine) - mine[0].target) <= top / 2 + 1
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(size.values()))
    again = sorted((str(r.doc_id), r.taken) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == sorted((str(r.doc_id), r.taken) for r in rows)
    assert mixing.mix(empty).count() == 0


def test_giant_texts_in_chunks(spark, monkeypatch, encoder):
    rng = random.Random(11)
    texts = ["".join(rng.choice("therion s\n") for _ in range(900)), "x" * 700, "a b  " * 200, "  " * 300, "é☃ " * 300 + "w" * 500, words(rng, 300), " lead " + "日本" * 200]
    texts += [texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: x.tolist() for i, x in enumerate(encoder.encode(texts))}
    keyed = df.select(F.col("doc_id").alias("k"), "text")
    for chunk, look in ((128, 24), (200, 100), (700, 16)):
        got = {r.k: np.frombuffer(bytes(r.ids), np.int32).tolist() for r in pieces.encode_giants(keyed, pieces.MODEL, chunk, look).collect()}
        assert got == want
    monkeypatch.setattr(pieces, "CHUNK", 600)  # sends the longer texts through the chunks
    got = {r.doc_id: r.tokens for r in pieces.encode_column(df).collect()}
    assert got == want
