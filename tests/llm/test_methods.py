"""What the operators promise beyond their results: work that is saved, columns that may clash, very long
texts, and results against independent versions."""

import bisect
import hashlib
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arbora.llm import common, linededup, lmscore, mixing, pieces, simhash, topk, toxicity, urls, webp

WHITE = b" \t\n\r\x0b\x0c"


# Section: 1: line dedup


def lines(rng, n, size=30):
    return ["".join(rng.choice("abcdefgh") + " " for _ in range(size)) + str(rng.random()) for _ in range(n)]


def pairwise(rows, least):
    """Every later document aligned with every earlier one, in order of the ids."""
    out = {}
    for j, (_, text) in enumerate(rows):
        split = text.split("\n")
        words = [len(x.split()) for x in split]
        gone = set()
        for _, first in rows[:j]:
            a, b = ([x if x.split() else "" for x in t.split("\n")] for t in (first, text))
            if a == b and sum(words):
                gone |= set(range(len(split)))
            elif sum(words) >= least:
                code = {x: i for i, x in enumerate(dict.fromkeys(a + b))}
                gone |= set(linededup.aligned_lines([code[x] for x in a], [code[x] for x in b], words, least))
        out[rows[j][0]] = "\n".join(x for i, x in enumerate(split) if i not in gone)
    return out


@pytest.mark.parametrize("least", [25, 1])
def test_lines_as_by_all_pairs(spark, least):
    rng = random.Random(least)
    pool = lines(rng, 12) + ["short one", "}", "", "\t \t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 5))) + "\n" + lines(rng, 1)[0]) for i in range(25)]
    rows += [(30, rows[4][1]), (31, "tiny"), (32, "tiny"), (33, pool[0] + "\n" + pool[1]), (34, pool[1] + "\n" + pool[0]), (35, pool[1] + "\n" + pool[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df, min_words=least).collect()}
    assert got == pairwise(rows, least)


def test_lines_keep_other_columns(spark):
    text = "\n".join(lines(random.Random(1), 3))
    names = ["k", "_gone", "_lost", "_row", "n_removed", "gone", "c", "fk"]
    df = spark.createDataFrame([(i, text, *range(8)) for i in range(2)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    out = linededup.dedup_lines(df)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == df.columns and rows[1].text == "" and rows[0].text == text
    assert all(r[n] == i for r in rows.values() for i, n in enumerate(names))


def test_alignment_of_texts_that_repeat_is_fast():
    a = [i % 7 for i in range(40_000)]
    assert sum(n for _, _, n in linededup.patience(a, a[3:] + [9, 9])) > 39_000


# Section: 2: language-model scores


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_words_are_told_apart(monkeypatch, piece):
    monkeypatch.setattr(lmscore, "_PIECE", piece)
    rng = random.Random(piece)
    texts = [bytes(rng.choice(b"aAbB\xc3\xa9 \t\n\x0b") for _ in range(rng.randrange(60))) for _ in range(80)] + [b"", b"x" * 300, b"x", b"X x"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    h, doc = lmscore.word_hashes(data, np.cumsum([0, *map(len, texts)]))
    want = [(i, w) for i, t in enumerate(texts) for w in t.lower().split()]
    assert doc.tolist() == [i for i, _ in want]
    named = {}
    for x, (_, w) in zip(h.tolist(), want):
        assert named.setdefault(w, x) == x
    assert len(set(named.values())) == len(named)


def test_what_is_sent_comes_back():
    cols = [np.array([0, 5, 2**63 + 1, 2**64 - 1], np.uint64), np.array([], np.uint64), np.array([7], np.uint64)]
    got = lmscore._expand(lmscore._squeeze(cols), [4, 0, 1])
    assert all(np.array_equal(a, b) for a, b in zip(cols, got))


# Section: 3: exact top-k


def test_thresholds_save_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(-60, 60, (20, 64))
    rows = np.concatenate([c + rng.integers(-4, 5, (200, 64)) for c in centres])
    blobs = [b"\x02" + r.astype("<i2").tobytes() for r in rows]
    ids, k = np.arange(len(rows)), 20
    block = topk.Block(ids, blobs, k)
    q = rows[::40].astype(np.int64)
    cutoff = np.array([s[k - 1] for s in block.gather(ids[::40], q)], float)
    block.scored = 0
    qi, ci, score = block.collect(ids[::40], q, cutoff)
    full = q @ rows.T
    for i, x in zip(ids[::40], full):
        want = sorted(((-int(s), int(j)) for j, s in enumerate(x) if j != i))[:k]
        assert [(-int(s), int(j)) for a, j, s in zip(qi, ci, score) if a == i] == want
    assert block.scored < 0.75 * topk.LISTS * full.size


def test_large_components_stay_exact(spark):
    rows = [(i, [2**20 * (i % 5 - 2), -(2**21) * i, 3 - i]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_k(df.where("vec_id = 20"), df, 4).orderBy("rank").collect()
    want = sorted(((-sum(a * b for a, b in zip(rows[20][1], v)), i) for i, v in rows if i != 20))[:4]
    assert [(-r.score, r.vec_id) for r in got] == want


# Section: 4: SentencePiece


def test_products_of_matrices_are_associative_and_find_the_way():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 5, 12)
    ms = [np.where(rng.random((a, b)) < 0.8, rng.integers(-9, 0, (a, b)), -np.inf) for a, b in zip(sizes, sizes[1:])]
    one = ms[0]
    for m in ms[1:]:
        one = pieces.multiply(one, m)
    assert np.array_equal(pieces.tree_product(ms), one)
    for r, c in ((None, None), (0, 0)):
        way = pieces.chain(ms, r, c)
        total = sum(m[i, j] for m, (i, j) in zip(ms, way))
        assert all(a[1] == b[0] for a, b in zip(way, way[1:]))
        assert total == (one.max() if r is None else one[0, 0]) or one[0, 0] == -np.inf


def test_documents_as_the_library_encodes_them():
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    sp = __import__("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t or "" for t in __import__("pyarrow.parquet").parquet.read_table(path).column("text").to_pylist()]
    with open(pieces.MODEL, "rb") as f:
        e = pieces.Encoder(pieces.Model(f.read()))
    assert all(ids.tolist() == sp.encode(t) for t, ids in zip(texts, e.encode(texts)))


def test_forgotten_words_are_worked_out_again(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    with open(pieces.MODEL, "rb") as f:
        e = pieces.Encoder(pieces.Model(f.read()))
    rng = random.Random(3)
    texts = ["  ".join("".join(rng.choice("thea") for _ in range(3)) for _ in range(9)) for _ in range(30)]
    whole = [x.tolist() for x in e.encode(texts)]
    assert [e.encode([t])[0].tolist() for t in texts] == whole


def test_tokens_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, _text long, _k long, ids long")
    r = pieces.encode_column(df).first()
    assert (r["_text"], r["_k"], r["ids"]) == (5, 6, 7) and len(r.tokens)


# Section: 5: URLs


def judged(data):
    """The verdicts of urls.judge by plain Python."""
    def host_path(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        end = min([rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0] or [len(rest)])
        return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in rest[:cut]), rest[cut:end]

    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    out, seen = [], {"allow": set(), "block": set()}
    for u in data:
        host, path = host_path(u)
        fits = [r for r in rules if (host == (h := r[: r.index("/")]) or host.endswith("." + h)) and path.startswith(r[r.index("/") :])]
        rule = max(fits, key=len, default=None)
        out.append([host, path, rule, rules.get(rule)])
        if rule:
            seen[rules[rule]].add(u)
    symbol = urls.TABLE.tolist()

    def learn(texts):
        count = {}
        for t in texts:
            s = [0] * urls.ORDER + [symbol[b] for b in t.encode()]
            for i in range(urls.ORDER, len(s)):
                for n in range(urls.ORDER + 1):
                    row = count.setdefault(tuple(s[i - n : i]), {})
                    row[s[i]] = row.get(s[i], 0) + 1

        def prob(context, c):
            shorter = prob(context[1:], c) if context else 1 / urls.SYMBOLS
            row = count.get(context)
            return (row.get(c, 0) + len(row) * shorter) / (sum(row.values()) + len(row)) if row else shorter

        return prob

    def scorer(good, bad):
        g, b = learn(good), learn(bad)

        def score(t):
            s = [0] * urls.ORDER + [symbol[x] for x in t.encode()]
            return sum(math.log(g(tuple(s[i - 3 : i]), s[i]) / b(tuple(s[i - 3 : i]), s[i])) for i in range(3, len(s))) / max(1, len(s) - 3)

        return score

    return out, seen, scorer


def test_urls_against_plain_python(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 9)))
    data = [f"https://{name()}.Org/{name()}?q={rng.randrange(9)}" for _ in range(40)] + [f"http://{name()}.com/de/{name()}#{name()}" for _ in range(40)]
    data += [f"http://x.example.org/en/{i}" for i in range(12)] + [f"ftp://{name()}.net/{'fr' if i % 2 else 'de'}/{name()}" for i in range(20)]
    data += [None, "", "x", "://", "http://a.com/fr/?", "z" * 100_000, data[0], data[0]]
    df = spark.createDataFrame(list(enumerate(data)), "page_id long, url string").withColumn("_url", F.lit(3)).withColumn("_said", F.lit(4))
    got = [(r.host, r.path, r.rule, r.verdict, r.score, r["_url"], r["_said"]) for r in urls.judge(df).orderBy("page_id").collect()]
    want, seen, scorer = judged(data)
    assert [list(g[:3]) for g in got] == [w[:3] for w in want] and all(g[3] == w[3] for g, w in zip(got, want) if w[2])
    assert {g[5:] for g in got} == {(3, 4)}
    score = scorer(sorted(seen["allow"]), sorted(seen["block"]))
    for u, g in zip(data, got):
        if g[2] is None:
            assert g[4] == pytest.approx(score((u or "")[:500]) if u is None or len(u) < 500 else g[4], abs=1e-4)


def plain_threshold(g, b):
    """The threshold of urls.best_threshold for the scores of both classes, by plain Python."""
    at = sorted({*g, *b})
    edges = [at[0] - 1, *((x + y) / 2 for x, y in zip(at, at[1:])), at[-1] + 1]
    g, b = sorted(g), sorted(b)
    right = [(len(g) - bisect.bisect_left(g, e)) / len(g) + bisect.bisect_left(b, e) / len(b) for e in edges]
    best = [e for e, r in zip(edges, right) if r >= max(right) - 1e-12]
    return best[len(best) // 2]


def test_url_models_learn_from_all(spark):
    """22,000 URLs of one class: scores and verdicts are those of models and a threshold from all of them."""
    rng = random.Random(9)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    good = sorted({f"http://{word('abcdefgh')}.org/{word('aeiou')}" for _ in range(22_000)})
    bad = sorted({f"http://{word('defghijk')}.com/de/{word('aeioux')}" for _ in range(300)})
    other = [f"http://{word('abcdefghijk')}.net/{word('aeioux')}" for _ in range(400)]
    df = spark.createDataFrame([(u,) for u in [*good, *bad, *other]], "url string")
    got = {r.url: r for r in urls.judge(df).where("rule IS NULL").collect()}
    held = lambda u: int(hashlib.md5(u.encode()).hexdigest()[:8], 16) % 5 == 0
    first = np.subtract(*(urls.Markov([u for u in x if not held(u)]).log for x in (good, bad)))
    threshold = plain_threshold(*(np.round(urls.score_urls([u for u in x if held(u)], first), 9).tolist() for x in (good, bad)))
    ratio = urls.Markov(good).log - urls.Markov(bad).log
    want = urls.score_urls(other, ratio)
    assert [got[u].score for u in other] == pytest.approx(want.tolist(), abs=1e-9)
    assert [got[u].verdict for u in other] == ["allow" if s >= threshold else "block" for s in want]
    assert {r.verdict for r in got.values()} == {"allow", "block"}


@pytest.mark.parametrize("seed", range(3))
def test_url_threshold_over_ranges(spark, seed):
    """Many equal scores and several best intervals, ordered in several partitions; one class all above; one class all below."""
    rng = random.Random(seed)
    g = [rng.randrange(40) / 8 + (0, 0, 9)[seed] for _ in range(60)]
    b = [rng.randrange(40) / 8 + (0, 9, 0)[seed] for _ in range(60)]
    rows = [(s, g.count(s), b.count(s)) for s in {*g, *b}]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert urls.best_threshold(spark.createDataFrame(rows, "s double, good long, bad long")) == plain_threshold(g, b)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


# Section: 7: WebP


def media_cases():
    rng = random.Random(5)
    some = lambda n, k: bytes(rng.randrange(k) for _ in range(n))
    row = some(64, 256)
    return {
        "palette": [b"", b"ab" * 32, some(3000, 2), some(3000, 4), some(3000, 16), b"x" * 100_000],
        "left": [bytes(i % 251 for i in range(9000)), bytes(i * 7 % 256 for i in range(64 * 30))],
        "top": [b"".join(bytes((b + k) % 256 for b in row) for k in range(100))],
        "none": [some(5000, 256), b"a line of text that repeats itself with variations 0123456789\n" * 200, "the quick brown fox é ".encode() * 4000, "".join(chr(rng.randrange(97, 123)) for _ in range(200_000)).encode()],
    }


def test_stored_texts_go_through_the_transforms():
    """Each kind of text is stored by the transform that suits it, with references where it repeats, and comes back."""
    used, referred = {}, 0
    for name, cases in media_cases().items():
        for t in cases:
            p = t + bytes(-len(t) % 64 if t else 64)
            kind, _, copies = webp.plan(np.frombuffer(p, np.uint8).reshape(-1, 64))
            used[kind] = used.get(kind, 0) + 1
            referred += bool(copies)
            assert webp.read_back(webp.store(p)).tobytes() == p
            assert kind == name or name == "none"
    assert set(used) == {"palette", "left", "top", "none"} and referred == 2


def test_stretches_of_a_stream_meet(monkeypatch):
    monkeypatch.setattr(webp, "_STRETCH", 64)
    for cases in media_cases().values():
        for t in cases:
            p = (t + bytes(-len(t) % 64 if t else 64))[: 64 * 200]
            assert webp.read_back(webp.store(p)).tobytes() == p


def test_predictors_in_one_go_equal_pixel_by_pixel():
    rng = np.random.default_rng(1)
    px = rng.integers(0, 2**32, 35, dtype=np.uint64).astype(np.uint32)
    for mode in (1, 2):
        even = webp._undo_predictor(px, 7, 5, 9, np.array([mode << 8], np.uint32))
        odd = webp._undo_predictor(px, 7, 5, 2, np.array([mode << 8] * 4, np.uint32))
        slow, out = px.tolist(), []
        for i, v in enumerate(slow):
            y, x = divmod(i, 7)
            q = (255, 0, 0, 0) if not i else webp._channels(out[i - 1]) if not y or (x and mode == 1) else webp._channels(out[i - 7])
            a, r, g, b = (u + w & 255 for u, w in zip(webp._channels(v), q))
            out.append(a << 24 | r << 16 | g << 8 | b)
        assert even.tolist() == odd.tolist() == out


@pytest.mark.parametrize("at", [30, 60, -40])
def test_damaged_streams_raise(at):
    m = webp.store(b"some text that is long enough to have a code of its own 0123456789 ABCDEFG" + bytes(54))
    with pytest.raises(ValueError):
        webp.decode(m[:at] if at > 0 else m[:20] + m[40:])


def test_code_lengths_are_complete_and_short():
    for counts in ([1], [5, 0, 1], [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765], list(range(1, 281))):
        n = webp._code_lengths(np.array(counts), 9)
        assert n.max() <= 9 and (sum(counts) == counts[0] or (2.0 ** -n[n > 0]).sum() == 1)


# Section: 6, 9, 10: clashing names, long texts


def test_near_duplicates_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", 5, 6, 7), (2, "a b c d", 5, 6, 7)], "doc_id long, text string, _key long, _n long, _text long")
    rows = simhash.drop_near_duplicates(df).collect()
    assert [tuple(r) for r in rows] == [(1, "a b c d", 5, 6, 7)]


def test_scores_keep_other_columns_and_take_long_texts(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["good", "tree", "you", "idiot"] if i % 2 else ["good", "tree", "leaf"]) for _ in range(30)), 9) for i in range(80)]
    rows += [(100, "idiot you " * 60_000, 9), (101, "z" * 300_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text long")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    out = toxicity.with_scores(df, toxicity.fit(df, labels)).collect()
    assert all(r["_text"] == 9 and 0 <= r.score <= 1 for r in out) and {r.doc_id: r.score for r in out}[100] > 0.5


def test_mix_keeps_other_columns_and_sorts_little(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(1, 9), f"s{i % 2}", 1, 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _size long, _end long")
    out = mixing.mix(df)
    assert all((r["_size"], r["_end"]) == (1, 2) for r in out.collect())
    keys = spark.range(200_000).select(mixing.range_of(mixing.key_of(F.col("id"), F.lit(0).cast("long"), F.lit(0))).alias("r"), (F.col("id") % 2).alias("q"))
    assert keys.groupBy("r").count().agg(F.max("count")).first()[0] < 200_000 / 500


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a long, A_ long, b long")
    assert common.fresh(df, "a", "b", "c", "c") == ["a__", "b_", "c", "c_"]


def test_mixing_equals_a_sort_of_each_source(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([0, 1, 5, 300]), rng.choice(["a", "b", None, "c"]), "x") for i in range(500)] + [(7, "w w", "a", "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mix(df).collect()

    def key(i, text):
        u = (int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        n = len(text.split())
        mean = len(text) / max(n, 1)
        return -math.log(u) / (0.1 + 0.9 * min(1.0, n / 200) * (1.0 if 3 <= mean <= 13 else 0.5))

    for s in {r[2] for r in rows}:
        mine = [r for r in got if r.source == s]
        size, target = mine[0].source_size, mine[0].target
        epochs = int(target // size)
        before, want = 0, []
        for i, t, _, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (key(r[0], r[1]), r[0], len(r[1].split()))):
            n = len(t.split())
            want.append((i, n, n * (epochs + (epochs < 3 and 2 * before + n <= 2 * (target - epochs * size)))))
            before += n
        assert sorted((r.doc_id, r.size, r.taken) for r in mine) == sorted(want)


def test_arrow_types_of_texts():
    assert common.texts_of(pa.array(["é", None, ""])) == ["é".encode(), b"", b""]
