"""The stages of the corpus pipeline one after the other on a small corpus."""

import random

import corpus_pipeline as cp
from arbora.llm import pieces


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        t = words(rng.randrange(40, 90))
        bad = i % 4 == 0
        if bad:
            t += " you idiot you moron you scum " + words(3)
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(bad)))
    passage = words(60)
    rows += [(300 + i, words(50) + "\n" + passage + "\n" + words(50), "en", "s0", 0) for i in range(3)]
    rows += [(400, rows[1][1], "en", "s1", 0), (401, rows[2][1] + " tail", "en", "s1", 0), (402, None, None, None, None), (403, "", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = []
    for i, (name, f) in enumerate(cp.STAGES):
        docs = f(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out.append(docs)
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {r[0] for r in rows} - set(range(0, 240, 4))
    kept = {r.doc_id for r in out[0].collect()}
    assert len(clean - kept) <= 1 and len(kept - clean) <= 1
    text = {r.doc_id: r.text for r in out[1].collect()}
    assert passage in text[300] and passage not in text[301] and passage not in text[302] and text[400] == ""
    left = {r.doc_id for r in out[2].collect()}
    assert 1 in left and 300 in left and len(left & {400, 402, 403}) == 1
    sizes = {r.doc_id: len((r.text or "").split()) for r in out[2].collect()}
    assert abs(out[3].count() - len(left)) < len(left) and {r.doc_id for r in out[3].collect()} <= left and sizes
    with open(pieces.MODEL, "rb") as f:
        enc = pieces.Encoder(pieces.Model(f.read()))
    want = {r.doc_id: enc.encode([r.text or ""])[0].tolist() for r in out[3].collect()}
    last = out[4].collect()
    assert len(last) == out[3].count() and all(r.tokens == want[r.doc_id] and r.n_tokens == len(r.tokens) for r in last)
    assert sorted(r.doc_id for r in cp.run(spark, str(tmp_path)).collect()) == sorted(r.doc_id for r in last)
