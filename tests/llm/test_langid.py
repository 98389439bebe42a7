import random
import zlib

import numpy as np
from stipple.llm import langid


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ö"], "cc": ["eau", "oi", "ç", "que"]}
    out = []
    for d in range(n):
        lang = ["aa", "bb", "cc"][d % 3]
        out.append((d, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), lang))
    return out


def test_held_out_accuracy(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 3 == 1]
    assert len(held) > 50 and np.mean([got[d].lang_pred == lang for d, _, lang in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_lang_does_not_matter(spark):
    docs = corpus(120)
    hide = [(d, t, None if zlib.crc32(str(d).encode()) % 3 == 1 else lang) for d, t, lang in docs]
    a, b = (sorted(map(tuple, langid.identify(spark.createDataFrame(x, "doc_id long, text string, lang string")).collect())) for x in (docs, hide))
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b])


def test_edge_cases(spark):
    docs = [*corpus(60), (500, None, "aa"), (501, "", "aa"), (502, "12 !", None), (None, "kalo mitu", "zz"), (3, "again", None), (503, "kalomi " * 300_000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    assert len(got) == len(docs)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (500, 501, 502)} == {("und", 0.0)}
    assert [r.lang_pred for r in got if r.doc_id == 503] == ["aa"]
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df.lang.substr(0, 0)).where("doc_id < 500")).collect()} == {""}
    assert {r.lang_pred for r in langid.identify(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert langid.identify(df.limit(0)).collect() == []


def test_presence_of_long_texts_in_pieces(monkeypatch):
    text = " ".join(chr(97 + i % 23) * 2 + chr(97 + i % 19) + "é" + chr(97 + i % 17) for i in range(500))
    whole = langid.presence(text)
    monkeypatch.setattr(langid, "PIECE", 37)
    assert (langid.presence(text) == whole).all() and whole.sum() > 50
