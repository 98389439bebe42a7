import random
import zlib
from collections import Counter

import numpy as np
import pytest
from stipple.llm import toxicity as tox

BAD = ["grotface", "slimewit", "dungbrain"]


def corpus(n=600, seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    docs, labels = [], []
    for d in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        bad = d % 4 == 0
        if bad:
            for _ in range(max(2, len(words) // 20)):
                words.insert(rng.randint(0, len(words)), rng.choice(BAD))
        docs.append((d, " ".join(words).capitalize()))
        labels.append((d, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_ranges(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, label string")
    lab = spark.createDataFrame([(d, 1, t) for d, t in labels], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in tox.with_score(df, lab).collect()}
    truth = dict(labels)
    held = [d for d in got if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(held) > 100 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[d] >= tox.THRESHOLD) == truth[d] for d in held]) > 0.95


def test_held_out_labels_and_ids_do_not_matter(spark):
    docs, labels = corpus(200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    flip = [(d, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, t in labels]
    a, b = ({r.doc_id: r.score for r in tox.with_score(df, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flip))
    assert a == b


def test_edge_cases(spark):
    docs, labels = corpus(200)
    docs += [(1000, None), (1001, ""), (1002, "123 !"), (None, "no id"), (5, "twice"), (1003, "aei " * 100_000)]
    labels += [(5, 0), (None, 1), (77_777, 1), (6, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = tox.with_score(df, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1000, 1001, 1002)}) == 1
    assert {r.score for r in tox.with_score(df, lab.limit(0)).collect()} == {0.0}
    assert {r.score for r in tox.with_score(df, lab.where("toxic = 1")).collect()} == {1.0}
    assert tox.with_score(df.limit(0), lab).collect() == []


def brute_ratio(rows, text):
    """Evidence of a text by models that are written out as dictionaries. rows: (label, text), one of each family."""
    n = [Counter(), Counter()]
    for label, t in rows:
        w = tox.words_of(t)
        n[label].update(set(zip(["", *w], w)))
    c = [Counter(w for _, w in n[k]) for k in (0, 1)]
    left = Counter(w for _, w in {*n[0], *n[1]})

    def discount(counts):
        k = Counter(counts)
        return k[1] / (k[1] + 2 * k[2]) if k[1] and k[2] else 0.5

    d = discount(left.values())
    shared = {w: (k - d) / sum(left.values()) + d * len(left) / sum(left.values()) / (len(left) + 1) for w, k in left.items()}
    unseen = d * len(left) / sum(left.values()) / (len(left) + 1)
    words = [w for w in left if max(c[0][w], c[1][w]) >= tox.MIN_LEFT]
    pairs = [x for x in {*n[0], *n[1]} if max(n[0][x], n[1][x]) >= tox.MIN_DOCS]

    def probability(k, v, w):
        total, off, top = sum(c[k].values()), discount(c[k].values()), discount(n[k].values())
        own = {x: max(c[k][x] - off, 0) / total for x in words}
        low = own.get(w, 0) + (1 - sum(own.values())) * shared.get(w, unseen)
        after = max(1, sum(m for (a, _), m in n[k].items() if a == v))
        mine = {x: max(n[k][x] - top, 0) / after for x in pairs if x[0] == v}
        return mine.get((v, w), 0) + (1 - sum(mine.values())) * low

    w = tox.words_of(text)
    return np.mean([np.log(1 - tox.MIX + tox.MIX * probability(1, a, b) / probability(0, a, b)) for a, b in zip(["", *w], w)]), probability, [*left]


def test_models_agree_with_written_out_ones_and_sum_to_one(spark):
    docs, labels = corpus(60, 9)
    rows = [(lab, " ".join(t.split()[:40])) for (_, t), (_, lab) in zip(docs, labels)]
    model, unseen = tox.entries(tox.pair_counts(spark.createDataFrame(rows, "label int, text string")))
    asked = [rows[0][1], rows[3][1], "grotface slimewit", "never seen words of any kind", rows[5][1] + " dungbrain"]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate([*asked, "", None])], "i int, text string")
    got = {r.i: r.x for r in tox.with_evidence(texts, "x", model, unseen).collect()}
    dealt = {r.i: r.x for r in tox.with_evidence(texts, "x", model, unseen, shipped=0).collect()}
    for i, t in enumerate(asked):
        want, probability, words = brute_ratio(rows, t)
        assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert got[5] == got[6] == 0 and dealt == pytest.approx(got)
    for k in (0, 1):
        for v in ("", words[0], "never"):
            assert sum(probability(k, v, w) for w in words) + probability(k, v, "never") == pytest.approx(1)


def test_an_expression_of_fixed_context_and_one_of_ordinary_words(spark):
    """Two toxic expressions: a word that always follows the same one, and two ordinary words in a row."""
    docs, labels = corpus(800, 12)
    rng = random.Random(1)
    out = []
    for (d, t), (_, lab) in zip(docs, labels):
        words = [w for w in t.split() if w.lower() not in BAD]
        if lab:
            for _ in range(max(2, len(words) // 20)):
                words.insert(rng.randint(0, len(words)), rng.choice(["utterly vilemug", "sae tun"]))
        out.append((d, " ".join(words)))
    df, lab = spark.createDataFrame(out, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in tox.with_score(df, lab).collect()}
    held = [(d, t) for d, t in labels if tox_fold(d)]
    assert np.mean([(got[d] >= tox.THRESHOLD) == t for d, t in held]) > 0.95
    assert np.mean([got[d] >= tox.THRESHOLD for d, t in held if t]) > 0.9


def tox_fold(d):
    return zlib.crc32(str(d).encode()) % tox.FOLDS == tox.HELD_OUT


def test_near_copies_are_one_family(spark):
    rng = random.Random(2)
    words = [f"w{''.join(rng.choice('abcde') for _ in range(5))}" for _ in range(300)]
    texts = [" ".join([*words, "x" * k]) for k in range(1, 9)] + [" ".join(rng.sample(words, 300)) for _ in range(8)] + ["a b", "a b", "a c", ""]
    rows = [(i, 1, *tox.families(tox.hashes_of(t))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, label int, f0 long, f1 long, f2 long")
    kept = {r.doc_id for r in tox.one_of_each_family(df).collect()}
    assert kept == {0, *range(8, 16), 16, 18, 19}


@pytest.mark.parametrize("folder, recall, precision", [("sf0.01", 0.5, 0.8), ("sf0.1", 0.88, 0.9)])
def test_held_out_labels_of_the_table(spark, folder, recall, precision):
    """Held-out documents of the test tables. Some 11% of the labels outside English sit on a few expressions each, too few at sf0.01."""
    folder = f"/root/testdata/{folder}"
    got = {r.doc_id: r for r in tox.query(spark, folder).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [d for d in labels if got[d].held_out]
    caught = sum(got[d].predicted for d in held if labels[d])
    assert caught >= recall * sum(labels[d] for d in held)
    assert caught >= precision * sum(got[d].predicted for d in held)


def test_a_large_model_is_read_and_no_document_shuffled(spark, monkeypatch):
    """Beyond the size that is shipped, scores agree and the plan over the documents moves none of them."""
    monkeypatch.setattr(tox, "GROUP_WORDS", 500)
    docs, labels = corpus(300, 7)
    df = spark.createDataFrame([*docs, (900, None), (901, "aei " * 2_000)], "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    df = tox.materialize(df, "t")
    a, b = (tox.with_score(df, lab, shipped=n) for n in (1 << 20, 0))
    assert {r.doc_id: r.score for r in b.collect()} == pytest.approx({r.doc_id: r.score for r in a.collect()})
    assert "Exchange" not in b._jdf.queryExecution().executedPlan().toString()


def test_pairs_in_bounded_pieces(spark, monkeypatch):
    docs, labels = corpus(40, 3)
    rows = spark.createDataFrame([(lab, t) for (_, t), (_, lab) in zip(docs, labels)], "label int, text string").coalesce(1)
    whole = {r[:2]: r[2:] for r in map(tuple, tox.pair_counts(rows).collect())}
    monkeypatch.setattr(tox, "FLUSH_PAIRS", 30)
    assert {r[:2]: r[2:] for r in map(tuple, tox.pair_counts(rows).collect())} == whole and len(whole) > 1000


def test_only_the_model_stays_in_the_scratch_folder(spark):
    from stipple import scratch

    docs, labels = corpus(200)
    before = len(scratch._made)
    tox.learned(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in scratch._made[before:]}
    assert left == {"toxic-labels", "toxic-model"}
