import re

import numpy as np
import pytest
import xxhash
from stipple.llm import simhash
from stipple.llm.components import connected_components


def brute_fingerprint(text, k=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=2, k=3):
    fps = [(d, brute_fingerprint(t, k)) for d, t in rows]
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= radius and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    first = {}
    for (d, _), c in zip(fps, label):
        first[c] = min([x for x in (first.get(c), d) if x is not None], default=None)
    return sorted(((d, f"{f:016x}", first[c]) for (d, f), c in zip(fps, label)), key=str)


TEXTS = [None, "", " \n", "One", "one", "Two words", "ÉTÉ à Paris x y\x0bz", "a b c d e f g", "A B C D E F G", "\x1ca b c d", "w " * 5000]


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id").collect()), key=str)


def test_edge_cases_against_brute_force(spark):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(None, "one"), (None, "alone here now"), (7, "one"), (7, "one")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").repartition(3)
    assert got(simhash.near_duplicates(df)) == brute_components(rows)
    assert got(simhash.near_duplicates(df.limit(0))) == []


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.query(spark, sf_dir).collect()), key=str) == brute_components(rows)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(4000)) + "\n  tail Words"
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "CHUNK", 50)
    assert simhash.fingerprint(text.encode()) == whole == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_links_against_brute_force(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "QUERIES", 37)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2)
    codes = {int(c) for c in base}
    for c in base:  # clusters, some of them large
        for _ in range(60):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                c = c ^ np.uint64(1 << int(b))
            codes.add(int(c))
    codes |= {0, 1, 2**64 - 1, 2**63}
    codes = sorted(codes)
    want = {frozenset((a, b)) for i, a in enumerate(codes) for b in codes[:i] if (a ^ b).bit_count() <= radius}
    arr = np.array(codes, np.uint64)
    found = [(int(x), int(y)) for t in range(radius + 1) for a, b in simhash.table_pairs(arr, t, radius) for x, y in zip(a, b)]
    assert len(found) == len(want) and {frozenset(p) for p in found} == want
    if radius == 2:
        for crowd in (simhash.CROWD, 5):  # undivided and divided blocks give the same links, each once
            monkeypatch.setattr(simhash, "CROWD", crowd)
            df = spark.createDataFrame([(simhash.signed(c),) for c in codes], "fp long")
            found = [frozenset((r.u % 2**64, r.v % 2**64)) for r in simhash.links(df, radius).collect()]
            assert set(found) == want and len(found) == len(want)
        df = spark.createDataFrame([(simhash.signed(c),) for c in codes], "fp long")
        pairs = simhash.links(df, radius).collect()
        assert {frozenset((r.u % 2**64, r.v % 2**64)) for r in pairs} == want and len(pairs) == len(want)
        assert all(r.distance == ((r.u ^ r.v) % 2**64).bit_count() for r in pairs)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 199), (199, 200)]
    df = spark.createDataFrame(edges, "u long, v long")
    found = {r.node: r.root for r in connected_components(df).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 140)} | {200: 199}
    assert connected_components(df.limit(0)).collect() == []


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for w in [t.lower().split()] for i in range(max(1, len(w) - k + 1))} for t in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_near_copies_of_edited_texts(spark, monkeypatch, crowd):
    import random

    monkeypatch.setattr(simhash, "CROWD", crowd)

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    docs, group = [], {}
    for g in range(60):
        base = [word() for _ in range(rng.randint(150, 400))]
        for copy in range(rng.choice([1, 1, 2, 3, 12])):
            words = list(base)
            for _ in range(copy and rng.randint(0, len(words) // 120)):
                words[rng.randrange(len(words))] = word()
            docs.append((len(docs) * 3, " ".join(words)))
            group[docs[-1][0]] = g
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, key string").repartition(3)
    out = simhash.without_near_copies(df)
    assert out.columns == df.columns
    left = [r.doc_id for r in out.collect()]
    assert {group[d] for d in left} == set(range(60))  # nothing else is lost
    text = dict(docs)
    missed = [(a, b) for a in left for b in left if a < b and jaccard(text[a], text[b]) >= 0.85]
    assert len(missed) <= 1
    for d in left:
        same = [e for e in group if text[e] == text[d]]
        assert d == min(same)


def test_near_copies_edge_cases(spark):
    rows = [(5, None), (4, ""), (3, "  "), (9, "Same text here"), (2, "same  TEXT here"), (7, "other words stay"), (None, "same text here"), (None, None), (8, "w " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id for r in simhash.without_near_copies(df).collect()), key=str)
    assert got == sorted([3, 2, 7, 8, None, None], key=str)
    assert simhash.without_near_copies(df.limit(0)).collect() == []


def test_sketch_links_pairs_of_one_fingerprint(spark):
    """Texts of equal words in another order share every view, and the sketch keeps them apart."""
    words = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(reversed(words))), (3, " ".join(words[:-1] + ["w199x"]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_copies(df).collect()) == [1, 2]


def test_views_are_dealt_a_few_at_a_time(spark, monkeypatch):
    """One shuffle holds few views of a class and goes before the next; the copies that stay do not depend on their number."""
    import random

    rng = random.Random(21)
    docs = []
    for d in range(30):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        docs += [(3 * d, " ".join(words)), (3 * d + 1, " ".join([*words, "end"])), (3 * d + 2, " ".join(words).upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen, dealt = [], simhash.dealt_to_tables

    def counted(rows, *more):
        if "view" in rows.columns:
            seen.append({r.view for r in rows.select("view").distinct().collect()})
        return dealt(rows, *more)

    monkeypatch.setattr(simhash, "dealt_to_tables", counted)
    stay = {r.doc_id for r in simhash.near_copies(df).collect()}
    assert max(map(len, seen)) <= simhash.VIEWS // 4 and sorted(v for s in seen for v in s) == list(range(simhash.VIEWS))
    monkeypatch.setattr(simhash, "VIEWS_AT_ONCE", simhash.VIEWS)
    assert {r.doc_id for r in simhash.near_copies(df).collect()} == stay and not any(d % 3 for d in stay)
