import random

import pytest
from stipple.llm import decontamination as dc
from stipple.llm.editing import Pattern


def edit(a, b, free=False):
    """Plain dynamic programme; free: against the best substring of b."""
    row = [0 if free else j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) if free else row[-1]


def test_myers_against_dynamic_programme():
    rng = random.Random(1)
    for _ in range(400):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        assert Pattern(a).distance(b) == edit(a, b)
        assert Pattern(a).best(b)[0] == edit(a, b, free=True)


def brute(docs, items, rate=dc.RATE, least=dc.MIN_WORDS):
    out = {}
    for d, text in docs:
        for i, item in items:
            w = dc.words_of(item or "")
            if len(w) >= least and text:
                dist = edit(w, dc.words_of(text), free=True)
                if dist <= int(len(w) * rate):
                    out[d, i] = min(dist, out.get((d, i), 999))
    return out


def spoil(words, k, rng):
    words = list(words)
    for _ in range(k):
        at = rng.randrange(len(words))
        match rng.randrange(3):
            case 0:
                words[at] = "zzz"
            case 1:
                del words[at]
            case 2:
                words.insert(at, "qq")
    return words


def test_edited_passages_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 60)))) for i in range(30)] + [(77, None), (78, ""), (5, "same id other text of seven words"), (None, "an item that has no id at all here")]
    docs = []
    for d in range(150):
        body = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            item = dc.words_of(rng.choice(items)[1] or "")
            if item:
                at = rng.randint(0, len(body))
                body[at:at] = spoil(item, rng.randint(0, max(1, len(item) // 3)), rng)
        docs.append((d, rng.choice([" ", "\n", ", ", " - "]).join(body).title()))
    docs += [(1000, None), (1001, ""), (1002, "x " * 20_000 + (items[0][1] or "")), (None, "so AN item, that has NO id at-all here"), (3, "an item that has no id at all here")]
    df = spark.createDataFrame([(*x, 5) for x in docs], "doc_id long, text string, distance int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in dc.matches(df, bench).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 60
    hit = {d for d, _ in want}
    kept = dc.without_matches(df, bench)
    assert kept.columns == df.columns
    want_kept = [d for d, t in docs if not brute([(d, t)], items)]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want_kept, key=str) and hit


def test_blocks_and_empty_tables(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"item number {i} has some words a{i} b{i} c{i}") for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before ITEM number {i}, has some words a{i} b{i} c{i} after") for i in range(9)], "doc_id long, text string")
    one = sorted(map(tuple, dc.matches(docs, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK_CHARS", 100)
    assert sorted(map(tuple, dc.matches(docs, bench).collect())) == one and {(d, i) for d, i, *_ in one} >= {(i, i) for i in range(9)}
    assert dc.matches(docs, bench.limit(0)).collect() == [] and dc.matches(docs.limit(0), bench).collect() == []
    assert dc.without_matches(docs, bench.limit(0)).count() == 9 and dc.without_matches(docs, bench).count() == 0


@pytest.mark.parametrize("table", ["documents"])
def test_whole_table_against_brute_force(spark, sf_dir, table):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.distance for r in dc.query(spark, sf_dir).collect()}
    # the plain programme is slow: all pairs that share five words in a row, and all others' first documents
    grams = lambda t: {tuple(w[i : i + 3]) for w in [dc.words_of(t or "")] for i in range(len(w) - 2)}
    of_items = [(i, t, grams(t)) for i, t in items]
    near = [(d, t, i, x) for d, t in docs for g in [grams(t)] for i, x, gi in of_items if len(g & gi) > 4]
    want = {}
    for d, t, i, x in near:
        want |= brute([(d, t)], [(i, x)])
    assert got == want


def test_short_items_and_scripts_without_spaces(spark):
    item = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed"
    bench = spark.createDataFrame([(1, "Quick brown Fox"), (2, item), (3, "\u3053\u308c\u306f\u4f55")], "item_id long, text string")
    spoilt = item.replace("\u597d", "\u574f")
    docs = spark.createDataFrame([(1, "a quick, brown fox ran"), (2, f"\u4ed6\u8bf4{item}\u5427"), (3, f"\u4ed6\u8bf4{spoilt}\u5427"), (4, "a quick red fox"), (5, "\u3053\u308c\u306f\u4f55\u3067\u3059\u304b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.distance) for r in dc.matches(docs, bench).collect()) == [(1, 1, 0), (2, 2, 0), (3, 2, 1), (5, 3, 0)]
    assert [r.doc_id for r in dc.without_matches(docs, bench).collect()] == [4]
