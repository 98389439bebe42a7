import numpy as np
import pytest
from pyspark.sql import functions as F
from stipple.llm import neighbours as nn


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    x, ids = np.array([v for _, v in good]), np.array([i for i, _ in good])
    out = {}
    for i, v in good:
        if i % every == 0:
            s = (x * v).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores_on_the_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(nn, "LEAF_ROWS", 16)
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = found(nn.query(spark, sf_dir)), brute(rows, nn.EVERY, nn.K)
    assert got.keys() == want.keys()
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for q in want:
        true = dict(want[q])
        assert len(got[q]) == nn.K and all(abs(s - true[i]) < 1e-12 for i, s in got[q] if i in true)


def test_copies_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(nn, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(4)
    same = [0.5, -0.25, 1.0]
    rows = [(i, same) for i in range(60)] + [(100 + i, rng.normal(size=3).round(2).tolist()) for i in range(60)]
    rows += [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 2.0]), (260, [float("nan"), 1.0, 1.0]), (280, [float("inf"), 1.0, 1.0]), (300, []), (320, [1.0, 2.0]), (None, same)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, leaf int").repartition(3)
    got = found(nn.search(df, F.col("vec_id") % 20 == 0, recall=1.0))
    rows32 = [(i, None if v is None or len(v) != 3 else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute(rows32, 20, nn.K)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_rows_than_asked_for(spark, n):
    df = spark.createDataFrame([(20 * i, [float(i), 1.0]) for i in range(n)], "vec_id long, embedding array<float>")
    got = found(nn.search(df, F.col("vec_id") % 20 == 0))
    assert all(len(v) == n - 1 for v in got.values()) and len(got) == (n if n > 1 else 0)


def test_tree_order_is_complete():
    x = np.random.default_rng(1).normal(size=(3000, 8))
    tree = nn.Tree(x, 20)
    order = list(tree.leaves(x[0]))
    assert sorted(order) == list(range(tree.n_leaves)) and tree.n_leaves > 50
    assert np.bincount(tree.leaf_of(x), minlength=tree.n_leaves).sum() == 3000


def test_queries_are_answered_in_bounded_pieces(spark, monkeypatch):
    """Each query of a batch visits every leaf: no task lists its visits with the vectors, and pieces change nothing."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(700)] + [(700 + i, [1.0, 2.0, -1.0, 0.5]) for i in range(300)] + [(40, [9.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for name, value in (("LEAF_ROWS", 16), ("BLOCK_ROWS", 9), ("ANSWERED", 7), ("PAIRS_AT_ONCE", 11)):
        monkeypatch.setattr(nn, name, value)
    out = nn.search(df, F.col("vec_id") % 10 == 0, recall=1.0)
    got = found(out)
    want = {}
    for q in {i for i, _ in rows if i % 10 == 0}:
        v = np.array(min(v for i, v in rows if i == q))
        s = sorted((-float((np.array(x) * v).sum()), i) for i, x in rows if i != q)[: nn.K]
        want[q] = [i for _, i in s]
    assert {q: [i for i, _ in r] for q, r in got.items()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "block" not in plan
