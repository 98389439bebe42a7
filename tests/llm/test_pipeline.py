import numpy as np
import pytest
from test_simhash import jaccard
from test_tokens import expected

import corpus_pipeline as cp
from stipple.llm import decontamination, mixing, simhash, tokens, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs)
    for _, f in cp.STAGES:
        out.append(cp.materialize(f(spark, out[-1], sf_dir), "t"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_records"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, sf_dir, stages):
    before, after = texts(stages[0]), texts(stages[1])
    scores = {r.doc_id: r.score for r in toxicity.with_score(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert after == {d: t for d, t in before.items() if scores[d] < toxicity.THRESHOLD}
    assert len(after) > 0.8 * len(before)


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[1]), texts(stages[2])
    gone = set(before) - set(after)
    assert all(any(jaccard(before[g] or "", before[k] or "") > 0.6 for k in before if k != g) for g in gone)
    kept = list(after.values())
    assert len({" ".join((t or "").lower().split()) for t in kept}) == len(kept)


def test_contaminated_documents_go(spark, sf_dir, stages):
    hits = {r.doc_id for r in decontamination.matches(stages[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert texts(stages[3]) == {d: t for d, t in texts(stages[2]).items() if d not in hits}


def test_mixture_holds_each_document_as_often_as_drawn(stages):
    want = {r.doc_id: r.copies for r in mixing.with_copies(stages[3]).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == want and max(got.values()) <= 3


def test_tokens_of_the_mixture_and_run(spark, sf_dir, stages):
    rows = sorted((r.doc_id, r.text) for r in stages[4].collect())
    got = sorted(map(tuple, stages[5].select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == expected(rows)
    again = cp.run(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, again), key=lambda r: r[1]) == got and np.all([r[2] >= 1 for r in got])
    assert simhash.VIEWS and tokens.SHARD_BYTES
