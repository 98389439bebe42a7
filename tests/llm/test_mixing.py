import duckdb
from stipple.llm import mixing


def rows(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken, r.source) for r in df.collect()), key=str)


def brute_targets(sizes):
    """Shares what is left by weight among the sources below their caps, again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, target, open_ = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_against_brute_force(spark):
    docs = [(i, "w " * (1 + i * 7 % 13), s) for i in range(400) for s in [["a", "b", "é", None, "zz"][min(4, i % 17 // 3)]]] + [(1000, "x " * 5, "tiny"), (1001, None, "none"), (1002, "", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.with_copies(df).collect()
    sizes = {}
    for _, text, s in docs:
        sizes[s] = sizes.get(s, 0) + len((text or "").split())
    want, taken = brute_targets(sizes), {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(docs)
    assert all(abs(taken[s] - want[s]) <= max(3 * 13, 0.02 * want[s]) for s in want)


def test_equals_sql_and_reruns_agree(spark, sf_dir):
    docs = duckdb.sql(f"SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(duckdb.sql(mixing.ORACLE_SQL.replace("FROM documents", "FROM docs")).fetchall(), key=str)
    got = rows(mixing.query(spark, sf_dir))
    assert got == sorted(((a, b, c, round(d, 6), e, f) for a, b, c, d, e, f, _ in want), key=str)
    assert got == rows(mixing.query(spark, sf_dir))


def test_emitted_rows_keep_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b", "s", 9, "c"), (1, "a b", "s", 9, "c"), (2, None, None, 9, "c")], "doc_id long, text string, source string, copies int, size string")
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert mixing.mix(df.limit(0)).collect() == []
    counts = mixing.with_copies(df).groupBy().sum("taken").first()[0]
    assert sum(len((r.text or "").split()) for r in out.collect()) == counts
