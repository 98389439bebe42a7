import hashlib

import duckdb
from stipple.llm import warc
from stipple.llm.common import scratch_dir

BIG = "<p>" + "é" * 60
ROWS = [(5, "http://a/\r\nX: y", BIG), (2, "http://b", BIG), (9, None, BIG), (1, "u", None), (3, "v", ""), (4, "w", "short"), (6, "x", "short"), (None, "n", BIG), (2, "again", BIG), (8, "long", "y" * 3_000_000)]


def test_round_trip_and_index(spark):
    df = spark.createDataFrame([(*r, "c") for r in ROWS], "page_id long, url string, html string, digest string").repartition(2)
    uri = scratch_dir(spark, "w")
    index = warc.write_archives(df, uri)
    got = sorted(map(tuple, warc.read_records(index, uri).collect()), key=str)
    want = []
    for page_id, _, html in ROWS:
        data = (html or "").encode()
        revisit = html == BIG and page_id != 2
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert got == sorted(want, key=str)
    one = warc.read_records(index.where("url = 'w'"), uri).collect()
    assert [r.page_id for r in one] == [4]
    assert {r.url for r in index.collect()} == {u or "" for _, u, _ in ROWS}


def test_all_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "a", BIG), (None, "b", BIG)], "page_id long, url string, html string")
    uri = scratch_dir(spark, "w")
    assert {(r.record_type, r.refers_to) for r in warc.read_records(warc.write_archives(df, uri), uri).collect()} == {("response", None)}
    uri = scratch_dir(spark, "w")
    assert warc.read_records(warc.write_archives(df.limit(0), uri), uri).collect() == []


def test_ranges_merge_neighbours():
    assert [len(g) for g in warc.ranges([(0, 10), (10, 5), (100_000, 5), (100_010, warc.RANGE_BYTES)])] == [2, 1, 1]


def test_equals_sql(spark, sf_dir):
    pages = duckdb.sql(f"SELECT * FROM '{sf_dir}/pages.parquet'")
    want = duckdb.sql(warc.ORACLE_SQL.replace("FROM pages", "FROM '%s/pages.parquet'" % sf_dir)).fetchall()
    assert sorted(map(tuple, warc.query(spark, sf_dir).collect()), key=str) == sorted(want, key=str) and len(pages.columns) == 3
