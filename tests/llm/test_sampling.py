from pyspark.sql import functions as F

from stipple.llm.sampling import drawn_by_hash, sample_by_class


def test_tiny_shares_draw_their_share(spark):
    """A share far below one in a million still draws, by the hash's leading bits."""
    n = 4_000_000
    got = spark.range(n).where(drawn_by_hash(20 / n, "id")).count()
    assert 2 <= got <= 60
    assert spark.range(100).where(drawn_by_hash(1.0, "id")).count() == 100 and spark.range(100).where(drawn_by_hash(0.0, "id")).count() == 0


def test_two_thousand_classes(spark):
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("c"), (F.col("id") % 2000).cast("string")).alias("lang"))
    rows = rows.unionByName(spark.range(100_000, 200_000).select(F.col("id").alias("doc_id"), F.lit("c7").alias("lang")))
    drawn, share = sample_by_class(rows, "lang", 40)
    counts = {r.lang: r["count"] for r in drawn.groupBy("lang").count().collect()}
    assert len(share) == len(counts) == 2000 and all(counts[c] == 30 for c in counts if c != "c7") and 15 <= counts["c7"] <= 80
    assert drawn.columns == ["doc_id", "lang"]
