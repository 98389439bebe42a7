"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every source gets a target number of words. Each of its documents is expected ``target / source size`` times; the
expectations are prefix-summed within the source, one random offset is added, and a document is emitted once for
each integer boundary that its interval crosses. Whole documents are taken, so a source's words miss its target
by a few documents' size at most; ordering documents by size class keeps that error small.

Defined cases: a null text has size 0, as an empty one; a null source is a source of its own, after all others; a
source without words has target 0 and nothing is taken from it; rows that share a doc_id are sampled as separate
documents; an empty table gives an empty result. Columns besides doc_id, text and source are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

#: Weight of the i-th source in code point order: 1, 2, 3, repeating.
WEIGHT_CYCLE = 3
#: No target exceeds this many times its source's size, so that no document is repeated more often.
MAX_REPEAT = 3
#: Leading hex digits of md5(doc_id) that split a source's size class into separately sorted groups.
SPLIT_DIGITS = 2
SEED = 20260


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Monotone in size; sizes of one class differ by less than an eighth."""
    bits = F.length(F.bin(size))
    return (bits * 16 + F.expr(f"shiftright(__size, greatest(length(bin(__size)) - 4, 0))")).cast("int")


def source_targets(sized: DataFrame) -> DataFrame:
    """(__sk, source_size, target) per source. ``sized`` has __sk and __size.

    Targets are the water level: sources sorted by cap / weight, the level is where the uncapped ones take all that is left.
    One row per source enters the windows below, never one per document.
    """
    totals = sized.groupBy("__sk").agg(F.sum("__size").alias("source_size"))
    every = Window.partitionBy()
    weighed = totals.withColumn("__rn", F.row_number().over(every.orderBy("__sk"))).withColumn("__w", (F.col("__rn") - 1) % WEIGHT_CYCLE + 1)
    cap = F.col("source_size") * MAX_REPEAT
    order = every.orderBy("__ratio", "__rn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        weighed.withColumn("__ratio", cap.cast("double") / F.col("__w"))
        .withColumn("__left", F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("__w_left", F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0)))
        .withColumn("__level", F.col("__left").cast("double") / F.col("__w_left"))
    )
    first = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__rn", "__level"))).over(every)
    return levels.withColumn("__at", first["__level"]).select(
        "__sk", "source_size", F.least(cap.cast("double"), F.col("__w") * F.col("__at")).alias("target")
    )


def with_copies(docs: DataFrame, seed: int = SEED, narrow: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken.

    narrow: keep doc_id and source only, and store them once, so that texts are read once and never shuffled.
    """
    offset = random.Random(seed).random()
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = docs.withColumn("__size", n_words(F.col("text"))).withColumn("__sk", F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("z")))
    if narrow:
        sized = materialize(sized.select("doc_id", "source", "__sk", "__size"), "mix-sizes")
    sized = sized.withColumn("__class", size_class(F.col("__size"))).withColumn("__md5", key).withColumn("__hh", F.substring("__md5", 1, SPLIT_DIGITS))
    group = ["__sk", "__class", "__hh"]
    targets = source_targets(sized.select("__sk", "__size"))
    counts = sized.groupBy(*group).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__sk").orderBy("__class", "__hh").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .join(targets, "__sk")
        .withColumn("__rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .drop("__n")
    )
    ranked = sized.withColumn("__row", F.row_number().over(Window.partitionBy(*group).orderBy("__md5", "doc_id", "__size")))
    rank = F.col("__base") + F.col("__row")
    crossed = F.floor(rank * F.col("__rate") + offset) - F.floor((rank - 1) * F.col("__rate") + offset)
    return (
        ranked.join(groups, group)
        .withColumn("copies", F.least(crossed, F.ceil("__rate")).cast("int"))
        .withColumn("size", F.col("__size"))
        .withColumn("taken", F.col("copies") * F.col("__size"))
        .drop("__md5", "__hh", "__class", "__row", "__base", "__rate", "__sk", "__size")
    )


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as it was drawn, with the columns of ``docs``."""
    names = docs.columns
    inner = docs.select(F.col("doc_id"), F.col("text"), F.col("source"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row_in"))
    drawn = with_copies(inner, seed, narrow=False).where(F.col("copies") > 0)
    return drawn.select("__row_in", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("__i")).select("__row_in.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def mixing_sql(docs: str = "documents", seed: int = SEED) -> str:
    """CTEs ending in ``mixed`` (all columns of ``docs`` and those of the query), in DuckDB's dialect."""
    offset = random.Random(seed).random()
    return f"""
sized AS (SELECT *, coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS sz FROM {docs}),
keyed AS (SELECT *, length(bin(sz)) * 16 + (sz >> greatest(length(bin(sz)) - 4, 0)) AS cls,
  md5(coalesce(doc_id::VARCHAR, '')) AS h FROM sized),
totals AS (SELECT source AS src, sum(sz)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1 AS w FROM totals),
levels AS (SELECT *, (3 * source_size)::DOUBLE / w AS ratio,
  (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
   / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS lvl
  FROM weighed WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT src, source_size, least((3 * source_size)::DOUBLE, w * (SELECT lvl FROM levels WHERE lvl <= ratio ORDER BY ratio, src NULLS LAST LIMIT 1)) AS target FROM levels),
ranked AS (SELECT k.*, row_number() OVER (PARTITION BY source ORDER BY cls, h, doc_id, sz) AS rn FROM keyed k),
rated AS (SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.src),
mixed AS (SELECT *, least(floor(rn * rate + {offset!r}) - floor((rn - 1) * rate + {offset!r}), ceil(rate))::INT AS copies FROM rated)"""


ORACLE_SQL = f"""WITH {mixing_sql()}
SELECT doc_id, sz AS size, source_size, target, (copies * sz)::BIGINT AS taken, source, copies FROM mixed"""
