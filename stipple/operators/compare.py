"""Point tables against each other: multiset differences and legacy files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import with_dense_ids
from ..model import POINT_COLUMNS, require_columns

COMPARED = ["seg_num", "x", "y", "z"]


def load_canonical_pointcloud_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with at least the point columns, as longs."""
    df = spark.read.csv(str(path), header=True)
    require_columns(df, POINT_COLUMNS, "point cloud CSV")
    return df.withColumns({c: F.col(c).cast("double").cast("long") for c in POINT_COLUMNS})


def load_legacy_centroids_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV seg_num, x, y, z whose x holds rows and y columns: swapped here, and numbered from 1 in file order."""
    header = spark.read.text(str(path)).first()
    if header is None or [c.strip() for c in header[0].split(",")] != COMPARED:
        raise ValueError(f"legacy CSV must have exactly the columns {COMPARED}")
    rows = spark.read.schema("seg_num double, x double, y double, z double").csv(str(path), header=True)
    rows = rows.select(F.monotonically_increasing_id().alias("__at"), F.col("seg_num").cast("long"), F.col("y").cast("long").alias("x"), F.col("x").cast("long").alias("y"), F.col("z").cast("long"))
    return with_dense_ids(rows, ["__at"], "detection_id").select(*POINT_COLUMNS)


def relabel_slices_in_natural_order(df: DataFrame) -> DataFrame:
    """z as 1-based dense rank; the ranks are made from the distinct planes only."""
    ranks = with_dense_ids(df.select("z").distinct(), ["z"], "__rank")
    return df.join(ranks, "z").withColumn("z", F.col("__rank")).drop("__rank").select(df.columns)


def compare_counts(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Full outer join of the two tables' row counts by (seg_num, x, y, z)."""
    n = lambda df, name: df.groupBy(*COMPARED).agg(F.count("*").alias(name))
    return n(ours, "python_count").join(n(theirs, "matlab_count"), COMPARED, "full_outer").fillna(0, ["python_count", "matlab_count"])


def surplus(counts: DataFrame, side: str) -> DataFrame:
    """Rows that one side has more often, with the difference."""
    a, b = ("python_count", "matlab_count") if side == "python" else ("matlab_count", "python_count")
    return counts.where(F.col(a) > F.col(b)).withColumn("difference", F.col(a) - F.col(b))


def comparison_report(counts: DataFrame) -> DataFrame:
    """One row. Keys that both have but not equally often add nothing to exact_matches."""
    p, m = F.col("python_count"), F.col("matlab_count")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    report = counts.agg(
        total(p).alias("python_rows"), total(m).alias("matlab_rows"), total(F.when(p == m, p)).alias("exact_matches"),
        total(F.when(p > m, p - m)).alias("python_only_rows"), total(F.when(m > p, m - p)).alias("matlab_only_rows"),
    )
    shared = F.least("python_rows", "matlab_rows").alias("shared_rows")
    same = ((F.col("python_only_rows") == 0) & (F.col("matlab_only_rows") == 0)).alias("all_rows_match")
    return report.select("python_rows", "matlab_rows", shared, "exact_matches", "python_only_rows", "matlab_only_rows", same)


def compare_pointcloud_tables(ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, rows only or more often in ours, the same for theirs)."""
    counts = compare_counts(ours, theirs)
    return comparison_report(counts), surplus(counts, "python"), surplus(counts, "matlab")
