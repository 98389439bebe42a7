"""The test tables seen as spatial data, in Spark and as SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PointCloudDataset, SpaceDefinition, build_dataset_metadata
from ..operators.voxel import empty_grid

NATIVE = SpaceDefinition("native", "las", ["x", "y", "z"], "zero_based", "voxel", [600, 1500, 30], [1.0, 1.0, 5.0])
ANALYSIS = SpaceDefinition("analysis", "las", ["x", "y", "z"], "zero_based", "voxel", [30, 75, 8], [20.0, 20.0, 20.0])
#: Axes in another order, one of them reversed, and other resolutions.
TURNED = SpaceDefinition("turned", "sra", ["x", "y", "z"], "one_based", "voxel", [15, 300, 500], [10.0, 2.0, 3.0])
STACK = SpaceDefinition("stack", "las", ["x", "y", "z"], "zero_based", "voxel", [400, 300, 8], [1.0, 1.0, 5.0])
STACK_COARSE = SpaceDefinition("stack_coarse", "las", ["x", "y", "z"], "zero_based", "voxel", [40, 30, 4], [10.0, 10.0, 10.0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str, event_type: str | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events")
    if event_type:
        events = events.where(F.col("event_type") == event_type)
    e = F.col("event_id")
    return events.select(
        (e + 1).alias("detection_id"), (e % 7 + 1).alias("seg_num"), F.floor("value").cast("long").alias("x"), F.col("user_id").cast("long").alias("y"), (F.day("ts") - 1).cast("long").alias("z"),
        F.col("value").cast("double").alias("x_float"), F.col("user_id").cast("double").alias("y_float"), (e % 50 + 1).alias("area_px"), (e % 100 / 100).alias("eccentricity"),
    )


DET = """det AS (SELECT event_id + 1 AS detection_id, event_id % 7 + 1 AS seg_num, floor(value)::BIGINT AS x, user_id AS y, (day(ts) - 1)::BIGINT AS z,
  value AS x_float, user_id::DOUBLE AS y_float, event_id % 50 + 1 AS area_px, (event_id % 100)::DOUBLE / 100 AS eccentricity, event_type FROM events)"""


def dataset(points: DataFrame, space: SpaceDefinition = NATIVE, kind: str = "point_centroids") -> PointCloudDataset:
    return PointCloudDataset("subject", points, build_dataset_metadata(space, kind))


def annotation(spark: SparkSession, space: SpaceDefinition = ANALYSIS) -> DataFrame:
    """A label for every voxel of the grid: 0 is background, the others are nations' ids."""
    return empty_grid(spark, space).select("vx", "vy", "vz", ((F.col("vx") * 7 + F.col("vy") * 3 + F.col("vz")) % 26).alias("label"))


def hemisphere(spark: SparkSession, space: SpaceDefinition = ANALYSIS) -> DataFrame:
    return empty_grid(spark, space).select("vx", "vy", "vz", F.when(F.col("vx") < space.shape[0] // 2, 1).otherwise(2).cast("long").alias("label"))


def signal(spark: SparkSession, space: SpaceDefinition = ANALYSIS) -> DataFrame:
    return empty_grid(spark, space).select("vx", "vy", "vz", ((F.col("vx") + F.col("vy") * 5 + F.col("vz") * 11) % 8 / 8).alias("value"))


ANN = """ann AS (SELECT a.range AS vx, b.range AS vy, c.range AS vz, (a.range * 7 + b.range * 3 + c.range) % 26 AS label,
  CASE WHEN a.range < 15 THEN 1 ELSE 2 END AS side, ((a.range + b.range * 5 + c.range * 11) % 8)::DOUBLE / 8 AS signal FROM range(30) a, range(75) b, range(8) c)"""


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations (from 1) below regions (from 101) below a root."""
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("id"), (F.col("n_regionkey") + 101).cast("long").alias("parent_id"), F.substring("n_name", 1, 4).alias("acronym"), F.col("n_name").alias("name"), F.format_string("#%06X", F.col("n_nationkey").cast("int") * 1000).alias("color"))
    regions = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 101).cast("long").alias("id"), F.lit(1000).cast("long").alias("parent_id"), F.substring("r_name", 1, 4).alias("acronym"), F.col("r_name").alias("name"), F.lit("#FFFFFF").alias("color"))
    root = spark.range(1).select(F.lit(1000).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("root").alias("acronym"), F.lit("root").alias("name"), F.lit("#FFFFFF").alias("color"))
    return nations.unionByName(regions).unionByName(root)


ONT = """ont AS (SELECT n_nationkey::BIGINT + 1 AS id, n_regionkey::BIGINT + 101 AS parent_id, substr(n_name, 1, 4) AS acronym, n_name AS name, printf('#%06X', n_nationkey * 1000) AS color FROM nation
  UNION ALL SELECT r_regionkey::BIGINT + 101, 1000, substr(r_name, 1, 4), r_name, '#FFFFFF' FROM region
  UNION ALL SELECT 1000, NULL, 'root', 'root', '#FFFFFF')"""


def level_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.lit("region").alias("level"), (F.col("r_regionkey") + 101).cast("long").alias("id"))


def signal_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pixels (x, y, z, value)."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 400).alias("x"), (F.col("l_suppkey") * 7 % 300).alias("y"), F.col("l_linenumber").cast("long").alias("z"))
    return rows.distinct().withColumn("value", F.lit(1))


PIX = "pix AS (SELECT DISTINCT l_partkey % 400 AS x, l_suppkey * 7 % 300 AS y, l_linenumber::BIGINT AS z FROM lineitem)"


def label_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a stack (z, y, x, label): the distinct ones, in square patches of one label each."""
    rows = signal_pixels(spark, sf_dir)
    return rows.select("z", "y", "x", (F.floor(F.col("x") / 20) * 100 + F.floor(F.col("y") / 20) + 1).cast("long").alias("label"))


LAB = PIX + ", lab AS (SELECT z, y, x, (floor(x / 20) * 100 + floor(y / 20) + 1)::BIGINT AS label FROM pix)"


def members(points: DataFrame, size: int) -> DataFrame:
    """Objects of so many consecutive detections."""
    return points.select(F.floor((F.col("detection_id") + size - 1) / size).cast("long").alias("object_id"), "detection_id")


def cleaned_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with shape columns, in the native grid."""
    e = F.col("detection_id")
    return detections(spark, sf_dir).select(
        e.alias("object_id"), "x", "y", "z", (e % 3 + 1).alias("n_detections"), (e % 2 + 1).alias("n_planes"), F.col("area_px").cast("double").alias("mean_area_px"), F.col("eccentricity").alias("mean_eccentricity")
    )


OBJ = DET + """, obj AS (SELECT detection_id AS object_id, x, y, z, detection_id % 3 + 1 AS n_detections, detection_id % 2 + 1 AS n_planes, area_px::DOUBLE AS mean_area_px, eccentricity AS mean_eccentricity FROM det)"""
