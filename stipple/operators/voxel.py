"""Points and signal onto grids: counts, densities, denominators, fractions. All maps are sparse (vx, vy, vz, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coordinates import check_same_axes, keep_in_grid, map_between_grids, rebin_index, zero_based_xyz
from ..model import PointCloudDataset, ProcessingProvenance, SpaceDefinition, VoxelMap, in_grid

VOXEL = ["vx", "vy", "vz"]
#: Point kinds that voxelize_to_space takes.
CENTROID_TYPES = ("point_centroids", "cleaned_objects")


def empty_grid(spark: SparkSession, space: SpaceDefinition, dtype: str = "long") -> DataFrame:
    """Every voxel of a grid with value 0; made from ranges on the executors."""
    axes = [spark.range(n).withColumnRenamed("id", v) for v, n in zip(VOXEL, space.shape)]
    return axes[0].crossJoin(F.broadcast(axes[1])).crossJoin(F.broadcast(axes[2])).withColumn("value", F.lit(0).cast(dtype))


def densify(voxels: DataFrame, space: SpaceDefinition) -> DataFrame:
    """A sparse map with its zeros written out."""
    grid = empty_grid(voxels.sparkSession, space).drop("value")
    return grid.join(voxels, VOXEL, "left").fillna(0, ["value"])


def accumulate_count_map(voxels: DataFrame, space: SpaceDefinition) -> DataFrame:
    """Rows per voxel of the grid; rows outside don't count. One aggregation with partial sums before the shuffle."""
    return keep_in_grid(voxels, space).groupBy(*VOXEL).agg(F.count("*").alias("value"))


def points_in_target(dataset: PointCloudDataset, target: SpaceDefinition) -> DataFrame:
    """vx, vy, vz in the target grid of every point, in the grid or not, from its integer columns."""
    source = dataset.space
    check_same_axes(source, target)
    columns = [rebin_index(c, s, t).alias(v) for c, v, s, t in zip(zero_based_xyz(source), VOXEL, source.resolution_um, target.resolution_um)]
    return dataset.points.select(*columns)


def voxelize_point_centroids_to_count_map(dataset: PointCloudDataset, target: SpaceDefinition) -> VoxelMap:
    """Counts of points per target voxel; the sidecar has what was put in, kept and left out."""
    kind = dataset.metadata.representation
    counts = accumulate_count_map(points_in_target(dataset, target), target)
    about = counts.agg(F.count("*").alias("nonzero_voxels"), F.coalesce(F.sum("value"), F.lit(0)).alias("total_count"))
    summary = voxelization_summary(dataset, target).crossJoin(about).first().asDict()
    parameters = {"source_kind": kind.kind, "source_representation_type": kind.representation_type, "target_space_name": target.space_name}
    provenance = ProcessingProvenance("voxelize_to_space", dataset.subject_name, parameters, summary)
    metadata = dataset.metadata.derived("count_map", provenance, kind="voxel_map", space=target, value_units="objects_per_voxel")
    return VoxelMap(dataset.subject_name, counts, metadata)


def voxelization_summary(dataset: PointCloudDataset, target: SpaceDefinition) -> DataFrame:
    """One row: input_points, kept_points, dropped_points."""
    inside = F.count(F.when(in_grid(target), 1))
    return points_in_target(dataset, target).agg(F.count("*").alias("input_points"), inside.alias("kept_points"), (F.count("*") - inside).alias("dropped_points"))


def voxelize_to_space(dataset: PointCloudDataset, target: SpaceDefinition) -> VoxelMap:
    kind = dataset.metadata.representation.representation_type
    if kind not in CENTROID_TYPES:
        raise NotImplementedError(f"no voxelization of {kind!r} points")
    return voxelize_point_centroids_to_count_map(dataset, target)


def validate_counts(counts: VoxelMap) -> None:
    if counts.metadata.representation.representation_type != "count_map":
        raise ValueError("a count_map is needed")
    v = F.col("value").cast("double")
    bad = counts.voxels.agg(F.count(F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 1)).alias("odd"), F.count(F.when(v < 0, 1)).alias("negative")).first()
    if bad["odd"]:
        raise ValueError("counts must be finite")
    if bad["negative"]:
        raise ValueError("counts must not be negative")


def count_map_to_density_map(counts: VoxelMap, validate: bool = True) -> VoxelMap:
    """float32(count) / float32(voxel volume in mm3)."""
    if validate:
        validate_counts(counts)
    density = (F.col("value").cast("float") / F.lit(counts.space.voxel_volume_mm3).cast("float")).cast("float")
    volume, before = counts.space.voxel_volume_mm3, counts.metadata.representation
    found = counts.voxels.select(*VOXEL, density.alias("value"))
    total = counts.voxels.agg(F.coalesce(F.sum(F.col("value").cast("double")), F.lit(0.0)).alias("total_count"))
    top = found.agg(F.count(F.when(F.col("value") != 0, 1)).alias("nonzero_voxels"), F.coalesce(F.max("value").cast("double"), F.lit(0.0)).alias("max_density_objects_per_mm3"))
    summary = total.crossJoin(top).first().asDict()
    parameters = {"source_representation_type": before.representation_type, "source_value_units": before.value_units, "voxel_volume_mm3": volume}
    metadata = counts.metadata.derived("density_map", ProcessingProvenance("count_map_to_density_map", counts.subject_name, parameters, summary), value_units="objects_per_mm3")
    return VoxelMap(counts.subject_name, found, metadata)


def denominator_axes(spark: SparkSession, source: SpaceDefinition, target: SpaceDefinition) -> list[DataFrame]:
    """Per axis, (vx | vy | vz, n): how many source planes fall in each target plane; planes beyond the grid fall away."""
    check_same_axes(source, target)
    out = []
    for v, n, s, t, m in zip(VOXEL, source.shape, source.resolution_um, target.resolution_um, target.shape):
        planes = spark.range(n).select(rebin_index(F.col("id"), s, t).alias(v)).where(F.col(v) < m)
        out.append(planes.groupBy(v).agg(F.count("*").alias(f"n_{v}")))
    return out


def compute_native_voxel_denominator_grid(spark: SparkSession, source: SpaceDefinition, target: SpaceDefinition) -> DataFrame:
    """Source voxels per target voxel: the product of three histograms, each with a row per plane of the grid."""
    x, y, z = denominator_axes(spark, source, target)
    return x.crossJoin(F.broadcast(y)).crossJoin(F.broadcast(z)).select(*VOXEL, (F.col("n_vx") * F.col("n_vy") * F.col("n_vz")).alias("value"))


def build_fraction_map_from_counts(numerator: DataFrame, denominator: DataFrame) -> DataFrame:
    """float32(numerator) / float32(denominator), 0 where the denominator is 0 or missing; sparse as the numerator is."""
    n, d = F.col("n").cast("float"), F.col("d").cast("float")
    both = numerator.withColumnRenamed("value", "n").join(denominator.withColumnRenamed("value", "d"), VOXEL, "left")
    return both.select(*VOXEL, F.when(F.coalesce(d, F.lit(0)) != 0, (n / d).cast("float")).otherwise(F.lit(0).cast("float")).alias("value"))


def accumulate_signal_to_target_counts(pixels: DataFrame, source: SpaceDefinition, target: SpaceDefinition) -> DataFrame:
    """Signal pixels (x, y, z zero-based; value, where not 0) per target voxel."""
    signal = pixels.where("value <> 0").select(F.col("x").cast("long").alias("vx"), F.col("y").cast("long").alias("vy"), F.col("z").cast("long").alias("vz"))
    return accumulate_count_map(map_between_grids(signal, source, target), target)


def voxelize_signal_to_fraction_map(pixels: DataFrame, source: SpaceDefinition, target: SpaceDefinition, *, n_planes: int | None = None) -> DataFrame:
    """Share of each target voxel's source voxels that hold signal. The axes' histograms are joined one by one, so the
    denominator is never written out for voxels without signal."""
    if n_planes is not None and n_planes != source.shape[2]:
        raise ValueError(f"{n_planes} planes given, the space declares {source.shape[2]}")
    counts = accumulate_signal_to_target_counts(pixels, source, target).withColumnRenamed("value", "n")
    for v, axis in zip(VOXEL, denominator_axes(pixels.sparkSession, source, target)):
        counts = counts.join(F.broadcast(axis), v)  # a row per plane of the target grid
    total = (F.col("n_vx") * F.col("n_vy") * F.col("n_vz")).cast("float")
    return counts.select(*VOXEL, (F.col("n").cast("float") / total).cast("float").alias("value"))


def fraction_map_summary(pixels: DataFrame, source: SpaceDefinition, target: SpaceDefinition) -> DataFrame:
    """One row: input_signal_points, nonzero_voxels, sum_signal_counts, max_fraction. Pixels outside the target still are input."""
    counts = accumulate_signal_to_target_counts(pixels, source, target).agg(F.count("*").alias("nonzero_voxels"), F.coalesce(F.sum("value"), F.lit(0)).alias("sum_signal_counts"))
    top = voxelize_signal_to_fraction_map(pixels, source, target).agg(F.coalesce(F.max("value"), F.lit(0).cast("float")).alias("max_fraction"))
    return pixels.where("value <> 0").agg(F.count("*").alias("input_signal_points")).crossJoin(counts).crossJoin(top)


def packed_voxel(space: SpaceDefinition, columns=("vx", "vy", "vz")) -> Column:
    """One long per voxel, row-major."""
    x, y, z = (F.col(c).cast("long") for c in columns)
    return (x * F.lit(space.shape[1]).cast("long") + y) * F.lit(space.shape[2]).cast("long") + z
