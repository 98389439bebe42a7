"""Objects from detections: linked across planes by distance and merged under plane constraints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coordinates import half_up, preferred_xy
from ..functions.ids import with_dense_ids
from ..model import POINT_COLUMNS, SpaceDefinition, require_columns
from ..scratch import materialize
from .distance import check_radius, distance_join
from .graph import constrained_merge

EDGE_ORDER = ["xy_distance_um", "plane_offset", "source", "target"]
EDGE_COLUMNS = ["source_detection_id", "target_detection_id", "source_z", "target_z", "plane_offset", "dx_um", "dy_um", "xy_distance_um", "dz_um"]


@dataclass(frozen=True)
class DeduplicationResult:
    edges: DataFrame
    membership: DataFrame
    objects: DataFrame


def _check(max_plane_offset: int, max_xy_distance_um: float, max_n_planes: int | None) -> None:
    if max_plane_offset < 1:
        raise ValueError("max_plane_offset must be at least 1")
    check_radius(max_xy_distance_um)
    if max_n_planes is not None and max_n_planes < 1:
        raise ValueError("max_n_planes must be at least 1")


def build_cross_plane_edge_table(points: DataFrame, space: SpaceDefinition, *, max_plane_offset: int, max_xy_distance_um: float) -> DataFrame:
    """Pairs of detections 1 to ``max_plane_offset`` planes apart (lower plane first) and within the xy distance, inclusive."""
    _check(max_plane_offset, max_xy_distance_um, None)
    require_columns(points, POINT_COLUMNS, "points")
    x, y = preferred_xy(points)
    rx, ry, rz = (space.resolution(a) for a in ("x", "y", "z"))
    base = points.select("detection_id", F.col("z").cast("long").alias("z"), (F.col(x).cast("double") * rx).alias("px"), (F.col(y).cast("double") * ry).alias("py"))
    sources = base.select(F.col("detection_id").alias("source_detection_id"), "z", "px", "py", F.explode(F.sequence(F.lit(1), F.lit(max_plane_offset))).alias("plane_offset"))
    sources = sources.withColumn("target_z", F.col("z") + F.col("plane_offset")).drop("z")
    targets = base.select(F.col("detection_id").alias("target_detection_id"), F.col("z").alias("target_z"), "px", "py")
    pairs = distance_join(sources, targets, ["target_z"], max_xy_distance_um)
    return pairs.withColumn("plane_offset", F.col("plane_offset").cast("long")).withColumn("source_z", F.col("target_z") - F.col("plane_offset")).withColumn("dz_um", F.col("plane_offset") * F.lit(rz)).select(*EDGE_COLUMNS)


def build_object_membership_table(points: DataFrame, edges: DataFrame, *, max_n_planes: int | None = None, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(object_id, detection_id), objects numbered from 1 by their smallest detection; and the accepted edges.

    Without ``validate`` the edges are taken to be of these points, and their planes those of the points.
    """
    if max_n_planes is not None and max_n_planes < 1:
        raise ValueError("max_n_planes must be at least 1")
    named = edges.select(F.col("source_detection_id").alias("source"), F.col("target_detection_id").alias("target"), "xy_distance_um", "plane_offset", *([] if validate else [F.col("source_z").alias("source_plane"), F.col("target_z").alias("target_plane")]))
    if validate:
        ids = points.select(F.col("detection_id").alias("source"))
        ends = edges.select(F.explode(F.array("source_detection_id", "target_detection_id")).alias("source"))
        if unknown := [r[0] for r in ends.join(ids, "source", "left_anti").limit(10).collect()]:
            raise ValueError(f"edges name unknown detections: {unknown}")
    merged, accepted = constrained_merge(points.select(F.col("detection_id").alias("id"), F.col("z").cast("long").alias("plane")), named, EDGE_ORDER, max_n_planes)
    roots = with_dense_ids(merged.where("id = root").select("root"), ["root"], "object_id")
    membership = merged.join(roots, "root").select("object_id", F.col("id").alias("detection_id"))
    kept = edges.join(accepted.select(F.col("source").alias("source_detection_id"), F.col("target").alias("target_detection_id")), ["source_detection_id", "target_detection_id"], "left_semi")
    return membership, kept


def aggregate_cleaned_objects(points: DataFrame, membership: DataFrame, *, validate: bool = True) -> DataFrame:
    """One row per object: mean position (and half-up integers), spread over planes, and means of what shape columns there are.

    Means add up an object's detections by their ids, so a mean near a half rounds the same way however rows are dealt out.
    """
    if validate:
        if membership.groupBy("detection_id").count().where("count > 1").limit(1).count():
            raise ValueError("a detection belongs to several objects")
        if missing := [r[0] for r in membership.select("detection_id").join(points.select("detection_id"), "detection_id", "left_anti").limit(10).collect()]:
            raise ValueError(f"membership names unknown detections: {missing}")
    x, y = preferred_xy(points)
    z = F.col("z").cast("double")
    # running means: those of the last row are the object's
    ordered = Window.partitionBy("object_id").orderBy("detection_id")
    running: dict[str, Column] = {}

    def mean(value: Column) -> Column:
        name = f"__mean{len(running)}"
        running[name] = F.avg(value.cast("double")).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return F.max_by(name, "__n")

    aggregates = [
        mean(F.col(x)).alias("x_float"), mean(F.col(y)).alias("y_float"), mean(z).alias("z_float"),
        F.count("*").alias("n_detections"), F.countDistinct("z").alias("n_planes"), F.min(F.col("z").cast("long")).alias("z_min"), F.max(F.col("z").cast("long")).alias("z_max"),
    ]
    optional = [("area_px", "mean_area_px", mean), ("area_px", "max_area_px", F.max), ("major_axis_length_px", "mean_major_axis_length_px", mean), ("minor_axis_length_px", "mean_minor_axis_length_px", mean), ("eccentricity", "mean_eccentricity", mean)]
    aggregates += [f(F.col(c).cast("double")).alias(name) for c, name, f in optional if c in points.columns]
    rows = membership.join(points, "detection_id").withColumns({"__n": F.row_number().over(ordered)} | running)
    objects = rows.groupBy("object_id").agg(*aggregates)
    rounded = [half_up(F.col(f"{a}_float")).alias(a) for a in ("x", "y", "z")]
    return objects.select("object_id", *rounded, *[c for c in objects.columns if c != "object_id"])


def deduplicate_across_planes(points: DataFrame, space: SpaceDefinition, *, max_plane_offset: int, max_xy_distance_um: float, max_n_planes: int | None = None) -> DeduplicationResult:
    """Edges, members and objects; raises if an object has two detections in one plane."""
    _check(max_plane_offset, max_xy_distance_um, max_n_planes)
    edges = materialize(build_cross_plane_edge_table(points, space, max_plane_offset=max_plane_offset, max_xy_distance_um=max_xy_distance_um), "edges")
    membership, accepted = build_object_membership_table(points, edges, max_n_planes=max_n_planes, validate=False)
    membership = materialize(membership, "membership")
    objects = aggregate_cleaned_objects(points, membership, validate=False)
    planes = membership.join(points.select("detection_id", "z"), "detection_id").groupBy("object_id", "z").count()
    if planes.where("count > 1").limit(1).count():
        raise RuntimeError("an object has several detections in one plane")
    return DeduplicationResult(accepted, membership, objects)


def summarize_deduplication_result(points: DataFrame, result: DeduplicationResult) -> DataFrame:
    """One row: n_detections, n_edges, n_objects."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(points, "n_detections").crossJoin(n(result.edges, "n_edges")).crossJoin(n(result.objects, "n_objects"))
