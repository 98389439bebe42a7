"""Sinks: Parquet tables with JSON sidecars, volumes, and the outputs of whole workflows."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DatasetMetadata, PointCloudDataset, ProcessingProvenance, VoxelMap, build_dataset_metadata
from ..operators.colocalization import ColocalizationResult
from ..operators.deduplication import DeduplicationResult
from ..operators.qc import write_centroid_images, write_colocalization_images, write_colocalization_report, write_region_quantification_qc
from ..operators.regions import RegionQuantificationResult, write_csv
from .masks import assign_slices, extract_centroids_from_mask_stack, extract_signal_points_from_mask_stack, find_mask_files, space_from_mask_files
from .nifti import dense, read_nifti, voxel_table, write_nifti_voxel_map

FORMATS = ("parquet", "npy", "nifti")
#: Array types of map kinds.
MAP_DTYPES = {"count_map": np.uint32, "density_map": np.float32, "fraction_map": np.float32}


@dataclass(frozen=True)
class PointCloudOutputPaths:
    table: Path
    metadata: Path


@dataclass(frozen=True)
class VoxelMapOutputPaths:
    metadata: Path
    parquet: Path | None = None
    npy: Path | None = None
    nifti: Path | None = None


@dataclass(frozen=True)
class DeduplicationOutputPaths:
    objects_table: Path
    objects_metadata: Path
    membership_table: Path
    edge_table: Path | None = None


@dataclass(frozen=True)
class ColocalizationOutputPaths:
    matches_table: Path
    metadata: Path
    relationships_table: Path | None = None
    report: Path | None = None
    images: tuple[Path, ...] = ()


@dataclass(frozen=True)
class InstanceRegionQuantificationOutputPaths:
    assigned_objects_table: Path
    assigned_objects_metadata: Path
    region_summary_csv: Path
    qc_png: Path | None = None


def make_subject_output_stem(name: str) -> str:
    stem = re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]+", "_", name)).strip("_")
    if not stem:
        raise ValueError(f"subject name {name!r} gives no file name")
    return stem


def _write(df: DataFrame, path: Path) -> Path:
    df.write.mode("overwrite").parquet(str(path))
    return path


def save_pointcloud_dataset(dataset: PointCloudDataset, table: str | Path, metadata: str | Path, *, validate: bool = True) -> PointCloudOutputPaths:
    if validate:
        dataset.validate()
    return PointCloudOutputPaths(_write(dataset.points, Path(table)), dataset.metadata.to_json(metadata))


def build_pointcloud_from_masks(spark: SparkSession, mask_dir: str | Path, out_dir: str | Path, *, subject_name: str, space_name: str, orientation: str, resolution_um, indexing: str = "zero_based", extensions=(".tif", ".tiff", ".png"), prefix: str | None = None, suffix: str | None = None, centroid_images: bool = False) -> PointCloudOutputPaths:
    """Planes of labels to detections, written as one data set."""
    files = find_mask_files(mask_dir, extensions=extensions, prefix=prefix, suffix=suffix)
    space = space_from_mask_files(files, space_name=space_name, orientation=orientation, resolution_um=resolution_um, indexing=indexing)
    stem, out_dir = make_subject_output_stem(subject_name), Path(out_dir)
    points = extract_centroids_from_mask_stack(spark, files, indexing=indexing)
    paths = save_pointcloud_dataset(PointCloudDataset(subject_name, points, build_dataset_metadata(space, "point_centroids")), out_dir / f"{stem}_pointcloud.parquet", out_dir / f"{stem}_pointcloud_space.json", validate=False)
    if centroid_images:
        write_centroid_images(spark.read.parquet(str(paths.table)), assign_slices(files, space.offset), out_dir / "centroid_images", indexing=indexing)
    return paths


def build_signal_points_from_masks(spark: SparkSession, mask_dir: str | Path, out_dir: str | Path, *, subject_name: str, space_name: str, orientation: str, resolution_um, indexing: str = "zero_based", extensions=(".tif", ".tiff", ".png"), prefix: str | None = None, suffix: str | None = None) -> PointCloudOutputPaths:
    files = find_mask_files(mask_dir, extensions=extensions, prefix=prefix, suffix=suffix)
    space = space_from_mask_files(files, space_name=space_name, orientation=orientation, resolution_um=resolution_um, indexing=indexing)
    stem, out_dir = make_subject_output_stem(subject_name), Path(out_dir)
    points = extract_signal_points_from_mask_stack(spark, files, indexing=indexing)
    table = _write(points, out_dir / f"{stem}_signal_points.parquet")
    return PointCloudOutputPaths(table, build_dataset_metadata(space, "signal_points").to_json(out_dir / f"{stem}_signal_points_space.json"))


def save_voxel_map_outputs(voxels: VoxelMap, out_dir: str | Path, *, name_suffix: str, output_stem: str | None = None, formats=("parquet",)) -> VoxelMapOutputPaths:
    """The sparse table as Parquet, and on request dense arrays, which are made on the driver."""
    formats = list(formats)
    if not formats or (unknown := [f for f in formats if f not in FORMATS]):
        raise ValueError(f"formats must be some of {FORMATS}, not {formats}")
    del unknown
    base = Path(out_dir) / f"{output_stem or make_subject_output_stem(voxels.subject_name)}_{name_suffix}"
    base.parent.mkdir(parents=True, exist_ok=True)
    paths: dict[str, Path] = {"metadata": voxels.metadata.to_json(f"{base}_space.json")}
    if "parquet" in formats:
        paths["parquet"] = _write(voxels.voxels, Path(f"{base}.parquet"))
    if "npy" in formats or "nifti" in formats:
        array = dense(voxels.voxels, voxels.space, MAP_DTYPES.get(voxels.metadata.representation.representation_type, np.float32))
        if "npy" in formats:
            paths["npy"] = Path(f"{base}.npy")
            np.save(paths["npy"], array)
        if "nifti" in formats:
            paths["nifti"] = Path(f"{base}.nii.gz")
            write_nifti_voxel_map(array, voxels.space, paths["nifti"])
    return VoxelMapOutputPaths(**paths)


def _map_of(spark: SparkSession, array: np.ndarray, metadata: DatasetMetadata, subject_name: str) -> VoxelMap:
    if list(array.shape) != list(metadata.space.shape):
        raise ValueError(f"volume has shape {list(array.shape)}, its metadata {metadata.space.shape}")
    return VoxelMap(subject_name, voxel_table(spark, array), metadata)


def voxel_map_from_npy(spark: SparkSession, npy: str | Path, sidecar: str | Path, *, subject_name: str | None = None) -> VoxelMap:
    return _map_of(spark, np.load(npy), DatasetMetadata.from_json(sidecar), subject_name or Path(npy).stem)


def voxel_map_from_nifti(spark: SparkSession, nii: str | Path, sidecar: str | Path, *, subject_name: str | None = None) -> VoxelMap:
    return _map_of(spark, read_nifti(nii)[0], DatasetMetadata.from_json(sidecar), subject_name or Path(nii).name.split(".")[0])


def voxel_map_from_parquet(spark: SparkSession, table: str | Path, sidecar: str | Path, *, subject_name: str | None = None) -> VoxelMap:
    return VoxelMap(subject_name or Path(table).stem, spark.read.parquet(str(table)), DatasetMetadata.from_json(sidecar))


def save_deduplication_outputs(source: PointCloudDataset, result: DeduplicationResult, out_dir: str | Path, *, parameters: dict | None = None, source_name: str | None = None, write_edge_table: bool = False) -> DeduplicationOutputPaths:
    stem, out_dir = make_subject_output_stem(source.subject_name), Path(out_dir)
    objects = _write(result.objects, out_dir / f"{stem}_objects.parquet")
    members = _write(result.membership, out_dir / f"{stem}_object_membership.parquet")
    edges = _write(result.edges, out_dir / f"{stem}_object_edges.parquet") if write_edge_table else None
    read = source.points.sparkSession.read.parquet
    summary = {"n_detections": read(str(members)).count(), "n_objects": read(str(objects)).count()}
    provenance = ProcessingProvenance("deduplicate_across_planes", source_name or f"{stem}_pointcloud.parquet", dict(parameters or {}), summary)
    metadata = source.metadata.derived("cleaned_objects", provenance).to_json(out_dir / f"{stem}_objects_space.json")
    return DeduplicationOutputPaths(objects, metadata, members, edges)


def save_colocalization_outputs(a: PointCloudDataset, b: PointCloudDataset, result: ColocalizationResult, out_dir: str | Path, *, channel_a: str = "a", channel_b: str = "b", relationships: DataFrame | None = None, parameters: dict | None = None, write_qc: bool = False, marker_radius_px: int = 2) -> ColocalizationOutputPaths:
    stem, out_dir = make_subject_output_stem(a.subject_name), Path(out_dir)
    matches = _write(result.matches, out_dir / f"{stem}_detection_matches.parquet")
    read = a.points.sparkSession.read.parquet
    counts: dict = {"n_matches": read(str(matches)).count()}
    related = None
    if relationships is not None:
        related = _write(relationships, out_dir / f"{stem}_object_relationships.parquet")
        counts["relationship_status_counts"] = {r[0]: r[1] for r in read(str(related)).groupBy("relationship_status").count().collect()}
    body = {"channel_a": channel_a, "channel_b": channel_b, "space": a.space.to_dict(), "parameters": dict(parameters or {}), "summary": counts}
    metadata = out_dir / f"{stem}_colocalization_metadata.json"
    metadata.write_text(json.dumps(body, indent=2) + "\n", encoding="utf-8")
    images, report = (), None
    if write_qc:
        images = tuple(write_colocalization_images(a, b, read(str(matches)), out_dir / "colocalization_qc", stem, marker_radius_px=marker_radius_px))
        report = write_colocalization_report(result.plane_summary, out_dir / f"{stem}_colocalization_qc.xlsx", channel_a=channel_a, channel_b=channel_b, images=list(images))
    return ColocalizationOutputPaths(matches, metadata, related, report, images)


def save_instance_region_quantification_outputs(result: RegionQuantificationResult, out_dir: str | Path, *, annotation: DataFrame | None = None, write_qc: bool = False) -> InstanceRegionQuantificationOutputPaths:
    if write_qc and annotation is None:
        raise ValueError("the annotation is needed to draw QC")
    stem, out_dir = make_subject_output_stem(result.remapped.subject_name), Path(out_dir)
    table = _write(result.assigned, out_dir / f"{stem}_objects_with_regions.parquet")
    assigned = result.assigned.sparkSession.read.parquet(str(table))
    statuses = {r[0]: r[1] for r in assigned.groupBy("assignment_status").agg(F.count("*")).collect()}
    provenance = ProcessingProvenance("assign_regions", summary={"assignment_status_counts": statuses})
    metadata = result.remapped.metadata.derived("objects_with_region_ids", provenance).to_json(out_dir / f"{stem}_objects_with_regions_space.json")
    csv = out_dir / f"{stem}_region_summary.csv"
    write_csv(result.region_summary, str(csv))
    png = out_dir / f"{stem}_quantification_qc.png" if write_qc else None
    if png is not None:
        write_region_quantification_qc(assigned, annotation, result.remapped.space, png)
    return InstanceRegionQuantificationOutputPaths(table, metadata, csv, png)
