"""Grids, sidecar metadata, and data sets of points and voxels.

Metadata lives on the driver as frozen dataclasses; rows stay in DataFrames. A voxel set is sparse: one row
(vx, vy, vz, value) per voxel that isn't zero, always zero-based, whatever the grid's indexing.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEXING_OFFSETS = {"zero_based": 0, "one_based": 1}
POINT_COLUMNS = ("detection_id", "seg_num", "x", "y", "z")
XYZ = ("x", "y", "z")


def validate_indexing(indexing: str) -> str:
    if indexing not in INDEXING_OFFSETS:
        raise ValueError(f"indexing must be one of {sorted(INDEXING_OFFSETS)}, not {indexing!r}")
    return indexing


def coordinate_offset(indexing: str) -> int:
    return INDEXING_OFFSETS[validate_indexing(indexing)]


def resolve_slice_start(indexing: str, slice_start: int | None = None) -> int:
    """First slice number: the indexing's offset unless given, and never below it."""
    low = coordinate_offset(indexing)
    if slice_start is None:
        return low
    if slice_start < low:
        raise ValueError(f"slice_start must be at least {low} for {indexing}")
    return slice_start


def _text(value: Any, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a non-empty string")
    return value


@dataclass(frozen=True)
class SpaceDefinition:
    """A regular grid: which axes, how they are oriented, how large, and how fine."""

    space_name: str
    orientation: str
    axis_labels: list[str]
    indexing: str
    units: str
    shape: list[int]
    resolution_um: list[float]
    affine_ras_mm: list[list[float]] | None = None

    @property
    def offset(self) -> int:
        return coordinate_offset(self.indexing)

    def resolution(self, axis: str) -> float:
        return float(self.resolution_um[self.axis_labels.index(axis)])

    def bounds(self, axis: str) -> tuple[int, int]:
        """Smallest and largest legal coordinate of an axis."""
        n = self.shape[self.axis_labels.index(axis)]
        return self.offset, n - 1 + self.offset

    @property
    def voxel_volume_mm3(self) -> float:
        return math.prod(self.resolution_um) / 1e9

    def to_dict(self) -> dict[str, Any]:
        out = {k: getattr(self, k) for k in ("space_name", "orientation", "axis_labels", "indexing", "units", "shape", "resolution_um")}
        return out if self.affine_ras_mm is None else out | {"affine_ras_mm": self.affine_ras_mm}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> SpaceDefinition:
        return cls(d["space_name"], d["orientation"], list(d["axis_labels"]), d["indexing"], d["units"], list(d["shape"]), list(d["resolution_um"]), d.get("affine_ras_mm"))


@dataclass(frozen=True)
class DataRepresentation:
    kind: str
    representation_type: str
    value_units: str | None = None

    def to_dict(self) -> dict[str, Any]:
        out = {"kind": self.kind, "representation_type": self.representation_type}
        return out if self.value_units is None else out | {"value_units": self.value_units}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> DataRepresentation:
        return cls(d["kind"], d["representation_type"], d.get("value_units"))


@dataclass(frozen=True)
class ArtifactReference:
    """An input of a processing step, by role and id."""

    role: str
    artifact_id: str
    schema_name: str | None = None
    name: str | None = None

    def __post_init__(self) -> None:
        _text(self.role, "role")
        _text(self.artifact_id, "artifact_id")
        for k in ("schema_name", "name"):
            if getattr(self, k) is not None:
                _text(getattr(self, k), k)

    def to_dict(self) -> dict[str, Any]:
        return {k: v for k in ("role", "artifact_id", "schema_name", "name") if (v := getattr(self, k)) is not None}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> ArtifactReference:
        return cls(d["role"], d["artifact_id"], d.get("schema_name"), d.get("name"))


@dataclass(frozen=True)
class ProcessingProvenance:
    stage: str
    source_name: str | None = None
    parameters: dict[str, Any] = field(default_factory=dict)
    summary: dict[str, Any] = field(default_factory=dict)
    inputs: list[ArtifactReference] | None = None

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"stage": self.stage}
        if self.source_name is not None:
            out["source_name"] = self.source_name
        out |= {"parameters": self.parameters, "summary": self.summary}
        return out if self.inputs is None else out | {"inputs": [x.to_dict() for x in self.inputs]}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> ProcessingProvenance:
        inputs = [ArtifactReference.from_dict(x) for x in d["inputs"]] if "inputs" in d else None
        return cls(d["stage"], d.get("source_name"), dict(d.get("parameters", {})), dict(d.get("summary", {})), inputs)


@dataclass(frozen=True)
class DatasetMetadata:
    """The sidecar of a data set. Version 0.2.0 adds artifact_id and processing inputs; parts that are absent stay absent."""

    schema_name: str
    schema_version: str
    space: SpaceDefinition
    representation: DataRepresentation
    processing: ProcessingProvenance | None = None
    artifact_id: str | None = None

    def __post_init__(self) -> None:
        _text(self.schema_name, "schema_name")
        _text(self.schema_version, "schema_version")
        if self.artifact_id is not None:
            _text(self.artifact_id, "artifact_id")

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"schema_name": self.schema_name, "schema_version": self.schema_version}
        if self.artifact_id is not None:
            out["artifact_id"] = self.artifact_id
        out |= {"space": self.space.to_dict(), "representation": self.representation.to_dict()}
        return out if self.processing is None else out | {"processing": self.processing.to_dict()}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> DatasetMetadata:
        processing = ProcessingProvenance.from_dict(d["processing"]) if d.get("processing") is not None else None
        return cls(d["schema_name"], d["schema_version"], SpaceDefinition.from_dict(d["space"]), DataRepresentation.from_dict(d["representation"]), processing, d.get("artifact_id"))

    def to_json(self, path: str | Path) -> Path:
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(self.to_dict(), indent=2) + "\n", encoding="utf-8")
        return path

    @classmethod
    def from_json(cls, path: str | Path) -> DatasetMetadata:
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    def derived(self, representation_type: str, processing: ProcessingProvenance | None, *, kind: str | None = None, space: SpaceDefinition | None = None, value_units: str | None = None) -> DatasetMetadata:
        """Metadata of a data set made from this one. It has no artifact_id: that names one artifact only."""
        representation = DataRepresentation(kind or self.representation.kind, representation_type, value_units)
        return replace(self, space=space or self.space, representation=representation, processing=processing, artifact_id=None)


def build_dataset_metadata(space: SpaceDefinition, representation_type: str, *, kind: str = "point_cloud", schema_name: str = "stipple_dataset", schema_version: str = "0.1.0", value_units: str | None = None, processing: ProcessingProvenance | None = None) -> DatasetMetadata:
    return DatasetMetadata(schema_name, schema_version, space, DataRepresentation(kind, representation_type, value_units), processing)


def write_dataset_metadata(metadata: DatasetMetadata, path: str | Path) -> Path:
    return metadata.to_json(path)


def require_columns(df: DataFrame, columns, what: str = "table") -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} is missing required columns: {missing}")


def subject_from_path(path: str | Path) -> str:
    """File stem without a trailing ``_pointcloud``."""
    return Path(path).stem.removesuffix("_pointcloud")


@dataclass(frozen=True)
class PointCloudDataset:
    subject_name: str
    points: DataFrame
    metadata: DatasetMetadata

    @classmethod
    def from_files(cls, spark: SparkSession, table: str | Path, sidecar: str | Path, *, subject_name: str | None = None) -> PointCloudDataset:
        return cls(subject_name or subject_from_path(table), spark.read.parquet(str(table)), DatasetMetadata.from_json(sidecar))

    @property
    def space(self) -> SpaceDefinition:
        return self.metadata.space

    def validate(self, *, bounds: bool = True) -> None:
        require_columns(self.points, POINT_COLUMNS, "point cloud")
        self.validate_spatial_points(bounds=bounds)

    def validate_spatial_points(self, *, bounds: bool = True) -> None:
        """Axes, indexing, and that every coordinate is inside the grid; the bounds cost one aggregation and can be left out."""
        space = self.space
        if len(space.axis_labels) != 3 or len(space.shape) != 3 or len(space.resolution_um) != 3:
            raise ValueError("metadata must describe three axes")
        validate_indexing(space.indexing)
        require_columns(self.points, space.axis_labels, "point cloud")
        if not bounds:
            return
        found = self.points.agg(*[f(a).alias(f"{k}_{a}") for a in space.axis_labels for k, f in (("min", F.min), ("max", F.max))]).first()
        for a in space.axis_labels:
            low, high = space.bounds(a)
            if found[f"min_{a}"] is None:
                continue
            if found[f"min_{a}"] < low:
                raise ValueError(f"point cloud has {a} values below {low}")
            if found[f"max_{a}"] > high:
                raise ValueError(f"point cloud has {a} values above {high}")

    def summary(self) -> DataFrame:
        """One row: n_points and the range of each axis."""
        return self.points.agg(F.count("*").alias("n_points"), *[f(a).alias(f"{a}_{k}") for a in XYZ for k, f in (("min", F.min), ("max", F.max))])


@dataclass(frozen=True)
class VoxelMap:
    subject_name: str
    voxels: DataFrame
    metadata: DatasetMetadata

    @property
    def space(self) -> SpaceDefinition:
        return self.metadata.space

    def validate(self) -> None:
        require_columns(self.voxels, ("vx", "vy", "vz", "value"), "voxel map")
        outside = ~in_grid(self.space)
        if self.voxels.where(outside).limit(1).count():
            raise ValueError("voxel map has voxels outside the grid's shape")

    def summary(self) -> DataFrame:
        """One row: n_voxels of the grid, nonzero_voxels, value_sum, value_max (0 where no row holds a value)."""
        n = math.prod(self.space.shape)
        return self.voxels.agg(
            F.lit(n).cast("long").alias("n_voxels"),
            F.count(F.when(F.col("value") != 0, 1)).alias("nonzero_voxels"),
            F.coalesce(F.sum(F.col("value").cast("double")), F.lit(0.0)).alias("value_sum"),
            F.coalesce(F.max(F.col("value").cast("double")), F.lit(0.0)).alias("value_max"),
        )


def in_grid(space: SpaceDefinition, columns=("vx", "vy", "vz")):
    """Condition that zero-based voxel columns lie in a grid; false for nulls."""
    inside = F.lit(True)
    for c, n in zip(columns, space.shape):
        inside = inside & (F.col(c) >= 0) & (F.col(c) < n)
    return F.coalesce(inside, F.lit(False))
