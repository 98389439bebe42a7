"""Mask stacks: planes of labels or signal as image files, to pixels, detections and signal points."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coordinates import half_up
from ..functions.ids import with_dense_ids
from ..model import DatasetMetadata, SpaceDefinition, build_dataset_metadata, coordinate_offset, resolve_slice_start
from .images import decode_mask

DEFAULT_EXTENSIONS = (".tif", ".tiff", ".png")
PIXELS_PER_BATCH = 1 << 20


def normalize_extensions(extensions) -> tuple[str, ...]:
    """Lower case with a leading dot; patterns and empty ones are errors."""
    out = []
    for e in [extensions] if isinstance(extensions, str) else extensions:
        e = e.strip().lower()
        if not e.strip(".") or any(c in e for c in "*?[]"):
            raise ValueError(f"not a file extension: {e!r}")
        out.append("." + e.lstrip("."))
    if not out:
        raise ValueError("no file extensions given")
    return tuple(out)


def natural_key(name: str) -> list:
    return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", name.lower()) if p]


def find_mask_files(mask_dir: str | Path, *, extensions=DEFAULT_EXTENSIONS, prefix: str | None = None, suffix: str | None = None) -> list[Path]:
    """Files of a folder by extension and by the start and end of their stems, in natural order."""
    mask_dir = Path(mask_dir)
    if not mask_dir.exists():
        raise FileNotFoundError(f"mask folder does not exist: {mask_dir}")
    if not mask_dir.is_dir():
        raise NotADirectoryError(f"not a folder: {mask_dir}")
    kinds = normalize_extensions(extensions)
    found = [p for p in mask_dir.iterdir() if p.is_file() and p.suffix.lower() in kinds and p.stem.startswith(prefix or "") and p.stem.endswith(suffix or "")]
    if not found:
        raise FileNotFoundError(f"no mask files in {mask_dir}")
    return sorted(found, key=lambda p: (natural_key(p.name), p.name))


def assign_slices(files: list[Path], slice_start: int = 0) -> list[tuple[int, Path]]:
    if slice_start < 0:
        raise ValueError("slice_start must not be negative")
    return list(enumerate(files, slice_start))


def read_2d_mask(path: str | Path) -> np.ndarray:
    return decode_mask(Path(path).read_bytes(), str(path))


def read_mask_crop(path: str | Path, *, x_start: int, x_end: int, y_start: int, y_end: int) -> np.ndarray:
    """Half-open window of a plane."""
    if any(isinstance(v, bool) or not isinstance(v, (int, np.integer)) for v in (x_start, x_end, y_start, y_end)):
        raise TypeError("crop bounds must be integers")
    image = read_2d_mask(path)
    if not (0 <= x_start < x_end <= image.shape[1] and 0 <= y_start < y_end <= image.shape[0]):
        raise ValueError(f"crop is empty or outside the plane of shape {image.shape}")
    return image[y_start:y_end, x_start:x_end].copy()


def pixels(spark: SparkSession, slices: list[tuple[int, Path]]) -> DataFrame:
    """(z, y, x, label) of every pixel that isn't 0. Tasks read and decode the files; the driver only sends their names."""
    names = {Path(p).resolve().as_uri(): z for z, p in slices}
    numbers = spark.createDataFrame([(k, int(v)) for k, v in names.items()], "uri string, z long")
    # one place per plane, so that the join needs no broadcast of content
    files = spark.read.format("binaryFile").load([str(Path(p).resolve()) for _, p in slices])
    files = files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("uri"), "content")
    named = files.join(F.broadcast(numbers.withColumn("uri", F.regexp_replace("uri", "^file:/+", "file:///"))), "uri").select("z", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, z in enumerate(batch.column("z").to_pylist()):
                image = decode_mask(batch.column("content")[i].as_py())
                y, x = np.nonzero(image)
                for at in range(0, len(y), PIXELS_PER_BATCH):
                    part = slice(at, at + PIXELS_PER_BATCH)
                    label = image[y[part], x[part]]
                    if image.dtype.kind == "f":
                        label = label.astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(label), z, np.int64)), pa.array(y[part].astype(np.int64)), pa.array(x[part].astype(np.int64)), pa.array(label.astype(np.int64))], ["z", "y", "x", "label"])

    return named.mapInArrow(run, "z long, y long, x long, label long")


def detections_from_pixels(pixel: DataFrame, *, indexing: str = "zero_based") -> DataFrame:
    """One row per (plane, label): area, centroid, and the axes of the ellipse with the same second moments; numbered by (z, label).

    The variances along the principal axes are the eigenvalues of the pixels' covariance matrix; an axis is four deviations long.
    """
    offset = coordinate_offset(indexing)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    stats = pixel.where("label <> 0").groupBy("z", "label").agg(
        F.count("*").alias("area_px"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"), F.covar_pop(x, y).alias("sxy")
    )
    mean = (F.col("sxx") + F.col("syy")) / 2
    spread = F.sqrt(F.pow((F.col("sxx") - F.col("syy")) / 2, 2) + F.pow("sxy", 2))
    large, small = mean + spread, F.greatest(mean - spread, F.lit(0.0))
    rows = stats.withColumn("l1", large).withColumn("l2", small)
    # what is below rounding is zero, and axes that differ by less are equal
    scale = 1e-12 * F.greatest(F.col("l1"), F.lit(1.0))
    rows = rows.withColumn("l2", F.when(F.col("l2") < scale, 0.0).when(F.col("l1") - F.col("l2") < scale, F.col("l1")).otherwise(F.col("l2")))
    numbered = with_dense_ids(rows, ["z", "label"], "detection_id")
    return numbered.select(
        "detection_id", F.col("label").alias("seg_num"), (half_up(F.col("mx")) + offset).alias("x"), (half_up(F.col("my")) + offset).alias("y"), "z", "area_px",
        (4 * F.sqrt("l1")).alias("major_axis_length_px"), (4 * F.sqrt("l2")).alias("minor_axis_length_px"),
        F.when(F.col("l1") > 0, F.sqrt(F.lit(1.0) - F.col("l2") / F.when(F.col("l1") > 0, F.col("l1")))).otherwise(0.0).alias("eccentricity"),
        (F.col("mx") + offset).alias("x_float"), (F.col("my") + offset).alias("y_float"),
    )


def extract_centroids_from_mask_stack(spark: SparkSession, files: list[Path], *, indexing: str = "zero_based", slice_start: int | None = None) -> DataFrame:
    start = resolve_slice_start(indexing, slice_start)
    return detections_from_pixels(pixels(spark, assign_slices(files, start)), indexing=indexing)


def extract_centroids_from_mask(spark: SparkSession, path: str | Path, slice_index: int, *, indexing: str = "zero_based") -> DataFrame:
    return detections_from_pixels(pixels(spark, [(slice_index, Path(path))]), indexing=indexing)


def signal_points_from_pixels(pixel: DataFrame, *, indexing: str = "zero_based") -> DataFrame:
    """One row per pixel that isn't 0, numbered in (z, y, x) order."""
    offset = coordinate_offset(indexing)
    numbered = with_dense_ids(pixel.where("label <> 0").select("z", "y", "x"), ["z", "y", "x"], "point_id")
    return numbered.select("point_id", (F.col("x") + offset).alias("x"), (F.col("y") + offset).alias("y"), "z")


def extract_signal_points_from_mask_stack(spark: SparkSession, files: list[Path], *, indexing: str = "zero_based", slice_start: int | None = None) -> DataFrame:
    start = resolve_slice_start(indexing, slice_start)
    return signal_points_from_pixels(pixels(spark, assign_slices(files, start)), indexing=indexing)


def extract_signal_points_from_mask(spark: SparkSession, path: str | Path, slice_index: int, *, indexing: str = "zero_based") -> DataFrame:
    return signal_points_from_pixels(pixels(spark, [(slice_index, Path(path))]), indexing=indexing)


def space_from_mask_files(files: list[Path], *, space_name: str, orientation: str, resolution_um, indexing: str = "zero_based") -> SpaceDefinition:
    """Grid of a stack: width and height of the first plane, and the number of planes."""
    if not files:
        raise ValueError("no mask files given")
    height, width = read_2d_mask(files[0]).shape
    return SpaceDefinition(space_name, orientation, ["x", "y", "z"], indexing, "voxel", [int(width), int(height), len(files)], [float(r) for r in resolution_um])


def metadata_from_mask_files(files: list[Path], *, representation_type: str, **space) -> DatasetMetadata:
    return build_dataset_metadata(space_from_mask_files(files, **space), representation_type)
