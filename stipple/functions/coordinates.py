"""Column expressions and grid checks for coordinates. Nothing here runs a job."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import XYZ, SpaceDefinition, in_grid

#: Anatomical axis of each orientation letter; a letter names the side at voxel 0.
FAMILIES = {"l": "lr", "r": "lr", "a": "ap", "p": "ap", "s": "si", "i": "si"}
#: World axis (right, anterior, superior positive) of each family, and the direction in which indices grow from a side.
WORLD_AXIS = {"lr": 0, "ap": 1, "si": 2}
GROWS_TOWARDS_POSITIVE = {"l": 1, "r": -1, "p": 1, "a": -1, "i": 1, "s": -1}


def half_up(value: Column) -> Column:
    """floor(v + 0.5) as a long; null for NaN, which a cast would turn into 0."""
    value = value.cast("double")
    return F.when(~F.isnan(value), F.floor(value + 0.5).cast("long"))


def zero_based_xyz(space: SpaceDefinition) -> list[Column]:
    """The grid's own axis columns as zero-based longs named vx, vy, vz."""
    return [(F.col(a).cast("long") - space.offset).alias(v) for a, v in zip(space.axis_labels, ("vx", "vy", "vz"))]


def letters(space: SpaceDefinition) -> list[str]:
    found = list(space.orientation.lower())
    if len(found) != 3 or any(c not in FAMILIES for c in found) or len({FAMILIES[c] for c in found}) != 3:
        raise ValueError(f"orientation must have one letter of each axis: {space.orientation!r}")
    return found


def check_same_axes(source: SpaceDefinition, target: SpaceDefinition) -> None:
    if list(source.axis_labels) != list(target.axis_labels):
        raise ValueError(f"axis labels differ: {source.axis_labels} and {target.axis_labels}")
    if source.orientation != target.orientation:
        raise ValueError(f"orientations differ: {source.orientation} and {target.orientation}")


def rebin_index(index: Column, source_um: float, target_um: float) -> Column:
    """Index in the target grid of a source voxel's centre: floor(((i + 0.5) * s) / t)."""
    return F.floor((index + 0.5) * F.lit(float(source_um)) / F.lit(float(target_um))).cast("long")


def map_between_grids(df: DataFrame, source: SpaceDefinition, target: SpaceDefinition) -> DataFrame:
    """Re-bins zero-based vx, vy, vz from one grid to another of the same axes and orientation."""
    check_same_axes(source, target)
    pairs = zip(("vx", "vy", "vz"), source.resolution_um, target.resolution_um)
    return df.withColumns({v: rebin_index(F.col(v), s, t) for v, s, t in pairs})


def keep_in_grid(df: DataFrame, space: SpaceDefinition) -> DataFrame:
    return df.where(in_grid(space))


def subject_analysis_space(source: SpaceDefinition, resolution_um, *, space_name: str = "subject_analysis") -> SpaceDefinition:
    """A grid over the same extent at another resolution: shape rounded up, affine dropped."""
    resolution = [float(r) for r in (resolution_um if isinstance(resolution_um, (list, tuple)) else [resolution_um] * 3)]
    if len(resolution) != 3 or any(not math.isfinite(r) or r <= 0 for r in resolution):
        raise ValueError("resolution_um must be positive and finite, one value or one per axis")
    shape = [math.ceil(n * s / t) for n, s, t in zip(source.shape, source.resolution_um, resolution)]
    return SpaceDefinition(space_name, source.orientation, list(source.axis_labels), source.indexing, source.units, shape, resolution)


def axis_mapping(source: SpaceDefinition, target: SpaceDefinition) -> list[tuple[int, bool]]:
    """For each target axis: the source axis of the same anatomical family, and whether it runs the other way."""
    own, wanted = letters(source), letters(target)
    out = []
    for letter in wanted:
        i = next(i for i, c in enumerate(own) if FAMILIES[c] == FAMILIES[letter])
        out.append((i, own[i] != letter))
    return out


def validate_subject_space_match(source: SpaceDefinition, target: SpaceDefinition) -> None:
    """Both grids must cover the same extent along every anatomical axis, to within one voxel of the coarser."""
    for t, (s, _) in enumerate(axis_mapping(source, target)):
        a, b = source.shape[s] * source.resolution_um[s], target.shape[t] * target.resolution_um[t]
        if abs(a - b) > max(source.resolution_um[s], target.resolution_um[t]):
            raise ValueError(f"extents differ along {target.axis_labels[t]}: {a} and {b} um")


def float_coordinate_columns(df: DataFrame, prefer_float: bool = True) -> list[str]:
    """The x, y, z columns to read: the float ones only if all three are there."""
    names = [f"{a}_float" for a in XYZ]
    return names if prefer_float and all(n in df.columns for n in names) else list(XYZ)


def preferred_xy(df: DataFrame) -> tuple[str, str]:
    """x and y columns for distances; each takes its float form if there."""
    return tuple(f"{a}_float" if f"{a}_float" in df.columns else a for a in ("x", "y"))  # type: ignore[return-value]


def remap_columns(df: DataFrame, source: SpaceDefinition, target: SpaceDefinition, *, prefer_float_columns: bool = True, copy_source_coordinates: bool = True, source_coordinate_prefix: str = "source") -> DataFrame:
    """Moves x, y, z (and *_float) to another grid: axes permuted and flipped by orientation, voxel centres kept.

    The coordinates as they came are copied to ``<prefix>_*`` columns that aren't there yet.
    """
    columns = float_coordinate_columns(df, prefer_float_columns)
    kept = {}
    if copy_source_coordinates:
        for name in [*XYZ, *(f"{a}_float" for a in XYZ)]:
            if name in df.columns and f"{source_coordinate_prefix}_{name}" not in df.columns:
                kept[f"{source_coordinate_prefix}_{name}"] = F.col(name)
    moved = {}
    for t, (s, flip) in enumerate(axis_mapping(source, target)):
        at = F.col(columns[s]).cast("double") - source.offset
        if flip:
            at = F.lit(source.shape[s] - 1.0) - at
        moved[XYZ[t]] = (at + 0.5) * F.lit(float(source.resolution_um[s])) / F.lit(float(target.resolution_um[t])) - 0.5
    out = {f"{a}_float": v + target.offset for a, v in moved.items()} | {a: half_up(v) + target.offset for a, v in moved.items()}
    return df.withColumns(kept | out)


def nearest_voxel(df: DataFrame, space: SpaceDefinition, prefer_float_columns: bool = True) -> list[Column]:
    """Zero-based voxel that each point falls in, as vx, vy, vz; half-up for float coordinates."""
    columns = float_coordinate_columns(df, prefer_float_columns)
    return [half_up(F.col(c).cast("double") - space.offset).alias(v) for c, v in zip(columns, ("vx", "vy", "vz"))]


def check_compatible_spaces(a: SpaceDefinition, b: SpaceDefinition) -> None:
    """Equal orientation, axes, indexing, units and shape, and all but equal resolution; names may differ."""
    for k in ("orientation", "axis_labels", "indexing", "units", "shape"):
        if list(getattr(a, k)) != list(getattr(b, k)):
            raise ValueError(f"spaces differ in {k}: {getattr(a, k)} and {getattr(b, k)}")
    if not np.allclose(a.resolution_um, b.resolution_um):
        raise ValueError(f"spaces differ in resolution_um: {a.resolution_um} and {b.resolution_um}")


def check_same_sampling(a: SpaceDefinition, b: SpaceDefinition, what: str = "volumes") -> None:
    """Equal shape, orientation (in any case), indexing and resolution."""
    if list(a.shape) != list(b.shape):
        raise ValueError(f"{what} differ in shape: {a.shape} and {b.shape}")
    if a.orientation.lower() != b.orientation.lower():
        raise ValueError(f"{what} differ in orientation: {a.orientation} and {b.orientation}")
    if a.indexing != b.indexing:
        raise ValueError(f"{what} differ in indexing: {a.indexing} and {b.indexing}")
    if not np.allclose(a.resolution_um, b.resolution_um):
        raise ValueError(f"{what} differ in resolution: {a.resolution_um} and {b.resolution_um}")


def validate_volume_sampling_space(space: SpaceDefinition, reference: SpaceDefinition, *, volume_name: str = "volume") -> None:
    """Same sampling, and where both declare an affine, nearly the same affine."""
    check_same_sampling(space, reference, f"{volume_name} and its reference")
    affines = [np.array(s.affine_ras_mm, float) for s in (space, reference) if s.affine_ras_mm is not None]
    if any(a.shape != (4, 4) for a in affines):
        raise ValueError("affine_ras_mm must be 4x4")
    if len(affines) == 2 and not np.allclose(*affines, rtol=1e-5, atol=1e-6):
        raise ValueError(f"{volume_name} has another affine than its reference")


def build_nifti_ras_affine(space: SpaceDefinition) -> np.ndarray:
    """Voxel-to-world matrix in mm: the declared one, else from orientation and resolution with no translation."""
    if space.affine_ras_mm is not None:
        a = np.array(space.affine_ras_mm, float)
        if a.shape != (4, 4) or not np.isfinite(a).all():
            raise ValueError("affine_ras_mm must be a finite 4x4 matrix")
        return a
    a = np.zeros((4, 4))
    a[3, 3] = 1
    for i, (letter, um) in enumerate(zip(letters(space), space.resolution_um)):
        a[WORLD_AXIS[FAMILIES[letter]], i] = GROWS_TOWARDS_POSITIVE[letter] * um / 1000
    return a
