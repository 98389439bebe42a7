"""Morphology filters: detections split by calibrated area and shape rules."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_, ge, gt, le, lt, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import PointCloudDataset, ProcessingProvenance, require_columns

COMPARE = {">": gt, ">=": ge, "<": lt, "<=": le}
COMBINE = {"any": or_, "all": and_}
HARD, CONDITIONAL = "hard_area_threshold", "conditional_area_and_features"


@dataclass(frozen=True)
class DetectionFilterCondition:
    """``feature operator threshold``."""

    feature: str
    operator: str
    threshold: float

    def __post_init__(self) -> None:
        if not self.feature.strip():
            raise ValueError("feature must not be empty")
        if self.operator not in COMPARE:
            raise ValueError(f"operator must be one of {list(COMPARE)}")
        if not math.isfinite(self.threshold):
            raise ValueError("threshold must be finite")

    @property
    def expression(self) -> str:
        return f"{self.feature} {self.operator} {self.threshold:g}"

    def column(self) -> Column:
        return COMPARE[self.operator](F.col(self.feature).cast("double"), F.lit(float(self.threshold)))


@dataclass(frozen=True)
class DetectionMorphologyFilterResult:
    accepted: PointCloudDataset
    rejected: PointCloudDataset
    labelled: DataFrame
    hard_area_threshold_um2: float
    accepted_rule: str

    @property
    def maximum_area_um2(self) -> float:
        return self.hard_area_threshold_um2

    def summary(self) -> DataFrame:
        """One row of counts, from one aggregation."""
        n = lambda reason: F.count(F.when(F.col("rejection_reason") == reason, 1))
        return self.labelled.agg(
            F.count("*").alias("input_detections"),
            F.count(F.when(F.col("rejection_reason").isNull(), 1)).alias("accepted_detections"),
            F.count("rejection_reason").alias("rejected_detections"),
            n(HARD).alias("rejected_hard_area"),
            n(CONDITIONAL).alias("rejected_conditional"),
        )


def pixel_area_um2(dataset: PointCloudDataset) -> float:
    return dataset.space.resolution("x") * dataset.space.resolution("y")


def _positive(value: float, name: str) -> float:
    if not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must be positive and finite")
    return float(value)


def check_features(df: DataFrame, features: list[str], area_column: str) -> None:
    """Every feature is a finite number, areas are positive, eccentricities in [0, 1]. One pass over all features; names up to ten ids."""
    require_columns(df, [area_column, *features], "detections")
    faults = []
    for f in dict.fromkeys([area_column, *features]):
        v = F.col(f).try_cast("double")
        bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        if f == area_column:
            bad = bad | (v <= 0)
        if f == "eccentricity":
            bad = bad | (v < 0) | (v > 1)
        faults.append((f, bad))
    found = df.where(reduce(or_, (b for _, b in faults))).select("detection_id", *[b.alias(f"b{i}") for i, (_, b) in enumerate(faults)]).limit(10).collect()
    for i, (f, _) in enumerate(faults):
        if ids := [r["detection_id"] for r in found if r[f"b{i}"]]:
            raise ValueError(f"{f} has values out of range for detections {ids}")


def rejection_reason(pixel_um2: float, hard: float, conditional: float | None, conditions, combination: str, area_column: str) -> Column:
    area = F.col(area_column).cast("double") * pixel_um2
    reason = F.when(area > hard, HARD)
    if conditions:
        reason = reason.when((area > conditional) & reduce(COMBINE[combination], (c.column() for c in conditions)), CONDITIONAL)
    return reason


def filter_detections_by_morphology(dataset: PointCloudDataset, *, hard_area_threshold_um2: float, conditional_area_threshold_um2: float | None = None, conditions: list[DetectionFilterCondition] | None = None, condition_combination: str = "any", area_column: str = "area_px", source_name: str | None = None, validate: bool = True) -> DetectionMorphologyFilterResult:
    """Rejects areas above the hard threshold, and those above the conditional one that also meet any (or all) conditions.

    Thresholds are strict: an equal area passes. The hard reason goes first. Accepted rows have area_um2 added, rejected
    ones rejection_reason as well; the two sides share one scan's expressions.
    """
    hard = _positive(hard_area_threshold_um2, "hard_area_threshold_um2")
    conditions = list(conditions or [])
    if (conditional_area_threshold_um2 is None) != (not conditions):
        raise ValueError("conditional_area_threshold_um2 and conditions go together")
    if conditional_area_threshold_um2 is not None and _positive(conditional_area_threshold_um2, "conditional_area_threshold_um2") >= hard:
        raise ValueError("conditional_area_threshold_um2 must be below the hard threshold")
    if condition_combination not in COMBINE:
        raise ValueError("condition_combination must be 'any' or 'all'")
    if dataset.metadata.representation.representation_type != "point_centroids":
        raise ValueError("morphology filters take point_centroids")
    if validate:
        check_features(dataset.points, [c.feature for c in conditions], area_column)
    pixel = pixel_area_um2(dataset)
    reason = rejection_reason(pixel, hard, conditional_area_threshold_um2, conditions, condition_combination, area_column)
    labelled = dataset.points.withColumn("area_um2", F.col(area_column).cast("double") * pixel).withColumn("rejection_reason", reason)
    rule = f"area_um2 <= {hard:g}"
    if conditions:
        joined = f" {'OR' if condition_combination == 'any' else 'AND'} ".join(c.expression for c in conditions)
        rule += f" AND NOT (area_um2 > {conditional_area_threshold_um2:g} AND ({joined}))"
    parameters = {"hard_area_threshold_um2": hard, "conditional_area_threshold_um2": conditional_area_threshold_um2, "conditions": [c.expression for c in conditions], "condition_combination": condition_combination, "area_column": area_column}

    def side(points: DataFrame, population: str) -> PointCloudDataset:
        provenance = ProcessingProvenance("morphology_filter", source_name, parameters | {"population": population, "accepted_rule": rule})
        return PointCloudDataset(dataset.subject_name, points, dataset.metadata.derived(f"morphology_{population}_point_centroids", provenance))

    accepted = side(labelled.where("rejection_reason IS NULL").drop("rejection_reason"), "filtered")
    rejected = side(labelled.where("rejection_reason IS NOT NULL"), "rejected")
    return DetectionMorphologyFilterResult(accepted, rejected, labelled, hard, rule)


def filter_detections_by_area(dataset: PointCloudDataset, *, maximum_area_um2: float, area_column: str = "area_px", source_name: str | None = None) -> DetectionMorphologyFilterResult:
    return filter_detections_by_morphology(dataset, hard_area_threshold_um2=maximum_area_um2, area_column=area_column, source_name=source_name)
