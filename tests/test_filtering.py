import math

import pytest
from helpers import cloud, points, space, tuples

from stipple.operators import filtering as f

EXTRA = ", area_px long, eccentricity double, mean_intensity double"


def data(spark, rows):
    return cloud(points(spark, [(d, 1, 0, 0, 0, *r) for d, *r in rows], EXTRA), space([9, 9, 9], [2.0, 3.0, 20.0]))


def test_area_is_inclusive(spark):
    r = f.filter_detections_by_area(data(spark, [(11, 5, 0.1, 1.0), (12, 10, 0.1, 1.0), (13, 11, 0.1, 1.0)]), maximum_area_um2=60)
    assert tuples(r.accepted.points, "detection_id", "area_um2") == [(11, 30.0), (12, 60.0)]
    assert tuples(r.rejected.points, "detection_id", "area_um2", "rejection_reason") == [(13, 66.0, f.HARD)]
    assert r.maximum_area_um2 == 60 and "rejection_reason" not in r.accepted.points.columns
    assert r.accepted.metadata.representation.representation_type == "morphology_filtered_point_centroids"


def test_composite_rule(spark):
    ds = data(spark, [(11, 8, 1.0, 1.0), (12, 9, 0.96, 1.0), (13, 9, 0.965, 1.0), (14, 11, 0.1, 1.0)])
    r = f.filter_detections_by_morphology(ds, hard_area_threshold_um2=60, conditional_area_threshold_um2=48, conditions=[f.DetectionFilterCondition("eccentricity", ">=", 0.965)])
    assert tuples(r.accepted.points, "detection_id") == [(11,), (12,)]
    assert tuples(r.rejected.points, "detection_id", "rejection_reason") == [(13, f.CONDITIONAL), (14, f.HARD)]
    assert r.summary().first().asDict() == {"input_detections": 4, "accepted_detections": 2, "rejected_detections": 2, "rejected_hard_area": 1, "rejected_conditional": 1}
    assert "eccentricity >= 0.965" in r.accepted_rule


@pytest.mark.parametrize("how,rejected", [("any", [(12,), (13,)]), ("all", [(12,)])])
def test_any_and_all(spark, how, rejected):
    ds = data(spark, [(11, 9, 0.5, 200.0), (12, 9, 0.97, 50.0), (13, 9, 0.5, 50.0)])
    conditions = [f.DetectionFilterCondition("eccentricity", ">=", 0.965), f.DetectionFilterCondition("mean_intensity", "<", 100)]
    r = f.filter_detections_by_morphology(ds, hard_area_threshold_um2=100, conditional_area_threshold_um2=50, conditions=conditions, condition_combination=how)
    assert tuples(r.rejected.points, "detection_id") == rejected


@pytest.mark.parametrize("bad", [0, -1, math.nan, math.inf])
def test_bad_thresholds(spark, bad):
    with pytest.raises(ValueError):
        f.filter_detections_by_area(data(spark, []), maximum_area_um2=bad)


def test_bad_arguments_and_values(spark):
    one = [f.DetectionFilterCondition("eccentricity", ">", 0.5)]
    ds = data(spark, [(1, 5, 0.5, 1.0)])
    for bad in (dict(conditions=one), dict(conditional_area_threshold_um2=5), dict(conditions=one, conditional_area_threshold_um2=60), dict(conditions=one, conditional_area_threshold_um2=5, condition_combination="none")):
        with pytest.raises(ValueError):
            f.filter_detections_by_morphology(ds, hard_area_threshold_um2=60, **bad)
    for args in (("", ">", 1), ("a", "=", 1), ("a", ">", math.nan)):
        with pytest.raises(ValueError):
            f.DetectionFilterCondition(*args)
    with pytest.raises(ValueError, match=r"area_px.*\[7\]"):
        f.filter_detections_by_area(data(spark, [(7, 0, 0.5, 1.0)]), maximum_area_um2=60)
    with pytest.raises(ValueError, match=r"eccentricity.*\[8\]"):
        f.filter_detections_by_morphology(data(spark, [(8, 5, 1.5, 1.0)]), hard_area_threshold_um2=60, conditional_area_threshold_um2=5, conditions=one)
