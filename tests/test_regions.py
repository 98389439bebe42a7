import pytest
from helpers import cloud, space, tuples, voxels

from stipple.operators import regions as rg

ONTOLOGY = [(997, None, "root", "root", "#FFFFFF"), (315, 997, "Iso", "Isocortex", "#70FF71"), (184, 315, "FRP", "Frontal pole", "#268F45"), (68, 184, "FRP1", "layer 1", "#268F45"), (667, 184, "FRP2", "layer 2", "#268F46"), (526157192, 184, "FRP5", "layer 5", "#268F45")]
GRID = space([3, 1, 1], [10.0, 10.0, 10.0])


def ontology(spark):
    return spark.createDataFrame(ONTOLOGY, "id long, parent_id long, acronym string, name string, color string")


def levels(spark, *ids):
    return spark.createDataFrame([("structure", i) for i in ids], "level string, id long")


def line(spark, labels, name="label"):
    return voxels(spark, [(i, 0, 0, v) for i, v in enumerate(labels)], name)


def objects(spark, xs, extra=(), ddl=""):
    rows = [(i, x, 0, 0, *e) for i, (x, e) in enumerate(zip(xs, extra or [()] * len(xs)), 1)]
    return spark.createDataFrame(rows, "object_id long, x long, y long, z long" + ddl)


def test_assignment_and_statuses(spark):
    got = rg.assign_objects_to_regions(objects(spark, [0, 1, 2, 5]), GRID, line(spark, [68, 0, 667]), annotation_space=GRID)
    assert tuples(got, "object_id", "region_id", "in_bounds", "in_brain", "assignment_status") == [(1, 68, True, True, "assigned"), (2, 0, True, False, "background"), (3, 667, True, True, "assigned"), (4, -1, False, True, "out_of_bounds")]
    masked = rg.assign_objects_to_regions(objects(spark, [0, 5]), GRID, line(spark, [68, 0, 667]), annotation_space=GRID, brain_mask=line(spark, [0, 1, 1]))
    assert tuples(masked, "object_id", "in_brain") == [(1, False), (2, False)]
    sides = rg.assign_objects_to_hemispheres(objects(spark, [0, 1, 2, 9]), GRID, line(spark, [1, 2, 7]))
    assert tuples(sides.fillna(-1, ["hemisphere_id"]).fillna("", ["hemisphere"]), "object_id", "hemisphere_id", "hemisphere") == [(1, 1, "left"), (2, 2, "right"), (3, -1, ""), (4, -1, "")]
    with pytest.raises(ValueError):
        rg.assign_objects_to_regions(objects(spark, [0]), space([9, 9, 9]), line(spark, [1]), annotation_space=GRID)


def test_region_medians_use_native_pixels(spark):
    rows = objects(spark, [0, 0, 1], [(10.0, 0.2), (20.0, 0.6), (100.0, 0.5)], ", mean_area_px double, mean_eccentricity double")
    asg = rg.assign_objects_to_regions(rows, GRID, line(spark, [1, 2, 3]), annotation_space=GRID)
    got = rg.summarize_objects_by_region(asg, line(spark, [1, 2, 3]), volume_space=GRID, area_measurement_space=space([9, 9, 9], [1.5, 2.0, 20.0]))
    assert tuples(got.where("region_id < 3"), "region_id", "object_count", "median_object_area_um2", "median_object_eccentricity") == [(1, 2, 45.0, 0.4), (2, 1, 300.0, 0.5)]
    empty = got.where("region_id = 3").first()
    assert (empty.object_count, empty.median_object_area_um2, empty.object_density_per_mm3) == (0, None, 0.0)


def test_out_of_bounds_row_and_empty_annotation(spark):
    rows = objects(spark, [0, 7, 8], [(2,), (3,), (4,)], ", n_detections long")
    asg = rg.assign_objects_to_regions(rows, GRID, line(spark, [0, 0, 0]), annotation_space=GRID)
    got = rg.summarize_objects_by_region(asg, line(spark, [0, 0, 0]), volume_space=GRID)
    assert tuples(got, "region_id", "region_voxels", "object_count", "detection_count", "object_density_per_mm3") == [(-1, 0, 2, 7, None)]
    assert rg.summarize_objects_by_region(asg.where("in_bounds"), line(spark, [0, 0, 0]), volume_space=GRID).collect() == []
    kept = rg.summarize_objects_by_region(asg, line(spark, [0, 0, 0]), volume_space=GRID, include_background=True, include_out_of_bounds=False)
    assert tuples(kept, "region_id", "region_voxels", "object_count") == [(0, 3, 1)]
    sparse = rg.summarize_objects_by_region(asg, line(spark, [0]), volume_space=GRID, sparse_background=True, include_background=True, include_out_of_bounds=False)
    assert tuples(sparse, "region_id", "region_voxels") == [(0, 3)]


def test_scopes_end_to_end(spark, tmp_path):
    ds = cloud(objects(spark, [0, 1, 2]), GRID, "cleaned_objects")
    r = rg.quantify_objects_by_region(ds, line(spark, [68, 0, 667]), GRID, hemisphere=line(spark, [1, 2, 2]), hemisphere_space=GRID, ontology=ontology(spark), output_csv=str(tmp_path / "s.csv"))
    assert tuples(r.assigned, "assignment_status") == [("assigned",), ("assigned",), ("background",)]
    row = r.region_summary.where("region_id = 68").first()
    assert (row.bilateral_object_count, row.left_object_count, row.right_object_count) == (1, 1, 0)
    assert abs(row.left_object_density_per_mm3 - 1e6) < 1e-3 and row.right_object_density_per_mm3 is None and row.region_acronym == "FRP1"
    assert (tmp_path / "s.csv").is_file() and spark.read.csv(str(tmp_path / "s.csv"), header=True).count() == 2
    for bad in (dict(output_csv="x.txt"), dict(hemisphere=line(spark, [1, 2, 0]))):
        with pytest.raises(ValueError):
            rg.quantify_objects_by_region(ds, line(spark, [68, 0, 667]), GRID, **bad)
    with pytest.raises(ValueError):
        rg.quantify_objects_by_region(cloud(objects(spark, [0]), GRID, "signal_points"), line(spark, [68]), GRID)


def test_enrichment(spark):
    ids = spark.createDataFrame([(20040, 1), (0, 2), (-1, 3)], "region_id long, n long")
    id_map = spark.createDataFrame([(20040, 526157192)], "src_id long, allen_id long")
    got = rg.enrich_region_summary_with_atlas(ids, ontology(spark), id_map=id_map)
    assert got.columns == ["region_id", "allen_region_id", "region_acronym", "region_name", "region_color", "n"]
    rows = {r.region_id: tuple(r)[1:5] for r in got.collect()}
    assert rows == {20040: (526157192, "FRP5", "layer 5", "#268F45"), 0: (None, "background", "Background", "#000000"), -1: (None, "out_of_bounds", "Out of bounds", "#808080")}
    unknown = spark.createDataFrame([(5, 1)], "region_id long, n long")
    with pytest.raises(ValueError, match="unknown"):
        rg.enrich_region_summary_with_atlas(unknown, ontology(spark))
    assert rg.enrich_region_summary_with_atlas(unknown, ontology(spark), strict=False).first().region_name == "Unknown region"
    with pytest.raises(ValueError):
        rg.enrich_region_summary_with_atlas(unknown.selectExpr("cast(null as long) region_id"), ontology(spark))


def test_hierarchy(spark):
    rows = objects(spark, [0, 1, 2, 9], [(1, 1.0, 0.4), (2, 9.0, 0.5), (1, 25.0, 0.6), (1, 1.0, 0.1)], ", n_detections long, mean_area_px double, mean_eccentricity double")
    ann = line(spark, [68, 667, 184])
    asg = rg.assign_objects_to_regions(rows, GRID, ann, annotation_space=GRID)
    got = rg.summarize_objects_by_hierarchy_level(asg, ann, ontology(spark), levels(spark, 184), level="structure", hierarchy_preset="p", volume_space=GRID)
    assert got.columns[:3] == ["hierarchy_preset", "region_id", "is_parent_residual"]
    r = got.where("region_id = 184").first()
    assert (r.region_voxels, r.object_count, r.detection_count, r.median_object_area_um2, r.median_object_eccentricity, r.is_parent_residual) == (3, 3, 4, 900.0, 0.5, False)
    assert abs(r.region_volume_mm3 - 3e-6) < 1e-15 and abs(r.object_density_per_mm3 - 1e6) < 1e-3
    assert got.where("region_id = -1").first().is_parent_residual is False


def test_hierarchy_residuals_and_lost_regions(spark):
    ids = spark.createDataFrame([(997,), (315,), (68,), (0,)], "region_id long")
    assert tuples(rg.map_to_hierarchy_parent(ids, ontology(spark), levels(spark, 184), "structure")) == [(0, 0), (68, 184), (315, 315), (997, 997)]
    with pytest.raises(ValueError, match="without a parent"):
        rg.map_to_hierarchy_parent(spark.createDataFrame([(12345,)], "region_id long"), ontology(spark), levels(spark, 184), "structure")
    cycle = spark.createDataFrame([(1, 2), (2, 1)], "id long, parent_id long")
    with pytest.raises(ValueError, match="cycle"):
        rg.ancestors(cycle, 8)


def test_signal_by_region(spark, tmp_path):
    grid = space([4, 1, 1], [10.0] * 3)
    r = rg.quantify_signal_by_region(voxels(spark, [(0, 0, 0, 1.0), (1, 0, 0, 0.5), (3, 0, 0, 1.0)], "value", "double"), line(spark, [68, 68, 667, 667]), space=grid, hemisphere=line(spark, [1, 2, 1, 2]), output_csv=str(tmp_path / "o.csv"))
    row = r.region_summary.where("region_id = 68").first()
    assert (row.bilateral_region_voxels, row.bilateral_signal_voxel_equivalents, row.bilateral_signal_fraction, row.left_signal_fraction, row.right_signal_fraction) == (2, 1.5, 0.75, 1.0, 0.5)
    assert abs(row.bilateral_region_volume_mm3 - 2e-6) < 1e-15 and abs(row.bilateral_signal_volume_mm3 - 1.5e-6) < 1e-15


@pytest.mark.parametrize("bad", [1.5, -0.1, float("nan"), None])
def test_bad_signal(spark, bad):
    with pytest.raises(ValueError):
        rg.quantify_signal_by_region(voxels(spark, [(0, 0, 0, bad)], "value", "double"), line(spark, [68]), space=GRID)


def test_sparse_and_negative_ids(spark):
    labels, signal, sides = [-1, 68, 900000001, 68, -1, 900000001], [1, 0.5, 0.25, 1, 0, 0.75], [0, 1, 2, 2, 0, 1]
    grid = space([6, 1, 1], [10.0] * 3)
    got = rg.quantify_signal_by_region(voxels(spark, [(i, 0, 0, float(v)) for i, v in enumerate(signal)], "value", "double"), line(spark, labels), space=grid, hemisphere=line(spark, sides), validate=False).region_summary
    pick = ["region_id", *[f"{s}_{c}" for c in ("region_voxels", "signal_voxel_equivalents") for s in rg.SCOPES]]
    assert tuples(got, *pick) == [(-1, 2, 0, 0, 1.0, 0.0, 0.0), (68, 2, 1, 1, 1.5, 0.5, 1.0), (900000001, 2, 1, 1, 1.0, 0.75, 0.25)]
    with pytest.raises(ValueError):
        rg.validate_and_collect_region_ids(voxels(spark, [(0, 0, 0, 1.5)], "label", "double"))


def test_remap_outside_raises(spark):
    ds = cloud(objects(spark, [0]).selectExpr("object_id", "x + 50 as x", "y", "z"), space([3, 1, 1], [10.0] * 3))
    with pytest.raises(ValueError, match="x values above"):
        rg.remap_pointcloud_dataset_to_space(ds, GRID)
