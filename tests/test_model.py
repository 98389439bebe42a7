import json

import pytest
from helpers import cloud, points, simple, space, voxels

from stipple.model import ArtifactReference, DatasetMetadata, PointCloudDataset, ProcessingProvenance, VoxelMap, build_dataset_metadata, coordinate_offset, resolve_slice_start, subject_from_path
from stipple.sources.outputs import make_subject_output_stem, save_pointcloud_dataset

SPACE = {"space_name": "n", "orientation": "las", "axis_labels": ["x", "y", "z"], "indexing": "zero_based", "units": "voxel", "shape": [3, 3, 1], "resolution_um": [1.0, 1.0, 5.0]}
V1 = {"schema_name": "s", "schema_version": "0.1.0", "space": SPACE, "representation": {"kind": "point_cloud", "representation_type": "point_centroids"}}
V2 = V1 | {"schema_version": "0.2.0", "artifact_id": "a-1", "processing": {"stage": "x", "source_name": "f", "parameters": {"p": 1}, "summary": {}, "inputs": [{"role": "r", "artifact_id": "b", "schema_name": "q", "name": "n"}]}}


@pytest.mark.parametrize("d", [V1, V2, V2 | {"processing": V2["processing"] | {"inputs": []}}, V1 | {"space": SPACE | {"affine_ras_mm": [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]}}])
def test_metadata_round_trip(d, tmp_path):
    m = DatasetMetadata.from_dict(d)
    assert m.to_dict() == d
    path = m.to_json(tmp_path / "a" / "m.json")
    assert path.read_text() == json.dumps(m.to_dict(), indent=2) + "\n" and DatasetMetadata.from_json(path) == m


def test_empty_ids_and_derived_artifacts():
    for bad in ({"role": "", "artifact_id": "x"}, {"role": "r", "artifact_id": " "}, {"role": "r", "artifact_id": "x", "name": ""}):
        with pytest.raises(ValueError):
            ArtifactReference(**bad)
    with pytest.raises(ValueError):
        DatasetMetadata.from_dict(V1 | {"artifact_id": ""})
    m = DatasetMetadata.from_dict(V2).derived("cleaned_objects", ProcessingProvenance("p"))
    assert m.artifact_id is None and m.processing.to_dict() == {"stage": "p", "parameters": {}, "summary": {}}


def test_indexing_rules():
    assert coordinate_offset("one_based") == 1 and resolve_slice_start("one_based") == 1 and resolve_slice_start("zero_based", 4) == 4
    for f in (lambda: coordinate_offset("two_based"), lambda: resolve_slice_start("one_based", 0)):
        with pytest.raises(ValueError):
            f()


def test_bounds_and_columns(spark):
    grid = space([3, 3, 1], indexing="one_based")
    cloud(simple(spark, [(1, 3, 1, 1)]), grid).validate()
    with pytest.raises(ValueError, match="x values above"):
        cloud(simple(spark, [(1, 4, 1, 1)]), grid).validate()
    with pytest.raises(ValueError, match="y values below"):
        cloud(simple(spark, [(1, 1, 0, 1)]), grid).validate()
    with pytest.raises(ValueError, match="missing required"):
        cloud(spark.createDataFrame([(1,)], "x long"), grid).validate()
    cloud(simple(spark, []), grid).validate()


def test_files_and_summary(spark, tmp_path):
    ds = cloud(points(spark, [(1, 1, 0, 1, 0), (2, 1, 2, 2, 0)]), space([3, 3, 1]))
    save_pointcloud_dataset(ds, tmp_path / "m1_pointcloud", tmp_path / "m1.json")
    back = PointCloudDataset.from_files(spark, tmp_path / "m1_pointcloud", tmp_path / "m1.json")
    assert back.subject_name == "m1" and back.metadata == ds.metadata
    assert back.summary().first().asDict() == {"n_points": 2, "x_min": 0, "x_max": 2, "y_min": 1, "y_max": 2, "z_min": 0, "z_max": 0}
    assert subject_from_path("a/b_pointcloud.parquet") == "b"
    assert make_subject_output_stem("a b--c__d ") == "a_b_c_d"
    with pytest.raises(ValueError):
        make_subject_output_stem("!!")


def test_voxel_map(spark):
    m = VoxelMap("s", voxels(spark, [(0, 0, 0, 2), (1, 1, 1, 0)]), build_dataset_metadata(space([2, 2, 2]), "count_map"))
    m.validate()
    assert m.summary().first().asDict() == {"n_voxels": 8, "nonzero_voxels": 1, "value_sum": 2.0, "value_max": 2.0}
    with pytest.raises(ValueError):
        VoxelMap("s", voxels(spark, [(2, 0, 0, 2)]), m.metadata).validate()
