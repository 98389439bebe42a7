import numpy as np
import pytest
from helpers import cloud, simple, space, tuples, voxels

from stipple.functions import coordinates as c
from stipple.model import VoxelMap, build_dataset_metadata
from stipple.operators import voxel
from pyspark.sql import functions as F


def test_half_up(spark):
    df = spark.createDataFrame([(10.5,), (11.5,), (10.49,), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in df.select(c.half_up(F.col("v"))).collect()] == [11, 12, 10, None, None]


def test_count_map_of_one_based_points(spark):
    source, target = space([4, 4, 4], [5.0] * 3, "one_based"), space([2, 2, 2], [10.0] * 3)
    ds = cloud(simple(spark, [(1, 1, 1, 1), (2, 2, 2, 2), (3, 4, 4, 4)]), source)
    out = voxel.voxelize_to_space(ds, target)
    assert tuples(out.voxels, "vx", "vy", "vz", "value") == [(0, 0, 0, 2), (1, 1, 1, 1)]
    assert out.metadata.space == target and out.metadata.representation.representation_type == "count_map"
    with pytest.raises(NotImplementedError):
        voxel.voxelize_to_space(cloud(ds.points, source, "signal_points"), target)
    with pytest.raises(ValueError):
        voxel.voxelize_to_space(ds, space([2, 2, 2], [10.0] * 3, orientation="ras"))


def test_density(spark):
    m = VoxelMap("s", voxels(spark, [(0, 0, 0, 0), (1, 0, 0, 2)]), build_dataset_metadata(space([2, 1, 1], [10.0, 20.0, 50.0]), "count_map"))
    got = voxel.count_map_to_density_map(m)
    assert tuples(got.voxels, "vx", "value") == [(0, 0.0), (1, float(np.float32(2) / np.float32(1e-5)))]
    with pytest.raises(ValueError, match="negative"):
        voxel.count_map_to_density_map(VoxelMap("s", voxels(spark, [(0, 0, 0, -1)]), m.metadata))
    with pytest.raises(ValueError):
        voxel.count_map_to_density_map(got)


def test_analysis_space():
    assert c.subject_analysis_space(space([5, 5, 5], [3.0] * 3), 4.0).shape == [4, 4, 4]
    with pytest.raises(ValueError):
        c.subject_analysis_space(space([5, 5, 5]), [0.0, 1, 1])


def test_denominator(spark):
    got = voxel.compute_native_voxel_denominator_grid(spark, space([5, 5, 1]), space([3, 3, 1], [2.0, 2.0, 1.0]))
    grid = np.zeros((3, 3), int)
    for r in got.collect():
        grid[r.vx, r.vy] = r.value
    assert grid.tolist() == [[4, 4, 2], [4, 4, 2], [2, 2, 1]]


def test_fraction_map(spark):
    rows = ["1100", "1011", "0010", "1111"]
    pix = spark.createDataFrame([(x, y, 0, int(v)) for y, r in enumerate(rows) for x, v in enumerate(r)], "x long, y long, z long, value int")
    source, target = space([4, 4, 1]), space([2, 2, 1], [2.0, 2.0, 1.0])
    got = voxel.voxelize_signal_to_fraction_map(pix, source, target)
    assert tuples(got, "vx", "vy", "value") == [(0, 0, 0.75), (0, 1, 0.5), (1, 0, 0.5), (1, 1, 0.75)]
    assert voxel.fraction_map_summary(pix, source, target).first()["input_signal_points"] == 10
    both = voxel.build_fraction_map_from_counts(voxel.accumulate_signal_to_target_counts(pix, source, target), voxel.compute_native_voxel_denominator_grid(spark, source, target))
    assert tuples(both) == tuples(got)
    with pytest.raises(ValueError):
        voxel.voxelize_signal_to_fraction_map(pix, source, target, n_planes=2)


def test_dense_grid(spark):
    assert voxel.empty_grid(spark, space([2, 3, 4])).count() == 24
    assert tuples(voxel.densify(voxels(spark, [(1, 0, 0, 7)]), space([2, 1, 1]))) == [(0, 0, 0, 0), (1, 0, 0, 7)]


def test_ras_affine():
    res = [20.0, 25.0, 30.0]
    assert np.allclose(c.build_nifti_ras_affine(space([1, 1, 1], res)), np.diag([0.02, -0.025, -0.03, 1]))
    got = c.build_nifti_ras_affine(space([1, 1, 1], res, orientation="asl"))
    assert np.allclose(got[:3, :3], [[0, 0, 0.03], [-0.02, 0, 0], [0, -0.025, 0]])
    own = np.diag([1.0, 2, 3, 1]).tolist()
    assert c.build_nifti_ras_affine(space([1, 1, 1], affine=own)).tolist() == own
    with pytest.raises(ValueError):
        c.build_nifti_ras_affine(space([1, 1, 1], affine=[[1.0]]))


def test_remap_permutes_flips_and_rescales(spark):
    source, target = space([10, 6, 4], [1.0, 1.0, 2.0]), space([8, 5, 3], [1.0, 2.0, 2.0], "one_based", "sra")
    c.validate_subject_space_match(source, target)
    moved = c.remap_columns(simple(spark, [(1, 2, 4, 1)]), source, target).first()
    # z leads: (1.5 * 2 / 1 - .5); x flips: (9 - 2 + .5) / 2 - .5; y: 4.5 / 2 - .5; one-based
    assert (moved.x_float, moved.y_float, moved.z_float) == (3.5, 4.25, 2.75) and (moved.x, moved.y, moved.z) == (4, 4, 3)
    assert (moved.source_x, moved.source_y, moved.source_z) == (2, 4, 1)
    with pytest.raises(ValueError, match="extents"):
        c.validate_subject_space_match(source, space([99, 5, 3], [1.0, 2.0, 2.0], orientation="sra"))
    with pytest.raises(ValueError, match="orientation"):
        c.letters(space([1, 1, 1], orientation="lla"))


def test_space_checks():
    a = space([2, 2, 2])
    c.check_compatible_spaces(a, space([2, 2, 2], name="other"))
    for bad in (space([2, 2, 3]), space([2, 2, 2], [2.0, 1.0, 1.0]), space([2, 2, 2], indexing="one_based"), space([2, 2, 2], orientation="ras")):
        with pytest.raises(ValueError):
            c.check_compatible_spaces(a, bad)
        with pytest.raises(ValueError):
            c.check_same_sampling(a, bad)
    eye = np.eye(4)
    with pytest.raises(ValueError, match="affine"):
        c.validate_volume_sampling_space(space([2, 2, 2], affine=eye.tolist()), space([2, 2, 2], affine=(2 * eye).tolist()))
