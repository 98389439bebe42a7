import json
import struct
import zlib

import numpy as np
import pytest
from helpers import cloud, simple, space, tuples, voxels

from stipple.model import VoxelMap, build_dataset_metadata
from stipple.operators import qc
from stipple.operators import reference_space as rs
from stipple.sources import config, images, masks, nifti, outputs


def stack(tmp_path, planes, kind="tif"):
    folder = tmp_path / "m"
    folder.mkdir(exist_ok=True)
    for i, plane in enumerate(planes):
        data = np.array(plane, np.uint16)
        (folder / f"masks_plane_{i + 9}.{kind}").write_bytes(images.encode_tiff(data) if kind == "tif" else images.encode_png(data))
    return folder


A, B = [[0, 1, 1], [0, 0, 0], [2, 2, 0]], [[0, 0, 3], [0, 3, 3], [0, 0, 0]]


def test_natural_order_and_errors(tmp_path):
    for n in ("plane_10.tiff", "plane_2.tif", "plane_1.TIF", "other.png", "plane_3.txt"):
        (tmp_path / n).write_bytes(b"")
    assert [p.name for p in masks.find_mask_files(tmp_path, extensions=("tif", ".TIFF"), prefix="plane")] == ["plane_1.TIF", "plane_2.tif", "plane_10.tiff"]
    assert [p.name for p in masks.find_mask_files(tmp_path, extensions="png")] == ["other.png"]
    for bad, error in ((tmp_path / "no", FileNotFoundError), (tmp_path / "other.png", NotADirectoryError)):
        with pytest.raises(error):
            masks.find_mask_files(bad)
    with pytest.raises(FileNotFoundError):
        masks.find_mask_files(tmp_path, prefix="zzz")
    for e in ("*.tif", "", "."):
        with pytest.raises(ValueError):
            masks.normalize_extensions([e])
    with pytest.raises(ValueError):
        masks.assign_slices([], -1)


@pytest.mark.parametrize("kind", ["tif", "png"])
def test_detections_of_a_stack(spark, tmp_path, kind):
    files = masks.find_mask_files(stack(tmp_path, [A, B], kind))
    got = masks.extract_centroids_from_mask_stack(spark, files)
    rows = tuples(got, "detection_id", "seg_num", "x", "y", "z", "area_px", "major_axis_length_px", "minor_axis_length_px", "eccentricity", "x_float", "y_float")
    assert rows[0] == (1, 1, 2, 0, 0, 2, 2.0, 0.0, 1.0, 1.5, 0.0) and rows[1] == (2, 2, 1, 2, 0, 2, 2.0, 0.0, 1.0, 0.5, 2.0)
    assert rows[2][:6] == (3, 3, 2, 1, 1, 3)
    one = masks.extract_centroids_from_mask(spark, files[0], 1, indexing="one_based")
    assert tuples(one, "x", "y", "z", "x_float", "y_float") == [(2, 3, 1, 1.5, 3.0), (3, 1, 1, 2.5, 1.0)]


def test_moments_of_simple_shapes(spark, tmp_path):
    plane = np.zeros((20, 20), int)
    plane[0, 0] = 1
    plane[5:9, 5:9] = 2
    plane[np.arange(10, 16), np.arange(10, 16)] = 3
    got = {r.seg_num: r for r in masks.extract_centroids_from_mask(spark, masks.find_mask_files(stack(tmp_path, [plane]))[0], 0).collect()}
    assert (got[1].major_axis_length_px, got[1].eccentricity) == (0.0, 0.0)
    assert got[2].eccentricity == 0 and abs(got[2].major_axis_length_px - 4 * 1.25**0.5) < 1e-12
    assert got[3].minor_axis_length_px == 0 and got[3].eccentricity == 1 and abs(got[3].major_axis_length_px - 4 * (2 * 35 / 12) ** 0.5) < 1e-9


def test_signal_points(spark, tmp_path):
    files = masks.find_mask_files(stack(tmp_path, [[[0, 1, 0], [1, 0, 1], [0, 0, 0]], A]))
    assert tuples(masks.extract_signal_points_from_mask(spark, files[0], 2), "point_id", "x", "y", "z") == [(1, 1, 0, 2), (2, 0, 1, 2), (3, 2, 1, 2)]
    assert tuples(masks.extract_signal_points_from_mask_stack(spark, files, indexing="one_based"), "point_id", "x", "y", "z")[3] == (4, 2, 1, 2)
    blank = masks.find_mask_files(stack(tmp_path, [np.zeros((2, 2)), np.zeros((2, 2))]))
    assert masks.extract_centroids_from_mask_stack(spark, blank).collect() == []


def test_workflow_outputs(spark, tmp_path):
    folder = stack(tmp_path, [A, B])
    common = dict(subject_name="a b", space_name="s", orientation="las", resolution_um=[1, 1, 5])
    paths = outputs.build_pointcloud_from_masks(spark, folder, tmp_path / "o", centroid_images=True, **common)
    assert paths.table.name == "a_b_pointcloud.parquet" and spark.read.parquet(str(paths.table)).count() == 3
    assert json.loads(paths.metadata.read_text())["space"]["shape"] == [3, 3, 2]
    image = masks.read_2d_mask(tmp_path / "o" / "centroid_images" / "centroids_plane_9.tif")
    assert image[0, 2] == image[2, 1] == 255 and (image > 0).sum() == 2
    signal = outputs.build_signal_points_from_masks(spark, folder, tmp_path / "o", **common)
    assert spark.read.parquet(str(signal.table)).count() == 7


def test_crops(tmp_path):
    path = masks.find_mask_files(stack(tmp_path, [A]))[0]
    assert masks.read_mask_crop(path, x_start=1, x_end=3, y_start=0, y_end=1).tolist() == [[1, 1]]
    with pytest.raises(ValueError):
        masks.read_mask_crop(path, x_start=1, x_end=9, y_start=0, y_end=1)
    with pytest.raises(TypeError):
        masks.read_mask_crop(path, x_start=1.0, x_end=2, y_start=0, y_end=1)
    with pytest.raises(ValueError):
        images.decode_mask(b"nothing here")
    with pytest.raises(ValueError):
        images.decode_mask(images.encode_png(np.zeros((2, 2, 3), np.uint8)))


def lzw(data):
    """A plain encoder, early change, as TIFF has it."""
    table, out, width, bits, n = {bytes([i]): i for i in range(256)}, [], 9, 0, 0
    codes, w, size = [(256, 9)], b"", 258
    for b in data:
        if w + bytes([b]) in table:
            w += bytes([b])
            continue
        codes.append((table[w], width))
        table[w + bytes([b])] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4095:
            codes.append((256, width))
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        w = bytes([b])
    codes += [(table[w], width)] if w else []
    size += 1
    codes.append((257, 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12))
    for c, k in codes:
        bits, n = bits << k | c, n + k
        while n >= 8:
            out.append(bits >> (n - 8) & 255)
            n -= 8
    return bytes(out + ([bits << (8 - n) & 255] if n else []))


def test_codecs():
    rng = np.random.default_rng(2)
    for dtype in (np.uint8, np.uint16, np.uint32, np.int16, np.float32):
        im = (rng.random((7, 5)) * 200).astype(dtype)
        assert (images.decode_tiff(images.encode_tiff(im)) == im).all()
    for im in ((rng.random((6, 4)) * 255).astype(np.uint8), (rng.random((6, 4)) * 65535).astype(np.uint16), (rng.random((6, 4, 4)) * 255).astype(np.uint8)):
        assert (images.decode_png(images.encode_png(im)) == im).all()
    data = bytes(rng.integers(0, 4, 9000, dtype=np.uint8))
    assert images.lzw_decode(lzw(data)) == data
    assert images.packbits_decode(b"\x02abc\xfed\x80") == b"abcddd"


def test_png_filters():
    """The same image stored with each of the five line filters."""
    im = (np.random.default_rng(3).random((5, 6)) * 255).astype(np.uint8)
    for kind in range(5):
        lines = b""
        for y in range(5):
            row = []
            for x in range(6):
                a, b, c = (int(im[y, x - 1]) if x else 0), (int(im[y - 1, x]) if y else 0), (int(im[y - 1, x - 1]) if x and y else 0)
                p = a + b - c
                guess = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda v: abs(p - v))][kind]
                row.append((int(im[y, x]) - guess) % 256)
            lines += bytes([kind, *row])
        body = zlib.compress(lines)
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        png = images.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")
        assert (images.decode_png(png) == im).all()


def test_nifti_round_trip(spark, tmp_path):
    array = np.arange(24, dtype=np.int16).reshape(2, 3, 4)
    for orientation in ("las", "ras", "asl", "pir"):
        grid = space([2, 3, 4], [20.0, 25.0, 30.0], orientation=orientation)
        path = tmp_path / f"{orientation}.nii.gz"
        nifti.write_nifti_voxel_map(array, grid, path)
        back = nifti.load_nifti_space(path)
        assert (back.orientation, back.shape, back.space_name) == (orientation, [2, 3, 4], orientation) and np.allclose(back.resolution_um, grid.resolution_um)
        assert (nifti.read_nifti(path)[0] == array).all()
    volume = nifti.load_label_volume(spark, path, space_name="x")
    assert volume.space.space_name == "x" and volume.voxels.count() == 24 and volume.voxels.where("vx = 1 AND vy = 2 AND vz = 3").first().label == 23
    with pytest.raises(ValueError):
        nifti.read_header(b"\0" * 400)


def test_voxel_map_outputs(spark, tmp_path):
    m = VoxelMap("s 1", voxels(spark, [(1, 0, 1, 3)]), build_dataset_metadata(space([2, 2, 2]), "count_map"))
    paths = outputs.save_voxel_map_outputs(m, tmp_path, name_suffix="counts", formats=("parquet", "npy", "nifti"))
    for back in (outputs.voxel_map_from_npy(spark, paths.npy, paths.metadata), outputs.voxel_map_from_nifti(spark, paths.nifti, paths.metadata), outputs.voxel_map_from_parquet(spark, paths.parquet, paths.metadata)):
        assert tuples(back.voxels) == [(1, 0, 1, 3)]
    assert np.load(paths.npy).dtype == np.uint32
    for bad in ((), ("zip",)):
        with pytest.raises(ValueError):
            outputs.save_voxel_map_outputs(m, tmp_path, name_suffix="c", formats=bad)
    np.save(tmp_path / "bad.npy", np.zeros((1, 1, 1)))
    with pytest.raises(ValueError, match="shape"):
        outputs.voxel_map_from_npy(spark, tmp_path / "bad.npy", paths.metadata)


def registration(tmp_path, **more):
    grid = space([4, 4, 4], name="f")
    for n in ("fixed", "moving"):
        nifti.write_nifti_voxel_map(np.zeros((4, 4, 4), np.uint8), grid, tmp_path / f"{n}.nii.gz")
    image = lambda n: {"image": f"{n}_raw.nii.gz", "normalized_image": f"{n}.nii.gz", "shape": [4, 4, 4], "orientation": "las"}
    manifest = {"schema_version": 1, "success": True, "fixed_image": image("fixed"), "moving_image": image("moving"), "forward_transforms": ["a.mat"], "transformed_segmentations": {"s": "seg.nii.gz"}} | more
    (tmp_path / rs.MANIFEST).write_text(json.dumps(manifest))
    return tmp_path


def test_registration_folder(tmp_path):
    folder = rs.load_registration_folder(registration(tmp_path))
    assert folder.forward_transforms == [tmp_path / "a.mat"] and folder.transformed_segmentations == {"s": tmp_path / "seg.nii.gz"} and folder.warped_image_path is None
    for bad in (dict(success=False), dict(schema_version=2), dict(fixed_image={}), dict(forward_transforms="x"), dict(transformed_segmentations=[])):
        with pytest.raises(ValueError):
            rs.load_registration_folder(registration(tmp_path, **bad))
    with pytest.raises(FileNotFoundError):
        rs.load_registration_folder(tmp_path / "none")
    bad = registration(tmp_path, moving_image={"image": "m", "normalized_image": "moving.nii.gz", "shape": [5, 4, 4]})
    with pytest.raises(ValueError, match="shape"):
        rs.registration_spaces(rs.load_registration_folder(bad))


def test_reference_transform(spark, tmp_path):
    ds = cloud(simple(spark, [(10, 1, 1, 1), (11, 1, 1, 2), (12, 2, 2, 2), (13, 3, 3, 3)]), space([4, 4, 4]))
    images_of = {(1, 1, 1): (1.1, 1, 1), (1, 1, 2): (1.2, 1, 1), (2, 2, 2): (float("nan"), 2, 2), (3, 3, 3): (9, 3, 3)}
    r = rs.transform_pointcloud_to_reference_space(ds, registration(tmp_path), lambda xyz: np.array([images_of[tuple(p.astype(int))] for p in xyz]).reshape(-1, 3))
    assert tuples(r.accepted.points, "detection_id", "x", "native_z") == [(10, 1, 1), (11, 1, 2)]
    assert tuples(r.rejected, "detection_id", "rejection_reason", "x") == [(12, "non_finite", 0), (13, "out_of_bounds", 9)]
    assert r.summary().first().asDict() == {"input_points": 4, "transformed_points": 4, "in_bounds_points": 2, "non_finite_points": 1, "out_of_bounds_points": 1}
    affine = rs.transform_points(ds, space([4, 4, 4]), space([4, 4, 4]), np.array([[1.0, 0, 0, 0.5], [0, 1, 0, 0], [0, 0, 1, 0]]))
    assert tuples(affine.accepted.points, "detection_id", "x_float", "x") == [(10, 1.5, 2), (11, 1.5, 2), (12, 2.5, 3)]


def test_config_and_templates(tmp_path):
    assert len(config.list_templates()) == 4
    for name in config.list_templates():
        target = config.scaffold_template(name, tmp_path)
        assert config.load_toml_config(target)
        with pytest.raises(FileExistsError):
            config.scaffold_template(name, tmp_path)
        config.scaffold_template(name, tmp_path, overwrite=True)
    cfg = config.load_toml_config(target)
    assert config.require_config_value(cfg, "space", "orientation") == "las"
    with pytest.raises(KeyError, match="space.nothing"):
        config.require_config_value(cfg, "space", "nothing")
    with pytest.raises(KeyError):
        config.read_template_text("none")


def test_status_labels_and_pair_qc(spark, tmp_path):
    mask = np.array(A)
    assert qc.render_duplicate_status_labels(mask, [2]).tolist() == [[0, 1, 1], [0, 0, 0], [2, 2, 0]]
    assert qc.render_duplicate_status_mask(mask, [2])[2, 0].tolist() == [0, 255, 0]
    assert qc.duplicate_status_colormap()[:, 1].tolist() == [65535, 0, 0]
    folder = stack(tmp_path, [A, B])
    files = masks.find_mask_files(folder)
    pts = masks.extract_centroids_from_mask_stack(spark, files)
    member = spark.createDataFrame([(1, 1), (1, 3), (2, 2)], "object_id long, detection_id long")
    path = qc.write_pair_duplicate_qc(pts, member, dict(masks.assign_slices(files)), [(0, 1)], tmp_path / "qc")
    assert json.loads(path.read_text())["pair_summaries"][0]["plane_0_linked"] == 1
    assert images.decode_tiff((tmp_path / "qc" / "pair_0_1_plane_0.tif").read_bytes()).tolist() == [[0, 2, 2], [0, 0, 0], [1, 1, 0]]
    with pytest.raises(ValueError):
        qc.write_pair_duplicate_qc(pts, member, {}, [(0, 1)], tmp_path / "qc")
    with pytest.raises(ValueError):
        qc.check_plane_mask_alignment(mask, pts, 1)


def test_projections_and_region_image(spark, tmp_path):
    pts = simple(spark, [(1, 0, 0, 0), (2, 0, 0, 1), (3, 2, 1, 1), (4, 9, 9, 9)])
    grid = space([3, 2, 2])
    assert tuples(qc.count_projection(pts, grid, "x", "y")) == [(0, 0, 2), (2, 1, 1)]
    assert tuple(qc.representative_slices(pts, grid).first()) == (0, 0, 1)
    assert tuple(qc.representative_slices(pts.where("false"), grid).first()) == (1, 1, 1)
    for n, limit in ((50, 10), (10, 50), (97, 13), (100, 99), (5, 1), (30, 2)):
        kept = [r.x for r in qc.thinned(simple(spark, [(i, i, 0, 0) for i in range(n)]), limit, ["detection_id"]).orderBy("x").collect()]
        assert kept == (list(range(n)) if n <= limit else np.linspace(0, n - 1, limit, dtype=np.int64).tolist())
    from pyspark.sql import functions as F

    ann = voxels(spark, [(x, y, z, x) for x in range(3) for y in range(2) for z in range(2)], "label")
    counts = qc.write_region_quantification_qc(pts.withColumn("assignment_status", F.lit("assigned")), ann, grid, tmp_path / "q.png")
    assert counts == {"assigned": 4} and images.decode_png((tmp_path / "q.png").read_bytes()).ndim == 3
    with pytest.raises(ValueError):
        qc.write_region_quantification_qc(pts, ann, grid, tmp_path / "q.jpg")
    assert [qc.axis_direction(grid, a) for a in "xyz"] == ["L to R", "A to P", "S to I"] and qc.percentage(1, 8) == "12.5%" and qc.percentage(1, 0) == "n/a"


def test_colocalization_outputs(spark, tmp_path):
    import zipfile

    from stipple.operators import colocalization as co

    grid = space([20, 10, 2])
    a, b = cloud(simple(spark, [(1, 3, 3, 0), (2, 15, 5, 0)]), grid), cloud(simple(spark, [(11, 5, 3, 0)]), grid)
    r = co.match_colocalized_detections(a, b, max_xy_distance_um=3)
    rel = co.map_detection_matches_to_objects(r.matches, spark.createDataFrame([(1, 1)], "object_id long, detection_id long"), spark.createDataFrame([(5, 11)], "object_id long, detection_id long")).relationships
    (tmp_path / "colocalization_qc").mkdir()
    (tmp_path / "colocalization_qc" / "subject_z0099.png").write_bytes(b"old")
    paths = outputs.save_colocalization_outputs(a, b, r, tmp_path, channel_a="red", channel_b="green", relationships=rel, write_qc=True, marker_radius_px=1)
    body = json.loads(paths.metadata.read_text())
    assert body["summary"] == {"n_matches": 1, "relationship_status_counts": {"one_to_one": 1}}
    assert [p.name for p in paths.images] == ["subject_z0000.png", "subject_z0001.png"] and not (tmp_path / "colocalization_qc" / "subject_z0099.png").exists()
    image = images.decode_png(paths.images[0].read_bytes())
    assert image.shape == (10, 20, 4) and tuple(image[3, 3]) == qc.CHANNEL_COLORS["a"][0] and tuple(image[5, 15]) == qc.CHANNEL_COLORS["a"][1] and tuple(image[3, 5]) == qc.CHANNEL_COLORS["b"][0]
    sheet = zipfile.ZipFile(paths.report).read("xl/worksheets/sheet1.xml").decode()
    assert "n_red_detections" in sheet and "hyperlink" in sheet
    with pytest.raises(ValueError):
        qc.excel_column_label("!")


def test_region_and_dedup_outputs(spark, tmp_path):
    from stipple.operators import deduplication as dd
    from stipple.operators import regions as rg

    grid = space([4, 4, 2])
    ds = cloud(simple(spark, [(1, 1, 1, 0), (2, 1, 1, 1)]), grid)
    result = dd.deduplicate_across_planes(ds.points, grid, max_plane_offset=1, max_xy_distance_um=1)
    paths = outputs.save_deduplication_outputs(ds, result, tmp_path, write_edge_table=True)
    assert json.loads(paths.objects_metadata.read_text())["processing"]["summary"] == {"n_detections": 2, "n_objects": 1} and spark.read.parquet(str(paths.edge_table)).count() == 1
    ann = voxels(spark, [(x, y, z, 5) for x in range(4) for y in range(4) for z in range(2)], "label")
    objects = cloud(spark.read.parquet(str(paths.objects_table)), grid, "cleaned_objects")
    out = outputs.save_instance_region_quantification_outputs(rg.quantify_objects_by_region(objects, ann, grid), tmp_path, annotation=ann, write_qc=True)
    assert json.loads(out.assigned_objects_metadata.read_text())["processing"]["summary"] == {"assignment_status_counts": {"assigned": 1}} and out.qc_png.exists()


def test_compare_and_legacy(spark, tmp_path):
    from stipple.operators import compare as cm

    (tmp_path / "l.csv").write_text("seg_num,x,y,z\n1,10,20,4\n2,30,40,8\n")
    old = cm.load_legacy_centroids_csv(spark, tmp_path / "l.csv")
    assert tuples(old, "detection_id", "seg_num", "x", "y", "z") == [(1, 1, 20, 10, 4), (2, 2, 40, 30, 8)]
    old.toPandas().to_csv(tmp_path / "c.csv", index=False)
    new = cm.load_canonical_pointcloud_csv(spark, tmp_path / "c.csv")
    report, ours, theirs = cm.compare_pointcloud_tables(new, old)
    assert report.first().all_rows_match and ours.count() == theirs.count() == 0
    (tmp_path / "bad.csv").write_text("x,seg_num,y,z\n")
    with pytest.raises(ValueError):
        cm.load_legacy_centroids_csv(spark, tmp_path / "bad.csv")
    assert tuples(cm.relabel_slices_in_natural_order(simple(spark, [(1, 0, 0, 4), (2, 0, 0, 12), (3, 0, 0, 8)])), "detection_id", "z") == [(1, 1), (2, 3), (3, 2)]
    twice = simple(spark, [(1, 0, 0, 0), (2, 0, 0, 0), (3, 5, 5, 5)])
    r, p, m = cm.compare_pointcloud_tables(twice, simple(spark, [(1, 0, 0, 0), (3, 5, 5, 5), (4, 7, 7, 7)]))
    assert r.first().asDict() == {"python_rows": 3, "matlab_rows": 3, "shared_rows": 3, "exact_matches": 1, "python_only_rows": 1, "matlab_only_rows": 1, "all_rows_match": False}
    assert tuples(p, "x", "difference") == [(0, 1)] and tuples(m, "x", "difference") == [(7, 1)]
