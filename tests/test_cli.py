import pytest
from helpers import tuples

from stipple.cli import main


def test_quickstart_and_following_commands(spark, tmp_path, capsys):
    out = tmp_path / "o"
    assert main(["quickstart", "--out", str(out)]) == 0
    assert tuples(spark.read.parquet(str(out / "demo_objects.parquet")), "object_id", "n_detections") == [(1, 4), (2, 2)]
    table, sidecar = str(out / "demo_pointcloud.parquet"), str(out / "demo_pointcloud_space.json")
    assert main(["validate", table, sidecar]) == 0
    assert main(["deduplicate", table, sidecar, "--out", str(out / "d"), "--distance", "5", "--edges", "--qc-masks", str(out / "masks"), "--qc-pairs", "1"]) == 0
    assert (out / "d" / "pair_qc" / "pair_qc_summary.json").exists()
    assert main(["voxelize", table, sidecar, "--out", str(out), "--resolution", "10", "--density", "--formats", "npy"]) == 0
    assert (out / "subject_count_map.npy").exists() or (out / "demo_count_map.npy").exists()
    with pytest.raises(SystemExit):
        main(["deduplicate", table, sidecar, "--out", str(out), "--distance", "0"])


def test_configured_commands(spark, tmp_path):
    main(["quickstart", "--out", str(tmp_path)])
    main(["scaffold-config", "voxelize_signal_masks", str(tmp_path / "v.toml")])
    text = (tmp_path / "v.toml").read_text().replace("/data/signal_masks", str(tmp_path / "masks")).replace("/data/fraction_map", str(tmp_path / "f"))
    (tmp_path / "v.toml").write_text(text)
    assert main(["voxelize-signal", str(tmp_path / "v.toml")]) == 0 and (tmp_path / "f" / "subject_1_fraction_map.nii.gz").exists()
    main(["scaffold-config", "colocalization", str(tmp_path / "c.toml")])
    text = (tmp_path / "c.toml").read_text().replace("/data/matches", str(tmp_path / "m"))
    for c in "ab":
        text = text.replace(f"/data/channel_{c}_pointcloud.parquet", str(tmp_path / "demo_pointcloud.parquet")).replace(f"/data/channel_{c}_pointcloud_space.json", str(tmp_path / "demo_pointcloud_space.json"))
    (tmp_path / "c.toml").write_text(text)
    assert main(["colocalize", str(tmp_path / "c.toml")]) == 0
    assert spark.read.parquet(str(tmp_path / "m" / "subject_detection_matches.parquet")).count() == 6
