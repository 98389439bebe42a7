"""Command line: ``python -m stipple.cli <command> --help``. Every command is a thin wrapper of the library."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from .functions.coordinates import subject_analysis_space
from .model import PointCloudDataset, VoxelMap, build_dataset_metadata
from .operators import colocalization, compare, deduplication, qc, regions, voxel
from .sources import config as cfg
from .sources import images, masks, nifti, outputs


def session() -> SparkSession:
    return SparkSession.builder.appName("stipple").getOrCreate()


def mask_options(c: dict) -> dict:
    """Folder, selection and grid from a TOML config, as keyword arguments."""
    need = lambda *k: cfg.require_config_value(c, *k)
    space = need("space")
    out = dict(subject_name=need("subject", "name"), space_name=need("space", "name"), orientation=need("space", "orientation"), resolution_um=need("space", "resolution_um"), indexing=space.get("indexing", "zero_based"))
    return out | {k: v for k in ("extensions", "prefix", "suffix") if (v := c["input"].get(k))}


def build_pointcloud(a) -> None:
    c = cfg.load_toml_config(a.config)
    images_too = bool(c.get("qc", {}).get("write_centroid_images"))
    print(outputs.build_pointcloud_from_masks(session(), cfg.require_config_value(c, "input", "mask_dir"), cfg.require_config_value(c, "output", "out_dir"), centroid_images=images_too, **mask_options(c)).table)


def build_signal_points(a) -> None:
    c = cfg.load_toml_config(a.config)
    print(outputs.build_signal_points_from_masks(session(), cfg.require_config_value(c, "input", "mask_dir"), cfg.require_config_value(c, "output", "out_dir"), **mask_options(c)).table)


def load(a) -> PointCloudDataset:
    return PointCloudDataset.from_files(session(), a.table, a.metadata)


def deduplicate(a) -> None:
    if a.distance <= 0:
        raise SystemExit("--distance must be positive")
    ds = load(a)
    ds.validate()
    result = deduplication.deduplicate_across_planes(ds.points, ds.space, max_plane_offset=a.plane_offset, max_xy_distance_um=a.distance, max_n_planes=a.max_planes)
    paths = outputs.save_deduplication_outputs(ds, result, a.out, parameters={"max_plane_offset": a.plane_offset, "max_xy_distance_um": a.distance, "max_n_planes": a.max_planes}, write_edge_table=a.edges)
    if a.qc_masks:
        files = dict(masks.assign_slices(masks.find_mask_files(a.qc_masks), ds.space.offset))
        members = ds.points.sparkSession.read.parquet(str(paths.membership_table))
        print(qc.write_pair_duplicate_qc(ds.points, members, files, qc.select_qc_plane_pairs(ds.points, n_pairs=a.qc_pairs), Path(a.out) / "pair_qc"))
    print(paths.objects_table)


def colocalize(a) -> None:
    c = cfg.load_toml_config(a.config)
    need = lambda *k: cfg.require_config_value(c, *k)
    channel = {s: PointCloudDataset.from_files(session(), need(f"input_{s}", "table"), need(f"input_{s}", "space_json"), subject_name=c.get("subject", {}).get("name", "subject")) for s in "ab"}
    radius = need("matching", "max_xy_distance_um")
    result = colocalization.match_colocalized_detections(channel["a"], channel["b"], max_xy_distance_um=radius)
    shown = c.get("qc", {})
    print(outputs.save_colocalization_outputs(channel["a"], channel["b"], result, need("output", "out_dir"), channel_a=need("input_a", "name"), channel_b=need("input_b", "name"), parameters={"max_xy_distance_um": radius}, write_qc=bool(shown.get("write")), marker_radius_px=shown.get("marker_radius_px", 2)).matches_table)


def quantify(a) -> None:
    ds = load(a)
    spark = ds.points.sparkSession
    annotation = nifti.load_label_volume(spark, a.annotation)
    side = nifti.load_label_volume(spark, a.hemisphere) if a.hemisphere else None
    ontology = spark.read.parquet(a.ontology) if a.ontology else None
    result = regions.quantify_objects_by_region(ds, annotation.voxels, annotation.space, hemisphere=side and side.voxels, hemisphere_space=side and side.space, ontology=ontology, id_map=spark.read.parquet(a.id_map) if a.id_map else None)
    print(outputs.save_instance_region_quantification_outputs(result, a.out, annotation=annotation.voxels, write_qc=a.qc).region_summary_csv)


def voxelize(a) -> None:
    ds = load(a)
    counts = voxel.voxelize_to_space(ds, subject_analysis_space(ds.space, a.resolution, space_name="analysis"))
    outputs.save_voxel_map_outputs(counts, a.out, name_suffix="count_map", formats=a.formats)
    if a.density:
        outputs.save_voxel_map_outputs(voxel.count_map_to_density_map(counts), a.out, name_suffix="density_map", formats=a.formats)


def voxelize_signal(a) -> None:
    c = cfg.load_toml_config(a.config)
    o = mask_options(c)
    files = masks.find_mask_files(cfg.require_config_value(c, "input", "mask_dir"), **{k: o[k] for k in ("extensions", "prefix", "suffix") if k in o})
    source = masks.space_from_mask_files(files, **{k: o[k] for k in ("space_name", "orientation", "resolution_um", "indexing")})
    target = subject_analysis_space(source, cfg.require_config_value(c, "analysis", "resolution_um"), space_name=cfg.require_config_value(c, "analysis", "space_name"))
    pixels = masks.pixels(session(), masks.assign_slices(files)).withColumnRenamed("label", "value")
    fractions = voxel.voxelize_signal_to_fraction_map(pixels, source, target, n_planes=len(files))
    made = VoxelMap(o["subject_name"], fractions, build_dataset_metadata(target, "fraction_map", kind="voxel_map"))
    print(outputs.save_voxel_map_outputs(made, cfg.require_config_value(c, "output", "out_dir"), name_suffix="fraction_map", formats=("parquet", "nifti")).metadata)


def compare_tables(a) -> int:
    spark = session()
    ours, legacy = compare.load_canonical_pointcloud_csv(spark, a.table), compare.load_legacy_centroids_csv(spark, a.legacy)
    report, only_ours, only_theirs = compare.compare_pointcloud_tables(compare.relabel_slices_in_natural_order(ours), compare.relabel_slices_in_natural_order(legacy))
    report.show(truncate=False)
    for df in (only_ours, only_theirs):
        df.show(a.limit, truncate=False)
    return 0 if report.first()["all_rows_match"] else 1


def validate(a) -> None:
    ds = load(a)
    ds.validate()
    ds.summary().show(truncate=False)


def scaffold(a) -> None:
    print(cfg.scaffold_template(a.template, a.target, overwrite=a.overwrite))


def quickstart(a) -> None:
    """A generated stack of four planes, through to a count map."""
    out = Path(a.out)
    (out / "masks").mkdir(parents=True, exist_ok=True)
    for z in range(4):
        plane = np.zeros((32, 32), np.uint16)
        plane[4 : 8, 4 + z : 8 + z] = 1
        plane[20:23, 10:13] = 2 if z < 2 else 0
        (out / "masks" / f"plane_{z}.tif").write_bytes(images.encode_tiff(plane))
    spark = session()
    made = outputs.build_pointcloud_from_masks(spark, out / "masks", out, subject_name="demo", space_name="demo", orientation="las", resolution_um=[2.0, 2.0, 5.0])
    ds = PointCloudDataset.from_files(spark, made.table, made.metadata)
    result = deduplication.deduplicate_across_planes(ds.points, ds.space, max_plane_offset=1, max_xy_distance_um=5.0)
    paths = outputs.save_deduplication_outputs(ds, result, out)
    objects = PointCloudDataset.from_files(spark, paths.objects_table, paths.objects_metadata)
    counts = voxel.voxelize_to_space(objects, subject_analysis_space(ds.space, 10.0))
    print(outputs.save_voxel_map_outputs(counts, out, name_suffix="count_map", formats=("parquet", "npy")).parquet)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stipple")
    sub = p.add_subparsers(required=True)

    def command(name: str, f, *, table: bool = False, config: bool = False, out: bool = False) -> argparse.ArgumentParser:
        s = sub.add_parser(name, help=(f.__doc__ or "").strip() or None)
        s.set_defaults(run=f)
        if config:
            s.add_argument("config")
        if table:
            s.add_argument("table")
            s.add_argument("metadata")
        if out:
            s.add_argument("--out", required=True)
        return s

    command("build-pointcloud", build_pointcloud, config=True)
    command("build-signal-points", build_signal_points, config=True)
    s = command("deduplicate", deduplicate, table=True, out=True)
    s.add_argument("--distance", type=float, required=True)
    s.add_argument("--plane-offset", type=int, default=1)
    s.add_argument("--max-planes", type=int)
    s.add_argument("--edges", action="store_true")
    s.add_argument("--qc-masks")
    s.add_argument("--qc-pairs", type=int, default=3)
    command("colocalize", colocalize, config=True)
    s = command("quantify-regions", quantify, table=True, out=True)
    for name in ("annotation", "hemisphere", "ontology", "id-map"):
        s.add_argument(f"--{name}", required=name == "annotation")
    s.add_argument("--qc", action="store_true")
    s = command("voxelize", voxelize, table=True, out=True)
    s.add_argument("--resolution", type=float, nargs="+", required=True)
    s.add_argument("--formats", nargs="+", default=["parquet"])
    s.add_argument("--density", action="store_true")
    command("voxelize-signal", voxelize_signal, config=True)
    s = command("compare", compare_tables)
    s.add_argument("table")
    s.add_argument("legacy")
    s.add_argument("--limit", type=int, default=10)
    command("validate", validate, table=True)
    s = command("scaffold-config", scaffold)
    s.add_argument("template", choices=cfg.list_templates())
    s.add_argument("target")
    s.add_argument("--overwrite", action="store_true")
    command("quickstart", quickstart, out=True)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if hasattr(args, "resolution") and len(args.resolution) == 1:
        args.resolution = args.resolution[0]
    return args.run(args) or 0


if __name__ == "__main__":
    sys.exit(main())
