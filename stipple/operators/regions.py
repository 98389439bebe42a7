"""Objects and signal by annotated region, side and hierarchy level.

Volumes are sparse voxel tables (vx, vy, vz, label); an absent voxel is background. The ontology is a table
(id, parent_id, acronym, name, color), an id map (src_id, allen_id), level parents (level, id).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coordinates import check_same_sampling, nearest_voxel, remap_columns, validate_subject_space_match, validate_volume_sampling_space
from ..model import PointCloudDataset, ProcessingProvenance, SpaceDefinition, in_grid, require_columns

VOXEL = ["vx", "vy", "vz"]
BACKGROUND_ID, OUT_OF_BOUNDS_ID = 0, -1
LEFT, RIGHT = 1, 2
SPECIAL = {"background": ("background", "Background", "#000000"), "out_of_bounds": ("out_of_bounds", "Out of bounds", "#808080")}
SCOPES = ("bilateral", "left", "right")


@dataclass(frozen=True)
class RegionQuantificationResult:
    remapped: PointCloudDataset
    assigned: DataFrame
    region_summary: DataFrame
    summary_csv: str | None = None


@dataclass(frozen=True)
class SignalRegionQuantificationResult:
    region_summary: DataFrame
    summary_csv: str | None = None


def remap_pointcloud_dataset_to_space(dataset: PointCloudDataset, target: SpaceDefinition, *, prefer_float_columns: bool = True, copy_source_coordinates: bool = True, source_coordinate_prefix: str = "source", validate: bool = True) -> PointCloudDataset:
    """Points moved to another grid of the same subject; raises if one ends up outside."""
    validate_subject_space_match(dataset.space, target)
    points = remap_columns(dataset.points, dataset.space, target, prefer_float_columns=prefer_float_columns, copy_source_coordinates=copy_source_coordinates, source_coordinate_prefix=source_coordinate_prefix)
    provenance = ProcessingProvenance("remap_to_space", parameters={"source_space": dataset.space.space_name, "target_space": target.space_name})
    moved = PointCloudDataset(dataset.subject_name, points, dataset.metadata.derived(dataset.metadata.representation.representation_type, provenance, space=target))
    if validate:
        moved.validate_spatial_points()
    return moved


def lookup(objects: DataFrame, space: SpaceDefinition, volume: DataFrame, name: str, prefer_float_columns: bool) -> DataFrame:
    """``objects`` with the volume's label at each one's voxel (null where absent) and whether it lies in the grid.

    An equi-join on the three indices: Spark broadcasts the volume or shuffles both sides by what their sizes are.
    """
    require_columns(objects, ("x", "y", "z"), "objects")
    voxel = dict(zip(("__vx", "__vy", "__vz"), nearest_voxel(objects, space, prefer_float_columns)))
    placed = objects.withColumns(voxel).withColumn("__in", in_grid(space, list(voxel)))
    labels = volume.select(F.col("vx").alias("__vx"), F.col("vy").alias("__vy"), F.col("vz").alias("__vz"), F.col("label").alias(name))
    return placed.join(labels, list(voxel), "left").drop(*voxel)


def assign_objects_to_regions(objects: DataFrame, object_space: SpaceDefinition, annotation: DataFrame, *, annotation_space: SpaceDefinition, brain_mask: DataFrame | None = None, prefer_float_columns: bool = True, background_id: int = BACKGROUND_ID, out_of_bounds_id: int = OUT_OF_BOUNDS_ID) -> DataFrame:
    """Adds region_id, in_bounds, in_brain and assignment_status.

    Without a brain mask, in_brain means that the region isn't background, so it holds for objects out of bounds too.
    """
    check_same_sampling(object_space, annotation_space, "objects and annotation")
    found = lookup(objects, annotation_space, annotation, "__label", prefer_float_columns)
    region = F.when(~F.col("__in"), F.lit(out_of_bounds_id)).otherwise(F.coalesce(F.col("__label"), F.lit(background_id))).cast("long")
    found = found.withColumn("region_id", region).withColumn("in_bounds", F.col("__in")).drop("__label", "__in")
    if brain_mask is None:
        inside = F.col("region_id") != background_id
    else:
        found = lookup(found, annotation_space, brain_mask, "__mask", prefer_float_columns)
        inside = F.col("__in") & (F.coalesce("__mask", F.lit(0)) != 0)
    status = F.when(~F.col("in_bounds"), "out_of_bounds").when(F.col("region_id") == background_id, "background").otherwise("assigned")
    return found.withColumn("in_brain", inside).withColumn("assignment_status", status).drop("__mask", "__in")


def assign_objects_to_hemispheres(objects: DataFrame, space: SpaceDefinition, hemisphere: DataFrame, *, prefer_float_columns: bool = True) -> DataFrame:
    """Adds hemisphere_id (1 left, 2 right, else null) and its name."""
    found = lookup(objects, space, hemisphere, "__side", prefer_float_columns)
    side = F.when(F.col("__in") & F.col("__side").isin(LEFT, RIGHT), F.col("__side")).cast("byte")
    found = found.withColumn("hemisphere_id", side).drop("__side", "__in")
    return found.withColumn("hemisphere", F.when(F.col("hemisphere_id") == LEFT, "left").when(F.col("hemisphere_id") == RIGHT, "right"))


def validate_hemisphere_volume(hemisphere: DataFrame, annotation: DataFrame, *, background_id: int = BACKGROUND_ID) -> None:
    """Every annotated voxel must have a side; only the set of wrong values comes to the driver."""
    sides = annotation.where(F.col("label") != background_id).select(*VOXEL).join(hemisphere.withColumnRenamed("label", "side"), VOXEL, "left")
    bad = sides.select(F.coalesce("side", F.lit(0)).alias("side")).where(~F.col("side").isin(LEFT, RIGHT)).distinct().limit(20).collect()
    if bad:
        raise ValueError(f"annotated voxels have hemisphere values {sorted(r[0] for r in bad)}, expected 1 or 2")


def annotation_counts(annotation: DataFrame, hemisphere: DataFrame | None = None, space: SpaceDefinition | None = None, background_id: int = BACKGROUND_ID) -> DataFrame:
    """(region_id, bilateral, left, right): voxels per label, all scopes in one pass. With a space, absent voxels count as background."""
    rows = annotation
    if hemisphere is not None:
        rows = rows.join(hemisphere.withColumnRenamed("label", "side"), VOXEL, "left")
    else:
        rows = rows.withColumn("side", F.lit(None).cast("long"))
    counts = rows.groupBy(F.col("label").cast("long").alias("region_id")).agg(F.count("*").alias("bilateral"), F.count(F.when(F.col("side") == LEFT, 1)).alias("left"), F.count(F.when(F.col("side") == RIGHT, 1)).alias("right"))
    if space is None:
        return counts
    n = space.shape[0] * space.shape[1] * space.shape[2]
    missing = counts.agg((F.lit(n) - F.coalesce(F.sum("bilateral"), F.lit(0))).alias("bilateral"))
    extra = missing.where("bilateral > 0").select(F.lit(background_id).cast("long").alias("region_id"), "bilateral", F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("right"))
    return counts.unionByName(extra).groupBy("region_id").agg(*[F.sum(c).alias(c) for c in SCOPES])


def object_aggregates(columns: list[str], pixel_area_um2: float, when: Column | None = None, prefix: str = "") -> list[Column]:
    """Aggregates of a region's objects, of those that meet a condition if one is given."""
    of = lambda c: c if when is None else F.when(when, c)
    out = [F.count(of(F.lit(1))).alias(f"{prefix}object_count")]
    if "n_detections" in columns:
        out.append(F.coalesce(F.sum(of(F.col("n_detections"))), F.lit(0)).alias(f"{prefix}detection_count"))
    if "n_planes" in columns:
        out.append(F.avg(of(F.col("n_planes"))).alias(f"{prefix}mean_n_planes"))
    if "mean_area_px" in columns:
        out.append(F.median(of(F.col("mean_area_px").cast("double") * pixel_area_um2)).alias(f"{prefix}median_object_area_um2"))
    if "mean_eccentricity" in columns:
        out.append(F.median(of(F.col("mean_eccentricity").cast("double"))).alias(f"{prefix}median_object_eccentricity"))
    return out


def pixel_area(space: SpaceDefinition) -> float:
    return space.resolution("x") * space.resolution("y")


def summarize_from_counts(assigned: DataFrame, region: Column, counts: DataFrame, *, volume_space: SpaceDefinition, area_measurement_space: SpaceDefinition, background_id: int = BACKGROUND_ID, out_of_bounds_id: int = OUT_OF_BOUNDS_ID, include_background: bool = False, include_out_of_bounds: bool = True) -> DataFrame:
    """A row per label of the annotation (counts: region_id, voxels), whether it has objects or not, and one for objects out of bounds if any."""
    columns = assigned.columns
    objects = assigned.withColumn("region_id", region.cast("long")).groupBy("region_id").agg(*object_aggregates(columns, pixel_area(area_measurement_space)))
    volume = F.col("region_voxels") * volume_space.voxel_volume_mm3
    rows = counts.select(F.col("region_id").cast("long").alias("region_id"), F.col("voxels").alias("region_voxels"))
    if not include_background:
        rows = rows.where(F.col("region_id") != background_id)
    zeros = [c for c in ("object_count", "detection_count") if c in objects.columns]
    rows = rows.join(objects, "region_id", "left").fillna(0, zeros)
    if include_out_of_bounds:
        out = objects.where(F.col("region_id") == out_of_bounds_id).withColumn("region_voxels", F.lit(0).cast("long"))
        for c in objects.columns:
            if c.startswith(("mean_", "median_")):
                out = out.withColumn(c, F.lit(None).cast("double"))
        rows = rows.unionByName(out)
    rows = rows.withColumn("region_volume_mm3", volume).withColumn("object_density_per_mm3", F.try_divide(F.col("object_count").cast("double"), F.col("region_volume_mm3")))
    first = ["region_id", "region_voxels", "region_volume_mm3", "object_count", "object_density_per_mm3"]
    return rows.select(*first, *[c for c in objects.columns if c not in first])


def summarize_objects_by_region(assigned: DataFrame, annotation: DataFrame, *, volume_space: SpaceDefinition, area_measurement_space: SpaceDefinition | None = None, region_column: str = "region_id", sparse_background: bool = False, **options) -> DataFrame:
    """Regions by what objects they hold; areas are measured with the native pixel of ``area_measurement_space``."""
    counts = annotation_counts(annotation, space=volume_space if sparse_background else None).select("region_id", F.col("bilateral").alias("voxels"))
    return summarize_from_counts(assigned, F.col(region_column), counts, volume_space=volume_space, area_measurement_space=area_measurement_space or volume_space, **options)


def summarize_object_scopes(assigned: DataFrame, annotation: DataFrame, hemisphere: DataFrame, *, volume_space: SpaceDefinition, area_measurement_space: SpaceDefinition | None = None, background_id: int = BACKGROUND_ID, out_of_bounds_id: int = OUT_OF_BOUNDS_ID, include_background: bool = False, include_out_of_bounds: bool = True) -> DataFrame:
    """Bilateral, left and right columns of the region summary; one pass over the objects and one over the annotation."""
    area = pixel_area(area_measurement_space or volume_space)
    side = {"bilateral": None, "left": F.col("hemisphere_id") == LEFT, "right": F.col("hemisphere_id") == RIGHT}
    aggregates = [x for s in SCOPES for x in object_aggregates(assigned.columns, area, side[s], f"{s}_")]
    objects = assigned.groupBy(F.col("region_id").cast("long").alias("region_id")).agg(*aggregates)
    rows = annotation_counts(annotation, hemisphere).select("region_id", *[F.col(s).alias(f"{s}_region_voxels") for s in SCOPES])
    if not include_background:
        rows = rows.where(F.col("region_id") != background_id)
    zeros = [c for c in objects.columns if c.endswith(("object_count", "detection_count"))]
    rows = rows.join(objects, "region_id", "left").fillna(0, zeros)
    if include_out_of_bounds:
        out = objects.where(F.col("region_id") == out_of_bounds_id)
        for s in SCOPES:
            out = out.withColumn(f"{s}_region_voxels", F.lit(0).cast("long"))
        for c in objects.columns:
            if "_mean_" in c or "_median_" in c:
                out = out.withColumn(c, F.lit(None).cast("double"))
        rows = rows.unionByName(out)
    for s in SCOPES:
        rows = rows.withColumn(f"{s}_region_volume_mm3", F.col(f"{s}_region_voxels") * volume_space.voxel_volume_mm3)
        rows = rows.withColumn(f"{s}_object_density_per_mm3", F.try_divide(F.col(f"{s}_object_count").cast("double"), F.col(f"{s}_region_volume_mm3")))
    own = lambda s: [f"{s}_region_voxels", f"{s}_region_volume_mm3", f"{s}_object_count", f"{s}_object_density_per_mm3"]
    return rows.select("region_id", *[c for s in SCOPES for c in [*own(s), *[x for x in objects.columns if x.startswith(f"{s}_") and x not in own(s)]]])


def enrich_region_summary_with_atlas(summary: DataFrame, ontology: DataFrame, *, id_map: DataFrame | None = None, region_column: str = "region_id", background_id: int = BACKGROUND_ID, out_of_bounds_id: int = OUT_OF_BOUNDS_ID, strict: bool = True) -> DataFrame:
    """Adds allen_region_id, region_acronym, region_name and region_color after the id.

    Background and out-of-bounds rows get fixed names; an id that the ontology doesn't know raises, or with strict=False is 'unknown'.
    """
    require_columns(summary, [region_column], "region summary")
    if dict(summary.dtypes)[region_column] in ("float", "double"):  # whole numbers that a reader took for floats
        summary = summary.withColumn(region_column, F.col(region_column).cast("long"))
    region = F.col(region_column)
    rows = summary
    if id_map is not None:
        rows = rows.join(id_map.select(F.col("src_id").alias(region_column), F.col("allen_id").alias("__allen")), region_column, "left")
    else:
        rows = rows.withColumn("__allen", region)
    nodes = ontology.select(F.col("id").alias("__allen"), F.col("acronym").alias("__acronym"), F.col("name").alias("__name"), F.col("color").alias("__color"), F.lit(True).alias("__known"))
    rows = rows.join(nodes, "__allen", "left")
    special = region.isin(background_id, out_of_bounds_id)
    if strict:
        bad = rows.where(region.isNull() | (~special & F.col("__known").isNull())).select(region_column).distinct().limit(20).collect()
        if any(r[0] is None for r in bad):
            raise ValueError("region summary has a row without region id")
        if bad:
            raise ValueError(f"region ids unknown to the ontology: {sorted((r[0] for r in bad), key=str)}")
    known = F.col("__known").isNotNull()

    def pick(i: int, column: str, unknown) -> Column:
        return F.when(region == background_id, SPECIAL["background"][i]).when(region == out_of_bounds_id, SPECIAL["out_of_bounds"][i]).when(known, F.col(column)).otherwise(unknown)

    added = {
        "allen_region_id": F.when(~special & known, F.col("__allen")).cast("long"),
        "region_acronym": pick(0, "__acronym", F.lit("unknown")),
        "region_name": pick(1, "__name", F.lit("Unknown region")),
        "region_color": pick(2, "__color", F.lit(None).cast("string")),
    }
    at = summary.columns.index(region_column) + 1
    return rows.select(*summary.columns[:at], *[v.alias(k) for k, v in added.items()], *summary.columns[at:])


def ancestors(ontology: DataFrame, max_depth: int = 64) -> DataFrame:
    """(id, ancestor, distance) of every node, itself at 0. The ontology is a small table of bounded depth."""
    nodes = ontology.select("id", "parent_id")
    every = level = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    parents = nodes.where("parent_id IS NOT NULL").select(F.col("id").alias("ancestor"), "parent_id")
    for depth in range(1, max_depth + 1):
        level = level.join(parents, "ancestor").select("id", F.col("parent_id").alias("ancestor"), F.lit(depth).alias("distance"))
        if not level.limit(1).count():
            break
        every = every.unionByName(level)
    else:
        raise ValueError("the ontology has a cycle or is too deep")
    return every


def map_to_hierarchy_parent(ids: DataFrame, ontology: DataFrame, level_parents: DataFrame, level: str, *, id_map: DataFrame | None = None, background_id: int = BACKGROUND_ID, out_of_bounds_id: int = OUT_OF_BOUNDS_ID) -> DataFrame:
    """(region_id, parent_id) for distinct region ids: the nearest ancestor at the level, the id itself for an ancestor of level nodes
    and the special ids; raises for others."""
    rows = ids.select("region_id").distinct()
    if id_map is not None:
        rows = rows.join(id_map.select(F.col("src_id").alias("region_id"), F.col("allen_id").alias("node")), "region_id", "left")
    else:
        rows = rows.withColumn("node", F.col("region_id"))
    up = ancestors(ontology)
    parents = level_parents.where(F.col("level") == level).select(F.col("id").alias("ancestor"))
    nearest = up.join(parents, "ancestor").groupBy(F.col("id").alias("node")).agg(F.min_by("ancestor", "distance").alias("at_level"))
    above = parents.select(F.col("ancestor").alias("id")).join(up, "id").select(F.col("ancestor").alias("node")).distinct().withColumn("above", F.lit(True))
    found = rows.join(nearest, "node", "left").join(above, "node", "left")
    special = F.col("region_id").isin(background_id, out_of_bounds_id)
    parent = F.when(special, F.col("region_id")).otherwise(F.coalesce("at_level", F.when(F.col("above"), F.col("node"))))
    found = found.select("region_id", parent.cast("long").alias("parent_id"))
    if lost := [r[0] for r in found.where("parent_id IS NULL").limit(20).collect()]:
        raise ValueError(f"regions without a parent at level {level!r}: {sorted(lost, key=str)}")
    return found


def summarize_objects_by_hierarchy_level(assigned: DataFrame, annotation: DataFrame, ontology: DataFrame, level_parents: DataFrame, *, level: str, hierarchy_preset: str, volume_space: SpaceDefinition, area_measurement_space: SpaceDefinition | None = None, id_map: DataFrame | None = None, region_column: str = "region_id", background_id: int = BACKGROUND_ID, out_of_bounds_id: int = OUT_OF_BOUNDS_ID, **options) -> DataFrame:
    """The region summary with ids lifted to a level: voxels add up, and means and medians are taken over all objects below."""
    counts = annotation_counts(annotation).select("region_id", F.col("bilateral").alias("voxels"))
    objects = assigned.withColumn("__region", F.col(region_column).cast("long"))
    ids = counts.select("region_id").unionByName(objects.select(F.col("__region").alias("region_id")))
    lift = map_to_hierarchy_parent(ids, ontology, level_parents, level, id_map=id_map, background_id=background_id, out_of_bounds_id=out_of_bounds_id)
    lifted = counts.join(lift, "region_id").groupBy(F.col("parent_id").alias("region_id")).agg(F.sum("voxels").alias("voxels"))
    objects = objects.join(lift.select(F.col("region_id").alias("__region"), F.col("parent_id").alias("__parent")), "__region")
    summary = summarize_from_counts(objects.drop("__region"), F.col("__parent"), lifted, volume_space=volume_space, area_measurement_space=area_measurement_space or volume_space, background_id=background_id, out_of_bounds_id=out_of_bounds_id, **options)
    summary = enrich_region_summary_with_atlas(summary, ontology, background_id=background_id, out_of_bounds_id=out_of_bounds_id).drop("allen_region_id")
    parents = level_parents.where(F.col("level") == level).select(F.col("id").alias("region_id"), F.lit(True).alias("__at_level"))
    residual = ~F.col("region_id").isin(background_id, out_of_bounds_id) & F.col("__at_level").isNull()
    rest = [c for c in summary.columns if c != "region_id"]
    return summary.join(parents, "region_id", "left").select(F.lit(hierarchy_preset).alias("hierarchy_preset"), "region_id", residual.alias("is_parent_residual"), *rest)


def validate_signal(signal: DataFrame, space: SpaceDefinition) -> None:
    """Values are numbers in [0, 1] and voxels lie in the grid."""
    v = F.col("value").cast("double")
    bad = signal.agg(F.count(F.when(v.isNull() | F.isnan(v) | (v < 0) | (v > 1), 1)).alias("values"), F.count(F.when(~in_grid(space), 1)).alias("places")).first()
    if bad["values"]:
        raise ValueError("signal values must be finite and in [0, 1]")
    if bad["places"]:
        raise ValueError("signal has voxels outside the annotation's shape")


def validate_and_collect_region_ids(annotation: DataFrame) -> DataFrame:
    """Distinct integral labels, sorted; raises for labels that aren't whole numbers."""
    label = F.col("label").cast("double")
    if annotation.where(F.col("label").isNull() | F.isnan(label) | (label != F.floor(label))).limit(1).count():
        raise ValueError("region labels must be finite whole numbers")
    return annotation.select(F.col("label").cast("long").alias("region_id")).distinct().orderBy("region_id")


def quantify_signal_by_region(signal: DataFrame, annotation: DataFrame, *, space: SpaceDefinition, hemisphere: DataFrame | None = None, ontology: DataFrame | None = None, id_map: DataFrame | None = None, include_background: bool = False, background_id: int = BACKGROUND_ID, output_csv: str | None = None, validate: bool = True) -> SignalRegionQuantificationResult:
    """Voxels, volume and signal of every region, bilaterally and, with a hemisphere volume, by side. One aggregation for all scopes."""
    check_csv(output_csv)
    if validate:
        validate_signal(signal, space)
        validate_and_collect_region_ids(annotation)
        if hemisphere is not None:
            validate_hemisphere_volume(hemisphere, annotation, background_id=background_id)
    rows = annotation.join(signal.select(*VOXEL, F.col("value").cast("double").alias("value")), VOXEL, "left").fillna(0.0, ["value"])
    scopes = ["bilateral"]
    side = {"bilateral": F.lit(True)}
    if hemisphere is not None:
        rows = rows.join(hemisphere.withColumnRenamed("label", "side"), VOXEL, "left")
        scopes, side = list(SCOPES), side | {"left": F.col("side") == LEFT, "right": F.col("side") == RIGHT}
    aggregates = [x for s in scopes for x in (F.count(F.when(side[s], 1)).alias(f"{s}_region_voxels"), F.coalesce(F.sum(F.when(side[s], F.col("value"))), F.lit(0.0)).alias(f"{s}_signal_voxel_equivalents"))]
    found = rows.groupBy(F.col("label").cast("long").alias("region_id")).agg(*aggregates)
    if not include_background:
        found = found.where(F.col("region_id") != background_id)
    v = space.voxel_volume_mm3
    columns = []
    for s in scopes:
        n, e = F.col(f"{s}_region_voxels"), F.col(f"{s}_signal_voxel_equivalents")
        columns += [n, (n * v).alias(f"{s}_region_volume_mm3"), e, (e * v).alias(f"{s}_signal_volume_mm3"), F.try_divide(e, n).alias(f"{s}_signal_fraction")]
    summary = found.select("region_id", *columns)
    if ontology is not None:
        summary = enrich_region_summary_with_atlas(summary, ontology, id_map=id_map, background_id=background_id)
    return SignalRegionQuantificationResult(write_csv(summary, output_csv), output_csv)


def check_csv(path: str | None) -> None:
    if path is not None and not str(path).lower().endswith(".csv"):
        raise ValueError(f"output_csv must have a .csv suffix, got {path}")


def write_csv(summary: DataFrame, path: str | None) -> DataFrame:
    """Writes a region summary, one row per region, as one CSV file in whatever file system the path names."""
    if path is not None:
        spark = summary.sparkSession
        part = f"{path}.parts-{uuid.uuid4().hex[:8]}"
        summary.orderBy("region_id").coalesce(1).write.csv(part, header=True)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        folder, target = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(str(path))
        fs = folder.getFileSystem(conf)
        written = [x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")]
        fs.delete(target, True)
        if not fs.rename(written[0], target):
            raise OSError(f"could not write {path}")
        fs.delete(folder, True)
    return summary


def quantify_objects_by_region(objects: PointCloudDataset, annotation: DataFrame, annotation_space: SpaceDefinition, *, hemisphere: DataFrame | None = None, hemisphere_space: SpaceDefinition | None = None, ontology: DataFrame | None = None, id_map: DataFrame | None = None, include_background: bool = False, include_out_of_bounds: bool = True, background_id: int = BACKGROUND_ID, out_of_bounds_id: int = OUT_OF_BOUNDS_ID, output_csv: str | None = None, validate: bool = True) -> RegionQuantificationResult:
    """Remap, look up regions (and sides), summarise, name, and write if asked to. Objects outside the grid raise; without
    ``validate`` they are out of bounds."""
    if objects.metadata.representation.representation_type not in ("cleaned_objects", "point_centroids"):
        raise ValueError("region quantification takes cleaned_objects or point_centroids")
    check_csv(output_csv)
    moved = remap_pointcloud_dataset_to_space(objects, annotation_space, validate=validate)
    assigned = assign_objects_to_regions(moved.points, annotation_space, annotation, annotation_space=annotation_space, background_id=background_id, out_of_bounds_id=out_of_bounds_id)
    options = dict(volume_space=annotation_space, area_measurement_space=objects.space, background_id=background_id, out_of_bounds_id=out_of_bounds_id, include_background=include_background, include_out_of_bounds=include_out_of_bounds)
    if hemisphere is not None:
        if hemisphere_space is not None:
            validate_volume_sampling_space(hemisphere_space, annotation_space, volume_name="hemisphere")
        validate_hemisphere_volume(hemisphere, annotation, background_id=background_id)
        assigned = assign_objects_to_hemispheres(assigned, annotation_space, hemisphere)
        summary = summarize_object_scopes(assigned, annotation, hemisphere, **options)
    else:
        summary = summarize_objects_by_region(assigned, annotation, **options)
    if ontology is not None:
        summary = enrich_region_summary_with_atlas(summary, ontology, id_map=id_map, background_id=background_id, out_of_bounds_id=out_of_bounds_id)
    return RegionQuantificationResult(moved, assigned, write_csv(summary, output_csv), output_csv)


