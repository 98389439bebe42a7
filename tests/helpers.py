from stipple.model import PointCloudDataset, SpaceDefinition, build_dataset_metadata


def space(shape, resolution=(1.0, 1.0, 1.0), indexing="zero_based", orientation="las", name="s", affine=None):
    return SpaceDefinition(name, orientation, ["x", "y", "z"], indexing, "voxel", list(shape), list(resolution), affine)


def cloud(df, grid, kind="point_centroids", subject="subject"):
    return PointCloudDataset(subject, df, build_dataset_metadata(grid, kind))


def points(spark, rows, extra=""):
    return spark.createDataFrame(rows, "detection_id long, seg_num long, x long, y long, z long" + extra)


def simple(spark, rows):
    """(detection_id, x, y, z) with seg_num 1."""
    return points(spark, [(d, 1, x, y, z) for d, x, y, z in rows])


def voxels(spark, rows, value="value", kind="long"):
    return spark.createDataFrame(rows, f"vx long, vy long, vz long, {value} {kind}")


def tuples(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
