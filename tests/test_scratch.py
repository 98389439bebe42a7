import os

from stipple import scratch


def test_tables_go_when_cleared(spark):
    df = scratch.materialize(spark.range(3), "t")
    path = scratch._made[-1].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    kept, scratch._made[:] = scratch._made[:-1], scratch._made[-1:]
    assert scratch.clear_scratch(spark) == 1 and not os.path.exists(path)
    scratch._made[:] = kept


def test_folder_comes_from_the_session(spark):
    assert scratch.scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))


def test_a_bare_path_is_of_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        assert scratch.qualified(spark, "/data/ckpt") == "file:///data/ckpt"
        conf.set("fs.defaultFS", "hdfs://name:8020")
        assert scratch.qualified(spark, "/data/ckpt") == "hdfs://name:8020/data/ckpt"
        assert scratch.qualified(spark, "file:/data/ckpt") == "file:///data/ckpt"
        assert scratch.qualified(spark, "s3a://bucket/x") == "s3a://bucket/x"
    finally:
        conf.set("fs.defaultFS", before)
