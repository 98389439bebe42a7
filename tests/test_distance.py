from stipple.operators.distance import distance_join


def test_distance_join_never_broadcasts_a_side(spark):
    df = lambda n: spark.createDataFrame([(1, 0, 0.0, 0.0)], f"{n} long, z long, px double, py double")
    plan = distance_join(df("a"), df("b"), ["z"], 3.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
