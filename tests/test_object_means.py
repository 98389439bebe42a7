import random

from helpers import points, tuples

from stipple.operators import deduplication as dd


def test_means_add_up_in_the_order_of_detections(spark):
    """Sums of floats depend on their order, and a mean near a half then rounds up or down."""
    rng = random.Random(3)
    values = [round(rng.expovariate(0.02), 2) for _ in range(1600)]
    rows = [(i, 1, 0, 0, i % 3, v, v) for i, v in enumerate(values, 1)]
    rng.shuffle(rows)
    member = spark.createDataFrame([((i + 3) // 4, i) for i in range(1, 1601)], "object_id long, detection_id long").repartition(5)
    got = dd.aggregate_cleaned_objects(points(spark, rows, ", x_float double, y_float double"), member)
    want = [(k + 1, (((values[4 * k] + values[4 * k + 1]) + values[4 * k + 2]) + values[4 * k + 3]) / 4) for k in range(400)]
    assert tuples(got, "object_id", "x_float") == want
    assert {r.n_planes for r in got.collect()} == {3}
