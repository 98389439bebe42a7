import random

import pytest
from helpers import points, space, tuples
from test_deduplication import sequential

from stipple.operators import deduplication as dd
from stipple.operators.graph import constrained_merge


@pytest.mark.parametrize("seed,cap,few", [(5, None, 0), (6, 3, 0), (7, 3, 60), (8, 2, 1000)])
def test_rounds_and_the_last_task_equal_sequential_merging(spark, seed, cap, few):
    rng = random.Random(seed)
    nodes = [(i, rng.randrange(6)) for i in range(100)]
    edges = {}
    for _ in range(250):
        a, b = rng.sample(range(100), 2)
        edges[a, b] = round(rng.random(), 1)
    edges = [(a, b, d, nodes[a][1], nodes[b][1]) for (a, b), d in edges.items()]
    frame = spark.createDataFrame(edges, "source long, target long, d double, source_plane long, target_plane long")
    merged, accepted = constrained_merge(spark.createDataFrame(nodes, "id long, plane long"), frame, ["d", "source", "target"], cap, few=few)
    assert (tuples(merged), tuples(accepted, "source", "target")) == sequential(nodes, edges, cap)


def test_a_long_chain_takes_few_jobs(spark):
    """Rising distances leave one edge to be taken in each round."""
    n = 300
    pts = points(spark, [(i, 1, 0, 0, i, i + i * i / 1000, 0.0) for i in range(n)], ", x_float double, y_float double")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    r = dd.deduplicate_across_planes(pts, space([1000, 1000, 1000]), max_plane_offset=1, max_xy_distance_um=2.0, max_n_planes=None)
    assert r.edges.count() == n - 1 and {x.object_id for x in r.membership.collect()} == {1}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) < 150
