import math
import random

import pytest
from helpers import points, simple, space, tuples

from stipple.operators import deduplication as dd
from stipple.operators import qc
from stipple.operators.distance import distance_join
from stipple.operators.graph import connected_components, constrained_merge

GRID = space([1000, 1000, 100], [1.0, 1.0, 5.0], "one_based")
FIVE = [(1, 100, 200, 10), (2, 102, 201, 11), (3, 101, 199, 12), (4, 300, 400, 11), (5, 303, 402, 12)]


def groups(membership):
    out = {}
    for r in membership.collect():
        out.setdefault(r.object_id, set()).add(r.detection_id)
    return [out[k] for k in sorted(out)]


def test_whole_flow(spark):
    pts = simple(spark, FIVE)
    r = dd.deduplicate_across_planes(pts, GRID, max_plane_offset=1, max_xy_distance_um=5)
    assert tuples(r.edges, "source_detection_id", "target_detection_id", "xy_distance_um", "dz_um") == [(1, 2, math.sqrt(5), 5.0), (2, 3, math.sqrt(5), 5.0), (4, 5, math.sqrt(13), 5.0)]
    assert groups(r.membership) == [{1, 2, 3}, {4, 5}]
    assert tuples(r.objects, "object_id", "x", "y", "z", "n_detections", "n_planes", "z_min", "z_max") == [(1, 101, 200, 11, 3, 3, 10, 12), (2, 302, 401, 12, 2, 2, 11, 12)]
    assert tuples(r.objects.where("object_id = 2"), "x_float", "y_float", "z_float") == [(301.5, 401.0, 11.5)]
    assert dd.summarize_deduplication_result(pts, r).first().asDict() == {"n_detections": 5, "n_edges": 3, "n_objects": 2}


def test_plane_cap(spark):
    r = dd.deduplicate_across_planes(simple(spark, FIVE[:3]), GRID, max_plane_offset=1, max_xy_distance_um=5, max_n_planes=2)
    assert groups(r.membership) == [{1, 2}, {3}] and tuples(r.edges, "source_detection_id", "target_detection_id") == [(1, 2)]
    assert groups(dd.deduplicate_across_planes(simple(spark, FIVE), GRID, max_plane_offset=1, max_xy_distance_um=5, max_n_planes=1).membership) == [{i} for i in range(1, 6)]


def test_one_plane_is_never_merged(spark):
    r = dd.deduplicate_across_planes(simple(spark, [(1, 100, 100, 10), (2, 103, 100, 10), (3, 101, 100, 11)]), GRID, max_plane_offset=1, max_xy_distance_um=3)
    assert groups(r.membership) == [{1, 3}, {2}] and r.edges.count() == 1


def test_chain_overlap(spark):
    nodes = spark.createDataFrame([(1, 10), (2, 11), (3, 10), (4, 12)], "id long, plane long")
    edges = spark.createDataFrame([(1, 2, 0.1), (3, 4, 0.2), (2, 4, 0.3)], "source long, target long, d double")
    merged, accepted = constrained_merge(nodes, edges, ["d", "source", "target"], 3)
    assert tuples(merged) == [(1, 1), (2, 1), (3, 3), (4, 3)] and accepted.count() == 2


def sequential(nodes, edges, cap):
    """Edges one by one in their order."""
    parent, planes = {i: i for i, _ in nodes}, {i: {p} for i, p in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    taken = []
    for e in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        a, b = sorted((find(e[0]), find(e[1])))
        if a != b:
            if planes[a] & planes[b] or (cap and len(planes[a] | planes[b]) > cap):
                continue
            parent[b], planes[a] = a, planes[a] | planes[b]
        taken.append(e[:2])
    return sorted((i, find(i)) for i, _ in nodes), sorted(taken)


@pytest.mark.parametrize("seed,cap", [(1, None), (2, 2), (3, 3), (4, 4)])
def test_rounds_equal_sequential_merging(spark, seed, cap):
    rng = random.Random(seed)
    nodes = [(i, rng.randrange(6)) for i in range(120)]
    edges = {}
    for _ in range(300):
        a, b = rng.sample(range(120), 2)
        if nodes[a][1] != nodes[b][1]:
            edges[a, b] = round(rng.random(), 1)
    edges = [(a, b, d) for (a, b), d in edges.items()]
    merged, accepted = constrained_merge(spark.createDataFrame(nodes, "id long, plane long"), spark.createDataFrame(edges, "source long, target long, d double"), ["d", "source", "target"], cap)
    want = sequential(nodes, edges, cap)
    assert (tuples(merged), tuples(accepted, "source", "target")) == want


@pytest.mark.parametrize("radius", [0.0, 1.0, 2.5])
def test_distance_join_against_all_pairs(spark, radius):
    rng = random.Random(7)
    a, b = ([(i, rng.randrange(3), rng.choice([float(rng.randint(-5, 5)), rng.uniform(-6, 6)]), float(rng.randint(-5, 5))) for i in range(150)] for _ in range(2))
    df = lambda rows, n: spark.createDataFrame([*rows, (999, 0, float("nan"), 1.0), (998, 0, None, 1.0)], f"{n} long, z long, px double, py double")
    got = tuples(distance_join(df(a, "a"), df(b, "b"), ["z"], radius), "a", "b")
    want = sorted((i, j) for i, z, x, y in a for j, w, u, v in b if z == w and math.hypot(u - x, v - y) <= radius)
    assert got == want
    with pytest.raises(ValueError):
        distance_join(df(a, "a"), df(b, "b"), ["z"], -1.0)


def test_offsets_and_missing_float_columns(spark):
    pts = simple(spark, [(1, 10, 10, 1), (2, 11, 10, 2)])
    r = dd.deduplicate_across_planes(pts, GRID, max_plane_offset=1, max_xy_distance_um=2)
    assert tuples(r.objects, "x_float", "x") == [(10.5, 11)]
    far = dd.build_cross_plane_edge_table(simple(spark, [(1, 0, 0, 5), (2, 0, 0, 3), (3, 0, 0, 2)]), GRID, max_plane_offset=2, max_xy_distance_um=0)
    assert tuples(far, "source_detection_id", "target_detection_id", "plane_offset") == [(2, 1, 2), (3, 2, 1)]


def test_errors(spark):
    pts = simple(spark, FIVE)
    for bad in (dict(max_plane_offset=0, max_xy_distance_um=1), dict(max_plane_offset=1, max_xy_distance_um=-1), dict(max_plane_offset=1, max_xy_distance_um=1, max_n_planes=0)):
        with pytest.raises(ValueError):
            dd.deduplicate_across_planes(pts, GRID, **bad)
    edges = dd.build_cross_plane_edge_table(pts, GRID, max_plane_offset=1, max_xy_distance_um=5)
    with pytest.raises(ValueError, match="unknown"):
        dd.build_object_membership_table(pts.where("detection_id <> 2"), edges)
    member = spark.createDataFrame([(1, 1), (2, 1)], "object_id long, detection_id long")
    with pytest.raises(ValueError, match="several"):
        dd.aggregate_cleaned_objects(pts, member)


def test_shape_means(spark):
    pts = points(spark, [(1, 1, 0, 0, 0, 4, 0.5), (2, 1, 0, 0, 1, 8, 0.25)], ", area_px long, eccentricity double")
    out = dd.aggregate_cleaned_objects(pts, spark.createDataFrame([(1, 1), (1, 2)], "object_id long, detection_id long")).first()
    assert (out.mean_area_px, out.max_area_px, out.mean_eccentricity) == (6.0, 8.0, 0.375)


def test_components_of_structs(spark):
    edges = spark.createDataFrame([((0, 1), (1, 5)), ((0, 2), (1, 5)), ((0, 9), (1, 9))], "u struct<s:int,i:long>, v struct<s:int,i:long>")
    assert {(tuple(r.node), tuple(r.root)) for r in connected_components(edges).collect()} == {((0, 2), (0, 1)), ((1, 5), (0, 1)), ((1, 9), (0, 9))}


def test_plane_pairs(spark):
    counts = [1, 1, 10, 15, 50, 60, 20, 10, 1, 1]
    pts = simple(spark, [(100 * z + i, 0, 0, z) for z, n in enumerate(counts, 1) for i in range(n)])
    assert qc.select_qc_plane_pairs(pts, n_pairs=2) == [(3, 4), (7, 8)]
    assert qc.select_qc_plane_pairs(simple(spark, [(1, 0, 0, 1)])) == []
    assert qc.select_qc_plane_pairs(simple(spark, [(1, 0, 0, 1), (2, 0, 0, 5)]), n_pairs=1) == [(1, 5)]
    with pytest.raises(ValueError):
        qc.select_qc_plane_pairs(pts, n_pairs=0)
