import itertools
import random

import numpy as np
import pytest
from helpers import cloud, simple, space, tuples

from stipple.operators import colocalization as co
from stipple.operators.assignment import assign, match_component

GRID = space([100, 100, 3])


def match(spark, a, b, r, grid=GRID):
    return co.match_colocalized_detections(cloud(simple(spark, a), grid), cloud(simple(spark, b), grid), max_xy_distance_um=r)


def test_exact_plane(spark):
    r = match(spark, [(1, 10, 10, 0), (2, 20, 20, 1)], [(11, 11, 10, 0), (12, 20, 20, 2)], 2)
    assert tuples(r.matches, "a_detection_id", "b_detection_id", "z") == [(1, 11, 0)]
    assert [(x.z, x.n_accepted_matches, x.n_unmatched_a, x.n_unmatched_b, x.raw_match_rate_a) for x in r.plane_summary.orderBy("z").collect()] == [(0, 1, 0, 0, 1.0), (1, 0, 1, 0, 0.0), (2, 0, 0, 1, None)]


def test_cardinality_goes_first(spark):
    r = match(spark, [(1, 0, 10, 0), (2, 2, 10, 0)], [(11, 1, 10, 0), (12, 0, 10, 0)], 1.1)
    assert tuples(r.matches, "a_detection_id", "b_detection_id", "is_ambiguous") == [(1, 12, True), (2, 11, True)]
    row = r.plane_summary.where("z = 0").first()
    assert (row.n_candidate_pairs, row.n_ambiguous_a, row.n_ambiguous_b) == (3, 1, 1)


def test_resolution_and_empty_channels(spark):
    assert match(spark, [(1, 10, 10, 0)], [(11, 12, 10, 0)], 3, space([100, 100, 1], [2.0, 1.0, 1.0])).matches.count() == 0
    r = match(spark, [], [(11, 2, 2, 1)], 3, space([9, 9, 2], indexing="one_based"))
    assert r.matches.count() == 0 and tuples(r.plane_summary, "z", "n_unmatched_b") == [(1, 1), (2, 0)]


def best(edges, n):
    """Most pairs, then least distance, by trying all sets."""
    top = (0, 0.0)
    for k in range(len(edges), 0, -1):
        for s in itertools.combinations(edges, k):
            if len({e[0] for e in s}) == len({e[1] for e in s}) == k:
                top = min([x for x in (top if top[0] == k else None, (k, sum(e[2] for e in s))) if x], key=lambda x: x[1])
        if top[0] == k:
            return top
    return top


def test_assignment_against_all_sets():
    rng = random.Random(3)
    for _ in range(150):
        edges = {(rng.randrange(4), rng.randrange(4)): round(rng.random() * 5, 2) for _ in range(rng.randint(1, 8))}
        edges = [(a, b, d) for (a, b), d in edges.items()]
        a, b, d = (np.array(c) for c in zip(*edges))
        keep = match_component(a, b, d, 5.0)
        want = best(edges, 4)
        assert len(keep) == want[0] == len(set(a[keep])) == len(set(b[keep])) and abs(d[keep].sum() - want[1]) < 1e-9
    cost = np.random.default_rng(1).random((6, 4))
    assert abs(sum(cost[r, c] for r, c in assign(cost)) - min(sum(cost[p[i], i] for i in range(4)) for p in itertools.permutations(range(6), 4))) < 1e-12


def test_dense_planes_against_all_sets(spark):
    rng = random.Random(8)
    a, b = ([(base + i, rng.randrange(6), rng.randrange(3), i % 3) for i in range(15)] for base in (1, 101))
    r = match(spark, a, b, 1.5)
    got = r.matches.collect()
    for z in range(3):
        edges = [(i, j, float(np.hypot(x - u, y - v))) for i, x, y, w in a for j, u, v, t in b if w == t == z and np.hypot(x - u, y - v) <= 1.5]
        own = [m for m in got if m.z == z]
        k, total = best(edges, 5)
        assert len(own) == k and abs(sum(m.xy_distance_um for m in own) - total) < 1e-9


def test_input_checks(spark):
    a = simple(spark, [(1, 1, 1, 0)])
    with pytest.raises(ValueError, match="subjects"):
        co.match_colocalized_detections(cloud(a, GRID), cloud(a, GRID, subject="other"), max_xy_distance_um=1)
    with pytest.raises(ValueError, match="point_centroids"):
        co.match_colocalized_detections(cloud(a, GRID), cloud(a, GRID, "cleaned_objects"), max_xy_distance_um=1)
    with pytest.raises(ValueError, match="shape"):
        co.match_colocalized_detections(cloud(a, GRID), cloud(a, space([9, 9, 9])), max_xy_distance_um=1)
    with pytest.raises(ValueError, match="unique"):
        co.match_colocalized_detections(cloud(a.union(a), GRID), cloud(a, GRID), max_xy_distance_um=1)


def relate(spark, matches, a, b):
    m = spark.createDataFrame(matches, "a_detection_id long, b_detection_id long, z long, xy_distance_um double")
    member = lambda d: spark.createDataFrame([(o, x) for o, xs in d.items() for x in xs], "object_id long, detection_id long")
    return co.map_detection_matches_to_objects(m, member(a), member(b)).relationships


def test_relationships(spark):
    rows = relate(spark, [(1, 11, 0, 1.0), (2, 12, 1, 1.5)], {1: [1, 2]}, {10: [11], 20: [12]})
    assert tuples(rows, "a_object_id", "b_object_id", "n_detection_matches", "a_partner_count", "b_partner_count", "relationship_status") == [(1, 10, 1, 2, 1, "one_a_to_multiple_b"), (1, 20, 1, 2, 1, "one_a_to_multiple_b")]
    one = relate(spark, [(1, 11, 0, 1.0), (2, 12, 1, 2.0), (3, 13, 2, 4.0)], {1: [1, 2, 3]}, {10: [11, 12, 13]}).first()
    assert (one.n_matched_planes, one.min_distance_um, one.median_distance_um, one.max_distance_um, one.relationship_status) == (3, 1.0, 2.0, 4.0, "one_to_one")
    with pytest.raises(ValueError, match="without an object"):
        relate(spark, [(1, 11, 0, 1.0)], {1: [2]}, {10: [11]})
    with pytest.raises(ValueError, match="several"):
        relate(spark, [(1, 11, 0, 1.0)], {1: [1], 2: [1]}, {10: [11]})


def test_collapse(spark):
    objects = lambda rows: spark.createDataFrame(rows, "object_id long, x long, y long, z long")
    a, b = objects([(1, 10, 10, 0), (2, 12, 10, 0), (3, 1, 1, 1), (4, 9, 9, 9)]), objects([(10, 11, 10, 0), (11, 2, 1, 2)]).selectExpr("*", "x + 0.0D as x_float")
    rel = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "a_object_id long, b_object_id long")
    rows = co.collapse_colocalized_object_components(a, b, rel).orderBy("object_id").collect()
    assert [(r.object_id, r.x, r.a_object_ids, r.b_object_ids, r.n_relationships, r.relationship_status) for r in rows] == [(0, 11, [1, 2], [10], 2, "multiple_a_to_one_b"), (1, 2, [3], [11], 1, "one_to_one")]
    # x_float exists in one table only, so the other's rows are left out of its mean; z is half-even
    assert rows[1].x_float == 2.0 and (rows[1].z_float, rows[1].z) == (1.5, 2)
    with pytest.raises(ValueError, match="twice"):
        co.collapse_colocalized_object_components(a, b, rel.union(rel))
    with pytest.raises(ValueError, match="unknown"):
        co.collapse_colocalized_object_components(a.where("object_id > 1"), b, rel)
