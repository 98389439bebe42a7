"""Two channels: candidates by distance, optimal one-to-one matches per plane, object relationships, collapsed events."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coordinates import check_compatible_spaces, preferred_xy
from ..functions.ids import with_dense_ids
from ..model import POINT_COLUMNS, PointCloudDataset, ProcessingProvenance, SpaceDefinition, require_columns
from ..scratch import materialize
from .assignment import match_component
from .distance import distance_join
from .graph import connected_components

MATCH_COLUMNS = ["a_detection_id", "b_detection_id", "z", "dx_um", "dy_um", "xy_distance_um", "a_candidate_count", "b_candidate_count", "is_ambiguous"]


@dataclass(frozen=True)
class ColocalizationResult:
    matches: DataFrame
    plane_summary: DataFrame


@dataclass(frozen=True)
class ObjectRelationshipResult:
    relationships: DataFrame


def build_candidates(a: DataFrame, b: DataFrame, space: SpaceDefinition, *, max_xy_distance_um: float) -> DataFrame:
    """Pairs of one plane within the distance, with how many candidates each side has."""
    rx, ry = space.resolution("x"), space.resolution("y")

    def side(df: DataFrame, name: str) -> DataFrame:
        x, y = preferred_xy(df)
        return df.select(F.col("detection_id").alias(f"{name}_detection_id"), F.col("z").cast("long").alias("z"), (F.col(x).cast("double") * rx).alias("px"), (F.col(y).cast("double") * ry).alias("py"))

    pairs = distance_join(side(a, "a"), side(b, "b"), ["z"], max_xy_distance_um)
    count = lambda s: F.count("*").over(Window.partitionBy("z", f"{s}_detection_id"))
    pairs = pairs.withColumn("a_candidate_count", count("a")).withColumn("b_candidate_count", count("b"))
    return pairs.withColumn("is_ambiguous", (F.col("a_candidate_count") > 1) | (F.col("b_candidate_count") > 1)).select(*MATCH_COLUMNS)


def select_matches(candidates: DataFrame, max_xy_distance_um: float) -> DataFrame:
    """The largest one-to-one set of candidates per plane, of least total distance among those.

    Unambiguous pairs are matches as they are, and stars (all other pairs of one side's detection have no rival) give
    their shortest edge; only what is left goes to the assignment solver, one connected component at a time. Ties go to smaller ids.
    """
    single = candidates.where("a_candidate_count = 1 AND b_candidate_count = 1")
    rest = candidates.where("a_candidate_count > 1 OR b_candidate_count > 1")
    # detection ids are unique per channel, so negative ids keep the two sides apart
    node_a, node_b = F.struct(F.lit(0).alias("side"), F.col("a_detection_id").cast("long").alias("id")), F.struct(F.lit(1).alias("side"), F.col("b_detection_id").cast("long").alias("id"))
    edges = materialize(rest.withColumn("u", node_a).withColumn("v", node_b), "candidates")
    roots = connected_components(edges.select("u", "v"))
    placed = edges.join(roots.withColumnRenamed("node", "u"), "u", "left").withColumn("component", F.coalesce("root", "u")).drop("u", "v", "root")
    per = Window.partitionBy("component")
    shaped = placed.withColumn("__a", F.max("a_candidate_count").over(per)).withColumn("__b", F.max("b_candidate_count").over(per)).withColumn("__n", F.count("*").over(per))
    shaped = materialize(shaped, "components")
    star = (F.col("__n") == F.col("__a")) | (F.col("__n") == F.col("__b"))
    first = F.row_number().over(per.orderBy("xy_distance_um", "a_detection_id", "b_detection_id"))
    stars = shaped.where(star).withColumn("__first", first).where("__first = 1").select(*MATCH_COLUMNS)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a_detection_id", "b_detection_id"], ignore_index=True)
        keep = match_component(pdf["a_detection_id"].to_numpy(), pdf["b_detection_id"].to_numpy(), pdf["xy_distance_um"].to_numpy(), max_xy_distance_um)
        return pdf.loc[keep, MATCH_COLUMNS]

    dense = shaped.where(~star)
    schema = dense.select(*MATCH_COLUMNS).schema
    solved = dense.select("component", *MATCH_COLUMNS).groupBy("component").applyInPandas(solve, schema)
    return single.unionByName(stars).unionByName(solved)


def plane_summary(a: DataFrame, b: DataFrame, candidates: DataFrame, matches: DataFrame, space: SpaceDefinition) -> DataFrame:
    """One row for every plane that the space declares, empty ones too; rates and distances are null where undefined."""
    spark = a.sparkSession
    low, high = space.bounds("z")
    planes = spark.range(low, high + 1).withColumnRenamed("id", "z")
    n = lambda df, name: df.groupBy(F.col("z").cast("long").alias("z")).agg(F.count("*").alias(name))
    ambiguous = lambda s: F.countDistinct(F.when(F.col(f"{s}_candidate_count") > 1, F.col(f"{s}_detection_id"))).alias(f"n_ambiguous_{s}")
    found = candidates.groupBy("z").agg(F.count("*").alias("n_candidate_pairs"), ambiguous("a"), ambiguous("b"))
    taken = matches.groupBy("z").agg(F.count("*").alias("n_accepted_matches"), F.median("xy_distance_um").alias("median_match_distance_um"), F.max("xy_distance_um").alias("maximum_match_distance_um"))
    every = planes
    for part in (n(a, "n_a_detections"), n(b, "n_b_detections"), found, taken):
        every = every.join(part, "z", "left")
    counts = ["n_a_detections", "n_b_detections", "n_candidate_pairs", "n_accepted_matches", "n_ambiguous_a", "n_ambiguous_b"]
    every = every.fillna(0, counts)
    m = F.col("n_accepted_matches")
    return every.select(
        "z", "n_a_detections", "n_b_detections", "n_candidate_pairs", "n_accepted_matches",
        (F.col("n_a_detections") - m).alias("n_unmatched_a"), (F.col("n_b_detections") - m).alias("n_unmatched_b"),
        F.try_divide(m, F.col("n_a_detections")).alias("raw_match_rate_a"), F.try_divide(m, F.col("n_b_detections")).alias("raw_match_rate_b"),
        "median_match_distance_um", "maximum_match_distance_um", "n_ambiguous_a", "n_ambiguous_b",
    )


def validate_inputs(a: PointCloudDataset, b: PointCloudDataset) -> None:
    if a.subject_name != b.subject_name:
        raise ValueError(f"channels are of different subjects: {a.subject_name!r} and {b.subject_name!r}")
    check_compatible_spaces(a.space, b.space)
    for ds in (a, b):
        if ds.metadata.representation.representation_type != "point_centroids":
            raise ValueError("matching takes point_centroids")
        require_columns(ds.points, POINT_COLUMNS, "points")
        if ds.points.groupBy("detection_id").count().where("count > 1").limit(1).count():
            raise ValueError("detection_id must be unique in each channel")


def match_colocalized_detections(a: PointCloudDataset, b: PointCloudDataset, *, max_xy_distance_um: float) -> ColocalizationResult:
    validate_inputs(a, b)
    candidates = materialize(build_candidates(a.points, b.points, a.space, max_xy_distance_um=max_xy_distance_um), "candidates")
    matches = materialize(select_matches(candidates, max_xy_distance_um), "matches")
    return ColocalizationResult(matches, plane_summary(a.points, b.points, candidates, matches, a.space))


def status(many_a: Column, many_b: Column) -> Column:
    """Four-way name by whether several A and several B are involved."""
    return F.when(many_a & many_b, "many_to_many").when(many_a, "multiple_a_to_one_b").when(many_b, "one_a_to_multiple_b").otherwise("one_to_one")


def map_detection_matches_to_objects(matches: DataFrame, a_membership: DataFrame, b_membership: DataFrame, *, validate: bool = True) -> ObjectRelationshipResult:
    """Pairs of objects whose detections match, with how often, in how many planes, how far, and how many partners each has."""
    if validate:
        for side, members in (("a", a_membership), ("b", b_membership)):
            require_columns(members, ("object_id", "detection_id"), "membership")
            if members.groupBy("detection_id").count().where("count > 1").limit(1).count():
                raise ValueError("a detection belongs to several objects")
            lost = matches.select(F.col(f"{side}_detection_id").alias("detection_id")).join(members, "detection_id", "left_anti")
            if ids := [r[0] for r in lost.limit(10).collect()]:
                raise ValueError(f"matched detections of channel {side} without an object: {ids}")
    member = lambda df, s: df.select(F.col("detection_id").alias(f"{s}_detection_id"), F.col("object_id").cast("long").alias(f"{s}_object_id"))
    pairs = matches.join(member(a_membership, "a"), "a_detection_id", "left").join(member(b_membership, "b"), "b_detection_id", "left")
    d = "xy_distance_um"
    rows = pairs.groupBy("a_object_id", "b_object_id").agg(
        F.count("*").alias("n_detection_matches"), F.countDistinct("z").alias("n_matched_planes"), F.min(d).alias("min_distance_um"), F.median(d).alias("median_distance_um"), F.max(d).alias("max_distance_um")
    )
    partners = lambda s: F.count("*").over(Window.partitionBy(f"{s}_object_id"))
    rows = rows.withColumn("a_partner_count", partners("a")).withColumn("b_partner_count", partners("b"))
    # an A with several partners has several B
    return ObjectRelationshipResult(rows.withColumn("relationship_status", status(F.col("b_partner_count") > 1, F.col("a_partner_count") > 1)))


def collapse_colocalized_object_components(a: DataFrame, b: DataFrame, relationships: DataFrame, *, validate: bool = True) -> DataFrame:
    """One event per connected group of related objects: mean place (half-even integers), member lists, status; numbered from 0
    by (smallest A, smallest B). Statuses in ``relationships`` don't matter; objects count alike, whatever their detections."""
    require_columns(relationships, ("a_object_id", "b_object_id"), "relationships")
    if validate:
        if relationships.groupBy("a_object_id", "b_object_id").count().where("count > 1").limit(1).count():
            raise ValueError("relationships hold a pair twice")
        for s, df in (("a", a), ("b", b)):
            lost = relationships.select(F.col(f"{s}_object_id").alias("object_id")).join(df.select("object_id"), "object_id", "left_anti")
            if ids := [r[0] for r in lost.limit(10).collect()]:
                raise ValueError(f"relationships name unknown objects of channel {s}: {ids}")
    node = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).cast("long").alias("id"))
    edges = relationships.select(node(0, "a_object_id").alias("u"), node(1, "b_object_id").alias("v"))
    roots = connected_components(edges)
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    # a float column counts if either table has it; rows without it are left out of its mean
    names = ["x", "y", "z"]
    floats = {c: f"{c}_float" for c in names if f"{c}_float" in a.columns or f"{c}_float" in b.columns}

    def places(df: DataFrame, side: int) -> DataFrame:
        column = lambda c: (F.col(floats[c]) if floats[c] in df.columns else F.lit(None)) if c in floats else F.col(c)
        return df.select(node(side, "object_id").alias("node"), *[column(c).cast("double").alias(c) for c in names])

    rows = nodes.join(places(a, 0).unionByName(places(b, 1)), "node")
    ids = lambda side: F.array_sort(F.collect_set(F.when(F.col("node.side") == side, F.col("node.id"))))
    events = rows.groupBy("root").agg(*[F.avg(c).alias(f"{c}_float") for c in names], ids(0).alias("a_object_ids"), ids(1).alias("b_object_ids"))
    counts = edges.join(nodes.withColumnRenamed("node", "u"), "u").groupBy("root").agg(F.count("*").alias("n_relationships"))
    events = events.join(counts, "root").withColumn("n_a_objects", F.size("a_object_ids").cast("long")).withColumn("n_b_objects", F.size("b_object_ids").cast("long"))
    events = events.withColumn("relationship_status", status(F.col("n_a_objects") > 1, F.col("n_b_objects") > 1)).withColumn("__a", F.col("a_object_ids")[0]).withColumn("__b", F.col("b_object_ids")[0])
    numbered = with_dense_ids(events.drop("root"), ["__a", "__b"], "object_id", start=0)
    rounded = [F.rint(f"{c}_float").cast("long").alias(c) for c in names]
    return numbered.select("object_id", *rounded, *[f"{c}_float" for c in names], "n_a_objects", "n_b_objects", "n_relationships", "relationship_status", "a_object_ids", "b_object_ids")


def collapse_to_dataset(subject_name: str, space_of: PointCloudDataset, events: DataFrame, *, population_id: str, channel_a: str, channel_b: str, source_name: str | None = None, processing_parameters: dict | None = None) -> PointCloudDataset:
    """Events as a data set of cleaned objects, with where they came from."""
    parameters = {"population_id": population_id, "channel_a": channel_a, "channel_b": channel_b, "component_rule": "connected_components", "coordinate_rule": "mean_of_objects"} | dict(processing_parameters or {})
    metadata = space_of.metadata.derived("cleaned_objects", ProcessingProvenance("collapse_colocalized_objects", source_name, parameters))
    return PointCloudDataset(subject_name, events, metadata)
