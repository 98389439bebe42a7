"""Components of edge tables: plain ones, and merges under plane constraints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: of one orderable type) that isn't its component's smallest; root is the smallest.

    Alternates large-star and small-star steps. Each round is written to the shared folder, so it can be read again after a
    loss of executors. A node's minimum comes from a partial aggregation and goes back by a join, so nodes of high
    degree need no task of their own.
    """
    current = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "components")
    mark = None
    for _ in range(max_rounds):
        # large star: every node hands the smallest of its neighbours and itself to its larger neighbours
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every node hands its smallest neighbour to itself and its smaller neighbours
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        handed = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialize(handed.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        seen = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
    raise RuntimeError("components did not settle")


#: Open edges that one task settles one by one; more of them go through rounds first.
FEW = 100_000


def settle(max_planes: int | None, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Goes through edges in their order and gives those that are accepted; a and b are the components they join then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        planes: dict = {}

        def find(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for batch in batches:
            taken = []
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "pa", "pb")]
            for i, (a, b, pa_, pb_) in enumerate(zip(*columns)):
                planes.setdefault(a, frozenset(pa_))
                planes.setdefault(b, frozenset(pb_))
                a, b = find(a), find(b)
                if a != b:
                    both = planes[a] | planes[b]
                    if planes[a] & planes[b] or (max_planes is not None and len(both) > max_planes):
                        continue
                    new, old = (a, b) if a < b else (b, a)
                    parent[old], planes[new] = new, both
                taken.append((i, a, b))
            at, a, b = zip(*taken) if taken else ((), (), ())
            out = batch.take(pa.array(at, pa.int64()))
            ends = {"a": a, "b": b}
            yield pa.RecordBatch.from_arrays([pa.array(ends[c], out.schema.field(c).type) if c in ends else out.column(c) for c in keep], keep)

    return run


def constrained_merge(nodes: DataFrame, edges: DataFrame, order: list[str], max_planes: int | None = None, max_rounds: int = 10_000, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Merges along edges in a total order, unless the two sides share a plane or together have too many.

    nodes: (id, plane); edges: (source, target, and the ``order`` columns, which must order them totally; source_plane and
    target_plane, if they are there, are the nodes' planes). Gives (id, root) with the smallest id of each component, and the
    accepted edges; an edge within a component is accepted.

    Equal to going through the edges one by one: in each round every component looks at its smallest remaining edge, and the
    edges that are smallest for both of their ends are taken at once. Edges that can never be taken, because plane sets only
    grow, are dropped before. An edge has its components and their planes with it, so a round costs what the open edges
    do; once they are ``few``, one task goes through the rest.
    """
    key = F.struct(*order)
    names = ["source", "target", *[c for c in order if c not in ("source", "target")]]
    columns = [*names, "a", "b", "pa", "pb"]
    fits = ~F.arrays_overlap("pa", "pb")
    if max_planes is not None:
        fits = fits & (F.size("pa") + F.size("pb") <= max_planes)
    fits = (F.col("a") == F.col("b")) | fits
    left = edges.withColumns({"a": F.col("source"), "b": F.col("target")})
    for end, c in (("a", "source_plane"), ("b", "target_plane")):
        if c in edges.columns:
            left = left.withColumn(f"p{end}", F.array(c))
        else:
            left = left.join(nodes.select(F.col("id").alias(end), F.array("plane").alias(f"p{end}")), end)
    left = materialize(left.select(*columns).where(fits), "merge-edges")
    moves: list[DataFrame] = []
    accepted: list[DataFrame] = []
    for _ in range(max_rounds):
        accepted.append(left.where("a = b").select(*names))
        open_edges = left.where("a <> b")
        n = open_edges.count()
        if n <= few:
            if n:
                kept = [*names, "a", "b"]
                rest = open_edges.repartition(1).sortWithinPartitions(*order)
                taken = materialize(rest.mapInArrow(settle(max_planes, kept), open_edges.select(*kept).schema), "merge-taken")
                accepted.append(taken.select(*names))
                moves.append(taken.where("a <> b").select(F.greatest("a", "b").alias("old"), F.least("a", "b").alias("new")))
            break
        ends = open_edges.select(F.explode(F.array("a", "b")).alias("root"), key.alias("k"))
        least = ends.groupBy("root").agg(F.min("k").alias("least"))
        taken = (
            open_edges.select("a", "b", "pa", "pb", key.alias("k"))
            .join(least.select(F.col("root").alias("a"), F.col("least").alias("la")), "a").where(F.col("k") == F.col("la")).drop("la")
            .join(least.select(F.col("root").alias("b"), F.col("least").alias("lb")), "b").where(F.col("k") == F.col("lb"))
        )
        # each component is an end of at most one taken edge
        taken = materialize(taken.select(F.greatest("a", "b").alias("old"), F.least("a", "b").alias("new"), F.array_union("pa", "pb").alias("planes")), "merge-taken")
        moves.append(taken.select("old", "new"))
        # taken edges end in one component now, and are accepted with the others within a component
        changed = taken.select(F.explode(F.array("old", "new")).alias("__at"), F.col("new").alias("__new"), F.col("planes").alias("__planes"))
        left = open_edges
        for end in ("a", "b"):
            left = left.join(changed.withColumnRenamed("__at", end), end, "left").withColumns({end: F.coalesce("__new", end), f"p{end}": F.coalesce("__planes", f"p{end}")}).drop("__new", "__planes")
        left = materialize(left.select(*columns).where(fits), "merge-edges")
    else:
        raise RuntimeError("merging did not settle")
    # old ids point to new ones that may have moved later: the components of these pointers are the merged ones
    every = accepted[0]
    for more in accepted[1:]:
        every = every.unionByName(more)
    ids = nodes.select("id")
    if not moves:
        return ids.withColumn("root", F.col("id")), every
    pointers = moves[0]
    for more in moves[1:]:
        pointers = pointers.unionByName(more)
    roots = connected_components(pointers.select(F.col("old").alias("u"), F.col("new").alias("v")))
    return ids.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root")), every
