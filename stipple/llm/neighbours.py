"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample of ``fit_rows`` vectors; every row goes to one leaf. A query walks the tree with a
priority queue of nodes, best inner product with the node's centre first, and so gets leaves in order of promise. How
many it visits is calibrated: exact neighbours of a bounded number of queries are found by brute force over all rows,
and the visits are widened until the share of them in visited leaves reaches ``recall``. A query goes on beyond that while
the leaves it has visited hold too few rows. The rows are written in the order of their leaves to the shared folder, and a task reads
them for a bounded number of queries from near leaves, a bounded piece at a time, and passes over what none of those visits. So neither queries
nor found pairs are shuffled, and neither a crowded leaf nor a vector with many copies needs one large task.

Scores are inner products in double precision of the vectors as stored. Products of matrices only bound the candidates; their
scores are then summed in one order for all rows, so equal vectors have equal scores and ties go to the smaller vec_id.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do vectors of
another length than most have, or rows without vec_id; of a repeated vec_id each row is a candidate, and as queries they are one,
the row with the smallest vector; with fewer than ``k`` candidates all are returned; an empty table gives an empty result. Columns
besides vec_id and embedding are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, materialize, n_partitions, table
from .sampling import drawn_by_hash

K, EVERY = 20, 20
#: Rows that the tree is fitted on, queries that calibrate it (both at most, in expectation), recall to reach on those.
FIT_ROWS, CALIBRATE, RECALL = 20_000, 100, 0.97
BRANCH, LEAF_ROWS, BLOCK_ROWS = 16, 256, 1024
QUERY_CHUNK = 512
#: Queries that a task answers at once; (query, leaf) marks that it holds; pairs whose scores it sums at once; bytes of the index in a piece.
ANSWERED, MARKS, PAIRS_AT_ONCE, PIECE_BYTES = 2048, 1 << 24, 1 << 16, 4 << 20


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull()).where(fine)
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (lengths["n"] if lengths else 0)).select("vec_id", e.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = sums[n > 0] / n[n > 0][:, None]
    return np.unique(centres, axis=0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(1)


class Tree:
    """children[node]: (centres, node or -1 - leaf for each centre). Node 0 is the root; a tree of one leaf has no children."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, seed: int = 11):
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_leaves = 0
        self.leaf_rows, self.rng = max(2, leaf_rows), np.random.default_rng(seed)
        self._grow(sample)
        self.n_leaves = max(1, self.n_leaves)

    def _grow(self, x: np.ndarray) -> int:
        centres = k_means(x, min(BRANCH, -(-len(x) // self.leaf_rows)), self.rng) if len(x) > self.leaf_rows else x[:0]
        if len(centres) < 2:
            self.n_leaves += 1
            return -self.n_leaves
        at = len(self.children)
        self.children.append((centres, np.zeros(0, np.int64)))
        own = nearest(x, centres)
        self.children[at] = centres, np.array([self._grow(x[own == i]) for i in range(len(centres))])
        return at

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        if not self.children:
            return out
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            centres, below = self.children[node]
            own = below[nearest(x[rows], centres)]
            for child in np.unique(own):
                some = rows[own == child]
                if child < 0:
                    out[some] = -1 - child
                else:
                    todo.append((int(child), some))
        return out

    def leaves(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        if not self.children:
            yield 0
            return
        queue: list[tuple[float, int]] = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            centres, below = self.children[node]
            for score, child in zip((centres @ query).tolist(), below.tolist()):
                heapq.heappush(queue, (-score, child))


def best_of(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, vec_ids, scores) of each query's k best rows but its own, best first, ties by id."""
    for at in range(0, len(queries), QUERY_CHUNK):
        q = queries[at : at + QUERY_CHUNK]
        rough = q @ x.T
        rough[query_ids[at : at + QUERY_CHUNK, None] == ids[None]] = -np.inf
        n = rough.shape[1]
        edge = np.partition(rough, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), -np.inf)
        # far more than what the order of the sum can change
        edge = edge - 1e-9 * (np.abs(edge, where=np.isfinite(edge), out=np.zeros_like(edge)) + np.sqrt((q**2).sum(1) * (x**2).sum(1).max(initial=0)))
        for i in range(len(q)):
            some = np.flatnonzero((rough[i] >= edge[i]) & (rough[i] > -np.inf))
            score = (x[some] * q[i]).sum(1)
            order = np.lexsort((ids[some], -score))[:k]
            yield at + i, ids[some][order], score[order]


class Best:
    """The k best rows so far of each of some queries (ascending, distinct ids), by the exact score, ties by id."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int):
        self.queries, self.query_ids, self.k = queries, query_ids, k
        self.ids, self.scores = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k))
        self.n = np.zeros(len(queries), np.int64)
        self.norms = np.sqrt((queries**2).sum(1))

    def meet(self, some: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Offers rows to the queries at the places ``some``. Products of matrices only pass over rows, by far more than their error."""
        rough = self.queries[some] @ x.T
        allowed = np.ones(rough.shape, bool)
        place = np.minimum(np.searchsorted(self.query_ids[some], ids), len(some) - 1)
        own = np.flatnonzero(self.query_ids[some][place] == ids)
        allowed[place[own], own] = False
        edge = np.where(self.n[some] == self.k, self.scores[some, -1], -np.inf)
        if len(ids) - len(own) > self.k and (fresh := np.flatnonzero(edge == -np.inf)).size:
            least = np.where(allowed[fresh], rough[fresh], -np.inf)
            edge[fresh] = np.partition(least, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
        slack = 1e-9 * (np.abs(edge, where=np.isfinite(edge), out=np.zeros_like(edge)) + self.norms[some] * np.sqrt((x**2).sum(1).max()))
        q, r = np.nonzero(allowed & (rough >= (edge - slack)[:, None]))
        for at in range(0, len(q), PAIRS_AT_ONCE):
            i, j = some[q[at : at + PAIRS_AT_ONCE]], r[at : at + PAIRS_AT_ONCE]
            self._add(i, ids[j], (x[j] * self.queries[i]).sum(1))

    def _add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched = np.unique(query)
        held = np.arange(self.k) < self.n[touched, None]
        query = np.r_[np.repeat(touched, self.n[touched]), query]
        ids, scores = np.r_[self.ids[touched][held], ids], np.r_[self.scores[touched][held], scores]
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        n = np.diff(np.r_[first, len(query)])
        rank = np.arange(len(query)) - np.repeat(first, n)
        kept = rank < self.k
        self.ids[query[kept], rank[kept]], self.scores[query[kept], rank[kept]] = ids[kept], scores[kept]
        self.n[touched] = np.minimum(n, self.k)


PAIRS = "query_id long, ids array<long>, scores array<double>"


def found_batch(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, c = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([x.tolist() for x in b], pa.list_(pa.int64())), pa.array([x.tolist() for x in c], pa.list_(pa.float64()))], ["query_id", "ids", "scores"])


def merged(parts: DataFrame, k: int) -> DataFrame:
    """One row per query and rank; every part holds at most k entries, and a query a bounded number of parts."""
    pairs = F.flatten(F.collect_list(F.arrays_zip(F.transform("scores", lambda s: -s).alias("m"), F.col("ids").alias("i"))))
    return parts.groupBy("query_id").agg(F.slice(F.array_sort(pairs), 1, k).alias("best"))


def ranked(best: DataFrame) -> DataFrame:
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("b")["i"].alias("vec_id"), (-F.col("b")["m"]).alias("score"))


def exact(index: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int) -> DataFrame:
    """Brute force of a bounded number of queries against all rows of ``index`` (vec_id, v)."""
    shipped = index.sparkSession.sparkContext.broadcast((queries, query_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, q_ids = shipped.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i, ids, scores in best_of(q, q_ids, matrix(batch.column("v")), batch.column("vec_id").to_numpy(), k):
                if i in best:
                    ids, scores = np.r_[best[i][0], ids], np.r_[best[i][1], scores]
                    order = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[order], scores[order]
                best[i] = ids, scores
        if best:
            yield found_batch([(int(q_ids[i]), *b) for i, b in best.items()])

    return merged(index.select("vec_id", "v").mapInArrow(run, PAIRS), k)


def calibrated_visits(tree: Tree, index: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int, recall: float) -> int:
    """The fewest leaves whose visit finds the wanted share of the calibration queries' true neighbours."""
    best = exact(index, queries, query_ids, k)
    true = ranked(best).join(index.select("vec_id", "leaf").dropDuplicates(["vec_id"]), "vec_id").select("query_id", "leaf").toPandas()
    by_id = {int(i): q for i, q in zip(query_ids, queries)}
    places = []
    for query_id, leaves in true.groupby("query_id")["leaf"]:
        order = {leaf: n for n, leaf in enumerate(tree.leaves(by_id[query_id]), 1)}
        places += [order[leaf] for leaf in leaves]
    places = np.array(places)
    visits = 1
    while len(places) and visits < tree.n_leaves and (places <= visits).mean() < recall:
        visits += 1
    return visits


def drawn(rows: DataFrame, n: int, salt: str) -> tuple[np.ndarray, np.ndarray]:
    """About n rows, by the hash of vec_id, in its order."""
    share = min(1.0, n / max(1, rows.count()))
    some = rows.where(drawn_by_hash(share, F.lit(salt), "vec_id") | F.lit(share >= 1)).toPandas().drop_duplicates("vec_id").sort_values("vec_id")
    return some["vec_id"].to_numpy(np.int64), np.array(some["v"].tolist(), np.float64)


def search(vectors: DataFrame, is_query, k: int = K, recall: float = RECALL, fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row that ``is_query`` (a condition on vec_id) selects."""
    spark = vectors.sparkSession
    rows = materialize(valid(vectors), "vectors")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    _, sample = drawn(rows, fit_rows, "fit")
    if not len(sample):
        sample = matrix(rows.limit(1).toArrow().column("v"))
    tree = spark.sparkContext.broadcast(Tree(sample, max(8, round(LEAF_ROWS * len(sample) / total))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.value.leaf_of(matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["vec_id", "v", "leaf"])

    kind = rows.schema["v"].dataType.simpleString()
    placed = rows.mapInArrow(place, f"vec_id long, v {kind}, leaf long")
    n = n_partitions(spark)
    index = materialize(placed.repartitionByRange(n, "leaf", "vec_id").sortWithinPartitions("leaf"), "vector-index", **{"parquet.block.size": PIECE_BYTES})
    asking = index.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "leaf")).alias("r")).select("vec_id", "r.v", "r.leaf")
    ids, queries = drawn(asking.select("vec_id", "v"), CALIBRATE, "calibrate")
    visits = calibrated_visits(tree.value, index, queries, ids, k, recall) if len(ids) else tree.value.n_leaves
    # one number per leaf, and the fit bounds the leaves
    size = np.zeros(tree.value.n_leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():
        size[r["leaf"]] = r["count"]
    sizes = spark.sparkContext.broadcast(size)
    files = sorted(index.inputFiles())

    def visited(queries: np.ndarray) -> np.ndarray:
        """(query, leaf): whether the query visits the leaf."""
        size, out = sizes.value, np.zeros((len(queries), len(sizes.value)), bool)
        for i, query in enumerate(queries):
            seen = 0
            for n, leaf in enumerate(tree.value.leaves(query)):
                if n >= visits and seen > k:
                    break
                seen += size[leaf]
                out[i, leaf] = True
        return out

    def answer(query_ids: np.ndarray, queries: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(query_ids)
        best = Best(queries[order], query_ids[order], k)
        marks = visited(best.queries)
        wanted = np.flatnonzero(marks.any(0))
        for leaf, x, ids in pieces(files, wanted):
            some = np.flatnonzero(marks[:, leaf])
            best.meet(some, x, ids)
        n = best.n
        rank = np.concatenate([np.zeros(0, np.int64), *(np.arange(1, m + 1) for m in n)]).astype(np.int32)
        held = np.arange(k) < n[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(best.query_ids, n)), pa.array(rank), pa.array(best.ids[held]), pa.array(best.scores[held])], ["query_id", "rank", "vec_id", "score"])

    def search_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(1, min(ANSWERED, MARKS // len(sizes.value)))
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                held.append(batch.slice(at, at_once))
                size += held[-1].num_rows
                while size >= at_once:
                    whole = pa.Table.from_batches(held)
                    yield answer(whole.column("vec_id")[:at_once].to_numpy(), matrix(whole.column("v")[:at_once]))
                    held, size = whole[at_once:].to_batches(), size - at_once
        if size:
            whole = pa.Table.from_batches(held)
            yield answer(whole.column("vec_id").to_numpy(), matrix(whole.column("v")))

    near = asking.repartitionByRange(n, "leaf", "vec_id").sortWithinPartitions("leaf").select("vec_id", "v")
    return near.mapInArrow(search_for, "query_id long, rank int, vec_id long, score double")


def pieces(files: list[str], wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, vectors, vec_ids) of the wanted leaves (ascending), at most BLOCK_ROWS rows at a time, of files that are sorted by leaf."""
    for file in files:
        fs, path = filesystem(file)
        with fs.open_input_file(path) as f:
            index = pq.ParquetFile(f)
            for group in range(index.num_row_groups):
                meta = index.metadata.row_group(group)
                bounds = meta.column(meta.num_columns - 1).statistics  # of leaf, the last column
                if bounds is not None and bounds.has_min_max and np.searchsorted(wanted, bounds.min) == np.searchsorted(wanted, bounds.max, "right"):
                    continue
                for batch in index.iter_batches(batch_size=4 * BLOCK_ROWS, row_groups=[group]):
                    leaf, ids, x = batch.column("leaf").to_numpy(), batch.column("vec_id").to_numpy(), None
                    cuts = np.r_[0, np.flatnonzero(leaf[1:] != leaf[:-1]) + 1, len(leaf)]
                    for a, b in zip(cuts, cuts[1:]):
                        if a < b and wanted[min(np.searchsorted(wanted, leaf[a]), len(wanted) - 1)] == leaf[a]:
                            x = matrix(batch.column("v")) if x is None else x
                            for at in range(a, b, BLOCK_ROWS):
                                end = min(b, at + BLOCK_ROWS)
                                yield int(leaf[a]), x[at:end], ids[at:end]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
