"""SimHash near-duplicates found with a Gray-ordered hierarchical index.

A document's fingerprint sums the bits of its word shingles' XXH64. Equal fingerprints are one class; links are sought
between classes only. With at most k differing bits, one of k + 1 blocks of the fingerprint is equal in both, so the
classes are dealt to k + 1 tables by one block each; in a table they are rotated until that block leads, sorted by Gray
rank (the position in the binary-reflected Gray sequence, in which neighbours differ in few bits), and arranged in a
tree: the members of a node share their leading bits, and every bit in which all of them agree is factored out into
the node. A search goes down the tree, adds up the differences in the bits that each node factored out, and leaves
a whole group as soon as the sum exceeds k. A pair is reported by the first table whose block it shares.

Defined cases: a null, empty or blank text has fingerprint 0 and is linked like any other; texts of fewer words than a
shingle are one shingle; a null doc_id gets its class's component but is never the id of one, unless no member has an
id; rows that share a doc_id are classified each; an empty table gives an empty result. Very long texts are hashed
piece by piece. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bits import bit_sums, bit_sums_of_rows
from .common import discard, materialize, n_partitions, table
from .components import connected_components, local_forest

BITS, SEED = 64, 42
SHINGLE, RADIUS = 3, 2
#: Bits by which a tree level is longer than the one above.
STEP = 4
CHUNK, QUERIES = 4 << 20, 1 << 16
#: Fingerprints that may meet under one block before the block is divided.
CROWD = 1 << 18
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_chunks(data: bytes) -> Iterator[list[bytes]]:
    """The words of ``data``, A-Z lower-cased, in lists of bounded size. bytes.split() parts at ASCII white space."""
    start = 0
    while start < len(data):
        end = start + CHUNK
        if end < len(data):
            end = m.start() if (m := SPACE.search(data, end)) else len(data)
        yield data[start:end].lower().split()
        start = end


def bit_counts(hashes: list[int]) -> np.ndarray:
    return bit_sums(np.array(hashes, np.uint64), np.zeros(1, np.int64))[0]


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a UTF-8 text."""
    digest = xxhash.xxh64_intdigest
    kept: list[bytes] = []
    counts, n = np.zeros(BITS, np.int64), 0
    for words in word_chunks(data or b""):
        words = kept + words
        if len(words) >= shingle:
            hashes = [digest(b" ".join(t), SEED) for t in zip(*(words[i:] for i in range(shingle)))]
            counts += bit_counts(hashes)
            n += len(hashes)
        kept = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not n and kept:
        counts, n = bit_counts([digest(b" ".join(kept), SEED)]), 1
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            fps = [signed(fingerprint(texts[i].as_py(), shingle)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def blocks(radius: int) -> list[tuple[int, int]]:
    """(offset from the left, width) of the radius + 1 blocks."""
    cuts = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def rotate(codes: np.ndarray, by: int) -> np.ndarray:
    return codes if by == 0 else codes << np.uint64(by) | codes >> np.uint64(BITS - by)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        codes = codes ^ codes >> np.uint64(s)
    return codes


class GrayTree:
    """Distinct codes in Gray order under nodes of shared bits; the first level are the runs of equal leading blocks."""

    def __init__(self, codes: np.ndarray, lead: int):
        self.codes = codes[np.argsort(gray_rank(codes))]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        above = None
        for depth in [*range(lead, BITS, STEP), BITS]:
            prefix = self.codes >> np.uint64(BITS - depth)
            starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]]) if len(prefix) else np.zeros(0, np.int64)
            ones, some = (f.reduceat(self.codes, starts) if len(starts) else self.codes for f in (np.bitwise_and, np.bitwise_or))
            agreed = ~(ones ^ some)
            first = np.zeros(0, np.int64)
            fresh = agreed
            if above is not None:
                first = np.searchsorted(starts, np.r_[above[0], len(self.codes)])
                fresh = agreed & ~np.repeat(above[1], np.diff(first))
            self.levels.append((starts, fresh, ones & fresh, first))
            above = starts, agreed

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i < j) of the codes that share a run and differ in at most ``radius`` bits, in batches."""
        starts = self.levels[0][0]
        ends = np.r_[starts[1:], len(self.codes)]
        run = np.repeat(np.arange(len(starts)), ends - starts)
        asking = np.flatnonzero((ends - starts)[run] > 1) if len(starts) else run
        for at in range(0, len(asking), QUERIES):
            query = asking[at : at + QUERIES]
            node, far = run[query], np.zeros(len(query), np.int64)
            for starts, fresh, pattern, first in self.levels[1:]:
                n = first[node + 1] - first[node]
                child = np.repeat(first[node] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                query, far = np.repeat(query, n), np.repeat(far, n)
                # members before the query asked for this pair themselves
                later = np.r_[starts[1:], len(self.codes)][child] > query + 1
                query, far, child = query[later], far[later], child[later]
                far = far + np.bitwise_count((self.codes[query] ^ pattern[child]) & fresh[child])
                near = far <= radius
                query, far, node = query[near], far[near], child[near]
            later = node > query
            yield query[later], node[later]


def rest_blocks(which: int, radius: int) -> list[tuple[int, int]]:
    """(offset, width) in a code rotated to block ``which`` of the radius + 1 parts of the other bits."""
    lead = blocks(radius)[which][1]
    cuts = [lead + round(i * (BITS - lead) / (radius + 1)) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def equal_in(differ: np.ndarray, block: tuple[int, int]) -> np.ndarray:
    return differ << np.uint64(block[0]) >> np.uint64(BITS - block[1]) == 0


def table_pairs(codes: np.ndarray, which: int, radius: int, sub: int = -1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of distinct codes within ``radius`` that share block ``which`` and no earlier one.

    sub: of a divided block, only pairs that share this part of the other bits too, and no earlier part.
    """
    parts = blocks(radius)
    tree = GrayTree(rotate(codes, parts[which][0]), parts[which][1])
    back = rotate(tree.codes, (BITS - parts[which][0]) % BITS)
    for i, j in tree.pairs(radius):
        differ = back[i] ^ back[j]
        new = np.ones(len(i), bool)
        for part in parts[:which]:
            new &= ~equal_in(differ, part)
        if sub >= 0:
            turned = tree.codes[i] ^ tree.codes[j]
            rest = rest_blocks(which, radius)
            new &= equal_in(turned, rest[sub])
            for part in rest[:sub]:
                new &= ~equal_in(turned, part)
        yield back[i][new], back[j][new]


def bits_of(fp: Column, block: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(F.shiftleft(fp, block[0]), BITS - block[1])


def dealt_to_tables(rows: DataFrame, radius: int, keys: list[str]) -> DataFrame:
    """``rows`` (fp and more) once for each table, with which and sub, partitioned so that what shares a block meets.

    A block that more than CROWD rows share is divided: with the block equal, at most ``radius`` bits differ in the others, so one
    of radius + 1 parts of them is equal too, and its rows are dealt by block and part.
    """
    parts = blocks(radius)
    tables = rows.select("*", F.posexplode(F.array(*[bits_of(F.col("fp"), b) for b in parts])).alias("which", "lead"))
    many = tables.groupBy(*keys, "which", "lead").agg(F.count("*").alias("__n")).where(F.col("__n") > CROWD)
    crowded = materialize(many.select(*keys, "which", "lead", F.lit(True).alias("__crowd")), "crowded-blocks")
    n = n_partitions(rows.sparkSession)
    if not crowded.limit(1).count():
        return tables.repartition(n, *keys, "which", "lead").withColumn("sub", F.lit(-1)).drop("lead")
    turned = F.lit(None)
    for which, (offset, _) in enumerate(parts):
        code = F.col("fp") if offset == 0 else F.shiftleft("fp", offset).bitwiseOR(F.shiftrightunsigned("fp", BITS - offset))
        values = F.array(*[bits_of(code, b) for b in rest_blocks(which, radius)])
        turned = F.when(F.col("which") == which, values).otherwise(turned)
    own = tables.join(crowded, [*keys, "which", "lead"], "left")
    subs = F.when(F.col("__crowd"), F.transform(turned, lambda v, i: F.struct(i.alias("sub"), v.alias("part")))).otherwise(F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("part"))))
    spread = own.withColumn("__s", F.explode(subs)).select(*rows.columns, "which", "lead", F.col("__s.sub").alias("sub"), F.col("__s.part").alias("part"))
    return spread.repartition(n, *keys, "which", "lead", "sub", "part").drop("lead", "part")


def links(classes: DataFrame, radius: int = RADIUS, forest: bool = False) -> DataFrame:
    """Links (u, v, distance) between the distinct fingerprints of ``classes`` (fp).

    forest: per task only as many links (distance null) as connect what all of them connect.
    """
    dealt = dealt_to_tables(classes.select("fp"), radius, [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            fp, which, sub = batch.column("fp").to_numpy().view(np.uint64), batch.column("which").to_numpy(), batch.column("sub").to_numpy()
            for t, d in {*zip(which.tolist(), sub.tolist())}:
                kept.setdefault((t, d), []).append(fp[(which == t) & (sub == d)])
        held: list[tuple[int, int]] = []
        for t, d in sorted(kept):
            for a, b in table_pairs(np.concatenate(kept.pop((t, d))), t, radius, d):
                if forest:
                    held += zip(a.view(np.int64).tolist(), b.view(np.int64).tolist())
                    if len(held) > 4 * QUERIES:
                        held = local_forest(held)
                elif len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.bitwise_count(a ^ b).astype(np.int32))], ["u", "v", "distance"])
        if held := local_forest(held):
            u, v = zip(*held)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.nulls(len(u), pa.int32())], ["u", "v", "distance"])

    return dealt.mapInArrow(run, "u long, v long, distance int")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links lead to, the document's own included."""
    prints = materialize(fingerprints(docs, shingle), "simhash")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = connected_components(links(classes.select("fp"), radius, forest=True))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = placed.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_class, "fp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


# --- near copies: word fingerprints find candidates, a wide shingle fingerprint filters them, exact similarity decides ----

#: Fingerprints of single words that candidates may share; five-word shingles and bits of the sketch that filters.
VIEWS, SKETCH_SHINGLE, SKETCH_WORDS = 16, 5, 8
#: Views that are dealt to tables at once: each class goes three times for each of them, with its sketch, through one shuffle.
VIEWS_AT_ONCE = 4
#: Least similarity (Jaccard of the sets of five-word shingles) of texts to be linked. The sketch's standard error is about 0.04 there,
#: and the bound on differing bits leaves two such errors; what passes is held to the similarity itself.
SIMILARITY = 0.8


def sketch_bits(similarity: float) -> int:
    """Differing bits of the sketch, at most: two sets of one size and Jaccard s have the cosine 2s / (1 + s)."""
    bits = BITS * SKETCH_WORDS
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + 2 * (bits * p * (1 - p)) ** 0.5)


#: What mixed() adds for each of the family.
STARTS = np.array([(0x9E3779B97F4A7C15 * (i + 1)) & (1 << 64) - 1 for i in range(max(VIEWS, SKETCH_WORDS))], np.uint64)


def mixed(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th of a family of 64-bit hashes made from one (splitmix64's finish on a shifted start)."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & (1 << 64) - 1)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def families(hashes: np.ndarray, n: int) -> np.ndarray:
    """mixed() of each of the first n of the family, a row each; all at once and in place, which is a fraction of the time."""
    z = hashes[None, :] + STARTS[:n, None]
    other = z >> np.uint64(30)
    z ^= other
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= np.right_shift(z, np.uint64(27), out=other)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= np.right_shift(z, np.uint64(31), out=other)
    return z


def family_counts(hashes: list[int] | np.ndarray, n: int) -> np.ndarray:
    return bit_sums_of_rows(families(np.asarray(hashes, np.uint64), n))


def hashed(pieces: Iterable[bytes], n: int) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, pieces, repeat(SEED))), ">u8", n).astype(np.uint64)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted; np.unique's table of hashes takes longer than the sort."""
    h = np.sort(hashes)
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """The hashes of all runs of n words with a space between them, as slices of one joined text; there are n words at least."""
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - n + 1]
    return hashed([joined[a:b] for a, b in zip(starts.tolist(), ends[n - 1 :].tolist())], len(starts))


def majority(counts: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * counts > n, axis=1).view(">u8").ravel().astype(np.uint64)


def shingle_set(data: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, sorted; of fewer words, that of all of them."""
    kept: list[bytes] = []
    found: list[np.ndarray] = []
    for words in word_chunks(data or b""):
        words = kept + words
        if len(words) >= SKETCH_SHINGLE:
            found.append(distinct(shingle_hashes(words, SKETCH_SHINGLE)))
            kept = words[1 - SKETCH_SHINGLE :]
        else:
            kept = words
    if not found:
        return hashed([b" ".join(kept)], 1) if kept else np.zeros(0, np.uint64)
    return found[0] if len(found) == 1 else distinct(np.concatenate(found))


def jaccard_of(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def describe(data: bytes | None) -> tuple[bytes, list[int], bytes]:
    """(hash of the lower-cased words, VIEWS fingerprints of words, sketch of the distinct five-word shingles) of a text."""
    whole = xxhash.xxh3_128()
    views = np.zeros((VIEWS, BITS), np.int64)
    n_words = 0
    for words in word_chunks(data or b""):
        if not words:
            continue
        whole.update(b" ".join(words) + b" ")
        views += family_counts(hashed(words, len(words)), VIEWS)
        n_words += len(words)
    shingles = shingle_set(data)
    sketch = family_counts(shingles, SKETCH_WORDS) if len(shingles) else np.zeros((SKETCH_WORDS, BITS), np.int64)
    return whole.digest(), majority(views, n_words).view(np.int64).tolist(), majority(sketch, len(shingles)).tobytes()


def verified_forest(fp: np.ndarray, sketch: np.ndarray, node: np.ndarray, which: int, radius: int, most: int, sub: int = -1) -> list[tuple[int, int]]:
    """Links (node, node) that connect what all links connect: fingerprints within ``radius`` that share block ``which``, sketches within ``most`` bits.

    Pairs that are connected already are not compared, so a crowd of near copies costs about its size.
    """
    order = np.argsort(fp, kind="stable")
    fp, sketch, node = fp[order], sketch[order], node[order]
    starts = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]]) if len(fp) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(fp)]
    parent = np.arange(len(fp))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        return others[np.bitwise_count(sketch[others] ^ sketch[i]).sum(1, dtype=np.int64) <= most]

    links: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            links.append((int(node[i]), int(node[j])))
            parent[max(a, b)] = min(a, b)

    one = np.ones(len(starts), bool)  # whether the members of a fingerprint are connected
    for g in np.flatnonzero(ends - starts > 1):
        rest, pieces = np.arange(starts[g], ends[g]), 0
        while len(rest):
            front, rest, pieces = [rest[0]], rest[1:], pieces + 1
            while front and len(rest):
                i = front.pop()
                found = near(i, rest)
                for j in found:
                    join(int(i), int(j))
                rest = np.setdiff1d(rest, found, assume_unique=True)
                front += found.tolist()
        one[g] = pieces == 1
    place = dict(zip(fp[starts].tolist(), range(len(starts))))
    for a, b in table_pairs(fp[starts], which, radius, sub):
        for u, v in zip(a.tolist(), b.tolist()):
            g, h = place[u], place[v]
            if one[g] and one[h] and find(int(starts[g])) == find(int(starts[h])):
                continue
            right = np.arange(starts[h], ends[h])
            for i in range(starts[g], ends[g]):
                root = find(i)
                for j in near(i, right):
                    if find(int(j)) != root:
                        join(i, int(j))
                        root = find(i)
    return links


def similar_links(rows: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Those of the links ``found`` (u, v: doc_ids) whose texts in ``rows`` (doc_id, text) reach the similarity."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingle_set(texts[i].as_py()).tobytes() for i in range(batch.num_rows)], pa.binary())], ["doc_id", "shingles"])

    linked = found.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    # of repeated doc_ids one row stands for all
    each = materialize(rows.join(linked, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, shingles binary").groupBy("doc_id").agg(F.min("shingles").alias("shingles")), "near-copy-sets")
    full = found.join(each.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a")), "u").join(each.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b")), "v")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [jaccard_of(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= similarity for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("u", "v")], ["u", "v"])

    return full.mapInArrow(check, "u long, v long")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id) of one document of each group of near copies: of texts equal in their lower-cased words, that with the smallest
    id; of linked ones among those, again the smallest. Rows without doc_id are left out."""
    most = sketch_bits(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            keys, views, sketches = zip(*(describe(texts[i].as_py()) for i in range(batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(views, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "key", "views", "sketch"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    first = F.min(F.struct("doc_id", "views", "sketch")).alias("f")
    classes = rows.mapInArrow(run, "doc_id long, key binary, views array<long>, sketch binary").groupBy("key").agg(first).select("f.*")
    classes = materialize(classes, "near-copy-classes")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            node, fp = batch.column("doc_id").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            view, which, sub = (batch.column(c).to_numpy() for c in ("view", "which", "sub"))
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)
            for t in {*zip(view.tolist(), which.tolist(), sub.tolist())}:
                some = (view == t[0]) & (which == t[1]) & (sub == t[2])
                kept.setdefault(t, []).append((fp[some], sketch[some], node[some]))
        held: set[tuple[int, int]] = set()
        for t in sorted(kept):
            columns = [np.concatenate(c) for c in zip(*kept.pop(t))]
            held |= {(min(x), max(x)) for x in verified_forest(*columns, t[1], radius, most, t[2])}
        if held:
            u, v = zip(*held)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    parts = []
    for at in range(0, VIEWS, VIEWS_AT_ONCE):
        some = F.slice(F.transform("views", lambda fp, i: F.struct(i.alias("view"), fp.alias("fp"))), at + 1, VIEWS_AT_ONCE)
        each = classes.select("doc_id", "sketch", F.explode(some).alias("__v")).select("doc_id", "sketch", "__v.view", "__v.fp")
        # written one after the other, so that the shuffle of one is gone before the next
        parts.append(materialize(dealt_to_tables(each, radius, ["view"]).mapInArrow(link, "u long, v long"), "near-copy-links"))
    found = materialize(reduce(DataFrame.unionByName, parts).distinct(), "near-copy-links")
    discard(*parts)
    roots = connected_components(similar_links(rows, found, similarity))
    return classes.select("doc_id").join(roots.select(F.col("node").alias("doc_id")), "doc_id", "left_anti")


def without_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose document stays; rows that share a doc_id are one document, and rows without one all stay."""
    stay = near_copies(docs, similarity)
    return docs.where("doc_id is not null").join(stay, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))
