"""Toxicity by class-conditional Kneser-Ney models of word pairs.

Two interpolated Kneser-Ney models, of toxic and of ordinary documents, give a word its probability after the word before:
the pair's discounted count in the class, then the class's continuation counts (different words that it follows), then
the continuation counts of both classes together, then a uniform share. Discounts come from the counts of counts, and each
level hands on exactly what it discounted. Rare expressions are smoothed by the shared counts alone: a word that follows fewer than
``MIN_LEFT`` different words in both classes, and a pair in fewer than ``MIN_DOCS`` documents of both, has no count of its
own in either class. Pairs count once per document, and of near copies (two least hashes of five-word shingles equal, in one of
three drawings) one document counts, so a passage that is often copied proves no more than one.

A toxic text is mostly ordinary language with some toxic expressions, so its word is taken to come from the toxic model with
the probability ``MIX`` and else from the ordinary one. A text's evidence is the difference of the two log-likelihoods per word, and a
logistic curve over it gives the score. The curve is fitted on at most about ``PER_CLASS`` documents of each label, drawn from the share
``CURVE_SHARE`` of the documents that the counts leave out. The counts come from all other labelled documents that are not
held out. Models of up to ``SHIPPED`` entries go to every worker; larger ones stay in the shared folder, sorted by key, and a worker
reads them through for each ``GROUP_WORDS`` words of its documents and keeps the entries of those words. No document is shuffled.

Defined cases: a null or empty text, or one without letters, gets the curve's value for no evidence; texts of any length are read whole;
texts of equal evidence get equal scores; without labels of both kinds every score is the share of label 1 (0 without labels); several labels of one doc_id count each;
documents that share a doc_id with a label all carry it; repeated rows are scored alike and count once; rows without doc_id are
scored but not learned from; an empty table gives an empty result. Columns besides doc_id and text, doc_id and toxic are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, filesystem, id_remainder, materialize, n_partitions, table
from .sampling import drawn_by_hash, sample_by_class
from .simhash import mixed

#: Documents of each label that fit the curve, at most (in expectation), and the share of documents that is kept for it.
PER_CLASS, CURVE_SHARE = 4_000, 0.2
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Share of a toxic text that its toxic expressions make up; least continuations of a word and documents of a pair.
MIX, MIN_LEFT, MIN_DOCS = 0.005, 3, 5
#: Entries of a model that go to every worker (40 bytes each); words scored per reading of a larger one; ids that a join ships to every executor.
SHIPPED, GROUP_WORDS, SHIPPED_IDS = 1 << 16, 1 << 20, 1 << 20
LETTERS = re.compile(r"[^\W\d_]+")
SHINGLE, DRAWINGS = 5, 3
#: Pairs counted in a task before the counts go on; words whose hashes a worker keeps; words scored at once.
FLUSH_PAIRS, CACHE_WORDS, CHUNK_WORDS = 2_000_000, 100_000, 200_000
START = np.uint64(0)


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def hashes_of(text: str | None) -> np.ndarray:
    return np.array([_hashes[w] for w in words_of(text)], np.uint64)


def pair_key(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(left, 1) * np.uint64(3) + word, 2)


def families(h: np.ndarray) -> list[int]:
    """A number per drawing that near copies share: both least hashes of the five-word shingles, of two hash functions."""
    if len(h) < SHINGLE:
        s = np.array([len(h) + 1, *h], np.uint64)
        s = np.array([np.bitwise_xor.reduce(mixed(s, 9) + np.arange(len(s), dtype=np.uint64))])
    else:
        s = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for i in range(SHINGLE):
            s = s * np.uint64(0x100000001B3) + h[i : i + len(s)]
    least = np.array([mixed(s, i).min() for i in range(2 * DRAWINGS)])
    return (least[::2] ^ mixed(least[1::2], 3)).view(np.int64).tolist()


def one_of_each_family(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, label and families) without the documents that share a family of their label with a smaller id."""
    for i in range(DRAWINGS):
        columns = [c for c in rows.columns if c not in ("label", f"f{i}")]
        rows = rows.groupBy("label", f"f{i}").agg(F.min(F.struct(*columns)).alias("r")).select("label", "r.*")
    return rows


def pair_counts(texts: DataFrame) -> DataFrame:
    """(v, w, n0, n1) of ``texts`` (label, text): documents of each label that hold the pair. Summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one piece of memory for all pairs held: many small arrays stay with the worker when they are freed
        held, toxic = np.empty((2, FLUSH_PAIRS), np.uint64), np.empty(FLUSH_PAIRS, bool)
        size = 0

        def flush() -> pa.RecordBatch:
            order = np.lexsort((held[1, :size], held[0, :size]))
            v, w = held[0, order], held[1, order]
            first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
            n1 = np.add.reduceat(toxic[order], first, dtype=np.int64)
            n = np.diff(np.r_[first, len(v)])
            return pa.RecordBatch.from_arrays([pa.array(v[first].view(np.int64)), pa.array(w[first].view(np.int64)), pa.array(n - n1), pa.array(n1)], ["v", "w", "n0", "n1"])

        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                h = hashes_of(text)
                if not len(h):
                    continue
                left = np.r_[START, h[:-1]]
                _, at = np.unique(pair_key(left, h), return_index=True)
                for some in np.array_split(at, len(at) // FLUSH_PAIRS + 1):
                    if size + len(some) > FLUSH_PAIRS:
                        yield flush()
                        size = 0
                    here = slice(size, size + len(some))
                    held[0, here], held[1, here], toxic[here] = left[some], h[some], bool(label)
                    size += len(some)
        if size:
            yield flush()

    raw = texts.select("label", "text").mapInArrow(run, "v long, w long, n0 long, n1 long")
    return raw.groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def discount(ones: int | None, twos: int | None) -> float:
    """The share of a count that is handed on, from how many counts are one and two."""
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def ones_and_twos(*names: str) -> list[Column]:
    return [F.sum((F.col(n) == k).cast("int")).alias(f"{n}_{k}") for n in names for k in (1, 2)]


def entries(pairs: DataFrame) -> tuple[DataFrame, float]:
    """The model of ``pairs`` (v, w, n0, n1) as (key, a0, a1, l0, l1), and the ratio of a word that has no entry.

    A word's entry has its probability by continuations in each class (a) and what the class hands on after it (l); a pair's has the
    pair's own discounted share after its first word (a).
    """
    by_word = materialize(
        pairs.groupBy("w").agg(*[F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"c{c}") for c in (0, 1)], F.count("*").alias("left"), F.max(F.greatest("n0", "n1")).alias("most")), "toxic-words"
    )
    kept_words = F.greatest("c0", "c1") >= MIN_LEFT
    t = by_word.agg(*[F.sum(c).alias(c) for c in ("c0", "c1", "left")], F.count("*").alias("words"), *ones_and_twos("c0", "c1", "left")).first()
    d = {c: discount(t[f"{c}_1"], t[f"{c}_2"]) for c in ("c0", "c1", "left")}
    own = lambda c: F.when(kept_words, F.greatest(F.col(c) - d[c], F.lit(0.0)) / t[c]).otherwise(0.0)
    handed = by_word.agg(*[(1 - F.sum(own(c))).alias(c) for c in ("c0", "c1")]).first()
    shared = (F.col("left") - d["left"]) / t["left"] + d["left"] * t["words"] / t["left"] / (t["words"] + 1)
    words = by_word.where(kept_words | (F.col("most") >= MIN_DOCS)).select("w", *[(own(f"c{c}") + handed[f"c{c}"] * shared).alias(f"a{c}") for c in (0, 1)])
    two = pairs.agg(*ones_and_twos("n0", "n1")).first()
    e = [discount(two[f"n{c}_1"], two[f"n{c}_2"]) for c in (0, 1)]
    less = lambda c: F.greatest(F.col(f"n{c}") - e[c], F.lit(0.0))
    kept_pairs = F.greatest("n0", "n1") >= MIN_DOCS
    after = pairs.groupBy("v").agg(
        *[F.sum(f"n{c}").alias(f"t{c}") for c in (0, 1)], *[F.sum(F.when(kept_pairs, less(c)).otherwise(0.0)).alias(f"m{c}") for c in (0, 1)], F.max(kept_pairs).alias("any")
    ).where("any")
    after = materialize(after.select("v", *[F.greatest(F.col(f"t{c}"), F.lit(1)).alias(f"t{c}") for c in (0, 1)], *[(1 - F.col(f"m{c}") / F.greatest(F.col(f"t{c}"), F.lit(1))).alias(f"l{c}") for c in (0, 1)]), "toxic-left")
    # a word's entry and what comes after it are one row
    both = words.join(after.drop("t0", "t1"), words.w == after.v, "full").select(F.coalesce("w", "v").alias("w"), "a0", "a1", "l0", "l1")
    key = F.pandas_udf(lambda v, w: _as_long(v, w), "long")
    top = pairs.where(kept_pairs).join(after.select("v", "t0", "t1"), "v").select(key("v", "w").alias("key"), *[(less(c) / F.col(f"t{c}")).alias(f"a{c}") for c in (0, 1)], F.lit(None).cast("double").alias("l0"), F.lit(None).cast("double").alias("l1"))
    ratio = handed["c1"] / handed["c0"]
    model = materialize(both.withColumnRenamed("w", "key").unionByName(top), "toxic-entries")
    ordered = materialize(model.repartitionByRange(n_partitions(pairs.sparkSession), "key").sortWithinPartitions("key"), "toxic-model")
    discard(by_word, after, model)
    return ordered, ratio


def _as_long(v, w):
    return pd.Series(pair_key(v.to_numpy().view(np.uint64), w.to_numpy().view(np.uint64)).view(np.int64))


class Model:
    """Entries sorted by key, or those of them that some documents need."""

    def __init__(self, key: np.ndarray, values: np.ndarray, unseen: float):
        order = np.argsort(key)
        self.key, self.values, self.unseen = key[order], values[order], unseen

    def find(self, key: np.ndarray) -> np.ndarray:
        """Rows (a0, a1, l0, l1) of the entries, nan where there is none."""
        out = np.full((len(key), 4), np.nan)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[at] == key
            out[hit] = self.values[at[hit]]
        return out

    def ratios(self, left: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Toxic over ordinary probability of each word after the one before."""
        here, before, pair = self.find(word), self.find(left), self.find(pair_key(left, word))
        q0, q1 = np.where(np.isnan(here[:, 0]), 1.0, here[:, 0]), np.where(np.isnan(here[:, 1]), self.unseen, here[:, 1])
        l0, l1 = (np.where(np.isnan(x), 1.0, x) for x in (before[:, 2], before[:, 3]))
        return (np.nan_to_num(pair[:, 1]) + l1 * q1) / (np.nan_to_num(pair[:, 0]) + l0 * q0)

    def evidence(self, hashed: list[np.ndarray]) -> np.ndarray:
        """The difference of log-likelihoods per word of each text, given as hashes of its words."""
        out, at = np.zeros(len(hashed)), 0
        while at < len(hashed):
            end, size = at, 0
            while end < len(hashed) and (end == at or size + len(hashed[end]) <= CHUNK_WORDS):
                size += len(hashed[end])
                end += 1
            if size:
                word = np.concatenate(hashed[at:end])
                n = np.array([len(x) for x in hashed[at:end]])
                starts = np.cumsum(n) - n
                left = np.r_[START, word[:-1]]
                left[starts[n > 0]] = START
                sums = np.add.reduceat(np.log1p(MIX * (self.ratios(left, word) - 1)), starts[n > 0])
                out[at:end][n > 0] = sums / n[n > 0]
            at = end
        return out


def columns_of(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in ("a0", "a1", "l0", "l1")]).astype(float)
    return batch.column("key").to_numpy().view(np.uint64), values


def entries_for(hashed: list[np.ndarray], files: list[str], unseen: float) -> Model:
    """The entries that the texts need, of a model in Parquet files that are sorted by key; a batch of rows at a time is held besides."""
    word = np.concatenate([np.zeros(0, np.uint64), *hashed])
    left = np.concatenate([np.zeros(0, np.uint64), *(np.r_[START, h[:-1]] for h in hashed if len(h))])
    need = np.unique(np.concatenate([word, pair_key(left, word), [START]]).view(np.int64))
    del word, left
    keys, values = [np.zeros(0, np.uint64)], [np.zeros((0, 4))]
    for file in files:
        fs, path = filesystem(file)
        with fs.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["key", "a0", "a1", "l0", "l1"]):
                key = batch.column("key").to_numpy()
                if not len(key):
                    continue
                some = need[np.searchsorted(need, key[0]) : np.searchsorted(need, key[-1], "right")]
                if len(some):
                    at = np.searchsorted(key, some)
                    k, v = columns_of(batch.take(pa.array(at[key[at] == some])))
                    keys.append(k)
                    values.append(v)
    return Model(np.concatenate(keys), np.concatenate(values), unseen)


def with_evidence(docs: DataFrame, name: str, model: DataFrame, unseen: float, shipped: int = SHIPPED) -> DataFrame:
    """``docs`` (with a column text) and their evidence."""
    spark = docs.sparkSession
    if model.count() <= shipped:
        sent = spark.sparkContext.broadcast(Model(*columns_of(model.toArrow()), unseen))

        def run(texts):
            return pd.Series(sent.value.evidence([hashes_of(t) for t in texts]))

        return docs.withColumn(name, F.pandas_udf(run, "double")(F.col("text")))
    files = sorted(model.inputFiles())

    def run_grouped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held: list[np.ndarray] = []
        size = 0
        for texts in batches:
            for t in texts:
                held.append(hashes_of(t))
                size += len(held[-1])
                if size >= GROUP_WORDS:
                    yield pd.Series(entries_for(held, files, unseen).evidence(held))
                    held, size = [], 0
        if held:
            yield pd.Series(entries_for(held, files, unseen).evidence(held))

    return docs.withColumn(name, F.pandas_udf(run_grouped, "double")(F.col("text")))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Slope (0 or more) and constant of a weighted logistic curve, by Newton steps."""
    scale = np.sqrt((weight * x**2).sum() / weight.sum()) or 1.0
    z, beta, hold = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2), np.array([ridge, 1e-6])
    loss = lambda b: (weight * (np.logaddexp(0, z @ b) - y * (z @ b))).sum() + (hold * b**2).sum() / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-(z @ beta)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + np.diag(hold), z.T @ (weight * (y - p)) - hold * beta)
        while loss(beta + step) > loss(beta) + 1e-12 and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    if beta[0] < 0:
        p = (weight * y).sum() / weight.sum()
        return 0.0, float(np.log(max(p, 1e-9) / max(1 - p, 1e-9)))
    return float(beta[0] / scale), float(beta[1])


def joined(rows: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """``rows`` joined with ``ids`` (materialized), which are shipped where they are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= SHIPPED_IDS else ids, on, how)


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label, text, families and whether the curve may use it, of the labelled documents to learn from."""
    doc_id = F.col("doc_id")
    own = lambda df: df.where(doc_id.isNotNull() & (id_remainder(doc_id, FOLDS) != HELD_OUT))
    known = own(labels.where("toxic in (0, 1)").select(doc_id.cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))).distinct()
    texts = own(docs.select(doc_id.cast("long").alias("doc_id"), "text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(families(hashes_of(t)) for t in batch.column("text").to_pylist()))) or [()] * DRAWINGS
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f, pa.int64()) for f in found)], [*batch.schema.names, *(f"f{i}" for i in range(DRAWINGS))])

    rows = joined(texts, materialize(known, "toxic-labels"), ["doc_id"], "inner").select("doc_id", "text", "label", drawn_by_hash(CURVE_SHARE, F.lit("curve"), "doc_id").alias("curve"))
    return materialize(rows.mapInArrow(describe, "doc_id long, text string, label int, curve boolean, " + ", ".join(f"f{i} long" for i in range(DRAWINGS))), "toxic-train")


def learned(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, shipped: int = SHIPPED) -> tuple[DataFrame | None, float, float, float]:
    """Entries, ratio of unseen words, and slope and constant of the curve; without both labels, no entries and the share of label 1."""
    rows = training(docs, labels)
    kinds = [r[0] for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        discard(rows)
        return None, 1.0, 0.0, float(next(iter(kinds), 0))
    count_rows = rows.where("not curve")
    kept = materialize(one_of_each_family(count_rows.drop("text", "curve")).select("doc_id", "label"), "toxic-kept")
    pairs = materialize(pair_counts(joined(count_rows, kept, ["doc_id", "label"], "left_semi")), "toxic-pairs")
    model, unseen = entries(pairs)
    discard(pairs, kept)
    drawn, share = sample_by_class(rows.where("curve").select("doc_id", "label").distinct(), "label", per_class)
    if len(share) < 2:  # too few rows for a curve
        discard(rows)
        return model, unseen, 1000.0, -3.0
    sample = rows.where("curve").select("doc_id", "label", "text").join(F.broadcast(drawn), ["doc_id", "label"], "left_semi")
    seen = with_evidence(sample, "x", model, unseen, shipped).select("doc_id", "label", "x").toPandas().sort_values(["doc_id", "label", "x"], ignore_index=True)
    discard(rows)
    weight = seen["label"].map({k: 1 / s for k, s in share.items()}).to_numpy(float)
    slope, constant = fit_curve(seen["x"].to_numpy(float), seen["label"].to_numpy(float), weight * len(weight) / weight.sum())
    return model, unseen, slope, constant


def with_score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, name: str = "score", shipped: int = SHIPPED) -> DataFrame:
    """``docs`` with a column of scores."""
    model, unseen, slope, constant = learned(docs, labels, per_class, shipped)
    if model is None:
        return docs.withColumn(name, F.lit(constant))
    x = F.col(name)
    return with_evidence(docs, name, model, unseen, shipped).withColumn(name, 1 / (1 + F.exp(-(x * slope + constant))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
