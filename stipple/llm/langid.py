"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams, of every length from 1 to 4 together, that occur in both
(presence, not counts), divided by the geometric mean of how many each has. Nyström landmarks, a bounded number of
training texts, turn it into features: a text's kernel values against the landmarks, times the inverse square
root of the landmarks' own kernel matrix. One-versus-rest ridge regression on them gives a weight per landmark and language.
Presence is held as a vector over hashed n-grams; a batch of texts is scored by matrix products with the landmarks' vectors.

The labelled rows learned from are a bounded sample: about ``per_class`` texts of each language, from rows that
crc32(doc_id as text) mod 3 does not make held-out and that have a language and a letter. A prediction depends on the text only.

Defined cases: a null text or one without a letter is ``und`` with score 0; without training rows everything is ``und``; with one
language, everything else is that one; texts of any length are used whole, in pieces; rows without doc_id are not learned from; an
empty table gives an empty result. Columns besides doc_id, text and lang are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, materialize, table
from .sampling import sample_by_class

#: Training texts of each language, at most (in expectation); landmarks in all, at most.
PER_CLASS, LANDMARKS = 400, 256
FOLDS, HELD_OUT = 3, 1
#: Hashed n-grams, a power of two; n-gram lengths; ridge, relative to the mean eigenvalue.
DIM, ORDERS, RIDGE = 1 << 14, (1, 2, 3, 4), 1e-3
LETTER = re.compile(r"[^\W\d_]")
PIECE, BATCH = 1 << 20, 128


def presence(text: str) -> np.ndarray:
    """Which hashed n-grams of the lower-cased text's UTF-8 bytes occur; white space runs and digits are one symbol each."""
    data = np.frombuffer(re.sub(r"[\W\d_]+", " ", f" {text.lower()} ").encode(), np.uint8)
    out = np.zeros(DIM, bool)
    for at in range(0, len(data), PIECE):
        piece = data[at : at + PIECE + ORDERS[-1] - 1].astype(np.uint32)
        code = np.zeros(len(piece), np.uint32)
        for n in ORDERS:
            if len(piece) < n:
                break
            code = code[: len(piece) - n + 1] * np.uint32(257) + piece[n - 1 :] + np.uint32(1)
            # the multiplication spreads the sums over the high bits
            out[(code * np.uint32(2654435769)) >> np.uint32(32 - 14)] = True
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and LETTER.search(text) is not None


def packed_sample(docs: DataFrame, per_class: int) -> pd.DataFrame:
    """lang and packed presence of the sampled training texts."""
    doc_id = F.col("doc_id")
    rows = docs.select(doc_id.cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where(doc_id.isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder(doc_id, FOLDS) != HELD_OUT))
    drawn, _ = sample_by_class(rows, "lang", per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(d, lang, np.packbits(presence(t)).tobytes()) for d, lang, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))) if has_letter(t)]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*kept)], ["doc_id", "lang", "bits"])

    found = materialize(drawn.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, bits binary"), "lang-sample")
    return found.toPandas().sort_values(["doc_id", "lang", "bits"], ignore_index=True)


class Classifier:
    """Landmark vectors and, per language, their weights."""

    def __init__(self, sample: pd.DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(sample["lang"].unique())
        x = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for b in sample["bits"]]).astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        each = max(1, landmarks // len(self.langs))
        rng = np.random.default_rng(3)
        at = np.concatenate([rng.permutation(np.flatnonzero(sample["lang"] == lang))[:each] for lang in self.langs])
        self.landmarks = np.unique(x[at], axis=0)
        value, vector = np.linalg.eigh((self.landmarks @ self.landmarks.T).astype(float))
        good = value > 1e-6 * value.max()
        self.root = vector[:, good] / np.sqrt(value[good])
        z = np.column_stack([(x @ self.landmarks.T).astype(float) @ self.root, np.ones(len(x))])
        y = np.where(sample["lang"].to_numpy()[:, None] == np.array(self.langs)[None], 1.0, -1.0)
        # languages count alike, whatever their number of texts
        weight = 1 / sample["lang"].map(sample["lang"].value_counts()).to_numpy(float)
        weight *= len(weight) / weight.sum()
        gram = z.T @ (z * weight[:, None])
        hold = ridge * np.trace(gram) / len(gram) * np.eye(len(gram))
        hold[-1, -1] = 0
        beta = np.linalg.solve(gram + hold, z.T @ (y * weight[:, None]))
        self.weights = (self.root @ beta[:-1]).astype(np.float32)
        self.constant = beta[-1].astype(np.float32)

    def scores(self, bits: np.ndarray) -> np.ndarray:
        """Rows of presence to rows of one value per language."""
        kernel = (bits @ self.landmarks.T) / np.sqrt(np.maximum(bits.sum(1, keepdims=True), 1))
        return kernel @ self.weights + self.constant

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, shares = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if has_letter(t)]
        for at in range(0, len(some), BATCH):
            own = some[at : at + BATCH]
            value = self.scores(np.stack([presence(texts[i]) for i in own]).astype(np.float32))
            odds = np.exp(4 * (value - value.max(1, keepdims=True)))
            odds /= odds.sum(1, keepdims=True)
            for i, k, s in zip(own, odds.argmax(1), odds.max(1)):
                names[i], shares[i] = self.langs[k], float(s)
        return names, shares


def identify(docs: DataFrame, per_class: int = PER_CLASS, landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    sample = packed_sample(docs, per_class)
    model = Classifier(sample, landmarks) if len(sample) else None
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column("text"), batch.num_rows
            names, shares = [], []
            for at in range(0, n, BATCH):
                own = texts[at : at + BATCH].to_pylist()
                a, b = shipped.value.predict(own) if shipped.value else (["und"] * len(own), [0.0] * len(own))
                names += a
                shares += b
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
