"""Benchmark decontamination: passages of benchmark items in documents, found by pigeonhole edit matching.

Texts are compared as lower-cased words, punctuation and white space aside; characters of scripts written without spaces are words each. An item of n words may differ from a passage
in k = floor(n * rate) words (changed, missing or added). It is split into k + 1 pieces of words in a row; one of them
must occur unchanged wherever the item does, so one Aho-Corasick pass over a document finds all places to look at.
Each is verified with Myers' bit-parallel distance between the item and the words around the place.

The benchmark is a stated query set: it is taken to the executors in blocks of bounded size, each of which is held
against every document. Documents are never shuffled.

Defined cases: null or empty texts match nothing; short items are searched like all others, which for fewer than five words means exactly;
items that share an item_id or a text are reported each; rows that share a doc_id are searched
each, and reported once per item at the best place; an empty table gives an empty result. Whole texts are searched.
Columns besides doc_id and text, item_id and text are not read.
"""

from __future__ import annotations

import bisect
import itertools
import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .editing import Pattern

RATE = 0.2
#: Least words of an item to be searched for: all that have any.
MIN_WORDS = 1
#: Characters of benchmark text in a block.
BLOCK_CHARS = 8 << 20
BETWEEN = re.compile(r"[\W_]+")
#: Thai, Lao, Burmese, Khmer; kana; Chinese characters.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")


def words_of(text: str) -> list[str]:
    text = BETWEEN.sub(" ", text.lower())
    return (text if text.isascii() else UNSPACED.sub(r" \1 ", text)).split()


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], rate: float, min_words: int):
        self.items: list[tuple[int | None, Pattern, int]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if len(words) < max(1, min_words):
                continue
            i, k = len(self.items), int(len(words) * rate)
            self.items.append((item_id, Pattern(words), k))
            cuts = [j * len(words) // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(f" {' '.join(words[a:b])} ", []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def search(self, text: str) -> Iterator[tuple[int | None, int, int, int]]:
        """(item_id, distance, words of the item, number of words before the passage's end), the best place per item."""
        if self.empty:
            return
        words = words_of(text)
        line = f" {' '.join(words)} "
        starts: list[int] = []
        seen: dict[int, set[int]] = {}
        best: dict[int, tuple[int, int]] = {}
        for end, (length, places) in self.automaton.iter(line):
            if not starts:
                starts = list(itertools.accumulate((len(w) + 1 for w in words), initial=1))
            at = bisect.bisect_left(starts, end - length + 2)
            for i, before in places:
                _, pattern, k = self.items[i]
                first = at - before
                if first in (done := seen.setdefault(i, set())):
                    continue
                done.add(first)
                low = max(0, first - k)
                distance, stop = pattern.best(words[low : first + pattern.n + k])
                if distance <= k and (i not in best or distance < best[i][0]):
                    best[i] = distance, low + stop
        for i, (distance, stop) in best.items():
            yield self.items[i][0], distance, self.items[i][1].n, stop


_built: dict[str, Matcher] = {}


def held_matcher(spark: SparkSession, items: list[tuple[int | None, str]], rate: float, min_words: int) -> Callable[[], Matcher]:
    """The matcher of a block, built once in each worker."""
    block, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def get() -> Matcher:
        if key not in _built:
            _built.clear()
            _built[key] = Matcher(block.value, rate, min_words)
        return _built[key]

    return get


def is_clean(matcher_of: Callable[[], Matcher]):
    def clean(texts: pd.Series) -> pd.Series:
        matcher = matcher_of()
        return pd.Series([not text or next(matcher.search(text), None) is None for text in texts], dtype=bool)

    return F.pandas_udf(clean, "boolean")


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's (item_id, text) in lists of about BLOCK_CHARS characters."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null and text <> ''")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    for i in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == i).collect()]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, distance, item_words, end_word: one row per document and item that it has a passage of."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, item_words int, end_word long"
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    found = []
    for items in item_blocks(benchmark):
        matcher_of = held_matcher(spark, items, rate, min_words)

        def run(batches: Iterator[pa.RecordBatch], matcher_of=matcher_of) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of()
            for batch in batches:
                texts, rows = batch.column("text"), []
                for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    if text := texts[i].as_py():
                        rows += [(doc_id, *m) for m in matcher.search(text)]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "item_id", "distance", "item_words", "end_word"])

        found.append(narrow.mapInArrow(run, schema))
    if not found:
        return spark.createDataFrame([], schema)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.min(F.struct("distance", "end_word", "item_words")).alias("b")
    return every.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.distance", "b.item_words", "b.end_word")


def without_matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no passage of any item, in one pass per block and without a shuffle."""
    for items in item_blocks(benchmark):
        docs = docs.where(is_clean(held_matcher(docs.sparkSession, items, rate, min_words))(F.col("text")))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
