"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drawn_by_hash(share: Column | float, *keys: str | Column) -> Column:
    """Whether a row is among a share of all, by the 64-bit hash of its keys; shares may be as small as 2^-63."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    # the hash without its sign bit, as a double in [0, 1)
    return F.shiftrightunsigned(F.xxhash64(*keys), 1).cast("double") / F.lit(2.0**63) < share


def sample_by_class(rows: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each class, drawn by the hash of doc_id, and the share drawn of each class.

    Classes that have no more rows than that are taken whole.
    """
    share = {r[label]: min(1.0, per_class / r["count"]) for r in rows.groupBy(label).count().collect()}
    if not share:
        return rows.limit(0), {}
    small = rows.sparkSession.createDataFrame([(k, float(s)) for k, s in sorted(share.items())], rows.select(F.col(label).alias("__label"), F.lit(0.0).alias("__share")).schema)
    picked = rows.join(F.broadcast(small), F.col(label) == F.col("__label"))
    return picked.where(drawn_by_hash(F.col("__share"), "doc_id") | (F.col("__share") >= 1)).drop("__label", "__share"), share
