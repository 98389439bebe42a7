"""Shared pieces of the corpus operators: table access, scratch storage, file access."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialize, scratch_dir

__all__ = ["WORD", "discard", "filesystem", "id_remainder", "materialize", "n_partitions", "scratch_dir", "table"]

#: A word, wherever an operator counts or shingles them: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; works in executors and for any store that Arrow knows."""
    return pafs.FileSystem.from_uri(uri)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus``; the fixed train/held-out split."""
    return F.crc32(doc_id.cast("string")) % modulus
