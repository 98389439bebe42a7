"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, langid, lines, mixing, neighbours, simhash, tokens, toxicity, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.query,
    "op2_token_records": tokens.query,
    "op3_mixing": mixing.query,
    "op4_nearest": neighbours.query,
    "op5_url_filter": urls.query,
    "op6_language_id": langid.query,
    "op7_toxicity": toxicity.query,
    "op8_warc": warc.query,
    "op9_simhash": simhash.query,
    "op10_line_dedup": lines.query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": mixing.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
}
