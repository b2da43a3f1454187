"""Registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import check_queries, rule_queries, text_queries, tree_queries, vector_queries

QUERIES: dict = {**text_queries.QUERIES, **tree_queries.QUERIES, **vector_queries.QUERIES, **check_queries.QUERIES, **rule_queries.QUERIES}
ORACLES: dict[str, str] = {**text_queries.ORACLES, **tree_queries.ORACLES, **vector_queries.ORACLES, **check_queries.ORACLES, **rule_queries.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to tokens, periods and context windows with digests."""
    return text_queries.ctx_window_digests(spark, sf_dir)
