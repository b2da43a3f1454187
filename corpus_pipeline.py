"""The corpus pipeline: language ID, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of `documents`. `run` applies them in order, each result written as Parquet to the shared folder and read again.

In every stage an empty table gives an empty one, other columns are dropped, and nulls in lang, source and n_chars stay as
they are. Null and empty texts have no language, so the first stage drops them; in a later stage they stay and are packed
as empty. Rows without a doc_id cannot be named by a decision: near-duplicates and repeated passages leave them as they
are, leaks too, and packing packs them. Repeated rows are one row after the second stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import decontaminate, langid, near_dedup, packing, passages
from lexspan.llm.common import Stage, small, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language covers less of it is rejected, as is one without a letter.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in one learned language, and name it."""
    found = langid.identify(spark, docs.select(*COLUMNS), carry=("text", "source", "n_chars"))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, the one with the smallest id; of rows with that id the one with the least text
    hash, and of equal texts the least of the other columns."""
    stage = Stage(spark, "pipeline-near")
    found = near_dedup.near_duplicates(spark, docs)
    gone = stage.put(found.where("not kept and doc_id is not null").select("doc_id", "text_key").distinct())
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key"))
    kept = rows.join(small(gone, gone.count()), ["doc_id", "text_key"], "left_anti")
    repeated = stage.put(found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("text_key").alias("text_key")).where("n > 1").select("doc_id", "text_key"))
    n = repeated.count()
    if not n:
        return kept.select(*COLUMNS)
    one = kept.join(small(repeated, n), ["doc_id", "text_key"], "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return kept.join(small(repeated.select("doc_id"), n), "doc_id", "left_anti").select(*COLUMNS).unionByName(one)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out every repeated passage but its first occurrence; texts left blank go."""
    stage = Stage(spark, "pipeline-passages")
    found = passages.repeated_passages(spark, docs)
    places = stage.put(found.where("not kept and doc_id is not null").groupBy("doc_id", "start", "length").agg(F.lit(False).alias("kept")))
    n = places.select("doc_id").distinct().count()
    left = passages.without_passages(docs.select(*COLUMNS), places, rows=n)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    stage = Stage(spark, "pipeline-leaks")
    found = decontaminate.leaks(spark, docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    gone = stage.put(found.select("doc_id").where("doc_id is not null").distinct())
    return docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packed),
]

#: Language ID and packing cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stage = table(spark, sf_dir, "documents", *COLUMNS), Stage(spark, "pipeline")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage.put(docs)
    return docs
