"""Evaluation of predictions against a hand-made reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut


def reference_violations(gold: DataFrame) -> DataFrame:
    """gold: case_id, text, target, start_pos, end_pos. (case_id, start_pos, check): literal slices, order, repeats."""
    order = Window.partitionBy("case_id").orderBy("start_pos", "end_pos")
    rows = gold.withColumn("before", F.lag("end_pos").over(order))
    checks = {"literal": cut(F.col("text"), F.col("start_pos"), F.col("end_pos")) != F.col("target"), "overlap": F.col("before") > F.col("start_pos")}
    found = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in checks.items())), lambda x: x.isNotNull())
    return rows.select("case_id", "start_pos", F.explode(found).alias("check"))


def compared(gold: DataFrame, predicted: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Gold rows with the prediction at the same place; a missing prediction is a miss."""
    p = predicted.select(*keys, *(F.col(f).alias(f"predicted_{f}") for f in fields))
    rows = gold.join(p, keys, "left")
    return rows.select(*keys, *fields, *(F.col(f"predicted_{f}") for f in fields), *(F.col(f).eqNullSafe(F.col(f"predicted_{f}")).alias(f"{f}_hit") for f in fields))


def summary(rows: DataFrame, fields: list[str]) -> DataFrame:
    hits = [x for f in fields for x in (F.count_if(F.col(f"{f}_hit")).alias(f"{f}_hits"), F.round(F.avg(F.col(f"{f}_hit").cast("double")), 6).alias(f"{f}_rate"))]
    return rows.agg(F.count("*").alias("targets"), *hits)


def as_markdown(rows: DataFrame) -> DataFrame:
    """Lines of a table; bars and line ends inside cells are escaped."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("—")), r"\|", r"\\|"), r"\r?\n", " ")
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in rows.columns)), F.lit(" |")).alias("line"))
