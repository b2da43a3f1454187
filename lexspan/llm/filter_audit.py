"""Operator 12: filter interaction audit by execution of the trie of filter orders.

The orders of n filters form a trie; two of its nodes that applied the same filters, in whatever order, hold the same
survivors, so there are 2^n states and not n! leaves. The states are visited depth first: each is a persisted DataFrame
made from its parent's by one filter, its counts are taken there, and it is released before its sibling is made, so at
most n + 1 are held at a time. For every edge (state, filter) what the filter removes from the survivors is counted in
the survivors; nothing is inferred from other edges.

Before that, one pass over the texts gives a narrow written table with a flag for each filter; a lost executor's blocks
are made again from it. Copies meet by the SHA-256 digest of their text: the smallest doc_id of each repeated text is
found by pre-aggregation, and only repeated texts are looked up again, by broadcast up to a counted size and else by a
join whose large keys AQE splits.

Null texts count as empty (and are copies of other empty texts). A null lang is the part ''. A null doc_id is never
smaller than another and has no smaller one, so its row does not fail the copy filter. Rows with the same doc_id and text
are ties, none of which is smaller: they stay together. Several labels of one doc_id count as one that says what any of
them says; labels of null ids or null values say nothing. An empty table has no parts and gives an empty result; other
columns are dropped.
"""

from __future__ import annotations

from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, small, spread

FILTERS = "ABCDE"
#: A: fewest words. B: distinct words of 100. C: capitals of 100 code points.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = "[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def flags_of_text(text: Column) -> dict[str, Column]:
    """Whether a text fails the filters that need nothing but the text."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    distinct = F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": F.size(words) < LEAST_WORDS, "B": 100 * distinct < LEAST_DISTINCT * F.size(words), "C": 100 * capitals > MOST_CAPITALS * F.length(text), "D": text.rlike(SYMBOLS)}


def flagged(stage: Stage, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: part, a boolean for each filter that it fails, good, toxic."""
    rows = spread(stage.spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part")))
    rows = stage.put(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(name) for name, c in flags_of_text(F.col("text")).items())))
    first = stage.put(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"))
    rows = rows.join(small(first, 2 * first.count()), "digest", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for name, c in (("good", "quality"), ("toxic", "toxic"))))
    rows = rows.join(said, "doc_id", "left")
    return stage.put(rows.select("part", *FILTERS, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))))


def walk(stage: Stage, rows: DataFrame, filters: str) -> DataFrame:
    """part, state (the filters applied, sorted), survivors, and for each edge from it: filter, removed, good_lost,
    toxic_lost. A row with a null filter holds the survivors alone. Parts without survivors have no row."""
    path, seen, n = f"{stage.root}/edges", set(), F.count_if

    def visit(state: frozenset, survivors: DataFrame) -> None:
        seen.add(state)
        rest = [f for f in filters if f not in state]
        lost = [F.struct(F.lit(f).alias("filter"), *(n(F.col(f) & which).alias(name) for name, which in (("removed", F.lit(True)), ("good_lost", F.col("good")), ("toxic_lost", F.col("toxic"))))) for f in rest]
        alone = F.struct(F.lit(None).cast("string").alias("filter"), *(F.lit(0).cast("long").alias(name) for name in ("removed", "good_lost", "toxic_lost")))
        counted = survivors.groupBy("part").agg(F.count("*").alias("survivors"), F.array(alone, *lost).alias("edge"))
        edges = counted.select("part", F.lit("".join(sorted(state))).alias("state"), "survivors", F.explode("edge").alias("e")).select("part", "state", "survivors", "e.*")
        edges.write.mode("append").parquet(path)  # a few rows for each part
        for f in rest:
            child = state | {f}
            if child not in seen:
                left = survivors.where(~F.col(f))
                # Survivors that are only counted need not be held.
                open_ = any(child | {g} not in seen for g in rest if g != f)
                left = left.persist(StorageLevel.MEMORY_AND_DISK) if open_ else left
                visit(child, left)
                if open_:
                    left.unpersist()

    top = rows.persist(StorageLevel.MEMORY_AND_DISK)
    visit(frozenset(), top)
    top.unpersist()
    return stage.spark.read.schema("part string, state string, survivors long, filter string, removed long, good_lost long, toxic_lost long").parquet(path)


def audit(spark: SparkSession, rows: DataFrame, filters: str = FILTERS, stage: Stage | None = None) -> DataFrame:
    """Every order of the filters (one letter each, a boolean column of rows: does it fail?), part by part and step by
    step. rows: part, the filters' columns, good, toxic (booleans)."""
    stage = stage or Stage(spark, "audit")
    every = walk(stage, rows, filters)
    alone, edges = every.where("filter is null").select("part", "state", "survivors"), every.where("filter is not null").select("part", "state", "filter", "removed", "good_lost", "toxic_lost")
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(filters)))).alias("filter_order")
    steps = alone.where("state = ''").select("part", orders).select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    upto = lambda k: F.array_join(F.array_sort(F.split(F.substring("filter_order", F.lit(1), k), "")), "")
    steps = steps.select("*", F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"), upto(F.col("step") - 1).alias("state"), upto(F.col("step")).alias("after"))
    out = steps.join(edges, ["part", "state", "filter"], "left").join(alone.select("part", F.col("state").alias("after"), F.col("survivors").alias("kept")), ["part", "after"], "left")
    failing = edges.where("state = ''").select("part", "filter", F.col("removed").alias("failing"))
    only = edges.where(F.length("state") == len(filters) - 1).select("part", "filter", F.col("removed").alias("unique_fails"))
    out = out.join(failing, ["part", "filter"], "left").join(only, ["part", "filter"], "left")
    out = out.na.fill(0, ["kept", "removed", "good_lost", "toxic_lost", "failing", "unique_fails"]).withColumn("redundant", F.col("failing") - F.col("removed"))
    out = out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
    return stage.result(out.select("part", "filter_order", "step", *COUNTS))


def audit_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters of this module over documents (doc_id, text, lang) and labels (doc_id, quality, toxic): part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    stage = Stage(spark, "audit")
    return audit(spark, flagged(stage, docs, labels), stage=stage)


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
ORACLE = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len({_WORDS}) < {LEAST_WORDS} THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct({_WORDS})) < {LEAST_DISTINCT} * len({_WORDS}) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '{SYMBOLS}') THEN 8 ELSE 0 END)
    + (CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
  FROM texts t LEFT JOIN said s ON s.doc_id = t.doc_id),
grown AS (
  SELECT '' AS o, 0 AS used, 0 AS step, CAST('' AS VARCHAR) AS letter, 0 AS bit, 0 AS before
  UNION ALL SELECT o || l, used | (1 << k), step + 1, l, 1 << k, used
  FROM grown, (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)) AS f(l, k) WHERE used & (1 << k) = 0),
orders AS (SELECT o FROM grown WHERE step = 5),
steps AS (
  SELECT o AS filter_order, k AS step, 1 << (ascii(o[k]) - 65) AS bit,
    CAST(coalesce(list_sum([1 << (ascii(c) - 65) FOR c IN string_split(o[1:k - 1], '') IF c <> '']), 0) AS INTEGER) AS before
  FROM orders, range(1, 6) AS r(k)),
masks AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, mask),
counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
    sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
    sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted"""
