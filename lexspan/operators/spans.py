"""Preparation: an original text, its work copy, and the map between the two.

Tables: `prepared` (doc_id, original, work, lengths, digests, versions, normalized), `span map` (doc_id, ord, kind and
both spans), `changes` (one row for each converted line end). Nothing is shuffled but the rows of a map, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut, sha256

CRLF = "\r\n"
COPY, CHANGE = "copy", "technical_change"
POLICY = "crlf_to_lf"


def prepare(docs: DataFrame, normalize_crlf: bool = True) -> DataFrame:
    """docs: doc_id, original. The work copy's version rises by the policy alone, even if nothing changes."""
    work = F.replace("original", F.lit(CRLF), F.lit("\n")) if normalize_crlf else F.col("original")
    rows = docs.where("original is not null").select("doc_id", "original", work.alias("work"))
    return rows.select(
        "doc_id", "original", "work", F.length("original").alias("original_length"), F.length("work").alias("work_length"),
        sha256(F.col("original")).alias("original_sha256"), sha256(F.col("work")).alias("work_sha256"),
        F.lit(1).alias("original_version"), F.lit(1 + int(normalize_crlf)).alias("work_version"), F.lit(normalize_crlf).alias("normalized"),
    )


def _parts(prepared: DataFrame) -> DataFrame:
    """Texts between converted line ends: doc_id, k, part, offset of the part in the work text."""
    split = F.when(F.col("normalized"), F.split("original", CRLF, -1)).otherwise(F.array("original"))
    rows = prepared.select("doc_id", F.posexplode(split).alias("k", "part"))
    before = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)))


def span_map(prepared: DataFrame) -> DataFrame:
    """Ordered pieces that cover both texts without gaps; none is empty."""
    parts = _parts(prepared)
    copies = parts.where(F.length("part") > 0).select("doc_id", (2 * F.col("k") + 1).alias("place"), F.lit(COPY).alias("kind"), (F.col("before") + F.col("k")).alias("work_start"), (F.col("before") + F.col("k") + F.length("part")).alias("work_end"), (F.col("before") + 2 * F.col("k")).alias("original_start"), (F.col("before") + 2 * F.col("k") + F.length("part")).alias("original_end"))
    ends = parts.where("k > 0").select("doc_id", (2 * F.col("k")).alias("place"), F.lit(CHANGE).alias("kind"), (F.col("before") + F.col("k") - 1).alias("work_start"), (F.col("before") + F.col("k")).alias("work_end"), (F.col("before") + 2 * F.col("k") - 2).alias("original_start"), (F.col("before") + 2 * F.col("k")).alias("original_end"))
    order = Window.partitionBy("doc_id").orderBy("place")
    return copies.unionByName(ends).select("doc_id", (F.row_number().over(order) - 1).alias("ord"), "kind", *(F.col(c).cast("long").alias(c) for c in ("work_start", "work_end", "original_start", "original_end")))


def changes(prepared: DataFrame) -> DataFrame:
    """One row for each converted line end; ids count from 1."""
    ends = _parts(prepared).where("k > 0")
    return ends.select(F.concat(F.col("doc_id").cast("string"), F.lit(":change:"), F.col("k").cast("string")).alias("change_id"), "doc_id", F.lit(POLICY).alias("operation"), (F.col("before") + F.col("k") - 1).cast("long").alias("work_start"), (F.col("before") + 2 * F.col("k") - 2).cast("long").alias("original_start"), F.lit(2).alias("removed"), F.lit(1).alias("put"))


def line_ends(original: Column) -> Column:
    """Places of converted line ends in the work text, in order."""
    sizes = F.transform(F.split(original, CRLF, -1), lambda p: F.length(p))
    steps = F.aggregate(F.slice(sizes, 1, F.size(sizes) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, n: F.struct((acc["at"] + n + 1).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out")))
    return steps["out"]


def to_original(place: Column, ends: Column) -> Column:
    """The original place of a work place: one more for each converted line end before it."""
    return place + F.size(F.filter(ends, lambda x: x < place))


def map_intervals(prepared: DataFrame, intervals: DataFrame) -> DataFrame:
    """intervals: doc_id, work_start, work_end. Both ends map by the same closed form, so no range join is needed; a
    converted line end that is touched contributes its whole original span."""
    ends = prepared.select("doc_id", F.when(F.col("normalized"), line_ends(F.col("original"))).otherwise(F.array().cast("array<int>")).alias("ends"))
    rows = intervals.join(ends, "doc_id")
    return rows.select("doc_id", "work_start", "work_end", to_original(F.col("work_start"), F.col("ends")).alias("original_start"), to_original(F.col("work_end"), F.col("ends")).alias("original_end"))


def original_places(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """places: doc_id, any other columns, place (in the work text), is_end. places with `original`, through any map of
    pieces: inside a copy the offset is kept; a change that is touched counts whole, so a start in it goes to its first
    and an end to its last original place. The piece of a place is the last one that begins before it, carried along in
    one ordered pass by document: no range join, and a document with many pieces and places is not their product."""
    held = F.struct("kind", "work_start", "work_end", "original_start", "original_end")
    rest = [c for c in places.columns if c != "doc_id"]
    asked = places.withColumn("_at", F.col("place") - F.col("is_end").cast("int")).withColumn("_order", F.lit(1))
    marks = pieces.select("doc_id", F.col("work_start").alias("_at"), F.lit(0).alias("_order"), held.alias("_piece"))
    order = Window.partitionBy("doc_id").orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marks.unionByName(asked, allowMissingColumns=True).withColumn("_piece", F.last("_piece", ignorenulls=True).over(order)).where("_order = 1")
    p, into = F.col("_piece"), F.col("place") - F.col("_piece.work_start")
    change = F.when(F.col("is_end") | (into > 0), p["original_end"]).otherwise(p["original_start"])
    mapped = F.when(p.isNull(), F.col("place")).when(p["kind"] == COPY, p["original_start"] + into).otherwise(change)
    return rows.select("doc_id", *rest, mapped.cast("long").alias("original"))


def original_spans(pieces: DataFrame, spans_: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """spans_ with the original coordinates of the spans that `pairs` names (name: its columns of start and end), as
    <name>_start and <name>_end. Rows are told apart by all their columns; an empty span stays empty."""
    key = F.struct(*(c for c in spans_.columns if c != "doc_id"))
    ends = [F.struct(F.lit(f"{name}_{side}").alias("what"), F.col(b if side == "end" else a).cast("long").alias("place"), (F.lit(side == "end") & (F.col(b) > F.col(a))).alias("is_end")) for name, (a, b) in pairs.items() for side in ("start", "end")]
    places = spans_.select("doc_id", key.alias("key"), F.explode(F.array(*ends)).alias("e")).select("doc_id", "key", "e.*")
    found = original_places(pieces, places).groupBy("doc_id", "key").agg(*(F.max(F.when(F.col("what") == f"{name}_{side}", F.col("original"))).alias(f"{name}_{side}") for name in pairs for side in ("start", "end")))
    return found.select("doc_id", "key.*", *(f"{name}_{side}" for name in pairs for side in ("start", "end")))


def violations(prepared: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, check) for each check that fails; a valid preparation has none."""
    digests = prepared.where((sha256(F.col("original")) != F.col("original_sha256")) | (sha256(F.col("work")) != F.col("work_sha256"))).select("doc_id", F.lit("digest").alias("check"))
    lengths = prepared.where((F.length("original") != F.col("original_length")) | (F.length("work") != F.col("work_length"))).select("doc_id", F.lit("length").alias("check"))
    versions = prepared.where(F.col("work_version") != F.col("original_version") + F.col("normalized").cast("int")).select("doc_id", F.lit("version").alias("check"))
    order = Window.partitionBy("doc_id").orderBy("ord")
    gaps = pieces.withColumn("wp", F.coalesce(F.lag("work_end").over(order), F.lit(0))).withColumn("op", F.coalesce(F.lag("original_end").over(order), F.lit(0)))
    gaps = gaps.where("work_start <> wp or original_start <> op").select("doc_id", F.lit("gap").alias("check")).distinct()
    cover = pieces.groupBy("doc_id").agg(F.max("work_end").alias("w"), F.max("original_end").alias("o"))
    cover = prepared.join(cover, "doc_id", "left").where("coalesce(w, 0) <> work_length or coalesce(o, 0) <> original_length").select("doc_id", F.lit("cover").alias("check"))
    both = pieces.join(prepared.select("doc_id", "original", "work"), "doc_id")
    mine, theirs = cut(F.col("work"), F.col("work_start"), F.col("work_end")), cut(F.col("original"), F.col("original_start"), F.col("original_end"))
    wrong = F.when(F.col("kind") == COPY, mine != theirs).otherwise((mine != "\n") | (theirs != CRLF))
    copies = both.where(wrong).select("doc_id", F.lit("piece").alias("check")).distinct()
    parts = [digests, lengths, versions, gaps, cover, copies]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def metadata_conflicts(prepared: DataFrame, metadata: DataFrame) -> DataFrame:
    """metadata: doc_id, given_version, given_length, given_sha256; a null field is not checked, digests ignore case."""
    rows = prepared.join(metadata, "doc_id")
    named = {"version": F.col("given_version") != F.col("original_version"), "length": F.col("given_length") != F.col("original_length"), "sha256": F.lower("given_sha256") != F.col("original_sha256")}
    found = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in named.items())), lambda x: x.isNotNull())
    return rows.select("doc_id", F.explode(found).alias("conflict"))


def zoned(text: Column) -> Column:
    """Is the text a date and time with a zone?"""
    return F.coalesce(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp(text).isNotNull(), F.lit(False))
