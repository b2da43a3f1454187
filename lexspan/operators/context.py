"""Context units: a window of periods around each period, fenced by paragraphs unless crossing is allowed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical, cut_all, sha256
from . import spans

# Reasons why a window ends where it does, and the limits of one run.
REASONS = ("zero_radius", "radius_met", "document_edge", "paragraph_fence")
MOST = {"units": 10_000, "period_refs": 100_000, "chars": 16 * 1024 * 1024, "references": 500_000}
IDENTITY_VERSION = "1.0.0"


def windows(periods: DataFrame, before: int = 1, after: int = 1, cross: bool = False) -> DataFrame:
    """periods: doc_id, period, paragraph, start_pos, end_pos. One unit for each period."""
    keys = ["doc_id"] if cross else ["doc_id", "paragraph"]
    order = Window.partitionBy(*keys).orderBy("period")
    frame = order.rowsBetween(-before, after)
    whole = Window.partitionBy("doc_id")
    rows = periods.select(
        "doc_id", "period", "paragraph", "start_pos", "end_pos",
        F.min("start_pos").over(frame).alias("window_start"), F.max("end_pos").over(frame).alias("window_end"),
        F.min("period").over(frame).alias("first_period"), F.max("period").over(frame).alias("last_period"),
        F.max("period").over(whole).alias("final"),
    )
    back, ahead = F.col("period") - F.col("first_period"), F.col("last_period") - F.col("period")
    reason = lambda radius, got, edge: F.when(F.lit(radius) == 0, REASONS[0]).when(got == radius, REASONS[1]).when(edge, REASONS[2]).otherwise(REASONS[3])
    return rows.select(
        "doc_id", "period", "paragraph", "start_pos", "end_pos", "window_start", "window_end", "first_period", "last_period",
        back.alias("selected_before"), ahead.alias("selected_after"),
        reason(before, back, F.col("first_period") == 0).alias("reason_before"), reason(after, ahead, F.col("last_period") == F.col("final")).alias("reason_after"),
    )


def with_digests(units: DataFrame, docs: DataFrame) -> DataFrame:
    """Digests of the focus and of the window, separators between its periods included. A document's units are gathered
    and its text is cut once."""
    placed = lambda a, b: F.transform("u", lambda x: F.struct(x[a].alias("start_pos"), x[b].alias("end_pos")))
    rows = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("period", *(c for c in units.columns if c not in ("doc_id", "period"))))).alias("u"))
    rows = rows.join(docs.select("doc_id", "text"), "doc_id")
    digests = lambda a, b: F.transform(cut_all(F.col("text"), placed(a, b)), lambda t: F.struct(sha256(t).alias("sha"), F.length(t).cast("long").alias("n")))
    rows = rows.select("doc_id", F.explode(F.arrays_zip("u", digests("start_pos", "end_pos").alias("f"), digests("window_start", "window_end").alias("w"))).alias("x"))
    return rows.select(*(F.col("doc_id") if c == "doc_id" else F.col(f"x.u.{c}").alias(c) for c in units.columns), F.col("x.f.sha").alias("focus_sha256"), F.col("x.w.sha").alias("window_sha256"), F.col("x.w.n").alias("window_chars"))


def with_original_digests(units: DataFrame, prepared: DataFrame) -> DataFrame:
    """doc_id, period, and of focus and window the span in the original text, its digest and its length: the spans in the
    work text are mapped through the preparation, and what the original holds there is digested, changes undone."""
    rows = units.select("doc_id", "period", "start_pos", "end_pos", F.col("window_start").alias("w0"), F.col("window_end").alias("w1"))
    mapped = spans.original_spans(spans.span_map(prepared), rows, {"focus": ("start_pos", "end_pos"), "window": ("w0", "w1")})
    placed = mapped.select("doc_id", "period", F.col("focus_start").alias("start_pos"), F.col("focus_end").alias("end_pos"), "window_start", "window_end")
    made = with_digests(placed, prepared.select("doc_id", F.col("original").alias("text")))
    return made.select("doc_id", "period", F.col("start_pos").alias("original_start"), F.col("end_pos").alias("original_end"), F.col("window_start").alias("original_window_start"), F.col("window_end").alias("original_window_end"), F.col("focus_sha256").alias("original_focus_sha256"), F.col("window_sha256").alias("original_window_sha256"), F.col("window_chars").alias("original_window_chars"))


def logical_ids(periods: DataFrame, docs: DataFrame, before: int, after: int, cross: bool) -> DataFrame:
    """An identity made of content alone: digest of the text, spans of the focus and of the window's periods, policy."""
    frame = Window.partitionBy("doc_id", *([] if cross else ["paragraph"])).orderBy("period").rowsBetween(-before, after)
    span = F.struct(F.col("end_pos").cast("long").alias("end"), F.col("start_pos").cast("long").alias("start"))
    rows = periods.select("doc_id", "period", span.alias("focus"), F.collect_list(span).over(frame).alias("periods")).join(docs.select("doc_id", sha256(F.col("text")).alias("digest")), "doc_id")
    policy = F.struct(F.lit(after).alias("after"), F.lit(before).alias("before"), F.lit(cross).alias("cross"))
    identity = F.struct(F.struct(F.col("digest").alias("sha256")).alias("document"), "focus", "periods", policy.alias("policy"), F.lit(IDENTITY_VERSION).alias("version"))
    return rows.select("doc_id", "period", sha256(canonical(identity)).alias("logical_id"))


def cost(units: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """What a run over each document would make, before it is made, and whether it stays within the limits. references:
    doc_id, period, paragraph, tokens, refs (annotations, entities, occurrences and their links), notes, for each period;
    with them, references count what the windows' records would repeat."""
    sums = [F.count("*").alias("units"), F.sum(F.col("last_period") - F.col("first_period") + 1).alias("period_refs"), F.sum(F.col("window_end") - F.col("window_start")).alias("chars")]
    if references is not None:
        upto = references.select("doc_id", "period", "paragraph", "tokens", "refs", "notes", *(F.sum(c).over(Window.partitionBy("doc_id").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"{c}_upto") for c in ("refs", "notes")))
        last = upto.select("doc_id", F.col("period").alias("last_period"), F.col("refs_upto").alias("r1"), F.col("notes_upto").alias("n1"), F.col("paragraph").alias("p1"))
        first = upto.select("doc_id", F.col("period").alias("first_period"), (F.col("refs_upto") - F.col("refs")).alias("r0"), (F.col("notes_upto") - F.col("notes")).alias("n0"), F.col("paragraph").alias("p0"))
        units = units.join(last, ["doc_id", "last_period"]).join(first, ["doc_id", "first_period"]).join(references.select("doc_id", "period", "tokens"), ["doc_id", "period"])
        n, paragraphs = F.col("last_period") - F.col("first_period") + 1, F.col("p1") - F.col("p0") + 1
        sums.append(F.sum(F.col("r1") - F.col("r0") + F.col("tokens") + 2 * n + paragraphs + 6 + (F.col("n1") - F.col("n0")) * (2 * n + paragraphs + 2)).alias("references"))
    out = units.groupBy("doc_id").agg(*sums)
    return out.withColumn("allowed", reduce(lambda x, y: x & y, (F.col(c) <= MOST[c] for c in out.columns if c in MOST)))


def refused(units: DataFrame, costs: DataFrame) -> DataFrame:
    """The units, or an error where their document's cost exceeds a limit: nothing is left out or cut short."""
    checked = costs.select("doc_id", F.when(F.col("allowed"), True).otherwise(F.raise_error(F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(" exceeds the limits of a run"))).cast("boolean")).alias("allowed"))
    return units.join(checked, "doc_id").where("allowed").drop("allowed")


def owner_references(units: DataFrame, layers: DataFrame) -> DataFrame:
    """layers: doc_id, period (the owner), layer, ref. References of each unit, those of its focus and of its neighbours
    apart: doc_id, period, owner, role, layer, refs (in order)."""
    held = layers.groupBy("doc_id", F.col("period").alias("owner"), "layer").agg(F.array_sort(F.collect_list("ref")).alias("refs"))
    windows_ = units.select("doc_id", "period", F.explode(F.sequence("first_period", "last_period")).alias("owner"))
    role = F.when(F.col("owner") == F.col("period"), "focus").otherwise("neighbour")
    return windows_.join(held, ["doc_id", "owner"]).select("doc_id", "period", "owner", role.alias("role"), "layer", "refs")


def _holding(units: DataFrame, rows: DataFrame, at: str) -> DataFrame:
    """Each row beside the units whose windows hold its period `at`: a unit's window reaches no further than the widest
    radius, so a row meets as many candidate units as a window has periods."""
    reach = units.groupBy("doc_id").agg(F.max("selected_before").alias("b"), F.max("selected_after").alias("a"))
    near = rows.join(reach, "doc_id").withColumn("focus", F.explode(F.sequence((F.col(at) - F.col("a")).cast("long"), (F.col(at) + F.col("b")).cast("long")))).drop("a", "b")
    return near.join(units.select("doc_id", F.col("period").alias("focus"), "first_period", "last_period"), ["doc_id", "focus"]).where(F.col(at).between(F.col("first_period"), F.col("last_period")))


def pendings(units: DataFrame, occurrences: DataFrame) -> DataFrame:
    """occurrences: doc_id, occurrence, period, notes (array of struct(field, number, message)). One row for each note of
    an occurrence in a window, with its role."""
    notes = occurrences.select("doc_id", "occurrence", F.col("period").alias("source_period"), F.explode("notes").alias("n"))
    rows = _holding(units, notes, "source_period")
    return rows.select("doc_id", F.col("focus").alias("period"), "occurrence", "source_period", F.col("n.field").alias("field"), F.col("n.number").alias("number"), F.col("n.message").alias("message"), F.when(F.col("source_period") == F.col("focus"), "focus").otherwise("neighbour").alias("role"))


def link_places(units: DataFrame, links: DataFrame) -> DataFrame:
    """links: doc_id, occurrence, period, target_period. Is the target inside the window of the unit that holds it?"""
    rows = _holding(units, links, "period")
    inside = F.coalesce(F.col("target_period").between(F.col("first_period"), F.col("last_period")), F.lit(False))
    return rows.select("doc_id", "focus", "occurrence", "period", "target_period", F.when(inside, "in_window").otherwise("outside_window").alias("place"))


def unit(units: DataFrame, doc_id: int | None = None, period: int | None = None, logical_id: str | None = None) -> DataFrame:
    """One unit, by its document and focus period or by its logical id (a column of units): exactly one of the two."""
    by_place = doc_id is not None and period is not None
    if by_place == (logical_id is not None) or (doc_id is None) != (period is None):
        raise ValueError("a unit is asked for by document and period, or by its logical id")
    return units.where((F.col("doc_id") == doc_id) & (F.col("period") == period)) if by_place else units.where(F.col("logical_id") == logical_id)


def differences(made: DataFrame, again: DataFrame) -> DataFrame:
    """Validation by recomputation: rows of either side that the other lacks; none if the record is valid.
    Each side is computed once, and both meet in one exchange."""
    sides = made.withColumn("_n", F.lit(1)).unionByName(again.withColumn("_n", F.lit(-1))).groupBy(*made.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, "recorded").otherwise("recomputed")
    return sides.select(*made.columns, F.explode(F.array_repeat(side, F.abs("_n").cast("int"))).alias("side"))
