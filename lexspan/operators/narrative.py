"""The structural validator of short narratives and its event-sourced state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STORY_WORD

SLOTS = 5
#: Paragraph break: blank lines of any line end, or U+2029.
BREAK = "(?:\r\n|[\r\n])(?:[^\\S\r\n]*(?:\r\n|[\r\n]))+| "
# Dotted abbreviations. The look-arounds that Java has and RE2 lacks are used here only.
ABBREVIATION = (
    r"(?<![\p{L}\p{N}_])(?:(?iu:p\.[ \t]*ex\.|a\.c\.|d\.c\.|(?:srs?|sras?|srta|drs?|dras?|prof|profa|profs|profas|etc|ex|obs|av|pág|págs|pag|pags|pp|art|arts|cap|caps|tel|cel|ed|eds|vol|vols|aprox|depto|depart|min|máx|max)\.)"
    r"|(?:[A-ZÀ-ÖØ-Ý]\.){2,}|[A-ZÀ-ÖØ-Ý]\.(?=[ \t]+[A-ZÀ-ÖØ-Ý][a-zà-öø-ÿ])|(?iu:(?:n|núm|num)\.[ \t]*[º°])|\d+\.[ºª])"
)
FORBIDDEN = {"colon": ":", "semicolon": ";", "ellipsis": r"\.{3,}|…", "dash": "[—―]"}
#: Stands for a protected dot while periods are cut: a private-use character. Where a text holds it, or the mark of that,
#: both are written as the mark and a code, and read back.
HELD, MARK, IS_HELD, IS_MARK = "\ue000", "\ue001", "\ue002", "\ue003"


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(STORY_WORD)).cast("long")


def paragraphs(text: Column) -> Column:
    return F.size(F.filter(F.split(text, BREAK), lambda p: p.rlike(r"\S"))).cast("long")


def found_at(df: DataFrame, column: str, pattern: str, kind: str) -> DataFrame:
    """Matches with offsets: the pieces between matches are cumulated."""
    parts = F.split(column, f"(?:{pattern})", -1)
    hits = F.regexp_extract_all(column, F.lit(f"({pattern})"), F.lit(1))
    rows = df.select("id", F.posexplode(F.arrays_zip(parts.alias("p"), hits.alias("h"))).alias("k", "x")).select("id", "k", F.col("x.p").alias("p"), F.col("x.h").alias("h"))
    upto = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end_pos", F.sum(F.length("p") + F.coalesce(F.length("h"), F.lit(0))).over(upto))
    return rows.where("h is not null").select("id", F.lit(kind).alias("kind"), (F.col("end_pos") - F.length("h")).alias("start_pos"), "end_pos", F.col("h").alias("found"))


def forbidden(texts: DataFrame, abbreviations: bool = True) -> DataFrame:
    """texts: id, text. Forbidden punctuation with offsets."""
    kinds = FORBIDDEN | ({"abbreviation": ABBREVIATION} if abbreviations else {})
    out = None
    for kind, pattern in kinds.items():
        part = found_at(texts, "text", pattern, kind)
        out = part if out is None else out.unionByName(part)
    return out


def protected(text: Column) -> Column:
    """The text with dots of abbreviations and decimals held back."""
    free = F.replace(F.replace(text, F.lit(MARK), F.lit(MARK + IS_MARK)), F.lit(HELD), F.lit(MARK + IS_HELD))
    held = F.regexp_replace(free, r"(?<=\d)\.(?=\d)", HELD)
    parts, hits = F.split(held, ABBREVIATION, -1), F.regexp_extract_all(held, F.lit(f"({ABBREVIATION})"), F.lit(1))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(parts.alias("p"), hits.alias("h")), lambda x: F.array(x["p"], F.coalesce(F.replace(x["h"], F.lit("."), F.lit(HELD)), F.lit(""))))), "")


def released(text: Column) -> Column:
    """What `protected` held back, again."""
    return F.replace(F.replace(F.replace(text, F.lit(HELD), F.lit(".")), F.lit(MARK + IS_HELD), F.lit(HELD)), F.lit(MARK + IS_MARK), F.lit(MARK))


def periods(texts: DataFrame, guard: bool = True) -> DataFrame:
    """id, k, period, words, closed: runs up to terminal punctuation and closing quotes that hold a word."""
    text = protected(F.col("text")) if guard else F.col("text")
    every = F.regexp_extract_all(text, F.lit("([^.!?]*[.!?]+[\"'”’»]*|[^.!?]+$)"), F.lit(1))
    rows = texts.select("id", F.posexplode(every).alias("k", "p")).withColumn("period", F.regexp_replace(released(F.col("p")) if guard else F.col("p"), r"^\s+|\s+$", ""))
    rows = rows.where(words(F.col("period")) > 0)
    order = Window.partitionBy("id").orderBy("k")
    return rows.select("id", (F.row_number().over(order) - 1).alias("k"), "period", words(F.col("period")).alias("words"), F.col("p").rlike("[.!?]+[\"'”’»]*$").alias("closed"))


def validated(texts: DataFrame, abbreviations: bool = True) -> DataFrame:
    """One paragraph, SLOTS closed periods, nothing forbidden."""
    p = periods(texts, abbreviations).groupBy("id").agg(F.count("*").alias("periods"), F.count_if(~F.col("closed")).alias("open"))
    f = forbidden(texts, abbreviations).groupBy("id").agg(F.count("*").alias("forbidden"))
    rows = texts.select("id", paragraphs(F.col("text")).alias("paragraphs"), words(F.col("text")).alias("words")).join(p, "id", "left").join(f, "id", "left")
    rows = rows.select("id", "paragraphs", "words", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("periods", "open", "forbidden")))
    return rows.withColumn("valid", (F.col("paragraphs") == 1) & (F.col("periods") == SLOTS) & (F.col("open") == 0) & (F.col("forbidden") == 0))


def state(events: DataFrame) -> DataFrame:
    """events: story, seq, slot, verb (edit, generate, approve), text. Current text of each slot; an edit or a generated
    text takes back the approval of its slot and of all later ones, and marks later slots that hold text for review."""
    edits, approvals = events.where("verb in ('edit', 'generate')"), events.where("verb = 'approve'")
    last = edits.groupBy("story", "slot").agg(F.max_by("text", "seq").alias("text"), F.max("seq").alias("edited"))
    order = Window.partitionBy("story").orderBy("slot")
    last = last.withColumn("touched", F.max("edited").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    said = approvals.groupBy("story", "slot").agg(F.max("seq").alias("approved_at"))
    rows = last.join(said, ["story", "slot"], "left")
    ok = F.coalesce(F.col("approved_at") > F.col("touched"), F.lit(False))
    return rows.select("story", "slot", "text", ok.alias("approved"), ((F.col("touched") > F.col("edited")) & (F.col("text") != "")).alias("review"))


def compositions(events: DataFrame) -> DataFrame:
    """events: story, seq, slot, verb, text. The composition of each slot: what was last saved (verb compose), or what the
    slot before had when it was last inherited (verb inherit); later changes there are not followed. Slot by slot, as the
    value inherited may be inherited itself: (story, slot, composition)."""
    made, above = None, None
    for slot in range(SLOTS):
        saved = events.where((F.col("slot") == slot) & (F.col("verb") == "compose")).select("story", "seq", "text")
        if above is not None:
            asked = events.where((F.col("slot") == slot) & (F.col("verb") == "inherit")).select("story", "seq", F.lit(None).cast("string").alias("text"), F.lit(True).alias("asks"))
            order = Window.partitionBy("story").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            both = above.withColumn("asks", F.lit(False)).unionByName(asked).withColumn("text", F.last("text", ignorenulls=True).over(order))
            saved = saved.unionByName(both.where("asks and text is not null").select("story", "seq", "text"))
        above = saved
        last = saved.groupBy("story").agg(F.max_by("text", "seq").alias("composition")).select("story", F.lit(slot).alias("slot"), "composition")
        made = last if made is None else made.unionByName(last)
    return made


def prompts(current: DataFrame, fields: DataFrame) -> DataFrame:
    """current: as `state` gives it; fields: story, slot, instructions, composition (nulls: not set). The user message for
    the next text of each slot, as JSON: the texts before it in order, and of the fields those that are set."""
    order = Window.partitionBy("story").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rows = current.withColumn("previous", F.collect_list(F.struct("slot", "text")).over(order)).join(fields, ["story", "slot"], "left")
    set_ = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return rows.select("story", "slot", F.to_json(F.struct(set_("composition").alias("composition"), set_("instructions").alias("instructions"), F.transform("previous", lambda p: p["text"]).alias("previous"), F.col("slot"))).alias("message"))


def assembled(current: DataFrame) -> DataFrame:
    """Stories whose slots are all approved, joined by a blank line."""
    rows = current.groupBy("story").agg(F.array_sort(F.collect_list(F.struct("slot", "text"))).alias("s"), F.bool_and("approved").alias("ok"), F.count("*").alias("n"))
    return rows.where(F.col("ok") & (F.col("n") == SLOTS)).select("story", F.array_join("s.text", "\n\n").alias("narrative"))


def migrated(states: DataFrame) -> DataFrame:
    """Schema 1.0 or 2.0 (id, schema, texts map, plan, tone) to 3.0: removed fields go to an archive, nothing is lost."""
    old = F.col("schema") != "3.0"
    archive = F.when(old, F.to_json(F.struct("plan", "tone")))
    return states.select("id", F.lit("3.0").alias("schema"), "texts", archive.alias("archive"), F.when(old, F.col("schema")).alias("migrated_from"))
