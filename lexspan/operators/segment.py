"""Segmentation: tokens, separators, paragraphs and periods, with spans in code points.

Everything is local to a document: one exchange by doc_id serves all windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK_LINE, PIECES, bound, cut_all, record, running, sha256

# Titles before whose dot no period ends, closing and opening marks.
TITLES = ["dr", "dra", "sr", "sra"]
CLOSERS = ['"', "'", "”", "’", ")", "]", "}", "»", "›", "」", "』"]
OPENERS = ['"', "'", "“", "‘", "(", "[", "{", "«"]
STRAIGHT = ['"', "'"]
MOST_CHARS = 2 * 1024 * 1024


def pieces(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Tokens and runs of white space in order: doc_id, k, piece, start_pos, end_pos, blank."""
    rows = docs.where("text is not null").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({PIECES})"), F.lit(1))).alias("k", "piece"))
    upto = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end_pos", F.sum(F.length("piece")).over(upto))
    return rows.select("doc_id", "k", "piece", (F.col("end_pos") - F.length("piece")).alias("start_pos"), "end_pos", F.col("piece").rlike(r"^\s+$").alias("blank"))


def pieces_by(docs: DataFrame, tokenize: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    """As `pieces`, with spans from an injected tokenizer; the gaps between its tokens become separators."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                at, k = 0, 0
                for a, b in [*((a, b) for a, b in tokenize(text) if text[a:b].strip()), (len(text), len(text))]:
                    if a < at:
                        raise ValueError(f"tokens of document {doc_id} overlap")
                    for x, y, blank in ((at, a, True), (a, b, False)):
                        if x < y:
                            rows.append((doc_id, k, text[x:y], x, y, blank))
                            k += 1
                    at = b
            yield pd.DataFrame(rows, columns=["doc_id", "k", "piece", "start_pos", "end_pos", "blank"])

    return docs.where("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, k int, piece string, start_pos long, end_pos long, blank boolean")


def tokens(parts: DataFrame) -> DataFrame:
    """doc_id, ord, token, start_pos, end_pos, paragraph (from 0; a blank line between two tokens starts the next)."""
    order = Window.partitionBy("doc_id").orderBy("k")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    breaks = F.sum(F.when(F.col("blank") & F.col("piece").rlike(BLANK_LINE), 1).otherwise(0)).over(upto)
    rows = parts.withColumn("breaks", breaks).where("not blank")
    first = F.min("breaks").over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("ord"), F.col("piece").alias("token"), "start_pos", "end_pos", (F.col("breaks") - first).alias("paragraph"))


def separators(parts: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("k")
    return parts.where("blank").select("doc_id", (F.row_number().over(order) - 1).alias("ord"), F.col("piece").alias("separator"), "start_pos", "end_pos")


def rebuilt(parts: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, same: do tokens and separators in order give the text again?"""
    joined = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("p"))
    joined = joined.select("doc_id", sha256(F.array_join("p.piece", "")).alias("digest"))
    return docs.where("text is not null").join(joined, "doc_id", "left").select("doc_id", F.coalesce(F.col("digest") == sha256(F.col("text")), F.col("text") == "").alias("same"))


def _terminal(token: Column) -> Column:
    return token.rlike(r"^[.!?]+$")


def with_periods(toks: DataFrame) -> DataFrame:
    """Tokens with `period` (from 0 in the document) and `closed` (does punctuation end the period?).

    A token that can be absorbed after an end (further terminal punctuation, closers; straight quotes only if adjacent)
    belongs to the token before it; such a run ends a period at its last token if it holds a terminal candidate.
    """
    order = Window.partitionBy("doc_id", "paragraph").orderBy("ord")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # What follows a token is carried back from the end: frames that reach ahead are computed anew for each row.
    back = Window.partitionBy("doc_id", "paragraph").orderBy(F.desc("ord"))
    onward, behind = back.rowsBetween(Window.unboundedPreceding, Window.currentRow), back.rowsBetween(Window.unboundedPreceding, -1)
    token = F.col("token")
    letter = F.regexp_extract(token, r"\p{L}", 0)
    rows = toks.withColumn("upper", F.last(F.when(~token.isin(OPENERS), letter.rlike(r"\p{Lu}")), ignorenulls=True).over(onward))
    rows = rows.withColumn("upper_next", F.coalesce(F.last(F.when(~token.isin(CLOSERS), F.coalesce("upper", F.lit(False))), ignorenulls=True).over(behind), F.lit(True)))
    rows = rows.withColumn("prev", F.lag("token").over(order)).withColumn("next", F.lead("token").over(order))
    rows = rows.withColumn("glued", F.coalesce(F.lag("end_pos").over(order) == F.col("start_pos"), F.lit(False)))
    rows = rows.withColumn("tight", F.coalesce(F.lead("start_pos").over(order) == F.col("end_pos"), F.lit(False)))
    word = F.regexp_replace(F.lower("prev"), r"\.+$", "")
    inner = F.col("tight") & F.col("prev").rlike(r"[0-9]$") & F.col("next").rlike(r"^[0-9]")
    dot = F.when(~F.col("glued"), True).when(word.isin(TITLES), False).when(word == "etc", F.col("upper_next")).when(inner, False).otherwise(True)
    candidate = F.when(F.lower(token) == "etc.", F.col("upper_next")).when(~_terminal(token), False).when(token.rlike(r"^\.{2,}$"), False).when(token == ".", dot).otherwise(True)
    absorbable = _terminal(token) | (token.isin(CLOSERS) & (~token.isin(STRAIGHT) | F.col("glued")))
    rows = rows.withColumn("candidate", candidate).withColumn("absorbed", absorbable)
    # A run begins at a token that is not absorbed; it ends a period at its last token if a candidate lies in it.
    run = F.coalesce(F.max(F.when(~F.col("absorbed"), F.col("ord"))).over(upto), F.lit(-1))
    inside = F.coalesce(F.max(F.when(F.col("candidate"), F.col("ord"))).over(upto) >= run, F.lit(False))
    rows = rows.withColumn("ends", inside & ~F.coalesce(F.lead("absorbed").over(order), F.lit(False)))
    rows = rows.withColumn("cut_before", F.coalesce(F.lag("ends").over(order), F.lit(True)))
    # In the order of the windows above, so that nothing is sorted again.
    number = F.sum(F.col("cut_before").cast("int")).over(Window.partitionBy("doc_id").orderBy("paragraph", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    return rows.select("doc_id", "ord", "token", "start_pos", "end_pos", "paragraph", number.alias("period"), "ends")


def periods(tagged: DataFrame) -> DataFrame:
    """doc_id, period, paragraph, first_token, last_token, start_pos, end_pos, rule."""
    out = tagged.groupBy("doc_id", "period").agg(F.min("paragraph").alias("paragraph"), F.min("ord").alias("first_token"), F.max("ord").alias("last_token"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.max("ends").alias("closed"))
    return out.select("doc_id", "period", "paragraph", "first_token", "last_token", "start_pos", "end_pos", F.when(F.col("closed"), "terminal_punctuation").otherwise("paragraph_end").alias("rule"))


# Chunks: what `pieces`, `tokens` and `with_periods` find token by token, found stretch by stretch. A chunk is white space
# with a blank line in it, or what stands before a run of terminal punctuation together with that run and all that is
# absorbed behind it; a period can end at a chunk's end only, and every chunk ends where a piece ends.
_BREAK = rf"(?=\s*?{BLANK_LINE})\s++"
_SPACE = rf"(?!\s*?{BLANK_LINE})\s++"
_WORD = r"[\p{L}\p{M}]++(?:['’-][\p{L}\p{M}]++)*+"
_TOKEN = rf"{_WORD}|[0-9]++(?:[.,:/][0-9]++)*+|[.!?]++|[^\s\p{{L}}\p{{M}}0-9]"
_BODY = rf"(?:{_SPACE}|{_WORD}|[0-9]++(?:[.,:/][0-9]++)*+|[^\s\p{{L}}\p{{M}}0-9.!?])++"
_mark = lambda marks: "[" + "".join("\\" + m for m in marks) + "]"
_TAIL = rf"[.!?]++(?:{_mark(STRAIGHT)}|(?:{_SPACE})?(?:[.!?]++|{_mark([c for c in CLOSERS if c not in STRAIGHT])}))*+"
CHUNK = rf"({_BREAK}|{_BODY}(?:{_TAIL})?|{_TAIL})"
#: A chunk's tail, from its first terminal punctuation that is not inside a number.
_AT_END = rf"([.!?][.!?\s{_mark(CLOSERS)[1:-1]}]*)$"
#: A title, or "etc", as the whole of the last word.
_LAST = r"(?<![\p{L}\p{M}])(?<![\p{L}\p{M}]['’-])(?i:%s)$"


def chunks(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. A document's chunks that hold tokens: doc_id, k, chunk, at (where it begins), ord (of its first
    token), n (its tokens), paragraph, period, ends (does punctuation end the period here?). Rows are as many as stretches
    between terminal punctuation, so that the windows sort few of them."""
    rows = docs.where("text is not null").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(CHUNK), F.lit(1))).alias("k", "chunk"))
    rows = rows.withColumns({"size": F.length("chunk"), "n": F.regexp_count("chunk", F.lit(_TOKEN)), "tail": F.regexp_extract("chunk", _AT_END, 1)})
    rows = rows.withColumn("breaks", ((F.col("n") == 0) & F.col("chunk").rlike(BLANK_LINE)).cast("int"))
    order = Window.partitionBy("doc_id").orderBy("k")
    upto, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"at": F.coalesce(F.sum("size").over(before), F.lit(0)), "ord": F.coalesce(F.sum("n").over(before), F.lit(0)), "b": F.sum("breaks").over(upto), "then": F.lead(F.when(F.col("breaks") == 0, F.col("chunk"))).over(order)})
    # The first terminal of the tail: what stands before it decides whether a single dot ends a period.
    first, body = F.regexp_extract("tail", r"^([.!?]+)", 1), F.expr("substring(chunk, 1, size - length(tail))")
    rest = F.concat(F.expr("substring(tail, 2)"), F.coalesce("then", F.lit("")))  # behind a single dot
    joined = r"(?:\p{M}+['’-](?=[\p{L}\p{M}]))*\p{M}*\p{Lu}"
    upper = rest.rlike(rf"^[\s{_mark(CLOSERS)[1:-1]}]*$") | rest.rlike(rf"^[\s{_mark(CLOSERS)[1:-1]}]*+[\s{_mark(OPENERS)[1:-1]}]*+{joined}")
    dot = F.when(body.rlike(r"(?:^|\s)$"), True).when(body.rlike(_LAST % "|".join(TITLES)), False).when(body.rlike(_LAST % "etc"), upper).otherwise(True)
    later = F.col("tail").rlike(r"^[.!?]+[^.!?][^!?]*?(?:[!?]|(?<!\.)\.(?!\.))")
    ends = F.when(F.col("tail") == "", False).otherwise((F.when(first == ".", dot).otherwise(first.rlike("[!?]"))) | later)
    rows = rows.where("n > 0").withColumn("ends", ends)
    first_break = F.min("b").over(upto)  # of the first token; breaks only grow
    rows = rows.withColumn("paragraph", F.col("b") - first_break)
    cut_before = F.coalesce(F.lag("ends").over(order) | (F.lag("b").over(order) != F.col("b")), F.lit(True))
    rows = rows.withColumn("cut", cut_before)
    period = (F.sum(F.col("cut").cast("int")).over(upto) - 1).alias("period")
    return rows.select("doc_id", "k", "chunk", "at", "ord", "n", "paragraph", period, "ends")


def tagged_in(docs: DataFrame) -> DataFrame:
    """As with_periods(tokens(pieces(docs))): the tokens are cut out of chunks that know their period."""
    spaced = F.regexp_extract_all("chunk", F.lit(rf"(\s*+(?:{_TOKEN}))"), F.lit(1))
    placed = lambda xs, ends: F.transform(xs, lambda x, j: record(x=x, e=F.get(ends, j)))
    # Places are summed up in the chunk's row; a window over tokens would sort them all.
    each = bound(spaced, lambda xs: bound(running(F.transform(xs, F.length)), lambda ends: placed(xs, ends)))
    rows = chunks(docs).select("doc_id", "at", F.col("ord").alias("o"), "n", "paragraph", "period", "ends", F.posexplode(each).alias("j", "x"))
    rows = rows.withColumns({"token": F.ltrim("x.x", F.lit(" \t\n\x0b\f\r")), "end_pos": F.col("at") + F.col("x.e")})
    return rows.select("doc_id", (F.col("o") + F.col("j")).cast("int").alias("ord"), "token", (F.col("end_pos") - F.length("token")).alias("start_pos"), "end_pos", "paragraph", "period", (F.col("ends") & (F.col("j") == F.col("n") - 1)).alias("ends"))


def words_of(docs: DataFrame) -> DataFrame:
    """doc_id, ord, token, as tokens(pieces(docs)) has them: tokens are numbered where they are found, nothing is sorted."""
    return docs.where("text is not null").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(rf"\s*+({_TOKEN})"), F.lit(1))).alias("ord", "token"))


def words_in(docs: DataFrame) -> DataFrame:
    """doc_id, period, words, low: the tokens of each period in one row, without a row for each of them; low is the ord of
    the first."""
    rows = chunks(docs).select("doc_id", "period", "k", "ord", F.regexp_extract_all("chunk", F.lit(rf"\s*+({_TOKEN})"), F.lit(1)).alias("w"))
    rows = rows.groupBy("doc_id", "period").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("c"), F.min("ord").cast("int").alias("low"))
    return rows.select("doc_id", "period", F.flatten("c.w").alias("words"), "low")


def periods_in(docs: DataFrame) -> DataFrame:
    """As periods(tagged_in(docs)), from the chunks alone."""
    left = F.length("chunk") - F.length(F.ltrim("chunk", F.lit(" \t\n\x0b\f\r")))
    right = F.length(F.rtrim("chunk", F.lit(" \t\n\x0b\f\r")))
    rows = chunks(docs).select("doc_id", "period", "paragraph", "ends", F.col("ord").alias("first_token"), (F.col("ord") + F.col("n") - 1).alias("last_token"), (F.col("at") + left).alias("start_pos"), (F.col("at") + right).alias("end_pos"))
    out = rows.groupBy("doc_id", "period").agg(F.min("paragraph").alias("paragraph"), F.min("first_token").cast("int").alias("first_token"), F.max("last_token").cast("int").alias("last_token"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.max("ends").alias("closed"))
    return out.select("doc_id", "period", "paragraph", "first_token", "last_token", "start_pos", "end_pos", F.when(F.col("closed"), "terminal_punctuation").otherwise("paragraph_end").alias("rule"))


def paragraphs(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("doc_id", "paragraph").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count_distinct("period").alias("periods"), F.count("*").alias("tokens"))


def paragraphs_in(found: DataFrame) -> DataFrame:
    """As paragraphs(tagged), from the periods, each of which lies in one paragraph: no token is a row."""
    size = F.col("last_token") - F.col("first_token") + 1
    return found.groupBy("doc_id", "paragraph").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count("*").alias("periods"), F.sum(size).alias("tokens"))


def neighbours(found: DataFrame) -> DataFrame:
    """Previous and next period in the document's order, across paragraphs."""
    order = Window.partitionBy("doc_id").orderBy("period")
    return found.select("doc_id", "period", F.lag("period").over(order).alias("previous"), F.lead("period").over(order).alias("following"))


def too_long(docs: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """Documents over the limit: an explicit refusal, never a truncation."""
    return docs.where(F.length("text") > most).select("doc_id", F.length("text").cast("long").alias("chars"))


def with_text(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans with the text under them; a document's spans are gathered and its text is cut once."""
    rest = [c for c in found.columns if c not in ("doc_id", "start_pos", "end_pos")]
    rows = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", *rest))).alias("s")).join(docs.select("doc_id", "text"), "doc_id")
    rows = rows.select("doc_id", F.explode(F.arrays_zip("s", cut_all(F.col("text"), F.col("s")).alias("t"))).alias("x"))
    return rows.select(*(F.col("doc_id") if c == "doc_id" else F.col(f"x.s.{c}").alias(c) for c in found.columns), F.col("x.t").alias("literal"))
