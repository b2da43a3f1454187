"""Operator 3: chat formatting with a grammar round trip, in DataFrame operations only.

Grammar:  conversation := turn* ; turn := "### " role ": " text "</turn>" LF
A control string inside a role or a text gets a backslash behind its first character, a backslash is doubled, and ": "
inside a role is split the same way, so neither terminator nor header can arise inside content; the parser drops each
backslash and keeps what follows it. A turn is first rendered as it is and parsed again; if the parser rejects it or
recovers another role or text, its content is escaped. The whole conversation is then parsed once more and compared
with its source turn by turn; a difference raises an error.

Turns are ordered by turn, role, text (nulls first). Null roles and texts count as empty. Repeated rows are repeated
turns. Rows with a null conv_id form one conversation. An empty table gives an empty result. The rows of one
conversation meet in one row of the result, which is that conversation's text; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound

HEAD, COLON, END = "### ", ": ", "</turn>"
STOP = END + "\n"
LEARNED = "assistant"


def _split_up(text: Column, mark: str) -> Column:
    return F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return _split_up(_split_up(doubled, END), HEAD)


def escape_role(role: Column) -> Column:
    return _split_up(escape(role), COLON)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def pieces(formatted: Column) -> Column:
    """The turns of a formatted text, each without its terminator."""
    parts = F.split(formatted, STOP)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def piece_role(piece: Column) -> Column:
    return unescape(F.substring_index(F.substr(piece, F.lit(len(HEAD) + 1)), COLON, 1))


def piece_text(piece: Column) -> Column:
    """The text as it stands in the output, still escaped."""
    return F.substr(piece, F.locate(COLON, piece, len(HEAD) + 1) + F.lit(len(COLON)))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(COLON), text, F.lit(STOP))


def _accepted(role: Column, text: Column) -> Column:
    """Does the parser take the turn as it is, and give the same role and text back?"""
    turn = render(role, text)
    one = F.size(pieces(turn)) == 1
    piece = F.element_at(pieces(turn), 1)
    clean = ~F.contains(role, F.lit(HEAD)) & ~F.contains(text, F.lit(HEAD)) & ~F.contains(role, F.lit(END)) & ~F.contains(text, F.lit(END))
    return one & clean & (piece_role(piece) == role) & (unescape(piece_text(piece)) == text)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask (array of start, length in code points of the learned texts), turns (what the
    parser recovers: role, text, and raw, the text as it stands in the output)."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("ok", _accepted(F.col("role"), F.col("text")))
    rows = rows.withColumn("r", F.when(F.col("ok"), F.col("role")).otherwise(escape_role(F.col("role"))))
    rows = rows.withColumn("t", F.when(F.col("ok"), F.col("text")).otherwise(escape(F.col("text"))))
    rows = rows.withColumn("segment", render(F.col("r"), F.col("t")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("place", F.row_number().over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("stop", F.sum(F.length("segment")).over(order))
    start = F.col("stop") - F.length(F.lit(STOP)) - F.length("t")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text", "segment", start.alias("start"), F.length("t").cast("long").alias("length")))).alias("source"))
    made = grouped.select("conv_id", "source", F.array_join("source.segment", "").alias("formatted"))
    parsed = made.withColumn("turns", F.transform(pieces(F.col("formatted")), lambda p: F.struct(piece_role(p).alias("role"), unescape(piece_text(p)).alias("text"), piece_text(p).alias("raw"))))
    same = (F.col("turns.role") == F.col("source.role")) & (F.col("turns.text") == F.col("source.text"))
    learned = F.filter("source", lambda s: s["role"] == LEARNED)
    mask = F.transform(learned, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("round trip differs in conversation "), F.col("conv_id").cast("string"))).cast("string"))
    return parsed.select("conv_id", checked.alias("formatted"), mask.alias("loss_mask"), "turns")


#: Spans cut out of one chunk of a long text, so that no cut walks the whole text.
TOGETHER = 64


def cut(text: Column, spans: Column) -> Column:
    """The stretches of a text under sorted spans (start, length) of code points, unescaped, one behind another."""
    sub = lambda t, a, n: F.substr(t, (a + 1).cast("int"), n.cast("int"))

    def cut_group(some: Column) -> Column:
        begin, last = F.element_at(some, 1)["start"], F.element_at(some, -1)
        chunk = F.struct(sub(text, begin, last["start"] + last["length"] - begin).alias("t"), begin.alias("at"))
        return bound(chunk, lambda c: F.array_join(F.transform(some, lambda s: unescape(sub(c["t"], s["start"] - c["at"], s["length"]))), ""))

    groups = lambda s: F.transform(F.sequence(F.lit(1), F.size(s), F.lit(TOGETHER)), lambda g: bound(F.slice(s, g, TOGETHER), cut_group))
    return bound(spans, lambda s: F.when(F.size(s) > 0, F.array_join(groups(s), "")).otherwise(""))


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output alone: turns as the parser recovers them, the learned text under the mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = cut(F.col("formatted"), F.col("loss_mask"))
    out = formatted.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


TRICKY = "\\### Assistant: </turn> ok"


def with_tricky(turns: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts hold the template's own control strings."""
    extra = turns.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(TRICKY).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


_CLEAN = "NOT (contains(role, '### ') OR contains(text, '### ') OR contains(role, '</turn>') OR contains(text, '</turn>') OR contains(role, '\\') OR contains(text, '\\') OR contains(role, ': '))"
_ESC = "replace(replace(replace({}, '\\', '\\\\'), '</turn>', '<\\/turn>'), '### ', '#\\## ')"
ORACLE = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'),
made AS (
  SELECT *, CASE WHEN {_CLEAN} THEN length(role) + length(text)
                 ELSE length(replace({_ESC.format("role")}, ': ', ':\\ ')) + length({_ESC.format("text")}) END + 14 AS chars FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM made GROUP BY conv_id"""
