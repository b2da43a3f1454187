"""Operator 13: secret scans by sliding-window Shannon entropy, in DataFrame operations only.

Base spans are matches of three patterns: a named value (`assign`), an access key (`access`), a run of hex digits
(`hex`); a match whose value is too short is dropped, not searched again for another.

Added spans come from entropy. Candidate strings are runs of at least WINDOW characters that keys, paths and addresses are
made of. A candidate that the allow-list names (addresses, UUIDs, alphabets, placeholders, a caller's own patterns) is
suppressed. In the rest, runs of one character class (hex digits, or the base64 alphabets) are read by a window of WINDOW
characters: the counts of its symbols, of digits, capitals and small letters are kept up one character at a time, and so
is the sum of c * log2(c), held as an integer so that it cannot drift. A window is a hit if its entropy reaches the class's
bits and it mixes the kinds of character that the class asks for; hits that overlap or touch are one span. Spans inside a
base span are not repeated. Base spans are never suppressed.

Positions are code points: the matches of a pattern and the gaps between them are cut by the same pattern, and their
lengths are summed up in blocks, so that a text with very many matches costs little more than its length.

Every row depends on itself only: nothing is shuffled. Null and empty texts have no spans. Rows with a null doc_id and
repeated rows are scanned like others; spans with equal starts are ordered by kind, then by end. An empty table gives an
empty result; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound

# What the contract names.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
LEAST = {"assign": 6, "access": 20, "hex": 24}

WINDOW = 20
#: class: its characters, least bits of a window, kinds of character that a window must hold (digit, capital, small).
CLASSES = {"entropy_hex": ("0-9A-Fa-f", 3.0, ("digit", "letter")), "entropy_base64": ("A-Za-z0-9+/_-", 3.8, ("digit", "capital", "small"))}
CANDIDATE = f"[A-Za-z0-9+/_=.:@%?&~#-]{{{WINDOW},}}"
#: Candidates that hold one of these are no secrets.
ALLOWED = ("://", "[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", "(?i:example|sample|placeholder|changeme|dummy|xxxx)", "(?i:abcdefghij|0123456789|qwertyuiop)")
KINDS = (*LEAST, *CLASSES)


def _either_case(pattern: str) -> str:
    """ASCII letters in either case, whatever an engine takes for the other case of a letter."""
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in pattern)


ASSIGN = f"({_either_case('|'.join(NAMES))})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A short match of these two leaves nothing behind it that could match, so the least length stands in the pattern.
ACCESS, HEX = f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", f"[0-9a-f]{{{LEAST['hex']},}}"

SCALE = 1 << 20
#: c * log2(c), scaled.
WEIGHTS = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(WINDOW + 1)]

TOGETHER = 64
SPAN = "array<struct<start:int,no:int,stop:int>>"


def most_weight(bits: float) -> int:
    """The largest sum of WEIGHTS over a window's counts with so many bits: H = log2(n) - sum / n."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


def running(values: Column, levels: int = 3) -> Column:
    """Running sums of an array of integers; blocks of TOGETHER are summed first, so a long array is not walked again for
    each element."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    if levels == 1:
        return F.transform(values, lambda x, k: total(F.slice(values, 1, k + 1)))

    def of_blocks(blocks: Column) -> Column:
        ends = lambda sums: F.zip_with(blocks, sums, lambda b, end: bound(end - total(b), lambda base: F.transform(running(b, 1), lambda x: x + base)))
        return F.flatten(bound(bound(F.transform(blocks, total), lambda t: running(t, levels - 1)), ends))

    blocks = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(TOGETHER)), lambda g: F.slice(values, g, TOGETHER))
    return F.when(F.size(values) > TOGETHER, bound(blocks, of_blocks)).when(F.size(values) > 0, running(values, 1)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap, in order: start, stop, m."""

    def placed(both: Column) -> Column:
        moves = F.zip_with(both["m"], F.slice(both["gaps"], 1, F.size(both["m"])), lambda m, gap: F.length(gap) + F.length(m))
        return F.zip_with(running(moves), both["m"], lambda stop, m: F.struct((stop - F.length(m)).alias("start"), stop.alias("stop"), m.alias("m")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), bound(both, placed)).otherwise(F.array().cast("array<struct<start:int,stop:int,m:string>>"))


def _span(no: int, start: Column, stop: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(no).alias("no"), stop.cast("int").alias("stop"))


def base_spans(text: Column) -> dict[str, Column]:
    value = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= LEAST["assign"]
    found = {"assign": F.filter(matches(text, ASSIGN), value), "access": matches(text, ACCESS), "hex": matches(text, HEX)}
    as_spans = lambda no: lambda x: _span(no, x["start"], x["stop"])
    return {kind: F.transform(spans, as_spans(KINDS.index(kind))) for kind, spans in found.items()}


def hot_windows(run: Column, bits: float, needs: Sequence[str]) -> Column:
    """The parts (start, stop) of a run of characters that its hits cover."""
    limit, weights = most_weight(bits), F.array(*map(F.lit, WEIGHTS))

    def read(chars: Column) -> Column:
        return bound(F.array_distinct(chars), lambda symbols: bound(F.transform(chars, lambda c: F.array_position(symbols, c).cast("int")), lambda codes: slide(chars, symbols, codes)))

    def slide(chars: Column, symbols: Column, codes: Column) -> Column:
        kind = {"digit": "[0-9]", "capital": "[A-Z]", "small": "[a-z]", "letter": "[A-Za-z]"}
        is_a = lambda c, name: F.coalesce(c.rlike(kind[name]).cast("int"), F.lit(0))
        none = [F.lit(0).alias(name) for name in needs]
        start = F.struct(F.transform(symbols, lambda s: F.lit(0)).alias("counts"), F.lit(0).cast("long").alias("weight"), *none, F.array().cast("array<struct<start:int,stop:int>>").alias("hits"))

        def step(now: Column, i: Column) -> Column:
            inn, out = F.get(codes, i), F.coalesce(F.get(codes, i - WINDOW), F.lit(0))
            counts = F.transform(now["counts"], lambda n, k: n + (k + 1 == inn).cast("int") - (k + 1 == out).cast("int"))
            count = lambda code: F.get(now["counts"], code - 1)
            up = F.get(weights, count(inn) + 1) - F.get(weights, count(inn))
            down = F.when(out > 0, F.get(weights, count(out)) - F.get(weights, count(out) - 1)).otherwise(0)
            moved = F.struct(F.when(inn == out, now["weight"]).otherwise(now["weight"] + up - down).alias("weight"), *((now[name] + is_a(F.get(chars, i), name) - is_a(F.get(chars, i - WINDOW), name)).alias(name) for name in needs))

            def settle(m: Column) -> Column:
                hit, last = (i >= WINDOW - 1) & (m["weight"] <= limit), F.get(now["hits"], F.size(now["hits"]) - 1)
                for name in needs:
                    hit = hit & (m[name] > 0)
                begin, end = (i - (WINDOW - 1)).cast("int"), (i + 1).cast("int")
                joins = F.coalesce(last["stop"] >= begin, F.lit(False))
                grown = F.concat(F.slice(now["hits"], 1, F.size(now["hits"]) - joins.cast("int")), F.array(F.struct(F.when(joins, last["start"]).otherwise(begin).alias("start"), end.alias("stop"))))
                return F.struct(counts.alias("counts"), m["weight"].alias("weight"), *(m[name].alias(name) for name in needs), F.when(hit, grown).otherwise(now["hits"]).alias("hits"))

            return bound(moved, settle)

        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda now: now["hits"])

    return bound(F.split(run, ""), read)


def entropy_spans(text: Column, allowed: Sequence[str] = ()) -> Column:
    clean = F.filter(matches(text, CANDIDATE), lambda c: ~c["m"].rlike("|".join([*ALLOWED, *allowed])))

    def of_class(kind: str) -> Column:
        chars, bits, needs = CLASSES[kind]
        runs = lambda c: F.transform(matches(c["m"], f"[{chars}]{{{WINDOW},}}"), lambda r: F.transform(hot_windows(r["m"], bits, needs), lambda h: _span(KINDS.index(kind), c["start"] + r["start"] + h["start"], c["start"] + r["start"] + h["stop"])))
        return lambda found: F.flatten(F.transform(found, lambda c: F.flatten(runs(c))))

    return bound(clean, lambda found: F.concat(*(of_class(kind)(found) for kind in CLASSES)))


def scan(docs: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """doc_id, base and found (arrays of kind, start, stop; found holds base and what entropy adds).

    allowed: further patterns of candidates that are no secrets."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.array_sort(F.concat(*base_spans(F.col("text")).values())).alias("base"), F.when(F.col("text").rlike(CANDIDATE), entropy_spans(F.col("text"), allowed)).otherwise(F.array().cast(SPAN)).alias("added"))
    new = F.filter("added", lambda a: ~F.exists("base", lambda b: (b["start"] <= a["start"]) & (a["stop"] <= b["stop"])))
    named = lambda spans: F.transform(spans, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["no"] + 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return rows.select("doc_id", named(F.col("base")).alias("base"), named(F.array_sort(F.concat("base", new))).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    is_of = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("base", is_of(kind))).cast("long").alias(f"n_{kind}") for kind in LEAST]
    return scanned.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _placed(source: str, kind_no: int | str, pattern: str, keys: str) -> str:
    """SQL: matches of a pattern in source(<keys>, s), with their places in s."""
    p = pattern.replace("'", "''")
    return f"""SELECT {keys}, {kind_no} AS no, m, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY {keys} ORDER BY k) AS BIGINT) AS stop_ FROM (
      SELECT {keys}, unnest(regexp_extract_all(s, '{p}')) AS m, unnest(string_split_regex(s, '{p}')[1:len(regexp_extract_all(s, '{p}'))]) AS gap, unnest(range(len(regexp_extract_all(s, '{p}')))) AS k FROM {source})"""


def _oracle() -> str:
    allow, names = "|".join(ALLOWED), ", ".join(f"'{k}'" for k in KINDS)
    weights = ", ".join(map(str, WEIGHTS))
    need = {"digit": "[0-9]", "capital": "[A-Z]", "small": "[a-z]", "letter": "[A-Za-z]"}
    windows = " UNION ALL ".join(
        f"""SELECT r, no, base + w AS start_ FROM (SELECT r, no, base, w, m[w + 1:w + {WINDOW}] AS x FROM (SELECT r, no, base, m, unnest(range(length(m) - {WINDOW - 1})) AS w FROM runs WHERE no = {KINDS.index(kind)}))
        WHERE list_sum([([{weights}])[CAST(c AS BIGINT) + 1] FOR c IN map_values(list_histogram(string_split(x, '')))]) <= {most_weight(bits)} AND {" AND ".join(f"regexp_matches(x, '{need[n]}')" for n in needs)}"""
        for kind, (_, bits, needs) in CLASSES.items()
    )
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS s FROM documents),
base AS (
  SELECT r, no, stop_ - length(m) AS start_, stop_ FROM ({_placed("texts", 0, ASSIGN, "r")}) WHERE length(regexp_extract(m, '{ASSIGN.replace("'", "''")}', 2)) >= {LEAST["assign"]}
  UNION ALL SELECT r, no, stop_ - length(m), stop_ FROM ({_placed("texts", 1, ACCESS, "r")})
  UNION ALL SELECT r, no, stop_ - length(m), stop_ FROM ({_placed("texts", 2, HEX, "r")})),
candidates AS (SELECT r, stop_ - length(m) AS place, m AS s FROM ({_placed("texts", 0, CANDIDATE, "r")}) WHERE NOT regexp_matches(m, '{allow}')),
runs AS ({" UNION ALL ".join(f"SELECT r, no, place + stop_ - length(m) AS base, m FROM ({_placed('candidates', KINDS.index(kind), f'[{chars}]{{{WINDOW},}}', 'r, place')})" for kind, (chars, *_) in CLASSES.items())}),
windows AS ({windows}),
islands AS (
  SELECT r, no, start_, sum(new) OVER (PARTITION BY r, no ORDER BY start_) AS island
  FROM (SELECT *, CASE WHEN start_ <= lag(start_) OVER (PARTITION BY r, no ORDER BY start_) + {WINDOW} THEN 0 ELSE 1 END AS new FROM windows)),
added AS (
  SELECT r, no, start_, stop_ FROM (SELECT r, no, min(start_) AS start_, max(start_) + {WINDOW} AS stop_ FROM islands GROUP BY r, no, island) a
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = a.r AND b.start_ <= a.start_ AND a.stop_ <= b.stop_)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM added),
joined AS (
  SELECT r, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
    coalesce(string_agg([{names}][no + 1] || ':' || start_ || ':' || stop_, ',' ORDER BY start_, no, stop_) FILTER (no < {len(LEAST)}), '') AS base,
    string_agg([{names}][no + 1] || ':' || start_ || ':' || stop_, ',' ORDER BY start_, no, stop_) AS spans
  FROM every GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (r)"""


ORACLE = _oracle()
