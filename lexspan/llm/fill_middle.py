"""Operator 11: fill-in-middle transformation by an Arrow-batched pandas UDF.

A text is cut into units, each a word with the ASCII white space before it (white space at the end is a unit of its own);
the regex library finds them, and only their ends are kept, in a compact array. Two of the ends, chosen by the document's
seed, cut the text into prefix, middle and suffix. The seed is the SHA-256 of SEED, a colon and the decimal doc_id: its
first four groups of eight hex digits choose the two cuts, whether a text is transformed (RATE of 100) and whether the
suffix comes first (SPM of 100). A text that is empty or holds a mark itself stays plain, so the marks of an output are
always its own and the text is rebuilt from output and form alone.

Each row depends on itself only, so nothing is shuffled and a lost task is run again with the same result. Null texts
count as empty; a null doc_id counts as an empty decimal. Repeated rows give repeated rows, ties cannot arise, an empty
table gives an empty result, other columns are dropped.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread

SEED, RATE, SPM = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")

MADE = "n long, form string, prefix_chars long, middle_chars long, output string"
DIGESTS = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def unit_ends(text: str) -> array:
    """The end offsets (code points) of a text's units."""
    return array("q", (m.end() for m in UNIT.finditer(text)))


def seeds(doc_id: str, seed: int = SEED) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def rearrange(doc_id: str, text: str, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = seeds(doc_id, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in MARKS):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text, rebuilt from output and form. A mark shares no end with another, so the first of its kind is its own."""
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    if not output.startswith(one):
        raise ValueError(f"no {form} output: {output[:40]!r}")
    first, found, rest = output[len(one) :].partition(two)
    second, found_too, middle = rest.partition(MIDDLE)
    if not (found and found_too):
        raise ValueError(f"no {form} output: {output[:40]!r}")
    return second + middle + first if form == "spm" else first + middle + second


def _maker(seed: int, rate: int, spm: int):
    @F.pandas_udf(MADE)
    def make(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            out = pd.DataFrame([rearrange(i, t, seed, rate, spm) for i, t in zip(ids, texts)], columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return make


def _digester():
    @F.pandas_udf(DIGESTS)
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        for made in batches:
            out = made[["n", "form"]].copy()
            # Between chained functions a column with nulls may come as objects.
            for name in ("prefix_chars", "middle_chars"):
                out[name] = pd.array(made[name], dtype="Int64")
            out["output_sha256"] = [sha(t) for t in made["output"]]
            out["restored_sha256"] = [sha(restore(t, f)) for t, f in zip(made["output"], made["form"])]
            yield out

    return digest


def _made(seed: int, rate: int, spm: int) -> Column:
    # Ids as text: a column of numbers with nulls would reach pandas as floating point.
    return _maker(seed, rate, spm)(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))


def fill_in_middle(spark: SparkSession, docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: the texts to train on."""
    rows = spread(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", _made(seed, rate, spm).alias("made")).select("doc_id", "made.*")


def digests(spark: SparkSession, docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """What is read back from the outputs, in the same worker, so that they are not sent to and fro once more."""
    rows = spread(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", _digester()(_made(seed, rate, spm)).alias("made")).select("doc_id", "made.*")


_SPACE = r"[\x20\x09-\x0D]"
ORACLE = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, text, regexp_extract_all(text, '{_SPACE}*[^\\x20\\x09-\\x0D]+|{_SPACE}+') AS units,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM hashed),
chosen AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS low, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(list_slice(units, 1, low), '') AS prefix, array_to_string(list_slice(units, low + 1, high), '') AS middle, array_to_string(list_slice(units, high + 1, n), '') AS suffix FROM chosen)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""
