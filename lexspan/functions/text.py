"""Column functions and patterns shared by the stages. Offsets are code points, 0-based, end-exclusive."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces of a text: runs of white space, words with inner apostrophes or hyphens, numbers with inner marks, runs of
#: terminal punctuation, single symbols. Together they cover every text. Both Java's and RE2's syntax.
PIECES = r"\s+|[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*|[0-9]+(?:[.,:/][0-9]+)*|[.!?]+|[^\s\p{L}\p{M}0-9]"
#: A blank line: what separates paragraphs.
BLANK_LINE = r"(?:\r\n|\n)[ \t]*(?:\r\n|\n)(?:[ \t]*(?:\r\n|\n))*"
#: Words of the structural validator: letters and digits with inner hyphens or apostrophes.
STORY_WORD = r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*"

def _folded(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c.casefold()) if unicodedata.category(x) != "Mn")


#: Letters of the basic plane whose case folding without marks is another single letter, and those where it is several
#: letters: made from the Unicode data, surrogates left out. Decomposed marks are dropped before.
_FOLDS = {c: _folded(c) for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if unicodedata.category(c)[0] in "LNS"}
SINGLE = {c: f for c, f in _FOLDS.items() if f != c and len(f) == 1}
SEVERAL = {c: f for c, f in _FOLDS.items() if len(f) > 1 and not 0xAC00 <= ord(c) <= 0xD7A3}


def _class(chars: dict[str, str], gap: int = 64) -> str:
    """A class of few ranges that holds these characters, and others between them: Java asks a class' parts one by one for
    each character of a text."""
    spans: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if spans and c - spans[-1][1] <= gap:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]"


#: The letters of SEVERAL below 256 (ß), and what may hold one of the others.
_COMMON = {c: f for c, f in SEVERAL.items() if ord(c) < 256}
_RARE = _class({c: f for c, f in SEVERAL.items() if c not in _COMMON})

# Function words that are not index terms.
FUNCTION_WORDS = (
    "a ao aos as ate com da das de do dos e em entre essa esse esta este eu ela ele elas eles isso isto ja lhe lhes "
    "mais me meu meus minha minhas muito na nas no nos num numa o os ou para pela pelas pelo pelos por qual quando que "
    "quem se ser seu seus sobre sua suas tambem ter um uma umas uns"
).split()


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def plain(text: Column) -> Column:
    """Case folding without marks: decomposed, marks dropped. Hangul syllables stay composed."""
    unfold = lambda t, some: reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(SEVERAL[c])), some, t)
    bare = unfold(F.regexp_replace(text, r"\p{Mn}", ""), _COMMON)
    rare = F.when(bare.rlike(_RARE), unfold(bare, [c for c in SEVERAL if c not in _COMMON])).otherwise(bare)
    return F.lower(F.translate(rare, "".join(SINGLE), "".join(SINGLE.values())))


def terms(text: Column) -> Column:
    """Index terms in order: runs of plain letters (and numerals other than digits), longer than one, without function words."""
    found = F.regexp_extract_all(plain(text), F.lit(r"([\p{L}\p{Nl}\p{No}]+)"), F.lit(1))
    # isin looks up a set; array_contains would compare each term with every function word.
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(FUNCTION_WORDS))


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + F.lit(1), end - start)


#: Spans cut out of one chunk of a text, so that no cut walks the whole text.
TOGETHER = 64


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row: an expression that a lambda names is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def record(**fields: Column) -> Column:
    """A struct whose names hold in nested lambdas too, where aliases are lost."""
    return F.named_struct(*(x for name, value in fields.items() for x in (F.lit(name), value)))


def running(sizes: Column) -> Column:
    """Running sums of an array of whole numbers, in groups of TOGETHER, so that no sum copies all that stand before it."""
    step = lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))))
    sums = lambda some: F.aggregate(some, F.array().cast("array<int>"), step)
    groups = lambda s: F.transform(F.sequence(F.lit(1), F.size(s), F.lit(TOGETHER)), lambda g: sums(F.slice(s, g, TOGETHER)))
    onto = lambda gs, before: F.flatten(F.transform(gs, lambda x, k: bound(F.coalesce(F.get(before, k - 1), F.lit(0)), lambda b: F.transform(x, lambda y: y + b))))
    every = lambda s: bound(groups(s), lambda gs: bound(sums(F.transform(gs, lambda x: F.element_at(x, -1))), lambda before: onto(gs, before)))
    return bound(sizes, lambda s: F.when(F.size(s) > 0, every(s)).otherwise(F.array().cast("array<int>")))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns computed once a row: the generator keeps what is built on them from computing them anew."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def cut_all(text: Column, spans: Column) -> Column:
    """The texts under spans (start_pos, end_pos), which ascend by start; each chunk of TOGETHER spans is cut once."""

    def cut_group(some: Column) -> Column:
        begin = F.element_at(some, 1)["start_pos"]
        chunk = F.struct(cut(text, begin.cast("int"), F.array_max(some["end_pos"]).cast("int")).alias("t"), begin.alias("at"))
        return bound(chunk, lambda c: F.transform(some, lambda x: cut(c["t"], (x["start_pos"] - c["at"]).cast("int"), (x["end_pos"] - c["at"]).cast("int"))))

    groups = lambda s: F.transform(F.sequence(F.lit(1), F.size(s), F.lit(TOGETHER)), lambda g: bound(F.slice(s, g, TOGETHER), cut_group))
    return bound(spans, lambda s: F.when(F.size(s) > 0, F.flatten(groups(s))).otherwise(F.array().cast("array<string>")))


def canonical(struct: Column) -> Column:
    """Canonical JSON of a struct whose fields are declared in alphabetical order at every level."""
    return F.to_json(struct, {"ignoreNullFields": "false"})
