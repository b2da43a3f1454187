"""Operator 8: language identification with script ranges and a Viterbi pass over words.

A text is lower-cased and cut into words at white space, ASCII digits and punctuation. A word's script is the one of its
characters' code point ranges (the highest range wins); languages that hardly use the script are no candidates for it.
Each candidate scores the word by naive Bayes over byte trigrams, byte 4-grams (with the word's edges) and the word
itself. Viterbi over all words of the whole text, with one penalty for any switch, labels spans; the label that covers
most bytes is the text's language, its share of them the score.

The model is fitted on at most TRAIN_ROWS labelled texts, the first in the order of xxhash64(doc_id), of which those
longer than TRAIN_CHARS code points are left out; whole texts are used. Those bounds are parameters. Counts are hashed into tables of fixed size, so the model never grows.

A null text, or one without a letter, is `und` with score 0; so is every text if nothing is labelled. A text with
letters always gets a learned label. Repeated rows are repeated; a null doc_id is kept (it is not held out: it has no
checksum) but never trained on. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, slices, spread

TRAIN_ROWS, TRAIN_CHARS, TABLE_BITS, SWITCH, UNKNOWN = 4000, 100_000, 17, 6.0, "und"
#: A language is a candidate for a script that holds at least this share of its training bytes.
SCRIPT_SHARE = 0.01
#: Held out: crc32 of the id as text has this remainder modulo FOLDS.
FOLDS, HELD = 4, 2

_LETTER = re.compile(r"[^\W\d_]")
# Script by the lead byte of UTF-8, as code point ranges: Latin, Greek, Cyrillic, Armenian and Hebrew, Arabic and
# Syriac, Indic to Georgian and others (E0, E1), symbols, kana and CJK marks (E3), Han, Hangul, beyond the basic plane.
_RANGES = [(0x41, 0x7A, 1), (0xC3, 0xC9, 1), (0xCA, 0xCD, 1), (0xCE, 0xCF, 2), (0xD0, 0xD4, 3), (0xD5, 0xD7, 4), (0xD8, 0xDF, 5), (0xE0, 0xE0, 6), (0xE1, 0xE1, 7), (0xE3, 0xE3, 9), (0xE4, 0xE9, 10), (0xEA, 0xED, 11), (0xF0, 0xF4, 12)]
SCRIPTS = 13
_SCRIPT = np.zeros(256, np.int8)
for _a, _b, _s in _RANGES:
    _SCRIPT[_a : _b + 1] = _s
_SEP = np.array([not (97 <= b <= 122 or b >= 0x80) for b in range(256)])
_C = np.random.default_rng(5).integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % FOLDS == HELD, F.lit(False))


class Words:
    """Words and hashed features of some texts."""

    def __init__(self, texts: list[str | None], bits: int = TABLE_BITS, long_grams: bool = False):
        parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b"    " + b"    ".join(parts) + b"      ", np.uint8)
        sep = _SEP[raw]
        edge = np.flatnonzero(np.diff(sep.astype(np.int8), prepend=np.int8(1)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        stops = 4 + np.cumsum([len(p) + 4 for p in parts]) - 2 if parts else np.zeros(0, int)
        self.first = np.concatenate([[0], np.searchsorted(self.starts, stops)])
        clean = np.where(sep, np.uint8(0), raw).astype(np.uint64) + np.uint64(1)
        # One entry for each byte of a word and the separator in front of it.
        at = np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)]).astype(np.int64)
        self.at = at[:-1]
        where = np.arange(at[-1]) - np.repeat(self.at, self.ends - self.starts + 1) + np.repeat(self.starts - 1, self.ends - self.starts + 1)
        shift = np.uint64(64 - bits)
        tri = clean[where] * _C[0] + clean[where + 1] * _C[1] + clean[where + 2] * _C[2]
        self.tri = (tri * _C[7] >> shift).astype(np.int32)
        four = (tri + clean[where + 3] * _C[3]) * _C[6]
        self.four = (four >> shift).astype(np.int32)
        if long_grams:  # six bytes, cut at the separator behind the word
            end = np.repeat(self.ends, self.ends - self.starts + 1)
            six = four + clean[np.minimum(where + 4, end)] * _C[4] + clean[np.minimum(where + 5, end)] * _C[5]
            self.six = (mix64(six) >> shift).astype(np.int32)
        total = np.add.reduceat(mix64(four ^ (where - np.repeat(self.starts, self.ends - self.starts + 1) + 1).astype(np.uint64) * _C[5]), self.at) if len(self.at) else np.zeros(0, np.uint64)
        self.word = (mix64(total) >> shift).astype(np.int32)
        self.script = np.maximum.reduceat(np.where(sep, np.int8(0), _SCRIPT[raw]), np.minimum(np.stack([self.starts, self.ends], 1).ravel(), len(raw) - 1))[0::2] if len(self.starts) else np.zeros(0, np.int8)
        self.size = self.ends - self.starts


class Model:
    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        n, size = len(self.langs), 1 << TABLE_BITS
        if not n:
            return
        counts = np.zeros((3, size, n))
        scripts = np.zeros((n, SCRIPTS))
        for k, lang in enumerate(self.langs):
            own = [t for t, x in zip(texts, langs) if x == lang]
            for a, b in slices(own, 500_000):
                w = Words(own[a:b])
                for j, ids in enumerate((w.tri, w.four, w.word)):
                    counts[j, :, k] += np.bincount(ids, minlength=size)
                scripts[k] += np.bincount(w.script, weights=w.size, minlength=SCRIPTS)
        smooth = counts + 0.5
        log = np.log(smooth / smooth.sum(axis=1, keepdims=True))
        self.tables = (log - log.mean(axis=2, keepdims=True)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        allowed = share.T >= SCRIPT_SHARE
        allowed[0] = True
        allowed[~allowed.any(axis=1)] = True
        self.barred = np.where(allowed, 0, -50).astype(np.float32)

    def emissions(self, w: Words) -> np.ndarray:
        """Score of each word by language; the three features are not independent, so their mean size is damped."""
        tri, four, word = self.tables
        out = np.add.reduceat(tri[w.tri] + four[w.four], w.at, axis=0) / 2 + word[w.word]
        return np.clip(out, -20, 20) + self.barred[w.script]

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self.langs:
            return out
        w = Words(texts)
        path = viterbi(self.emissions(w), w.first) if len(w.starts) else np.zeros(0, int)
        for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
            if a < b and _LETTER.search(texts[i]):
                mass = np.bincount(path[a:b], weights=w.size[a:b], minlength=len(self.langs))
                best = int(mass.argmax())
                out[i] = (self.langs[best], float(mass[best] / mass.sum()))
            elif a == b and texts[i] and _LETTER.search(texts[i]):
                out[i] = (self.langs[0], 0.0)
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Byte spans (first, behind the last) of the lower-cased text and their languages."""
        w = Words([text])
        path = viterbi(self.emissions(w), w.first) if len(w.starts) else []
        out: list[tuple[int, int, str]] = []
        for a, b, k in zip(w.starts - 4, w.ends - 4, path):
            if out and out[-1][2] == self.langs[k]:
                out[-1] = (out[-1][0], int(b), self.langs[k])
            else:
                out.append((int(a), int(b), self.langs[k]))
        return out


def viterbi(emit: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; sequence i is emit[first[i]:first[i + 1]]. All sequences advance together."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    begin, size = first[order], sizes[order]
    path = np.zeros(len(emit), np.int8)
    if not len(order):
        return path
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")  # sequences longer than t
    # In the order of steps, so that each step reads and writes a slice.
    edge = np.concatenate([[0], np.cumsum(active)])
    at = begin[np.arange(edge[-1]) - np.repeat(edge[:-1], active)] + np.repeat(np.arange(steps), active)
    emit = emit[at]
    moved = np.zeros(emit.shape, bool)
    source = np.zeros(len(emit), np.int8)
    edges = edge.tolist()
    score = emit[: edges[1]].copy()
    for a, b in zip(edges[1:-1], edges[2:]):
        now = score[: b - a]
        source[a:b] = now.argmax(axis=1)
        jump = now.max(axis=1, keepdims=True) - switch
        np.less(now, jump, out=moved[a:b])
        np.maximum(now, jump, out=now)
        now += emit[a:b]
    state = score.argmax(axis=1)
    came = np.where(moved, source[:, None], np.arange(emit.shape[1], dtype=np.int8))
    rank, found = np.arange(len(order)), np.zeros(len(emit), np.int8)
    for a, b in zip(edges[-2::-1], edges[:0:-1]):
        now = state[: b - a]
        found[a:b] = now
        state[: b - a] = came[a:b][rank[: b - a], now]
    path[at] = found
    return path


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """From the labelled rows outside the held-out fold, at most `rows` of them: ids first, then their texts."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    edge = labelled.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if edge is None:
        return Model([], [])
    sample = labelled.where(F.xxhash64("doc_id") <= edge).where(F.length("text") <= TRAIN_CHARS).orderBy(F.xxhash64("doc_id"), "text").select("text", "lang").limit(rows).toPandas()
    return Model(list(sample["text"]), list(sample["lang"]))


def identify(spark: SparkSession, docs: DataFrame, model: Model | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the columns named in carry as they are."""
    model = fit(docs.select("doc_id", "text", "lang")) if model is None else model

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts, 400_000):
                found = model.label(texts[a:b])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in keep), pa.array([x for x, _ in found]), pa.array([s for _, s in found])], names=[*keep, "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"), *(c for c in carry if c != "text"))
    keep = ["doc_id", "held_out", *carry]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return spread(spark, rows).mapInArrow(predict, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", lang_pred string, score double")
