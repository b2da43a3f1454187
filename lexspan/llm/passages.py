"""Operator 4: repeated passages by paragraph MinHash banding.

A paragraph is a line of a text that holds at least WORDS words between ASCII white space; shorter lines (headings,
signatures, licence lines) are left alone. Paragraphs are lower-cased (A-Z) and compared as sets of five-word shingles.
Bands of two minima are tuned for recall: at the threshold of 0.8 a linked pair shares no band with probability
(1 - 0.8^2)^10, under 4e-5. Equal paragraphs are one class, named by a 128-bit digest; colliding classes are confirmed by
exact Jaccard similarity (see near_dedup for how a large bucket is treated without meeting pairwise). Of each component
the first occurrence, by doc_id and place, stays; the others are removed.

Lines do not bound every passage, so a second pass reads what the first leaves, whole texts without the lines that go. Its
words are cut at content-defined places: of every 26 neighbouring segments of 25 words the one with the least hash is an
anchor, so any two equal runs of RUN words share an anchor inside them. Around the anchors that occur twice all runs of
RUN words are compared, and neighbours of them grow together to whole common runs: exactly the words of the runs of RUN
words that occur more than once are found, wherever they lie in a line and over however many lines. Code points of
scripts without spaces are words of their own. The rows of a run hold its first line, start and length and where its
first RUN words occur first; of the occurrences of any RUN words, too, the first stays.

Null and empty texts have no paragraphs. Rows with a null doc_id come last, so another occurrence is kept before theirs;
the second pass leaves them out, as nothing can be cut from them.
Repeated rows repeat their paragraphs: occurrences are told apart by doc_id, place and text, so equal rows stay or go
together. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, _powers, mix64, shingle_hashes, slices, small, split_words, spread
from .near_dedup import SHINGLE, Rule, link_classes

WORDS = 25
RULE = Rule(percent=80, bands=10, rows=2)
#: Words of the shortest run found inside or across lines.
RUN = 50
#: Scripts without spaces: Thai to Myanmar, Khmer, kana to Hangul's neighbours (Hangul has spaces), ideographs.
_OWN = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _paragraphs(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Lines of some texts that hold at least WORDS words: text, place (line number), first code point, length, first
    word and end among the words; and the words' hashes."""
    words, first, starts, _, raw = split_words(texts)
    feeds = np.flatnonzero(raw == 10)
    ends_at = feeds[np.searchsorted(feeds, np.cumsum([len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts]) - 1)] if texts else feeds
    line = np.searchsorted(feeds, starts)
    edge = np.flatnonzero(np.diff(line, prepend=-1))
    size = np.diff(edge, append=len(line))
    long = size >= WORDS
    a, n = edge[long], size[long]
    number = line[a]
    text = np.searchsorted(ends_at, feeds[number])
    points = np.cumsum((raw & 0xC0) != 0x80)  # code points up to a byte, it included
    begin_line = np.where(number > 0, feeds[number - 1] + 1, 0)
    last = np.concatenate([[-1], ends_at])  # the byte in front of each text
    before = np.concatenate([[0], points])
    first_line = np.searchsorted(feeds, last[text] + 1)
    start = before[begin_line] - before[last[text] + 1]
    return text, number - first_line, start, before[feeds[number]] - before[begin_line], a, a + n, words


def _shingles_of(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the word ranges from a to b (of SHINGLE words at least), one behind another, and where each
    range's shingles begin."""
    every = shingle_hashes(words, SHINGLE)
    n = b - a - SHINGLE + 1
    at = np.cumsum(n) - n
    return every[np.arange(n.sum()) + np.repeat(a - at, n)], at


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, ids = list(batch["text"]), batch["doc_id"].astype("Int64")
        for i, j in slices(texts, 250_000):
            text, place, start, length, a, b, words = _paragraphs(texts[i:j])
            if len(text):
                hashes, at = _shingles_of(words, a, b)
                digests = [xxhash.xxh3_128_digest(words[x:y].tobytes()) for x, y in zip(a, b)]
                yield pd.DataFrame({"doc_id": ids[i:j].array[text], "text_key": batch["text_key"].to_numpy()[i:j][text], "place": place, "start": start, "length": length, "class": digests, "bands": list(RULE.bands_of(hashes, at))})


def _wanted_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, wanted = list(batch["text"]), list(batch["places"])
        for i, j in slices(texts, 250_000):
            text, place, _, _, a, b, words = _paragraphs(texts[i:j])
            pairs = {(k, p) for k, places in enumerate(wanted[i:j]) for p in places}
            take = [k for k, pair in enumerate(zip(text.tolist(), place.tolist())) if pair in pairs]
            every = shingle_hashes(words, SHINGLE)
            rows = [(xxhash.xxh3_128_digest(words[x:y].tobytes()), np.unique(every[x : y - SHINGLE + 1]).tobytes()) for x, y in zip(a[take], b[take])]
            yield pd.DataFrame(rows, columns=["class", "hashes"])


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and end code points and lines of the lower-cased (A-Z) words of a text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c >= 65) & (c <= 90), c + np.uint32(32), c)
    space = (c == 32) | ((c >= 9) & (c <= 13))
    edge = np.ones(len(c) + 1, bool)
    edge[1:-1] = space[1:] != space[:-1]
    if len(c) and c.max() >= _OWN[0][0]:
        own = np.zeros(len(c), bool)
        for a, b in _OWN:
            own |= (c >= a) & (c <= b)
        edge[1:-1] |= own[1:] | own[:-1]
    at = np.flatnonzero(edge)
    if len(at) < 2:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    word = ~space[at[:-1]]
    a, b = at[:-1][word], at[1:][word]
    up, down = _powers(len(c) + 1)
    total = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(mix64(c.astype(np.uint64) + np.uint64(1)) * up[: len(c)], out=total[1:])
    return mix64((total[b] - total[a]) * down[a]), a, b, np.searchsorted(np.flatnonzero(c == 10), a)


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of so many words, by their first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix64((total[size:] - total[:n]) * down[:n])


def _left(text: str, gone) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, lines, hashes, first and end code points) of the stretches of a text between the lines that go."""
    words, a, b, line = _words(text)
    stay = np.ones(len(a), bool) if gone is None else ~np.isin(line, np.asarray(gone))
    edge = np.flatnonzero(np.diff(stay.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    for i, j in zip(edge[0::2], edge[1::2]):
        if j - i >= RUN:
            yield int(i), line[i:j], words[i:j], a[i:j], b[i:j]


def _near(x: np.ndarray, f, span: int) -> np.ndarray:
    """f (minimum or maximum) of every `span` neighbours, by windows of twice the length each time."""
    size = 1
    while 2 * size <= span:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (span - size)], x[span - size :]) if span > size else x


def _anchors(words: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Which words begin an anchor: the least segment of WORDS words of every RUN - WORDS + 1 in one stretch (all, if
    equal). Stretches are numbered in ascending order; negative ones are left out."""
    begins = np.zeros(len(words), bool)
    if len(words) < RUN:
        return begins
    span = RUN - WORDS + 1
    h = _runs(words, WORDS)
    low = _near(h, np.minimum, span)
    # A window that is no stretch's own counts as 0, so no segment is equal to its least hash.
    low = np.where((stretch[RUN - 1 :] == stretch[: len(low)]) & (stretch[: len(low)] >= 0), low, np.uint64(0))
    none = np.zeros(span - 1, np.uint64)
    begins[: len(h)] = (_near(np.concatenate([none, low, none]), np.maximum, span) == h) & (h > 0)
    return begins


def _frame(parts: list[tuple], columns: list[str]) -> pd.DataFrame:
    """One frame from (doc_id, text_key, array, ...) of many stretches."""
    sizes = [len(p[2]) for p in parts]
    ids = [np.repeat(np.array([p[k] for p in parts], np.int64), sizes) for k in (0, 1)]
    rest = [np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(2, len(columns))]
    return pd.DataFrame(dict(zip(columns, ids + rest)))


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each text: its anchors' places and hashes."""
    for batch in batches:
        texts, gone = list(batch["text"]), list(batch["gone"])
        for i, j in slices(texts, 200_000):
            words, at, _, line = _words("\n".join(texts[i:j]))
            size = np.array([len(t) + 1 for t in texts[i:j]])
            begin = np.cumsum(size) - size
            first = np.searchsorted(at, np.append(begin, begin[-1] + size[-1]))
            stretch = np.repeat(np.arange(j - i), np.diff(first))
            feeds = np.cumsum([0, *(t.count("\n") + 1 for t in texts[i:j])])
            for k in range(j - i):
                if gone[i + k] is not None:
                    own = slice(first[k], first[k + 1])
                    out = np.isin(line[own] - feeds[k], np.asarray(gone[i + k]))
                    stretch[own] = np.where(out, -1, np.cumsum(np.diff(out.astype(np.int8), prepend=np.int8(0)) != 0) * (j - i) + k)
            begins = np.flatnonzero(_anchors(words, stretch))
            h = _runs(words, WORDS)[begins].view(np.int64) if len(begins) else np.zeros(0, np.int64)
            edge = np.searchsorted(begins, first)
            rows = [(doc_id, key, begins[a:b] - f, h[a:b]) for doc_id, key, f, a, b in zip(batch["doc_id"][i:j], batch["text_key"][i:j], first, edge, edge[1:]) if b > a]
            yield pd.DataFrame(rows, columns=["doc_id", "text_key", "at", "hash"])


def _window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All runs of RUN words around the repeated anchors."""
    columns = ["doc_id", "text_key", "at", "hash", "place", "start", "stop"]
    for batch in batches:
        parts = []
        for doc_id, text, gone, key, ranges in zip(batch["doc_id"], batch["text"], batch["gone"], batch["text_key"], batch["ranges"]):
            low, high = (np.array([r[k] for r in ranges]) for k in ("low", "high"))
            for first, line, words, a, b in _left(text, gone):
                h = _runs(words, RUN)
                near = np.zeros(len(h) + 1, np.int64)
                np.add.at(near, np.clip(low - first - (RUN - WORDS), 0, len(h)), 1)
                np.add.at(near, np.clip(high - first + 1, 0, len(h)), -1)
                i = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                if len(i):
                    parts.append((doc_id, key, i + first, h[i].view(np.int64), line[i], a[i], b[i + RUN - 1]))
            if sum(len(p[2]) for p in parts) > 50_000:
                yield _frame(parts, columns)
                parts = []
        if parts:
            yield _frame(parts, columns)


def _common_runs(stage: Stage, docs: DataFrame, found: DataFrame) -> DataFrame:
    """Runs of at least RUN words that occur more than once in what is left of the texts without the found lines."""
    gone = stage.put(found.where("not kept and doc_id is not null").groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("gone")))
    left = docs.where("doc_id is not null and text is not null").join(small(gone, 4 * gone.count()), ["doc_id", "text_key"], "left")
    anchors = stage.put(spread(stage.spark, left).mapInPandas(_anchor_rows, "doc_id long, text_key long, at array<long>, hash array<long>"))
    anchors = anchors.select("doc_id", "text_key", F.posexplode(F.arrays_zip("at", "hash")).alias("n", "a")).select("doc_id", "text_key", "n", "a.at", "a.hash")
    spot = F.xxhash64("doc_id", "text_key", "at")  # repeated rows are one occurrence
    twice = stage.put(anchors.groupBy("hash").agg(F.min(spot).alias("x"), F.max(spot).alias("y")).where("x <> y").select("hash"))
    again = anchors.join(small(twice, twice.count()), "hash", "left_semi")
    # Ranges of repeated anchors without another between them: every run of RUN words there holds one of them.
    island = F.col("n") - F.dense_rank().over(Window.partitionBy("doc_id", "text_key").orderBy("n"))
    ranges = again.withColumn("island", island).groupBy("doc_id", "text_key", "island").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    by_doc = stage.put(ranges.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("low", "high")).alias("ranges")))
    n = by_doc.select(F.coalesce(F.sum(F.size("ranges")), F.lit(0))).first()[0]
    rows = left.join(small(by_doc, 2 * n), ["doc_id", "text_key"]).mapInPandas(_window_rows, "doc_id long, text_key long, at long, hash long, place long, start long, stop long")
    rows = stage.put(rows)
    low = F.min(F.struct("doc_id", "text_key", "at", "place")).alias("low")
    tops = stage.put(rows.groupBy("hash").agg(low, F.min(spot).alias("x"), F.max(spot).alias("y")).where("x <> y").select("hash", "low"))
    rows = rows.join(tops.hint("merge"), "hash")
    # Neighbouring windows are one run; first occurrences are runs of their own.
    kept = (F.col("doc_id") == F.col("low.doc_id")) & (F.col("text_key") == F.col("low.text_key")) & (F.col("at") == F.col("low.at"))
    rows = rows.select("doc_id", "text_key", "at", "place", "start", "stop", "low", kept.alias("kept"))
    island = F.col("at") - F.dense_rank().over(Window.partitionBy("doc_id", "text_key", "kept").orderBy("at"))
    runs = rows.withColumn("island", island).groupBy("doc_id", "text_key", "kept", "island")
    runs = runs.agg(F.min("place").alias("place"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min(F.struct("at", "low")).alias("first"))
    return runs.select("doc_id", "text_key", "place", "start", (F.col("stop") - F.col("start")).alias("length"), F.col("first.low.doc_id").alias("component_id"), F.col("first.low.place").alias("component_place"), "kept")


def repeated_passages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Passages that occur more than once, whole lines and runs of words: doc_id, text_key (hash of the text, which tells
    rows of one doc_id apart), place (line, of a run its first), start, length, component_id (doc_id of the first
    occurrence), component_place, kept."""
    stage = Stage(spark, "passages")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    lines = stage.put(_repeated_lines(stage, docs))
    return stage.result(lines.unionByName(_common_runs(stage, docs, lines)))


def text_key(text: Column) -> Column:
    """Tells the texts of a repeated doc_id apart."""
    return F.xxhash64(text)


def _repeated_lines(stage: Stage, docs: DataFrame) -> DataFrame:
    """Paragraphs that occur more than once."""
    made = stage.put(spread(stage.spark, docs).mapInPandas(_features, "doc_id long, text_key long, place long, start long, length long, class binary, bands array<long>"))
    named = made.where("doc_id is not null")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Only one text that holds a wanted paragraph is read again."""
        first = named.join(small(nodes, nodes.count()), "class", "left_semi").groupBy("class").agg(F.min(F.struct("doc_id", "text_key", "place")).alias("p"))
        by_doc = stage.put(first.groupBy("p.doc_id", "p.text_key").agg(F.collect_set("p.place").alias("places")))
        n = by_doc.select(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
        return docs.join(small(by_doc, n), ["doc_id", "text_key"]).mapInPandas(_wanted_sets, "class binary, hashes binary")

    nodes, labels = link_classes(stage, named.select("class", "bands"), RULE, sets_of)
    linked = stage.put(nodes.join(labels.withColumnRenamed("node", "id"), "id").select("class", F.col("component").alias("linked")))
    rows = made.select("doc_id", "text_key", "place", "start", "length", "class").join(small(linked, 2 * linked.count()), "class", "left")
    # A group is a component of linked classes, or one class of copies.
    rows = rows.withColumn("group", F.when(F.col("linked").isNull(), F.col("class")).otherwise(F.encode(F.col("linked").cast("string"), "utf-8"))).drop("class", "linked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "place")).alias("top")
    tops = stage.put(rows.groupBy("group").agg(first, F.count("*").alias("n")).where("n > 1").select("group", "top"))
    out = rows.join(small(tops, 3 * tops.count()), "group")
    kept = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("text_key") == F.col("top.text_key")) & (F.col("place") == F.col("top.place"))
    return out.select("doc_id", "text_key", "place", "start", "length", F.col("top.doc_id").alias("component_id"), F.col("top.place").alias("component_place"), kept.alias("kept"))


def _cut(text: Column, gone: Column) -> Column:
    """text without the spans (start, length) of code points; whole lines go with their line feed."""
    sub = lambda a, n: F.substr(text, (a + 1).cast("int"), n.cast("int"))
    size, feed = F.length(text).cast("long"), F.lit("\n")
    start = F.struct(F.lit("").alias("left"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("last"))

    def step(state: Column, span: Column) -> Column:
        a, b = F.greatest(span["start"], state["at"]), F.greatest(span["start"] + span["length"], state["at"])
        whole = (span["start"] == 0) | (sub(span["start"] - 1, F.lit(1)) == feed)
        b = F.when(whole & (sub(b, F.lit(1)) == feed), b + 1).otherwise(b)
        return F.struct(F.concat(state["left"], sub(state["at"], a - state["at"])).alias("left"), b.alias("at"), (state["last"] | (whole & (b == size))).alias("last"))

    def end(state: Column) -> Column:
        left = F.concat(state["left"], sub(state["at"], size))
        return F.when(state["last"], F.regexp_replace(left, "\n\\z", "")).otherwise(left)

    return F.aggregate(F.array_sort(gone), start, step, end)


def without_passages(docs: DataFrame, found: DataFrame, rows: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with the passages that are not kept cut out; texts left blank go. Other columns stay as they are. rows: number
    of documents that lose a passage, if counted. Without a text_key in found, what it names goes from every text of an id."""
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"))
    keys = [F.col("doc_id").alias("_key"), *([F.col("text_key").alias("_text_key")] if "text_key" in found.columns else [])]
    gone = found.where("not kept").where(F.col("doc_id").isNotNull()).groupBy(*keys).agg(F.collect_set(span).alias("_gone"))
    if rows is not None:
        gone = small(gone, 4 * rows)
    same = F.col(key) == F.col("_key")
    if len(keys) > 1:
        same &= text_key(F.col(text)) == F.col("_text_key")
    rows = docs.join(gone, same, "left").drop("_text_key")
    rows = rows.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(_cut(F.col(text), F.col("_gone"))))
    blank = F.col("_gone").isNotNull() & (F.trim(F.translate(F.col(text), "\n\t\r", "   ")) == "")
    return rows.where(~blank).drop("_key", "_gone")
