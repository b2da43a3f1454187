"""Hybrid retrieval: BM25 and dense scores, block ranks, reciprocal-rank fusion, and literal checks of citations."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut, sha256, terms
from ..sources.package import PackageError, strict_json
from ..sources.stage import materialized
from .vectors import CORPUS_UNIT, OVERHEAD, norm, split_by

# Parameters of the scores and the fusion, limits of a report and of a request.
K1, B, RRF, TOP, FINAL = 1.2, 0.75, 60, 50, 12
MOST_WORDS, PARAGRAPHS, MOST_LINKS, REQUEST_BYTES = 400, 2, 24, 256 * 1024
ANSWER_BYTES = 1 << 20
SITUATIONS = ["pertinent", "partial", "discarded"]
BREAK = r"(?:\r\n|\n|\r)"
#: Passages: up to terminal punctuation or a line's end.
PASSAGE = r"[^.!?\n]+[.!?]*"


#: A fenced answer: the whole of it between two fence lines.
FENCE = re.compile(r"```(?:json)?[ \t]*(?:\r\n|\n|\r)(.*?)(?:\r\n|\n|\r)```", re.DOTALL | re.IGNORECASE)


def _indexed(fragments: DataFrame) -> DataFrame:
    """(frag, size, terms) of a fragment's header, if it has one, and text."""
    text = F.concat_ws("\n", "header", "text") if "header" in fragments.columns else F.col("text")
    return fragments.select("frag", terms(text).alias("terms")).select("frag", F.greatest(F.size("terms"), F.lit(0)).alias("size"), "terms")


def postings(fragments: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """fragments: frag, text, and header if there is one. (term, frag, tf, size), of the wanted terms (term) only if they
    are given; counted on the map side, so a frequent term costs a row a fragment."""
    rows = _indexed(fragments).select("frag", "size", F.explode("terms").alias("term"))
    if wanted is not None:
        rows = rows.join(wanted, "term", "left_semi")
    return rows.groupBy("frag", "size", "term").agg(F.count("*").alias("tf"))


def statistics(fragments: DataFrame) -> DataFrame:
    """One row: n fragments, mean size (empty fragments count; 1 if all are empty)."""
    return _means(_indexed(fragments).agg(F.count("*").alias("n"), F.sum("size").alias("total")))


def _means(sums: DataFrame) -> DataFrame:
    return sums.select("n", F.when(F.coalesce("total", F.lit(0)) == 0, 1.0).otherwise(F.col("total") / F.col("n")).alias("mean"))


#: Up to so many rows of terms or queries are broadcast.
FEW = 100_000


#: Pairs of a query and a fragment that one task sums up.
PAIRS = 2_000_000


def bm25(queries: DataFrame, fragments: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """queries: query, text. (query, frag, score) of fragments that share a term; a query's terms count once. Without an
    index only the postings of the queries' terms are counted, in one pass over the texts, and written once, with a row
    without term for each fragment, which holds its size. Postings are dealt by fragment, so that its scores meet in one
    task, and into so many parts that a task's pairs stay bounded."""
    asked = materialized(queries.select("query", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")))
    words = asked.select("term").distinct().withColumn("asked", F.lit(True))
    if index is None:
        rows = _indexed(fragments).select("frag", "size", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("terms", F.array().cast("array<string>")))).alias("term"))
        rows = rows.join(F.broadcast(words) if words.count() <= FEW else words, "term", "left").where("term is null or asked")
        index = materialized(rows.groupBy("frag", "size", "term").agg(F.count("*").alias("tf")))
        stats = _means(index.where("term is null").agg(F.count("*").alias("n"), F.sum("size").alias("total")))
        index = index.where("term is not null")
    else:
        stats = statistics(fragments)
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    weighed = asked.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    weighed = weighed.select("query", "term", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    parts = max(index.sparkSession.sparkContext.defaultParallelism, -(-stats.first()["n"] * queries.count() // PAIRS))
    rows = index.repartition(parts, "frag").join(F.broadcast(weighed) if asked.count() <= FEW else weighed, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return rows.groupBy("query", "frag").agg(F.round(F.sum(part), 9).alias("score"))


def dense(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """queries: query, q; vectors: frag, v. Every fragment against a set of at most FEW queries, which is counted and
    broadcast. `best` behind it keeps the best of each partition before anything is shuffled."""
    if queries.limit(FEW + 1).count() > FEW:
        raise ValueError(f"score queries in sets of at most {FEW}")
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return vectors.crossJoin(F.broadcast(queries)).select("query", "frag", F.round(dot, 9).alias("score"))


def best(scores: DataFrame, positive: bool, top: int = TOP) -> DataFrame:
    """(query, frag, score, rank) of the best fragments; ties go to the lower fragment."""
    rows = scores.where("score > 0") if positive else scores
    order = Window.partitionBy("query").orderBy(F.desc("score"), "frag")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


#: Queries and vectors of one cell of dense_best, and queries scored together in it.
CELL_QUERIES, CELL_VECTORS, SCORED = 4096, 65_536, 128


def _cell(asked: pa.Table, held: pa.Table, top: int) -> pa.Table:
    """The best of a cell's vectors for each of its queries; a vector that is missing or of another length scores null."""

    def matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
        rows = column.to_pylist()
        sound = np.array([v is not None and len(v) == width and None not in v for v in rows], bool)
        return np.array([v if ok else [0.0] * width for v, ok in zip(rows, sound)], np.float64).reshape(len(rows), width), sound

    width = max((len(v) for v in asked["q"].to_pylist() if v is not None), default=0)
    (q, q_sound), (v, v_sound) = matrix(asked["q"], width), matrix(held["v"], width)
    ids, frags = asked["query"].to_numpy(), held["frag"].to_numpy()
    out = ([], [], [])
    for at in range(0, len(ids) if len(frags) else 0, SCORED):
        scores = np.round(q[at : at + SCORED] @ v.T, 9)
        scores[:, ~v_sound] = -np.inf
        scores[~q_sound[at : at + SCORED]] = -np.inf
        for i, row in enumerate(scores):
            # All that tie with the last one stay, so that the lower fragment wins.
            some = np.flatnonzero(row >= np.partition(row, len(row) - top)[len(row) - top]) if len(row) > top else np.arange(len(row))
            some = some[np.lexsort((frags[some], -row[some]))][:top]
            for column, values in zip(out, (np.full(len(some), ids[at + i]), frags[some], row[some])):
                column.append(values)
    query, frag, score = (np.concatenate(x) if x else np.empty(0) for x in out)
    return pa.table({"query": pa.array(query, pa.int64()), "frag": pa.array(frag, pa.int64()), "score": pa.array(score, pa.float64(), mask=np.isneginf(score))})


def dense_best(queries: DataFrame, vectors: DataFrame, top: int = TOP) -> DataFrame:
    """queries: query, q; vectors: frag, v (ids are whole numbers). (query, frag, score, rank) of the best fragments by
    every score, as best(dense(...)) gives them: queries and vectors are dealt by hash into a grid of cells of bounded size,
    in each of which the scores are a product of matrices, and a cell gives back a query's best only. What is shuffled are
    the vectors once for each CELL_QUERIES queries, and a query's best once for each CELL_VECTORS vectors."""
    asked, held = -(-queries.count() // CELL_QUERIES) or 1, -(-vectors.count() // CELL_VECTORS) or 1
    # Few cells would leave cores idle: smaller ones cost little while the rows that they repeat are few.
    asked = max(asked, min(-(-queries.sparkSession.sparkContext.defaultParallelism // held), 16))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col("query").cast("long").alias("query"), "q", place("query", asked).alias("a"), every(held).alias("b"))
    right = vectors.select(F.col("frag").cast("long").alias("frag"), "v", place("frag", held).alias("b"), every(asked).alias("a"))
    cell = lambda x, y: _cell(x, y, top)
    # A number of its own, so that small cells are not put together into one task.
    dealt = lambda rows: rows.repartition(2 * asked * held, "a", "b").groupBy("a", "b")
    return best(dealt(left).cogroup(dealt(right)).applyInArrow(cell, "query long, frag long, score double"), False, top)


def block_ranks(ranked: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """blocks: frag, block (none if `ranked` names its blocks). Blocks in order of their first fragment: (query, block,
    first_rank, block_rank)."""
    rows = ranked if blocks is None else ranked.join(blocks, "frag")
    first = rows.groupBy("query", "block").agg(F.min("rank").alias("first_rank"))
    return first.withColumn("block_rank", F.row_number().over(Window.partitionBy("query").orderBy("first_rank")))


def fused(*methods: DataFrame) -> DataFrame:
    """One contribution for each block, method and query: (block, rrf, hits)."""
    rows = methods[0].select("block", "block_rank")
    for m in methods[1:]:
        rows = rows.unionAll(m.select("block", "block_rank"))
    return rows.groupBy("block").agg(F.round(F.sum(1 / (RRF + F.col("block_rank"))), 9).alias("rrf"), F.count("*").alias("hits"))


def final(blocks: DataFrame, top: int = FINAL) -> DataFrame:
    return blocks.orderBy(F.desc("rrf"), "block").limit(top)


def report_intake(reports: DataFrame) -> DataFrame:
    """reports: id, text. Words by white space and paragraphs between blank lines (LF, CRLF or CR)."""
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))
    parts = F.filter(F.split("text", f"{BREAK}[\t ]*{BREAK}(?:[\t ]*{BREAK})*"), lambda p: p.rlike(r"\S"))
    out = reports.select("id", words.cast("long").alias("words"), F.size(parts).cast("long").alias("paragraphs"))
    return out.withColumn("valid", (F.col("words") > 0) & (F.col("words") <= MOST_WORDS) & (F.col("paragraphs") == PARAGRAPHS))


def report_paragraphs(reports: DataFrame) -> DataFrame:
    """reports: id, text. Paragraphs between blank lines, without outer white space: id, origin (P1, P2, …), start_pos,
    end_pos, text; the offsets are those of the text as it is."""
    blank = f"{BREAK}[\t ]*{BREAK}(?:[\t ]*{BREAK})*"
    parts, gaps = F.split("text", blank, -1), F.regexp_extract_all("text", F.lit(f"({blank})"), F.lit(1))
    rows = reports.select("id", F.posexplode(F.arrays_zip(parts.alias("p"), gaps.alias("g"))).alias("k", "x")).select("id", "k", F.col("x.p").alias("p"), F.coalesce("x.g", F.lit("")).alias("g"))
    before = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("p") + F.length("g")).over(before), F.lit(0))).where(F.col("p").rlike(r"\S"))
    left, body = F.length("p") - F.length(F.regexp_replace("p", r"^\s+", "")), F.regexp_replace("p", r"^\s+|\s+$", "")
    rows = rows.withColumn("number", F.row_number().over(Window.partitionBy("id").orderBy("k"))).withColumn("start_pos", (F.col("at") + left).cast("long"))
    return rows.select("id", F.concat(F.lit("P"), F.col("number").cast("string")).alias("origin"), "start_pos", (F.col("start_pos") + F.length(body)).cast("long").alias("end_pos"), body.alias("text"))


def named_queries(reports: DataFrame, max_tokens: int, count: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """One query for each paragraph and one for the whole report, cut into blocks of at most max_tokens: id, query (P1, or
    P1.1, P1.2, … if there are several blocks), origin, start_pos, end_pos, tokens, text. count() makes a worker's
    tokenizer; without it a token is a code point, beside the fixed ones of an input."""
    whole = reports.where(F.col("text").rlike(r"\S")).select("id", F.lit("report").alias("origin"), F.lit(0).cast("long").alias("start_pos"), "text")
    rows = report_paragraphs(reports).select("id", "origin", "start_pos", "text").unionByName(whole)
    if count is None:
        room = max_tokens - OVERHEAD
        cuts = F.transform(F.sequence(F.lit(0), F.length("text") - 1, F.lit(room)), lambda a: F.struct(a.alias("a"), F.least(a + room, F.length("text")).alias("b"), (F.least(a + room, F.length("text")) - a + OVERHEAD).alias("tokens")))
        rows = rows.withColumn("cuts", cuts)
    else:
        kind = "id long, origin string, start_pos long, text string, cuts array<struct<a:int,b:int,tokens:int>>"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tokens_of = count()
            split = split_by(tokens_of, max_tokens)
            for batch in batches:
                yield batch.assign(cuts=[[{"a": a, "b": b, "tokens": tokens_of(t[a:b])} for a, b in split(t)] for t in batch["text"]])

        rows = rows.mapInPandas(run, kind)
    rows = rows.select("id", "origin", "start_pos", "text", F.size("cuts").alias("n"), F.posexplode("cuts").alias("k", "c"))
    name = F.when(F.col("n") == 1, F.col("origin")).otherwise(F.concat_ws(".", "origin", (F.col("k") + 1).cast("string")))
    return rows.select("id", name.alias("query"), "origin", (F.col("start_pos") + F.col("c.a")).cast("long").alias("start_pos"), (F.col("start_pos") + F.col("c.b")).cast("long").alias("end_pos"), F.col("c.tokens").cast("long").alias("tokens"), cut(F.col("text"), F.col("c.a"), F.col("c.b")).alias("text"))


def read_answers(answers: DataFrame, content: str = "content", most: int = ANSWER_BYTES) -> DataFrame:
    """Strict reading of a model's answers: one JSON value, bare or in one fence, without repeated keys, NaN or deep
    nesting; nothing is repaired. Adds value (canonical JSON, null if refused) and why (null if read)."""

    @F.pandas_udf("value string, why string")
    def read(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            try:
                if text is None or len(text.encode("utf-8", "surrogatepass")) > most:
                    raise PackageError("missing or too long")
                bare = text.strip()
                fence = FENCE.fullmatch(bare)
                value = strict_json((fence.group(1) if fence else bare).encode("utf-8", "surrogatepass"))
                out.append((json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")), None))
            except (ValueError, RecursionError):
                out.append((None, "invalid"))
        return pd.DataFrame(out, columns=["value", "why"])

    return answers.withColumn("read_", read(content)).select(*answers.columns, "read_.value", "read_.why")


def rebuilt_blocks(fragments: DataFrame) -> DataFrame:
    """fragments: block, frag_no, start_pos, end_pos, text. A block's text from overlapping fragments; gaps: how many
    fragments begin behind all that came before."""
    order = Window.partitionBy("block").orderBy("start_pos", "frag_no")
    cover = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = fragments.withColumn("cover", F.coalesce(cover, F.first("start_pos").over(order)))
    new = F.when(F.col("end_pos") > F.col("cover"), F.substr("text", F.greatest(F.col("cover") - F.col("start_pos"), F.lit(0)) + F.lit(1), F.length("text"))).otherwise(F.lit(""))
    rows = rows.withColumn("new", new).withColumn("gap", (F.col("start_pos") > F.col("cover")).cast("int"))
    grouped = rows.groupBy("block").agg(F.array_join(F.array_sort(F.collect_list(F.struct("start_pos", "frag_no", "new")))["new"], "").alias("text"), F.sum("gap").alias("gaps"))
    return grouped.select("block", "text", sha256(F.col("text")).alias("sha256"), "gaps")


def overlap_conflicts(fragments: DataFrame) -> DataFrame:
    """(block, frag_no): fragments whose beginning differs from the end of the fragment before, where the two overlap."""
    order = Window.partitionBy("block").orderBy("start_pos", "frag_no")
    rows = fragments.withColumn("last", F.lag(F.struct("start_pos", "end_pos", "text")).over(order))
    shared = F.least("last.end_pos", "end_pos") - F.col("start_pos")
    before = F.substr("last.text", F.col("start_pos") - F.col("last.start_pos") + 1, shared)
    return rows.where((shared > 0) & (before != F.left("text", shared))).select("block", "frag_no")


def passages(texts: DataFrame) -> DataFrame:
    """texts: id, text. Literal passages, trimmed, with offsets; the pieces between are cumulated, never searched."""
    every = F.regexp_extract_all("text", F.lit(rf"((?s){PASSAGE}|[.!?\n]+)"), F.lit(1))
    rows = texts.select("id", F.posexplode(every).alias("k", "piece"))
    before = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    left = F.length("piece") - F.length(F.regexp_replace("piece", r"^\s+", ""))
    body = F.regexp_replace("piece", r"^\s+|\s+$", "")
    rows = rows.where(~F.col("piece").rlike(r"^[.!?\n]+$") & (body != ""))
    return rows.select("id", (F.col("at") + left).cast("long").alias("start_pos"), (F.col("at") + left + F.length(body)).cast("long").alias("end_pos"), body.alias("passage"))


def literal(quote: Column, text: Column, start: Column, end: Column) -> Column:
    """Is the quote what stands at the place named?"""
    inside = (start >= 0) & (end > start) & (end <= F.length(text))
    return F.coalesce(inside & (cut(text, start, end) == quote) & quote.rlike(r"\S"), F.lit(False))


def covered(citations: DataFrame, fragments: DataFrame) -> DataFrame:
    """citations: citation, block, a, b, frags (array of cited fragment numbers). (citation, covered): do the cited
    fragments, each of which must meet the passage, cover it without a gap?"""
    rows = citations.select("citation", "block", "a", "b", F.explode("frags").alias("frag_no")).join(fragments.select("block", "frag_no", "start_pos", "end_pos"), ["block", "frag_no"], "left")
    rows = rows.withColumn("x", F.greatest("a", "start_pos")).withColumn("y", F.least("b", "end_pos"))
    order = Window.partitionBy("citation").orderBy("x", "y")
    upto = F.coalesce(F.max("y").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("a"))
    rows = rows.withColumn("ok", F.col("start_pos").isNotNull() & F.coalesce((F.col("x") < F.col("y")) & (F.col("x") <= upto), F.lit(False)))
    found = rows.groupBy("citation").agg((F.bool_and("ok") & (F.max("y") >= F.max("b")) & (F.count("frag_no") == F.count_distinct("frag_no"))).alias("ok"))
    return citations.select("citation").join(found, "citation", "left").select("citation", F.coalesce("ok", F.lit(False)).alias("covered"))


def routed(links: DataFrame) -> DataFrame:
    """links: link, paragraph_known, report_literal, block_known, quote_literal, covered, situation, reason. Accepted,
    discarded or rejected with the first check that fails."""
    why = F.when(~F.col("paragraph_known"), "paragraph").when(~F.col("report_literal"), "report_quote").when(~F.col("block_known"), "block").when(~F.col("quote_literal"), "source_quote").when(~F.col("covered"), "fragments").when(~F.col("situation").isin(SITUATIONS), "situation").when(~F.coalesce(F.col("reason").rlike(r"\S"), F.lit(False)), "reason")
    return links.select("link", why.alias("why"), F.when(why.isNotNull(), "rejected").when(F.col("situation") == "discarded", "discarded").otherwise("accepted").alias("route"))


def distinct_links(links: DataFrame, keys: list[str], order: str = "link", most: int = MOST_LINKS) -> DataFrame:
    """The first of equal links, and no more than the limit."""
    one = Window.partitionBy(*keys).orderBy(order)
    return links.withColumn("n_", F.row_number().over(one)).where("n_ = 1").drop("n_").orderBy(order).limit(most)


def within_budget(blocks: DataFrame, budget: int = REQUEST_BYTES, overhead: int = 0) -> DataFrame:
    """blocks: query, rank, text. Whole blocks from the front while their bytes fit; what follows a misfit goes too."""
    upto = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("bytes", F.sum(F.octet_length("text") + F.lit(overhead)).over(upto)).where(F.col("bytes") <= budget)


def corpus_violations(fragments: DataFrame, vectors: DataFrame, expected: int, prefix: str = "passage: ") -> DataFrame:
    """(check, n): repeated ids, fragments without vector and the reverse, digests, order of offsets, counts; where the
    columns exist, digests of the model's entries, and vectors that are not finite, not of unit length or uneven."""
    checks = {
        "repeated": fragments.groupBy("frag").count().where("count > 1"),
        "no_vector": fragments.join(vectors, "frag", "left_anti"),
        "no_fragment": vectors.join(fragments, "frag", "left_anti"),
        "digest": fragments.where(sha256(F.col("text")) != F.col("sha256")),
        "offsets": fragments.where("start_pos < 0 or end_pos <= start_pos or end_pos - start_pos <> length(text)"),
    }
    if "entry_sha256" in fragments.columns:
        checks["entry"] = fragments.where(sha256(F.concat(F.lit(prefix), "header", F.lit("\n"), "text")) != F.col("entry_sha256"))
    if "v" in vectors.columns:
        bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        checks["not_finite"] = vectors.where(bad)
        checks["norm"] = vectors.where(~bad & (F.abs(norm(F.col("v")) - 1) > CORPUS_UNIT))
        checks["dimension"] = vectors.join(F.broadcast(vectors.agg(F.max(F.size("v")).alias("most"))), F.size("v") != F.col("most"))  # one row
    out = fragments.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit("count").alias("check"), "n")
    for name, df in checks.items():
        out = out.unionByName(df.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(name).alias("check"), "n"))
    return out
