"""Token ids of texts, and operator 10: token counts by a separator scan over flat token files.

A flat token file is one run of little-endian 16-bit ids, an end-of-document id behind each document, and no index. Here
it is held as rows (stream, block, tokens) of raw blocks of BLOCK ids each, cut wherever a block is full; `read_flat`
makes the same rows from plain files. The scan searches each block for the end-of-document id at once (numpy). A prefix
scan over the blocks' summaries then stitches documents that cross blocks: with T the ids before a block and P the place
behind the last end before it (a running maximum), T - P ids of an open document lie before the block. Only summaries,
one small row a block, meet per stream; lengths inside blocks stay where they are found.

Null and empty texts have 0 tokens. Repeated rows are repeated documents, and a null doc_id is kept. A text's own
mention of the end marker is ordinary text and never ends a document. Ids behind the last end of a stream are an
unfinished document, counted like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, split_words, spread

BLOCK, END_ID, CACHE_WORDS = 1 << 18, 49407, 1_000_000

_LETTERS = re.compile("[a-zà-öø-ÿ]+").fullmatch


class Encoder:
    """Ids as little-endian bytes, `width` bytes an id.

    The vocabulary ignores case and its pieces span neither white space nor a letter and a punctuation mark. So a text's
    ids are those of its words in turn, and a stop or comma between a letter and white space is a word of its own. Words
    are hashed for many texts at once (numpy); a distinct one is encoded once while it stays in a table of bounded size,
    and ids are put together by gathers. Texts that mention a special token go through the tokenizer as they are.
    """

    _made: dict = {}

    def __init__(self, path: str, width: int = 4, literal: bool = False):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        self.tokenizer, self.kind = Tokenizer.from_file(path), np.dtype(f"<u{width}")
        self.tokenizer.encode_special_tokens = literal
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for piece, k in vocabulary.items() if piece.endswith("</w>")]] = True
        if not self.ends.any():
            self.ends = None
        self._forget()

    def _forget(self) -> None:
        """Known words: hashes in ascending order, and the place and number of each one's ids in `pool`."""
        self.known, self.place, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    @classmethod
    def get(cls, path: str, width: int = 4, literal: bool = False) -> Encoder:
        key = (path, width, literal)
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def _encoded(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(indices, ids of each, their ids in turn). Words of letters are one piece each, so many go through as one text
        whose ids are cut behind each id that ends a word; should the number not agree, each goes alone."""
        letters = [self.ends is not None and _LETTERS(w) is not None for w in words]
        plain, left = [i for i, x in enumerate(letters) if x], [i for i, x in enumerate(letters) if not x]
        for k in range(0, len(plain), 512):
            some = plain[k : k + 512]
            ids = np.array(self.tokenizer.encode(" ".join([words[i] for i in some]), add_special_tokens=False).ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                yield some, np.diff(stops, prepend=0), ids
            else:
                left += some
        for k in range(0, len(left), 20_000):
            some = left[k : k + 20_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False)]
            yield some, np.array([len(x) for x in ids]), np.array([x for part in ids for x in part], self.kind)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        pool, order, counts = [self.pool], [], []
        for indices, count, ids in self._encoded(words):
            pool.append(ids)
            order += indices
            counts.append(count)
        count = np.concatenate(counts).astype(np.int64)
        known = np.concatenate([self.known, hashes[order]])
        place = np.concatenate([self.place, len(self.pool) + np.cumsum(count) - count])
        by = np.argsort(known, kind="stable")
        self.pool, self.known, self.place, self.count = np.concatenate(pool), known[by], place[by], np.concatenate([self.count, count])[by]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        special = {i: self.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if t and "<|" in t}
        hashes, first, starts, ends, raw = split_words([None if i in special else t for i, t in enumerate(texts)], marks=True)
        unique, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self._forget()
        found = np.searchsorted(self.known, unique)
        new = np.flatnonzero((self.known[np.minimum(found, len(self.known) - 1)] != unique) if len(self.known) else np.ones(len(unique), bool))
        if len(new):
            data = raw.tobytes()
            self._learn(unique[new], [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            found = np.searchsorted(self.known, unique)
        place, count = self.place[found][which], self.count[found][which]
        before = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.arange(before[-1]) + np.repeat(place - before[:-1], count)].tobytes()
        cut = (before[first] * self.kind.itemsize).tolist()
        return [np.array(special[i], self.kind).tobytes() if i in special else ids[cut[i] : cut[i + 1]] for i in range(len(texts))]


def flatten(docs: DataFrame, path: str) -> DataFrame:
    """Write documents (doc_id, text) as flat token streams, one a partition.

    Rows with tokens are blocks (stream, n the block's number); the others name the stream's n-th document.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, stream = Encoder.get(path, 2, True), TaskContext.get().partitionId()
        end, size = np.array([END_ID], "<u2").tobytes(), 2 * BLOCK
        rest, blocks, ordinal = b"", 0, 0
        row = lambda n, ids, tokens: pd.DataFrame({"stream": stream, "n": n, "doc_id": ids, "tokens": tokens}).astype({"doc_id": "Int64", "stream": "int64"})
        for batch in batches:
            for i in range(0, len(batch), 512):
                some = batch.iloc[i : i + 512]
                rest += b"".join(ids + end for ids in encoder.encode(list(some["text"])))
                full = len(rest) // size
                yield row(range(blocks, blocks + full), [None] * full, [rest[k * size : (k + 1) * size] for k in range(full)])
                rest, blocks = rest[full * size :], blocks + full
                yield row(range(ordinal, ordinal + len(some)), some["doc_id"].astype("Int64").array, [None] * len(some))
                ordinal += len(some)
        if rest:
            yield row([blocks], [None], [rest])

    return docs.mapInPandas(write, "stream long, n long, doc_id long, tokens binary")


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """(stream, name, block, tokens) of plain flat files under a path; Spark reads a file of at most 2 GB as one row,
    which is cut into its blocks once."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("stream"), F.col("path").alias("name"), "content", F.col("length").cast("long").alias("bytes"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / (2 * BLOCK)).cast("int")), lambda k: F.substr("content", k * (2 * BLOCK) + 1, F.lit(2 * BLOCK)))
    return files.where("bytes > 0").select("stream", "name", F.posexplode(cuts).alias("block", "tokens")).withColumn("block", F.col("block").cast("long"))


def _scan(end_id: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for stream, block, tokens in zip(batch["stream"], batch["block"], batch["tokens"]):
                ids = np.frombuffer(tokens, "<u2")
                at = np.flatnonzero(ids == end_id)
                rows.append((stream, block, len(ids), len(at), int(at[-1]) + 1 if len(at) else None, (np.diff(at, prepend=-1) - 1)))
            yield pd.DataFrame(rows, columns=["stream", "block", "ids", "ends", "last", "lengths"]).astype({"last": "Int64"})

    return scan


def document_lengths(stage: Stage, blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(stream, ordinal, n_tokens) of each document in blocks (stream, block, tokens)."""
    found = stage.put(blocks.select("stream", "block", "tokens").mapInPandas(_scan(end_id), "stream long, block long, ids long, ends long, last long, lengths array<long>"))
    order = Window.partitionBy("stream").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("stream", "block", "ids", "ends", "last")
    summary = summary.withColumn("t", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    summary = summary.withColumn("done", F.coalesce(F.max(F.col("t") + F.col("last")).over(before), F.lit(0)))
    summary = summary.withColumn("number", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    summary = summary.withColumn("final", F.lead("block").over(order).isNull())
    place = summary.select("stream", "block", (F.col("t") - F.col("done")).alias("open"), "number")
    closed = found.where("ends > 0").select("stream", "block", F.posexplode("lengths").alias("k", "length")).join(place, ["stream", "block"])
    closed = closed.select("stream", (F.col("number") + F.col("k")).alias("ordinal"), (F.col("length") + F.when(F.col("k") == 0, F.col("open")).otherwise(0)).alias("n_tokens"))
    left = F.when(F.col("last").isNull(), F.col("t") - F.col("done") + F.col("ids")).otherwise(F.col("ids") - F.col("last"))
    unfinished = summary.where("final").select("stream", (F.col("number") + F.col("ends")).alias("ordinal"), left.alias("n_tokens")).where("n_tokens > 0")
    return closed.unionByName(unfinished)


def count_tokens(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens (without the end), stream, ordinal."""
    stage = Stage(spark, "tokens")
    flat = stage.put(flatten(spread(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), path))
    lengths = document_lengths(stage, flat.where("tokens is not null").select("stream", F.col("n").alias("block"), "tokens"))
    named = flat.where("tokens is null").select("stream", F.col("n").alias("ordinal"), "doc_id")
    return stage.result(named.join(lengths, ["stream", "ordinal"]).select("doc_id", "n_tokens", "stream", "ordinal"))
