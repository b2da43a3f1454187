"""Shared pieces of the training-data operators: tables, staging in the shared folder, vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import safe_unions, shared_dir

#: Rows of an Arrow batch; texts may be long, and a worker holds a batch more than once.
BATCH_ROWS = "500"
#: Words are runs without the ASCII white space of the contract.
WORD_BREAKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns never enter a plan, so their names cannot clash."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


class Stage:
    """Written tables of one operator run. They cut the lineage, survive lost executors and are dropped when done."""

    def __init__(self, spark: SparkSession, name: str):
        safe_unions(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stage_path = path
        return out

    def _delete(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no lazy result reads any more."""
        self._delete(df.stage_path)

    def result(self, df: DataFrame) -> DataFrame:
        """Write the operator's result and delete all its other tables."""
        out = self.put(df)
        for k in range(1, self.n):
            self._delete(f"{self.root}/{k}")
        return out


def spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A table read as fewer splits than there are cores is dealt out before heavy row work."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Up to so many rows of an id or a hash are broadcast (about 16 bytes each); beyond it Spark shuffles.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side of counted size, or leave it to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


# Vectorised hashing ------------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_ROW = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(WORD_BREAKS)] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, p in enumerate((_P, _P_INV)):
            base = np.full(size, p)
            base[0] = 1
            _POWERS[k] = np.multiply.accumulate(base)
    return _POWERS[0][:n], _POWERS[1][:n]


def split_words(texts: list[str | None], marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash every lower-cased (A-Z) word of some texts at once.

    Returns the words' hashes, each text's first word (one more entry than texts), each word's first and last byte in the
    texts joined by line feeds, and those bytes. A word's hash depends on its bytes alone. With `marks` a full stop or
    comma between a Latin-1 letter and white space is a word of its own.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends_at = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
    inside = ~_IS_BREAK[raw]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    if marks and len(ends):
        last, one, two = raw[ends - 1], raw[np.maximum(ends - 2, 0)], raw[np.maximum(ends - 3, 0)]
        letter = ((one >= 97) & (one <= 122)) | ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))
        own = letter & ((last == 44) | (last == 46)) & (ends - starts >= 2 + ((one >= 0x80).astype(np.int64)))
        at = np.flatnonzero(own)
        starts, ends = np.insert(starts, at + 1, ends[at] - 1), np.insert(ends, at, ends[at] - 1)
    up, down = _powers(len(raw) + 1)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * up[:-1], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts])
    first = np.concatenate([[0], np.searchsorted(starts, ends_at)]) if len(parts) else np.zeros(1, np.int64)
    return hashes, first, starts, ends, raw


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, and each text's first word (one more entry than texts)."""
    hashes, first, *_ = split_words(texts)
    return hashes, first


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text in order; the whole sequence as one if it has fewer words."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    out = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        out += words[j : n - size + 1 + j] * _ROW[j]
    return mix64(out + np.uint64(size))


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first = word_hashes(texts)
    return [np.unique(shingle_hashes(words[a:b], k)) for a, b in zip(first[:-1], first[1:])]


def slices(texts, most: int = 500_000):
    """Index ranges of a column of texts that hold about so many characters together; a longer text stands alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


# Components --------------------------------------------------------------------------------------------------------


#: Edges that one task joins locally at most.
LOCAL = 200_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of the edges (a, b) of one partition: each node's smallest reachable node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    nodes = list(root)
    yield pd.DataFrame({"node": nodes, "component": [find(x) for x in nodes]}, dtype=np.int64)


def components(stage: Stage, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b); nodes without an edge to another don't appear.

    Up to LOCAL edges are joined by one task. Beyond that, pieces of so many edges are each reduced to stars first; then
    each round hooks every node to its smallest neighbour, follows the pointers twice and contracts the edges, so the
    edges shrink fast and a hub never meets in one task, until a task can join what is left.
    """
    edges = stage.put(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    solved = lambda edges: stage.put(edges.repartition(1).mapInPandas(_forest, "node long, component long"))
    n = edges.count()
    if n <= LOCAL:
        labels = solved(edges)
        stage.drop(edges)
        return labels
    stars = edges.repartition(-(-n // LOCAL)).mapInPandas(_forest, "node long, component long").where("node <> component")
    old, edges = edges, stage.put(stars.select(F.col("component").alias("a"), F.col("node").alias("b")).distinct())
    stage.drop(old)
    labels = stage.put(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")))
    while (n := edges.count()) > LOCAL:
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        up = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        up = stage.put(up)
        for _ in range(2):
            far = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            nxt = stage.put(up.join(far, "p").select("u", F.col("q").alias("p")))
            stage.drop(up)
            up = nxt
        a, b = (up.select(F.col("u").alias(x), F.col("p").alias(f"{x}2")) for x in "ab")
        old, old_labels = edges, labels
        edges = edges.join(a, "a").join(b, "b").where("a2 <> b2")
        edges = stage.put(edges.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        moved = up.select(F.col("u").alias("component"), F.col("p").alias("to"))
        labels = stage.put(labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        for x in (old, old_labels, up):
            stage.drop(x)
    if n:
        moved, old_labels = solved(edges), labels
        labels = stage.put(labels.join(F.broadcast(moved.select(F.col("node").alias("component"), F.col("component").alias("to"))), "component", "left").select("node", F.coalesce("to", "component").alias("component")))  # 2 * LOCAL rows at most
        for x in (moved, old_labels):
            stage.drop(x)
    stage.drop(edges)
    return labels


def joined(stage: Stage, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, component) after further edges (a, b): only the components that they touch are joined."""
    for x in "ab":
        edges = edges.join(labels.select(F.col("node").alias(x), F.col("component").alias(f"{x}2")), x, "left")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    moved = components(stage, edges.select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")))
    every = labels.unionByName(nodes).join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return stage.put(every.select("node", F.coalesce("to", "component").alias("component")))
