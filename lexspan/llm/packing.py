"""Operator 6: packing into windows by Karmarkar-Karp multiway differencing.

A document's ids (with id 1 behind them) are cut into whole windows of CAPACITY ids, each a sequence of its own, and the
rest into pieces of at most PIECE ids. The pieces of a bounded group of about GROUP pieces are divided into as few
windows as their sum needs: the two partial partitions with the largest differences are merged, the largest parts of one
with the smallest of the other, until one partition is left. If its largest window exceeds the capacity, the number of
windows rises by one. Groups are dealt by the hash of a row number, so copies or repeated ids never gather in one.

Null and empty texts hold id 1 alone. Repeated rows are packed as often as they occur; a null doc_id is kept. An empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, slices, spread
from .tokens import Encoder

CAPACITY, PIECE, GROUP, LAST_ID = 2048, 512, 400, 1


def differencing(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """(sum, indices) of each window, by the largest differencing method."""
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # Parts are in descending order; parts beyond a list's end are empty.
        alone_a, alone_b = windows - len(b), windows - len(a)
        if alone_a >= len(a):
            parts = a + b
        else:
            parts = a[:alone_a] + b[:alone_b]
            parts += [(a[i][0] + b[windows - 1 - i][0], a[i][1] + b[windows - 1 - i][1]) for i in range(alone_a, len(a))]
        parts.sort(key=lambda x: -x[0])
        gap = parts[0][0] - (parts[-1][0] if len(parts) == windows else 0)
        heapq.heappush(heap, (-gap, serial, parts))
        serial += 1
    return heap[0][2] if heap else []


def fill(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Indices by window, no window over the capacity; no size may exceed it."""
    windows = -(-sum(sizes) // capacity)
    while sizes:
        parts = differencing(sizes, windows)
        if parts[0][0] <= capacity:
            return [p for _, p in parts]
        windows += 1
    return []


def _pieces(path: str):
    end = LAST_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder.get(path)
        for batch in batches:
            texts, ids = list(batch["text"]), batch["doc_id"].astype("Int64").array
            for a, b in slices(texts, 2_000_000):
                rows = []
                for k, raw in enumerate(encoder.encode(texts[a:b]), a):
                    raw += end
                    n = len(raw) // 4
                    whole = n - n % CAPACITY
                    for start in [*range(0, whole, CAPACITY), *range(whole, n, PIECE)]:
                        length = CAPACITY if start < whole else min(PIECE, n - start)
                        rows.append((ids[k], start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n))
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    return cut


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("row").reset_index(drop=True)
    sequence, offset = [0] * len(group), [0] * len(group)
    sizes, base = group["length"].tolist(), int(group["bin"].iloc[0]) << 21
    for k, window in enumerate(fill(sizes)):
        at = 0
        for i in sorted(window):
            sequence[i], offset[i] = base + 2 * k, at
            at += sizes[i]
    group["sequence_id"], group["offset"] = sequence, offset
    return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]


def pack(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece.

    Even sequence ids are packed windows, odd ones whole windows of one document.
    """
    stage = Stage(spark, "pack")
    rows = spread(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    made = rows.mapInPandas(_pieces(path), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    made = stage.put(made.withColumn("row", F.monotonically_increasing_id()))
    whole, parts = made.where(f"length = {CAPACITY}"), made.where(f"length < {CAPACITY}")
    bins = max(1, -(-parts.count() // GROUP))
    dealt = parts.withColumn("bin", F.pmod(F.xxhash64("row"), F.lit(bins)))
    packed = dealt.groupBy("bin").applyInPandas(_fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    alone = whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return stage.result(packed.unionByName(alone))
