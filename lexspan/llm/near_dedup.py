"""Operator 2: MinHash near-duplicates with sequential Bayesian verification.

Texts are lower-cased (A-Z) and split at ASCII white space; a text's set holds its distinct five-word shingles, or the
whole sequence as one if it has fewer words. Two texts are linked if 100 * |intersection| >= 85 * |union|.

1. Each text becomes a signature of MINHASHES minima and BANDS band keys (Arrow batches, numpy). At the threshold a
   linked pair shares no band with probability (1 - 0.85^5)^25, under 5e-7.
2. Texts with equal sets are one class, named by a 128-bit digest, so that copies never meet pairwise. Only classes that
   share a bucket go on, as numbered nodes; their texts are read a second time for the full sets.
3. Within a bucket every class is compared with one leader only (the member with the most collisions): as many pairs
   as rows. Signatures are compared in batches; a pair is dropped once the posterior probability that it reaches the
   threshold falls under MISS. Survivors are confirmed on the full sets. A leader of many pairs is dealt by salts.
4. Where a bucket's members still lie in several components, shingles that no other such member holds are counted. They
   bound what a member can reach with anyone, so most edited copies are proved unlinked in linear time. Those that
   remain outside the largest component are compared with another member of it, again one pair a row, as long as rounds
   find links. What is left then meets in blocks of bounded size that hold the full sets, and each block gives back only
   confirmed links that join components, never more than its members. Pairs in one component need no link, so no
   component is lost, however large a bucket is.

Null, empty and blank texts have empty sets and are linked with nothing. Repeated rows are kept as rows. Rows of one
doc_id with different texts are different texts, each with its own component. Rows with a null doc_id take part in
classes through the others' ids and are never `kept`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, components, joined, mix64, shingle_sets, slices, small, spread

MINHASHES, BATCH, SHINGLE, MISS = 128, 16, 5, 1e-7
#: Rounds of further leaders at most, before what is left is compared in blocks.
ROUNDS = 2
#: Members of a bucket that one block of the last comparison holds, about.
BLOCK = 256
#: Pairs of one leader that are dealt together, about.
HOT = 256


@dataclass(frozen=True)
class Rule:
    """BANDS bands of ROWS minima; a pair is linked from PERCENT per cent of Jaccard similarity on."""

    percent: int = 85
    bands: int = 25
    rows: int = 5

    def band_keys(self, low: np.ndarray) -> list[int]:
        raw, size = low[: self.bands * self.rows].tobytes(), 4 * self.rows
        return [xxhash.xxh3_64_intdigest(raw[i * size : (i + 1) * size], seed=i) - 2**63 for i in range(self.bands)]

    def bands_of(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Band keys (a row for each set) of sets whose hashes lie one behind another; each set begins at `at`."""
        x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
        out = np.empty((len(at), self.bands), np.uint64)
        for band in range(self.bands):
            key = np.full(len(at), band + 1, np.uint64)
            for i in range(band * self.rows, (band + 1) * self.rows):
                key = mix64((key << np.uint64(32)) ^ key ^ np.minimum.reduceat(_permuted(x, i), at))
            out[:, band] = key
        return out.view(np.int64)

    def least_matches(self, miss: float = MISS) -> list[int]:
        """By number of batches: the matches below which a pair reaches the threshold with probability under `miss`.

        With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1); its mass above t is a
        binomial sum.
        """
        t, out = self.percent / 100, []
        for n in range(BATCH, MINHASHES + 1, BATCH):
            mass, m = 0.0, -1
            while mass < miss:
                m += 1
                mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append(m)
        return out

    def plausible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Indices of the row pairs that no batch of the signatures rules out."""
        alive, same = np.arange(len(left)), np.zeros(len(left), np.int32)
        for k, least in enumerate(self.least_matches()):
            at = slice(k * BATCH, (k + 1) * BATCH)
            same = same + (left[alive, at] == right[alive, at]).sum(axis=1, dtype=np.int32)
            keep = same >= least
            alive, same = alive[keep], same[keep]
        return alive

    def linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= self.percent * (len(x) + len(y) - both)


RULE = Rule()

_RNG = np.random.default_rng(97)
_MUL = _RNG.integers(0, 2**31, MINHASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, MINHASHES, dtype=np.uint32)


def _permuted(x: np.ndarray, i) -> np.ndarray:
    y = x * _MUL[i] + _ADD[i]
    y ^= y >> np.uint32(15)
    y *= np.uint32(0x2C1B3C6D)
    return y


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of MINHASHES permutations of the 32-bit halves of a set's hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    low = np.full(MINHASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(low, _permuted(x[i : i + 512, None], slice(None)).min(axis=0), out=low)
    return low


def described(hashes: np.ndarray, rule: Rule) -> tuple:
    """(class, signature, bands) of a set; nulls for an empty one. Equal sets have equal classes. A signature keeps one
    byte of each minimum: a chance match in 256 can only spare a pair."""
    if not len(hashes):
        return None, None, None
    low = signature(hashes)
    return xxhash.xxh3_128_digest(hashes.tobytes()), mixed_bytes(low), rule.band_keys(low)


def mixed_bytes(low: np.ndarray) -> bytes:
    """A byte of each minimum; minima are small numbers, so they are mixed first."""
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, MINHASHES)


def _compare(rule: Rule, rows: pd.DataFrame, across: bool) -> pd.DataFrame:
    """Confirmed links (a, b) between members (id, component, hashes, side) of different components, only those that
    join components; across: only between sides. Each member meets all others at once, by marking its shingles."""
    sizes = rows["hashes"].str.len().to_numpy() // 8
    _, shingle = np.unique(np.frombuffer(b"".join(rows["hashes"]), np.uint64), return_inverse=True)
    at = np.cumsum(sizes) - sizes
    ids, component, side = rows["id"].tolist(), rows["component"].to_numpy(), rows["side"].to_numpy()
    root = {int(c): int(c) for c in component}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    joins, marked = [], np.zeros(int(shingle.max(initial=0)) + 1, bool)
    for x in range(len(rows) - 1):
        own = shingle[at[x] : at[x] + sizes[x]]
        marked[own] = True
        both = np.add.reduceat(marked[shingle[at[x + 1] :]], at[x + 1 :] - at[x + 1], dtype=np.int64)
        marked[own] = False
        fits = (100 * both >= rule.percent * (sizes[x] + sizes[x + 1 :] - both)) & (component[x + 1 :] != component[x])
        for y in x + 1 + np.flatnonzero(fits & (side[x + 1 :] != side[x]) if across else fits):
            p, q = find(int(component[x])), find(int(component[y]))
            if p != q:
                root[max(p, q)] = min(p, q)
                joins.append((ids[x], ids[y]))
    return pd.DataFrame(joins, columns=["a", "b"]).astype("int64")


def link_classes(stage: Stage, classes: DataFrame, rule: Rule, sets_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, class), one for each class that shares a bucket, and components (node, component) of linked ids.

    classes: class (digest), bands and, if the rule prunes, signature; repeated rows of a class do no harm. Only
    buckets with two classes go on. sets_of gives (class, hashes), sorted distinct 64-bit hashes as bytes, for nodes.
    """
    pruning = "signature" in classes.columns

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.iloc[rule.plausible(_matrix(batch["s1"]), _matrix(batch["s2"]))][["a", "b"]]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [rule.linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch["h1"], batch["h2"])]
            yield batch[keep][["a", "b"]]

    def beside(pairs: DataFrame, what: str) -> DataFrame:
        """Pairs (a, b, n, salt) with a's and b's column; a is the leader, and n salts deal its pairs."""
        mine = nodes_with.select(F.col("id").alias("b"), F.col(what).alias("y"))
        salts = pairs.groupBy("a").agg(F.max("n").alias("n"))
        theirs = nodes_with.select(F.col("id").alias("a"), F.col(what).alias("x")).join(salts, "a")
        theirs = theirs.select("a", "x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"))
        return pairs.join(mine, "b").join(theirs, ["a", "salt"])

    def confirm(pairs: DataFrame) -> DataFrame:
        """The linked ones of pairs (a, b), of which a leads many."""
        pairs = stage.put(pairs)
        many = pairs.groupBy("a").agg(F.ceil(F.count("*") / HOT).cast("int").alias("n"))
        dealt = pairs.join(many, "a").withColumn("salt", F.pmod(F.hash("b"), F.col("n")))
        made = [pairs]
        if pruning:
            made.append(stage.put(beside(dealt, "signature").select("a", "b", F.col("x").alias("s1"), F.col("y").alias("s2")).mapInPandas(prune, "a long, b long")))
            left = made[-1]
            many = left.groupBy("a").agg(F.ceil(F.count("*") / HOT).cast("int").alias("n"))
            dealt = left.join(many, "a").withColumn("salt", F.pmod(F.hash("b"), F.col("n")))
        out = stage.put(beside(dealt, "hashes").select("a", "b", F.col("x").alias("h1"), F.col("y").alias("h2")).mapInPandas(verify, "a long, b long"))
        for x in made:
            stage.drop(x)
        return out

    # Buckets with two classes, and their members as numbered nodes.
    rows = classes.select("class", F.explode("bands").alias("bucket"))
    name = F.xxhash64("class")
    crowded = stage.put(rows.groupBy("bucket").agg(F.min(name).alias("low"), F.max(name).alias("high")).where("low <> high").select("bucket"))
    met = stage.put(rows.join(small(crowded, crowded.count()), "bucket").distinct())
    nodes = stage.put(met.select("class").distinct().select("class", F.monotonically_increasing_id().alias("id")))
    n_nodes = nodes.count()
    live = stage.put(met.join(small(nodes, n_nodes), "class").select("bucket", "id"))
    for x in (crowded, met):
        stage.drop(x)
    with_sets = sets_of(nodes).join(small(nodes, n_nodes), "class").dropDuplicates(["id"])
    nodes_with = with_sets.select("id", "hashes")
    if pruning:
        signed = classes.select("class", "signature").join(small(nodes, n_nodes), "class").dropDuplicates(["id"]).select("id", "signature")
        nodes_with = nodes_with.join(signed, "id")
    nodes_with = stage.put(nodes_with)  # read once, for all rounds

    # Stars: every member against the one of its bucket that meets the most others.
    counts = stage.put(live.groupBy("bucket").agg(F.count("*").alias("members")))
    weight = stage.put(live.join(counts, "bucket").groupBy("id").agg(F.sum("members").alias("weight")))
    top = F.max(F.struct("weight", (-F.col("id")).alias("r"))).alias("top")
    leaders = stage.put(live.join(weight, "id").groupBy("bucket").agg(top).select("bucket", (-F.col("top.r")).alias("leader")))
    stars = live.join(leaders, "bucket").where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    labels = components(stage, confirm(stars))
    for x in (counts, weight, leaders):
        stage.drop(x)

    # Buckets that the stars leave in several components, and the members that can have another link.
    component = F.coalesce("component", "id").alias("component")
    place = lambda live, *more: live.join(labels.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", component, *more)
    several = lambda placed: placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    placed = stage.put(place(live))
    live_open = stage.put(placed.join(stage.put(several(placed)), "bucket").select("bucket", "id"))
    stage.drop(placed)
    stage.drop(live)
    if not live_open.limit(1).count():
        return nodes, labels

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.frombuffer(x, np.int64) for x in batch["hashes"]]
            yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), [len(x) for x in sets]), "h": np.concatenate(sets) if sets else np.zeros(0, np.int64)})

    in_open = nodes_with.join(live_open.select("id").distinct(), "id", "left_semi")
    alone = in_open.select("id", "hashes").mapInPandas(shingles, "id long, h long").groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("id"))
    alone = alone.where("n = 1").groupBy("id").agg(F.count("*").alias("alone"))
    measure = stage.put(in_open.select("id", F.expr("octet_length(hashes) div 8").alias("size")).join(alone, "id", "left").select("id", "size", F.coalesce("alone", F.lit(0)).alias("alone")))
    sized = live_open.join(measure, "id")
    least = stage.put(sized.groupBy("bucket").agg(F.min("size").alias("least")))
    shared = F.col("size") - F.col("alone")
    reach = 100 * shared >= rule.percent * (F.col("alone") + F.greatest("least", shared))
    live = stage.put(sized.join(least, "bucket").where(reach).select("bucket", "id"))
    for x in (live_open, measure, least):
        stage.drop(x)

    for round_ in range(ROUNDS + 1):
        placed = stage.put(place(live))
        sizes = stage.put(placed.groupBy("bucket", "component").agg(F.count("*").alias("n")))
        tops = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"), F.sum("n").alias("members")).where("parts > 1")
        tops = stage.put(tops.select("bucket", F.col("top.component").alias("largest"), F.col("top.n").alias("inside"), (F.col("members") - F.col("top.n")).alias("outside")))
        open_ = stage.put(placed.join(tops, "bucket"))
        for x in (placed, sizes, tops):
            stage.drop(x)
        if not open_.limit(1).count():
            return nodes, labels
        if round_ == ROUNDS:
            break
        inside = stage.put(open_.where("component = largest").groupBy("bucket").agg(F.max(F.struct(F.xxhash64("bucket", "id", F.lit(round_)), "id")).alias("top")).select("bucket", F.col("top.id").alias("leader")))
        found = confirm(open_.where("component <> largest").join(inside, "bucket").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
        stage.drop(inside)
        if not found.limit(1).count():
            break
        stage.drop(open_)
        labels = joined(stage, labels, found)
    # Members outside the largest component in blocks; each block meets every block of its bucket.
    outside = F.col("component") != F.col("largest")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    few, many = blocks("outside"), blocks("inside")
    own = F.when(outside, F.pmod(F.hash("id"), few)).otherwise(-1 - F.pmod(F.hash("id"), many))
    others = F.when(outside, F.concat(F.sequence(F.lit(0), few - 1), F.sequence(-many, F.lit(-1)))).otherwise(F.sequence(F.lit(0), few - 1))
    rest = open_.select("bucket", "id", "component", own.alias("side"), F.explode(others).alias("other"))
    rest = rest.select("bucket", "id", "component", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    rest = rest.join(nodes_with.select("id", "hashes"), "id")
    found = stage.put(rest.groupBy("bucket", "i", "j").applyInPandas(lambda key, rows: _compare(rule, rows, key[1] != key[2]), "a long, b long"))
    if found.limit(1).count():
        labels = joined(stage, labels, found)
    for x in (live, open_, found, nodes_with):
        stage.drop(x)
    return nodes, labels


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = list(batch["text"])
        for a, b in slices(texts):
            rows = [(doc_id, key, len(s), *described(s, RULE)) for doc_id, key, s in zip(batch["doc_id"][a:b], batch["text_key"][a:b], shingle_sets(texts[a:b], SHINGLE))]
            yield pd.DataFrame(rows, columns=["doc_id", "text_key", "n_shingles", "class", "signature", "bands"]).astype({"doc_id": "Int64"})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = list(batch["text"])
        for a, b in slices(texts):
            sets = [s for s in shingle_sets(texts[a:b], SHINGLE) if len(s)]
            yield pd.DataFrame({"class": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "hashes": [s.tobytes() for s in sets]})


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key (xxhash64 of the text, which tells rows of one doc_id apart)."""
    stage = Stage(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    made = stage.put(spread(spark, docs).mapInPandas(_features, "doc_id long, text_key long, n_shingles long, class binary, signature binary, bands array<long>"))
    named = made.where("n_shingles > 0 and doc_id is not null")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Only one text of each class is read again."""
        first = named.join(small(nodes, nodes.count()), "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
        ids = stage.put(first.select("doc_id").distinct())
        return docs.join(small(ids, ids.count()), "doc_id", "left_semi").select("text").mapInPandas(_sets, "class binary, hashes binary")

    nodes, labels = link_classes(stage, named.select("class", "signature", "bands"), RULE, sets_of)
    rep = stage.put(named.groupBy("class").agg(F.min("doc_id").alias("rep")))
    linked = stage.put(nodes.join(labels.withColumnRenamed("node", "id"), "id").select("class", "component").join(rep, "class"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    n = linked.count()
    moved = linked.join(small(least, n), "component").select("class", "least")
    by_class = rep.join(small(moved, 2 * n), "class", "left").select("class", F.coalesce("least", "rep").alias("component"))
    out = made.select("doc_id", "n_shingles", "class", "text_key").join(by_class, "class", "left")
    component = F.coalesce("component", "doc_id")
    return stage.result(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), "text_key"))
