"""Operator 1: benchmark decontamination with SimHash over item-sized windows, in DataFrame operations only.

Words are runs of letters and digits of the lower-cased text; shingles are five words, or the whole item if it is
shorter. A document's window as long as an item is a leak if the weighted Jaccard similarity of their shingle sets is at
least 0.8; a shingle weighs 1 + ln((items + 1) / (items that hold it + 1)).

1. A window that reaches the threshold holds at least 0.8 of the item's weight, so it holds one of the item's rarest
   shingles (all but 0.8 of its weight). Every shingle position of every whole text is looked up among those.
2. In the texts found, all shingles of the items found are met, and every start is kept at which the shingles met inside
   an item-sized window weigh at least 0.8 of the item (repeated ones count each time, so no window is missed).
3. Each such window and each item gets a 64-bit SimHash of its weighted shingles.
4. A window meets the items for which it was kept, and no others, through BLOCKS blocks of bits. Two fingerprints that
   differ in at most RADIUS < BLOCKS bits agree on a block, so none within the radius is missed; any leak's window is kept
   for its own item in step 2, so candidates grow with what texts and items share and not with the number of items.
5. Candidates within the radius are verified by the exact weighted similarity; each (document, item) keeps its best
   window, the first of equals.

Null and empty texts and items have no shingle and never match. Texts and items are told apart by their words, so
repeated rows give one result row for a doc_id; of different texts or items under one id the best window counts. Rows
with a null id are compared as well and keep their null. Tables may be empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, small

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 two 64-bit fingerprints differ in 10 bits on average, with a deviation of 3.
RADIUS = 20
BLOCKS = RADIUS + 1


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(df: DataFrame, k: int, *keep: str) -> DataFrame:
    """A row (keep, pos, h) for each k-word shingle of the column `words`."""
    shifted = [F.col("words")] + [F.slice("words", j + 1, F.greatest(F.size("words") - j, F.lit(0))) for j in range(1, k)]
    rows = df.where(F.size("words") >= k).select(*keep, F.posexplode(F.arrays_zip(*(x.alias(f"w{j}") for j, x in enumerate(shifted)))).alias("pos", "w"))
    last = rows.where(F.col("w").getField(rows.schema["w"].dataType.fieldNames()[k - 1]).isNotNull())
    return last.select(*keep, "pos", F.xxhash64(*(F.col("w").getField(n) for n in rows.schema["w"].dataType.fieldNames())).alias("h"))


def grams(words: Column, k: int) -> Column:
    """The distinct hashes of the k-word shingles of an array of k words or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + F.lit(j)) for j in range(k)))))


def fingerprints(rows: DataFrame, *key: str) -> DataFrame:
    """key, simhash and mass (sum of the weights) from the weighted distinct shingles of each key."""
    signs = [F.sum(F.when(F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{b}") for b in range(64)]
    bits = (F.when(F.round(f"b{b}", 6) > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64))
    return rows.groupBy(*key).agg(F.round(F.sum("weight"), 6).alias("mass"), *signs).select(*key, "mass", reduce(lambda x, y: x.bitwiseOR(y), bits).alias("simhash"))


def _blocks(simhash: Column) -> Column:
    """Number and bits of each block: 64 bits in BLOCKS nearly equal blocks."""
    edges = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return F.array(*(F.shiftrightunsigned(simhash, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).bitwiseOR(F.lit(i << 32)) for i, (a, b) in enumerate(zip(edges, edges[1:]))))


SPOT = ("text", "start", "size")


def candidates(window_sets: DataFrame, laid: DataFrame, item_sets: DataFrame, n_items: int) -> DataFrame:
    """Windows beside the items that they were kept for and agree with on a block; a pair comes once for each such block."""
    items = item_sets.select("item", "k", F.col("simhash").alias("item_hash"), F.col("mass").alias("item_mass"), F.explode(_blocks(F.col("simhash"))).alias("block"))
    rows = laid.join(window_sets, list(SPOT)).withColumn("block", F.explode(_blocks(F.col("simhash"))))
    return rows.join(small(items, 3 * BLOCKS * n_items), ["item", "block"])


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (first word of the window), size (its words), similarity."""
    stage = Stage(spark, "leaks")
    named = benchmark.select("item_id", words(F.col("text")).alias("words")).withColumn("item", F.xxhash64("words")).where(F.size("words") > 0)
    named = stage.put(named.dropDuplicates(["item_id", "item"]))
    items = named.select("item", "words").dropDuplicates(["item"]).withColumn("size", F.size("words")).withColumn("k", F.least("size", F.lit(SHINGLE)))
    items = stage.put(items)
    n_items = items.count()
    ks = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most SHINGLE values
    empty = spark.createDataFrame([], "doc_id long, item_id long, start int, size int, similarity double")
    if not ks:
        return empty
    every = lambda f: reduce(DataFrame.unionByName, [f(k) for k in ks])
    rows = stage.put(every(lambda k: items.where(F.col("k") == k).select("item", "size", "k", F.explode(grams(F.col("words"), k)).alias("h"))))
    n_rows = rows.count()
    top = F.log(F.lit(n_items + 1.0)) + 1
    weights = stage.put(rows.groupBy("h").agg((1 + F.log(F.lit(n_items + 1.0) / (F.count("*") + 1))).alias("weight")))
    weighted = lambda x: x.join(small(weights, n_rows), "h", "left").withColumn("weight", F.round(F.coalesce("weight", top), 9))
    rows = stage.put(weighted(rows))
    item_sets = stage.put(fingerprints(rows, "item", "size", "k"))

    # The rarest shingles of each item: a window without any of them lacks more than it may.
    order = Window.partitionBy("item").orderBy(F.desc("weight"), "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = rows.withColumn("upto", F.sum("weight").over(order)).join(small(item_sets.select("item", "mass"), n_items), "item")
    rare = stage.put(rare.where(F.col("upto") - F.col("weight") <= (1 - SIMILARITY) * F.col("mass") + 1e-6).select("item", "k", "h"))
    texts = docs.select("doc_id", words(F.col("text")).alias("words")).withColumn("text_key", F.xxhash64("words"))
    key = ("doc_id", "text_key")
    met = every(lambda k: shingles(texts, k, *key).join(small(rare.where(F.col("k") == k).select("h", "item"), n_rows), "h").select(*key, "item"))
    pairs = stage.put(met.distinct())
    if not pairs.limit(1).count():
        return empty

    # The texts found, once more, and all shingles that they share with the items found in them.
    ids = stage.put(pairs.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).distinct())
    n_ids = ids.count()
    held = docs.join(small(ids.select("d").distinct(), n_ids), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").select("doc_id", words(F.col("text")).alias("words"))
    same = F.col("text_key").eqNullSafe(F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))
    held = held.withColumn("text_key", F.xxhash64("words")).join(small(ids, 2 * n_ids), same, "left_semi")
    held = stage.put(held.dropDuplicates(list(key)).withColumn("text", F.monotonically_increasing_id()))
    texts = held.select("text", *key)
    found = pairs.join(small(texts.select("text", F.col("doc_id").alias("d"), F.col("text_key").alias("t")), 3 * n_ids), same).select("text", "item")
    wanted = found.join(small(rows, 3 * n_rows), "item").select("text", "item", "size", "k", "h", "weight")
    inside = every(lambda k: shingles(held.withColumn("n", F.size("words")), k, "text", "n").withColumn("k", F.lit(k)))
    hits = inside.join(wanted, ["text", "k", "h"])

    # Starts at which the shingles met inside the window weigh enough: running sums over where each comes and goes.
    at = F.array(F.struct(F.greatest(F.col("pos") - F.col("size") + F.col("k"), F.lit(0)).alias("s"), F.col("weight").alias("w")), F.struct((F.col("pos") + 1).alias("s"), (-F.col("weight")).alias("w")))
    events = hits.select("text", "item", "size", "n", F.explode(at).alias("e")).groupBy("text", "item", "size", "n", F.col("e.s").alias("s")).agg(F.sum("e.w").alias("w"))
    by = Window.partitionBy("text", "item").orderBy("s")
    events = events.withColumn("held", F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("next", F.lead("s").over(by))
    events = events.join(small(item_sets.select("item", "mass"), n_items), "item").where(F.col("held") >= SIMILARITY * F.col("mass") - 1e-5)
    last = F.least(F.col("next") - 1, F.greatest(F.col("n") - F.col("size"), F.lit(0)))
    begin = F.least("s", last)
    laid = stage.put(events.select("text", "size", "item", F.explode(F.sequence(begin, last)).alias("start")).distinct())

    cut = stage.put(laid.select("text", "size", "start").distinct().join(held.select("text", "words"), "text").select("text", "start", "size", F.slice("words", F.col("start") + 1, F.col("size")).alias("words")))
    grams_of = lambda df, k: df.where(F.size("words") >= k).where(F.col("size") >= k if k == SHINGLE else F.col("size") == k).withColumn("grams", grams(F.col("words"), k))
    window_sets = fingerprints(weighted(every(lambda k: grams_of(cut, k).select(*SPOT, F.explode("grams").alias("h")))), *SPOT)
    near = candidates(window_sets, laid, item_sets, n_items)
    near = near.where(F.bit_count(F.col("simhash").bitwiseXOR(F.col("item_hash"))) <= RADIUS)
    # A pair meets in several blocks: it counts in the lowest block on which both agree.
    mine, theirs = _blocks(F.col("simhash")), _blocks(F.col("item_hash"))
    near = stage.put(near.where(F.col("block") == F.array_min(F.array_intersect(mine, theirs))).select(*SPOT, "item", "k", "mass", "item_mass"))

    shared = every(lambda k: grams_of(cut.join(near.where(F.col("k") == k).withColumnRenamed("k", "near_k"), list(SPOT)), k).select(*SPOT, "item", "mass", "item_mass", F.explode("grams").alias("h")))
    both = shared.join(small(rows.select("item", "h", "weight"), 2 * n_rows), ["item", "h"]).groupBy(*SPOT, "item", "mass", "item_mass").agg(F.sum("weight").alias("both"))
    close = both.withColumn("similarity", F.round(F.col("both") / (F.col("mass") + F.col("item_mass") - F.col("both")), 6)).where(F.col("similarity") >= SIMILARITY)
    best = close.groupBy("text", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "size")).alias("m"))
    best = best.join(texts, "text").join(named.select("item_id", "item"), "item").groupBy("doc_id", "item_id").agg(F.max("m").alias("m"))
    return stage.result(best.select("doc_id", "item_id", (-F.col("m.s")).alias("start"), F.col("m.size").alias("size"), F.col("m.similarity").alias("similarity")))
