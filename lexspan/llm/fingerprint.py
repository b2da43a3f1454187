"""Operator 7: document fingerprints from closed syncmers, in DataFrame operations only.

A text is cut into units: its words (split at white space), or its code points if the words are longer than LONG code
points on average, as in scripts without spaces. A k-mer of UNITS units is an anchor if the least hash among its inner
substrings of INNER units lies at its first or last place; that depends on the k-mer alone, so an edit moves no anchor
outside its reach, and two neighbouring anchors are at most UNITS - INNER units apart. The fingerprint holds all anchors
of the whole text in order: each has eight hex digits of its hash and two of its distance from the one before (of the
first, from the beginning). A text with fewer units than UNITS has its whole sequence as one anchor.

Texts are matched by position: a link is two neighbouring anchors and their distance, so it is shared only where anchors
follow one another at the same distance. Likeness is the Jaccard similarity of the sets of anchors and links of the two
whole texts, exact but for equal hashes; equal fingerprints have likeness 1, an empty one and another 0.

Null texts count as empty; an empty or blank text has an empty fingerprint. The next document is the one before in
ascending (doc_id, hash of the text, text); rows with a null doc_id come last, repeated rows follow one another, and a
single document follows itself. Rows are dealt by ranges of doc_id whose edges are quantiles, put together to about
equal bytes; an id that fills more than a range (null included) is dealt by hashes of its texts. The head of each range is handed to the range before, so that
no task sees more than its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bound

UNITS, INNER, LONG = 12, 2, 24
#: Quantiles of ids for each range, of which ranges of about equal bytes are made.
FINE = 8
#: Hashes of texts in an id that fills more than a range.
SPLIT = 1 << 20


def units(text: Column) -> Column:
    split = F.array_remove(F.split(text, r"\s+"), "")
    return bound(split, lambda w: F.when(F.length(text) > (LONG + 1) * F.size(w), F.array_remove(F.split(F.regexp_replace(text, r"\s+", ""), ""), "")).otherwise(w))


def short(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(0xFFFFFFFF))


def anchors(hashes: Column) -> Column:
    """The anchors (at, h) of a text in order, from its unit hashes; h has 32 bits."""
    at = lambda i, j: F.get(hashes, i + F.lit(j))
    inner = F.transform(F.sequence(F.lit(0), F.size(hashes) - INNER), lambda i: F.xxhash64(*(at(i, j) for j in range(INNER))))

    def closed(values: Column) -> Column:
        edge, last = lambda i, j: F.get(values, i + F.lit(j)), UNITS - INNER
        starts = F.sequence(F.lit(0), F.size(hashes) - UNITS)
        return F.filter(starts, lambda i: F.least(edge(i, 0), edge(i, last)) <= F.least(*(edge(i, j) for j in range(1, last))))

    found = F.transform(bound(inner, closed), lambda i: F.struct(i.alias("at"), short(F.xxhash64(*(at(i, j) for j in range(UNITS)))).alias("h")))
    whole = F.array(F.struct(F.lit(0).alias("at"), short(F.xxhash64(hashes)).alias("h")))
    return F.when(F.size(hashes) >= UNITS, found).when(F.size(hashes) > 0, whole).otherwise(F.slice(whole, 1, 0))


def text_anchors(text: Column) -> Column:
    return bound(F.transform(units(text), lambda w: F.xxhash64(w)), anchors)


def as_text(found: Column) -> Column:
    """The fingerprint of anchors in order."""
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    gap = lambda x, i: x["at"] - F.when(i > 0, F.get(found, i - 1)["at"]).otherwise(0)
    return F.array_join(F.transform(found, lambda x, i: F.concat(digits(x["h"], 8), digits(gap(x, i).cast("long"), 2))), "")


def parts(found: Column) -> Column:
    """The distinct anchors and links of a text."""
    links = F.transform(found, lambda x, i: F.when(i > 0, F.xxhash64(F.get(found, i - 1)["h"], x["h"], x["at"] - F.get(found, i - 1)["at"])))
    return F.array_distinct(F.concat(found["h"], F.filter(links, lambda x: x.isNotNull())))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of parts."""
    shared = bound(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared).cast("double")


def _ranged(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text, deal (a hash of the text), part (range), last (1 for the head of the range below, put behind the
    range's rows)."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    fine = FINE * n
    edges = {int(x) for x in docs.where("doc_id is not null").approxQuantile("doc_id", [i / fine for i in range(1, fine)], 1 / (4 * fine))} if n > 1 else set()
    # Ids that fill more than a range stand alone and are dealt on; there are at most n of them.
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("rows"))
    hot = counts.where(F.col("rows") > docs.count() / n).limit(n).collect()
    alone = {x for r in hot if r["doc_id"] is not None for x in (r["doc_id"] - 1, r["doc_id"])}
    number = lambda edges: F.size(F.filter(F.array(*(F.lit(x).cast("long") for x in sorted(edges))), lambda b: b < F.col("doc_id"))) if edges else F.lit(0)
    # Neighbouring fine ranges are put together until they hold a range's share of bytes.
    edges |= alone
    bytes_ = {r["p"]: r["bytes"] for r in docs.where("doc_id is not null").groupBy(number(edges).alias("p")).agg(F.sum(F.octet_length("text") + 64).alias("bytes")).collect()}  # at most FINE * n and a few rows
    share, held, wide = sum(bytes_.values()) / n, 0, set()
    for k, edge in enumerate(sorted(edges)):
        held += bytes_.get(k, 0)
        if held + bytes_.get(k + 1, 0) > share or edge in alone:
            wide.add(edge)
            held = 0
    edges = wide
    ids = spark.createDataFrame([(r["doc_id"], min(n, -(-r["rows"] * n // max(1, sum(x["rows"] for x in hot))))) for r in hot], "hot long, pieces int")
    part = F.when(F.col("doc_id").isNull(), -1).otherwise(number(edges))
    deal = F.pmod(F.xxhash64("text"), F.lit(SPLIT))
    rows = docs.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("hot")), "left").withColumn("deal", deal)  # at most n rows
    rows = rows.select("doc_id", "text", "deal", (part * F.lit(n + 1) + F.coalesce(F.floor(F.col("deal") * F.col("pieces") / SPLIT), F.lit(0))).cast("int").alias("part"), F.lit(0).alias("last"))
    tops = rows.groupBy("part").agg(F.max(F.struct("doc_id", "deal")).alias("top")).withColumnRenamed("part", "p")
    same = (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("deal") == F.col("top.deal"))
    heads = rows.join(F.broadcast(tops), same).groupBy("part").agg(F.max("text").alias("text"))  # tops has a row for each range, 6 * n at most
    below = Window.orderBy(F.desc("part"))
    around = heads.select(F.col("part"), F.coalesce(F.lead("text").over(below), F.first("text").over(below)).alias("text"))
    sentinels = around.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("deal"), "part", F.lit(1).alias("last"))
    return rows.unionByName(sentinels)


def fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    order = Window.partitionBy("part").orderBy("last", F.desc_nulls_last("doc_id"), F.desc("deal"), F.desc("text"))
    rows = _ranged(spark, docs.select("doc_id", "text")).withColumn("after", F.lead("text").over(order))
    # Anchors behind the exchange, so that only texts are shuffled.
    rows = rows.withColumn("own", text_anchors(F.col("text"))).withColumn("own_parts", parts(F.col("own")))
    rows = rows.withColumn("after_parts", F.lead("own_parts").over(order)).where("last = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("m", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.left("text", F.length("text") - F.col("m")), F.left("after", F.col("m")))
    rows = rows.select("doc_id", "n_chars", "own", "own_parts", "after_parts", edited.alias("edited"))
    rows = rows.withColumn("changed", text_anchors(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own_parts"), parts(F.col("changed"))).alias("near_edited"), likeness(F.col("own_parts"), F.col("after_parts")).alias("near_next"),
    )
