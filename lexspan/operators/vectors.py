"""Vectorization: targets, budgeted chunks, content-addressed artifacts, weighted means, codec and cache."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.text import canonical, cut, sha256
from . import scan
from .segment import with_text

# Limits of one run and of the cache, and tolerances of a unit norm.
MOST = {"representations": 25_000, "blocks": 50_000, "tokens": 2_000_000, "vector_bytes": 256 * 1024 * 1024, "chars": 32 * 1024 * 1024}
CACHE_ROWS, CACHE_BYTES = 2000, 32 * 1024 * 1024
UNIT, CORPUS_UNIT = 1e-5, 2e-5
#: Start, prefix and end beside a text's own tokens, one token a code point: the deterministic test tokenizer.
OVERHEAD = 3
PROFILES = {"retrieval": "passage: ", "similarity": "query: ", "query": "query: "}


def configuration(profile: str = "retrieval", max_tokens: int | None = None, batch: int = 4, aggregate: bool = True, model_limit: int = 512) -> dict:
    most = min(512, model_limit) if max_tokens is None else max_tokens
    if profile not in PROFILES or type(most) is not int or not 8 <= most <= model_limit or type(batch) is not int or not 1 <= batch <= 1024 or type(aggregate) is not bool:
        raise ValueError("unknown profile, or a budget, batch size or flag out of range")
    return {"aggregate": aggregate, "batch": batch, "max_tokens": most, "prefix": PROFILES[profile], "profile": profile}


def targets(units: DataFrame, paragraphs: DataFrame, docs: DataFrame) -> DataFrame:
    """Focus and window of each unit in turn, then paragraphs, then the document: doc_id, ord, kind, start_pos, end_pos."""
    rows = units.select("doc_id", F.explode(_of_unit()).alias("t"))
    return _numbered(rows.unionByName(paragraphs.select("doc_id", _target(1, F.col("paragraph"), "paragraph", "start_pos", "end_pos").alias("t"))), docs)


def targets_in(units: DataFrame, docs: DataFrame) -> DataFrame:
    """As `targets`, with the paragraphs of the units themselves, which the first unit of each brings along."""
    whole = Window.partitionBy("doc_id", "paragraph").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = units.withColumns({"first": F.min("period").over(whole), "p_start": F.min("start_pos").over(whole), "p_end": F.max("end_pos").over(whole)})
    paragraph = F.when(F.col("first") == F.col("period"), F.array(_target(1, F.col("paragraph"), "paragraph", "p_start", "p_end")))
    every = F.when(paragraph.isNull(), _of_unit()).otherwise(F.concat(_of_unit(), paragraph))
    return _numbered(rows.select("doc_id", F.explode(every).alias("t")), docs)


def _target(part: int, place: Column, kind: str, a: str, b: str) -> Column:
    return F.struct(F.lit(part).alias("part"), place.cast("long").alias("place"), F.lit(kind).alias("kind"), F.col(a).cast("long").alias("start_pos"), F.col(b).cast("long").alias("end_pos"))


def _of_unit() -> Column:
    return F.array(_target(0, 2 * F.col("period"), "focus", "start_pos", "end_pos"), _target(0, 2 * F.col("period") + 1, "window", "window_start", "window_end"))


def _numbered(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Targets of units and paragraphs with the documents' own behind them, numbered."""
    whole = docs.where("text is not null").select("doc_id", F.lit(0).alias("zero"), F.length("text").alias("chars"))
    rows = rows.unionByName(whole.select("doc_id", _target(2, F.lit(0), "document", "zero", "chars").alias("t"))).select("doc_id", "t.*")
    order = Window.partitionBy("doc_id").orderBy("part", "place")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("ord"), "kind", "start_pos", "end_pos")


def cuts(targets_: DataFrame, docs: DataFrame, max_tokens: int) -> DataFrame:
    """(doc_id, ord, kind, cuts): each target's blocks in its row, none of a blank text. One walk over the text cuts them
    all; a block by its place would walk the text, and carry it along, once for each block."""
    room = max_tokens - OVERHEAD
    every = F.regexp_extract_all("literal", F.lit(rf"(?s)(.{{1,{room}}})"), F.lit(1))
    return with_text(targets_, docs).select("doc_id", "ord", "kind", F.when(F.col("literal").rlike(r"\S"), every).otherwise(F.array().cast("array<string>")).alias("cuts"))


def chunks(targets_: DataFrame, docs: DataFrame, max_tokens: int) -> DataFrame:
    """Blocks of a tokenizer of one token a code point: greedy maximal prefixes have a closed form. Blank texts have none.
    weight: tokens of content, i.e. code points that are not white space."""
    rows = cuts(targets_, docs, max_tokens).select("doc_id", "ord", "kind", F.posexplode("cuts").alias("block", "block_text"))
    rows = rows.withColumn("at", F.col("block") * (max_tokens - OVERHEAD))
    weight = F.length(F.regexp_replace("block_text", r"\s", ""))
    return rows.select("doc_id", "ord", "kind", "block", F.col("at").cast("long").alias("start_pos"), (F.col("at") + F.length("block_text")).cast("long").alias("end_pos"), (F.length("block_text") + OVERHEAD).cast("long").alias("tokens"), weight.cast("long").alias("weight"), "block_text")


def split_by(tokens_of: Callable[[str], int], max_tokens: int) -> Callable[[str], list[tuple[int, int]]]:
    """Greedy maximal prefixes for any tokenizer: tokens_of counts a text's tokens with prefix and specials. Growth by
    doubling and then bisection, so a block costs O(log n) counts."""

    def split(text: str) -> list[tuple[int, int]]:
        out, at = [], 0
        if not text.strip():
            return out
        while at < len(text):
            good, step = at, max_tokens
            while good < len(text):
                end = min(len(text), good + step)
                if tokens_of(text[at:end]) <= max_tokens:
                    good, step = end, 2 * step
                else:
                    low, high = good, end
                    while high - low > 1:
                        mid = (low + high) // 2
                        low, high = (mid, high) if tokens_of(text[at:mid]) <= max_tokens else (low, mid)
                    good = low
                    break
            if good == at:
                raise ValueError("one code point exceeds the budget")
            out.append((at, good))
            at = good
        return out

    return split


def chunks_by(targets_: DataFrame, docs: DataFrame, count: Callable[[], Callable[[str], int]], max_tokens: int) -> DataFrame:
    """As `chunks`, with an injected tokenizer made once a worker."""
    rows = with_text(targets_, docs).select("doc_id", "ord", "kind", F.col("literal").alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens_of = count()
        split = split_by(tokens_of, max_tokens)
        for batch in batches:
            out = [(d, o, k, i, a, b, tokens_of(t[a:b]), t[a:b]) for d, o, k, t in zip(batch["doc_id"], batch["ord"], batch["kind"], batch["content"]) for i, (a, b) in enumerate(split(t))]
            yield pd.DataFrame(out, columns=["doc_id", "ord", "kind", "block", "start_pos", "end_pos", "tokens", "block_text"])

    return rows.mapInPandas(run, "doc_id long, ord int, kind string, block int, start_pos long, end_pos long, tokens long, block_text string")


def artifact_id(text: Column, prefix: str, max_tokens: int) -> Column:
    """Identity of a model's input by its content."""
    return sha256(canonical(F.struct(sha256(F.concat(F.lit(prefix), text)).alias("input"), F.lit(max_tokens).alias("max_tokens"), F.lit("1.0.0").alias("version"))))


def distinct_inputs(blocks: DataFrame) -> DataFrame:
    """blocks with artifact. Each input once, with its first user: (artifact, uses, doc_id, ord, block)."""
    first = F.min(F.struct("doc_id", "ord", "block")).alias("f")
    return blocks.groupBy("artifact").agg(F.count("*").alias("uses"), first).select("artifact", "uses", "f.doc_id", "f.ord", "f.block")


def cache_split(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """Which inputs a cache holds already. Where both sides have `input` (the canonical input itself, or its digest), an
    artifact counts as held only if its input is the same: an equal name alone is not trusted."""
    keys = ["artifact", *(["input"] if "input" in inputs.columns and "input" in cache.columns else [])]
    known = cache.select(*keys).distinct().withColumn("known", F.lit(True))
    return inputs.join(known, keys, "left").withColumn("origin", F.when(F.col("known"), "reused").otherwise("generated")).drop("known")


def embed(inputs: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "block_text", batch: int = 4) -> DataFrame:
    """inputs: artifact and a text column. The model is made once a worker and called with `batch` texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = model()
        for rows in batches:
            for i in range(0, len(rows), batch):
                some = rows.iloc[i : i + batch]
                found = np.asarray(encode(list(some[text])), np.float32)
                if len(found) != len(some):
                    raise ValueError("a model gives one vector for each input")
                yield pd.DataFrame({"artifact": some["artifact"].to_numpy(), "vector": list(found)})

    return inputs.select("artifact", text).mapInPandas(run, "artifact string, vector array<float>")


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def norm_violations(vectors: DataFrame, tolerance: float = UNIT) -> DataFrame:
    """vectors: id, vector. Rows whose vector is empty, not finite or not of unit length."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where((F.size("vector") == 0) | bad | (F.abs(norm(F.col("vector")) - 1) > tolerance)).select("id")


def mean_pooled(states: DataFrame) -> DataFrame:
    """states: id, position, used, state (array). Mean over the used positions, then unit length."""
    rows = states.where("used").select("id", F.posexplode("state").alias("dim", "v"))
    means = rows.groupBy("id", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return _unit(means, "id")


#: An exact sum is kept as LIMBS whole numbers, each worth 2^-GRID of the one before: all multiples of 2^-150, which
#: holds every product of a float32 and a whole number.
GRID, LIMBS = 30, 6


def limbs(x: Column) -> list[Column]:
    """A double as whole numbers; every step is exact. A double that is no multiple of the last one's worth is an error."""
    out, rest = [], x.cast("double")
    for k in range(LIMBS):
        whole = rest.cast("long")  # towards zero, so that the rest keeps its sign and all its bits
        out.append(whole)
        rest = (rest - whole) * (1.0 if k == LIMBS - 1 else float(1 << GRID))
    out[-1] = F.when(rest == 0, out[-1]).otherwise(F.raise_error(F.lit("a number is too small for an exact sum")).cast("long"))
    return out


def exact_sums(rows: DataFrame, x: Column, *keys: str) -> DataFrame:
    """(keys, limbs): the sum of a double, exact and so the same in any order. Limbs are added as whole numbers, partly
    before the shuffle; `as_integer` and `rounded` read them."""
    return rows.groupBy(*keys).agg(F.array(*(F.sum(n) for n in limbs(x))).alias("limbs"))


def as_integer(sums: Column, bits: int = 80) -> Column:
    """An exact sum times 2^bits, as a decimal; limbs below 2^-bits must be nothing."""
    worth = lambda k: F.lit(str(1 << (bits - GRID * k))).cast("decimal(25,0)")
    parts = [F.get(sums, k).cast("decimal(13,0)") * worth(k) for k in range(bits // GRID + 1)]
    rest = [F.get(sums, k) for k in range(bits // GRID + 1, LIMBS)]
    clean = reduce(lambda a, b: a & b, (r == 0 for r in rest))
    return F.when(clean, reduce(lambda a, b: a + b, parts)).otherwise(F.raise_error(F.lit("bits below the scale")).cast("decimal(38,0)"))


def rounded(sums: list[int]) -> float:
    """The double nearest to an exact sum: rounded once."""
    total = 0
    for n in sums:
        total = (total << GRID) + int(n)
    return total / (1 << (GRID * (LIMBS - 1)))


def _unit_means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A vector for each row of exact sums (by dimension) and their weight: mean, then unit length, each sum rounded once."""
    for batch in batches:
        vectors_ = []
        for sums, total in zip(batch["sums"], batch["total"]):
            means = [rounded(s) / total for s in sums]
            length = math.sqrt(math.fsum(m * m for m in means))
            if not (length > 0 and math.isfinite(length)):
                raise ValueError("a mean vector has no length")
            vectors_.append([m / length for m in means])
        yield batch.drop(columns=["sums", "total"]).assign(vector=vectors_)


def weighted_mean(blocks: DataFrame, *ids: str) -> DataFrame:
    """blocks: ids, weight (whole numbers), vector (float32). Sum of weight * vector over the sum of weights, then unit
    length. Sums are exact, so a representation's vector has the same bits however its blocks are dealt; blocks without
    weight take no part."""
    rows = blocks.where("weight > 0").select(*ids, F.col("weight").cast("long").alias("weight"), F.posexplode("vector").alias("dim", "v"))
    rows = rows.withColumn("product", F.col("weight").cast("double") * F.col("v").cast("double"))
    sums = rows.groupBy(*ids, "dim").agg(F.array(*(F.sum(n) for n in limbs(F.col("product")))).alias("limbs"), F.sum("weight").alias("total"))
    grouped = sums.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("dim", "limbs"))).alias("d"), F.max("total").alias("total")).select(*ids, F.col("d.limbs").alias("sums"), "total")
    schema = StructType([*(f for f in grouped.schema.fields if f.name in ids), StructField("vector", ArrayType(DoubleType()))])
    return grouped.mapInPandas(_unit_means, schema)


def _unit(means: DataFrame, *ids: str) -> DataFrame:
    grouped = means.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("d"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    return grouped.select(*ids, F.when(F.col("length") > 0, F.transform("d.v", lambda x: x / F.col("length"))).otherwise(F.raise_error(F.lit("a mean vector has no length")).cast("array<double>")).alias("vector"))


def construction(blocks: DataFrame, targets_: DataFrame, aggregate: bool = True) -> DataFrame:
    """How a representation's vector comes about; several blocks are `aggregated` even if one alone has content."""
    n = blocks.groupBy("doc_id", "ord").agg(F.count("*").alias("blocks"), F.sum("weight").alias("weight"))
    rows = targets_.select("doc_id", "ord", "kind").join(n, ["doc_id", "ord"], "left")
    return _constructed(rows.withColumn("blocks", F.coalesce("blocks", F.lit(0))), aggregate)


def construction_of(cuts_: DataFrame, aggregate: bool = True) -> DataFrame:
    """As `construction`, from targets that hold their blocks (see `cuts`)."""
    return _constructed(cuts_.select("doc_id", "ord", "kind", F.size("cuts").cast("long").alias("blocks")), aggregate)


def _constructed(rows: DataFrame, aggregate: bool) -> DataFrame:
    label = F.when(F.col("blocks") == 0, "no_content").when(F.col("blocks") == 1, "direct").otherwise("aggregated" if aggregate else "blocks")
    return rows.select("doc_id", "ord", "kind", "blocks", label.alias("construction"))


def over_limits(blocks: DataFrame, dims: int = 64) -> DataFrame:
    """What a run would make, before inference, against the limits."""
    out = blocks.agg(F.count_distinct("doc_id", "ord").alias("representations"), F.count("*").alias("blocks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.length("block_text")), F.lit(0)).cast("long").alias("chars"))
    fits = (F.col("representations") <= MOST["representations"]) & (F.col("blocks") <= MOST["blocks"]) & (F.col("tokens") <= MOST["tokens"]) & (F.col("blocks") * 4 * dims <= MOST["vector_bytes"]) & (F.col("chars") <= MOST["chars"])
    return out.withColumn("allowed", fits)


def within_limits(blocks: DataFrame, dims: int = 64) -> DataFrame:
    """The blocks, or an error that names what a run over them would exceed: known before a model is asked, and nothing is
    left out. One aggregation over the blocks, whose only row is looked at."""
    cost = over_limits(blocks, dims).first()
    if not cost["allowed"]:
        made = cost.asDict() | {"vector_bytes": cost["blocks"] * 4 * dims}
        raise ValueError("a run would exceed its limits: " + ", ".join(f"{made[k]} {k} of {most}" for k, most in MOST.items() if k in made and made[k] > most))
    return blocks


def content_tokens(inputs: DataFrame) -> Column:
    """How many tokens of an input stand for content: no special ones, behind the prefix, over something not blank."""
    every = F.arrays_zip(F.col("starts").alias("a"), F.col("ends").alias("b"), F.col("special").alias("s"))
    behind = lambda x: F.greatest(x["a"], F.length("prefix"))
    return F.size(F.filter(every, lambda x: (x["s"] == 0) & (x["b"] > x["a"]) & (x["b"] > F.length("prefix")) & cut(F.concat("prefix", "text"), behind(x).cast("int"), x["b"].cast("int")).rlike(r"\S")))


def input_violations(inputs: DataFrame) -> DataFrame:
    """inputs: id, prefix, text, ids, starts, ends (offsets in prefix and text), special (0 or 1). (id, check): ids out of
    range, lists of different lengths, offsets outside the input or out of order, special tokens with an offset, a text
    with content but without a token for it. Only the first of the checks that an input fails is named."""
    n, whole = F.size("ids"), F.length("prefix") + F.length("text")
    uneven = (n == 0) | (F.size("starts") != n) | (F.size("ends") != n) | (F.size("special") != n)
    pairs = F.arrays_zip(F.col("starts").alias("a"), F.col("ends").alias("b"), F.col("special").alias("s"))
    real = F.transform(F.filter(pairs, lambda x: (x["s"] == 0) & (x["b"] > x["a"])), lambda x: x["a"])
    check = (
        F.when(F.exists("ids", lambda x: x.isNull() | (x < 0)), "ids").when(uneven, "lengths").when(F.exists("special", lambda x: ~x.isin(0, 1)), "mask")
        .when(F.exists(pairs, lambda x: (x["a"] < 0) | (x["b"] < x["a"]) | (x["b"] > whole)), "outside").when(F.exists(pairs, lambda x: (x["s"] == 1) & ((x["a"] != 0) | (x["b"] != 0))), "special")
        .when(real != F.array_sort(real), "order").when(F.col("text").rlike(r"\S") & (content_tokens(inputs) == 0), "no_content")
    )
    return inputs.select("id", check.alias("check")).where("check is not null")


def run_violations(docs: DataFrame, targets_: DataFrame, blocks: DataFrame, artifacts: DataFrame, representations: DataFrame, prefix: str, max_tokens: int, tolerance: float = 1e-6) -> DataFrame:
    """A recorded run against its sources, without a model: (subject, check).

    blocks: doc_id, ord, block, start_pos, end_pos, tokens, weight, block_text, artifact (null without content);
    artifacts: artifact, vector; representations: doc_id, ord, vector. Blocks are compared with the text that they name;
    artifacts with the identity of that text; vectors with the weighted mean of the blocks' vectors where those are sound.
    """
    spot, text = F.concat_ws(":", "doc_id", "ord"), with_text(targets_.select("doc_id", "ord", "start_pos", "end_pos"), docs).select("doc_id", "ord", "literal")
    order = Window.partitionBy("doc_id", "ord").orderBy("start_pos", "block")
    rows = blocks.join(text, ["doc_id", "ord"], "left").withColumn("true_text", cut(F.col("literal"), F.col("start_pos").cast("int"), F.col("end_pos").cast("int")))
    rows = rows.withColumn("before", F.lag("end_pos", 1, 0).over(order)).withColumn("true_weight", F.length(F.regexp_replace("true_text", r"\s", "")))
    rows = rows.withColumn("true_artifact", F.when(F.col("true_weight") > 0, artifact_id(F.col("true_text"), prefix, max_tokens)))
    rows = rows.withColumn("held", F.lit(True))
    faults = {"text": ~F.col("block_text").eqNullSafe(F.col("true_text")), "budget": F.col("tokens") > max_tokens, "weight": F.col("weight") != F.col("true_weight"), "identity": ~F.col("artifact").eqNullSafe(F.col("true_artifact"))}
    found = F.filter(F.array(*(F.when(F.coalesce(v, F.lit(True)), F.lit(k)) for k, v in faults.items())), lambda x: x.isNotNull())
    named = rows.select(spot.alias("subject"), F.explode(found).alias("check"))
    covers = rows.groupBy("doc_id", "ord").agg(F.bool_and(F.col("start_pos") == F.col("before")).alias("even"), F.max("end_pos").alias("end"))
    covers = text.join(covers, ["doc_id", "ord"], "left").withColumn("whole", F.when(F.col("end").isNull(), ~F.col("literal").rlike(r"\S")).otherwise(F.col("even") & (F.col("end") == F.length("literal"))))
    parts = [named, covers.where("not whole").select(spot.alias("subject"), F.lit("cover").alias("check"))]
    sound = artifacts.withColumn("bad", (F.abs(norm(F.col("vector")) - 1) > UNIT) | (F.size("vector") == 0))
    of = lambda df, check: df.select(F.col("artifact").alias("subject"), F.lit(check).alias("check"))
    used = rows.where("true_artifact is not null").select(F.col("true_artifact").alias("artifact")).distinct()
    parts += [of(sound.where("bad"), "norm"), of(used.join(artifacts, "artifact", "left_anti"), "missing_artifact"), of(artifacts.select("artifact").join(used, "artifact", "left_anti"), "unused_artifact"), of(artifacts.groupBy("artifact").count().where("count > 1"), "repeated_artifact")]
    weighed = rows.where("true_weight > 0").join(sound.dropDuplicates(["artifact"]).withColumnRenamed("artifact", "true_artifact"), "true_artifact", "left").join(covers.where("whole").select("doc_id", "ord"), ["doc_id", "ord"], "left_semi")
    whole = weighed.groupBy("doc_id", "ord").agg(F.bool_and(F.col("vector").isNotNull() & ~F.col("bad")).alias("ok")).where("ok").select("doc_id", "ord")
    means = weighted_mean(weighed.join(whole, ["doc_id", "ord"], "left_semi").select("doc_id", "ord", F.col("true_weight").alias("weight"), "vector"), "doc_id", "ord").withColumnRenamed("vector", "mean")
    far = F.exists(F.zip_with("vector", "mean", lambda a, b: F.abs(a.cast("double") - b)), lambda d: d > tolerance)
    compared = means.join(representations, ["doc_id", "ord"], "left")
    parts.append(compared.where(F.col("vector").isNull() | (F.size("vector") != F.size("mean")) | far).select(spot.alias("subject"), F.lit("vector").alias("check")))
    empty = text.where(~F.col("literal").rlike(r"\S")).select("doc_id", "ord")
    parts.append(representations.where("vector is not null").join(empty, ["doc_id", "ord"], "left_semi").select(spot.alias("subject"), F.lit("surplus").alias("check")))
    return reduce(DataFrame.unionByName, parts).distinct()


def representation(representations: DataFrame, doc_id: int, ord_: int) -> DataFrame:
    """One representation by its id; none is an empty result."""
    return representations.where((F.col("doc_id") == doc_id) & (F.col("ord") == ord_))


def cached(store: DataFrame, rows: int = CACHE_ROWS, most: int = CACHE_BYTES, *partition: str) -> DataFrame:
    """store: partition columns, seq, logical_id, size. Newest first until a row or byte budget is first exceeded, then
    the newest of each logical id. Without partition columns the store has one budget, kept by a scan over ranges of seq
    (which tells all rows apart): ranges beyond the budget are not read again, and no task sees more than a range."""
    if not partition:
        counted = store.select("seq", "logical_id", "size", F.lit(1).alias("one"))
        kept = scan.running(counted, [F.desc("seq")], {"bytes": "size", "n": "one"}, {"bytes": most, "n": rows})
        newest = kept.groupBy("logical_id").agg(F.max_by(F.struct("seq", "size"), "seq").alias("x"))
        return newest.select("x.seq", "logical_id", "x.size")
    newest = Window.partitionBy(*partition).orderBy(F.desc("seq"))
    upto = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = store.withColumn("bytes", F.sum("size").over(upto)).withColumn("n", F.row_number().over(newest)).where((F.col("bytes") <= most) & (F.col("n") <= rows))
    one = Window.partitionBy(*partition, "logical_id").orderBy(F.desc("seq"))
    return kept.withColumn("k", F.row_number().over(one)).where("k = 1").select(*partition, "seq", "logical_id", "size")


def compatibility(one: DataFrame, other: DataFrame) -> DataFrame:
    """(path, one, other) where two flattened profiles (path, value) differ."""
    rows = one.select("path", F.col("value").alias("one")).join(other.select("path", F.col("value").alias("other")), "path", "full_outer")
    return rows.where(~F.col("one").eqNullSafe(F.col("other")))


def flattened(profile: dict, path: str = "") -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for key in sorted(profile):
        value, at = profile[key], f"{path}.{key}" if path else key
        out += flattened(value, at) if isinstance(value, dict) else [(at, str(value))]
    return out


def report(splits: DataFrame, constructions: DataFrame, real: bool) -> DataFrame:
    made = splits.agg(F.count_if(F.col("origin") == "generated").alias("generated"), F.count_if(F.col("origin") == "reused").alias("reused"))
    empty = constructions.agg(F.count_if(F.col("construction") == "no_content").alias("no_content"))
    return made.crossJoin(empty).withColumn("ready", F.lit(real) & (F.col("generated") + F.col("reused") > 0))  # one row each


def encode(vector: list[float]) -> bytes:
    """Little-endian float32 bytes of a finite unit vector."""
    out = np.asarray(vector, "<f4")
    if not 1 <= len(out) <= 8192 or not np.isfinite(out).all() or abs(float(np.sqrt((out.astype(float) ** 2).sum())) - 1) > UNIT:
        raise ValueError("a vector is finite and of unit length")
    return out.tobytes()


def decode(raw: bytes) -> list[float]:
    if len(raw) % 4:
        raise ValueError("a vector's bytes come in fours")
    vector = list(struct.unpack(f"<{len(raw) // 4}f", raw))
    encode(vector)
    return vector


def schema_of(df: DataFrame) -> StructType:
    """The schema without nullability, for comparing recorded and recomputed tables."""
    return StructType([StructField(f.name, f.dataType, True) for f in df.schema.fields])
