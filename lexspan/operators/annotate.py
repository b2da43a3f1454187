"""Annotations of tokens by an injected provider, and the vocabulary drawn from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("lemma", "pos", "tag", "feats")
# The classes a provider may give, those outside the vocabulary, and the limits of one document.
CLASSES = "ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X SPACE".split()
NOT_WORDS = ["PUNCT", "SYM"]
MOST_CHARS, MOST_TOKENS = 50_000, 10_000
SCHEMA = "doc_id long, ord int, token string, lemma string, pos string, tag string, feats string"


def annotate(tokens: DataFrame, provider: Callable[[], Callable[[list[str]], list[tuple]]]) -> DataFrame:
    """tokens: doc_id, ord, token. provider() is made once a worker and gives (lemma, pos, tag, feats) for each token of
    a document; another number of tokens is an error, not a shorter result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for batch in batches:
            rows = []
            for doc_id, words in zip(batch["doc_id"], batch["words"]):
                words = list(words)
                found = model(words)
                if len(found) != len(words):
                    raise ValueError(f"document {doc_id}: {len(found)} annotations for {len(words)} tokens")
                rows += [(doc_id, k, w, *a) for k, (w, a) in enumerate(zip(words, found))]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "token", *FIELDS])

    words = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "token"))).alias("t")).select("doc_id", F.col("t.token").alias("words"))
    return words.mapInPandas(run, SCHEMA)


def formula(length: Column, ord_: Column) -> dict[str, Column]:
    """A stand-in for a model: annotations from a token's length and place, marked as simulated by whoever stores them."""
    pick = lambda values, key: F.element_at(F.array(*(F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))
    return {
        "pos": pick(["NOUN", "VERB", "ADV", "DET", "AUX", "ADJ", "ADP"], length),
        "dep": pick(["nsubj", "obj", "advmod", "aux", "xcomp", "conj", "cop", "mark"], length + ord_),
    }


def cleaned(rows: DataFrame) -> DataFrame:
    """An empty value is a missing one."""
    return rows.select("doc_id", "ord", "token", *(F.nullif(F.col(c), F.lit("")).alias(c) for c in FIELDS))


def unresolved(*fields: str) -> Column:
    """Names of the fields that are missing, in the given order."""
    return F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in fields)), lambda x: x.isNotNull())


def vocabulary(rows: DataFrame, *keys: str) -> DataFrame:
    """Groups by lemma and class; by literal form and class where the lemma is missing. rows: keys, ord, token, lemma, pos.

    Groups are numbered in order of first appearance, forms likewise. Counts are summed per form first, so that a
    frequent word's rows shrink before they are shuffled.
    """
    rows = rows.where(~F.coalesce(F.col("pos"), F.lit("")).isin(NOT_WORDS))
    by = F.when(F.col("lemma").isNull(), "form").otherwise("lemma")
    rows = rows.select(*keys, "ord", "token", by.alias("criterion"), F.coalesce("lemma", "token").alias("key"), "pos")
    forms = rows.groupBy(*keys, "criterion", "key", "pos", "token").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    groups = forms.groupBy(*keys, "criterion", "key", "pos").agg(F.sum("n").alias("occurrences"), F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("first", "token"))).alias("f"))
    order = Window.partitionBy(*keys).orderBy("first", "criterion", "key", "pos")
    return groups.select(*keys, (F.row_number().over(order) - 1).alias("rank"), "criterion", "key", "pos", "occurrences", "first", F.array_join("f.token", "|").alias("forms"))


def vocabulary_tokens(rows: DataFrame, *keys: str) -> DataFrame:
    """The tokens of each group of `vocabulary` in order: keys, criterion, key, pos, tokens. By document, so that a list
    is no longer than a document."""
    rows = rows.where(~F.coalesce(F.col("pos"), F.lit("")).isin(NOT_WORDS))
    by = F.when(F.col("lemma").isNull(), "form").otherwise("lemma")
    return rows.groupBy(*keys, by.alias("criterion"), F.coalesce("lemma", "token").alias("key"), "pos").agg(F.array_sort(F.collect_list("ord")).alias("tokens"))


#: What a parser gives for a document: the head (ord) and label of each token, and entities (first and last ord, label).
Parser = Callable[[list[dict]], tuple[list[int], list[str], list[tuple[int, int, str]]]]
#: Documents whose tokens a parser's worker holds at once.
AT_ONCE = 64
_PARSE = "doc_id long, trees array<struct<ord:int,head:int,dep:string>>, entities array<struct<first_token:int,last_token:int,label:string>>"


def parsed(tokens: DataFrame, provider: Callable[[], Parser]) -> DataFrame:
    """tokens: doc_id, period, ord, token and the inherited annotations. provider() is made once a worker and is given a
    document's tokens as dicts, one document at a time; a wrong number of heads or a head or entity outside the document is an error. The
    inherited columns never pass through the provider: `trees` joins its heads to them. (doc_id, trees, entities)"""
    fields = [c for c in tokens.columns if c != "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = provider()
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                yield some(parse, batch.slice(k, AT_ONCE))

    def some(parse: Parser, batch: pa.RecordBatch) -> pa.RecordBatch:
        trees, named, to_trees, to_named = ([], [], []), ([], [], []), [0], [0]
        for doc_id, words in zip(batch.column("doc_id").to_pylist(), batch.column("t")):
            columns = [words.values.field(k).to_pylist() for k in range(len(names))]
            ords = columns[0]
            heads, labels, entities = parse([dict(zip(names, w)) for w in zip(*columns)])
            if len(heads) != len(ords) or len(labels) != len(ords):
                raise ValueError(f"document {doc_id}: {len(heads)} heads and {len(labels)} labels for {len(ords)} tokens")
            known = set(ords)
            if not known.issuperset(heads) or any(a not in known or b not in known or a > b for a, b, _ in entities):
                raise ValueError(f"document {doc_id}: a head or entity outside its tokens")
            for held, more in zip((*trees, *named), (ords, heads, labels, *([x[k] for x in entities] for k in range(3)))):
                held.extend(more)
            to_trees.append(len(trees[0]))
            to_named.append(len(named[0]))
        nested = lambda ends, kind, columns: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, kind[k].type) for k, c in enumerate(columns)], fields=list(kind)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), nested(to_trees, tree, trees), nested(to_named, entity, named)], schema=schema)

    names = ["ord", *(c for c in fields if c != "ord")]
    tree = pa.struct([("ord", pa.int32()), ("head", pa.int32()), ("dep", pa.string())])
    entity = pa.struct([("first_token", pa.int32()), ("last_token", pa.int32()), ("label", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("trees", pa.list_(tree)), ("entities", pa.list_(entity))])
    conf, rows = tokens.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf.set(rows, str(min(int(conf.get(rows)), AT_ONCE) if int(conf.get(rows)) > 0 else AT_ONCE))
    grouped = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("t"))
    return grouped.mapInArrow(run, _PARSE)


def trees(tokens: DataFrame, parses: DataFrame) -> DataFrame:
    """Tokens with their inherited annotations, head and dep."""
    found = parses.select("doc_id", F.explode("trees").alias("x")).select("doc_id", "x.ord", "x.head", "x.dep")
    return tokens.join(found, ["doc_id", "ord"])


def entities(tokens: DataFrame, parses: DataFrame) -> DataFrame:
    """doc_id, entity (number), label, first_token, last_token, tokens, start_pos, end_pos, first_start, last_end, periods."""
    named = parses.select("doc_id", F.posexplode("entities").alias("entity", "x")).select("doc_id", "entity", "x.label", "x.first_token", "x.last_token")
    inside = named.select("*", F.explode(F.sequence("first_token", "last_token")).alias("ord")).join(tokens.select("doc_id", "ord", "period", "start_pos", "end_pos"), ["doc_id", "ord"])
    out = inside.groupBy("doc_id", "entity", "label", "first_token", "last_token").agg(F.count("*").alias("tokens"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count_distinct("period").alias("periods"))
    return out.withColumn("first_start", F.col("start_pos")).withColumn("last_end", F.col("end_pos"))


def parse_report(tokens: DataFrame, parses: DataFrame) -> DataFrame:
    """(doc_id, tokens, parsed, periods, entities)."""
    n = tokens.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count_distinct("period").alias("periods"))
    found = parses.select("doc_id", F.size("trees").alias("parsed"), F.size("entities").alias("entities"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(found, "doc_id", "left").select("doc_id", "tokens", zero("parsed"), "periods", zero("entities"))


def coverage(rows: DataFrame, *keys: str) -> DataFrame:
    missing = [F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in FIELDS]
    return rows.groupBy(*keys).agg(F.count("*").alias("tokens"), *missing, F.sum(F.size(unresolved(*FIELDS))).alias("pendings"))


def violations(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, ord, check): tokens without annotation, annotations without token, changed forms, unknown classes."""
    both = tokens.select("doc_id", "ord", F.col("token").alias("mine"), F.lit(True).alias("here")).join(rows.select("doc_id", "ord", "token", "pos", F.lit(True).alias("there")), ["doc_id", "ord"], "full_outer")
    check = F.when(F.col("there").isNull(), "missing").when(F.col("here").isNull(), "surplus").when(F.col("mine") != F.col("token"), "form").when(~F.col("pos").isin(CLASSES), "class")
    return both.select("doc_id", "ord", check.alias("check")).where("check is not null")


def over_limits(docs: DataFrame, tokens: DataFrame, chars: int = MOST_CHARS, most: int = MOST_TOKENS) -> DataFrame:
    n = tokens.groupBy("doc_id").agg(F.count("*").alias("tokens"))
    rows = docs.select("doc_id", F.length("text").cast("long").alias("chars")).join(n, "doc_id", "left").select("doc_id", "chars", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    return rows.where((F.col("chars") > chars) | (F.col("tokens") > most))


def entity_violations(entities: DataFrame) -> DataFrame:
    """entities: doc_id, entity, first_token, last_token, tokens, start_pos, end_pos, first_start, last_end, periods."""
    order = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos")
    rows = entities.withColumn("before", F.lag("end_pos").over(order))
    checks = {"overlap": F.col("before") > F.col("start_pos"), "gap": F.col("last_token") - F.col("first_token") + 1 != F.col("tokens"), "bounds": (F.col("start_pos") != F.col("first_start")) | (F.col("end_pos") != F.col("last_end")), "period": F.col("periods") != 1}
    found = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in checks.items())), lambda x: x.isNotNull())
    return rows.select("doc_id", "entity", F.explode(found).alias("check"))
