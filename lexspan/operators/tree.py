"""Dependency trees: checks, clause nuclei, owners, scopes and quoted regions.

A period's tree is an array in one row, so pointers are followed by doubling inside the row: log2(n) passes, no shuffle
beyond the one that gathers the period. Rows: doc_id, period, ord, token, lemma, pos, dep, head (ord of the head; its
own at the root), feats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, held, record
from .segment import with_text

# Fixed values.
VERBAL, HELPERS = ["VERB", "AUX"], ["aux", "cop"]
QUOTES = {"“": "”", "«": "»", "‘": "’", '"': '"', "'": "'"}


def base(dep: Column) -> Column:
    """Lower-cased label without its subtype."""
    return F.lower(F.split_part(dep, F.lit(":"), F.lit(1)))


def followed(start: Column) -> Column:
    """Where repeated steps lead: start[i] is the next index of i, or i itself where the walk ends."""
    passes = F.sequence(F.lit(1), F.ceil(F.log2(F.size(start) + 1)).cast("int") + 1)
    return F.aggregate(passes, start, lambda acc, _: F.transform(acc, lambda j: F.get(acc, j)))


def forests(rows: DataFrame, *more: str) -> DataFrame:
    """One row a period: t, its tokens in order (`more` names further columns of theirs), with h, the head as an index in
    the period (null if the head lies outside)."""
    fields = ["ord", *(c for c in ("token", "lemma", "pos", "dep", "head", "feats") if c in rows.columns), *more]
    grouped = rows.groupBy("doc_id", "period").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("t"))
    low = F.element_at("t", 1)["ord"]
    return grouped.select("doc_id", "period", "t", heads(F.col("t"), low).alias("h"), low.alias("low"))


def heads(t: Column, low: Column) -> Column:
    """The tokens' heads as indices in their period, whose first token is `low`; null if the head lies outside."""
    return F.transform(t, lambda x: F.when((x["head"] >= low) & (x["head"] < low + F.size(t)), x["head"] - low).cast("int"))


def _forests(rows: DataFrame) -> DataFrame:
    """Tokens as forests; what is one already stays as it is."""
    return rows if "t" in rows.columns else forests(rows)


def gathered(forests_: DataFrame) -> DataFrame:
    """One row a document: doc_id and ps, its periods in order, each as `forests` has it."""
    return forests_.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("period", "t", "h", "low"))).alias("ps"))


def spread(documents: DataFrame) -> DataFrame:
    """The tokens of gathered documents as rows: doc_id, period, and the tokens' own columns."""
    return documents.select("doc_id", F.inline("ps")).select("doc_id", "period", F.inline("t"))


def violations(rows: DataFrame) -> DataFrame:
    """(doc_id, period, check): roots other than one, a root that has a head, others that head themselves, heads outside
    the period, cycles. rows: tokens, or forests."""
    f = _forests(rows)
    up = F.transform("h", lambda j, i: F.coalesce(j, i))
    root = lambda x: base(x["dep"]) == "root"
    checks = {
        "roots": F.size(F.filter("t", root)) != 1,
        "root_head": F.exists("t", lambda x: root(x) & (x["head"] != x["ord"])),
        "self_head": F.exists("t", lambda x: ~root(x) & (x["head"] == x["ord"])),
        "outside": F.exists("h", lambda j: j.isNull()),
        "cycle": bound(up, lambda u: bound(followed(u), lambda e: F.exists(e, lambda j: F.get(u, j) != j))),
    }
    found = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in checks.items())), lambda x: x.isNotNull())
    return f.select("doc_id", "period", F.explode(found).alias("check"))


def copulas(t: Column | str = "t", label=lambda x: base(x["dep"])) -> Column:
    """Ords of the heads of a period's copulas; `label` gives a token's label."""
    return F.transform(F.filter(t, lambda x: label(x) == "cop"), lambda x: x["head"])


def nuclei(cops: Column, t: Column | str = "t", label=lambda x: base(x["dep"])) -> Column:
    return F.transform(t, lambda x: F.coalesce(x["pos"].isin(VERBAL) & ~label(x).isin(HELPERS), F.lit(False)) | F.array_contains(cops, x["ord"]))


def owners(h: Column, nucleus: Column) -> Column:
    """Index of the nearest nucleus among a token and its ancestors; null if there is none."""
    step = F.transform(h, lambda j, i: F.when(F.get(nucleus, i) | j.isNull(), i).otherwise(j))
    return F.transform(bound(step, followed), lambda e: F.when(F.get(nucleus, e), e))


def parents(h: Column, owner: Column) -> Column:
    """Index of the nucleus that owns the head of a token's owner; null at the root."""
    return F.transform(owner, lambda o: F.when(F.get(h, o) != o, F.get(owner, F.get(h, o))))


def owned(rows: DataFrame) -> DataFrame:
    """Tokens with nucleus (is it a clause's), owner (ord of the nearest nucleus among itself and its ancestors) and
    parent (ord of the nucleus that owns the head of the owner; null at the root)."""
    fields = [c for c in rows.columns if c not in ("doc_id", "period")]
    f = held(forests(rows), o=bound(_owners(), lambda o: record(nucleus=o["nucleus"], owner=o["owner"], parent=parents(F.col("h"), o["owner"]))))
    one = lambda x, i: F.struct(*(x[c].alias(c) for c in fields), F.get("o.nucleus", i).alias("nucleus"), (F.col("low") + F.get("o.owner", i)).alias("owner"), (F.col("low") + F.get("o.parent", i)).alias("parent"))
    return f.select("doc_id", "period", F.inline(F.transform("t", one)))


def _owners() -> Column:
    """Of a forest's period nucleus and owner (an index) of each token."""
    return bound(copulas(), lambda cops: bound(nuclei(cops), lambda nuc: record(nucleus=nuc, owner=owners(F.col("h"), nuc))))


#: A token's owner and place in one number, which sorts by owner, then place.
_OWNER = 1 << 31


def _runs(f: DataFrame, starts: Callable[[Column, Column], Column], made: Callable[[Column, Column], Column]) -> DataFrame:
    """Forests as rows of runs of their tokens in order of (owner, place), found inside the period's row. starts(key, key
    before): does a run begin here? made(owner's ord, its keys): a run's row."""
    keys = F.sort_array(F.filter(F.transform(_owners()["owner"], lambda o, i: o.cast("long") * _OWNER + i), lambda k: k.isNotNull()))
    begins = lambda ks: F.filter(F.sequence(F.lit(0), F.size(ks) - 1), lambda i: (i == 0) | starts(F.get(ks, i), F.get(ks, i - 1)))
    run = lambda ks, at, x: bound(F.slice(ks, F.get(at, x) + 1, F.coalesce(F.get(at, x + 1), F.size(ks)) - F.get(at, x)), lambda mine: made(_ord(_owner_of(F.element_at(mine, 1))), mine))
    rows = bound(keys, lambda ks: F.when(F.size(ks) > 0, bound(begins(ks), lambda at: F.transform(at, lambda _, x: run(ks, at, x)))))
    return f.select("doc_id", F.inline(rows))


def _owner_of(key: Column) -> Column:
    return F.shiftright(key, 31).cast("int")


def _ord(i: Column) -> Column:
    return F.get("t", i)["ord"]


def _place(key: Column) -> Column:
    return _ord((key % _OWNER).cast("int"))


def own_tokens_in(f: DataFrame) -> DataFrame:
    """As own_tokens(owned(rows)), of forests."""
    return _runs(f, lambda k, b: _owner_of(k) != _owner_of(b), lambda o, ks: record(owner=o, own=F.transform(ks, _place)))


def fragments_in(f: DataFrame) -> DataFrame:
    """As fragments of the tokens (doc_id, owner, ord) that have an owner, of forests."""
    return _runs(f, lambda k, b: k != b + 1, lambda o, ks: record(owner=o, first=_place(F.element_at(ks, 1)), last=_place(F.element_at(ks, -1))))


def paths(h: Column) -> Column:
    """For each token of a period the indices from itself up to its root, by doubling: each pass sets the path of the
    token where a path ends behind it."""
    start = F.transform(h, lambda j, i: record(p=F.array(i), to=F.when(j != i, j)))
    passes = F.sequence(F.lit(1), F.ceil(F.log2(F.size(h) + 1)).cast("int") + 1)
    further = lambda acc, x: bound(F.get(acc, x["to"]), lambda y: record(p=F.concat(x["p"], y["p"]), to=y["to"]))
    return F.aggregate(passes, start, lambda acc, _: F.transform(acc, lambda x: F.when(x["to"].isNull(), x).otherwise(further(acc, x))), lambda acc: F.transform(acc, lambda x: x["p"]))


def ancestry(rows: DataFrame) -> DataFrame:
    """(doc_id, period, ord, ancestor, distance), itself included. rows: tokens, or forests. Trees without cycles."""
    rows = _forests(rows).select("doc_id", "period", "low", F.posexplode(paths(F.col("h"))).alias("i", "path")).select("doc_id", "period", "low", "i", F.posexplode("path").alias("distance", "a"))
    return rows.select("doc_id", "period", (F.col("low") + F.col("i")).alias("ord"), (F.col("low") + F.col("a")).alias("ancestor"), "distance")


def children(rows: DataFrame) -> DataFrame:
    """(doc_id, head, children) in token order; a root is nobody's child."""
    return rows.where("head <> ord").groupBy("doc_id", "head").agg(F.array_sort(F.collect_list("ord")).alias("children"))


def _nested(q: Column) -> Column:
    """Regions (opened, closed, outer) between quotes q (ord, token), by a stack; closed is null where no end is met, outer
    is the region around it."""
    pair = F.create_map(*(F.lit(x) for kv in QUOTES.items() for x in kv))
    kind = "array<struct<opened:int,closer:string,outer:int>>"
    zero = record(stack=F.array().cast(kind), out=F.array().cast("array<struct<opened:int,closed:int,outer:int>>"))

    def step(acc, x):
        top = F.try_element_at(acc["stack"], F.lit(-1))
        closes = F.coalesce(top["closer"] == x["token"], F.lit(False))
        popped = record(stack=F.slice(acc["stack"], 1, F.greatest(F.size(acc["stack"]) - 1, F.lit(0))), out=F.concat(acc["out"], F.array(record(opened=top["opened"], closed=x["ord"].cast("int"), outer=top["outer"]))))
        pushed = record(stack=F.concat(acc["stack"], F.array(record(opened=x["ord"].cast("int"), closer=F.try_element_at(pair, x["token"]), outer=top["opened"]))), out=acc["out"])
        return F.when(closes, popped).when(x["token"].isin(list(QUOTES)), pushed).otherwise(acc)

    left = lambda r: F.transform(r["stack"], lambda s: record(opened=s["opened"], closed=F.lit(None).cast("int"), outer=s["outer"]))
    return bound(F.aggregate(q, zero, step), lambda r: F.concat(r["out"], left(r)))


def _regions(rows: DataFrame) -> DataFrame:
    """(doc_id, opened, closed, nested, outer): regions between whole-token quotes, by a stack over the document's quotes
    only; closed is null where no end is met, outer is the region around it."""
    few = rows.where(F.col("token").isin([*QUOTES, *QUOTES.values()])).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "token"))).alias("q"))
    return few.select("doc_id", F.explode(_nested(F.col("q"))).alias("r")).select("doc_id", "r.opened", "r.closed", F.col("r.outer").isNotNull().alias("nested"), "r.outer")


def quote_regions(rows: DataFrame) -> DataFrame:
    """(doc_id, opened, closed, nested)."""
    return _regions(rows).drop("outer")


def with_regions(rows: DataFrame) -> DataFrame:
    """Tokens with region (ord of the opening quote of the innermost region around them) and region_closed, nested.
    The marks themselves lie in no region. Behind a mark that opens its own region holds, behind one that closes the
    outer one; that is carried on to the next mark."""
    regions = _regions(rows)
    about = F.struct(F.col("opened"), F.col("closed").isNotNull().alias("ok"), "nested")
    outer = regions.select("doc_id", F.col("opened").alias("outer"), about.alias("around"))
    marks = regions.select("doc_id", F.col("opened").alias("ord"), F.lit(True).alias("inside"), about.alias("r"))
    closing = regions.where("closed is not null").join(outer, ["doc_id", "outer"], "left").select("doc_id", F.col("closed").alias("ord"), F.col("around").isNotNull().alias("inside"), F.col("around").alias("r"))
    out = rows.join(marks.unionByName(closing), ["doc_id", "ord"], "left")
    state = F.last(F.when(F.col("inside").isNotNull(), F.struct("inside", "r")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumn("state", F.when(F.col("inside").isNull(), state))
    return out.select(*rows.columns, F.col("state.r.opened").alias("region"), F.col("state.r.ok").alias("region_closed"), F.col("state.r.nested").alias("region_nested"))


def own_tokens(owned_rows: DataFrame) -> DataFrame:
    """(doc_id, owner, own): the tokens of each nucleus in order."""
    return owned_rows.where("owner is not null").groupBy("doc_id", "owner").agg(F.array_sort(F.collect_list("ord")).alias("own"))


def fragments(spans: DataFrame) -> DataFrame:
    """spans: id columns and ord. Runs of consecutive ords (gaps and islands): ids, first, last."""
    ids = [c for c in spans.columns if c != "ord"]
    order = Window.partitionBy(*ids).orderBy("ord")
    islands = spans.withColumn("island", F.col("ord") - F.row_number().over(order))
    return islands.groupBy(*ids, "island").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).drop("island")


def fragment_texts(fragments_: DataFrame, tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """fragments_ (doc_id, ..., first, last) with start_pos, end_pos and the literal text from the first token to the last,
    separators between them included. tokens: doc_id, ord, start_pos, end_pos."""
    begin = tokens.select("doc_id", F.col("ord").alias("first"), "start_pos")
    end = tokens.select("doc_id", F.col("ord").alias("last"), "end_pos")
    return with_text(fragments_.join(begin, ["doc_id", "first"]).join(end, ["doc_id", "last"]), docs)
