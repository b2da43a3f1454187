"""Twelve linguistic rules over annotated trees, and the assembly of their occurrences.

Input: tree.with_regions(tree.owned(rows)). Each rule is a filter over tokens with a few equi-joins by document; the
word lists are literals. Result of each: doc_id, period, rule, category, marker, nucleus, scope (arrays of ords; scope
is null where it cannot be settled) and links (array of struct(kind, target)).
"""

from __future__ import annotations

import json
from functools import reduce
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import materialized
from . import asked, tree

# The rules' lists and the catalogue.
NEGATORS = {"não": "simple_negation", "nunca": "temporal_negation", "nem": "additive_negation"}
ONLY = ["só", "somente", "apenas"]
RELATIVE = ["ontem", "hoje", "amanhã"]
SUBORDINATE = ["xcomp", "ccomp", "advcl", "acl", "csubj"]
COMPLEMENTS = ["xcomp", "ccomp", "obj", "iobj", "obl", "csubj"]
SPEECH = ["dizer", "afirmar", "contar", "declarar", "responder", "perguntar", "relatar", "escrever"]
MODALS = {
    "poder": "possibility_open", "dever": "obligation", "precisar": "necessity", "necessitar": "necessity",
    "conseguir": "capacity", "saber": "capacity", "querer": "wish", "desejar": "wish", "duvidar": "doubt", "ter": "obligation",
}
MODAL_ADVERBS = {"talvez": "doubt", "possivelmente": "possibility", "provavelmente": "possibility"}
MODAL_ADJECTIVES = {"necessário": "necessity", "obrigatório": "obligation", "capaz": "capacity"}
CATALOGUE = [
    ("correlative_negation", 10, "negation"), ("clause", 20, "clauses"), ("negation_nao", 100, "negation"), ("negation_nunca", 100, "negation"), ("negation_nem", 100, "negation"), ("negation_multiple", 100, "negation"),
    ("tense", 100, "time"), ("relative_time", 100, "time"), ("modal_verbal", 100, "modality"), ("modal_lexical", 100, "modality"), ("connector", 100, "connectors"), ("therefore", 100, "connectors"),
]

LINK = "array<struct<kind:string,target:int>>"
OUT = ("doc_id", "period", "rule", "category", "marker", "nucleus", "scope", "links")


def _in(column: Column, values) -> Column:
    return F.coalesce(column.isin(list(values)), F.lit(False))


def _map(column: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), column)


def _links(*pairs: tuple[str, Column]) -> Column:
    every = F.array(*(F.when(t.isNotNull(), F.struct(F.lit(k).alias("kind"), t.cast("int").alias("target"))) for k, t in pairs))
    return F.filter(every, lambda x: x.isNotNull()).cast(LINK)


_SINGLE = ("negation_nao", "negation_nunca", "negation_nem")
_SPEAKING = ["ccomp", "parataxis"]
#: Words of the rules that look at a marker's own clause.
_SCOPED = [*NEGATORS, *RELATIVE, "quando", *MODAL_ADVERBS, "mas", "porque", "se", "isso"]
#: The words of a pair: each asks for the token behind it.
_PAIRS = ["não", "mas", "por"]


def enriched(rows: DataFrame) -> DataFrame:
    """The tokens that rules ask for (nuclei, verbs, the rules' words and adjectives, the heads of negators that negate a
    constituent, and whole periods with a token of unknown class), with trees and regions, columns of the head, the owner
    and the parent, and what the rules ask of a period about them: own (a nucleus' tokens), helpers, scope_own and
    scope_head (the tokens of the owner; for a negator of a constituent the descendants of the head; within quotes those of
    the token's closed region if the other lies in it too; null if empty), comps, content and cut (of modals), able, words,
    said (the verb of speech above a nucleus), nx (the next token) and unknown (has the period a token of unknown class?).
    whole_dep is the label as it was given. The tokens that a marker takes in beside these (helpers, que and de, the next of
    a pair) are rows too, so that all evidence is found here.

    rows: tokens, or documents as `tree.gathered` has them. A document's rows meet once; all the rest is found inside a
    period's row. A head outside its period is none (`tree.violations` names it)."""
    documents = rows if "ps" in rows.columns else tree.gathered(tree.forests(rows.repartition("doc_id")))
    some = asked.Lists(*(frozenset(x) for x in (NEGATORS, _SCOPED, _PAIRS, MODAL_ADVERBS, MODALS, MODAL_ADJECTIVES, SPEECH, _SPEAKING, COMPLEMENTS, tree.HELPERS, tree.VERBAL)), tree.QUOTES)
    return asked.found(documents, some)


class Index:
    """The tokens that the rules share (see `enriched`, also for rows), written once, so that each rule is a scan of them."""

    def __init__(self, rows: DataFrame, written: bool = True):
        """written: False for one rule that reads it once."""
        self.rows = rows
        self.tokens = materialized(enriched(rows)) if written else enriched(rows)
        self.regions = self.tokens.select("doc_id", "ord", "region")
        self._pairs: DataFrame | None = None

    def annotations(self) -> DataFrame:
        """What was annotated of the tokens that evidence may name: doc_id, ord, lemma, pos, feats, dep, head."""
        return self.tokens.select("doc_id", "ord", "lemma", "pos", "feats", F.col("whole_dep").alias("dep"), "head")

    def pairs(self) -> DataFrame:
        """The correlative pairs, found once."""
        if self._pairs is None:
            self._pairs = materialized(correlatives(self))
        return self._pairs


def _result(found: DataFrame, rule: str, category: Column, marker: Column, nucleus: Column, links: Column | None = None, several: bool = False) -> DataFrame:
    kept = F.filter(nucleus if several else F.array(nucleus), lambda x: x.isNotNull()).cast("array<int>")
    return found.select("doc_id", "period", F.lit(rule).alias("rule"), category.alias("category"), marker.cast("array<int>").alias("marker"), kept.alias("nucleus"), F.col("scope").cast("array<int>").alias("scope"), (links if links is not None else F.array().cast(LINK)).alias("links"), "unknown")


def _scoped(t: DataFrame) -> DataFrame:
    """Markers whose nucleus is their owner, with its scope."""
    return t.withColumn("nuc", F.col("owner")).withColumn("scope", F.col("scope_own"))


def clauses(ix: Index) -> DataFrame:
    """One occurrence for each nucleus, with its auxiliaries and copulas."""
    found, h = ix.tokens.where("nucleus").withColumn("scope", F.col("own")), F.col("helpers")
    marker = F.array_sort(F.concat(F.array(F.col("ord").cast("int")), F.transform(h, lambda x: x["o"])))
    kind = F.when(F.col("dep") == "conj", "coordination").when(F.col("dep").isin(SUBORDINATE), "subordination").otherwise("association")
    up = F.when(F.col("parent").isNotNull(), F.array(F.struct(kind.alias("kind"), F.col("parent").cast("int").alias("target")))).otherwise(F.array()).cast(LINK)
    links = F.concat(F.transform(h, lambda x: F.struct(F.when(x["dep"] == "aux", "auxiliary").otherwise("copula").alias("kind"), x["o"].alias("target"))).cast(LINK), up)
    return _result(found, "clause", F.lit("clause"), marker, F.col("ord"), links)


def correlatives(ix: Index) -> DataFrame:
    """não + only ... mas + também in one period. Each `mas` serves one pair: the earliest `não` takes the first `mas`
    that fits; the others go on to the next, in as many rounds as a period has candidates."""
    t = ix.tokens.where(F.col("low").isin("não", "mas"))
    first = t.where((F.col("low") == "não") & F.col("nx.low").isin(ONLY) & F.col("pos").isin("ADV", "PART") & (F.col("nx.pos") == "ADV") & F.col("dep").isin("advmod", "neg") & F.col("owner").isNotNull())
    then = t.where((F.col("low") == "mas") & (F.col("nx.low") == "também") & (F.col("pos") == "CCONJ") & (F.col("dep") == "cc") & (F.col("nx.pos") == "ADV") & F.col("owner").isNotNull() & (F.col("owner") == F.col("nx.owner")))
    side = lambda df, p: df.select("doc_id", "period", F.col("nx.ord").alias(f"{p}_next_ord"), *(F.col(c).alias(f"{p}_{d}") for d, c in {"ord": "ord", "owner": "owner", "region": "region", "dep": "owner_dep", "parent": "parent", "scope": "scope_own", "unknown": "unknown"}.items()))
    pairs = side(first, "a").join(side(then, "b").drop("b_unknown"), ["doc_id", "period"]).where(F.col("b_ord") >= F.col("a_ord") + 2).withColumnRenamed("a_unknown", "unknown")
    related = (F.col("a_owner") == F.col("b_owner")) | ((F.col("b_dep") == "conj") & (F.col("b_parent") == F.col("a_owner"))) | ((F.col("a_dep") == "conj") & (F.col("a_parent") == F.col("b_owner")))
    pairs = pairs.where(related & F.col("a_region").eqNullSafe(F.col("b_region")))
    pairs = pairs.where("a_scope is not null and b_scope is not null")
    # The greedy choice, as a fold over a period's candidates in order of (não, mas).
    grouped = pairs.groupBy("doc_id", "period").agg(F.array_sort(F.collect_list(F.struct("a_ord", "b_ord"))).alias("c"))
    zero = F.array().cast("array<struct<a_ord:int,b_ord:int>>")
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["a_ord"] == x["a_ord"]) | (y["b_ord"] == x["b_ord"]))
    chosen = F.aggregate(F.col("c").cast("array<struct<a_ord:int,b_ord:int>>"), zero, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    chosen = grouped.select("doc_id", "period", F.explode(chosen).alias("x")).select("doc_id", "period", "x.a_ord", "x.b_ord")
    found = pairs.join(chosen, ["doc_id", "period", "a_ord", "b_ord"]).withColumn("scope", F.array_sort(F.array_distinct(F.concat("a_scope", "b_scope"))))
    both = F.array_sort(F.array_distinct(F.array("a_owner", "b_owner"))).cast("array<int>")
    links = F.transform(both, lambda x: F.struct(F.lit("correlate").alias("kind"), x.alias("target"))).cast(LINK)
    return _result(found, "correlative_negation", F.lit("correlative_addition"), F.array("a_ord", "a_next_ord", "b_ord", "b_next_ord"), both, links, several=True)


def suppressed(correlative: DataFrame) -> DataFrame:
    """(doc_id, ord): the `não` and `mas` that the simple rules leave to the correlative one."""
    return correlative.select("doc_id", F.explode(F.array(F.element_at("marker", 1), F.element_at("marker", 3))).alias("ord"))


def negator_tokens(ix: Index, hidden: DataFrame | None = None) -> DataFrame:
    """não, nunca, nem: permitted by class and label, or mentioned inside quotes; with part (does it negate a constituent
    only?), nuc and scope."""
    t = ix.tokens.where(F.col("low").isin(list(NEGATORS)))
    if hidden is not None:
        t = t.join(hidden, ["doc_id", "ord"], "left_anti")
    allowed = F.when(F.col("low") == "nem", _in(F.col("pos"), ("ADV", "PART", "CCONJ")) & F.col("dep").isin("advmod", "neg", "cc", "root")).when(F.col("low") == "nunca", _in(F.col("pos"), ("ADV",)) & F.col("dep").isin("advmod", "neg", "root")).otherwise(_in(F.col("pos"), ("ADV", "PART")) & F.col("dep").isin("advmod", "neg", "root"))
    t = t.withColumn("allowed", allowed).where("allowed or region is not null")
    headed = F.col("allowed") & (F.col("head") != F.col("ord"))
    unknown = headed & F.col("head_pos").isNull()
    part = headed & ~unknown & ~F.col("head_nucleus") & ~F.col("head_dep").isin(tree.HELPERS)
    t = t.withColumn("part", part).withColumn("nuc", F.when(unknown, None).when(F.col("part"), F.col("head")).otherwise(F.col("owner")))
    scope, there = F.when(F.col("part"), F.col("scope_head")).otherwise(F.col("scope_own")), F.when(F.col("part"), F.col("head_region")).otherwise(F.col("owner_region"))
    stray = F.col("region").isNotNull() & (F.col("nuc").isNull() | ~there.eqNullSafe(F.col("region")))
    return t.withColumn("scope", F.when(F.col("allowed") & ~stray & F.col("nuc").isNotNull(), scope)).withColumn("nuc", F.when(~stray, F.col("nuc")))


def negators(ix: Index, hidden: DataFrame | None = None) -> DataFrame:
    """The occurrences of negator_tokens; rule names the word."""
    t = negator_tokens(ix, hidden)
    out = _result(t, "", _map(F.col("low"), NEGATORS), F.array("ord"), F.col("nuc"), _links(("modifies", F.col("nuc"))))
    names = {v: f"negation_{a}" for (k, v), a in zip(NEGATORS.items(), ("nao", "nunca", "nem"))}
    return out.withColumn("rule", _map(F.col("category"), names)).select(*OUT, "unknown")


def multiple(ix: Index, hidden: DataFrame | None = None) -> DataFrame:
    """Two or more negators of one nucleus in one quoted region; scope and links of the first."""
    grouped = negator_tokens(ix, hidden).where("nuc is not null").groupBy("doc_id", "period", F.col("nuc").alias("n"), "region").agg(F.array_sort(F.collect_list(F.struct("ord", "scope"))).alias("m"), F.max("unknown").alias("unknown")).where(F.size("m") > 1)
    grouped = grouped.withColumn("scope", F.element_at("m", 1)["scope"])
    return _result(grouped, "negation_multiple", F.lit("multiple_markers"), F.col("m.ord"), F.col("n"), _links(("modifies", F.col("n"))))


def tense(ix: Index) -> DataFrame:
    t = ix.tokens.where(F.col("pos").isin(tree.VERBAL) & F.col("feats").rlike(r"(^|\|)(Tense|Mood|VerbForm)="))
    t = _scoped(t)
    return _result(t, "tense", F.lit("verbal_inflection"), F.array("ord"), F.col("nuc"), _links(("predicate", F.col("nuc"))))


def _when(t: DataFrame) -> Column:
    return (F.col("low") == "quando") & _in(F.col("pos"), ("SCONJ", "ADV")) & F.col("dep").isin("mark", "advmod") & F.coalesce(F.col("owner_dep") == "advcl", F.lit(False))


def relative_time(ix: Index) -> DataFrame:
    relative = F.col("low").isin(RELATIVE) & _in(F.col("pos"), ("ADV",)) & F.col("dep").isin("advmod", "obl", "npadvmod")
    t = _scoped(ix.tokens.where(relative | _when(ix.tokens)))
    return _result(t, "relative_time", F.when(F.col("low") == "quando", "temporal_construction").otherwise("relative_reference"), F.array("ord"), F.col("nuc"), _links(("predicate", F.col("nuc"))))


def modal_verbs(ix: Index) -> DataFrame:
    """Modal verbs with comps, content (null if none) and words (que, de of a verbal complement)."""
    t = ix.tokens.where(F.col("pos").isin(tree.VERBAL) & F.col("lem").isin(list(MODALS)))
    return t.where(F.when(F.col("lem").isin("conseguir", "saber"), F.coalesce("able", F.lit(False))).when(F.col("lem") == "ter", F.col("words").isNotNull()).otherwise(True))


def modal_verbal(ix: Index) -> DataFrame:
    t = modal_verbs(ix).withColumn("scope", F.when(F.col("region").isNull() | F.col("region_closed"), F.col("cut")))
    marker = F.when(F.col("lem") == "ter", F.array_sort(F.array_union(F.array(F.col("ord").cast("int")), "words"))).otherwise(F.array(F.col("ord").cast("int")))
    links = F.transform("comps", lambda c: F.struct(F.lit("content").alias("kind"), c.cast("int").alias("target"))).cast(LINK)
    return _result(t, "modal_verbal", _map(F.col("lem"), MODALS), marker, F.col("ord"), links)


def modal_adjectives(ix: Index) -> DataFrame:
    """Modal adjectives that are a clause's nucleus, with comps and content."""
    return ix.tokens.where(~F.col("low").isin(list(MODAL_ADVERBS)) & F.col("lem").isin(list(MODAL_ADJECTIVES)) & (F.col("pos") == "ADJ") & F.col("nucleus"))


def modal_lexical(ix: Index) -> DataFrame:
    adverbs = ix.tokens.where(F.col("low").isin(list(MODAL_ADVERBS)) & (F.col("pos") == "ADV") & F.col("dep").isin("advmod", "discourse"))
    one = _result(_scoped(adverbs), "modal_lexical", _map(F.col("low"), MODAL_ADVERBS), F.array("ord"), F.col("nuc"), _links(("predicate", F.col("nuc"))))
    adjectives = modal_adjectives(ix).withColumn("scope", F.col("content"))
    return one.unionByName(_result(adjectives, "modal_lexical", _map(F.col("lem"), MODAL_ADJECTIVES), F.array("ord"), F.col("ord"), _links(("predicate", F.col("ord")))))


def connectors(ix: Index, hidden: DataFrame | None = None) -> DataFrame:
    t = ix.tokens.where("owner is not null")
    if hidden is not None:
        t = t.join(hidden, ["doc_id", "ord"], "left_anti")
    mark = _in(F.col("pos"), ("SCONJ",)) & (F.col("dep") == "mark")
    contrast = (F.col("low") == "mas") & _in(F.col("pos"), ("CCONJ",)) & (F.col("dep") == "cc") & F.col("head_nucleus") & (F.col("head_dep") == "conj")
    cause = (F.col("low") == "porque") & mark & F.col("owner_dep").isin("advcl", "ccomp", "root")
    condition = (F.col("low") == "se") & mark & F.col("owner_dep").isin("advcl", "root")
    category = F.when(contrast, "contrast").when(cause, "cause").when(condition, "condition").when(_when(t), "time")
    t = _scoped(t.withColumn("category_", category).where("category_ is not null"))
    return _result(t, "connector", F.col("category_"), F.array("ord"), F.col("nuc"), _links(("marked_clause", F.col("nuc")), ("related_to", F.col("parent"))))


def therefore(ix: Index) -> DataFrame:
    """por isso in front of the predicate that it modifies."""
    nx = lambda c: F.col(f"nx.{c}")
    t = ix.tokens.where((F.col("low") == "por") & (nx("low") == "isso") & (F.col("pos") == "ADP") & nx("pos").isin("PRON", "ADV") & (F.col("dep") == "case") & (F.col("head") == nx("ord")) & nx("dep").isin("obl", "advmod") & (F.col("ord") < nx("owner")))
    t = t.select("doc_id", "period", F.col("ord").alias("por"), nx("ord").alias("ord"), nx("owner").alias("nuc"), nx("parent").alias("up"), nx("scope").alias("scope"), "unknown")
    before = F.when(F.col("up") < F.col("por"), F.col("up"))
    return _result(t, "therefore", F.lit("consequence"), F.array("por", "ord"), F.col("nuc"), _links(("consequent", F.col("nuc")), ("antecedent", before)))


def detect(rows: DataFrame, enabled: list[str] | None = None, index: Index | None = None, only: list[str] | None = None) -> DataFrame:
    """Occurrences of the enabled rules (of them `only` some, if named). With the correlative rule enabled, the simple
    ones leave its markers alone."""
    names = configuration(enabled)[0]
    ix = index or Index(rows)
    hidden = lambda: suppressed(ix.pairs()) if "correlative_negation" in names else None
    made = {
        "correlative_negation": ix.pairs, "clause": lambda: clauses(ix), "negation_multiple": lambda: multiple(ix, hidden()), "tense": lambda: tense(ix), "relative_time": lambda: relative_time(ix),
        "modal_verbal": lambda: modal_verbal(ix), "modal_lexical": lambda: modal_lexical(ix), "connector": lambda: connectors(ix, hidden()), "therefore": lambda: therefore(ix),
    }
    wanted = [n for n in names if only is None or n in only]
    single = [n for n in wanted if n in _SINGLE]
    parts = [made[n]() for n in wanted if n not in _SINGLE] + ([negators(ix, hidden()).where(F.col("rule").isin(single))] if single else [])
    # A period with a token of unknown class settles no scope: which tokens a clause owns depends on every class.
    found = reduce(DataFrame.unionByName, (p.select(*OUT, "unknown") for p in parts))
    return found.withColumn("scope", F.when(~F.col("unknown"), F.col("scope"))).select(*OUT)


def ordered(found: DataFrame) -> DataFrame:
    """Without exact repeats, numbered by first marker, rule, category and the rest."""
    text = F.to_json(F.struct("links", "marker", "nucleus", "scope"), {"ignoreNullFields": "false"})
    # Met by document first, so that no window needs an exchange of its own; the rest is written out only where the first
    # marker, rule and category leave the order open.
    rows = found.repartition("doc_id").withColumn("m", F.element_at("marker", 1))
    rows = rows.withColumn("alike", F.count("*").over(Window.partitionBy("doc_id", "m", "rule", "category"))).withColumn("json", F.when(F.col("alike") > 1, text))
    order = Window.partitionBy("doc_id").orderBy("m", "rule", "category", "json")
    rows = rows.withColumn("number", F.dense_rank().over(order) - 1).withColumn("before", F.lag("number").over(order))
    return rows.where(F.col("before").isNull() | (F.col("before") != F.col("number"))).drop("m", "alike", "json", "before")


def with_evidence(rows: DataFrame) -> DataFrame:
    """Evidence is the sorted union of marker and nucleus."""
    return rows.withColumn("evidence", F.array_sort(F.array_union("marker", "nucleus")))


def reported_speech(ix: Index) -> DataFrame:
    """(doc_id, ord, verb): nuclei whose chain of clauses climbs to a complement of a verb of speech; the nearest one."""
    return ix.tokens.where("said is not null").select("doc_id", "ord", F.col("said").alias("verb"))


def configuration(enabled: list[str] | None = None) -> tuple[list[str], str]:
    """The enabled rules in order of priority and name, whatever order the caller gives, and the catalogue's digest."""
    names = [r for r, _, _ in CATALOGUE] if enabled is None else list(enabled)
    unknown = set(names) - {r for r, _, _ in CATALOGUE}
    if unknown or len(set(names)) < len(names):
        raise ValueError(f"unknown or repeated rules: {sorted(unknown) or names}")
    order = [r for _, r in sorted((p, r) for r, p, _ in CATALOGUE)]
    digest = sha256(json.dumps(sorted(CATALOGUE), ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    return [r for r in order if r in names], digest


def states(found: DataFrame, pendings: DataFrame, enabled: DataFrame, failed: list[str] = ()) -> DataFrame:
    """enabled: rule, enabled. (rule, occurrences, pendings, state); an enabled rule named in `failed` has failed, and
    neither its occurrences nor its pendings count."""
    broken = F.col("rule").isin(list(failed))
    n = found.where(~broken).groupBy("rule").agg(F.count("*").alias("occurrences"))
    p = pendings.where(~broken).groupBy("rule").agg(F.count("*").alias("pendings"))
    rows = enabled.join(n, "rule", "left").join(p, "rule", "left").select("rule", "enabled", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("pendings", F.lit(0)).alias("pendings"))
    state = F.when(~F.col("enabled"), "disabled").when(broken, "failed").when(F.col("pendings") == 0, "done").when(F.col("occurrences") > 0, "done_with_pendings").otherwise("blocked")
    return rows.select("rule", F.when(F.col("enabled"), F.col("occurrences")).otherwise(0).alias("occurrences"), "pendings", state.alias("state"))


def catalogue(spark) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "rule string, priority int, family string")


def by_family(rule_states: DataFrame, rules: DataFrame) -> DataFrame:
    rows = rule_states.join(F.broadcast(rules), "rule")
    return rows.groupBy("family").agg(F.count("*").alias("rules"), F.sum("occurrences").alias("occurrences"), F.bool_and(F.col("state").isin("done", "disabled")).alias("ready"))


def clause_links(found: DataFrame) -> DataFrame:
    """Links from token targets to clause occurrences: (doc_id, rule, first_marker, kind, target, clause_marker)."""
    links = found.where("rule <> 'clause'").select("doc_id", "rule", F.element_at("marker", 1).alias("first_marker"), F.explode("links").alias("l"))
    clause = found.where("rule = 'clause'").select("doc_id", F.element_at("nucleus", 1).alias("target"), F.element_at("marker", 1).alias("clause_marker"))
    return links.select("doc_id", "rule", "first_marker", "l.kind", "l.target").join(clause, ["doc_id", "target"], "left")
