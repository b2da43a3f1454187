"""Queries over annotations, trees and rules. Real tokens carry formula annotations (a heap tree in each period, classes
and labels from a token's length and place); the rules run over annotated sentences of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, record
from ..operators import annotate, notes, rules, segment, tree
from . import fixture
from .text_queries import PERIODS, bigints, blank_lined, documents, tagged

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_POS = ["NOUN", "VERB", "ADV", "DET", "AUX", "ADJ", "ADP"]
_DEP = ["nsubj", "obj", "advmod", "aux", "xcomp", "conj", "cop", "mark"]
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_in = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
FORMULA = PERIODS + f""", fp AS (SELECT doc_id, CAST(period AS BIGINT) AS period, CAST(ord AS BIGINT) AS ord, token, ord - min(ord) OVER (PARTITION BY doc_id, period) AS i FROM tagged),
ft AS (SELECT doc_id, period, ord, token, i, CAST(CASE WHEN i = 0 THEN ord ELSE ord - i + (i - 1) // 2 END AS BIGINT) AS head,
  {_list(_POS)}[length(token) % 7 + 1] AS pos, CASE WHEN i = 0 THEN 'root' ELSE {_list(_DEP)}[(length(token) + i) % 8 + 1] END AS d FROM fp)"""


def formula_forests(spark, sf_dir, *fields: str) -> DataFrame:
    """Heap trees over the tokens of every document's periods, one row a period (see `tree.forests`): head(i) = (i - 1) div
    2. fields: those of a token that are made beside ord and head."""

    def token(w, i):
        made = annotate.formula(F.length(w), i)
        every = {"token": w, "lemma": F.lower(w), "pos": made["pos"], "dep": F.when(i == 0, "ROOT").otherwise(made["dep"]), "feats": F.lit(None).cast("string")}
        head = F.when(i == 0, F.col("low")).otherwise(F.col("low") + F.floor((i - 1) / 2).cast("int"))
        return record(ord=F.col("low") + i, **{c: every[c] for c in fields if c != "feats"}, head=head, **{c: every[c] for c in fields if c == "feats"})

    rows = segment.words_in(blank_lined(spark, sf_dir))
    return rows.select("doc_id", "period", "low", bound(F.transform("words", token), lambda t: F.array(record(t=t, h=tree.heads(t, F.col("low")))))[0].alias("f")).select("doc_id", "period", "f.t", "f.h", "low")


def formula_trees(spark, sf_dir) -> DataFrame:
    """The tokens of the heap trees, with all their columns."""
    rows = segment.words_in(blank_lined(spark, sf_dir)).select("doc_id", "period", "low", F.posexplode("words").alias("i", "token"))
    made = annotate.formula(F.length("token"), F.col("i"))
    head = F.when(F.col("i") == 0, F.col("low")).otherwise(F.col("low") + F.floor((F.col("i") - 1) / 2))
    return rows.select("doc_id", "period", (F.col("low") + F.col("i")).alias("ord"), "token", F.lower("token").alias("lemma"), made["pos"].alias("pos"), F.when(F.col("i") == 0, "ROOT").otherwise(made["dep"]).alias("dep"), head.cast("int").alias("head"), F.lit(None).cast("string").alias("feats"))


def words(spark, sf_dir) -> DataFrame:
    """Tokens with a lemma that is missing for short ones, and classes by formula."""
    # Texts are dealt by document once, so that nothing behind them is shuffled as tokens.
    docs = documents(spark, sf_dir)
    texts = docs.repartition(max(4 * spark.sparkContext.defaultParallelism, 8 * docs.rdd.getNumPartitions()), "doc_id")
    t = segment.words_of(texts)
    return t.select("doc_id", "ord", "token", F.when(F.length("token") > 3, F.lower("token")).otherwise("").alias("lemma"), F.when(F.col("token").rlike(r"^[^\p{L}0-9]+$"), "PUNCT").otherwise(annotate.formula(F.length("token"), F.col("ord"))["pos"]).alias("pos"), F.when(F.col("ord") % 5 == 0, "").otherwise("T").alias("tag"), F.when(F.length("token") % 2 == 0, "Number=Sing").alias("feats"))


def words_sql() -> str:
    base = PERIODS.replace("replace(text, chr(10), chr(10) || chr(10))", "text")
    return base[: base.index(", w AS (SELECT")] + f""", words AS (SELECT doc_id, ord, token, CASE WHEN length(token) > 3 THEN lower(token) END AS lemma,
  CASE WHEN regexp_full_match(token, '[^\\p{{L}}0-9]+') THEN 'PUNCT' ELSE {_list(_POS)}[length(token) % 7 + 1] END AS pos, CASE WHEN ord % 5 = 0 THEN NULL ELSE 'T' END AS tag, CASE WHEN length(token) % 2 = 0 THEN 'Number=Sing' END AS feats FROM tokens)"""


WORDS = words_sql()
VOCABULARY = WORDS + """, kept AS (SELECT ord, doc_id, token, CASE WHEN lemma IS NULL THEN 'form' ELSE 'lemma' END AS criterion, coalesce(lemma, token) AS key, pos FROM words WHERE pos NOT IN ('PUNCT', 'SYM')),
forms AS (SELECT doc_id, criterion, key, pos, token, count(*) AS n, min(ord) AS first FROM kept GROUP BY ALL),
groups AS (SELECT doc_id, criterion, key, pos, CAST(sum(n) AS BIGINT) AS occurrences, min(first) AS first, string_agg(token, '|' ORDER BY first, token) AS forms FROM forms GROUP BY ALL)"""


@query(VOCABULARY + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first, criterion, key, pos) - 1 AS rank, criterion, key, pos, occurrences, first, forms FROM groups")
def vocab_by_document(spark, sf_dir):
    return bigints(annotate.vocabulary(annotate.cleaned(words(spark, sf_dir)), "doc_id"))


@query(VOCABULARY + " SELECT pos, criterion, count(DISTINCT key) AS keys, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM groups GROUP BY ALL")
def vocab_classes(spark, sf_dir):
    v = annotate.vocabulary(annotate.cleaned(words(spark, sf_dir)), "doc_id")
    return v.groupBy("pos", "criterion").agg(F.count_distinct("key").alias("keys"), F.sum("occurrences").alias("occurrences"))


@query(VOCABULARY + " SELECT doc_id, criterion, key, pos, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS tokens FROM kept GROUP BY ALL")
def vocab_tokens(spark, sf_dir):
    v = annotate.vocabulary_tokens(annotate.cleaned(words(spark, sf_dir)), "doc_id")
    return v.withColumn("tokens", F.array_join(F.transform("tokens", lambda x: x.cast("string")), ","))


@query(WORDS + " SELECT array_to_string([x FOR x IN [CASE WHEN lemma IS NULL THEN 'lemma' END, CASE WHEN pos IS NULL THEN 'pos' END, CASE WHEN tag IS NULL THEN 'tag' END, CASE WHEN feats IS NULL THEN 'feats' END] IF x IS NOT NULL], ',') AS missing, count(*) AS tokens FROM words GROUP BY ALL")
def annotation_unresolved(spark, sf_dir):
    rows = annotate.cleaned(words(spark, sf_dir))
    return rows.select(F.array_join(annotate.unresolved(*annotate.FIELDS), ",").alias("missing")).groupBy("missing").agg(F.count("*").alias("tokens"))


@query(WORDS + " SELECT doc_id, count(*) AS tokens, count(*) FILTER (lemma IS NULL) AS no_lemma, count(*) FILTER (pos IS NULL) AS no_pos, count(*) FILTER (tag IS NULL) AS no_tag, count(*) FILTER (feats IS NULL) AS no_feats, count(*) FILTER (lemma IS NULL) + count(*) FILTER (tag IS NULL) + count(*) FILTER (feats IS NULL) AS pendings FROM words GROUP BY doc_id")
def annotation_coverage(spark, sf_dir):
    return annotate.coverage(annotate.cleaned(words(spark, sf_dir)), "doc_id")


@query(WORDS + " SELECT doc_id, ord, 'missing' AS \"check\" FROM words WHERE ord % 101 = 7 UNION ALL SELECT doc_id, ord, 'form' FROM words WHERE ord % 103 = 9 AND ord % 101 <> 7 UNION ALL SELECT doc_id, ord, 'class' FROM words WHERE ord % 107 = 11 AND ord % 101 <> 7 AND ord % 103 <> 9")
def annotation_checks(spark, sf_dir):
    """Dropped, changed and wrongly classed annotations, each named."""
    rows = annotate.cleaned(words(spark, sf_dir))
    bad = rows.where("ord % 101 <> 7").withColumn("pos", F.when(F.col("ord") % 107 == 11, "NONE").otherwise(F.col("pos"))).withColumn("token", F.when(F.col("ord") % 103 == 9, F.concat("token", F.lit("x"))).otherwise(F.col("token")))
    return bigints(annotate.violations(rows.select("doc_id", "ord", "token"), bad))


@query(WORDS + ", c AS (SELECT doc_id, count(*) AS tokens FROM words GROUP BY doc_id) SELECT documents.doc_id, CAST(length(text) AS BIGINT) AS chars, coalesce(tokens, 0) AS tokens FROM documents LEFT JOIN c USING (doc_id) WHERE length(text) > 8000 OR coalesce(tokens, 0) > 1500")
def annotation_limits(spark, sf_dir):
    return annotate.over_limits(documents(spark, sf_dir), words(spark, sf_dir), 8000, 1500)


_ENT = """, e AS (SELECT doc_id, CAST(min(ord) AS BIGINT) AS first_token, CAST(max(ord) AS BIGINT) AS last_token, count(*) AS tokens, CAST(min(start_pos) AS BIGINT) AS start_pos, CAST(max(end_pos) AS BIGINT) AS end_pos, count(DISTINCT period) AS periods FROM tagged WHERE regexp_matches(token, '^\\p{Lu}') GROUP BY doc_id, ord // 5)"""


@query(PERIODS + _ENT + " SELECT doc_id, first_token AS entity, 'gap' AS \"check\" FROM e WHERE last_token - first_token + 1 <> tokens UNION ALL SELECT doc_id, first_token, 'period' FROM e WHERE periods <> 1 UNION ALL SELECT doc_id, first_token, 'overlap' FROM (SELECT *, lag(end_pos) OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos) AS p FROM e) WHERE p > start_pos")
def entity_checks(spark, sf_dir):
    """Capitalised tokens grouped by fives as would-be entities: those with gaps or across periods are named."""
    rows = tagged(spark, sf_dir).where(F.col("token").rlike(r"^\p{Lu}")).groupBy("doc_id", F.floor(F.col("ord") / 5).alias("g"))
    e = rows.agg(F.min("ord").alias("first_token"), F.max("ord").alias("last_token"), F.count("*").alias("tokens"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.min("start_pos").alias("first_start"), F.max("end_pos").alias("last_end"), F.count_distinct("period").alias("periods"))
    return bigints(annotate.entity_violations(e.withColumn("entity", F.col("first_token"))))


def formula_parser():
    """A parser by formula, made once a worker: heap trees in each period, capitalised runs as entities."""

    def parse(words: list[dict]) -> tuple[list[int], list[str], list[tuple[int, int, str]]]:
        heads, labels, named, low, period = [], [], [], 0, None
        for w in words:
            if w["period"] != period:
                period, low = w["period"], w["ord"]
            i = w["ord"] - low
            heads.append(w["ord"] if i == 0 else low + (i - 1) // 2)
            labels.append("ROOT" if i == 0 else _DEP[(len(w["token"]) + i) % 8])
            if w["token"][:1].isalpha() and w["token"][:1].isupper():
                if named and named[-1][1] == w["ord"] - 1 and i:
                    named[-1] = (named[-1][0], w["ord"], "MISC")
                else:
                    named.append((w["ord"], w["ord"], "MISC"))
        return heads, labels, named

    return parse


def _parsed(spark, sf_dir):
    return annotate.parsed(tagged(spark, sf_dir).select("doc_id", "period", F.col("ord").cast("int").alias("ord"), "token"), formula_parser)


@query(FORMULA + " SELECT doc_id, CAST(ord AS BIGINT) AS ord, head, d AS dep FROM ft")
def parse_trees(spark, sf_dir):
    """Heads and labels of an injected parser beside the tokens."""
    rows = annotate.trees(tagged(spark, sf_dir).select("doc_id", "ord"), _parsed(spark, sf_dir))
    return bigints(rows.select("doc_id", "ord", "head", F.lower("dep").alias("dep")))


@query(PERIODS + """, c AS (SELECT doc_id, period, ord FROM tagged WHERE regexp_matches(token, '^\\p{Lu}')), g AS (SELECT doc_id, period, ord - row_number() OVER (PARTITION BY doc_id, period ORDER BY ord) AS island FROM c),
n AS (SELECT doc_id, count(DISTINCT (period, island)) AS entities FROM g GROUP BY doc_id)
SELECT doc_id, count(*) AS tokens, count(*) AS parsed, count(DISTINCT period) AS periods, coalesce(max(entities), 0) AS entities FROM tagged LEFT JOIN n USING (doc_id) GROUP BY doc_id""")
def parse_report(spark, sf_dir):
    return bigints(annotate.parse_report(tagged(spark, sf_dir).select("doc_id", "period", "ord"), _parsed(spark, sf_dir)))


TREES = FORMULA.replace("WITH docs", "WITH RECURSIVE docs") + """, n AS (SELECT ft.*, (pos IN ('VERB', 'AUX') AND d NOT IN ('aux', 'cop')) OR c.head IS NOT NULL AS nucleus FROM ft LEFT JOIN (SELECT DISTINCT doc_id, head FROM ft WHERE d = 'cop') c ON ft.doc_id = c.doc_id AND ft.ord = c.head),
walk AS (SELECT doc_id, period, ord, ord AS place FROM n UNION ALL SELECT w.doc_id, w.period, w.ord, n.head FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.ord = w.place WHERE NOT n.nucleus AND n.head <> n.ord),
own AS (SELECT w.doc_id, w.ord, w.place AS owner FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.ord = w.place WHERE n.nucleus)"""


@query(TREES + " SELECT n.doc_id, n.period, n.ord, n.nucleus, own.owner, CASE WHEN h.head <> h.ord THEN up.owner END AS parent FROM n LEFT JOIN own ON own.doc_id = n.doc_id AND own.ord = n.ord LEFT JOIN n h ON h.doc_id = n.doc_id AND h.ord = own.owner LEFT JOIN own up ON up.doc_id = n.doc_id AND up.ord = h.head")
def tree_owner(spark, sf_dir):
    return bigints(tree.owned(formula_trees(spark, sf_dir)).select("doc_id", "period", "ord", "nucleus", "owner", "parent"))


@query(TREES + " SELECT doc_id, owner, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS own FROM own GROUP BY ALL")
def tree_own_tokens(spark, sf_dir):
    return bigints(tree.own_tokens_in(formula_forests(spark, sf_dir, "pos", "dep")).select("doc_id", "owner", F.array_join(F.transform("own", lambda x: x.cast("string")), ",").alias("own")))


@query(TREES + ", anc AS (SELECT doc_id, ord, ord AS a, 0 AS dist FROM ft UNION ALL SELECT x.doc_id, x.ord, ft.head, dist + 1 FROM anc x JOIN ft ON ft.doc_id = x.doc_id AND ft.ord = x.a WHERE ft.head <> ft.ord) SELECT doc_id, a AS ancestor, count(*) AS descendants, CAST(max(dist) AS BIGINT) AS depth FROM anc GROUP BY ALL")
def tree_descendants(spark, sf_dir):
    return bigints(tree.ancestry(formula_forests(spark, sf_dir)).groupBy("doc_id", "ancestor").agg(F.count("*").alias("descendants"), F.max("distance").alias("depth")))


@query(FORMULA + " SELECT doc_id, head, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS children FROM ft WHERE head <> ord GROUP BY ALL")
def tree_children(spark, sf_dir):
    return bigints(tree.children(formula_trees(spark, sf_dir)).select("doc_id", "head", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children")))


@query(FORMULA + ", s AS (SELECT doc_id, period, count(*) AS n FROM ft GROUP BY ALL) SELECT doc_id, period, 'cycle' AS \"check\" FROM s WHERE n > 2 AND period % 10 = 3 UNION ALL SELECT doc_id, period, 'roots' FROM s WHERE n > 1 AND period % 10 = 5 UNION ALL SELECT doc_id, period, 'root_head' FROM s WHERE n > 1 AND period % 10 = 5 UNION ALL SELECT doc_id, period, 'outside' FROM s WHERE period % 10 = 7 UNION ALL SELECT doc_id, period, 'root_head' FROM s WHERE period % 10 = 7")
def tree_validate(spark, sf_dir):
    """Trees, some with a cycle, a second root or a head outside the period: those are named and no others."""
    kind, n, low = F.col("period") % 10, F.size("t"), F.col("low")

    def damaged(x, i):
        head = F.when((kind == 3) & (i == 1) & (n > 2), low + 2).when((kind == 3) & (i == 2), low + 1).when((kind == 7) & (i == 0), F.lit(-5)).otherwise(x["head"])
        return record(ord=x["ord"], dep=F.when((kind == 5) & (i == 1), "ROOT").otherwise(x["dep"]), head=head.cast("int"))

    f = formula_forests(spark, sf_dir, "dep").select("doc_id", "period", "low", F.transform("t", damaged).alias("t"))
    return bigints(tree.violations(f.select("doc_id", "period", "t", tree.heads(F.col("t"), low).alias("h"), "low")))


QUOTED = PERIODS + """, q AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM tagged WHERE token = '"')"""


@query(QUOTED + " SELECT a.doc_id, CAST(a.ord AS BIGINT) AS opened, CAST(b.ord AS BIGINT) AS closed, false AS nested FROM q a LEFT JOIN q b ON a.doc_id = b.doc_id AND b.k = a.k + 1 WHERE a.k % 2 = 1")
def quote_regions(spark, sf_dir):
    """Straight double quotes, which toggle."""
    t = tagged(spark, sf_dir).where("token = '\"'").select("doc_id", "ord", "token")
    return bigints(tree.quote_regions(t))


# Rules over the annotated sentences ---------------------------------------------------------------------------------

_OPEN, _CLOSE = _in(["“", "«", "‘"]), {"“": "”", "«": "»", "‘": "’"}
BASE = f"""WITH RECURSIVE a AS ({fixture.as_sql()}),
t AS (SELECT * REPLACE (lower(split_part(dep, ':', 1)) AS dep), lower(token) AS low, lower(lemma) AS lem FROM a),
cop AS (SELECT DISTINCT doc_id, head FROM t WHERE dep = 'cop'),
n AS (SELECT t.*, coalesce(pos IN ('VERB', 'AUX'), false) AND dep NOT IN ('aux', 'cop') OR cop.head IS NOT NULL AS nucleus FROM t LEFT JOIN cop ON t.doc_id = cop.doc_id AND t.ord = cop.head),
walk AS (SELECT doc_id, ord, ord AS place FROM n UNION ALL SELECT w.doc_id, w.ord, n.head FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.ord = w.place WHERE NOT n.nucleus AND n.head <> n.ord),
own AS (SELECT w.doc_id, w.ord, w.place AS owner FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.ord = w.place WHERE n.nucleus),
anc AS (SELECT doc_id, ord, ord AS top FROM n UNION ALL SELECT x.doc_id, x.ord, n.head FROM anc x JOIN n ON n.doc_id = x.doc_id AND n.ord = x.top WHERE n.head <> n.ord),
q AS (SELECT doc_id, ord, token, CASE WHEN token = '"' THEN row_number() OVER (PARTITION BY doc_id, token ORDER BY ord) % 2 = 1 ELSE token IN {_OPEN} END AS opens FROM t WHERE token IN ('"', '“', '”', '«', '»', '‘', '’')),
reg AS (SELECT o.doc_id, o.ord AS opened, min(c.ord) AS closed FROM q o LEFT JOIN q c ON c.doc_id = o.doc_id AND c.ord > o.ord AND NOT c.opens AND c.token = CASE o.token WHEN '“' THEN '”' WHEN '«' THEN '»' WHEN '‘' THEN '’' ELSE o.token END WHERE o.opens GROUP BY ALL),
r AS (SELECT n.doc_id, n.ord, max(opened) AS region FROM n JOIN reg ON reg.doc_id = n.doc_id AND n.ord > opened AND (closed IS NULL OR n.ord < closed) WHERE NOT EXISTS (SELECT 1 FROM reg z WHERE z.doc_id = n.doc_id AND n.ord IN (z.opened, z.closed)) GROUP BY ALL),
e AS (SELECT n.*, own.owner, r.region, reg.closed IS NOT NULL AS rclosed, h.pos AS hpos, h.dep AS hdep, h.nucleus AS hnuc, o.dep AS odep, CASE WHEN o.head <> o.ord THEN up.owner END AS parent
  FROM n LEFT JOIN own USING (doc_id, ord) LEFT JOIN r USING (doc_id, ord) LEFT JOIN reg ON reg.doc_id = n.doc_id AND reg.opened = r.region LEFT JOIN n h ON h.doc_id = n.doc_id AND h.ord = n.head
  LEFT JOIN n o ON o.doc_id = n.doc_id AND o.ord = own.owner LEFT JOIN own up ON up.doc_id = n.doc_id AND up.ord = o.head),
unk AS (SELECT DISTINCT doc_id, period FROM t WHERE pos IS NULL)"""


def scoped_sql(found: str, rule: str, category: str, marker: str = "m.ord::VARCHAR", where: str = "true") -> str:
    """found: a SELECT with e.*, nuc and part. Scope as in the operators, written with correlated subqueries."""
    return (
        BASE
        + f""", m AS ({found}), mm AS (SELECT m.*, m.region IS NULL OR (m.rclosed AND coalesce((SELECT region FROM r WHERE r.doc_id = m.doc_id AND r.ord = m.nuc) = m.region, false)) AS settled FROM m),
s AS (SELECT m.doc_id, m.ord, string_agg(x.ord::VARCHAR, ',' ORDER BY x.ord) AS scope FROM mm m JOIN (SELECT doc_id, owner AS top, ord, false AS part FROM own UNION ALL SELECT doc_id, top, ord, true FROM anc) x ON x.doc_id = m.doc_id AND x.top = m.nuc AND x.part = m.part
  LEFT JOIN r ON r.doc_id = x.doc_id AND r.ord = x.ord WHERE m.settled AND (m.region IS NULL OR r.region = m.region) GROUP BY ALL)
SELECT m.doc_id, CAST(m.period AS BIGINT) AS period, '{rule}' AS rule, {category} AS category, {marker} AS marker, coalesce(m.nuc::VARCHAR, '') AS nucleus, CASE WHEN unk.doc_id IS NULL THEN s.scope END AS scope
FROM mm m LEFT JOIN s USING (doc_id, ord) LEFT JOIN unk ON unk.doc_id = m.doc_id AND unk.period = m.period WHERE {where}"""
    )


def shown(found: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return bigints(found.select("doc_id", "period", "rule", "category", text("marker"), text("nucleus"), text("scope")))


def of_rule(spark, name: str) -> DataFrame:
    return shown(rules.detect(fixture.annotated(spark), only=[name]))


_HELP = "(SELECT string_agg(o::VARCHAR, ',' ORDER BY o) FROM (SELECT m.ord AS o UNION ALL SELECT c.ord FROM n c WHERE c.doc_id = m.doc_id AND c.head = m.ord AND c.ord <> m.ord AND c.dep IN ('aux', 'cop')))"


@query(scoped_sql("SELECT * REPLACE (NULL::BIGINT AS region), ord AS nuc, false AS part FROM e WHERE nucleus", "clause", "'clause'", _HELP))
def rule_clauses(spark, sf_dir):
    return of_rule(spark, "clause")


_SUP = BASE.split("WITH RECURSIVE ")[1]
_NEG = """SELECT * EXCLUDE (nuc0, allowed, unknown), CASE WHEN region IS NOT NULL AND (nuc0 IS NULL OR coalesce((SELECT region FROM r WHERE r.doc_id = z.doc_id AND r.ord = nuc0), -1) <> region) THEN NULL ELSE nuc0 END AS nuc, allowed AS ok FROM (
  SELECT y.*, CASE WHEN unknown THEN NULL WHEN part THEN head ELSE owner END AS nuc0 FROM (
    SELECT x.*, allowed AND head <> ord AND hpos IS NULL AS unknown, allowed AND head <> ord AND hpos IS NOT NULL AND NOT hnuc AND hdep NOT IN ('aux', 'cop') AS part FROM (
      SELECT e.*, coalesce(pos, '') IN {classes} AND dep IN {deps} AS allowed FROM e WHERE low = '{word}'
        AND NOT EXISTS (SELECT 1 FROM e s JOIN e k ON k.doc_id = s.doc_id AND k.period = s.period AND k.low = 'mas' AND k.pos = 'CCONJ' AND k.dep = 'cc' JOIN e l ON l.doc_id = k.doc_id AND l.ord = k.ord + 1 AND l.low = 'também' AND l.pos = 'ADV'
          WHERE s.doc_id = e.doc_id AND s.ord = e.ord + 1 AND e.low = 'não' AND s.period = e.period AND s.low IN ('só', 'somente', 'apenas') AND s.pos = 'ADV' AND e.dep IN ('advmod', 'neg'))) x WHERE allowed OR region IS NOT NULL) y) z"""


def _negation(word: str, classes: str, deps: str, rule: str, category: str) -> str:
    sql = scoped_sql(_NEG.format(word=word, classes=classes, deps=deps), rule, f"'{category}'")
    return sql.replace("CASE WHEN unk.doc_id IS NULL THEN s.scope END", "CASE WHEN unk.doc_id IS NULL AND m.ok THEN s.scope END")


@query(_negation("não", "('ADV', 'PART')", "('advmod', 'neg', 'root')", "negation_nao", "simple_negation"))
def rule_negation_simple(spark, sf_dir):
    return of_rule(spark, "negation_nao")


@query(_negation("nunca", "('ADV')", "('advmod', 'neg', 'root')", "negation_nunca", "temporal_negation"))
def rule_negation_temporal(spark, sf_dir):
    return of_rule(spark, "negation_nunca")


@query(_negation("nem", "('ADV', 'PART', 'CCONJ')", "('advmod', 'neg', 'cc', 'root')", "negation_nem", "additive_negation"))
def rule_negation_additive(spark, sf_dir):
    return of_rule(spark, "negation_nem")


@query(scoped_sql("SELECT *, owner AS nuc, false AS part FROM e WHERE pos IN ('VERB', 'AUX') AND regexp_matches(feats, '(^|\\|)(Tense|Mood|VerbForm)=')", "tense", "'verbal_inflection'"))
def rule_tense(spark, sf_dir):
    return of_rule(spark, "tense")


_WHEN = "(low = 'quando' AND pos IN ('SCONJ', 'ADV') AND dep IN ('mark', 'advmod') AND odep = 'advcl')"


@query(scoped_sql(f"SELECT *, owner AS nuc, false AS part FROM e WHERE (low IN ('ontem', 'hoje', 'amanhã') AND pos = 'ADV' AND dep IN ('advmod', 'obl', 'npadvmod')) OR {_WHEN}", "relative_time", "CASE WHEN m.low = 'quando' THEN 'temporal_construction' ELSE 'relative_reference' END"))
def rule_relative_time(spark, sf_dir):
    return of_rule(spark, "relative_time")


_CONN = f"""CASE WHEN low = 'mas' AND pos = 'CCONJ' AND dep = 'cc' AND hnuc AND hdep = 'conj' THEN 'contrast' WHEN low = 'porque' AND pos = 'SCONJ' AND dep = 'mark' AND odep IN ('advcl', 'ccomp', 'root') THEN 'cause'
  WHEN low = 'se' AND pos = 'SCONJ' AND dep = 'mark' AND odep IN ('advcl', 'root') THEN 'condition' WHEN {_WHEN} THEN 'time' END"""


@query(scoped_sql(f"SELECT * FROM (SELECT *, owner AS nuc, false AS part, {_CONN} AS c FROM e WHERE owner IS NOT NULL AND NOT (low = 'mas' AND EXISTS (SELECT 1 FROM e l JOIN e s ON s.doc_id = l.doc_id AND s.period = l.period AND s.low = 'só' WHERE l.doc_id = e.doc_id AND l.ord = e.ord + 1 AND l.low = 'também'))) WHERE c IS NOT NULL", "connector", "m.c"))
def rule_connector(spark, sf_dir):
    return of_rule(spark, "connector")


@query(scoped_sql("SELECT i.*, i.owner AS nuc, false AS part, p.ord AS por FROM e p JOIN e i ON i.doc_id = p.doc_id AND i.period = p.period AND i.ord = p.ord + 1 WHERE p.low = 'por' AND i.low = 'isso' AND p.pos = 'ADP' AND i.pos IN ('PRON', 'ADV') AND p.dep = 'case' AND p.head = i.ord AND i.dep IN ('obl', 'advmod') AND p.ord < i.owner", "therefore", "'consequence'", "m.por || ',' || m.ord"))
def rule_therefore(spark, sf_dir):
    return of_rule(spark, "therefore")


_MODAL = "CASE lem " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.MODALS.items()) + " END"
_COMP = _in(rules.COMPLEMENTS)


@query(BASE + f""", c AS (SELECT k.doc_id, k.head AS m, k.ord AS c, k.pos, k.dep, k.feats FROM n k WHERE k.dep IN {_COMP} AND k.head <> k.ord),
mv AS (SELECT e.*, {_MODAL} AS category FROM e WHERE pos IN ('VERB', 'AUX') AND lem IN {_in(rules.MODALS)}),
kept AS (SELECT mv.* FROM mv WHERE CASE WHEN lem IN ('conseguir', 'saber') THEN EXISTS (SELECT 1 FROM c WHERE c.doc_id = mv.doc_id AND c.m = mv.ord AND c.pos IN ('VERB', 'AUX') AND c.dep = 'xcomp' AND c.feats LIKE '%VerbForm=Inf%')
  WHEN lem = 'ter' THEN EXISTS (SELECT 1 FROM c JOIN n w ON w.doc_id = c.doc_id AND w.head = c.c AND w.low IN ('que', 'de') AND w.dep IN ('mark', 'case') WHERE c.doc_id = mv.doc_id AND c.m = mv.ord AND c.pos IN ('VERB', 'AUX') AND c.dep IN ('xcomp', 'ccomp')) ELSE true END),
content AS (SELECT kept.doc_id, kept.ord, anc.ord AS x FROM kept JOIN c ON c.doc_id = kept.doc_id AND c.m = kept.ord JOIN anc ON anc.doc_id = c.doc_id AND anc.top = c.c WHERE kept.dep <> 'aux'
  UNION SELECT kept.doc_id, kept.ord, anc.ord FROM kept JOIN anc ON anc.doc_id = kept.doc_id AND anc.top = kept.head WHERE kept.dep = 'aux' AND anc.ord <> kept.ord),
s AS (SELECT doc_id, ord, string_agg(x::VARCHAR, ',' ORDER BY x) AS scope FROM content GROUP BY ALL)
SELECT k.doc_id, CAST(k.period AS BIGINT) AS period, 'modal_verbal' AS rule, category,
  CASE WHEN lem = 'ter' THEN k.ord || ',' || (SELECT string_agg(w.ord::VARCHAR, ',' ORDER BY w.ord) FROM c JOIN n w ON w.doc_id = c.doc_id AND w.head = c.c AND w.low IN ('que', 'de') AND w.dep IN ('mark', 'case') WHERE c.doc_id = k.doc_id AND c.m = k.ord) ELSE k.ord::VARCHAR END AS marker,
  k.ord::VARCHAR AS nucleus, CASE WHEN unk.doc_id IS NULL AND k.region IS NULL THEN scope END AS scope FROM kept k LEFT JOIN s USING (doc_id, ord) LEFT JOIN unk ON unk.doc_id = k.doc_id AND unk.period = k.period""")
def rule_modal_verbal(spark, sf_dir):
    return of_rule(spark, "modal_verbal")


@query(BASE + f""", lex AS (SELECT e.*, CASE low WHEN 'talvez' THEN 'doubt' ELSE 'possibility' END AS category, owner AS nuc FROM e WHERE low IN ('talvez', 'possivelmente', 'provavelmente') AND pos = 'ADV' AND dep IN ('advmod', 'discourse')
  UNION ALL SELECT e.*, CASE lem WHEN 'necessário' THEN 'necessity' WHEN 'obrigatório' THEN 'obligation' ELSE 'capacity' END, ord FROM e WHERE lem IN ('necessário', 'obrigatório', 'capaz') AND pos = 'ADJ' AND nucleus),
x AS (SELECT lex.doc_id, lex.ord, own.ord AS x FROM lex JOIN own ON own.doc_id = lex.doc_id AND own.owner = lex.nuc WHERE lex.pos = 'ADV'
  UNION SELECT lex.doc_id, lex.ord, anc.ord FROM lex JOIN n k ON k.doc_id = lex.doc_id AND k.head = lex.ord AND k.ord <> lex.ord AND k.dep IN {_COMP} JOIN anc ON anc.doc_id = k.doc_id AND anc.top = k.ord WHERE lex.pos = 'ADJ'),
s AS (SELECT doc_id, ord, string_agg(x::VARCHAR, ',' ORDER BY x) AS scope FROM x GROUP BY ALL)
SELECT lex.doc_id, CAST(period AS BIGINT) AS period, 'modal_lexical' AS rule, category, lex.ord::VARCHAR AS marker, nuc::VARCHAR AS nucleus, scope FROM lex LEFT JOIN s USING (doc_id, ord)""")
def rule_modal_lexical(spark, sf_dir):
    return of_rule(spark, "modal_lexical")


@query(BASE + """, p AS (SELECT a.doc_id, a.period, a.ord AS ao, a.owner AS aw, k.ord AS bo, k.owner AS bw FROM e a JOIN e s ON s.doc_id = a.doc_id AND s.period = a.period AND s.ord = a.ord + 1 JOIN e k ON k.doc_id = a.doc_id AND k.period = a.period AND k.ord >= a.ord + 2 JOIN e l ON l.doc_id = k.doc_id AND l.period = k.period AND l.ord = k.ord + 1
  WHERE a.low = 'não' AND s.low IN ('só', 'somente', 'apenas') AND a.pos IN ('ADV', 'PART') AND s.pos = 'ADV' AND a.dep IN ('advmod', 'neg') AND k.low = 'mas' AND l.low = 'também' AND k.pos = 'CCONJ' AND k.dep = 'cc' AND l.pos = 'ADV' AND k.owner = l.owner
  AND (a.owner = k.owner OR (k.odep = 'conj' AND k.parent = a.owner) OR (a.odep = 'conj' AND a.parent = k.owner)))
SELECT doc_id, CAST(period AS BIGINT) AS period, 'correlative_negation' AS rule, 'correlative_addition' AS category, ao || ',' || (ao + 1) || ',' || bo || ',' || (bo + 1) AS marker, CASE WHEN aw = bw THEN aw::VARCHAR ELSE least(aw, bw) || ',' || greatest(aw, bw) END AS nucleus,
  (SELECT string_agg(DISTINCT own.ord::VARCHAR, ',' ORDER BY own.ord::VARCHAR) FROM own WHERE own.doc_id = p.doc_id AND own.owner IN (aw, bw)) AS scope FROM p""")
def rule_correlative(spark, sf_dir):
    return of_rule(spark, "correlative_negation")


@query(BASE + """, g AS (SELECT doc_id, period, owner, region, count(*) AS k, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS marker FROM e WHERE low IN ('não', 'nunca', 'nem') AND pos IN ('ADV', 'PART', 'CCONJ') AND dep IN ('advmod', 'cc', 'neg') AND owner IS NOT NULL AND (hnuc OR head = ord) GROUP BY ALL)
SELECT doc_id, CAST(period AS BIGINT) AS period, 'negation_multiple' AS rule, 'multiple_markers' AS category, marker, owner::VARCHAR AS nucleus, (SELECT string_agg(own.ord::VARCHAR, ',' ORDER BY own.ord) FROM own WHERE own.doc_id = g.doc_id AND own.owner = g.owner) AS scope FROM g WHERE k > 1""")
def rule_negation_multiple(spark, sf_dir):
    return of_rule(spark, "negation_multiple")


@query(BASE + " SELECT doc_id, CAST(period AS BIGINT) AS period, CAST(count(*) AS BIGINT) AS unknown FROM t WHERE pos IS NULL GROUP BY ALL")
def rule_pos_gap_guard(spark, sf_dir):
    """Periods with a token of unknown class: no occurrence of theirs has a scope."""
    rows = fixture.annotated(spark)
    gaps = rows.where("pos is null").groupBy("doc_id", "period").agg(F.count("*").alias("unknown"))
    scoped = rules.detect(rows, only=["clause", "modal_verbal", "tense"]).where("scope is not null").select("doc_id", "period").distinct()
    return bigints(gaps.join(scoped, ["doc_id", "period"], "left_anti"))


@query(BASE + " SELECT e.doc_id, CAST(e.ord AS BIGINT) AS ord, CAST(e.parent AS BIGINT) AS verb FROM e JOIN n v ON v.doc_id = e.doc_id AND v.ord = e.parent WHERE e.nucleus AND e.dep IN ('ccomp', 'parataxis') AND v.lemma IN " + _in(rules.SPEECH) + " UNION SELECT e.doc_id, e.ord, p.parent FROM e JOIN e p ON p.doc_id = e.doc_id AND p.ord = e.parent JOIN n v ON v.doc_id = p.doc_id AND v.ord = p.parent WHERE e.nucleus AND p.dep IN ('ccomp', 'parataxis') AND v.lemma IN " + _in(rules.SPEECH))
def rule_reported_speech(spark, sf_dir):
    return bigints(rules.reported_speech(rules.Index(fixture.annotated(spark))))


# Notes, pendings and records -----------------------------------------------------------------------------------------

_RULES = [r for r, _, _ in rules.CATALOGUE]
_SHOWN = {
    "correlative_negation": "rule_correlative", "clause": "rule_clauses", "negation_nao": "rule_negation_simple", "negation_nunca": "rule_negation_temporal", "negation_nem": "rule_negation_additive", "negation_multiple": "rule_negation_multiple",
    "tense": "rule_tense", "relative_time": "rule_relative_time", "modal_verbal": "rule_modal_verbal", "modal_lexical": "rule_modal_lexical", "connector": "rule_connector", "therefore": "rule_therefore",
}


def occurrences_sql(names: list[str] = _RULES) -> str:
    """All occurrences of the named rules by the rules' own SQL: occ, with m (first marker) and n (first nucleus)."""
    every = " UNION ALL ".join(f"SELECT doc_id, period, rule, category, marker, nucleus, scope FROM ({ORACLES[_SHOWN[r]]}) AS o_{r}" for r in names)
    return f", occ AS (SELECT *, split_part(marker, ',', 1)::BIGINT AS m, CASE WHEN nucleus <> '' THEN split_part(nucleus, ',', 1)::BIGINT END AS n FROM ({every}) AS every_rule)"


_WORDS = {"correlative_negation": ["não", "só", "somente", "apenas", "mas", "também"], "negation_nao": ["não"], "negation_nunca": ["nunca"], "negation_nem": ["nem"], "negation_multiple": ["não", "nunca", "nem"], "relative_time": ["ontem", "hoje", "amanhã", "quando"]}
_ADJ, _ADVB = "('necessário', 'obrigatório', 'capaz')", "('talvez', 'possivelmente', 'provavelmente')"
#: (doc_id, period, rule) of periods with a missing class in which the rule has a candidate.
_AFFECTED = """, cand AS (
  SELECT doc_id, period, 'clause' AS rule FROM e WHERE nucleus OR pos IS NULL
  UNION SELECT doc_id, period, 'correlative_negation' FROM e WHERE low IN ('não', 'só', 'somente', 'apenas', 'mas', 'também') AND coalesce(pos, 'ADV') IN ('ADV', 'PART', 'CCONJ')
  UNION SELECT doc_id, period, CASE low WHEN 'não' THEN 'negation_nao' WHEN 'nunca' THEN 'negation_nunca' ELSE 'negation_nem' END FROM e WHERE low IN ('não', 'nunca', 'nem') AND (coalesce(pos, 'ADV') IN ('ADV', 'PART', 'CCONJ') OR region IS NOT NULL)
  UNION SELECT doc_id, period, 'negation_multiple' FROM e WHERE low IN ('não', 'nunca', 'nem') AND (coalesce(pos, 'ADV') IN ('ADV', 'PART', 'CCONJ') OR region IS NOT NULL)
  UNION SELECT doc_id, period, 'tense' FROM e WHERE coalesce(pos, 'VERB') IN ('VERB', 'AUX')
  UNION SELECT doc_id, period, 'relative_time' FROM e WHERE low IN ('ontem', 'hoje', 'amanhã', 'quando') AND coalesce(pos, 'ADV') IN ('ADV', 'SCONJ')
  UNION SELECT doc_id, period, 'modal_verbal' FROM e WHERE pos IN ('VERB', 'AUX') AND (lem IS NULL OR lem IN """ + _in(rules.MODALS) + """)
  UNION SELECT doc_id, period, 'modal_lexical' FROM e WHERE (low IN """ + _ADVB + """ AND coalesce(pos, 'ADV') = 'ADV') OR (lem IN """ + _ADJ + """ AND coalesce(pos, 'ADJ') = 'ADJ')
  UNION SELECT doc_id, period, 'connector' FROM e WHERE low IN ('mas', 'porque', 'se', 'quando') AND coalesce(pos, 'ADV') IN ('CCONJ', 'SCONJ', 'ADV')
  UNION SELECT p.doc_id, p.period, 'therefore' FROM e p JOIN e i ON i.doc_id = p.doc_id AND i.period = p.period AND i.ord = p.ord + 1 WHERE p.low = 'por' AND i.low = 'isso'),
affected AS (SELECT cand.* FROM cand JOIN unk USING (doc_id, period))"""  # fmt: skip
#: The markers that the simple rules leave to a complete correlative pair, by the pair's own SQL.
_HIDDEN = """, hidden AS (SELECT doc_id, unnest([split_part(marker, ',', 1)::BIGINT, split_part(marker, ',', 3)::BIGINT]) AS ord FROM ({sql}) AS pairs)"""


def pendings_sql() -> str:
    one = lambda rule, kind, where, source="e": f"SELECT doc_id, '{rule}' AS rule, '{kind}' AS kind, ord::VARCHAR AS tokens FROM {source} WHERE {where}"
    parts = [one(r, "class", f"pos IS NULL AND low IN {_in(w)}") for r, w in _WORDS.items()]
    parts += [
        "SELECT doc_id, 'clause', 'class', string_agg(ord::VARCHAR, ',' ORDER BY ord) FROM e WHERE pos IS NULL GROUP BY doc_id",
        one("tense", "class", "pos IS NULL"), one("tense", "feature", "pos IN ('VERB', 'AUX') AND feats IS NULL"), one("modal_verbal", "class", "pos IS NULL"), one("modal_verbal", "lemma", "pos IN ('VERB', 'AUX') AND lemma IS NULL"),
        one("modal_verbal", "infinitive", "pos IN ('VERB', 'AUX') AND dep = 'xcomp' AND coalesce(feats, '') NOT LIKE '%VerbForm=%' AND head <> ord AND EXISTS (SELECT 1 FROM e s WHERE s.doc_id = e.doc_id AND s.ord = e.head AND s.lem IN ('saber', 'conseguir') AND s.pos IN ('VERB', 'AUX'))"),
        one("modal_lexical", "lemma", "pos = 'ADJ' AND nucleus AND lemma IS NULL"), one("modal_lexical", "class", f"pos IS NULL AND (low IN {_ADVB} OR lem IN {_ADJ})"),
        one("connector", "class", "pos IS NULL AND low IN ('mas', 'porque', 'se', 'quando') AND NOT EXISTS (SELECT 1 FROM hidden h WHERE h.doc_id = e.doc_id AND h.ord = e.ord)"),
        "SELECT p.doc_id, 'therefore', 'class', CASE WHEN p.pos IS NULL AND i.pos IS NULL THEN p.ord || ',' || i.ord WHEN p.pos IS NULL THEN p.ord::VARCHAR ELSE i.ord::VARCHAR END FROM e p JOIN e i ON i.doc_id = p.doc_id AND i.period = p.period AND i.ord = p.ord + 1 WHERE p.low = 'por' AND i.low = 'isso' AND (p.pos IS NULL OR i.pos IS NULL)",
        "SELECT a.doc_id, a.rule, 'boundaries', string_agg(e.ord::VARCHAR, ',' ORDER BY e.ord) FROM affected a JOIN e ON e.doc_id = a.doc_id AND e.period = a.period WHERE e.pos IS NULL GROUP BY a.doc_id, a.period, a.rule",
    ]
    return _AFFECTED + _HIDDEN.format(sql=ORACLES["rule_correlative"]) + ", pend AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + ") AS p)"


@query(BASE + pendings_sql() + " SELECT * FROM pend")
def rule_pendings(spark, sf_dir):
    """What the rules miss: classes, features, lemmas, infinitives, and boundaries that hang on missing classes."""
    return notes.pendings(fixture.annotated(spark)).withColumn("tokens", F.array_join(F.transform("tokens", lambda x: x.cast("string")), ","))


def notes_sql() -> str:
    ungated = {r: ORACLES[_SHOWN[r]].replace("CASE WHEN unk.doc_id IS NULL AND m.ok THEN s.scope END", "CASE WHEN m.ok THEN s.scope END") for r in ("negation_nao", "negation_nunca", "negation_nem")}
    single = " UNION ALL ".join(f"SELECT doc_id, period, rule, category, marker::BIGINT AS m, nucleus, scope FROM ({q}) AS u_{r}" for r, q in ungated.items())
    note = lambda kind, code, source, target="NULL": f"SELECT doc_id, period, rule, category, m AS ord, '{kind}' AS kind, '{code}' AS code, {target} AS target FROM {source}"
    limited = [note("link", "marker_negation", "negated", "x"), note("ambiguity", "negated_marker", "negated"), note("link", "negation_in_content", "denied", "x"), note("ambiguity", "negated_content", "denied"), note("context", "content", "modal WHERE NOT EXISTS (SELECT 1 FROM content c WHERE c.doc_id = modal.doc_id AND c.m = modal.m)")]
    quoted = [
        note("link", "quote_delimiter", "looked WHERE region IS NOT NULL", "region"), note("ambiguity", "quoted", "looked WHERE closed"), note("context", "mention_or_speech", "looked WHERE closed AND coalesce(n_region, -1) <> region"),
        note("ambiguity", "unclosed_quote", "looked WHERE region IS NOT NULL AND NOT closed"), note("context", "unclosed_quote", "looked WHERE region IS NOT NULL AND NOT closed"), note("context", "nested_quotes", "looked WHERE nested"),
        note("link", "reported_speech", "looked WHERE verb IS NOT NULL", "verb"), note("ambiguity", "reported", "looked WHERE verb IS NOT NULL"), note("context", "source_of_speech", "looked WHERE verb IS NOT NULL"),
    ]
    own = [
        note("ambiguity", "constituent", "single JOIN e x ON x.doc_id = single.doc_id AND x.ord = single.m JOIN e h ON h.doc_id = x.doc_id AND h.ord = x.head WHERE x.pos IN ('ADV', 'PART', 'CCONJ') AND x.dep IN ('advmod', 'neg', 'cc', 'root') AND x.head <> x.ord AND h.pos IS NOT NULL AND NOT h.nucleus AND h.dep NOT IN ('aux', 'cop')").replace("doc_id, period, rule, category", "single.doc_id, single.period, single.rule, single.category", 1),
        note("context", "scope", "single WHERE scope IS NULL"), note("context", "time_reference", "occ WHERE category = 'relative_reference'"),
        *(note("alternative", a, "occ JOIN lemmas USING (doc_id, m) WHERE rule = 'modal_verbal' AND lem = 'poder'") for a in ("possibility", "permission", "capacity")),
        *(note(k, "reading_of_poder", "occ JOIN lemmas USING (doc_id, m) WHERE rule = 'modal_verbal' AND lem = 'poder'") for k in ("ambiguity", "context")),
        *(note("alternative", a, "occ JOIN lemmas USING (doc_id, m) WHERE rule = 'modal_verbal' AND lem = 'dever'") for a in ("obligation", "epistemic_inference")),
        note("ambiguity", "reading_of_dever", "occ JOIN lemmas USING (doc_id, m) WHERE rule = 'modal_verbal' AND lem = 'dever'"), note("context", "expressed_wish", "occ WHERE rule = 'modal_verbal' AND category = 'wish'"),
        note("link", "content", f"occ JOIN (SELECT doc_id AS d, head, ord AS x FROM e WHERE dep IN {_in(rules.COMPLEMENTS)} AND head <> ord) k ON k.d = occ.doc_id AND k.head = occ.m WHERE rule = 'modal_lexical' AND category IN ('necessity', 'obligation', 'capacity')", "x"),
        note("context", "related_unit", "occ WHERE rule = 'connector' AND (SELECT parent FROM e WHERE e.doc_id = occ.doc_id AND e.ord = occ.n) IS NULL"), note("ambiguity", "cause_in_complement", "occ WHERE rule = 'connector' AND category = 'cause' AND (SELECT dep FROM e WHERE e.doc_id = occ.doc_id AND e.ord = occ.n) = 'ccomp'"),
        note("ambiguity", "antecedent", "occ WHERE rule = 'therefore' AND coalesce((SELECT parent FROM e WHERE e.doc_id = occ.doc_id AND e.ord = occ.n) < m, false)"), note("context", "antecedent", "occ WHERE rule = 'therefore' AND NOT coalesce((SELECT parent FROM e WHERE e.doc_id = occ.doc_id AND e.ord = occ.n) < m, false)"),
    ]
    every = " UNION ALL ".join([*quoted, *limited, *own])
    return _AFFECTED + occurrences_sql() + f""", single AS ({single}), lemmas AS (SELECT doc_id, ord AS m, lem FROM e),
speech AS ({ORACLES["rule_reported_speech"]}),
place AS (SELECT occ.*, CASE WHEN rule = 'therefore' THEN split_part(marker, ',', 2)::BIGINT ELSE m END AS at FROM occ WHERE rule NOT IN ('clause', 'negation_multiple')),
seen AS (SELECT p.*, x.region, coalesce(x.rclosed, false) AND x.region IS NOT NULL AS closed, CASE WHEN rule IN ('modal_verbal', 'modal_lexical') THEN x.owner ELSE p.n END AS nuc,
  coalesce(x.region IS NOT NULL AND EXISTS (SELECT 1 FROM reg o JOIN reg i ON i.doc_id = o.doc_id AND i.opened = x.region WHERE o.doc_id = p.doc_id AND o.opened < i.opened AND (o.closed IS NULL OR o.closed > i.opened)), false) AS nested
  FROM place p JOIN e x ON x.doc_id = p.doc_id AND x.ord = p.at),
looked AS (SELECT s.*, (SELECT region FROM r WHERE r.doc_id = s.doc_id AND r.ord = s.nuc) AS n_region, (SELECT min(verb) FROM speech v WHERE v.doc_id = s.doc_id AND v.ord = s.nuc) AS verb FROM seen s),
modal AS (SELECT occ.*, x.pos AS m_pos, x.dep AS m_dep, x.head AS m_head FROM occ JOIN e x ON x.doc_id = occ.doc_id AND x.ord = occ.m WHERE rule IN ('modal_verbal', 'modal_lexical')),
content AS (SELECT modal.doc_id, modal.m, anc.ord AS x FROM modal JOIN e k ON k.doc_id = modal.doc_id AND k.head = modal.m AND k.ord <> modal.m AND k.dep IN {_in(rules.COMPLEMENTS)} JOIN anc ON anc.doc_id = k.doc_id AND anc.top = k.ord WHERE m_pos <> 'ADV' AND m_dep <> 'aux'
  UNION SELECT modal.doc_id, modal.m, anc.ord FROM modal JOIN anc ON anc.doc_id = modal.doc_id AND anc.top = modal.m_head WHERE m_pos <> 'ADV' AND m_dep = 'aux' AND anc.ord <> modal.m
  UNION SELECT doc_id, m, unnest(string_split(scope, ','))::BIGINT FROM modal WHERE m_pos = 'ADV' AND scope IS NOT NULL),
negator AS (SELECT doc_id AS d, ord AS x, head FROM e WHERE low IN ('não', 'nunca', 'nem') AND dep IN ('advmod', 'neg', 'cc')),
negated AS (SELECT modal.*, x FROM modal JOIN negator ON d = doc_id AND negator.head = modal.m AND x <> modal.m),
denied AS (SELECT modal.doc_id, period, rule, category, modal.m, min(negator.x) AS x FROM modal JOIN content c ON c.doc_id = modal.doc_id AND c.m = modal.m JOIN negator ON d = c.doc_id AND negator.x = c.x GROUP BY ALL),
made AS ({every}),
several AS (SELECT o.doc_id, made.period, o.rule, o.category, made.ord, kind, code, target FROM made JOIN occ o ON o.rule = 'negation_multiple' AND o.doc_id = made.doc_id AND o.m = made.ord WHERE made.rule IN ('negation_nao', 'negation_nunca', 'negation_nem')),
gaps AS (SELECT occ.doc_id, occ.period, occ.rule, category, m AS ord, 'context' AS kind, 'missing_class' AS code, NULL AS target FROM occ JOIN affected USING (doc_id, period, rule)),
noted AS (SELECT DISTINCT doc_id, CAST(period AS BIGINT) AS period, rule, category, CAST(ord AS BIGINT) AS ord, kind, code, CAST(target AS BIGINT) AS target FROM (SELECT * FROM made UNION ALL SELECT * FROM several UNION ALL SELECT * FROM gaps) AS n)"""


@query(BASE + notes_sql() + " SELECT * FROM noted")
def rule_context_notes(spark, sf_dir):
    """Links, ambiguities, alternatives and needs of context of all occurrences."""
    return bigints(notes.notes(fixture.annotated(spark)))


@query(_HIDDEN.format(sql=ORACLES["rule_correlative"]).replace(", hidden", "WITH hidden", 1) + " SELECT doc_id, CAST(ord AS BIGINT) AS ord FROM hidden")
def rule_suppression(spark, sf_dir):
    """The não and mas that the simple rules leave to complete correlative pairs."""
    return bigints(rules.suppressed(rules.Index(fixture.annotated(spark)).pairs()))


@query(BASE + pendings_sql() + occurrences_sql() + f""", names(rule) AS (VALUES {", ".join(f"('{r}')" for r in _RULES)}),
n_occ AS (SELECT rule, count(*) AS k FROM occ GROUP BY rule), n_pend AS (SELECT rule, count(*) AS k FROM pend GROUP BY rule)
SELECT rule, CAST(CASE WHEN rule IN ('tense', 'therefore') THEN 0 ELSE coalesce(o.k, 0) END AS BIGINT) AS occurrences, CAST(CASE WHEN rule IN ('tense', 'therefore') THEN 0 ELSE coalesce(p.k, 0) END AS BIGINT) AS pendings,
  CASE WHEN rule = 'therefore' THEN 'disabled' WHEN rule = 'tense' THEN 'failed' WHEN coalesce(p.k, 0) = 0 THEN 'done' WHEN coalesce(o.k, 0) > 0 THEN 'done_with_pendings' ELSE 'blocked' END AS state
FROM names LEFT JOIN n_occ o USING (rule) LEFT JOIN n_pend p USING (rule)""")
def rule_states(spark, sf_dir):
    """States of the rules' runs over the annotated sentences; one rule is switched off and one counts as failed."""
    rows = fixture.annotated(spark)
    ix, names = rules.Index(rows), [r for r in _RULES if r != "therefore"]
    enabled = rules.catalogue(spark).select("rule", (F.col("rule") != "therefore").alias("enabled"))
    return bigints(rules.states(rules.detect(rows, names, ix), notes.pendings(rows, names, ix), enabled, failed=["tense"]))


@query(BASE + occurrences_sql() + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY m, rule, category, marker) - 1 AS number, rule, category, m AS first_marker FROM occ")
def occ_order(spark, sf_dir):
    rows = rules.ordered(rules.detect(fixture.annotated(spark)))
    return bigints(rows.select("doc_id", "number", "rule", "category", F.element_at("marker", 1).alias("first_marker")))


@query(BASE + occurrences_sql(["clause", "connector", "tense"]) + """, l AS (SELECT doc_id, rule, m, 'predicate' AS kind, n AS target FROM occ WHERE rule = 'tense' AND n IS NOT NULL UNION ALL SELECT doc_id, rule, m, 'marked_clause', n FROM occ WHERE rule = 'connector'
  UNION ALL SELECT occ.doc_id, rule, m, 'related_to', e.parent FROM occ JOIN e ON e.doc_id = occ.doc_id AND e.ord = occ.n WHERE rule = 'connector' AND e.parent IS NOT NULL),
c AS (SELECT doc_id, n AS target, m AS clause_marker FROM occ WHERE rule = 'clause')
SELECT doc_id, rule, m AS first_marker, kind, CAST(target AS BIGINT) AS target, clause_marker FROM l LEFT JOIN c USING (doc_id, target)""")
def occ_links(spark, sf_dir):
    return bigints(rules.clause_links(rules.detect(fixture.annotated(spark), only=["clause", "connector", "tense"])))


@query(BASE + occurrences_sql() + """, ev AS (SELECT DISTINCT doc_id, rule, category, m, unnest(string_split(marker || CASE WHEN nucleus = '' THEN '' ELSE ',' || nucleus END, ','))::BIGINT AS token FROM occ)
SELECT ev.doc_id, rule, category, m AS first_marker, ev.token, a.lemma, a.pos, a.feats, a.dep, CAST(a.head AS BIGINT) AS head FROM ev JOIN a ON a.doc_id = ev.doc_id AND a.ord = ev.token""")
def occ_evidence(spark, sf_dir):
    """The annotations of each occurrence's marker and nucleus."""
    rows = fixture.annotated(spark)
    return bigints(notes.annotations_used(rules.detect(rows), rows))


@query(BASE + notes_sql() + """, cl AS (SELECT doc_id, n AS target, m AS to_marker FROM occ WHERE rule = 'clause'),
tied AS (SELECT doc_id, rule, m, unnest(string_split(nucleus, ','))::BIGINT AS target FROM occ WHERE rule <> 'clause' AND nucleus <> ''),
neg AS (SELECT doc_id, m AS target, rule AS to_rule FROM occ WHERE rule IN ('negation_nao', 'negation_nunca', 'negation_nem'))
SELECT DISTINCT t.doc_id, t.rule, t.m AS first_marker, 'associated_structure' AS kind, 'clause' AS to_rule, cl.to_marker FROM tied t JOIN cl USING (doc_id, target)
UNION SELECT n.doc_id, n.rule, n.ord, n.code, 'clause', cl.to_marker FROM noted n JOIN cl ON cl.doc_id = n.doc_id AND cl.target = n.target WHERE n.kind = 'link'
UNION SELECT n.doc_id, n.rule, n.ord, n.code, neg.to_rule, neg.target FROM noted n JOIN neg ON neg.doc_id = n.doc_id AND neg.target = n.target WHERE n.kind = 'link' AND n.code IN ('marker_negation', 'negation_in_content')""")
def occ_associated(spark, sf_dir):
    """Links from occurrence to occurrence: the clauses of nuclei, and those that the notes lead to."""
    rows = fixture.annotated(spark)
    ix = rules.Index(rows)
    made = notes.occurrence_links(rules.ordered(rules.detect(rows, index=ix)), notes.notes(rows, index=ix))
    coded = ["associated_structure", "quote_delimiter", "reported_speech", "marker_negation", "negation_in_content"]
    noted = F.col("kind").isin(coded) | ((F.col("rule") == "modal_lexical") & (F.col("kind") == "content"))
    return bigints(made.where(noted))


@query(BASE + occurrences_sql(["tense"]) + """ SELECT doc_id, rule, m AS first_marker, 'unknown' AS "check" FROM occ WHERE m % 5 = 0 UNION ALL SELECT doc_id, rule, m, 'repeated' FROM occ WHERE m % 5 = 1 UNION ALL SELECT doc_id, rule, m, 'empty_scope' FROM occ WHERE m % 5 = 2
UNION ALL SELECT doc_id, rule, m, 'periods' FROM occ WHERE m % 5 = 3 AND period > 0""")
def occ_proposals(spark, sf_dir):
    """Occurrences of verb forms, damaged by the place of their marker: each damage is named, and no other."""
    rows = fixture.annotated(spark)
    found, first = rules.detect(rows, only=["tense"]), F.element_at("marker", 1)
    kind = first % 5
    nucleus = F.when(kind == 0, F.array(F.lit(-9))).when(kind == 1, F.array(first, first)).when((kind == 3) & (F.col("period") > 0), F.array(F.lit(0))).otherwise(F.col("nucleus"))
    scope = F.when(kind == 2, F.array().cast("array<int>")).otherwise(F.col("scope"))
    return bigints(notes.proposal_violations(found.withColumn("nucleus", nucleus.cast("array<int>")).withColumn("scope", scope), rows))


@query(BASE + occurrences_sql(["clause"]) + " SELECT doc_id, 'clause' AS rule, 'recorded' AS side, count(*) AS rows FROM occ WHERE m % 4 = 1 GROUP BY doc_id UNION ALL SELECT doc_id, 'clause', 'recomputed', count(*) FROM occ WHERE m % 4 IN (1, 2) GROUP BY doc_id")
def occ_recompute(spark, sf_dir):
    """A record in which some occurrences were changed and some left out, against a new run; a rule that had failed is left out."""
    rows = fixture.annotated(spark)
    kept = rules.detect(rows).where("rule not in ('tense', 'connector')").where("rule <> 'clause' or element_at(marker, 1) % 4 <> 2")
    kept = kept.withColumn("category", F.when((F.col("rule") == "clause") & (F.element_at("marker", 1) % 4 == 1), "changed").otherwise(F.col("category")))
    enabled = [r for r in _RULES if r != "connector"]
    return notes.differences(kept, rows, enabled, failed=["tense"]).groupBy("doc_id", "rule", "side").agg(F.count("*").alias("rows"))


@query(TREES + " , f AS (SELECT doc_id, owner, ord, ord - row_number() OVER (PARTITION BY doc_id, owner ORDER BY ord) AS island FROM own) SELECT doc_id, owner, CAST(min(ord) AS BIGINT) AS first, CAST(max(ord) AS BIGINT) AS last FROM f GROUP BY doc_id, owner, island")
def occ_fragments(spark, sf_dir):
    """Runs of consecutive tokens of each clause."""
    return bigints(tree.fragments_in(formula_forests(spark, sf_dir, "pos", "dep")))


_CAT = "(VALUES " + ", ".join(f"('{r}', {p}, '{f}')" for r, p, f in rules.CATALOGUE) + ") AS c(rule, priority, family)"


@query("WITH d AS (SELECT event_id, CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{r}'" for i, (r, _, _) in enumerate(rules.CATALOGUE)) + f""" END AS rule FROM events),
o AS (SELECT rule, count(*) AS n FROM d WHERE event_id % 36 <> 4 GROUP BY rule), p AS (SELECT rule, count(*) AS n FROM d WHERE event_id % 24 = 5 GROUP BY rule),
s AS (SELECT c.rule, c.family, CASE WHEN c.rule = 'tense' THEN 0 ELSE coalesce(o.n, 0) END AS occurrences, CASE WHEN c.rule = 'tense' THEN 'disabled' WHEN coalesce(p.n, 0) = 0 THEN 'done' WHEN coalesce(o.n, 0) > 0 THEN 'done_with_pendings' ELSE 'blocked' END AS state FROM {_CAT} LEFT JOIN o USING (rule) LEFT JOIN p USING (rule))
SELECT family, count(*) AS rules, CAST(sum(occurrences) AS BIGINT) AS occurrences, bool_and(state IN ('done', 'disabled')) AS ready FROM s GROUP BY family""")
def rule_family_rollup(spark, sf_dir):
    """Run states by family, over events dealt to the rules."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    names = F.array(*(F.lit(r) for r, _, _ in rules.CATALOGUE))
    d = e.withColumn("rule", F.element_at(names, (F.col("event_id") % 12 + 1).cast("int")))
    catalogue = rules.catalogue(spark)
    states = rules.states(d.where("event_id % 36 <> 4"), d.where("event_id % 24 = 5"), catalogue.select("rule", (F.col("rule") != "tense").alias("enabled")))
    return bigints(rules.by_family(states, catalogue))
