"""Rules over the index: each is a scan; and a parser that never holds more than a few documents."""

import pandas as pd
import pyarrow as pa

from lexspan.operators import annotate, rules
from lexspan.plans import fixture


def test_rules_scan_the_index(spark):
    names = ["clause", "tense", "relative_time", "modal_verbal", "modal_lexical", "connector", "therefore", "negation_nao"]
    found = rules.detect(fixture.annotated(spark), names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert found.count() > 50


def test_parser_holds_few_documents(spark):
    docs = [(d, 0, k, f"w{k}") for d in range(300) for k in range(3)]
    tokens = spark.createDataFrame(docs, "doc_id long, period int, ord int, token string").coalesce(1)

    def provider():
        return lambda words: ([w["ord"] for w in words], ["ROOT"] * len(words), [(0, 0, "MISC")])

    parses = annotate.parsed(tokens, provider)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"n": [b.num_rows]}))

    assert parses.count() == 300 and annotate.trees(tokens, parses).count() == 900
    assert max(r.n for r in parses.mapInArrow(sizes, "n long").collect()) <= annotate.AT_ONCE


def test_index_copies_no_whole_head_or_owner(spark):
    """Of a token's head and owner the index lays out only the columns that the rules ask for."""
    from lexspan.operators import rules
    from lexspan.plans import fixture

    plan = rules.enriched(fixture.annotated(spark))._jdf.queryExecution().analyzed().toString()
    assert "up.t" not in plan and "ow.t" not in plan


def test_index_of_gathered_documents(spark):
    """Documents gathered into rows give the occurrences of their token rows; the index leaves out what no rule asks for."""
    from lexspan.operators import tree

    rows = fixture.annotated(spark)
    filler = spark.createDataFrame([(100, 0, k, f"w{k}", f"w{k}", "NOUN", "ROOT" if k == 0 else "nmod", 0, None) for k in range(40)], fixture.COLUMNS)
    rows = rows.unionByName(filler)
    index = rules.Index(tree.gathered(tree.forests(rows)))
    assert index.tokens.where("doc_id = 100").count() == 0 and rows.count() > index.tokens.count() > 100
    same = lambda df: sorted(map(str, df.collect()))
    assert same(rules.detect(None, index=index)) == same(rules.detect(rows))
    assert same(tree.spread(tree.gathered(tree.forests(rows))).select("doc_id", "ord", "token")) == same(rows.select("doc_id", "ord", "token"))


def test_order_meets_documents_once(spark):
    """Repeats and numbers of occurrences need one exchange, by document."""
    found = spark.createDataFrame(rules.detect(fixture.annotated(spark)).collect(), "doc_id long, period int, rule string, category string, marker array<int>, nucleus array<int>, scope array<int>, links array<struct<kind:string,target:int>>")
    plan = rules.ordered(found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_differences_count_rows(spark):
    """A record with an occurrence twice and another left out, against one run over the same index."""
    from lexspan.operators import notes

    index = rules.Index(fixture.annotated(spark))
    found = rules.detect(None, ["tense", "clause"], index)
    record = found.where("rule = 'tense'").unionByName(found.where("rule = 'tense'"))
    got = {(r.rule, r.side): r["count"] for r in notes.differences(record, None, ["tense", "clause"], index=index).groupBy("rule", "side").count().collect()}
    n = {r.rule: r["count"] for r in found.groupBy("rule").count().collect()}
    assert got == {("tense", "recorded"): n["tense"], ("clause", "recomputed"): n["clause"]}


def test_reported_speech_writes_no_index(spark):
    """What one rule reads once is not written first."""
    once, written = rules.Index(fixture.annotated(spark), written=False), rules.Index(fixture.annotated(spark))
    found = rules.reported_speech(once)
    assert "parquet" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(found.collect()) == sorted(rules.reported_speech(written).collect()) and found.count() > 0


def test_index_walks_periods_in_arrow_batches(spark):
    """The index is one walk over a period's row, not expressions that are interpreted for each token; a head outside, a
    cycle, a missing head of a copula and quotes that never close are walked too."""
    from pyspark.sql import functions as F

    rows = [(1, 0, 0, "“", "“", "PUNCT", "punct", 2, None), (1, 0, 1, "Não", "não", "ADV", "advmod", 2, None), (1, 0, 2, "quis", "querer", "VERB", "ROOT", 2, "VerbForm=Fin"), (1, 0, 3, "sair", "sair", "VERB", "xcomp", 2, "VerbForm=Inf"), (1, 0, 4, "que", "que", "SCONJ", "mark", 3, None)]
    rows += [(2, 0, 0, "a", "a", "VERB", "aux", 1, None), (2, 0, 1, "nem", "nem", "ADV", "advmod", 0, None), (2, 0, 2, "é", "ser", "AUX", "cop", None, None), (2, 0, 3, "x", "dever", "VERB", "obj", 9, None)]
    df = rules.enriched(spark.createDataFrame(rows, fixture.COLUMNS))
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.ord): r for r in df.orderBy("doc_id", "ord").collect()}
    modal = got[1, 2]
    assert (modal.own, modal.comps, modal.content, modal.cut, modal.able, modal.words) == ([0, 1, 2], [3], [3, 4], [3, 4], True, [4])
    assert got[1, 1].scope_own is None and got[1, 1].region == 0 and got[1, 1].region_closed is False and got[1, 1].nx.ord == 2
    assert got[1, 4].dep == "mark" and got[1, 2].whole_dep == "ROOT"
    assert got[2, 3].nucleus and got[2, 3].head_pos is None and got[2, 3].own == [3] and got[2, 0].nucleus is None and got[2, 1].owner is None
    assert df.where(F.col("unknown")).count() == 0


def test_evidence_is_in_the_index(spark):
    """Annotations of evidence come from the index; no table of all tokens is joined."""
    from lexspan.operators import notes

    rows = fixture.annotated(spark)
    index = rules.Index(rows)
    found = rules.detect(None, index=index)
    same = lambda df: sorted(map(str, df.collect()))
    assert same(notes.annotations_used(found, index.annotations())) == same(notes.annotations_used(found, rows))


def test_proposals_meet_stretches_of_tokens(spark):
    """Occurrences meet a document's periods, not its tokens; what lies in no one period is still looked at by token."""
    from lexspan.operators import notes, tree

    rows = spark.createDataFrame([(1, p, o, "w", "w", "VERB", "ROOT", o, None) for p, os in ((0, [0, 1, 2]), (1, [4, 5])) for o in os], fixture.COLUMNS)
    given = [([0], [1], [0, 1, 2]), ([0], [4], None), ([3], [], None), ([], [0, 0], []), ([5], [9], [4, 5])]
    found = spark.createDataFrame([(1, f"r{k}", *x) for k, x in enumerate(given)], "doc_id long, rule string, marker array<int>, nucleus array<int>, scope array<int>")
    want = [("r1", "periods"), ("r2", "unknown"), ("r3", "empty_scope"), ("r3", "marker"), ("r3", "repeated"), ("r4", "unknown")]
    for some in (rows, tree.gathered(tree.forests(rows))):
        bad = notes.proposal_violations(found, some)
        assert "Generate explode(concat" not in bad._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.rule, r.check) for r in bad.collect()) == want


def test_order_writes_out_only_what_is_open(spark):
    """Repeats go, numbers have no gaps, and an occurrence alone at its marker is not written out as text."""
    kind = "doc_id long, period int, rule string, category string, marker array<int>, nucleus array<int>, scope array<int>, links array<struct<kind:string,target:int>>"
    found = spark.createDataFrame([(1, 0, "a", "x", [3], [1], None, []), (1, 0, "a", "x", [3], [1], None, []), (1, 0, "a", "x", [3], [2], [1, 2], []), (1, 0, "b", "x", [0], [0], [0], [])], kind)
    rows = rules.ordered(found)
    assert sorted((r.number, r.rule, r.nucleus) for r in rows.collect()) == [(0, "b", [0]), (1, "a", [1]), (2, "a", [2])]
    assert "alike" in rows._jdf.queryExecution().optimizedPlan().toString()
