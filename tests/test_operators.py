"""Laws and small cases of the operators."""

import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspan.operators import context, evaluate, narrative, retrieval, rules, segment, spans, store, tree, vectors
from lexspan.plans import fixture

ALPHABET = ["a", "é", "é", "😀", " ", "\t", "\r", "\n", "\r\n", ".", "!", '"', "“"]
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def mapped(text: str, a: int, b: int) -> tuple[int, int]:
    """Piecewise, from the definition: places behind converted line ends move by one each."""
    at, work = [], 0
    i = 0
    while i < len(text):
        if text[i : i + 2] == "\r\n":
            at.append(work)
            i += 1
        i += 1
        work += 1
    return a + sum(x < a for x in at), b + sum(x < b for x in at)


@SLOW
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join), min_size=1, max_size=6))
def test_span_map_laws(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, original string")
    prepared = spans.prepare(docs)
    assert spans.violations(prepared, spans.span_map(prepared)).count() == 0
    work = [t.replace("\r\n", "\n") for t in texts]
    pairs = [(i, a, b) for i, w in enumerate(work) for a in range(len(w) + 1) for b in range(a, len(w) + 1)]
    got = spans.map_intervals(prepared, spark.createDataFrame(pairs, "doc_id long, work_start int, work_end int")).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert (r.original_start, r.original_end) == mapped(texts[r.doc_id], r.work_start, r.work_end)


def test_interval_vectors(spark):
    text = "Eu não queria sair.\r\nMas fiquei."
    for (a, b), want in {(20, 31): (21, 32), (18, 21): (18, 22), (19, 20): (19, 21), (19, 19): (19, 19), (20, 20): (21, 21)}.items():
        assert mapped(text, a, b) == want
        prepared = spans.prepare(spark.createDataFrame([(0, text)], "doc_id long, original string"))
        got = spans.map_intervals(prepared, spark.createDataFrame([(0, a, b)], "doc_id long, work_start int, work_end int")).first()
        assert (got.original_start, got.original_end) == want


def found_periods(spark, text):
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    p = segment.with_text(segment.periods(segment.with_periods(segment.tokens(segment.pieces(docs)))), docs)
    return [r.literal for r in p.orderBy("period").collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Vi o Dr. Silva. Saiu.", ["Vi o Dr. Silva.", "Saiu."]),
        ("Custa 2.5 reais... e mais. Fim", ["Custa 2.5 reais... e mais.", "Fim"]),
        ("Livros, etc. e mais. Livros, etc. Depois saiu.", ["Livros, etc. e mais.", "Livros, etc.", "Depois saiu."]),
        ("“Não vou.” Disse!! Foi?", ["“Não vou.”", "Disse!!", "Foi?"]),
        ("Um\n\nDois. Três", ["Um", "Dois.", "Três"]),
        ("", []),
        (" \n ", []),
    ],
)
def test_periods(spark, text, want):
    assert found_periods(spark, text) == want


def test_injected_tokenizer(spark):
    docs = spark.createDataFrame([(0, "ab  cd"), (1, None)], "doc_id long, text string")
    parts = segment.pieces_by(docs, lambda t: [m.span() for m in re.finditer(r"\S", t)])
    assert segment.rebuilt(parts, docs).collect()[0].same
    assert segment.tokens(parts).count() == 4
    with pytest.raises(Exception, match="overlap"):
        segment.pieces_by(docs, lambda t: [(0, 3), (1, 2)]).collect()


def test_context_reasons(spark):
    p = spark.createDataFrame([(0, i, int(i > 2), 10 * i, 10 * i + 5) for i in range(5)], "doc_id long, period int, paragraph int, start_pos int, end_pos int")
    got = {r.period: (r.first_period, r.last_period, r.reason_before, r.reason_after) for r in context.windows(p, 1, 2).collect()}
    assert got[0] == (0, 2, "document_edge", "radius_met")
    assert got[2] == (1, 2, "radius_met", "paragraph_fence")
    assert got[4] == (3, 4, "radius_met", "document_edge")
    assert context.windows(p, 0, 0).first().reason_before == "zero_radius"


def test_nested_and_open_quotes(spark):
    words = "a “ b « c » d ” e « f".split()
    rows = spark.createDataFrame([(0, i, w) for i, w in enumerate(words)], "doc_id long, ord int, token string")
    got = {(r.opened, r.closed, r.nested) for r in tree.quote_regions(rows).collect()}
    assert got == {(1, 7, False), (3, 5, True), (9, None, False)}
    inner = {r.ord: r.region for r in tree.with_regions(rows).collect()}
    assert inner == {0: None, 1: None, 2: 1, 3: None, 4: 3, 5: None, 6: 1, 7: None, 8: None, 9: None, 10: 9}


def test_rules_refuse_unknown_names(spark):
    with pytest.raises(ValueError):
        rules.detect(fixture.annotated(spark), ["clause", "clause"])
    with pytest.raises(ValueError):
        rules.detect(fixture.annotated(spark), ["nothing"])


def test_suppression_depends_on_the_enabled_rules(spark):
    index = rules.Index(fixture.annotated(spark))
    alone = rules.detect(index.rows, ["negation_nao"], index).count()
    both = rules.detect(index.rows, ["correlative_negation", "negation_nao"], index)
    assert both.where("rule = 'negation_nao'").count() == alone - both.where("rule = 'correlative_negation'").count()


def test_story_structure(spark):
    good = "Vi o Dr. Silva hoje. Ele saiu! Custou 2.5 reais? Sim. Fim."
    rows = [("good", "Um sai. Dois vêm. Três vão. Quatro ficam. Cinco somem."), ("abbreviation", good), ("colon", "Um: sai. Dois. Três. Quatro. Cinco."), ("open", "Um. Dois. Três. Quatro. Cinco"), ("two", "Um. Dois.\n\nTrês. Quatro. Cinco."), ("mark", "Um. Dois. Três. Quatro. Cinco."), ("empty", "")]
    got = {r.id: r for r in narrative.validated(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert {k for k, r in got.items() if r.valid} == {"good"}
    assert got["abbreviation"].periods == 5 and got["abbreviation"].forbidden == 1
    assert got["open"].open == 1 and got["two"].paragraphs == got["mark"].paragraphs == 2 and got["empty"].paragraphs == 0


def test_split_by_budget():
    split = vectors.split_by(lambda t: len(t) + 3, 10)
    text = "x" * 30
    assert split(text) == [(0, 7), (7, 14), (14, 21), (21, 28), (28, 30)]
    assert split("  ") == []
    with pytest.raises(ValueError):
        vectors.split_by(lambda t: 99, 10)("abc")


def test_vector_codec_and_configuration():
    assert vectors.decode(vectors.encode([0.6, 0.8])) == pytest.approx([0.6, 0.8])
    for bad in ([], [1.0, 1.0], [float("nan")]):
        with pytest.raises(ValueError):
            vectors.encode(bad)
    for bad in ({"profile": "x"}, {"max_tokens": 7}, {"batch": True}, {"aggregate": 1}):
        with pytest.raises(ValueError):
            vectors.configuration(**bad)


def test_embedding_provider_runs_once_for_equal_inputs(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "yy")], "artifact string, block_text string")
    got = {r.artifact: r.vector for r in vectors.embed(rows, lambda: lambda texts: [[float(len(t)), 0.0] for t in texts]).collect()}
    assert got == {"a": [1.0, 0.0], "b": [2.0, 0.0]}


def test_rebuilt_block_and_citations(spark):
    f = spark.createDataFrame([("b", 0, 0, 5, "abcde"), ("b", 1, 3, 8, "defgh"), ("c", 0, 0, 2, "ab"), ("c", 1, 3, 4, "d")], "block string, frag_no int, start_pos int, end_pos int, text string")
    got = {r.block: (r.text, r.gaps) for r in retrieval.rebuilt_blocks(f).collect()}
    assert got["b"] == ("abcdefgh", 0) and got["c"][1] == 1
    c = spark.createDataFrame([(1, "b", 2, 7, [0, 1]), (2, "b", 2, 7, [0]), (3, "b", 6, 7, [0, 1]), (4, "b", 2, 4, [9])], "citation int, block string, a int, b int, frags array<int>")
    assert {r.citation: r.covered for r in retrieval.covered(c, f).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_markdown_and_records(spark):
    rows = spark.createDataFrame([("a|b\nc", 1)], "x string, y int")
    assert evaluate.as_markdown(rows).first().line == "| a\\|b c | 1 |"
    assert json.loads(store.as_record(rows).first().record) == {"x": "a|b\nc", "y": 1}


def test_zoned_times(spark):
    rows = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+02:00",), ("2024-01-02T03:04:05",), ("x Z",), (None,)], "t string")
    assert [r[0] for r in rows.select(spans.zoned(F.col("t"))).collect()] == [True, True, False, False, False]


def test_chunks_give_the_tokens_and_periods_of_the_windows(spark):
    """Tokens and periods cut out of chunks equal those found token by token, over random texts of all marks that matter;
    the windows behind sort a row for each stretch, not for each token."""
    import random

    from lexspan.operators import segment

    random.seed(11)
    marks = ["Dr", "dra", "SR", "x-dr", "'dr", "3dr", "etc", "Etc", "Ab", "cd", "É", "́", "́-A", "3.5", "7,", ".", ".", "..", "...", "!", "?!", '"', "'", "”", "’", ")", "]", "“", "(", "«", " ", " ", "\n", "\n\n", "\n \n", "\r\n\r\n", "\t", ",", "-", "—", "😀"]
    texts = [(i, "".join(random.choice(marks) for _ in range(random.randint(0, 40)))) for i in range(2000)]
    texts += [(2000, None), (2001, "word " * 5000 + "end. Next"), (2002, ". " * 3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    old, new = segment.with_periods(segment.tokens(segment.pieces(docs))), segment.tagged_in(docs)
    assert sorted(map(tuple, new.select(old.columns).collect())) == sorted(map(tuple, old.collect()))
    assert sorted(map(tuple, segment.periods_in(docs).collect())) == sorted(map(tuple, segment.periods(old).collect()))
    assert segment.chunks(docs.where("doc_id = 2001")).count() == 2


def test_differences_keep_repeats_and_compute_each_side_once(spark):
    from lexspan.operators import context

    made = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "doc_id long, x string")
    again = spark.createDataFrame([(1, "a"), (2, None), (3, "d"), (3, "d")], "doc_id long, x string")
    found = context.differences(made, again)
    assert sorted(map(tuple, found.collect())) == [(1, "a", "recorded"), (3, "c", "recorded"), (3, "d", "recomputed"), (3, "d", "recomputed")]
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
