"""The corpus pipeline on a small corpus against brute force, and the odd cases of its stages."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

from .test_llm_operators import PATH, brute_passages, edited, grouped, prose, shingles

LEXICON = {
    "en": "the and of that with from house river night stone they have been which would there their about".split(),
    "de": "der und das mit von haus fluss nacht stein sie haben gewesen welche dort ihre nicht auch über".split(),
    "ru": "и в что с на дом река ночь камень они были который там их не также этот из".split(),
}


def text_in(rng, lang, n):
    return " ".join(rng.choice(LEXICON[lang]) + (str(rng.randint(0, 9)) if rng.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Texts in three languages with copies, near copies, passages, benchmark leaks, nulls and blanks."""
    rng, rows = random.Random(31), []
    items = {i: text_in(rng, "en", 30) for i in range(5)}
    passage = text_in(rng, "de", 70)
    for i in range(120):
        lang = rng.choice(list(LEXICON))
        rows.append((i, text_in(rng, lang, rng.randint(30, 120)), lang))
    for i in range(120, 140):
        k = rng.randrange(120)
        rows.append((i, edited(rng, rows[k][1], rng.choice([0, 0, 1])), rows[k][2]))
    for i in range(140, 150):
        rows.append((i, f"{text_in(rng, 'de', 20)} {passage} {text_in(rng, 'de', rng.randint(5, 40))}", "de"))
    for i in range(150, 156):
        rows.append((i, f"{text_in(rng, 'en', 40)} {items[i % 5]} {text_in(rng, 'en', 40)}", "en"))
    rows += [(156, None, "en"), (157, "", None), (158, "12345 !!", "en")]
    folder = tmp_path_factory.mktemp("corpus")
    table = [(i, t, x, f"s{i % 3}", len(t or ""), "clash") for i, t, x in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {i: t for i, t, _ in rows}, items


def test_stages_equal_brute_force(spark, corpus):
    folder, texts, items = corpus
    steps, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet")
    assert list(steps) == ["language ID", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "packing"]
    got = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, folder)
        assert docs.columns == corpus_pipeline.COLUMNS
        got[name] = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(list(got[name].values()), docs.schema)
    assert set(got["language ID"]) == set(range(156))
    assert all(r.text == texts[i] for i, r in got["language ID"].items())
    groups = grouped({i: shingles(texts[i]) for i in range(156)}, lambda both, union: 100 * both >= 85 * union)
    near = {i for i in groups if groups[i] == i}
    assert set(got["MinHash near-dedup"]) == near and len(near) < 150
    gone = brute_passages({i: texts[i] for i in near})
    left = {i: "".join(c for k, c in enumerate(texts[i]) if k not in gone[i]) for i in near}
    want = {i: t for i, t in left.items() if t.strip()}
    assert {i: r.text.split() for i, r in got["substring dedup"].items()} == {i: t.split() for i, t in want.items()}
    assert all(r.n_chars == len(r.text) for r in got["substring dedup"].values())
    assert sum(len(texts[i]) - len(left[i]) for i in near) > 9 * 300
    leaked = {i for i in want if any(items[k] in want[i] for k in items)}
    assert set(got["benchmark decontamination"]) == set(want) - leaked and leaked


def test_run_packs_what_the_stages_keep(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, folder).collect(), ", ".join(f"{c} {'string' if c in ('text', 'lang', 'source') else 'long'}" for c in corpus_pipeline.COLUMNS))
    raw = Tokenizer.from_file(PATH)
    want = {r.doc_id: len(raw.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert out.groupby("doc_id").length.sum().to_dict() == want == out.groupby("doc_id").doc_tokens.max().to_dict()


def test_stages_and_odd_rows(spark, corpus):
    """Nulls, blanks, repeated rows, one id with two texts, and empty tables in every stage."""
    folder, *_ = corpus
    rng = random.Random(32)
    one, two = prose(rng, 60), prose(rng, 60)
    rows = [(1, one, "en", "a", 1), (1, one, "en", "a", 1), (2, two, None, None, None), (2, one, "en", "b", 2), (None, one, "en", "a", 1), (None, None, "en", "a", 1), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, "x " * 40_000, "en", "a", 80_000)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kind)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), folder).count() == 0, name
    near = sorted((r.doc_id or -1, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, folder).where("text is not null").collect())
    assert near == [(-1, one), (1, one), (2, two), (4, ""), (5, "x " * 40_000)]
    kept = corpus_pipeline.benchmark_leaks(spark, docs, folder)
    assert kept.count() == len(rows)
    cut = {(r.doc_id, r.text) for r in corpus_pipeline.repeated_passages(spark, docs.where("doc_id is null or doc_id > 1"), folder).collect()}
    assert {(None, one), (None, None), (3, None), (4, "")} <= cut
    assert corpus_pipeline.packed(spark, docs, folder).select(F.sum("length")).first()[0] > 40_000
