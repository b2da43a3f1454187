"""Queries over whole tables: the SQL has none of the filters that both sides had once."""

import pytest

from lexspan.plans import registry

#: query: the filters that its SQL had, and what stands there now.
WHOLE = {
    "vec_chunks": [("doc_id % 20 = 0", "true")],
    "vec_dedupe": [("doc_id % 20 = 0", "true")],
    "vec_cache_split": [("doc_id % 20 = 0", "true")],
    "vec_construction": [("doc_id % 20 = 0", "true")],
    "vec_limits": [("doc_id % 20 = 0", "true")],
    "tree_owner": [("doc_id % 4 = 0", "true")],
    "tree_own_tokens": [("doc_id % 4 = 0", "true")],
    "tree_descendants": [("doc_id % 4 = 0", "true")],
    "tree_children": [("doc_id % 4 = 0", "true")],
    "tree_validate": [("doc_id % 4 = 0", "true")],
    "occ_fragments": [("doc_id % 4 = 0", "true")],
    "txt_periods": [("left(text, 600)", "text")],
    "txt_structure": [("left(text, 600)", "text")],
    "bm25_index": [("df >= 3", "true")],
    "bm25_topk": [("item_id < 20", "true")],
    "block_ranks": [("item_id < 20", "true"), ("vec_id < 20", "vec_id % 20 = 0")],
    "rrf_fusion": [("item_id < 20", "true"), ("vec_id < 20", "vec_id % 20 = 0")],
    "hybrid_final": [("item_id < 20", "true"), ("vec_id < 20", "vec_id % 20 = 0")],
    "dense_topk": [("vec_id < 20", "vec_id % 20 = 0")],
    "block_rebuild": [("doc_id % 10 = 0 AND length(text) <= 20000", "true")],
    "passages": [("doc_id % 5 = 0", "true")],
    "citation_check": [("doc_id % 10 = 1", "text IS NOT NULL"), ("d.doc_id % 40", "d.doc_id % (SELECT max(item_id) + 1 FROM benchmark)")],
    "eval_reference_checks": [("doc_id % 10 = 4", "true")],
    "prep_map_intervals": [(" WHERE length(work) <= 20000", "")],
}


@pytest.mark.parametrize("name", list(WHOLE))
def test_sql_reads_the_whole_table(name):
    """test_queries compares the results; here it is only seen that no filter has come back."""
    for old, _ in WHOLE[name]:
        assert old not in registry.ORACLES[name]


def test_map_intervals_of_a_long_text(spark, tmp_path):
    """A text of more than 20,000 characters is mapped: an interval's ends move by the line feeds before them."""
    text = "some words\n" * 2500
    spark.createDataFrame([(1, text), (2, "a\nb")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in registry.QUERIES["prep_map_intervals"](spark, str(tmp_path)).select("doc_id", "work_start", "work_end", "original_start", "original_end").collect()}
    ends = [(i, t, s, min(s + 41, len(t))) for i, t in ((1, text), (2, "a\nb")) for s in range(0, len(t), 97)]
    assert got == {(i, s, e, s + t[:s].count("\n"), e + t[:e].count("\n")) for i, t, s, e in ends}
