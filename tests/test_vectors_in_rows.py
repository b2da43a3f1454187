"""Targets, blocks and constructions without a row for each token or a copy of a text for each block."""

import time

from lexspan.operators import context, segment, vectors

DOCS = [(1, "Um dois. Três!\n\nQuatro 😀 cinco (seis.) sete"), (2, "  "), (3, "\n\n\n\nA. B\n\n\n\n\nC"), (4, "x" * 64 + "é😀" * 70), (5, ""), (6, None)]


def _same(df):
    return sorted(map(str, df.collect()))


def test_paragraphs_and_targets_from_periods(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    periods = segment.periods_in(docs)
    want, got = segment.paragraphs(segment.tagged_in(docs)), segment.paragraphs_in(periods)
    assert _same(got) == _same(want.select(got.columns))
    units = context.windows(periods)
    assert _same(vectors.targets_in(units, docs)) == _same(vectors.targets(units, want, docs))
    made = vectors.targets_in(units, docs)
    assert _same(vectors.construction_of(vectors.cuts(made, docs, 11))) == _same(vectors.construction(vectors.chunks(made, docs, 11), made))
    for r in vectors.chunks(made.where("kind = 'document'"), docs, 11).collect():
        assert r.block_text == DOCS[r.doc_id - 1][1][r.start_pos : r.end_pos] and r.start_pos == 8 * r.block


def test_blocks_of_a_long_text_take_linear_time(spark):
    """A text of two million characters: cut by place, each of its 31,250 blocks walked the text and carried it along."""
    docs = spark.createDataFrame([(1, "ab é" * 500_000)], "doc_id long, text string")
    whole = spark.createDataFrame([(1, 0, "document", 0, 2_000_000)], "doc_id long, ord int, kind string, start_pos long, end_pos long")
    began = time.time()
    assert vectors.chunks(whole, docs, 67).selectExpr("sum(length(block_text))", "count(*)").first()[:] == (2_000_000, 31_250)
    assert time.time() - began < 20
