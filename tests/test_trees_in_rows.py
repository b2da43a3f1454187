"""Trees, clauses and places found in a period's or a chunk's row, against what was found token by token."""

import random

from pyspark.sql import functions as F

from lexspan.functions.text import TOGETHER, running
from lexspan.operators import segment, tree
from lexspan.plans import fixture, tree_queries

from .conftest import SF


def _same(df):
    return sorted(map(str, df.collect()))


def _trees(spark):
    """Random trees, some periods without a nucleus, some heads outside the period, periods that begin at any token."""
    rng, rows = random.Random(5), []
    for doc in range(40):
        low = 0
        for period in range(rng.randint(1, 4)):
            n = rng.choice([1, 2, 3, 9, 70])
            for i in range(n):
                head = low if i == 0 else low + rng.randrange(i) if rng.random() < 0.95 else low + n + 3
                rows.append((doc, period, low + i, "w", "w", rng.choice(["VERB", "NOUN", "AUX", "ADJ"] if doc % 5 else ["NOUN"]), "ROOT" if i == 0 else rng.choice(["obj", "cop", "aux"] if doc % 5 else ["obj"]), head, None))
            low += n
    return spark.createDataFrame(rows, fixture.COLUMNS), rows


def test_clauses_in_rows(spark):
    rows, _ = _trees(spark)
    owned, forests = tree.owned(rows), tree.forests(rows)
    assert _same(tree.own_tokens_in(forests)) == _same(tree.own_tokens(owned))
    want = tree.fragments(owned.where("owner is not null").select("doc_id", "owner", "ord"))
    assert _same(tree.fragments_in(forests)) == _same(want.select("doc_id", "owner", "first", "last"))
    assert _same(tree.violations(forests)) == _same(tree.violations(rows))


def test_paths_by_doubling(spark):
    rows, made = _trees(spark)
    up = {(d, o): (p, h) for d, p, o, *_, h, _ in made}
    want = []
    for d, o in up:
        at, k = o, 0
        while True:
            want.append((d, up[d, o][0], o, at, k))
            h = up[d, at][1]
            if h == at or up.get((d, h), (None,))[0] != up[d, o][0]:
                break
            at, k = h, k + 1
    got = tree.ancestry(tree.forests(rows)).select("doc_id", "period", "ord", "ancestor", "distance")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_running_sums(spark):
    sizes = [[(7 * i) % 5 for i in range(n)] for n in (0, 1, TOGETHER - 1, TOGETHER, TOGETHER + 1, 5 * TOGETHER + 3)]
    df = spark.createDataFrame([(s,) for s in sizes], "s array<int>").select("s", running(F.col("s")).alias("r"))
    for s, r in df.collect():
        assert r == [sum(s[: i + 1]) for i in range(len(s))]


def test_tokens_are_not_sorted(spark):
    """The windows of a segmentation sort chunks, not tokens, and trees are made from rows of periods."""
    docs = spark.createDataFrame([(1, "a b. c")], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode")
    assert "Window" not in plan(segment.tagged_in(docs))[0]
    assert tree_queries.tree_validate(spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
