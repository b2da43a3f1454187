"""Exact sums, running sums over ranges, original coordinates, and corpora read in ranges, against brute force."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.operators import scan, spans, vectors
from lexspan.sources import corpus

# Exact sums ------------------------------------------------------------------------------------------------------------


def float32(x):
    return struct.unpack("<f", struct.pack("<f", x))[0]


def blocks():
    """Vectors whose sums depend on the order when they are added as doubles: huge, tiny and cancelling numbers."""
    rng = random.Random(4)
    rows = []
    for group in range(4):
        for _ in range(300):
            v = [float32(rng.uniform(-1, 1) * 10.0 ** rng.randint(-30, 6)) for _ in range(5)]
            rows += [(group, rng.randint(1, 5000), v), (group, 7, [float32(1e8), float32(-1e8), 1.0, 0.0, float32(2.0**-149)])]
    return rows + [(9, 0, [1.0] * 5), (9, 3, [0.6, 0.8, 0.0, 0.0, -0.0])]


def test_weighted_means_have_the_same_bits_however_dealt(spark):
    rows = blocks()
    want = {}
    for group in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == group and r[1] > 0]
        total = sum(r[1] for r in mine)
        means = [math.fsum(float(r[1]) * float32(r[2][i]) for r in mine) / total for i in range(5)]
        length = math.sqrt(math.fsum(m * m for m in means))
        want[group] = [m / length for m in means]
    random.Random(1).shuffle(rows)
    for parts in (1, 3, 17):
        df = spark.createDataFrame(rows, "grp int, weight int, vector array<float>").repartition(parts)
        assert {r.grp: r.vector for r in vectors.weighted_mean(df, "grp").collect()} == want
        random.Random(parts).shuffle(rows)


def test_exact_sums_are_rounded_once(spark):
    rng = random.Random(6)
    values = [float32(rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(-149, 60)) for _ in range(4000)] + [2.0**-149, -(2.0**-149), 0.0]
    df = spark.createDataFrame([(i % 9, x) for i, x in enumerate(values)], "k int, x double").repartition(7)
    got = {r.k: vectors.rounded(r.limbs) for r in vectors.exact_sums(df, F.col("x"), "k").collect()}
    assert got == {k: math.fsum(values[k::9]) for k in range(9)}
    assert vectors.exact_sums(df.limit(0), F.col("x"), "k").count() == 0
    with pytest.raises(Exception, match="too small"):
        vectors.exact_sums(spark.createDataFrame([(1, 2.0**-200)], "k int, x double"), F.col("x"), "k").collect()


def test_a_mean_without_length_is_an_error(spark):
    rows = spark.createDataFrame([(1, 2, [1.0, 0.0]), (1, 2, [-1.0, 0.0])], "g int, weight int, vector array<float>")
    with pytest.raises(Exception, match="no length"):
        vectors.weighted_mean(rows, "g").collect()


# Running sums ----------------------------------------------------------------------------------------------------------


def test_running_sums_over_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 50)) for i in range(3000)]
    total, want = 0, {}
    for i, n in sorted(rows, reverse=True):
        total += n
        want[i] = total
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, n int").repartition(5)
    for ranges in (1, 4, 13):
        out = scan.running(df, [F.desc("i")], {"upto": "n"}, ranges=ranges)
        assert {r.i: r.upto for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert scan.running(df.limit(0), [F.col("i")], {"upto": "n"}).count() == 0


def test_one_budget_for_a_whole_store(spark):
    rng = random.Random(3)
    rows = [(i, str(rng.randint(0, 30)), rng.randint(1, 90)) for i in range(2000)]
    df = spark.createDataFrame(rows, "seq int, logical_id string, size int").repartition(6)
    for most_rows, most_bytes in ((50, 10**9), (10**6, 3000), (0, 100), (10**6, 10**9)):
        used, want = 0, {}
        for k, (seq, name, size) in enumerate(sorted(rows, reverse=True)):
            used += size
            if used > most_bytes or k >= most_rows:
                break
            want.setdefault(name, (seq, size))
        out = vectors.cached(df, most_rows, most_bytes)
        assert {r.logical_id: (r.seq, r["size"]) for r in out.collect()} == want
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


# Original coordinates --------------------------------------------------------------------------------------------------


def map_by_hand(original, a, b):
    """Spans by their definition: the pieces that an interval touches, changes whole."""
    pieces, i, w = [], 0, 0
    while i < len(original):
        n = 2 if original[i : i + 2] == "\r\n" else 1
        pieces.append((w, i, n))
        i, w = i + n, w + 1
    pieces.append((w, i, 0))
    if a == b:
        return pieces[a][1], pieces[a][1]
    return pieces[a][1], pieces[b - 1][1] + pieces[b - 1][2]


def test_spans_in_the_original_text(spark):
    rng = random.Random(5)
    texts = ["Eu não queria sair.\r\nMas fiquei.", "", "\r\n\r\n", "\n\r\n\r", "plain", *("".join(rng.choice(["a", "é", "\U0001f642", "\r\n", "\n", "\r"]) for _ in range(rng.randint(1, 25))) for _ in range(40))]
    prepared = spans.prepare(spark.createDataFrame(list(enumerate(texts)), "doc_id long, original string"))
    rows, want = [], {}
    for i, t in enumerate(texts):
        n = len(t.replace("\r\n", "\n"))
        for a in range(n + 1):
            for b in range(a, n + 1):
                rows.append((i, a, b, min(a, 1), b))
                want[i, a, b] = (*map_by_hand(t, a, b), *map_by_hand(t, min(a, 1), b))
    table = spark.createDataFrame(rows, "doc_id long, a long, b long, c long, d long")
    got = spans.original_spans(spans.span_map(prepared), table, {"x": ("a", "b"), "y": ("c", "d")}).collect()
    assert len(got) == len(want) and {(r.doc_id, r.a, r.b): (r.x_start, r.x_end, r.y_start, r.y_end) for r in got} == want
    assert [want[0, a, b][:2] for a, b in ((20, 31), (18, 21), (19, 20), (19, 19), (20, 20))] == [(21, 32), (18, 22), (19, 21), (19, 19), (21, 21)]


# Corpora ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Far more lines and vectors than one range holds."""
    where, rng = tmp_path_factory.mktemp("corpus"), np.random.default_rng(1)
    n, dims = 4000, 6
    lines = [json.dumps({"frag": f"f{i}", "block": f"b{i // 3}", "text": "wörd " * (i % 60), "frag_no": i}, ensure_ascii=False) for i in range(n)]
    (where / "f.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    m = rng.normal(size=(n, dims)).astype("float32")
    np.save(where / "v.npy", m)
    (where / "manifest.json").write_text(json.dumps({"fragments": n, "blocks": -(-n // 3), "dims": dims, "references": "f.jsonl", "vectors": "v.npy"}))
    return str(where), lines, m


@pytest.mark.parametrize("most", ["512k", "16m", "8k"])
def test_a_corpus_is_the_same_in_any_ranges(spark, folder, most):
    where, lines, m = folder
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        numbered = corpus.numbered_lines(spark, f"{where}/f.jsonl")
        assert {r.row: r.line for r in numbered.collect()} == dict(enumerate(lines))
        _, fragments, vecs = corpus.corpus(spark, where, range_bytes={"512k": 1000, "16m": 1 << 30, "8k": 24}[most])
        rows = {r.frag_no: (r.row, r.v) for r in fragments.join(vecs, "row").collect()}
        assert all(rows[i][0] == i and np.array_equal(np.float32(rows[i][1]), m[i]) for i in range(len(m)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert (vecs.rdd.getNumPartitions() > 1) == (most != "16m")


def test_lines_of_several_files_follow_their_names(spark, tmp_path):
    want = []
    for k in range(5):
        some = [f"{k}-{i}" for i in range(k * 7)]
        (tmp_path / f"part-{k}.txt").write_text("".join(x + "\n" for x in some))
        want += some
    (tmp_path / "part-9.txt").write_text("no line end")
    assert [r.line for r in corpus.numbered_lines(spark, str(tmp_path)).orderBy("row").collect()] == [*want, "no line end"]


def test_damaged_matrices_are_refused(spark, tmp_path, folder):
    m = folder[2][:10]
    for name, data, said in (("cut", None, "cut short"), ("column", np.asfortranarray(m), "not rows"), ("flat", m[0], "not rows"), ("wide", m.astype("float64"), "float64")):
        np.save(tmp_path / f"{name}.npy", m if data is None else data)
        if data is None:
            raw = (tmp_path / f"{name}.npy").read_bytes()
            (tmp_path / f"{name}.npy").write_bytes(raw[:-3])
        with pytest.raises(Exception, match=said):
            corpus.matrix(spark, str(tmp_path / f"{name}.npy")).collect()


# Limits, caches, look-ups ----------------------------------------------------------------------------------------------


def test_a_run_over_its_limits_is_refused_before_a_model_is_asked(spark, monkeypatch):
    blocks_ = spark.createDataFrame([(1, k, "focus", 0, 5, "words") for k in range(4)], "doc_id long, ord int, kind string, block int, tokens long, block_text string")
    assert vectors.within_limits(blocks_) is blocks_ and vectors.within_limits(blocks_.limit(0)).count() == 0
    for name, limit in (("blocks", 3), ("tokens", 19), ("chars", 19), ("representations", 3), ("vector_bytes", 4 * 64 * 4 - 1)):
        with monkeypatch.context() as m:
            m.setitem(vectors.MOST, name, limit)
            with pytest.raises(ValueError, match=name):
                vectors.within_limits(blocks_)


def test_a_cached_artifact_counts_only_with_its_input(spark):
    inputs = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "artifact string, input string")
    cache = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "other")], "artifact string, input string")
    assert {r.artifact: r.origin for r in vectors.cache_split(inputs, cache).collect()} == {"a": "reused", "b": "generated", "c": "generated"}
    assert {r.artifact: r.origin for r in vectors.cache_split(inputs, cache.select("artifact")).collect()} == {"a": "reused", "b": "reused", "c": "generated"}


def test_a_unit_is_asked_for_in_exactly_one_way(spark):
    from lexspan.operators import context

    units = spark.createDataFrame([(1, 0, "p"), (1, 1, "q"), (2, 0, "r")], "doc_id long, period int, logical_id string")
    assert [tuple(r) for r in context.unit(units, logical_id="q").collect()] == [(1, 1, "q")] == [tuple(r) for r in context.unit(units, 1, 1).collect()]
    assert context.unit(units, logical_id="none").count() == 0
    for bad in ({}, {"doc_id": 1}, {"period": 0}, {"doc_id": 1, "period": 0, "logical_id": "p"}, {"doc_id": 1, "logical_id": "p"}):
        with pytest.raises(ValueError):
            context.unit(units, **bad)


def test_fragments_hold_their_inner_separators(spark):
    from lexspan.operators import segment, tree

    text = "Um  dia, dois\n\ndias."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    tokens = segment.tokens(segment.pieces(docs))
    own = spark.createDataFrame([(1, 0, o) for o in (0, 1, 3, 4)] + [(1, 9, 2), (1, 9, 5)], "doc_id long, owner int, ord int")
    rows = tree.fragment_texts(tree.fragments(own), tokens, docs).collect()
    assert sorted((r.owner, r["first"], r["last"], r.literal) for r in rows) == [(0, 0, 1, "Um  dia"), (0, 3, 4, "dois\n\ndias"), (9, 2, 2, ","), (9, 5, 5, ".")]
