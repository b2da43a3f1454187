"""The training-data operators against brute force, exact round trips and held-out accuracy, with the odd cases: nulls,
empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexspan.llm import chat, decontaminate, fingerprint, html_text, langid, near_dedup, packing, passages, queries, tokens, toxicity
from lexspan.llm.common import Stage, components

from ..conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


def prose(rng, n, words="alpha beta gamma delta rose tree stone river cloud night".split()):
    return " ".join(rng.choice(words) + str(rng.randint(0, 60)) for _ in range(n))


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Near copies without a centre, exact copies, chains, a very long text, nulls, blanks, repeated rows."""
    rng, rows = random.Random(4), []
    base = prose(rng, 200)
    rows += [edited(rng, base, 4) for _ in range(60)] + [base] * 30
    chain = prose(rng, 120)
    for _ in range(6):
        rows.append(chain)
        chain = edited(rng, chain, 1)
    rows += [prose(rng, n) for n in (1, 2, 3, 4, 5, 6, 40, 20_000)] + [None, "", " \n\t", "One two", "one TWO", "É x", "é x"]
    table = [(i, t, "en", "s", "clash") for i, t in enumerate(rows)] + [(0, rows[0], "en", "s", "clash"), (None, base, "en", "s", "clash"), (None, None, "en", "s", "clash")]
    return spark.createDataFrame(table, "doc_id long, text string, lang string, source string, component_id string").repartition(3)


def shingles(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def grouped(sets, linked):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            if x and y and linked(len(x & y), len(x | y)):
                p, q = find(keys[a]), find(keys[b])
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_brute_force(spark, odd_docs):
    rows = [r for r in odd_docs.collect() if r.doc_id is not None]
    sets = {r.doc_id: shingles(r.text) for r in rows}
    want = grouped(sets, lambda both, union: 100 * both >= 85 * union)
    got = near_dedup.near_duplicates(spark, odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
        else:
            assert not r.kept


def test_near_duplicates_in_a_large_group(spark, monkeypatch):
    """Over a thousand near copies of one text, many just under or over the threshold, in blocks far smaller than the
    group; and one doc_id with two texts, each in its own group."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "HOT", 8)
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    rng = random.Random(12)
    base, other = prose(rng, 150), prose(rng, 90)
    pool = [f"often{k}" for k in range(40)]  # edits that recur, so that shingles are seldom met once only

    def changed(text, n):
        words = text.split(" ")
        for _ in range(n):
            words[rng.randrange(len(words))] = rng.choice(pool)
        return " ".join(words)

    texts = [changed(base, rng.choice([0, 1, 2, 3, 4, 6, 9])) for _ in range(1100)] + [changed(other, rng.randint(0, 3)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(5000, base), (5000, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = dict(enumerate(shingles(t) for _, t in rows))
    want = grouped(sets, lambda both, union: 100 * both >= 85 * union)
    assert len(set(want.values())) > 20
    ids = {k: min(rows[j][0] for j in want if want[j] == c) for k, c in want.items()}
    expected = Counter((rows[k][0], len(sets[k]), ids[k]) for k in sets)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark, docs).collect()) == expected


def test_components_beyond_one_task(spark, monkeypatch):
    from lexspan.llm import common

    monkeypatch.setattr(common, "LOCAL", 10)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 60)]
    got = {r.node: r.component for r in components(Stage(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_near_duplicates_of_nothing(spark, odd_docs):
    assert near_dedup.near_duplicates(spark, odd_docs.limit(0)).count() == 0


def test_bayesian_bounds_miss_little():
    rule, rng = near_dedup.RULE, np.random.default_rng(1)
    same = rng.random((20_000, near_dedup.MINHASHES)) < 0.85
    left = rng.integers(0, 60_000, same.shape, dtype=np.uint16)
    right = np.where(same, left, left + 1)
    assert len(rule.plausible(left, right)) >= 19_999
    assert len(rule.plausible(left, np.where(rng.random(same.shape) < 0.4, left, left + 1))) <= 5


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 4), (7, 7)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r.node: r.component for r in components(Stage(spark, "test"), edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(41)}


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(8)
    items = {i: prose(rng, n) for i, n in enumerate((4, 5, 12, 30, 30, 59))} | {90: None, 91: "", 92: "…"}
    texts = [prose(rng, 50) + " " + items[rng.randint(1, 5)] + ". " + prose(rng, 20) for _ in range(12)]
    texts += [edited(rng, items[5], 1), edited(rng, items[5], 3), items[3].upper().replace(" ", ", "), items[2], items[0], prose(rng, 80), None, "", prose(rng, 9000) + " " + items[4]]
    # Both ends changed and words inserted inside: the best window is aligned with none of the shared shingles.
    core = items[5].split(" ")
    texts.append(" ".join([prose(rng, 40), "first", *core[1:30], "two", "more", *core[30:-1], "last", prose(rng, 40)]))
    for _ in range(40):
        own = list(core)
        for _ in range(rng.randint(1, 3)):
            i = rng.choice([0, 1, len(own) - 1, rng.randrange(len(own))])
            own[i : i + rng.randint(0, 1)] = [f"x{rng.randint(0, 999)}" for _ in range(rng.randint(0, 2))]
        texts.append(prose(rng, 30) + " " + " ".join(own) + " " + prose(rng, 30))
    texts.append(" ".join(core[30:] + core[:30]))  # halves exchanged
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items.items()], "item_id long, text string, doc_id int")
    split = lambda t: [w for w in re.split(r"[^\w]+|_+", (t or "").lower()) if w]
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    words = {i: split(t) for i, t in items.items() if split(t)}
    df = Counter(g for w in words.values() for g in set(grams(w, min(5, len(w)))))
    weight = lambda g: 1 + np.log((len(words) + 1) / (df[g] + 1))
    want = {}
    for d, t in enumerate(texts):
        w = split(t)
        for i, iw in words.items():
            k, own = min(5, len(iw)), set(grams(iw, min(5, len(iw))))
            for s in range(max(1, len(w) - len(iw) + 1)):
                mine = set(grams(w[s : s + len(iw)], k))
                if mine & own:
                    both = sum(map(weight, mine & own))
                    sim = both / (sum(map(weight, mine)) + sum(map(weight, own)) - both)
                    if sim >= 0.8:
                        want[d, i] = max(sim, want.get((d, i), 0))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(spark, docs, bench).collect()}
    assert set(got) == set(want) and len(got) >= 16
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert decontaminate.leaks(spark, docs, bench.limit(0)).count() == 0 == decontaminate.leaks(spark, docs.limit(0), bench).count()


def test_a_leak_with_changed_ends_and_insertions_is_found(spark):
    """A 79-word item whose copy has its first and last word changed and two words inserted in the middle."""
    rng = random.Random(79)
    core = prose(rng, 79).split(" ")
    bench = spark.createDataFrame([(1, " ".join(core))] + [(i, prose(rng, 30)) for i in range(2, 30)], "item_id long, text string")
    changed = ["zz", *core[1:39], "one", "two", *core[39:-1], "yy"]
    docs = spark.createDataFrame([(1, " ".join([prose(rng, 300), *changed, prose(rng, 300)])), (2, " ".join(core)), (3, prose(rng, 500))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(spark, docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1)} and got[2, 1].similarity == 1 and got[1, 1].similarity > 0.8


def test_candidates_grow_with_hits_and_not_with_items(spark, monkeypatch):
    """All items have one size; whether there are 500 or 2,000, a window meets the items that it shares shingles with."""
    rng = random.Random(80)
    words = [f"w{i}" for i in range(4000)]
    items = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(2000)]
    texts = [" ".join([prose(rng, 20), edited(rng, items[i], 1), prose(rng, 20)]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real, met = decontaminate.candidates, []

    def counted(*args):
        rows = real(*args)
        met.append(rows.select("text", "start", "size", "item").distinct().count())
        return rows

    monkeypatch.setattr(decontaminate, "candidates", counted)
    for n in (500, 2000):
        bench = spark.createDataFrame([(i, t) for i, t in enumerate(items[:n])], "item_id long, text string")
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, docs, bench).collect()} <= {(i, i) for i in range(40)}
    print("CANDIDATES", met)
    assert met[0] == met[1] <= 40 * 15


def test_decontamination_odd_cases(spark):
    """Null ids keep their null, equal texts tie on the first window, one id may stand for several texts or items."""
    rng = random.Random(3)
    one, two = prose(rng, 20), prose(rng, 25)
    bench = spark.createDataFrame([(1, one), (1, two), (2, one), (None, two), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(None, one), (None, two), (None, prose(rng, 40)), (7, f"{one} {one}"), (8, one), (8, two), (8, one), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.item_id or -1, r.start, r.size) for r in decontaminate.leaks(spark, docs, bench).collect()))
    assert [g[:2] for g in got] == [(-1, -1), (-1, 1), (-1, 2), (7, 1), (7, 2), (8, -1), (8, 1), (8, 2)]
    assert all(start == 0 for _, _, start, _ in got)


def test_chat_round_trip(spark):
    tricky = [chat.TRICKY, "\\", "\\\\", "</turn>", "<\\/turn>", "### ", "#### x", "#\\## ", "a: b", "\n", "", None, "😀</turn>\n### user: hi", "</turn", "<</turn>>"]
    turns = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(tricky)] + [(2, 0, r, "x") for r in ("sys: tem", "### a", "</turn>", None, "a:", "\\")] + [(3, 0, "user", "a"), (3, 0, "user", "a"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    made = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    for conv in (1, 2, 3, None):
        source = sorted(((t, r or "", x or "") for c, t, r, x in turns if c == conv), key=lambda s: s)
        assert [(t.role, t.text) for t in made[conv].turns] == [(r, x) for _, r, x in source]
        learned = [re.sub(r"(?s)\\(.)", r"\1", made[conv].formatted[m.start : m.start + m.length]) for m in made[conv].loss_mask]
        assert learned == [x for _, r, x in source if r == "assistant"]
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_loss_is_cut_by_the_mask(spark):
    """Many long turns; a mask moved by one code point gives another text."""
    turns = [(1, i, "assistant" if i % 3 == 0 else "user", f"é{i} </turn> " + "x😀" * 400) for i in range(500)] + [(2, 0, "user", "nothing learned")]
    made = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    want = "".join(t for _, _, r, t in turns if r == "assistant")
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(want), hashlib.sha256(want.encode()).hexdigest())
    assert (got[2].loss_chars, got[2].loss_sha256) == (0, hashlib.sha256(b"").hexdigest())
    moved = made.withColumn("loss_mask", F.transform("loss_mask", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"].alias("length"))))
    assert {r.conv_id: r.loss_sha256 for r in chat.digest(moved).collect()}[1] != got[1].loss_sha256


def test_chat_raises_on_a_broken_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "escape", lambda text: text)
    df = spark.createDataFrame([(1, 0, "user", "a </turn>\n b")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="round trip differs in conversation 1"):
        chat.format_conversations(df).collect()


def test_chat_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = {r[0]: r[1:] for r in con.sql(chat.ORACLE).fetchall()}
    got = {r.conv_id: tuple(r)[1:] for r in queries.op3_chat_formatting(spark, SF).collect()}
    assert got == want
    assert got[-7][2] == len(chat.TRICKY)


def test_repeated_passages(spark):
    rng = random.Random(2)
    passage, other = prose(rng, 60), prose(rng, 80)
    texts = [f"{prose(rng, 40)}\n{passage}\n{prose(rng, 30)}", passage, f"{edited(rng, passage, 1)}\n{other}", f"{prose(rng, 30)}\n{other.upper()}", prose(rng, 300), "short line\nshort line", None, "", f"{other}\n{other}"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, place int")
    found = passages.repeated_passages(spark, docs)
    got = {(r.doc_id, r.place): (r.component_id, r.component_place, r.kept) for r in found.collect()}
    assert got == {(0, 1): (0, 1, True), (1, 0): (0, 1, False), (2, 0): (0, 1, False), (2, 1): (2, 1, True), (3, 1): (2, 1, False), (8, 0): (2, 1, False), (8, 1): (2, 1, False)}
    for r in found.collect():
        assert texts[r.doc_id][r.start : r.start + r.length] == texts[r.doc_id].split("\n")[r.place]
    left = {r.doc_id: r.text for r in passages.without_passages(docs.drop("place"), found).collect()}
    assert left == {0: texts[0], 2: texts[2].split("\n")[1], 3: texts[3].split("\n")[0], 4: texts[4], 5: texts[5], 6: None, 7: ""}
    assert passages.repeated_passages(spark, docs.limit(0)).count() == 0


def test_repeated_passages_inside_and_across_lines(spark):
    """A passage in longer lines, wrapped over short lines, or in a script without spaces is found whole and cut once."""
    rng = random.Random(6)
    inside, wrapped, cjk = prose(rng, 60), prose(rng, 70), "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(90))
    short = inside.split(" ")[:40]
    wrap = lambda w: "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9))
    a = [f"{prose(rng, 90)} FIRST {inside} ONE {prose(rng, 90)}", f"intro one\n{wrap(wrapped.split(' '))}\nleaves", f"独{cjk}自", f"{prose(rng, 60)} X {' '.join(short)} Y"]
    b = [f"{prose(rng, 30)} SECOND {inside} TWO {prose(rng, 150)}", f"{prose(rng, 20)} OTHER {wrapped} END", f"{prose(rng, 9)}\n别{cjk}的", f"{prose(rng, 60)} Z {' '.join(short)} W"]
    texts = a + b
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = passages.repeated_passages(spark, docs)
    got = {(r.doc_id, texts[r.doc_id][r.start : r.start + r.length].replace("\n", " "), r.component_id, r.kept) for r in found.collect()}
    want = [(0, inside), (1, wrapped), (2, cjk)]
    assert got == {(i, t, i, True) for i, t in want} | {(i + 4, t, i, False) for i, t in want}
    left = {r.doc_id: r.text for r in passages.without_passages(docs, found).collect()}
    assert left == {i: t.replace(dict(want)[i - 4], "") if i in (4, 5, 6) else t for i, t in enumerate(texts)}


def brute_passages(texts):
    """Removed code points of each text, from the definition: lines of 25 words or more linked by exact Jaccard
    similarity, then all runs of 50 words in what is left; of equal ones the first stays."""
    split = lambda t: [(m.group().translate(LOWER), m.start(), m.end()) for m in re.finditer("[^\x20\x09-\x0d]+", t)]
    gone = {i: set() for i in texts}
    lines = {}
    for i, t in texts.items():
        at = 0
        for place, line in enumerate((t or "").split("\n")):
            words = [w for w, _, _ in split(line)]
            if len(words) >= 25:
                lines[i, place] = (at, len(line), {tuple(words[k : k + 5]) for k in range(len(words) - 4)})
            at += len(line) + 1
    groups = grouped({k: v[2] for k, v in lines.items()}, lambda both, union: 100 * both >= 80 * union)
    for k, top in groups.items():
        if k != top:
            gone[k[0]] |= set(range(lines[k][0], lines[k][0] + lines[k][1]))
    runs = {}
    for i, t in texts.items():
        stretch = []
        for w, a, b in [*split(t or ""), (None, None, None)]:
            if w is not None and a not in gone[i]:
                stretch.append((w, a, b))
                continue
            for k in range(len(stretch) - 49):
                some = stretch[k : k + 50]
                runs.setdefault(tuple(x[0] for x in some), []).append((i, some[0][1], some[-1][2]))
            stretch = []
    for places in runs.values():
        for i, a, b in sorted(places)[1:]:
            gone[i] |= set(range(a, b))
    return gone


LOWER = {c: c + 32 for c in range(65, 91)}


def test_repeated_passages_equal_brute_force(spark):
    """Random texts with passages inside lines, over lines, edited lines, repeats within a text and long copies."""
    rng, texts = random.Random(21), {}
    shared = [prose(rng, n) for n in (50, 51, 60, 75, 120)]
    lines = [prose(rng, n) for n in (25, 30, 60, 90)]
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            kind = rng.random()
            own = prose(rng, rng.randint(1, 40))
            if kind < 0.3:
                parts.append(f"{own} {rng.choice(shared)} {prose(rng, rng.randint(0, 30))}")
            elif kind < 0.5:
                parts.append(edited(rng, rng.choice(lines), rng.randint(0, 2)))
            elif kind < 0.6:
                words = rng.choice(shared).split(" ")
                parts.append("\n".join(" ".join(words[k : k + 11]) for k in range(0, len(words), 11)))
            else:
                parts.append(own.upper() if rng.random() < 0.3 else own)
        texts[i] = "\n".join(parts)
    texts |= {60: None, 61: "", 62: "same " * 300, 63: texts[5], 64: " \t\n "}
    docs = spark.createDataFrame([*texts.items(), (5, texts[5])], "doc_id long, text string").repartition(5)
    got = {i: set() for i in texts}
    for r in passages.repeated_passages(spark, docs).where("not kept").collect():
        got[r.doc_id] |= set(range(r.start, r.start + r.length))
    want = brute_passages(texts)
    blank = lambda i, at: {x for x in at if not texts[i][x].isspace()}
    assert {i: blank(i, x) for i, x in got.items()} == {i: blank(i, x) for i, x in want.items()}
    assert sum(map(len, want.values())) > 5000


def test_repeated_passages_odd_cases(spark):
    """Null ids come last and are only found, never cut; equal rows stay or go together; ties go to the first place."""
    rng = random.Random(22)
    line, passage = prose(rng, 40), prose(rng, 70)
    rows = [(None, line), (3, line), (3, line), (1, f"x {passage} y"), (2, f"{prose(rng, 20)} {passage} {prose(rng, 9)}"), (None, f"z {passage}"), (4, f"{line}\n{line}")]
    found = passages.repeated_passages(spark, spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, kept string"))
    got = Counter((r.doc_id, r.place, r.component_id, r.kept) for r in found.collect())
    assert got == {(None, 0, 3, False): 1, (3, 0, 3, True): 2, (4, 0, 3, False): 1, (4, 1, 3, False): 1, (1, 0, 1, True): 1, (2, 0, 1, False): 1}


def test_texts_of_one_id_are_cut_apart(spark):
    """Of the two texts of id 2 only the line that is repeated goes; the same place in the other text stays."""
    rng = random.Random(23)
    a, b, c, d = (prose(rng, n) for n in (40, 30, 35, 38))
    passage = prose(rng, 60)
    rows = [(1, a), (2, f"{a}\n{b}"), (2, f"{c}\n{d}"), (3, f"{prose(rng, 9)} {passage} x"), (4, f"y {passage} {prose(rng, 7)}"), (4, f"{prose(rng, 20)}")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, text_key int")
    found = passages.repeated_passages(spark, docs)
    left = Counter((r.doc_id, r.text) for r in passages.without_passages(docs, found).collect())
    assert left == Counter([(1, a), (2, b), (2, f"{c}\n{d}"), rows[3], (4, rows[4][1].replace(passage, "")), rows[5]])


HARD = """<html><head><title>T</title><style>p{}</style></head><body class=x><nav><ul><li><a href=/>Home</a></li></ul></nav><header><p>Site name</p></header>
<div class="cookie-notice">We use cookies. Accept them now.</div><article><h1>A &amp; B</h1><p>First <b>par</b>agraph
 here, with text.<p>Second&nbsp;one &lt;x&gt;, also long enough.<script>var a="</p>";</script><ul><li>one thing.<li>two things.</ul><div class="ad">Buy now!</div></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/>r1</a></li></ul></aside><section id="comments"><p>Nice article, I liked it. Thanks.</p></section><form><label>Mail</label><input></form><footer>&copy; 2024 Me</footer></body></html>"""


def test_html_extraction(spark):
    model = html_text.fit()
    assert model.text(HARD) == "A & B First paragraph here, with text. Second one <x>, also long enough. one thing. two things."
    assert model.text(None) == model.text("") == "" and model.text("just  text") == "just text"
    pages = spark.createDataFrame([(1, "u", HARD, "c"), (2, None, None, "c"), (None, "v", "<p>", "c"), (1, "u", HARD, "c")], "page_id long, url string, html string, text string")
    got = html_text.extract(spark, pages, model).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(spark, pages.limit(0), model).count() == 0


def test_html_held_out_pages():
    """Other pages of the generator: the text kept is the labelled text for nearly all of them."""
    model, good, n = html_text.fit(), 0, 0
    for html in html_text.labelled_pages(150, seed=99):
        nodes = html_text.ordered(html_text.Dom(html).root)
        state = np.zeros(len(nodes), bool)
        for node in nodes[1:]:
            state[node.index] = state[node.parent.index] if node.label is None else node.label == "1"
        good += html_text.main_text(nodes[0], state) == model.text(re.sub(r' data-label="[01]"', "", html))
        n += 1
    assert good / n > 0.85


def test_sum_product_equals_enumeration():
    model = html_text.fit(html_text.labelled_pages(60))
    nodes = html_text.ordered(html_text.Dom("<div><p>some text here.</p><ul><li>x<li>y</ul></div><footer>f</footer>").root)
    field = html_text.features(nodes) @ model.unary
    total, mass = np.zeros(len(nodes)), 0.0
    for bits in range(1 << len(nodes)):
        state = [(bits >> i) & 1 for i in range(len(nodes))]
        p = np.exp(sum(f * s for f, s in zip(field, state)) + sum(model.pair[html_text.kind(n)][state[n.parent.index], state[n.index]] for n in nodes[1:]))
        total += p * np.array(state)
        mass += p
    assert np.allclose(model.marginals(nodes), total / mass)


def test_packing(spark):
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (1, 30, 300, 900, 5000)] * 12 + [None, "", "É. <|endoftext|> ok"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0), (None, "x", 0)], "doc_id long, text string, start int")
    out = packing.pack(spark, docs, PATH).toPandas()
    raw = Tokenizer.from_file(PATH)
    pieces = defaultdict(list)
    for r in out.itertuples():
        pieces[None if r.doc_id != r.doc_id else int(r.doc_id)].append(r)
    for i, t in [*enumerate(texts)][1:]:
        ids, at = [*raw.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert len(pieces[0]) == 2 and len(pieces[None]) == 1
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= packing.CAPACITY
    assert out.length.sum() / (packing.CAPACITY * out.sequence_id.nunique()) > 0.9
    assert packing.pack(spark, docs.limit(0), PATH).count() == 0


def test_differencing_balances():
    rng = random.Random(3)
    sizes = [rng.randint(1, 512) for _ in range(400)]
    parts = packing.differencing(sizes, 50)
    assert sorted(i for _, p in parts for i in p) == list(range(400))
    assert all(s == sum(sizes[i] for i in p) for s, p in parts) and parts[0][0] - parts[-1][0] <= 8
    assert packing.fill([]) == [] and packing.fill([2048, 2048]) and max(sum([1500, 1500, 1000][i] for i in w) for w in packing.fill([1500, 1500, 1000])) <= 2048


def test_encoder_equals_the_tokenizer():
    texts = ["It's a TEST, don't. ÀÉ ñ,. x.,y a.b 12.5 z. <|endoftext|> Q. straße, µ. İi Σας", "'s. we'll. a\xa0b  \x1c c", "ºª x​. q", "", " ", "a.", "É,", "a' . '", "_a. b_, e—f.", "”. ”, é. ×. ÷,", "中文。text, ok."]
    for literal in (False, True):
        raw = Tokenizer.from_file(PATH)
        raw.encode_special_tokens = literal
        for _ in range(2):  # the second time from the table of known words
            got = tokens.Encoder.get(PATH, 4, literal).encode(texts)
        assert [list(np.frombuffer(x, "<u4")) for x in got] == [e.ids for e in raw.encode_batch(texts, add_special_tokens=False)]


def test_token_counts(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    texts = [prose(rng, n) for n in (0, 1, 2, 500, 1, 3000)] * 3 + [None, "<|endoftext|> a"]
    raw = Tokenizer.from_file(PATH)
    raw.encode_special_tokens = True
    want = Counter((i, len(raw.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    assert Counter((r.doc_id, r.n_tokens) for r in tokens.count_tokens(spark, docs, PATH).collect()) == want
    assert tokens.count_tokens(spark, docs.limit(0), PATH).count() == 0
    # Plain files, with documents across many small blocks and an unfinished one at the end.
    lengths = [0, 5, 0, 40, 1, 7]
    ids = [x for n in lengths[:-1] for x in [*range(1, n + 1), tokens.END_ID]] + [*range(lengths[-1])]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    monkeypatch.setattr(tokens, "BLOCK", 4)
    blocks = tokens.read_flat(spark, str(tmp_path))
    got = sorted((r.ordinal, r.n_tokens) for r in tokens.document_lengths(Stage(spark, "flat"), blocks).collect())
    assert got == list(enumerate(lengths))


def xx(*values):
    """The engine's 64-bit hash: each value seeds the next; an array hashes its members in turn."""
    seed = 42
    for v in values:
        for x in v if isinstance(v, list) else [v]:
            raw = x.encode() if isinstance(x, str) else (x & (2**64 - 1)).to_bytes(8, "little") if not isinstance(x, np.int32) else int(x).to_bytes(4, "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def syncmers(text):
    """(place, 32-bit hash) of the closed syncmers of a text, by the definition."""
    k, s = fingerprint.UNITS, fingerprint.INNER
    space = "[ \t\n\x0b\f\r]+"
    words = [w for w in re.split(space, text) if w]
    if len(text) > (fingerprint.LONG + 1) * len(words):
        words = list(re.sub(space, "", text))
    h = [xx(w) for w in words]
    if not h:
        return []
    if len(h) < k:
        return [(0, xx(h) & 0xFFFFFFFF)]
    out = []
    for i in range(len(h) - k + 1):
        inner = [xx(*h[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner[0], inner[-1]) == min(inner):
            out.append((i, xx(*h[i : i + k]) & 0xFFFFFFFF))
    return out


def test_fingerprints_equal_brute_force(spark, odd_docs):
    space = fingerprint.SPLIT
    got = fingerprint.fingerprints(spark, odd_docs).toPandas()
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, xx(r[1]) % space, r[1]), reverse=True)
    assert len(got) == len(rows)

    def printed(found):
        return "".join(f"{h:08x}{at - (found[i - 1][0] if i else 0):02x}" for i, (at, h) in enumerate(found))

    def parts(found):
        return {h for _, h in found} | {xx(x[1], y[1], np.int32(y[0] - x[0])) for x, y in zip(found, found[1:])}

    def like(a, b):
        a, b = parts(a), parts(b)
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    want = Counter()
    for k, (i, t) in enumerate(rows):
        m, after = len(t) // 3, rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - m] + after[:m]
        own, changed = syncmers(t), syncmers(edited)
        assert all(y[0] - x[0] <= fingerprint.UNITS - fingerprint.INNER for x, y in zip(own, own[1:]))
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), printed(own), printed(changed), round(like(own, changed), 9), round(like(own, syncmers(after)), 9)] += 1
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got.itertuples()) == want
    assert fingerprint.fingerprints(spark, odd_docs.limit(0)).count() == 0


def test_fingerprints_odd_cases(spark):
    """A single document follows itself; a hot id, null included, is dealt over ranges; scripts without spaces."""
    rng = random.Random(9)
    one = prose(rng, 50)
    r = fingerprint.fingerprints(spark, spark.createDataFrame([(1, one)], "doc_id long, text string")).first()
    assert (r.near_next, r.edited_sha256) == (1.0, hashlib.sha256((one[: len(one) - len(one) // 3] + one[: len(one) // 3]).encode()).hexdigest())
    rows = [(None if i % 3 else i, prose(rng, 20)) for i in range(300)] + [(7, prose(rng, 20)) for _ in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xx(r[1]) % fingerprint.SPLIT, r[1]), reverse=True)
    want = Counter((i, hashlib.sha256((t[: len(t) - len(t) // 3] + order[(k + 1) % len(order)][1][: len(t) // 3]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert Counter((r.doc_id, r.edited_sha256) for r in fingerprint.fingerprints(spark, df).collect()) == want
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(200))
    two = spark.createDataFrame([(1, han), (2, han[:150] + "好" + han[150:])], "doc_id long, text string")
    assert all(0.6 < r.near_next < 1 for r in fingerprint.fingerprints(spark, two).collect())


def test_likeness_follows_positions(spark):
    """Long texts that share a passage share its anchors; the same words in another order are less alike."""
    rng = random.Random(11)
    a, b, shared = prose(rng, 6000), prose(rng, 6000), prose(rng, 3000)
    parts_of = lambda c: fingerprint.parts(fingerprint.text_anchors(F.col(c)))
    words = shared.split(" ")
    mixed = " ".join(w for i in rng.sample(range(0, 3000, 60), 50) for w in words[i : i + 60])
    df = spark.createDataFrame([(f"{a} {shared}", f"{shared} {b}", shared, mixed)], "x string, y string, s string, m string")
    r = df.select(fingerprint.likeness(parts_of("x"), parts_of("y")).alias("passage"), fingerprint.likeness(parts_of("s"), parts_of("m")).alias("mixed"), fingerprint.likeness(parts_of("s"), parts_of("s")).alias("same")).first()
    assert 0.18 < r.passage < 0.22 and 0.4 < r.mixed < 0.9 and r.same == 1


def test_syncmers_are_context_free(spark):
    rng = random.Random(6)
    a, b = prose(rng, 400), prose(rng, 30)
    got = spark.createDataFrame([(a,), (b + " " + a,)], "t string").select("t", F.explode(fingerprint.text_anchors(F.col("t"))).alias("x")).collect()
    one, two = ({r.x.h for r in got if r.t == t} for t in (a, b + " " + a))
    assert one <= two


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98


def test_language_odd_cases(spark):
    train = [(i, t, x, "s") for i, (t, x) in enumerate([("the cat and the dog and the house of the king", "en"), ("der Hund und die Katze und das Haus", "de"), ("кошка и собака и дом короля", "ru")] * 8)]
    odd = [(100, None, None, "s"), (101, "123 !!", "en", "s"), (102, "", "en", "s"), (103, "дом и кошка", None, "s"), (104, "the cat " * 30_000, None, "s"), (None, "und das Haus", "de", "s")]
    docs = spark.createDataFrame(train + odd, "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in langid.identify(spark, docs).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 103, 104, None)] == ["und", "und", "und", "ru", "en", "de"]
    assert langid.identify(spark, docs.limit(0)).count() == 0
    model = langid.fit(docs)
    assert [x for *_, x in model.spans("the cat and the dog and the house кошка и собака и дом der Hund und die Katze")] == ["en", "ru", "de"]


def test_repeated_rows_and_missing_ids(spark):
    """Language, toxicity and token counts give a row for each row, whatever its id."""
    rng = random.Random(41)
    train = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog and the house", "en"), ("der Hund und die Katze und das Haus", "de")] * 20)]
    odd = [(500, "the dog", "en"), (500, "the dog", "en"), (500, "der Hund", None), (None, "the cat", None), (None, "the cat", None), (None, None, None)]
    docs = spark.createDataFrame(train + odd, "doc_id long, text string, lang string")
    got = Counter((r.doc_id, r.lang_pred, r.held_out) for r in langid.identify(spark, docs).collect() if r.doc_id is None or r.doc_id >= 500)
    held = zlib.crc32(b"500") % 4 == 2
    assert got == {(500, "en", held): 2, (500, "de", held): 1, (None, "en", False): 2, (None, "und", False): 1}
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    scored = Counter((r.doc_id, r.held_out) for r in toxicity.rate(spark, docs, labels).collect())
    assert scored[500, held] == 3 and scored[None, False] == 3 and sum(scored.values()) == 46
    raw = Tokenizer.from_file(PATH)
    count = lambda t: len(raw.encode(t or "", add_special_tokens=False).ids)
    texts = [(None, prose(rng, 30)), (None, None), (7, "ä b"), (7, "ä b"), (8, prose(rng, 3))]
    made = tokens.count_tokens(spark, spark.createDataFrame(texts, "doc_id long, text string"), PATH).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in made) == Counter((i, count(t)) for i, t in texts)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    emit, first = rng.normal(size=(9, 3)) * 3, np.array([0, 4, 4, 9])
    got = langid.viterbi(emit, first, 2.0)
    for a, b in ((0, 4), (4, 9)):
        score = lambda p: sum(emit[a + i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
        best = max((score(p) for p in np.ndindex(*[3] * (b - a))))
        assert score(got[a:b]) == pytest.approx(best)


def test_toxicity(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = prose(rng, 60).split()
        if bad:
            words[rng.randrange(60)] = rng.choice(["grobian", "lümmel", "idiotic"])
        rows.append((i, " ".join(words), 1.0))
        labels.append((i, int(bad), 0))
    rows += [(1000, None, 1.0), (1001, "", 1.0), (1002, "what a grobian", 1.0), (1003, "alpha1 " * 20_000, 1.0), (None, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    tags = spark.createDataFrame(labels + [(0, 0, 0), (5, None, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.rate(spark, docs, tags).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    held = got[got.held_out & got.doc_id.lt(400)]
    assert (held.predicted == (held.doc_id % 4 == 0)).mean() > 0.9
    assert toxicity.rate(spark, docs, tags.limit(0)).agg(F.max("score")).first()[0] == 0
    assert toxicity.rate(spark, docs.limit(0), tags).count() == 0


def auc(score, label):
    """Share of pairs of a toxic and a clean text in the right order, ties by half."""
    a, b = np.asarray(score)[label == 1], np.sort(np.asarray(score)[label == 0])
    return float((np.searchsorted(b, a, "left") + np.searchsorted(b, a, "right")).mean() / 2 / len(b))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_of_held_out_documents(spark, sf):
    """On whole tables, trained on some hundred and some thousand labels: the network beats a table of word and gram odds."""
    path = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic")
    texts = spark.read.parquet(f"{path}/documents.parquet").where("text is not null").select("doc_id", "text").join(labels, "doc_id").toPandas()
    got = queries.op9_toxicity(spark, path).toPandas().set_index("doc_id")
    assert len(got) == spark.read.parquet(f"{path}/documents.parquet").count()
    texts["held"] = [zlib.crc32(str(i).encode()) % 4 == 2 for i in texts.doc_id]
    train, held = texts[~texts.held], texts[texts.held]
    label = held.toxic.to_numpy()
    score = got.score.loc[held.doc_id].to_numpy()
    # The plainer way: the largest sum of shrunken log odds of a word and its six-grams.
    t, e = toxicity.Texts(list(train.text)), toxicity.Texts(list(held.text))
    table = {}
    for what in ("word", "six"):
        counts = np.zeros((2, 1 << toxicity.BITS[what]))
        for ids, y in zip(t.spans(what), train.toxic):
            counts[int(y), np.unique(ids)] += 1
        table[what] = np.log((counts[1] + 5) / (counts.sum(axis=0) * train.toxic.mean() + 5))
    odds = table["word"][e.word] + np.maximum.reduceat(table["six"][e.six], e.at)
    plain = [odds[a:b].max(initial=-9) for a, b in zip(e.first[:-1], e.first[1:])]
    hit = score >= toxicity.THRESHOLD
    print("TOXICITY", sf, len(train), "auc", auc(score, label), "odds", auc(plain, label), "precision", label[hit].mean(), "recall", hit[label == 1].mean())
    assert auc(score, label) > max(0.9, auc(plain, label) + 0.02)
    assert label[hit].mean() > 0.8 and hit[label == 1].mean() > 0.5


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, windows = rng.normal(size=(40, toxicity.INPUT)), np.array([[0, 20], [8, 40]])
    y, w = np.array([1.0, 0.0]), np.array([1.0, 1.0])
    grad = net.gradients(x, windows, y, w)

    def loss():
        z = net.forward(x, windows)
        return float((np.log1p(np.exp(z)) - y * z).mean())

    for name in ("Uf", "Wb", "a", "o", "bf"):
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        keep, step = net.p[name][at], 1e-2
        net.p[name][at] = keep + step
        high = loss()
        net.p[name][at] = keep - step
        low = loss()
        net.p[name][at] = keep
        assert grad[name][at] == pytest.approx((high - low) / (2 * step), rel=0.1, abs=2e-4)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage, before = Stage(spark, "pipeline-test"), docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage.put(step(spark, docs.withColumn("kept", F.lit(0)), SF))
        assert docs.columns == corpus_pipeline.COLUMNS and 0 < docs.count() <= before, name
        before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
    assert near_dedup.near_duplicates(spark, docs).where("not kept").count() == 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert out.doc_id.nunique() == before and isinstance(out, pd.DataFrame)


def test_settings_are_compared_without_the_held_out_fold(spark, monkeypatch):
    """The comparison trains on two folds, scores a third, and never reads the held-out one."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen, real = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, y, *a: seen.append((set(texts), a)) or real(texts, y, *a))
    got = toxicity.compare(docs, labels, [(1, 0.05), (2, 0.02)])
    assert list(got) == [(1, 0.05), (2, 0.02)] == [a for _, a in seen] and all(0 <= x <= 1 for x in got.values())
    rows = docs.join(labels, "doc_id").where("text is not null").select("doc_id", "text").collect()
    fold = lambda k: {r.text for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == k}
    for texts, _ in seen:
        assert texts <= fold(1) | fold(3) and not texts & (fold(2) - fold(1) - fold(3))
