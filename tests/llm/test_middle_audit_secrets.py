"""Operators 11 to 13 against brute force and their SQL, with the odd cases: nulls, empty and very long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations
from pathlib import Path

import duckdb
import pytest

from lexspan.llm import fill_middle, filter_audit, queries, secret_scan

from ..conftest import SF
from ..test_queries import canonical

NEW = ("op11_fill_in_middle", "op12_filter_interaction_audit", "op13_secret_scans")


@pytest.mark.parametrize("name", NEW)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    want, df = con.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), want.columns)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(rng, n):
    return " ".join(rng.choice("Alpha beta Gamma delta río été 木".split()) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (1, 2, 3, 99, 100, 101, 300)] + [prose(rng, 30_000), None, "", " ", "\t\r\n \x0b\x0c", " lead", "trail  ", "a<P>b", "a<S", "<M>", "one\x1ctwo three", "same words " * 70, "# tag", "UPPER CASE"]
    texts += [texts[4]] * 5 + [prose(rng, rng.randint(1, 40)) for _ in range(60)]
    rows = [(i, t, ["en", "de", None, ""][i % 4], "s", 7) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 7), (3, texts[3], "en", "s", 7), (None, texts[4], "en", "s", 7), (None, None, None, "s", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, form string, part int").repartition(5)


# Operator 11 ----------------------------------------------------------------------------------------------------------


def cut_up(text):
    """Units by hand: white space is held until a word follows it."""
    units, space, word = [], "", ""
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            if word:
                units.append(space + word)
                space = word = ""
            space += c
        else:
            word += c
    return units + ([space + word] if space + word else [])


def middle_by_hand(doc_id, text):
    text = text or ""
    units = cut_up(text)
    n = len(units)
    digest = sha("42:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_by_hand(spark, odd):
    source = Counter((r.doc_id, r.text or "") for r in odd.collect())
    want = Counter()
    for (i, t), k in source.items():
        want[(i, *middle_by_hand(i, t))] += k
    rows = fill_middle.fill_in_middle(spark, odd).collect()
    assert Counter(tuple(r) for r in rows) == want
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    digests = Counter(tuple(r) for r in fill_middle.digests(spark, odd).collect())
    assert digests == Counter({(i, *made[:4], sha(made[4]), sha(t)): k for (i, t), k in source.items() for made in [middle_by_hand(i, t)]})


def test_fill_in_middle_restores_any_text():
    rng = random.Random(2)
    for k in range(3000):
        text = "".join(rng.choice("a <PSM>\n ") for _ in range(rng.randint(0, 30)))
        n, form, _, _, output = fill_middle.rearrange(str(k), text, rate=100)
        assert fill_middle.restore(output, form) == text and n == len(cut_up(text))
        assert (form == "plain") == (text == "" or any(m in text for m in fill_middle.MARKS))
    with pytest.raises(ValueError):
        fill_middle.restore("no marks", "psm")


def test_fill_in_middle_of_large_ids_and_none(spark):
    big = 2**60 + 1  # not a double
    rows = spark.createDataFrame([(big, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert {r.doc_id for r in fill_middle.digests(spark, rows).collect()} == {big, None}
    want = middle_by_hand(big, "a b c")
    assert tuple(fill_middle.fill_in_middle(spark, rows).where("doc_id is not null").first())[1:] == want
    assert fill_middle.digests(spark, rows.limit(0)).count() == 0


# Operator 12 ----------------------------------------------------------------------------------------------------------


def audit_by_hand(docs, labels):
    least = {}
    for r in docs:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    said = {}
    for i, quality, toxic in labels:
        good, bad = said.get(i, (False, False))
        said[i] = good or quality == 1, bad or toxic == 1
    rows = []
    for r in docs:
        text = r.text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": any(c in "#$%&*|" for c in text), "E": r.doc_id is not None and r.doc_id > least[text]}
        rows.append((r.lang or "", {f for f in fails if fails[f]}, *said.get(r.doc_id, (False, False))))
    out = []
    for part in {r[0] for r in rows}:
        mine, sums, lines = [r for r in rows if r[0] == part], Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                earlier = sum(f in r[1] for r in mine) - len(gone)
                left = [r for r in left if f not in r[1]]
                sums[f] += len(gone)
                lines.append((part, order, step, len(left), len(gone), earlier, sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(*line, sums[line[1][line[2] - 1]]) for line in lines]
    return out


def test_audit_by_hand(spark, odd):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60)] + [(4, 0, 1), (4, None, None), (5, None, 0), (None, 1, 1), (9999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumnRenamed("x", "y")
    got = filter_audit.audit_documents(spark, odd, table).collect()
    known = [x for x in labels if x[0] is not None]
    want = audit_by_hand(odd.collect(), known)
    assert len(want) == 3 * 600
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_audit_of_no_rows_and_of_other_filters(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(spark, odd.limit(0), labels).count() == 0
    rows = spark.createDataFrame([("p", True, False, True, False), ("p", True, True, False, True), ("q", False, False, True, True)], "part string, X boolean, Y boolean, good boolean, toxic boolean")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit(spark, rows, "XY").collect()}
    assert got == {
        ("p", "XY", 1): (0, 2, 0, 1, 1, 1, 3), ("p", "XY", 2): (0, 0, 1, 0, 0, 0, 1), ("p", "YX", 1): (1, 1, 0, 0, 0, 1, 1), ("p", "YX", 2): (0, 1, 1, 1, 1, 0, 3),
        ("q", "XY", 1): (1, 0, 0, 0, 0, 0, 0), ("q", "XY", 2): (1, 0, 0, 0, 0, 0, 0), ("q", "YX", 1): (1, 0, 0, 0, 0, 0, 0), ("q", "YX", 2): (1, 0, 0, 0, 0, 0, 0),
    }


def test_audit_counts_each_state_once(spark, odd, tmp_path):
    """32 states, 80 edges, no order counted twice; a state's survivors hold what none of its filters removes."""
    from lexspan.llm.common import Stage

    stage = Stage(spark, "audit-test")
    rows = filter_audit.flagged(stage, odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    edges = [r for r in filter_audit.walk(stage, rows, "ABCDE").collect() if r.part == "en"]
    states = Counter(r.state for r in edges if r["filter"] is None)
    assert max(states.values()) == 1 and len({(r.state, r["filter"]) for r in edges}) == len(edges)
    assert sum(r["filter"] is not None for r in edges) == sum(5 - len(s) for s in states)
    flags = [r for r in rows.collect() if r.part == "en"]
    assert all(r.survivors == sum(not any(x[f] for f in r.state) for x in flags) for r in edges)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


# Operator 13 ----------------------------------------------------------------------------------------------------------


def base_by_hand(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def added_by_hand(text):
    """Every window's entropy from its own counts."""
    out = []
    allow = re.compile("://|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|(?i:example|sample|placeholder|changeme|dummy|xxxx|abcdefghij|0123456789|qwertyuiop)")
    for c in re.finditer(r"[A-Za-z0-9+/_=.:@%?&~#-]{20,}", text):
        if allow.search(c[0]):
            continue
        for no, chars, bits, needs in ((3, "0-9A-Fa-f", 3.0, ("[0-9]", "[A-Za-z]")), (4, "A-Za-z0-9+/_-", 3.8, ("[0-9]", "[A-Z]", "[a-z]"))):
            for r in re.finditer(f"[{chars}]{{20,}}", c[0]):
                spans = []
                for k in range(len(r[0]) - 19):
                    w = r[0][k : k + 20]
                    h = -sum(n / 20 * math.log2(n / 20) for n in Counter(w).values())
                    if h >= bits - 1e-6 and all(re.search(n, w) for n in needs):
                        a = c.start() + r.start() + k
                        if spans and spans[-1][1] >= a:
                            spans[-1][1] = a + 20
                        else:
                            spans.append([a, a + 20])
                out += [(a, no, b) for a, b in spans]
    return out


def scanned_by_hand(text):
    base = base_by_hand(text)
    new = [s for s in added_by_hand(text) if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]
    named = lambda spans: ",".join(f"{secret_scan.KINDS[no]}:{a}:{b}" for a, no, b in sorted(spans))
    return *(sum(s[1] == k for s in base) for k in range(3)), sha(named(base)), named(base + new)


def secret_texts():
    rng = random.Random(5)
    key = lambda n, alphabet="abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789+/": "".join(rng.choice(alphabet) for _ in range(n))
    texts = [
        None, "", "plain words only", "secret=token: abcdefgh", "token:=abc", "Password = 'hunter22'", "API_KEY:\"a.b-c=d\"", "apikey = abc", "paſſword = abcdef1", "toKen = abcdef1", "token\n= abcdef1", "token = ébcdefg",
        "AKIA" + "A" * 16, "AKIA" + "A" * 15, "xAKIAAKIA" + "Z" * 16, "token=AKIA" + "Q9" * 10, "f" * 23, "f" * 24 + " " + "0a" * 40, "\U0001f511 token=" + "0a1b" * 8 + " é deadbeef" + "0" * 20, "https://host/" + key(40), key(40), key(20), "id " + key(32, "0123456789ABCDEF"), "8" * 40, "x" * 50,
        "123e4567-e89b-12d3-a456-426614174000", "EXAMPLE" + key(30), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abc", "token=ab " * 3000 + key(40), " ".join(key(rng.randint(15, 60)) for _ in range(200)), key(300, "ab1C") + key(60) + "-" * 40 + key(60), "word " * 20_000 + key(30) + "\r\n" + "token=" + key(8),
    ]
    noise = ["token", "secret", "api_key", "=", ":", "'", '"', " ", "AKIA", "0a9f", "deadbeef", "Zq7+", "é", "\n", ".", "-", "passwd"]
    return texts + ["".join(rng.choice(noise) for _ in range(rng.randint(1, 80))) for _ in range(300)]


def test_secret_scan_by_hand(spark):
    texts = secret_texts()
    rows = [(i, t, 3) for i, t in enumerate(texts)] + [(0, None, 3), (22, texts[22], 3), (None, texts[20], 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(6)
    got = sorted((tuple(r) for r in secret_scan.digest(secret_scan.scan(table)).collect()), key=str)
    want = sorted(((i, *scanned_by_hand(t or "")) for i, t, _ in rows), key=str)
    assert got == want
    assert any("entropy_hex" in r[5] for r in want) and any("entropy_base64" in r[5] for r in want)
    assert secret_scan.scan(table.limit(0)).count() == 0


def test_secret_scan_equals_its_sql_on_odd_texts(spark, tmp_path):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(secret_texts())], "doc_id long, text string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(secret_scan.ORACLE).fetchall()
    df = secret_scan.digest(secret_scan.scan(table))
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)


def test_allowed_patterns_suppress_added_spans_only(spark):
    texts = ["key Zq7xP2mK9vL4nR8sT1wY5bD3 and token=Zq7xP2mK9vL4nR8sT1wY5bD3"]
    row = spark.createDataFrame([(1, texts[0])], "doc_id long, text string")
    kinds = lambda *allowed: [s.kind for s in secret_scan.scan(row, allowed).first().found]
    assert kinds() == ["entropy_base64", "assign"] and kinds("Zq7x") == ["assign"]


def test_running_sums_of_long_arrays(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 63, 64, 65, 5000):
        got = spark.range(1).select(secret_scan.running(F.transform(F.array_repeat(F.lit(0), n), lambda x, i: i)).alias("r")).first().r
        assert got == [k * (k + 1) // 2 for k in range(n)]


def test_native_plan_has_no_python(spark):
    plan = queries.QUERIES["op13_secret_scans"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
