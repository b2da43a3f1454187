"""What the rules ask of a period (see `rules.enriched`), found by one walk over it in Arrow batches.

Expressions over arrays are interpreted token by token and level by level; here words, classes and labels are looked up once
for each different one of a batch, and the walk over a period stops at the few tokens that a rule may ask for. Columns of
the tokens pass through as Arrow arrays. Where a list is null in `rules.enriched` it is None here.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


class Lists(NamedTuple):
    """The rules' lists."""

    negators: frozenset
    scoped: frozenset
    pairs: frozenset
    adverbs: frozenset
    modals: frozenset
    adjectives: frozenset
    speech: frozenset
    speaking: frozenset
    complements: frozenset
    helpers: frozenset
    verbal: frozenset
    quotes: dict


#: Documents whose tokens are laid out at once.
AT_ONCE = 256
#: What a token shows by itself; ASKED are those that a rule asks for.
NEGATOR, SCOPED, PAIR, ADJECTIVE, MODAL, VERBAL, NUCLEUS, COP, HELPER, COMPLEMENT, SPEAKING, SPEECH, UNKNOWN, UNLABELLED, QUOTE, JOINS, AUX, RULED, INFINITIVE, POR = (1 << k for k in range(20))
ASKED = NEGATOR | SCOPED | PAIR | ADJECTIVE | VERBAL
_INFINITIVE = re.compile(r"(^|\|)VerbForm=Inf(\||$)")
_INTS = ("owner", "parent", "region", "head_region", "owner_region", "said")
_FLAGS = ("nucleus", "region_closed", "region_nested", "head_nucleus", "able")
_LISTS = ("own", "scope_own", "scope_head", "comps", "content", "cut", "words")


def schema(documents: DataFrame) -> tuple[str, list[str]]:
    """The index' columns as a DDL string, and the names of the tokens' own columns."""
    token = documents.schema["ps"].dataType.elementType["t"].dataType.elementType
    kinds = {f.name: f.dataType.simpleString() for f in token}
    ord_, low = kinds["ord"], documents.schema["ps"].dataType.elementType["low"].dataType.simpleString()
    fields = [c for c in kinds if c != "dep"]
    of = {"owner": low, "parent": low, "said": low, "region": "int", "head_region": "int", "owner_region": "int", **{c: "boolean" for c in _FLAGS}, **{c: "array<int>" for c in _LISTS}, "helpers": "array<struct<o:int,dep:string>>", "nx": f"struct<ord:{ord_},low:string,pos:string,dep:string,owner:{low},parent:{low},scope:array<int>>"}
    order = ["nucleus", "owner", "parent", "region", "region_closed", "region_nested", "head_pos", "head_dep", "head_nucleus", "head_region", "owner_dep", "owner_region", "own", "helpers", "scope_own", "scope_head", "said", "nx", "comps", "content", "cut", "able", "words"]
    period = documents.schema["ps"].dataType.elementType["period"].dataType.simpleString()
    out = {"doc_id": documents.schema["doc_id"].dataType.simpleString(), "period": period, "unknown": "boolean", **{c: kinds[c] for c in fields}, "low": "string", "lem": "string", "dep": "string", "whole_dep": "string", **{c: of.get(c, "string") for c in order}}
    return ", ".join(f"`{c}` {k}" for c, k in out.items()), list(kinds)


def found(documents: DataFrame, lists: Lists) -> DataFrame:
    """documents: as `tree.gathered` has them. The rows of the index."""
    ddl, fields = schema(documents)
    names = StructType.fromDDL(ddl).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                columns = _walked(batch.slice(k, AT_ONCE), lists, fields)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    conf, most = documents.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf.set(most, str(min(int(conf.get(most)), AT_ONCE) if int(conf.get(most)) > 0 else AT_ONCE))
    return documents.select("doc_id", "ps").mapInArrow(run, ddl)


class _Column:
    """A column of lists that is filled row by row."""

    def __init__(self):
        self.values, self.ends = [], []

    def add(self, xs: list | None) -> None:
        if xs is None:
            self.ends.append(None)
        else:
            self.ends.append(len(self.values))
            self.values.extend(xs)

    def array(self, values: pa.Array | None = None) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([*self.ends, len(self.values)], pa.int32()), pa.array(self.values, pa.int32()) if values is None else values)


def _looked(column: pa.Array, show: Callable[[str | None], int]) -> np.ndarray:
    """What each value of a column shows; each different value is looked at once."""
    held = column.dictionary_encode()
    table = np.array([*map(show, held.dictionary.to_pylist()), show(None)], np.int64)
    return table[held.indices.fill_null(-1).to_numpy(zero_copy_only=False)]


def _mapped(column: pa.Array, change: Callable[[str], str]) -> pa.Array:
    held = column.dictionary_encode()
    return pc.take(pa.array([change(v) for v in held.dictionary.to_pylist()], pa.string()), held.indices)


def _label(dep: str) -> str:
    return dep.split(":", 1)[0].lower()


def _shown(t: dict[str, pa.Array], label: pa.Array, some: Lists) -> np.ndarray:
    def word(token: str | None) -> int:
        if token is None:
            return 1 << 30
        low = token.lower()
        return (NEGATOR if low in some.negators else 0) | (SCOPED if low in some.scoped else 0) | (PAIR if low in some.pairs else 0) | (1 << 30 if low in some.adverbs else 0) | (JOINS if low in ("que", "de") else 0) | (POR if low == "por" else 0) | (QUOTE if token in marks else 0)

    def lemma(value: str | None) -> int:
        if value is None:
            return 0
        low = value.lower()
        return (MODAL if low in some.modals else 0) | (ADJECTIVE if low in some.adjectives else 0) | (SPEECH if value in some.speech else 0)

    def of_label(value: str | None) -> int:
        if value is None:
            return UNLABELLED
        shows = {COP: value == "cop", AUX: value == "aux", HELPER: value in some.helpers, COMPLEMENT: value in some.complements, SPEAKING: value in some.speaking, JOINS: value in ("mark", "case"), RULED: value in ("xcomp", "ccomp"), INFINITIVE: value == "xcomp"}
        return sum(k for k, v in shows.items() if v)

    marks = {*some.quotes, *some.quotes.values()}
    w, m, d = _looked(t["token"], word), _looked(t["lemma"], lemma), _looked(label, of_label)
    p = _looked(t["pos"], lambda v: UNKNOWN if v is None else VERBAL if v in some.verbal else 1 << 30 if v == "ADJ" else 0)
    f = _looked(t["feats"], lambda v: 0 if v is None else SCOPED | (INFINITIVE if _INFINITIVE.search(v) else 0))
    verbal = (p & VERBAL) > 0
    when = lambda yes, bits: np.where(yes, bits, 0)
    return (
        (w & (NEGATOR | SCOPED | PAIR | QUOTE | POR)) | (p & (VERBAL | UNKNOWN)) | (m & SPEECH) | (d & (COP | AUX | HELPER | COMPLEMENT | SPEAKING | UNLABELLED)) | (w & d & JOINS)
        | when(verbal, (f & SCOPED) | (m & MODAL) | (d & RULED) | (d & f & INFINITIVE)) | when(((p & (1 << 30)) > 0) & ((w & (1 << 30)) == 0), m & ADJECTIVE) | when(verbal & ((d & (HELPER | UNLABELLED)) == 0), NUCLEUS)
    )


def _regions(q: list[tuple[int, str]], pair: dict) -> dict[int, list]:
    """Of each region its closing mark (None where no end is met) and the region around it, by its opening mark."""
    stack, out = [], {}
    for at, token in q:
        if stack and pair[stack[-1][1]] == token:
            out[stack.pop()[0]][0] = at
        elif token in pair:
            out[at] = [None, stack[-1][0] if stack else None]
            stack.append((at, token))
    return out


def _owners(h: list, nuclei: set) -> list[int]:
    """Of each token the nearest nucleus among itself and its ancestors; -1 if there is none."""
    own = [-2] * len(h)
    for i in range(len(h)):
        j, trail = i, []
        while own[j] == -2:
            k = h[j]
            if j in nuclei:
                own[j] = j
            else:
                own[j] = -1
                if k is not None and k != j:
                    trail.append(j)
                    j = k
        for x in trail:
            own[x] = own[j]
    return own


def _walked(batch: pa.RecordBatch, some: Lists, fields: list[str]) -> dict[str, pa.Array] | None:
    ps = batch.column("ps").flatten()
    periods_of = pc.list_value_length(batch.column("ps")).fill_null(0).to_pylist()
    part_of = {f.name: ps.field(k) for k, f in enumerate(ps.type)}
    flat = part_of["t"].flatten()
    if not len(flat):
        return None
    t = {c: flat.field(k) for k, c in enumerate(fields)}
    label = _mapped(t["dep"], _label)
    kinds = _shown(t, label, some)
    heads, sizes = part_of["h"].flatten().to_pylist(), pc.list_value_length(part_of["t"]).to_pylist()
    lows = part_of["low"].to_pylist()
    stops = np.flatnonzero(kinds).tolist()
    kinds = kinds.tolist()
    raw = t["head"]
    ids, docs, at, head_at, owner_at, unknowns, next_at, helper_at = [], [], [], [], [], [], [], []
    ints, flags, lists = {c: [] for c in _INTS}, {c: [] for c in _FLAGS}, {c: _Column() for c in _LISTS}
    helpers, nx_owner, nx_parent, nx_scope = _Column(), [], [], _Column()
    a = p = s = 0
    for d, count in enumerate(periods_of):
        first_a, first_p = a, p
        total = sum(sizes[first_p : first_p + count])
        end_s = bisect_left(stops, first_a + total, s)
        marks = [x for x in stops[s:end_s] if kinds[x] & QUOTE]
        regions = {}
        if marks:
            regions = _regions([(t["ord"][x].as_py(), t["token"][x].as_py()) for x in marks], some.quotes)
            events = sorted([(o, o) for o in regions] + [(c, outer) for c, outer in regions.values() if c is not None])
            event_ords = [e[0] for e in events]
        for p in range(first_p, first_p + count):
            n, low = sizes[p], lows[p]
            end = bisect_left(stops, a + n, s)
            seen, s = [x - a for x in stops[s:end]], end
            if not seen:
                a += n
                continue
            h, ks = heads[a : a + n], kinds[a : a + n]
            unknown = any(ks[i] & UNKNOWN for i in seen)
            nuclei, lost = {i for i in seen if ks[i] & NUCLEUS}, False
            for i in seen:
                if ks[i] & COP:
                    head = raw[a + i].as_py()
                    if head is None:
                        lost = True  # which token it makes a nucleus is not known
                    elif 0 <= head - low < n:
                        nuclei.add(head - low)
            parted = {h[i] for i in seen if ks[i] & NEGATOR and h[i] is not None and h[i] != i and not ks[h[i]] & (UNKNOWN | HELPER | UNLABELLED) and not lost and h[i] not in nuclei}
            wanted = range(n) if unknown else sorted({i for i in seen if ks[i] & ASKED} | nuclei | parted)
            # Tokens behind markers, that evidence names: helpers of nuclei, words of modals, the next of a pair.
            if not unknown and wanted:
                more = {i for i in seen if (ks[i] & HELPER and h[i] in nuclei) or ks[i] & JOINS} | {i + 1 for i in seen if ks[i] & PAIR and i + 1 < n}
                wanted = sorted(more.union(wanted))
            if not wanted:
                a += n
                continue
            own = _owners(h, nuclei)
            owned: dict[int, list[int]] = {q: [] for q in nuclei}
            for j, o in enumerate(own):
                if o >= 0:
                    owned[o].append(j)
            up = {q: own[h[q]] if h[q] is not None and h[q] != q else -1 for q in nuclei}
            parent = lambda i: up[own[i]] if own[i] >= 0 else -1  # noqa: B023, E731
            speaking = {q for q in nuclei if ks[q] & SPEAKING and up[q] >= 0 and ks[up[q]] & SPEECH}
            related: dict[int, list[int]] = {}
            for j in seen:
                if ks[j] & (COMPLEMENT | HELPER) and h[j] is not None and h[j] != j:
                    related.setdefault(h[j], []).append(j)
            st = None
            if regions:
                st, k = [None] * n, bisect_left(event_ords, low)
                begin, state = 0, events[k - 1][1] if k else None
                while True:
                    stop = event_ords[k] - low if k < len(events) and event_ords[k] < low + n else n
                    st[begin:stop] = [state] * (stop - begin)
                    if stop == n:
                        break
                    begin, state, k = stop + 1, events[k][1], k + 1
            region = (lambda i: st[i]) if st else (lambda i: None)  # noqa: B023, E731
            children: list[list[int]] | None = None
            known: dict[int, list[int]] = {}

            def descendants(c: int) -> list[int]:
                nonlocal children
                if c not in known:  # noqa: B023
                    if children is None:
                        children = [[] for _ in h]  # noqa: B023
                        for j, k in enumerate(h):  # noqa: B023
                            if k is not None and k != j:
                                children[k].append(j)
                    out, todo = {c}, [c]
                    while todo:
                        for j in children[todo.pop()]:
                            if j not in out:
                                out.add(j)
                                todo.append(j)
                    known[c] = sorted(out)  # noqa: B023
                return known[c]  # noqa: B023

            def scope(i: int) -> list[int] | None:
                """The owner's tokens, within the token's closed region."""
                o, r = own[i], region(i)  # noqa: B023
                if o < 0:
                    return None
                if r is None:
                    return [low + j for j in owned[o]]  # noqa: B023
                if regions[r][0] is None or region(o) != r:  # noqa: B023
                    return None
                return [low + j for j in owned[o] if region(j) == r] or None  # noqa: B023

            for i in wanted:
                k, hi, o, r = ks[i], h[i], own[i], region(i)
                nucleus = i in nuclei
                docs.append(d)
                ids.append(p)
                at.append(a + i)
                head_at.append(None if hi is None else a + hi)
                owner_at.append(None if o < 0 else a + o)
                unknowns.append(unknown)
                mine = up[o] if o >= 0 else -1
                ints["owner"].append(None if o < 0 else low + o)
                ints["parent"].append(None if mine < 0 else low + mine)
                ints["region"].append(r)
                ints["head_region"].append(None if hi is None else region(hi))
                ints["owner_region"].append(None if o < 0 else region(o))
                flags["nucleus"].append(True if nucleus else None if lost else False)
                flags["region_closed"].append(None if r is None else regions[r][0] is not None)
                flags["region_nested"].append(None if r is None else regions[r][1] is not None)
                flags["head_nucleus"].append(None if hi is None else True if hi in nuclei else None if lost else False)
                said = None
                if nucleus and speaking:
                    j, steps = i, 0
                    while j >= 0 and j not in speaking and steps <= n:
                        j, steps = up[j], steps + 1
                    if j in speaking:
                        said = low + up[j]
                ints["said"].append(said)
                lists["own"].add([low + j for j in owned[i]] if nucleus else None)
                if nucleus:
                    some_helpers = [j for j in related.get(i, ()) if ks[j] & HELPER]
                    helper_at.extend(a + j for j in some_helpers)
                    helpers.add([low + j for j in some_helpers])
                else:
                    helpers.add(None)
                lists["scope_own"].add(scope(i) if k & SCOPED else None)
                below = None
                if k & NEGATOR and hi in parted and hi != i and (r is None or (regions[r][0] is not None and region(hi) == r)):
                    below = [low + j for j in descendants(hi) if r is None or region(j) == r] or None
                lists["scope_head"].add(below)
                if k & MODAL or (k & ADJECTIVE and nucleus):
                    helps = k & MODAL and k & AUX
                    comps = ([] if hi is None else [hi]) if helps else [j for j in related.get(i, ()) if ks[j] & COMPLEMENT]
                    if helps:
                        content = [j for j in descendants(hi) if j != i] if hi is not None else []
                    else:
                        content = sorted(set().union(*map(descendants, comps))) if comps else None
                    ruled = {c for c in comps if ks[c] & RULED}
                    words = [low + j for j in seen if ks[j] & JOINS and h[j] in ruled and h[j] != j] or None
                    lists["comps"].add([low + c for c in comps])
                    lists["content"].add(None if content is None else [low + j for j in content])
                    lists["cut"].add(None if content is None else [low + j for j in content if r is None or region(j) == r] or None)
                    lists["words"].add(words)
                    flags["able"].append(any(ks[c] & INFINITIVE for c in comps))
                else:
                    for c in ("comps", "content", "cut", "words"):
                        lists[c].add(None)
                    flags["able"].append(None)
                if k & PAIR and i + 1 < n:
                    j = i + 1
                    next_at.append(a + j)
                    nx_owner.append(None if own[j] < 0 else low + own[j])
                    nx_parent.append(None if parent(j) < 0 else low + parent(j))
                    nx_scope.add(scope(j) if k & POR else None)
                else:
                    next_at.append(None)
                    nx_owner.append(None)
                    nx_parent.append(None)
                    nx_scope.add(None)
            a += n
        p, s = first_p + count, end_s
    if not at:
        return None
    rows, to_head, to_owner, to_next = (pa.array(x, pa.int32()) for x in (at, head_at, owner_at, next_at))
    low_, lem, of = _mapped(t["token"], str.lower), _mapped(t["lemma"], str.lower), lambda c, to: pc.take(c, to)
    kind = part_of["low"].type
    pair = pc.take(pa.array([bool(k & PAIR) for k in kinds]), rows)
    nx = {"ord": of(t["ord"], to_next), "low": of(low_, to_next), "pos": of(t["pos"], to_next), "dep": of(label, to_next), "owner": pa.array(nx_owner, kind), "parent": pa.array(nx_parent, kind), "scope": nx_scope.array()}
    return {
        "doc_id": pc.take(batch.column("doc_id"), pa.array(docs, pa.int32())), "period": pc.take(part_of["period"], pa.array(ids, pa.int32())), "unknown": pa.array(unknowns, pa.bool_()),
        **{c: of(t[c], rows) for c in fields if c != "dep"}, "low": of(low_, rows), "lem": of(lem, rows), "dep": of(label, rows), "whole_dep": of(t["dep"], rows),
        **{c: pa.array(ints[c], kind if c in ("owner", "parent", "said") else pa.int32()) for c in _INTS}, **{c: pa.array(flags[c], pa.bool_()) for c in _FLAGS}, **{c: x.array() for c, x in lists.items()},
        "head_pos": of(t["pos"], to_head), "head_dep": of(label, to_head), "owner_dep": of(label, to_owner),
        "helpers": helpers.array(pa.StructArray.from_arrays([pa.array(helpers.values, pa.int32()), of(label, pa.array(helper_at, pa.int32()))], names=["o", "dep"])),
        "nx": pa.StructArray.from_arrays(list(nx.values()), names=list(nx), mask=pc.invert(pair)),
    }
