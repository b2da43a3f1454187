"""Operator 9: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is lower-cased and cut into words at white space, ASCII digits and punctuation. Word inputs are the word's
embedding, char inputs the summed embeddings of its byte trigrams, four-grams and six-grams (with the word's edges), all
hashed to tables of fixed size that begin with zeros and are learned with the network. It reads windows of WINDOW words,
each STRIDE words after the one before, so that every word of the whole text lies in overlapping windows; attention pools
the states of a window, and the text's logit is the largest of its windows' logits, calibrated on the training rows.

Training uses at most TRAIN_ROWS labelled texts of at most TRAIN_CHARS code points outside the held-out fold, the first
in the order of xxhash64(doc_id); those bounds are parameters. In each pass the window with the largest logit stands for
its text, with one further window for clean texts, since labels belong to texts and not to words; before the first pass
the window is chosen by log odds of words, which are no input. Small training sets get more passes.

Null and empty texts, or texts without words, get the score of an empty window. A text's labels must agree to be used in
training; null labels are not. Repeated rows are repeated; a null doc_id is kept, not held out, and never trained on.
Without both labels the score is 0 for all. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, spread
from .langid import Words, held_out

WINDOW, STRIDE, TRAIN_ROWS, TRAIN_CHARS, THRESHOLD = 32, 16, 3000, 100_000, 0.3
DIM, HIDDEN = 6, 8
#: Passes and the tables' step size were chosen by `compare` on an inner fold of the training rows.
EPOCHS, STEPS, BATCH, RATE, TABLE_RATE = 6, 400, 64, 0.01, 0.05
INPUT = 2 * DIM
#: Words, trigrams, four-grams and six-grams are hashed to so many bits; each has a table of that size.
BITS = {"word": 18, "tri": 16, "four": 18, "six": 18}
GRAMS = ("tri", "four", "six")
#: Texts in which a word or gram must occur for an embedding of its own, and pseudo-counts of the first windows' odds.
FREQUENT, SHRINK = 4, 5.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Texts:
    """Word and gram ids, and the windows, of some texts; hashed slice by slice, so that what is kept is small."""

    def __init__(self, texts: list[str | None], slice_chars: int = 500_000):
        parts: dict[str, list] = {k: [np.zeros(0, np.int32)] for k in ("word", "tri", "four", "six", "sizes", "texts")}
        for a, b in slices(texts, slice_chars):
            w = Words(texts[a:b], max(BITS.values()), long_grams=True)
            for k, ids in (("word", w.word), ("tri", w.tri >> (max(BITS.values()) - BITS["tri"])), ("four", w.four), ("six", w.six), ("sizes", w.size + 1), ("texts", np.diff(w.first))):
                parts[k].append(ids.astype(np.int32))
        self.word, self.tri, self.four, self.six, self.sizes, per_text = (np.concatenate(parts.pop(k)) for k in ("word", "tri", "four", "six", "sizes", "texts"))
        self.at = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.first = np.concatenate([[0], np.cumsum(per_text, dtype=np.int64)])
        begins, owner = [], []
        for i, (a, b) in enumerate(zip(self.first[:-1], self.first[1:])):
            starts = np.arange(a, max(a + 1, b - (WINDOW - STRIDE)), STRIDE)
            begins.append(np.stack([starts, np.minimum(starts + WINDOW, b)], 1))
            owner.append(np.full(len(starts), i))
        self.windows = np.concatenate(begins) if begins else np.zeros((0, 2), int)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, int)

    def spans(self, what: str):
        """The ids of each text."""
        for a, b in zip(self.first[:-1], self.first[1:]):
            if what == "word" or a == b:
                yield self.word[a:b]
            else:
                yield getattr(self, what)[self.at[a] : self.at[b - 1] + self.sizes[b - 1]]


def log_odds(t: Texts, labels: np.ndarray) -> np.ndarray:
    """Shrunken log odds of each word and its six-grams in toxic texts, by the texts without its own one."""
    share, odds = labels.mean(), np.zeros(len(t.at), np.float32)
    for what in ("word", "six"):
        counts = np.zeros((2, 1 << BITS[what]), np.float32)
        for ids, y in zip(t.spans(what), labels):
            counts[int(y), np.unique(ids)] += 1
        every = counts.sum(axis=0)
        for ids, y, a, b in zip(t.spans(what), labels, t.first[:-1], t.first[1:]):
            if a < b:
                value = np.log((counts[1][ids] - y + SHRINK * share) / ((every[ids] - 1 + SHRINK) * share))
                odds[a:b] += value if what == "word" else np.maximum.reduceat(value, t.at[a:b] - t.at[a])
    return odds


class Network:
    """Weights p: tables of word and gram embeddings, and for each direction W (input), U (recurrent), b; attention a;
    output o, c. Tables begin with zeros, so that what was never learned adds nothing."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {k: np.zeros((1 << n, DIM), np.float32) for k, n in BITS.items()}
        for d in "fb":
            self.p |= {f"W{d}": draw(INPUT, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": draw(2 * HIDDEN), "o": draw(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, t: Texts, a: int, b: int) -> np.ndarray:
        """Inputs of the words from a to b: the word's embedding, and its grams' summed ones by the root of their number."""
        if a == b:
            return np.zeros((0, INPUT), np.float32)
        begin, end = t.at[a], t.at[b - 1] + t.sizes[b - 1]
        grams = sum(self.p[k][getattr(t, k)[begin:end]] for k in GRAMS)
        chars = np.add.reduceat(grams, t.at[a:b] - begin, axis=0) / np.sqrt(t.sizes[a:b, None].astype(np.float32))
        return np.concatenate([self.p["word"][t.word[a:b]], chars], axis=1)

    def window_logits(self, t: Texts) -> np.ndarray:
        """Logits of all windows, some at a time."""
        out = [np.zeros(0, np.float32)]
        for i in range(0, len(t.windows), 2048):
            windows = t.windows[i : i + 2048]
            a, b = int(windows[0, 0]), int(windows[:, 1].max())
            out.append(self.forward(self.inputs(t, a, max(a, b)), windows - a))
        return np.concatenate(out)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = False):
        """x: (steps, rows, 3 * HIDDEN) input projections in reading order; a masked step leaves the state."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        u, out, notes = self.p[f"U{d}"], np.empty((x.shape[0], x.shape[1], HIDDEN), np.float32), []
        uzr, un = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
        for k in range(x.shape[0]):
            zr = sigmoid(x[k, :, : 2 * HIDDEN] + h @ uzr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[k, :, 2 * HIDDEN :] + (r * h) @ un)
            g = z * mask[k][:, None]
            if keep:
                notes.append((h, z, r, n))
            h = h + g * (n - h)
            out[k] = h
        return out, notes

    def forward(self, x: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Logits of windows over the input rows x."""
        steps = np.arange(WINDOW)[:, None]
        at = windows[:, 0][None] + steps
        mask = (at < windows[:, 1][None]).astype(np.float32)
        at = np.minimum(at, max(len(x) - 1, 0))
        if not len(x):
            x, at = np.zeros((1, INPUT), np.float32), np.zeros_like(at)
        proj = {d: x @ self.p[f"W{d}"] + self.p[f"b{d}"] for d in "fb"}
        hf, nf = self._run(proj["f"][at], mask, "f", keep)
        hb, nb = self._run(proj["b"][at[::-1]], mask[::-1], "b", keep)
        h = np.concatenate([hf, hb[::-1]], axis=2)
        s = h @ self.p["a"] + (mask - 1) * 30
        e = np.exp(s - s.max(axis=0))
        att = e / e.sum(axis=0)
        pooled = (att[:, :, None] * h).sum(axis=0)
        logits = pooled @ self.p["o"] + self.p["c"][0]
        return (logits, (at, mask, nf, nb, h, att, pooled)) if keep else logits

    def gradients(self, x: np.ndarray, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        logits, (at, mask, nf, nb, h, att, pooled) = self.forward(x, windows, keep=True)
        d = ((sigmoid(logits) - y) * weight / len(y)).astype(np.float32)
        grad = {"o": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * self.p["o"]
        ds = att * ((h * dpool).sum(axis=2) - (pooled * dpool).sum(axis=1))
        grad["a"] = np.einsum("tr,trk->k", ds, h)
        dh = att[:, :, None] * dpool + ds[:, :, None] * self.p["a"]
        dx = np.zeros_like(x)
        for name, notes, order, part in (("f", nf, range(WINDOW), slice(0, HIDDEN)), ("b", nb, range(WINDOW - 1, -1, -1), slice(HIDDEN, None))):
            u, carry = self.p[f"U{name}"], np.zeros((len(y), HIDDEN), np.float32)
            uzr, un = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
            gu, gp = np.zeros_like(u), np.zeros((WINDOW, len(y), 3 * HIDDEN), np.float32)
            for k in reversed(range(WINDOW)):
                step = order[k]
                before, z, r, n = notes[k]
                m = mask[step][:, None]
                carry = carry + dh[step, :, part]
                dz = carry * m * (n - before) * z * (1 - z)
                dn = carry * m * z * (1 - n * n)
                drh = dn @ un.T
                dr = drh * before * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                gu[:, : 2 * HIDDEN] += before.T @ dzr
                gu[:, 2 * HIDDEN :] += (r * before).T @ dn
                carry = carry * (1 - m * z) + drh * r + dzr @ uzr.T
                gp[step] = np.concatenate([dzr, dn], axis=1)
            flat, rows = gp.reshape(-1, 3 * HIDDEN), at.reshape(-1)
            grad |= {f"U{name}": gu, f"b{name}": flat.sum(axis=0), f"W{name}": x[rows].T @ flat}
            ids, sums = _sum_by(rows, flat @ self.p[f"W{name}"].T)
            dx[ids] += sums
        used = np.unique(at)
        grad["rows"] = (used, dx[used])
        return grad

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The largest window logit of each text."""
        t = Texts(texts)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, t.owner, self.window_logits(t))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(np.clip(self.scale * self.logits(texts) + self.shift, -30, 30)).astype(float)


class Adam:
    """Adam for the dense weights. Rows of the tables take plain steps, scaled by one measure for a whole table, so that
    what many texts agree on grows and what one text holds by chance hardly moves."""

    def __init__(self, p: dict, table_rate: float = TABLE_RATE):
        self.table_rate = table_rate
        dense = {k: x for k, x in p.items() if k not in BITS}
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in dense.items()}, {k: np.zeros_like(x) for k, x in dense.items()}, 0
        self.size = dict.fromkeys(BITS, 0.0)

    def step(self, p: dict, grad: dict, rows: dict) -> None:
        """grad: dense gradients; rows: (ids, gradients) of the tables."""
        self.t += 1
        fix = RATE * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grad.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            p[k] -= fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)
        for k, (ids, g) in rows.items():
            if len(ids):
                self.size[k] = 0.99 * self.size[k] + 0.01 * float((g * g).mean())
                p[k][ids] -= self.table_rate * g / (np.sqrt(self.size[k] / (1 - 0.99**self.t)) + 1e-12)


def _sum_by(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their rows."""
    if not len(ids):
        return ids, values
    order = np.argsort(ids, kind="stable")
    unique, start = np.unique(ids[order], return_index=True)
    return unique, np.add.reduceat(values[order], start, axis=0).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, table_rate: float = TABLE_RATE) -> Network | None:
    """None unless both labels occur."""
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    t = Texts(texts)
    first = np.searchsorted(t.owner, np.arange(len(texts)))
    net, rng = Network(), np.random.default_rng(3)
    odds = log_odds(t, labels)
    least = min(FREQUENT, max(2, len(texts) // 100))
    common = {k: np.bincount(np.concatenate([np.unique(ids) for ids in t.spans(k)]), minlength=1 << n) >= least for k, n in BITS.items()}
    adam, balance = Adam(net.p, table_rate), float(np.sqrt((labels == 0).sum() / (labels == 1).sum()))
    clean = np.flatnonzero(labels == 0)
    for epoch in range(max(epochs, -(-STEPS * BATCH // (len(labels) + len(clean))))):
        if epoch == 0:  # before training the window with the largest odds stands for its text
            value = np.array([odds[a:b].max(initial=-9) for a, b in t.windows])
        else:
            value = net.window_logits(t)
        order = np.lexsort((-value, t.owner))
        top = order[first]
        extra = first + rng.integers(0, np.append(first[1:], len(t.owner)) - first)
        picked = np.concatenate([top, extra[clean]])
        y = np.concatenate([labels, np.zeros(len(clean), np.float32)])
        shuffle = rng.permutation(len(picked))
        for i in range(0, len(picked), BATCH):
            rows = shuffle[i : i + BATCH]
            windows, yy = t.windows[picked[rows]], y[rows]
            words = np.unique(np.minimum(windows[:, :1] + np.arange(WINDOW), max(len(t.word) - 1, 0)))
            local = np.searchsorted(words, windows[:, 0])
            near = np.stack([local, local + windows[:, 1] - windows[:, 0]], 1)
            at = np.concatenate([np.arange(t.at[w], t.at[w] + t.sizes[w]) for w in words])
            owner, root = np.repeat(np.arange(len(words)), t.sizes[words]), np.sqrt(t.sizes[words][:, None]).astype(np.float32)
            ids = {k: getattr(t, k)[at] for k in GRAMS} | {"word": t.word[words]}
            chars = np.add.reduceat(sum(net.p[k][ids[k]] for k in GRAMS), np.searchsorted(owner, np.arange(len(words))), axis=0) / root
            grad = net.gradients(np.concatenate([net.p["word"][ids["word"]], chars], axis=1), near, yy, np.where(yy > 0, balance, 1).astype(np.float32))
            used, dx = grad.pop("rows")
            back = np.zeros((len(words), INPUT), np.float32)
            back[used] = dx
            down = (back[:, DIM:] / root)[owner]
            tables = {}
            for k in BITS:
                often = common[k][ids[k]]
                tables[k] = _sum_by(ids[k][often], (back[:, :DIM] if k == "word" else down)[often])
            adam.step(net.p, grad, tables)
    # Calibration of the texts' largest logits: logistic regression by Newton steps.
    value = net.window_logits(t)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, t.owner, value)
    z, theta = np.stack([best, np.ones_like(best)], 1), np.array([1.0, 0.0])
    for _ in range(25):
        q = sigmoid(np.clip(z @ theta, -30, 30))
        hess = (z * (q * (1 - q))[:, None]).T @ z + 1e-2 * np.eye(2)
        theta = theta - np.linalg.solve(hess, z.T @ (q - labels) + 1e-2 * (theta - [1.0, 0.0]))
    net.scale, net.shift = max(float(theta[0]), 1e-3), float(theta[1])
    return net


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> pd.DataFrame:
    """doc_id, text, toxic of at most so many labelled texts outside the held-out fold."""
    said = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("low"), F.max("toxic").alias("toxic")).where("low = toxic").where(~held_out(F.col("doc_id")))
    chosen = said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "toxic")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "text").limit(rows).toPandas().drop_duplicates("text")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network | None:
    sample = training_rows(docs, labels, rows)
    return train(list(sample["text"]), sample["toxic"].to_numpy(float))


def compare(docs: DataFrame, labels: DataFrame, settings: list[tuple[int, float]], inner: int = 0) -> dict[tuple[int, float], float]:
    """Settings (passes, step size of the tables) by the area under the curve on an inner fold: the training rows whose
    crc32(doc_id) mod 4 is `inner`. The network is trained on the other training rows, and no row of the held-out fold is
    read, so settings may be chosen by these figures."""
    rows = training_rows(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    inside = np.array([zlib.crc32(str(i).encode()) % 4 == inner for i in rows["doc_id"]])
    texts, toxic, out = list(rows["text"]), rows["toxic"].to_numpy(float), {}
    for epochs, table_rate in settings:
        net = train([t for t, i in zip(texts, inside) if not i], toxic[~inside], epochs, table_rate)
        score, y = net.score([t for t, i in zip(texts, inside) if i]), toxic[inside] == 1
        ranks = pd.Series(score).rank().to_numpy()
        out[epochs, table_rate] = float((ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / max(1, y.sum() * (~y).sum()))
    return out


def rate(spark: SparkSession, docs: DataFrame, labels: DataFrame | None = None, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    net = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")) if net is None else net

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            for a, b in slices(texts, 1_000_000):
                score = np.zeros(b - a) if net is None else net.score(texts[a:b])
                yield pd.DataFrame({"doc_id": batch["doc_id"][a:b].astype("Int64").to_numpy(), "held_out": batch["held_out"][a:b].to_numpy(), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return spread(spark, rows).mapInPandas(predict, "doc_id long, held_out boolean, score double, predicted int")
