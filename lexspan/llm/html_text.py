"""Operator 5: main text of web pages by a tree-structured graphical model over DOM nodes.

Each element is a binary variable (content or not). Its unary potential is a logistic function of its tag, the words of
its class, id and role, and the length, links and punctuation of its text; a parent and a child share a potential by the
child's kind. Sum-product messages pass from the leaves to the root and back, giving exact marginals; text counts as
content if the marginal of its nearest element is at least 0.5. The parameters are fitted on labelled pages that
`labelled_pages` composes (layouts, names, languages and noise vary by a seeded generator; the labels are known by
construction); PAGES of them are used, and none of the pages to be extracted.

Scripts, styles, templates and comments of the markup hold no text. Optional tags may be left out: a head ends where what
cannot stand in it begins, a title without an end at the next block, other silent elements without an end (noscript) with
the element around them or at the next section. Character references are decoded, white space inside
a block becomes one space, blocks are trimmed and joined in page order by one space. Broken markup is read as browsers do
in the main cases: unknown end tags are dropped, open elements are closed with their parent.

A null or empty html gives an empty text; a page without elements is one block of text, which is content. Repeated rows
are repeated, nulls in page_id and url are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread

PAGES, SEED = 700, 20

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style template noscript head title svg math iframe object select textarea option".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: What may stand in a head; any other tag, or text, ends it where its end tag is left out.
IN_HEAD = set("base basefont bgsound link meta title noscript noframes style script template".split())
#: Where a silent element whose end tag is missing altogether ends at the latest.
SECTIONS = set("body article main section header footer nav aside h1".split())
#: An opening tag closes these open elements first, up to the nearest one that bounds them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tr", "td", "th"}}
ENDED = set().union(*CLOSES.values())
BOUNDS = set("ul ol dl table body article section main div aside nav header footer form".split())
BLOCKS = set("p div section article aside header footer nav main ul ol li dl dt dd table form h1 h2 h3 h4 h5 h6 pre blockquote figure hr address fieldset tbody tr td th".split())

KINDS = {
    "root": "html body", "article": "article main", "p": "p", "head": "h1 h2 h3 h4 h5 h6", "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form button input fieldset", "list": "ul ol dl", "item": "li dt dd",
    "table": "table tbody thead tr td th", "section": "section", "div": "div center", "quote": "blockquote pre", "figure": "figure figcaption picture", "link": "a", "inline": " ".join(sorted(INLINE - {"a"})),
}
KIND = {tag: k for k, tags in enumerate(KINDS.values()) for tag in tags.split()}
OTHER = len(KINDS)

WORDS = {
    "good": "article content post entry story main body text prose markdown page-content read",
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc pagination pager tabs topbar toolbar links",
    "head": "header masthead banner site-header branding logo hero",
    "foot": "footer foot colophon copyright legal bottom",
    "side": "sidebar side aside rail widget widgets related recommended trending popular more-stories",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense adslot outbrain taboola",
    "talk": "comment comments reply replies discussion disqus respond reviews responses feedback",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay newsletter subscribe subscription paywall toast share social sharing signup login",
    "form": "form search searchbox login-form contact-form",
    "meta": "byline author date meta tags tag-list",
    "hidden": "hidden sr-only visually-hidden",
}
GROUP = {w: k for k, words in enumerate(WORDS.values()) for w in words.split()}
GROUPS = len(WORDS)
FEATURES = 1 + (OTHER + 1) + GROUPS * 2 + 16

_SPACE = re.compile(r"\s+")
_STOP = re.compile(r"[.!?,;:。！？،؛]")
_NAME = re.compile(r"[a-z]+(?:-[a-z]+)?|[a-z]+")


class Node:
    __slots__ = ("tag", "names", "parent", "children", "items", "hidden", "index", "label", "chars", "linked", "stops", "paragraphs", "p", "item", "run", "inlines")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.parent, self.children, self.items, self.label = tag, parent, [], [], None
        # While the page is read, so that no tag walks up the tree twice: the paragraph that a block would end, the
        # nearest element that another of its kind ends, the element that holds the run of inline ones, and that run's tags.
        self.p = self if tag == "p" else parent.p if parent and tag in INLINE else None
        self.item = self if tag in ENDED else parent.item if parent and tag not in BOUNDS else None
        self.run = parent.run if parent and tag in INLINE else self
        self.inlines: dict[str, int] | None = None
        self.names = groups(" ".join(str(attrs.get(k) or "") for k in ("class", "id", "role", "aria-label")))
        self.hidden = "hidden" in attrs or "display:none" in str(attrs.get("style") or "").replace(" ", "") or attrs.get("aria-hidden") == "true"
        self.label = attrs.get("data-label")


def groups(names: str) -> set[int]:
    low, out = names.lower(), set()
    for name in re.split(r"[\s_]+", low):
        for part in [name, *name.split("-")]:
            part = part.rstrip("0123456789")
            if part in GROUP:
                out.add(GROUP[part])
    return out


class Dom(HTMLParser):
    """A tree of elements; items of a node are its texts and children in page order."""

    RCDATA_CONTENT_ELEMENTS = ()  # tags within an unclosed title are read as tags, whatever the library's version

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)
        # The elements open within silence, from the silent one inwards, and how often each tag is among them.
        self.silent: list[str] = []
        self.quiet: dict[str, int] = {}
        self.open: dict[str, int] = {}
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        low = html.lower()
        self.last_end = {tag: low.rfind(f"</{tag}") for tag in SILENT}
        self.feed(html)
        self.close()

    def _counts(self, node: Node) -> dict[str, int]:
        """Open elements by tag: of the node's run for inline tags, of the page for others."""
        if node.tag not in INLINE:
            return self.open
        if node.run.inlines is None:
            node.run.inlines = {}
        return node.run.inlines

    def _leave(self, node: Node):
        """Close all open elements below a node's parent."""
        while True:
            counts, done = self._counts(self.at), self.at is node
            counts[self.at.tag] -= 1
            self.at = self.at.parent
            if done:
                return

    def _closed_later(self, tag: str) -> bool:
        line, column = self.getpos()
        return self.last_end.get(tag, -1) > self.lines[line - 1] + column

    def _hush(self, tag: str):
        self.silent.append(tag)
        self.quiet[tag] = self.quiet.get(tag, 0) + 1

    def _speak(self, depth: int = 0):
        """End the silent elements from the given depth inwards."""
        while len(self.silent) > depth:
            self.quiet[self.silent.pop()] -= 1

    def _ends_silence(self, tag: str) -> bool:
        """Does an opening tag end silence whose end tag is left out? A head ends where what cannot stand in it begins; a
        title without an end ends at the next block, another silent element without an end at the next section."""
        k = int(self.silent[0] == "head")
        if k and tag == "body":
            return True
        if len(self.silent) == k:
            return tag not in IN_HEAD and tag not in ("html", "head")
        held = self.silent[k]
        return tag in (BLOCKS | SECTIONS if held == "title" else SECTIONS) and not self._closed_later(held)

    def handle_starttag(self, tag, attrs):
        if self.silent and self._ends_silence(tag):
            self._speak()
        if self.silent:
            if tag not in VOID:
                self._hush(tag)
            return
        if tag in ("html", "body"):
            self._name(self.root, dict(attrs))
            return
        if tag in SILENT:
            self._hush(tag)
            return
        if tag in BLOCKS and self.at.p is not None:
            self._leave(self.at.p)
        if tag in CLOSES:
            item = self.at.item
            while item is not None:
                outer = item.parent.item
                if item.tag in CLOSES[tag]:
                    self._leave(item)
                    if tag not in ("tr", "tbody"):
                        break
                item = outer
        if tag in VOID:
            self.at.items.append(" " if tag in ("br", "hr") else "")
            return
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        self.at.items.append(node)
        self.at = node
        counts = self._counts(node)
        counts[tag] = counts.get(tag, 0) + 1

    def _name(self, node: Node, attrs: dict):
        node.names |= groups(str(attrs.get("class") or ""))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        inner = (self.at.run.inlines or {}) if tag in INLINE else self.open
        if self.silent:
            if self.quiet.get(tag, 0):
                while self.silent[-1] != tag:
                    self._speak(len(self.silent) - 1)
                self._speak(len(self.silent) - 1)
                return
            # The end of an element around it ends a silent one that nothing closes.
            if not inner.get(tag, 0) or self._closed_later(self.silent[0]):
                return
            self._speak()
        if inner.get(tag, 0):
            node = self.at
            while node.tag != tag:
                node = node.parent
            self._leave(node)

    def handle_data(self, data):
        if self.silent == ["head"] and data.strip():
            self._speak()
        if not self.silent:
            self.at.items.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA[") and not self.silent:
            self.at.items.append(data[6:])


def ordered(root: Node) -> list[Node]:
    """Nodes with parents before children, numbered; text measures are summed up from the leaves."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.index = len(out)
        out.append(node)
        todo.extend(reversed(node.children))
    for node in reversed(out):
        own = "".join(x for x in node.items if isinstance(x, str))
        own = _SPACE.sub(" ", own).strip()
        node.chars = len(own) + sum(c.chars for c in node.children)
        node.linked = node.chars if node.tag == "a" else sum(c.linked for c in node.children)
        node.stops = len(_STOP.findall(own)) + sum(c.stops for c in node.children)
        node.paragraphs = (node.tag == "p") + sum(c.paragraphs for c in node.children)
    return out


def kind(node: Node) -> int:
    return KIND.get(node.tag, OTHER)


def features(nodes: list[Node]) -> np.ndarray:
    x = np.zeros((len(nodes), FEATURES))
    above: list[set[int]] = []
    total = max(nodes[0].chars, 1)
    in_article, in_junk = [False] * len(nodes), [False] * len(nodes)
    for i, node in enumerate(nodes):
        if up := node.parent:
            in_article[i] = in_article[up.index] or up.tag in ("article", "main")
            in_junk[i] = in_junk[up.index] or up.tag in ("nav", "footer", "aside", "form")
        inherited = above[up.index] if up else set()
        above.append(inherited if node.names <= inherited else inherited | node.names)
        x[i, 0] = 1
        x[i, 1 + kind(node)] = 1
        for g in node.names:
            x[i, 2 + OTHER + g] = 1
        for g in inherited:
            x[i, 2 + OTHER + GROUPS + g] = 1
        n, at = node.chars, 2 + OTHER + 2 * GROUPS
        links = node.linked / n if n else 0.0
        x[i, at : at + 13] = (n == 0, 0 < n < 25, 25 <= n < 100, 100 <= n < 400, n >= 400, links > 0.6, 0.2 < links <= 0.6, n > 0 and node.stops / max(n, 1) > 0.008, n / total > 0.5, node.paragraphs >= 2, in_article[i], node.hidden, in_junk[i])
    return x


class Model:
    """unary: weights of the features; pair[kind][parent's state][child's state]: log potentials."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """P(content) of each node by one upward and one downward sum-product pass."""
        field = np.stack([np.zeros(len(nodes)), features(nodes) @ self.unary], 1)
        up, sent = field.copy(), np.zeros((len(nodes), 2))  # sent: message of a node to its parent
        for node in reversed(nodes[1:]):
            i = node.index
            sent[i] = np.logaddexp.reduce(self.pair[kind(node)] + up[i][None, :], axis=1)
            sent[i] -= sent[i].max()
            up[node.parent.index] += sent[i]
        down = np.zeros((len(nodes), 2))
        for node in nodes[1:]:
            i, p = node.index, node.parent.index
            rest = up[p] + down[p] - sent[i]
            down[i] = np.logaddexp.reduce(self.pair[kind(node)] + rest[:, None], axis=0)
            down[i] -= down[i].max()
        belief = up + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        dom = Dom(html)
        if not dom.root.children:
            return _SPACE.sub(" ", "".join(dom.root.items)).strip()
        nodes = ordered(dom.root)
        return main_text(dom.root, self.marginals(nodes) >= 0.5)


def main_text(root: Node, content: np.ndarray) -> str:
    """Texts of content nodes; the edges of block elements end a block, inline elements do not."""
    blocks, now = [], []

    def flush():
        block = _SPACE.sub(" ", "".join(now)).strip()
        if block:
            blocks.append(block)
        now.clear()

    todo: list = [(root, 0)]
    while todo:
        node, k = todo.pop()
        block = node.tag not in INLINE
        if k == 0 and block:
            flush()
        while k < len(node.items):
            item = node.items[k]
            k += 1
            if isinstance(item, str):
                if content[node.index]:
                    now.append(item)
            else:
                todo.append((node, k))
                todo.append((item, 0))
                break
        else:
            if block:
                flush()
    flush()
    return " ".join(blocks)


# Training -----------------------------------------------------------------------------------------------------------


def labelled_pages(n: int = PAGES, seed: int = SEED) -> Iterator[str]:
    """Pages whose elements carry data-label="1" (content) or "0"; an element without one has its parent's."""
    rng = random.Random(seed)
    alphabets = ["etaoinshrdlu", "éaenirtlsoçu", "eintrsßaühdl", "aeosrnidlñtc", "оеаинтсрвлкм", "的一是不了人我在有他这中"]

    def word(letters):
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))

    def sentence(letters, low=4, high=18):
        return " ".join(word(letters) for _ in range(rng.randint(low, high))).capitalize() + rng.choice([".", ".", ".", "!", "?"])

    def prose(letters, low=1, high=6):
        return " ".join(sentence(letters) for _ in range(rng.randint(low, high)))

    def named(group, tags):
        tag = rng.choice(tags)
        form = rng.random()
        name = rng.choice(WORDS[group].split())
        given = f' class="{name}"' if form < 0.5 else f' id="{name}"' if form < 0.75 else f' class="c{rng.randint(0, 99)} {name}-{rng.choice(["box", "wrap", "list", "inner"])}"'
        return tag, given

    for _ in range(n):
        letters = rng.choice(alphabets)
        other = rng.choice(alphabets)
        links = lambda k, ls: "".join(f'<li><a href="/{i}">{" ".join(word(ls) for _ in range(rng.randint(1, 4)))}</a></li>' for i in range(k))  # noqa: B023, E731

        def junk(group, tags, body, plain=0.25):
            tag, given = named(group, tags)
            if tag in ("nav", "footer", "header", "aside", "form") and rng.random() < plain * 2:  # noqa: B023
                given = ""
            return f'<{tag}{given} data-label="0">{body}</{tag}>'

        menu = lambda: junk("menu", ["nav", "nav", "div", "ul"], f"<ul>{links(rng.randint(2, 9), other)}</ul>")  # noqa: B023, E731
        top = lambda: junk("head", ["header", "header", "div"], rng.choice([f"<h1>{sentence(other, 1, 4)}</h1>", f"<a href='/'>{word(other)}</a>", f"<p>{sentence(other, 2, 8)}</p>"]) + (menu() if rng.random() < 0.4 else ""))  # noqa: B023, E731
        foot = lambda: junk("foot", ["footer", "footer", "div"], rng.choice([f"&copy; {word(other)}.net &middot; {sentence(other)}", f"<p>{sentence(other)}</p><ul>{links(3, other)}</ul>", f"{prose(other, 1, 2)}"]))  # noqa: B023, E731
        side = lambda: junk("side", ["aside", "aside", "div", "section"], f"<h3>{sentence(other, 1, 3)}</h3>" + rng.choice([f"<ul>{links(rng.randint(2, 6), other)}</ul>", f"<p>{prose(other, 1, 3)}</p>", f"<p>{sentence(other)}</p><p>{sentence(other)}</p>"]))  # noqa: B023, E731
        ad = lambda: junk("ad", ["div", "div", "aside", "section", "p"], rng.choice([sentence(other), f"<p>{prose(other, 1, 3)}</p>", f'<a href="/b">{sentence(other)}</a>']))  # noqa: B023, E731
        talk = lambda: junk("talk", ["div", "section", "ol", "ul"], "".join(rng.choice([f'<div class="comment"><b>{word(other)}</b><p>{prose(other, 1, 4)}</p></div>', f"<p>{prose(other, 1, 3)}</p>", f"<li>{prose(other, 1, 2)}</li>"]) for _ in range(rng.randint(1, 6))))  # noqa: B023, E731
        notice = lambda: junk("notice", ["div", "div", "section", "p"], rng.choice([prose(other, 1, 3), f"<p>{prose(other, 1, 2)}</p><button>{word(other)}</button>", f"<span>{sentence(other)}</span> <a href='/x'>{word(other)}</a>"]))  # noqa: B023, E731
        form = lambda: junk("form", ["form", "form", "div"], f"<label>{sentence(other, 1, 4)}</label><input name=q><button>{word(other)}</button>" + (f"<p>{sentence(other)}</p>" if rng.random() < 0.4 else ""))  # noqa: B023, E731

        def inline(text):
            words = text.split(" ")
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(words))
                tag = rng.choice(["b", "i", "em", "strong", "span", "a href='/r'", "code"])
                words[i] = f"<{tag}>{words[i]}</{tag.split()[0]}>"
            return " ".join(words)

        body = [f"<h1>{sentence(letters, 2, 9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 14)):
            kind_ = rng.random()
            text = prose(letters, 1, 7)
            if kind_ < 0.68:
                body.append(f"<p>{inline(text)}</p>" if rng.random() < 0.9 else f"<p><b>{sentence(letters)}<br><p>{text}</p>")
            elif kind_ < 0.76:
                body.append(f"<h{rng.randint(2, 4)}>{sentence(letters, 1, 6)}</h2>"[:-1] + ">")
            elif kind_ < 0.82:
                body.append("<ul>" + "".join(f"<li>{sentence(letters, 2, 10)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind_ < 0.86:
                body.append(f"<blockquote>{rng.choice(['', '<p>'])}{text}</blockquote>")
            elif kind_ < 0.89:
                body.append(f"<pre>{text}</pre>")
            elif kind_ < 0.92:
                body.append("<table><tr>" + "".join(f"<td>{sentence(letters, 1, 4)}</td>" for _ in range(3)) + "</tr></table>")
            elif kind_ < 0.96:
                body.append(f"<div>{inline(text)}</div>")
            else:
                body.append(f"<section><h2>{sentence(letters, 1, 5)}</h2><p>{text}</p></section>")
        for maker, p in ((ad, 0.2), (notice, 0.12), (side, 0.08), (form, 0.06)):
            if rng.random() < p:
                body.insert(rng.randint(0, len(body)), maker())
        if rng.random() < 0.2:
            body.append(talk())
        style = rng.random()
        opening, closing = ("<article", "</article>") if style < 0.55 else ("<main", "</main>") if style < 0.7 else (f'<div class="{rng.choice(WORDS["good"].split())}"', "</div>") if style < 0.9 else ("<div", "</div>")
        core = f'{opening} data-label="1">{"".join(body)}{closing}'
        if rng.random() < 0.25:
            core = f'<div class="{rng.choice(["wrap", "container", "page", "row"])}">{core}{side() if rng.random() < 0.5 else ""}</div>'
        before = [f() for f, p in ((notice, 0.3), (top, 0.5), (menu, 0.7), (ad, 0.45), (form, 0.15)) if rng.random() < p]
        after = [f() for f, p in ((talk, 0.35), (side, 0.4), (ad, 0.3), (form, 0.12), (notice, 0.12), (foot, 0.8)) if rng.random() < p]
        rng.shuffle(before)
        yield f"<!DOCTYPE html><html><head><title>{word(letters)}</title></head><body>{''.join(before)}{core}{''.join(after)}</body></html>"


def fit(pages=None) -> Model:
    """Unary weights by regularised logistic regression (Newton), pair potentials by counts beyond independence."""
    xs, ys, ks, pair = [], [], [], np.ones((OTHER + 1, 2, 2))
    for html in labelled_pages() if pages is None else pages:
        nodes = ordered(Dom(html).root)
        state = np.zeros(len(nodes), int)
        for node in nodes[1:]:
            state[node.index] = state[node.parent.index] if node.label is None else int(node.label)
            pair[kind(node), state[node.parent.index], state[node.index]] += 1
        xs.append(features(nodes))
        ys.append(state)
        ks.append([kind(node) for node in nodes])
    x, y = np.concatenate(xs), np.concatenate(ys)
    w = np.zeros(x.shape[1])
    for _ in range(12):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w = w - np.linalg.solve(hess, x.T @ (q - y) + 0.5 * w)
    joint = pair / pair.sum(axis=(1, 2), keepdims=True)
    log = np.log(joint) - np.log(joint.sum(axis=1, keepdims=True)) - np.log(joint.sum(axis=2, keepdims=True))
    return Model(w, np.clip(log, -4, 4))


def extract(spark: SparkSession, pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    model = fit() if model is None else model
    unary, pair = model.unary, model.pair

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(unary, pair)
        for batch in batches:
            for i in range(0, len(batch), 256):
                some = batch.iloc[i : i + 256]
                texts = [own.text(h) for h in some["html"]]
                yield pd.DataFrame({"page_id": some["page_id"].astype("Int64").array, "url": some["url"].array, "text": texts, "n_chars": [len(t) for t in texts]})

    rows = spread(spark, pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
