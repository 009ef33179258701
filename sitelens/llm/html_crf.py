"""Main text of web pages by a linear-chain conditional random field.

A page becomes the sequence of its leaf blocks: runs of text between block-level
tags, in page order, with character references decoded and white space turned
into single spaces.  Each block has features from its ancestors (tags, words of
class, id and role), its text (length, share of linked characters, sentence
marks) and its place in the page (how near it stands to the element that holds
most of the unlinked text, how linked its surroundings are, before or after the
main heading).  A chain with two labels (main text or not) scores block features and
label changes; it is trained on labelled pages by gradient steps on the
conditional log-likelihood (forward-backward), and the best labelling of a page
is found by Viterbi.  Kept blocks are joined by blank lines.

The labelled pages come from :func:`labelled_pages`: page layouts composed by
rule (menus, banners, adverts, forms, sidebars, comments around articles in
many containers and styles: paragraphs, plain divs, tables, lists of links and
definitions, preformatted text, a single block) whose blocks carry their label by
construction.

Pages are independent: parsing and decoding run where the page is, whole, with
memory for one batch.  Defined cases: a null or blank page has no text;
malformed tags are text or ignored, never an error; repeated pages get equal
results; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sitelens.llm.common import map_texts

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^<]++|<)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = frozenset("script style noscript template head title svg iframe object textarea select canvas audio video".split())
#: Their bodies hold no tags: all up to the literal end tag is passed over.
RAW = frozenset("script style textarea title iframe noscript".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in RAW}
#: What matters inside a script: comments, their ends (<!--> is both) and script tags.
SCRIPT_MARK = re.compile(r"(<!--)(?!-*+>)|((?:<!)?---*+>)|(<script(?=[\s/>]))|</script(?=[\s/>])[^>]*+>?", re.I)
#: Tags that can stand in head; any other one ends a head left open, and so does text.
IN_HEAD = frozenset("html head title style script noscript template meta link base basefont bgsound noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table caption thead tbody tfoot tr td th section article "
    "header footer nav aside main form fieldset legend blockquote pre figure figcaption address hr details summary "
    "menu center option dialog hgroup search".split())
#: Their elements are closed by a slash.
FOREIGN = frozenset(("svg", "math"))
#: Opening a tag closes these open siblings, up to the container that bounds them.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select"})}


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...], int], ...]  # tag, words of its names, number of the element
    linked: int


def raw_end(page: str, tag: str, at: int, nested: bool) -> tuple[int, bool]:
    """Where the element ``tag`` whose body starts at ``at`` ends (the end of the page
    if it is never closed).  A script opened inside a script's comment hides one end
    tag; if that leaves the script open, the first end tag counts, here and (a false
    second result, passed on as ``nested``) in the rest of the page."""
    first = RAW_END[tag].search(page, at)
    if first is None:
        return len(page), nested
    if nested and tag == "script" and page.find("<!--", at, first.start()) >= 0:
        comment = inner = False
        for m in SCRIPT_MARK.finditer(page, at):
            opened, closed, script = m.groups()
            if opened:
                comment = True
            elif closed:
                comment = inner = False
            elif script:
                inner = comment
            elif not inner:
                return m.end(), nested
            else:
                inner = False
        nested = False
    return first.end(), nested


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    hidden = links = number = 0
    parts: list[str] = []
    linked = 0
    place: tuple = ()
    nested = True

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append(Block(text, place, min(linked, len(text))))
        parts, linked = [], 0

    def pop(n: int) -> None:
        nonlocal hidden, links
        while len(stack) > n:
            tag = stack.pop()[0]
            hidden -= tag in HIDDEN
            links -= tag == "a"

    tokens = TOKEN.finditer(page)
    while (m := next(tokens, None)) is not None:
        close, tag, attributes, text = m.groups()
        if text is not None:
            if stack and stack[-1][0] == "head" and text.strip(" \t\n\f\r"):
                pop(len(stack) - 1)
            if not hidden:
                if not parts:
                    place = tuple(stack)
                parts.append(text)
                if links:
                    linked += len(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if not close and tag not in IN_HEAD and stack and stack[-1][0] == "head":
            pop(len(stack) - 1)
        if tag == "head" and not close and stack and stack[-1][0] != "html":
            continue  # a head begins a page or is none
        block = tag in BLOCK
        if block:
            flush()
            if hidden and tag != "option":  # a list of choices left open ends where a block begins or ends
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "select":
                        pop(k)
                        break
                    if stack[k][0] in BLOCK and stack[k][0] != "option":
                        break
        if close:
            if tag == "br":
                parts.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if not block and stack[k][0] in BLOCK:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "img", "wbr") and parts:
                parts.append(" " if tag != "wbr" else "")
            continue
        if block:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if tag in IMPLIED:
            closes, bounds = IMPLIED[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closes:
                    pop(k)
                    break
                if stack[k][0] in bounds:
                    break
        if attributes.endswith("/") and (tag in FOREIGN or any(t in FOREIGN for t, _, _ in stack)):
            continue  # elsewhere a slash closes nothing
        if tag in RAW:
            end, nested = raw_end(page, tag, m.end(), nested)
            tokens = TOKEN.finditer(page, end)
            continue
        names = ()
        if "=" in attributes:
            names = tuple(sorted({w.lower() for _, a, b, c in ATTRIBUTE.findall(attributes) for w in NAME.findall(a or b or c)}))
        number += 1
        stack.append((tag, names, number))
        hidden += tag in HIDDEN
        links += tag == "a"
    flush()
    return out


def core_levels(page: list[Block]) -> list[int]:
    """How many levels above the core a block meets it (0: inside).  The core is found from the
    page down: the child that holds over half of the unlinked text, while it has two blocks."""
    free = [len(b.text) - b.linked for b in page]
    ids = [[n for t, _, n in b.path if t in BLOCK] for b in page]
    inside, core, depth = range(len(page)), [], 0
    while True:
        text: dict[int, int] = {}
        count: dict[int, int] = {}
        for i in inside:
            if len(ids[i]) > depth:
                n = ids[i][depth]
                text[n] = text.get(n, 0) + free[i]
                count[n] = count.get(n, 0) + 1
        best = max(text, key=text.__getitem__, default=None)
        if best is None or count[best] < 2 or 2 * text[best] <= sum(free[i] for i in inside):
            break
        core.append(best)
        inside = [i for i in inside if len(ids[i]) > depth and ids[i][depth] == best]
        depth += 1
    out = []
    for own in ids:
        same = 0
        while same < len(core) and same < len(own) and own[same] == core[same]:
            same += 1
        out.append(len(core) - same)
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Feature names of each block."""
    out = []
    n = len(page)
    levels = core_levels(page)
    whole = max(1, sum(len(b.text) - b.linked for b in page))
    around: dict[int, list[int]] = {}
    for b in page:
        for t, _, k in b.path:
            if t in BLOCK:
                sums = around.setdefault(k, [0, 0, 0])
                sums[0] += len(b.text)
                sums[1] += b.linked
                sums[2] += 1
    heading = next((i for i, b in enumerate(page) if any(t == "h1" for t, _, _ in b.path)), None)
    for i, b in enumerate(page):
        words = b.text.count(" ") + 1
        share = min(4, int(b.linked / max(1, len(b.text)) * 5))
        level = min(3, levels[i])
        f = {"bias", f"words:{min(7, int(math.log2(words)))}", f"linked:{share}",
             f"marks:{min(3, sum(map(b.text.count, '.!?')))}", f"core:{level}", f"core:{level}:{share}",
             "h1:" + ("none" if heading is None else "before" if i < heading else "after")}
        if b.text[-1] in ".!?:…\"'»”)":
            f.add("closed")
        if "©" in b.text or "®" in b.text:
            f.add("copyright")
        if i == 0:
            f.add("first")
        if i == n - 1:
            f.add("last")
        holders = [k for t, _, k in b.path if t in BLOCK]
        group = next((around[k] for k in reversed(holders) if around[k][2] > 1), None)
        if group:  # the smallest element that holds other blocks too
            f.add(f"group:{min(4, int(group[1] / max(1, group[0]) * 5))}")
            f.add(f"size:{min(4, int((group[0] - group[1]) / whole * 5))}")
        if b.path:
            f.add("in:" + next((t for t, _, _ in reversed(b.path) if t in BLOCK), "body"))
        for tag, names, _ in b.path:
            if tag in BLOCK and tag not in ("html", "body"):
                f.add("under:" + tag)
            f.update("name:" + w for w in names)
        out.append(sorted(f))
    return out


# --- the chain ------------------------------------------------------------------

@dataclass
class Chain:
    """Weights of label 1 against label 0, and scores of label changes."""

    weights: dict[str, float]
    change: np.ndarray  # [from, to]
    begin: np.ndarray

    def scores(self, feats: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in own) for own in feats]

    def best(self, feats: list[list[str]]) -> list[int]:
        """Viterbi; ties go to label 0."""
        s = self.scores(feats)
        if not s:
            return []
        (c00, c01), (c10, c11) = self.change.tolist()
        a0, a1 = self.begin.tolist()
        a1 += s[0]
        back = []
        for x in s[1:]:
            from0 = 1 if a1 + c10 > a0 + c00 else 0
            from1 = 1 if a1 + c11 > a0 + c01 else 0
            a0, a1 = max(a0 + c00, a1 + c10), max(a0 + c01, a1 + c11) + x
            back.append((from0, from1))
        label = 1 if a1 > a0 else 0
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, ridge: float = 1e-3) -> Chain:
    """Adaptive gradient ascent on the conditional log-likelihood, page by page."""
    index: dict[str, int] = {}
    data = [([np.array([index.setdefault(f, len(index)) for f in own]) for own in feats], np.array(labels))
            for feats, labels in pages if labels]
    w, gw = np.zeros(len(index)), np.full(len(index), 1e-2)
    c, gc = np.zeros((2, 2)), np.full((2, 2), 1e-2)
    b, gb = np.zeros(2), np.full(2, 1e-2)
    for _ in range(rounds):
        for feats, y in data:
            n = len(y)
            s = np.zeros((n, 2))
            s[:, 1] = [w[f].sum() for f in feats]
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = b + s[0]
            for i in range(1, n):
                fwd[i] = s[i] + np.logaddexp(fwd[i - 1, 0] + c[0], fwd[i - 1, 1] + c[1])
            for i in range(n - 2, -1, -1):
                z = s[i + 1] + bwd[i + 1]
                bwd[i] = np.logaddexp(c[:, 0] + z[0], c[:, 1] + z[1])
            total = np.logaddexp(*fwd[-1])
            p = np.exp(fwd + bwd - total)
            dc = np.zeros((2, 2))
            if n > 1:
                np.add.at(dc, (y[:-1], y[1:]), 1)
                dc -= np.exp(fwd[:-1, :, None] + c[None] + (s[1:] + bwd[1:])[:, None, :] - total).sum(0)
            db = np.eye(2)[y[0]] - p[0]
            for f, d in zip(feats, y - p[:, 1]):
                g = d - ridge * w[f]
                gw[f] += g * g
                w[f] += rate * g / np.sqrt(gw[f])
            gc += dc * dc
            c += rate * dc / np.sqrt(gc)
            gb += db * db
            b += rate * db / np.sqrt(gb)
    return Chain({f: float(w[i]) for f, i in index.items()}, c, b)


# --- labelled pages -------------------------------------------------------------

#: How an article is written, and in what it stands.
STYLES = ("paragraphs", "divs", "links", "table", "definitions", "preformatted", "single")
PLAIN = ("", "txt", "inner", "col", "box", "c1", "wrap", "left", "container")


def labelled_pages(count: int = 480, seed: int = 5, styles: tuple[str, ...] = STYLES) -> list[tuple[str, list[int]]]:
    """Pages composed by rule, with the label of each leaf block."""
    rng = random.Random(seed)
    return [_page(rng, styles) for _ in range(count)]


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(low, high)))


def _sentences(rng: random.Random, low: int, high: int) -> str:
    return " ".join(_words(rng, 3, 18).capitalize() + rng.choice("...!?") for _ in range(rng.randint(low, high)))


def _page(rng: random.Random, styles: tuple[str, ...]) -> tuple[str, list[int]]:
    style = rng.choice(styles) if rng.random() < 0.6 else "paragraphs" if "paragraphs" in styles else rng.choice(styles)
    parts: list[str] = []
    labels: list[int] = []

    def block(markup: str, label: int) -> None:
        parts.append(markup)
        labels.append(label)

    def links(n: int, label: int = 0, item: str = "li") -> None:
        for _ in range(n):
            block(f'<{item}><a href="/x">{_words(rng, 1, 4)}</a></{item}>', label)

    def inside(tag: str, name: str, fill) -> None:
        attribute = f' {rng.choice(("class", "id"))}="{name}"' if name else ""
        parts.append(f"<{tag}{attribute}>")
        fill()
        parts.append(f"</{tag}>")

    def menu() -> None:
        tag, name = rng.choice((("nav", ""), ("nav", "menu"), ("div", "nav"), ("div", "menu"), ("div", "topbar"),
                                ("ul", "navigation"), ("div", "breadcrumb")))
        inside(tag, name, lambda: inside("ul", "", lambda: links(rng.randint(2, 8))) if tag != "ul" else links(rng.randint(2, 6)))

    def noise(kind: str) -> None:
        if kind == "ad":
            tag, name = rng.choice((("div", "ad"), ("div", "ads"), ("div", "advert"), ("aside", "sponsored"), ("div", "promo banner"),
                                    ("div", "advertisement")))
            inside(tag, name, lambda: block(rng.choice(("{}", "<p>{}</p>")).format(_sentences(rng, 1, 3)), 0))
        elif kind == "notice":
            tag, name = rng.choice((("div", "cookie notice"), ("div", "consent"), ("div", "alert"), ("section", "gdpr-banner"),
                                    ("div", "notice"), ("div", "subscribe-popup")))
            inside(tag, name, lambda: [block(f"<p>{_sentences(rng, 1, 3)}</p>", 0) for _ in range(rng.randint(1, 2))])
        elif kind == "sidebar":
            tag, name = rng.choice((("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "related"), ("div", "widget")))

            def fill():
                block(f"<h3>{_words(rng, 1, 4)}</h3>", 0)
                if rng.random() < 0.5:
                    block(f"<p>{_sentences(rng, 1, 3)}</p>", 0)
                inside("ul", "", lambda: links(rng.randint(1, 5)))
            inside(tag, name, fill)
        elif kind == "form":
            tag = rng.choice(("form", "div"))

            def fill():
                block(f"<p>{_words(rng, 2, 8)}</p>", 0)
                if tag == "form" and rng.random() < 0.5:
                    block(f"<div><label>{_words(rng, 1, 2)}</label><input name=q><button>{_words(rng, 1, 2)}</button></div>", 0)
            inside(tag, rng.choice(("search", "login", "newsletter", "signup")) if tag == "div" else "", fill)
        elif kind == "comments":
            tag, name = rng.choice((("div", "comments"), ("section", "comments"), ("div", "comment-list"), ("ol", "commentlist"),
                                    ("div", "disqus thread"), ("section", "responses")))
            inner = "li" if tag == "ol" else rng.choice(("div", "p", "article"))
            inside(tag, name, lambda: [inside(inner, "comment" if inner != "p" else "", lambda: block(
                _sentences(rng, 1, 4), 0)) for _ in range(rng.randint(1, 4))])

    def paragraph() -> None:
        if style == "divs":
            block(rng.choice(("<div>{}</div>", "<div class=x>{}</div>", "<div>{}<br>")).format(_sentences(rng, 1, 6)), 1)
            if parts[-1].endswith("<br>"):
                parts.append("</div>")
        else:
            block(rng.choice(("<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<p><b>{}<br>", "<p><em>{}</em></p>"))
                  .format(_words(rng, 1, 5) + "." if rng.random() < 0.15 else _sentences(rng, 1, 7)), 1)

    def special() -> None:
        if style == "links":
            inside("ul", "", lambda: [block(f'<li><a href="/z">{_words(rng, 1, 9)}</a>{rng.choice(("", " " + _words(rng, 1, 6)))}</li>', 1)
                                      for _ in range(rng.randint(2, 6))])
        elif style == "table":
            inside("table", "", lambda: [[parts.append("<tr>"), [block(f"<{t}>{_words(rng, 1, 5)}</{t}>", 1) for t in ("th", "td", "td")],
                                          parts.append("</tr>")] for _ in range(rng.randint(2, 5))])
        elif style == "definitions":
            inside("dl", "", lambda: [[block(f"<dt>{_words(rng, 1, 3)}</dt>", 1), block(f"<dd>{_words(rng, 2, 12)}</dd>", 1)]
                                      for _ in range(rng.randint(2, 5))])
        elif style == "preformatted":
            block(f"<pre>{_words(rng, 2, 8)}\n  {_words(rng, 2, 30)}</pre>", 1)
        else:
            paragraph()

    def article() -> None:
        def fill():
            if style == "single":
                block(rng.choice(("<p>{}</p>", "<pre>{}</pre>", "{}", "<div>{}</div>")).format(
                    rng.choice((_words(rng, 2, 9), _sentences(rng, 1, 2)))), 1)
                return
            if rng.random() < 0.85:
                block(f"<h1>{_words(rng, 2, 12)}</h1>", 1)
            for _ in range(rng.randint(1, 9)):
                k = rng.random()
                if k < 0.18:
                    special()
                elif k < 0.68:
                    paragraph()
                elif k < 0.78:
                    block(f"<h2>{_words(rng, 1, 8)}</h2>", 1)
                elif k < 0.88:
                    inside("ul", "", lambda: [block(f"<li>{_words(rng, 1, 12)}</li>", 1) for _ in range(rng.randint(2, 4))])
                elif k < 0.94:
                    inside("blockquote", "", lambda: block(f"<p>{_sentences(rng, 1, 2)}</p>", 1))
                else:
                    block(f'<p>{_sentences(rng, 1, 2)} <a href="/y">{_words(rng, 1, 3)}</a> {_sentences(rng, 1, 2)}</p>', 1)
                if rng.random() < 0.06:
                    noise("ad")
        named = (("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article body"),
                 ("div", "entry-content"), ("section", "story"), ("div", "post"), ("div", "main text"))
        # one block tells by its container only; longer articles also stand in containers that tell nothing
        tag, name = rng.choice(named) if style == "single" or rng.random() < 0.65 else ("div", rng.choice(PLAIN))
        inside(tag, name, fill)

    bare = rng.random() < (0.5 if style == "single" else 0.15)  # no header, menu or footer
    alone = bare and rng.random() < 0.5  # nothing else at all
    parts.append('<!DOCTYPE html><html lang="xx"><head><meta charset="utf-8"><title>t</title><style>p{a:b}</style>'
                 '<script>var t="</p>";</script></head><body>')
    if not bare and rng.random() < 0.35:
        inside(*rng.choice((("header", ""), ("header", "site-header"), ("div", "header"))),
               lambda: (block(f"<div>{_words(rng, 1, 4)}</div>", 0), menu() if rng.random() < 0.5 else None))
    if not bare and rng.random() < 0.9:
        menu()
    for kind in ("notice", "ad", "form"):
        if not alone and rng.random() < (0.6 if kind == "ad" else 0.25):
            noise(kind)
    before = not alone and rng.random() < 0.3
    if before:
        noise("sidebar")
    wrapper = rng.random() < 0.3
    if wrapper:
        parts.append(rng.choice(('<div class="wrapper">', '<div id="page">', "<div>", '<main id="main">', "<div id=wrap>", "<div class=outer>")))
    article()
    for kind in ("ad", "comments", "form", "notice"):
        if not alone and rng.random() < 0.25:
            noise(kind)
    if wrapper:
        parts.append("</div>")
    if not before and not alone and rng.random() < 0.3:
        noise("sidebar")
    if not bare and rng.random() < 0.9:
        tag, name = rng.choice((("footer", ""), ("footer", ""), ("footer", "site-footer"), ("div", "footer")))
        inside(tag, name, lambda: (block(f"<p>{rng.choice(('&copy; ', ''))}{_sentences(rng, 1, 3)}</p>" if rng.random() < 0.5 else
                                         f"{rng.choice(('&copy; ', ''))}{_sentences(rng, 1, 3)}", 0),
                                   links(rng.randint(1, 4), item="div") if rng.random() < 0.3 else None))
    if rng.random() < 0.8:
        parts.append("</body></html>")
    return "".join(parts), labels


def fitted(count: int = 480, seed: int = 5, styles: tuple[str, ...] = STYLES) -> Chain:
    """The chain trained on the labelled pages (a few seconds, on the driver)."""
    data = []
    for page, labels in labelled_pages(count, seed, styles):
        got = blocks(page)
        if len(got) != len(labels):
            raise AssertionError("a labelled page parses into other blocks")
        data.append((features(got), labels))
    return train(data)


def main_text(page: str, chain: Chain) -> tuple[str, int, int]:
    """(text, blocks, blocks kept) of one page."""
    got = blocks(page)
    labels = chain.best(features(got))
    kept = [b.text for b, y in zip(got, labels) if y]
    return "\n\n".join(kept), len(got), len(kept)


def extracted(pages: DataFrame, chain: Chain, html_col: str = "html", result: str = "main",
              carry_html: bool = True) -> DataFrame:
    """``pages`` with the struct column ``result``: ``text``, ``n_blocks`` and ``n_kept``."""
    fields = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_blocks", T.IntegerType()),
                           T.StructField("n_kept", T.IntegerType())])

    def make():
        def work(texts):
            rows = [main_text(t.as_py().decode("utf-8", "replace"), chain) for t in texts]
            return {f.name: [r[i] for r in rows] for i, f in enumerate(fields)}
        return work

    return map_texts(pages, html_col, result, fields, make, carry_html)
