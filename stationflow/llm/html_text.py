"""Main text of HTML pages: a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: Elements that end an open element of the second list, as far up as the third.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Words in class, id and role that hint at what an element is.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar toc skip",
    "header": "header masthead banner topbar logo brand sitename hero",
    "footer": "footer foot copyright contentinfo legal colophon bottom",
    "side": "sidebar side aside widget rail complementary secondary related recommended popular trending more tags categories archive author bio",
    "notice": "notice cookie cookies consent gdpr alert warning message popup modal overlay announcement paywall disclaimer notification toast",
    "ad": "ad ads advert adverts advertisement adsbygoogle sponsor sponsored promo promotion promoted affiliate dfp banner-ad",
    "form": "form newsletter subscribe subscription signup login search contact register field",
    "comment": "comment comments commentlist reply replies respond discussion disqus feedback review reviews thread",
    "share": "share sharing social follow buttons button like tweet print meta byline dateline timestamp",
    "text": "article post entry content main story text prose body page-content articlebody post-body entry-content",
}
_HINT = {w: k for k, words in HINTS.items() for w in words.split()}
ANCESTORS = frozenset("nav header footer aside article main section form table ul ol dl blockquote figure pre fieldset details dialog select button body".split())
CUES = re.compile(r"cookie|subscribe|sign up|newsletter|all rights reserved|copyright|©|advertis|sponsor|log in|reply|read more|share", re.I)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]+|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))?|["'])*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
_SPLIT = re.compile(r"[^a-z0-9]+")


class Block:
    """A leaf block: its text, the characters of it in links, its tag, and what lies above it."""

    __slots__ = ("hidden", "hints", "linked", "tag", "tags", "text")

    def __init__(self, text: str, linked: int, tag: str, tags: frozenset, hints: frozenset, hidden: bool):
        self.text, self.linked, self.tag, self.tags, self.hints, self.hidden = text, linked, tag, tags, hints, hidden


def _hints(attributes: str) -> tuple[frozenset, bool]:
    found, hidden = set(), False
    for name, a, b, c in _ATTR.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "")
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden = hidden or value == "true"
        else:
            for w in value.split():
                found.update(_HINT[x] for x in [w, *_SPLIT.split(w)] if x in _HINT)
    return frozenset(found), hidden


class _Open:
    """The open elements: (tag, ancestor tags, hints, hidden) each, and where in the stack each tag and the blocks are."""

    def __init__(self):
        none = frozenset()
        self.stack = [("", none, none, False)]
        self.blocks, self.at = [0], {}

    def push(self, tag: str, tags: frozenset, hints: frozenset, hidden: bool) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, tags, hints, hidden))

    def last(self, tags) -> int:
        """Place of the innermost open element of ``tags``; 0 if there is none."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)

    def cut(self, k: int) -> None:
        """Close the element at place ``k`` and all within it."""
        while len(self.stack) > k:
            tag = self.stack.pop()[0]
            self.at[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of text in page order; raw text elements and comments are left out.

    Open elements are kept on a stack; what HTML closes by itself (p, li, td and the like) is closed here too. Time
    grows with the page alone, however many elements are left open.
    """
    blocks: list[Block] = []
    open_ = _Open()
    parts: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        if not parts:
            return
        text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
        if text:
            tag, tags, hints, hidden = open_.stack[open_.blocks[-1]]
            linked = len(" ".join("".join(t for t, link in parts if link).split()))
            blocks.append(Block(text, linked, tag, tags, hints, hidden))
        parts.clear()

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        m = _TAG.match(page, start) if start >= 0 else None
        if start < 0:
            parts.append((page[at:], links > 0))
            break
        if m is None:  # a lone <
            parts.append((page[at : start + 1], links > 0))
            at = start + 1
            continue
        if start > at:
            parts.append((page[at:start], links > 0))
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if not m[1]:
            if tag in RAW:
                close = _RAW_END[tag].search(page, at)
                at = (page.find(">", close.start()) + 1 or end) if close else end
                if tag not in ("svg", "math"):
                    flush()
                continue
            if tag in INLINE or tag in VOID:
                if tag == "a":
                    links += 1
                elif tag not in INLINE or tag == "br":
                    parts.append((" ", False)) if tag == "br" else flush()
                if tag in VOID or tag == "img":
                    continue
            else:
                flush()
                links = 0
                if open_.stack[open_.blocks[-1]][0] == "p":  # a block ends the paragraph that is open around it, and what is open inside that
                    open_.cut(open_.blocks[-1])
                if tag in CLOSES:
                    ends, limits = CLOSES[tag]
                    k = open_.last(ends)
                    if k > open_.last(limits):
                        open_.cut(k)
            _, tags, hints, hidden = open_.stack[-1]
            if m[3]:
                more, off = _hints(m[3])
                hints, hidden = hints | more if more else hints, hidden or off
            if tag in ANCESTORS and tag not in tags:
                tags = tags | {tag}
            open_.push(tag, tags, hints, hidden)
        else:
            if tag not in INLINE:
                flush()
                links = 0
            elif tag == "a":
                links = max(0, links - 1)
            k = open_.last((tag,))
            if k and (tag not in INLINE or k > open_.blocks[-1]):
                open_.cut(k)
    flush()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    """Ancestor-tag and text features of each block.

    Whether a block lies outside of the article's container, and whether it is the first or last one there, counts only on a page that has one.
    """
    out = []
    inside = [bool(b.tags & {"article", "main"}) or "text" in b.hints for b in blocks]
    contained = any(inside)
    n = len(blocks)
    for k, b in enumerate(blocks):
        size = len(b.text)
        f = ["bias", "tag:" + b.tag]
        f += ["in:" + t for t in b.tags]
        f += ["is:" + h for h in b.hints]
        f.append(f"len:{min(size.bit_length(), 11)}")
        f.append(f"link:{round(4 * b.linked / size)}")
        f.append("stop" if b.text[-1] in ".!?\"'”»…" else "nostop")
        if CUES.search(b.text):
            f.append("cue")
        if b.hidden:
            f.append("hidden")
        if contained and not inside[k]:
            f.append("outside")
            if k == 0:
                f.append("first")
            if k == n - 1:
                f.append("last")
        if b.linked == size and not inside[k]:
            f.append("alllink")
        out.append(f)
    return out


class ChainCRF:
    """Two labels (0 boilerplate, 1 text), feature weights and label transitions."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.moves = np.zeros((2, 2))

    def _scores(self, feats: list[list[str]]) -> np.ndarray:
        zero = np.zeros(2)
        return np.array([sum((self.weights.get(f, zero) for f in fs), zero) for fs in feats])

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 6, rate: float = 0.5, l2: float = 1e-4, seed: int = 1) -> ChainCRF:
        """Gradient steps on the conditional likelihood, page by page, with adaptive rates."""
        rng = np.random.default_rng(seed)
        for feats, _ in pages:
            for fs in feats:
                for f in fs:
                    self.weights.setdefault(f, np.zeros(2))
        past = {f: np.full(2, 1e-2) for f in self.weights}
        past_moves = np.full((2, 2), 1e-2)
        for _ in range(rounds):
            for k in rng.permutation(len(pages)):
                feats, labels = pages[k]
                s, n = self._scores(feats), len(labels)
                ahead, back = s.copy(), np.zeros((n, 2))
                for t in range(1, n):
                    ahead[t] += np.logaddexp(ahead[t - 1, 0] + self.moves[0], ahead[t - 1, 1] + self.moves[1])
                for t in range(n - 2, -1, -1):
                    x = s[t + 1] + back[t + 1]
                    back[t] = np.logaddexp(self.moves[:, 0] + x[0], self.moves[:, 1] + x[1])
                total = np.logaddexp(*ahead[-1])
                gain = -np.exp(ahead + back - total)
                gain[np.arange(n), labels] += 1
                moved = np.zeros((2, 2))
                for t in range(1, n):
                    moved -= np.exp(ahead[t - 1][:, None] + self.moves + (s[t] + back[t])[None, :] - total)
                    moved[labels[t - 1], labels[t]] += 1
                past_moves += moved**2
                self.moves += rate * moved / np.sqrt(past_moves)
                for fs, g in zip(feats, gain, strict=True):
                    if abs(g[0]) < 1e-4:
                        continue
                    for f in fs:
                        h = g - l2 * self.weights[f]
                        past[f] += h**2
                        self.weights[f] = self.weights[f] + rate * h / np.sqrt(past[f])
        return self

    def compact(self) -> tuple[dict[str, float], list[list[float]]]:
        """Score of label 1 over label 0 by feature, and the moves."""
        return {f: float(w[1] - w[0]) for f, w in self.weights.items()}, self.moves.tolist()


def viterbi(gain: list[float], moves: list[list[float]]) -> list[int]:
    """The most likely labels, given the score of label 1 over label 0 at each place."""
    if not gain:
        return []
    (m00, m01), (m10, m11) = moves
    a, b, back = 0.0, gain[0], []
    for g in gain[1:]:
        from0, from1 = (0, a + m00) if a + m00 >= b + m10 else (1, b + m10), (0, a + m01) if a + m01 > b + m11 else (1, b + m11)
        back.append((from0[0], from1[0]))
        a, b = from0[1], from1[1] + g
    label = int(b > a)
    out = [label]
    for pair in reversed(back):
        label = pair[label]
        out.append(label)
    return out[::-1]


def labelled_pages(n: int, seed: int = 2) -> Iterator[tuple[str, list[int]]]:
    """Labelled pages: page layouts filled with random words, and the label of each leaf block.

    Every layout mixes an article with menus, headers, footers, sidebars, notices, adverts, forms
    and reader comments in varying marks, order, length and nesting.
    """
    rng = np.random.default_rng(seed)
    sounds = "ba be bi bo da de di do fa ka ke la le lo ma me mi na ne no pa ra re ri ro sa se si so ta te ti to va za".split()

    def pick(x):
        return x[rng.integers(len(x))]

    def word():
        return "".join(pick(sounds) for _ in range(rng.integers(1, 5)))

    def prose(low, high):
        text = " ".join(word() for _ in range(rng.integers(low, high)))
        return (text.capitalize() + pick([".", ".", ".", "", "!", "?"])).replace(" ", ", ", rng.integers(0, 2))

    def links(k):
        return "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k)), [0] * k

    def wrap(options, inner):
        tag, attr = pick(options)
        return f"<{tag}{attr}>{inner}</{tag}>"

    def menu():
        inner, labels = links(rng.integers(2, 8))
        return wrap([("nav", ""), ("nav", ' class="menu"'), ("div", ' class="main-nav"'), ("div", ' id="menu"'), ("header", ""), ("div", ' role="navigation"'), ("div", ' class="breadcrumbs"')], f"<ul>{inner}</ul>"), labels

    def header():
        k = rng.integers(0, 2)
        return wrap([("header", ""), ("div", ' class="site-header"'), ("div", ' id="masthead"'), ("header", ' class="banner"')], f"<h2>{prose(1, 6)}</h2>" + f"<p>{prose(2, 12)}</p>" * k), [0] * (1 + k)

    def footer():
        text = pick(["&copy; ", "Copyright ", ""]) + f"{word()}.example.com &middot; " + prose(2, 25)
        return wrap([("footer", ""), ("div", ' class="footer"'), ("div", ' id="footer"'), ("footer", ' class="site-footer"')], pick([text, f"<p>{text}</p>"])), [0]

    def side():
        k = rng.integers(1, 4)
        body = "".join(f"<p>{prose(2, 60)}</p>" for _ in range(k))
        return wrap([("aside", ""), ("div", ' class="sidebar"'), ("aside", ' class="widget"'), ("div", ' id="sidebar"'), ("section", ' class="related"'), ("div", ' class="side-bar"')], f"<h3>{prose(1, 4)}</h3>" + body), [0] * (k + 1)

    def notice():
        text = pick(["We use cookies. ", "", "", "Notice: "]) + prose(3, 50)
        return wrap([("div", ' class="cookie-notice"'), ("div", ' class="notice"'), ("p", ' class="notice"'), ("div", ' role="alert"'), ("section", ' class="alert"'), ("div", ' id="consent"'), ("dialog", "")], text), [0]

    def advert():
        return wrap([("div", ' class="ad"'), ("div", ' class="ads"'), ("p", ' class="ad"'), ("aside", ' class="advert"'), ("div", ' class="sponsored"'), ("div", ' id="ad-1"'), ("ins", ' class="adsbygoogle"')][:6], pick([prose(2, 60), f"<p>{prose(2, 60)}</p>", f'<a href="#">{prose(2, 9)}</a>'])), [0]

    def form():
        k = rng.integers(1, 3)
        return wrap([("form", ""), ("form", ' class="newsletter"'), ("div", ' class="subscribe"'), ("form", ' action="/search"')], "".join(f"<p>{prose(1, 12)}</p>" for _ in range(k)) + '<label>' + prose(1, 4) + '</label> <input type="text"><button>' + word() + "</button>"), [0] * (k + 2)

    def comments():
        k = rng.integers(1, 6)
        body = "".join(pick([f'<div class="comment"><p>{prose(2, 70)}</p></div>', f"<li>{prose(2, 70)}</li>", f"<p>{prose(2, 70)}</p>", f"<article><p>{prose(3, 70)}</p></article>"]) for _ in range(k))
        return wrap([("section", ' class="comments"'), ("div", ' id="comments"'), ("div", ' class="comment-list"'), ("section", ' id="comments"'), ("div", ' class="reader-comments"')], f"<h3>{prose(1, 3)}</h3>" + body), [0] * (k + 1)

    def passage():
        cue = pick(["share", "reply", "cookies", "subscribe", "copyright", "advertising", "read more", "log in"]) if rng.random() < 0.15 else word()  # such words are no proof
        return " ".join([prose(3, 24) for _ in range(rng.integers(1, pick([2, 4, 9])))] + [f"{word()} {cue} {prose(2, 12)}"] * int(rng.random() < 0.3))

    def text(alone):
        body, labels = [], []
        leaf = pick(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<p class=\"a1\">{}", "<section>{}</section>"])
        if rng.random() < 0.5:
            body.append(pick(["<h1>{}</h1>", "<h1>{}</h1>", "<h2>{}</h2>", "<header><h1>{}</h1></header>"]).format(prose(2, 14)))
            labels.append(1)
        for _ in range(rng.integers(1, pick([3, 6, 12]))):
            kind = rng.integers(0, 18)
            if kind == 0:
                body.append(pick(["<h2>{}</h2>", "<h3>{}</h3>"]).format(prose(1, 8)))
                labels.append(1)
            elif kind == 1:
                k = rng.integers(2, 5)
                body.append(pick(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{prose(1, 20)}</li>" for _ in range(k))))
                labels += [1] * k
            elif kind == 2:
                body.append(f"<blockquote><p>{prose(3, 40)}</p></blockquote>")
                labels.append(1)
            elif kind == 3:
                body.append(f'<p><b>{prose(1, 5)}</b> {prose(1, 40)} <a href="#">{prose(1, 8)}</a><br></p>')
                labels.append(1)
            elif kind == 4:
                body.append(f"<table><tr><td>{prose(1, 6)}</td><td>{prose(1, 6)}</td></tr></table>")
                labels += [1, 1]
            elif kind == 5:
                body.append(f"<pre>{prose(2, 30)}</pre>")
                labels.append(1)
            elif kind == 6:
                k = rng.integers(1, 5)
                body.append("<ul>" + "".join(f'<li><a href="#">{prose(1, 9)}</a></li>' for _ in range(k)) + "</ul>" if not alone else f"<dl><dt>{word()}</dt><dd>{prose(2, 20)}</dd></dl>")
                labels += [1] * (k if not alone else 2)
            elif kind == 7:
                body.append(leaf.format(f'{word().capitalize()} <a href="#">{prose(2, 14)}</a>'))
                labels.append(1)
            else:
                body.append(leaf.format(passage()))
                labels.append(1)
            if rng.random() < 0.06:
                piece, l = pick([advert, notice, side, form, menu])()
                body.append(piece)
                labels += l
        if rng.random() < 0.12:
            piece, l = comments()
            body.append(piece)
            labels += l
        inner = "".join(body)
        if alone:  # nothing says where the article is
            return pick(["<div>{}</div>", "{}", "<div><div>{}</div></div>", "<section>{}</section>", "<div class=\"c7\">{}</div>"]).format(inner), labels
        kinds = [("article", ""), ("article", ""), ("main", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="content"'), ("div", ' class="post"'), ("article", ' class="entry"'), ("div", ' class="story-body"')]
        return (f"<main>{wrap(kinds, inner)}</main>" if rng.random() < 0.2 else wrap(kinds, inner)), labels

    for _ in range(n):
        bare = rng.random() < 0.35  # an article and nothing else
        before = [p() for p in (menu, header, notice, advert, form, side) if not bare and rng.random() < 0.4]
        after = [p() for p in (side, comments, form, advert, menu, notice) if not bare and rng.random() < 0.35]
        rng.shuffle(before)
        rng.shuffle(after)
        pieces = [*before, (passage(), [1]) if bare and rng.random() < 0.15 else text(rng.random() < 0.35), *after]
        if not bare and rng.random() < 0.8:
            pieces.append(footer())
        body = "".join(p for p, _ in pieces)
        labels = [x for _, l in pieces for x in l]
        yield pick(["<!DOCTYPE html><html><head><title>{0}</title><script>var a = '<p>';</script></head><body>{1}</body></html>", "<!DOCTYPE html><html><head><title>{0}</title></head><body>{1}</body></html>", "{1}"]).format(prose(1, 8), body), labels


@lru_cache(maxsize=4)
def train(pages: int = 500, seed: int = 2) -> tuple[dict[str, float], list[list[float]]]:
    """Fit on ``pages`` labelled pages: a fixed number, whatever the input, once in a process."""
    rows = []
    for page, labels in labelled_pages(pages, seed):
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise AssertionError("a labelled page was parsed into other blocks")
        rows.append((features(blocks), labels))
    return ChainCRF().fit(rows).compact()


def main_text(page: str, model: tuple[dict[str, float], list[list[float]]]) -> str:
    weights, moves = model
    blocks = leaf_blocks(page)
    gain = [sum(weights.get(f, 0.0) for f in fs) for fs in features(blocks)]
    return "\n\n".join(b.text for b, label in zip(blocks, viterbi(gain, moves), strict=True) if label)


def extract_text(pages: DataFrame, training_pages: int = 500) -> DataFrame:
    """Add text, the main text of each page, to the columns of ``pages`` (html and any others).

    A page is cut into leaf blocks; a linear-chain conditional random field labels them
    by ancestor tags, class and id hints, and text features, decoded by Viterbi. Blocks
    labelled as text are joined by an empty line; white space within a block becomes one space and
    character references are decoded. The field is trained on ``training_pages`` labelled pages.

    Null, empty or blank html: empty text. Nulls elsewhere pass through. Repeated rows: same text.
    Ties between labels count as boilerplate. Pages cut off in the middle are read up to there. Empty table: no
    rows. A column named text is replaced. Pages of any length are read whole.
    """
    rows = pages.select(*[c for c in pages.columns if c != "text"])
    shared = pages.sparkSession.sparkContext.broadcast(train(training_pages))  # some hundred weights

    @F.pandas_udf("string")
    def extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for s in pages:
            yield pd.Series([main_text(x, model) if x else "" for x in s])

    return rows.withColumn("text", extract("html"))
