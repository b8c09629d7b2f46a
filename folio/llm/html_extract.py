"""HTML main text by a recurrent block labeller."""

from __future__ import annotations

import random
import re
import zlib
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose text stands inside a line, elements without content, and elements whose content is no text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript head title iframe svg canvas object select option textarea".split())
#: A start tag here ends an open paragraph or item of its kind.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Start tags that an open head holds; start tags at which an element without an end tag whose content is no text ends.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
BLOCK = ENDS_P | frozenset("body caption dd dt figcaption legend li summary tbody td tfoot th thead tr".split())
_SPACE = re.compile(r"\s+")
#: What the heading of reader comments says, and words of notices.
_REPLIES = re.compile(r"^\W*(\d+\s+)?(reader\s+)?(comments?|replies|responses|discussion|leave a (reply|comment))\b", re.I)
_NOTICE = re.compile(r"\b(cookies?|consent|newsletter|gdpr|privacy)\b", re.I)

PATH_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 96, 32, 10, 16
INPUT = PATH_DIM + WORD_DIM + SHAPE_DIM
#: Blocks of pages that are labelled side by side.
PAGES, STEPS = 64, 4096


class _Silent(HTMLParser):
    """Numbers of the silent elements, in order of their start tags, that have no end tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.n, self.waiting = 0, {t: [] for t in SILENT}

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.waiting[tag].append(self.n)
            self.n += 1

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if self.waiting.get(tag):
            self.waiting[tag].pop()


class _Leaves(HTMLParser):
    """The leaf sequence of a page: (tag path, text, share of it in links) of each run of text between block boundaries.

    An open head ends at whatever a head can't hold, a silent element without an end tag at the next block.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html, self.never, self.seen = html, None, 0
        self.path, self.parts, self.leaves, self.silent, self.links, self.linked = [], [], [], 0, 0, 0

    def _unclosed(self, at) -> bool:
        if self.never is None:
            p = _Silent()
            p.feed(self.html)
            p.close()
            self.never = {n for left in p.waiting.values() for n in left}
        return self.path[at][2] in self.never

    def _end_silent(self, tag):
        silent = [at for at, (t, _, _) in enumerate(self.path) if t in SILENT]
        head = next((at for at in silent if self.path[at][0] == "head"), None)
        if head is not None and tag not in HEAD and all(self._unclosed(at) for at in silent if at > head):
            self._close(head)
        elif tag in BLOCK:
            at = next((at for at in silent if at != head and self._unclosed(at)), None)
            if at is not None:
                self._close(at)

    def flush(self):
        text = _SPACE.sub(" ", "".join(self.parts)).strip(" ")
        if text:
            self.leaves.append((tuple(p for _, p, _ in self.path), text, min(1.0, self.linked / len(text))))
        self.parts, self.linked = [], 0

    def _close(self, at):
        if any(t not in INLINE for t, *_ in self.path[at:]):
            self.flush()
        self.silent -= sum(t in SILENT for t, *_ in self.path[at:])
        self.links -= sum(t == "a" for t, *_ in self.path[at:])
        del self.path[at:]

    def handle_starttag(self, tag, attrs):
        if self.silent:
            self._end_silent(tag)
        if tag not in INLINE:
            self.flush()
        if tag in ENDS_P or tag == "li":
            kind = "li" if tag == "li" else "p"
            for at in range(len(self.path) - 1, -1, -1):
                t = self.path[at][0]
                if t == kind:
                    self._close(at)
                    break
                if t not in INLINE:
                    break
        if tag in VOID:
            return
        names = [v for k, v in attrs if k in ("class", "id", "role") and v]
        marks = re.findall(r"[a-z]+", " ".join(names).lower())
        self.path.append((tag, (tag, *marks), self.seen))
        self.links += tag == "a"
        if tag in SILENT:
            self.silent += 1
            self.seen += 1

    def handle_startendtag(self, tag, attrs):
        if self.silent:
            self._end_silent(tag)
        if tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag):
        for at in range(len(self.path) - 1, -1, -1):
            if self.path[at][0] == tag:
                self._close(at)
                return
        if tag not in INLINE:
            self.flush()

    def handle_data(self, data):
        if self.silent and self.path[-1][0] == "head" and data.strip(" \t\n\f\r"):
            self._close(len(self.path) - 1)
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def leaves(html: str) -> list[tuple[tuple, str, float]]:
    p = _Leaves(html)
    p.feed(html)
    p.close()
    p.flush()
    return p.leaves


@lru_cache(1 << 16)
def _slot(word: str, dim: int) -> int:
    return zlib.crc32(word.encode()) % dim


def vectors(page: list[tuple[tuple, str, float]]) -> np.ndarray:
    """Inputs of a leaf sequence: hashed tag path with its classes, hashed words, and the text's shape."""
    x = np.zeros((len(page), INPUT), np.float32)
    paths: dict[tuple, np.ndarray] = {}
    for i, (path, text, linked) in enumerate(page):
        if path not in paths:
            v = np.zeros(PATH_DIM, np.float32)
            for marks in path:
                for j, m in enumerate(marks):
                    v[_slot(("." if j else "") + m, PATH_DIM)] += 1
            if path:
                v[_slot("leaf:" + path[-1][0], PATH_DIM)] += 1
            paths[path] = v
        x[i, :PATH_DIM] = paths[path]
        words = text.split(" ")
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount([_slot(w.lower(), WORD_DIM) for w in words], minlength=WORD_DIM) / len(words) ** 0.5
        shape = (min(len(words), 60) / 30, text[-1] in ".!?", "©" in text, len(path) / 8, i / max(1, len(page) - 1), len(words) < 4, linked, min(len(page), 100) / 50, len(words) < 6 and bool(_REPLIES.match(text)), bool(_NOTICE.search(text)))
        x[i, PATH_DIM + WORD_DIM :] = shape
    return np.clip(x, 0, 3)


def _sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class Labeller:
    """A bidirectional LSTM over the leaf sequence with a logistic output per block, in numpy."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        scale = (INPUT + HIDDEN) ** -0.5
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = rng.normal(0, scale, (INPUT + HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p["V"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
        self.p["v0"] = np.zeros(1, np.float32)

    def _run(self, x, mask, d, keep):
        """States of one direction over x (time, pages, inputs); where the mask is 0 the state stays."""
        n = x.shape[1]
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, trace = np.zeros((len(x), n, HIDDEN), np.float32), []
        w, b = self.p[f"W{d}"], self.p[f"c{d}"]
        fed = x @ w[:INPUT] + b
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = fed[t] + h @ w[INPUT:]
            i, f, o = (_sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            th = np.tanh(new)
            if keep:
                trace.append((t, h, c, i, f, o, g, th, m))
            h, c = m * (o * th) + (1 - m) * h, m * new + (1 - m) * c
            out[t] = h
        return out, trace

    def score(self, x, mask):
        hf, hb = self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0]
        return np.concatenate([hf, hb], 2) @ self.p["V"] + self.p["v0"]

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, top: float = 0.02, seed: int = 4):
        """Adam on the logistic loss, back through time over whole pages, in steps that become smaller."""
        rng = np.random.default_rng(seed)
        first, second, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            order, rate = rng.permutation(len(pages)), top * (1 - 0.95 * epoch / epochs)
            for at in range(0, len(order), 32):
                x, mask, y = padded([pages[i][0] for i in order[at : at + 32]], [pages[i][1] for i in order[at : at + 32]])
                grads = self._gradients(x, mask, y)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def _gradients(self, x, mask, y):
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        delta = (_sigmoid(both @ self.p["V"] + self.p["v0"]) - y) * mask / mask.sum()
        grads = {"V": np.tensordot(delta, both, ([0, 1], [0, 1])), "v0": np.array([delta.sum()])}
        for k, d in enumerate("fb"):
            w = self.p[f"W{d}"]
            gw, gb = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, th, m in reversed(runs[d][1]):
                dh = dh + delta[t][:, None] * self.p["V"][k * HIDDEN : (k + 1) * HIDDEN]
                live = m * dh
                dnew = m * dc + live * o * (1 - th * th)
                da = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * th * o * (1 - o), dnew * i * (1 - g * g)], 1)
                gw[:INPUT] += x[t].T @ da
                gw[INPUT:] += h.T @ da
                gb += da.sum(0)
                dh, dc = (1 - m) * dh + da @ w[INPUT:].T, (1 - m) * dc + dnew * f
            grads[f"W{d}"], grads[f"c{d}"] = gw, gb
        return grads


def padded(xs, ys=None):
    n, top = len(xs), max(len(x) for x in xs)
    x, mask, y = np.zeros((top, n, INPUT), np.float32), np.zeros((top, n), np.float32), np.zeros((top, n), np.float32)
    for i, v in enumerate(xs):
        x[: len(v), i], mask[: len(v), i] = v, 1
        if ys is not None:
            y[: len(v), i] = ys[i]
    return x, mask, y


def _words(rng, n):
    sounds = ["an", "ter", "lo", "mi", "ra", "su", "en", "tion", "ge", "pol", "vi", "es", "o", "kar", "th", "and", "de", "la", "ung"]
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randint(1, 4))) for _ in range(n))


def _sentences(rng, least, most):
    return " ".join(_words(rng, rng.randint(3, 14)).capitalize() + rng.choice(".....!?") for _ in range(rng.randint(least, most)))


#: Class names that tell what stands in an element, by kind of clutter; and those of containers that hold main text or anything.
MARKS = {
    "menu": "nav menu navbar topnav breadcrumb breadcrumbs links pager tabs skip".split(),
    "ad": "ad ads advert sponsored promo banner adslot advertisement".split(),
    "notice": "cookie notice consent alert newsletter subscribe popup gdpr".split(),
    "sidebar": "sidebar related widget aside recommended trending rail".split(),
    "comments": "comments comment replies discussion respond commentlist comment-list comments-area thread responses disqus".split(),
    "header": "header masthead top site-header branding".split(),
    "footer": "footer foot copyright site-footer legal colophon".split(),
    "form": "search login signup form".split(),
}
HOLDERS = "content post body entry main main-col story text page wrap wrapper container col row inner outer article-body primary prose layout grid section block box center left right".split()


def made_page(rng) -> tuple[str, list[bool]]:
    """A made-up page and the truth about its leaves: main text or not.

    Pages differ in their containers: articles, sections, nested divisions of any name or none, table cells, nothing at all. In some no element has a class; there
    clutter is only what tags and links tell.
    """
    html, truth = [], []
    bare, quoted = rng.random() < 0.3, rng.random() < 0.5
    wrapped, linky = rng.random() < 0.12, rng.random() < 0.14

    def put(markup, text, main):
        html.append(markup.replace("@", text))
        truth.append(main)

    def named(names, always=False):
        """A class or id attribute, or none."""
        if not always and (bare or rng.random() < 0.2):
            return ""
        some = " ".join(rng.sample(names, min(len(names), rng.choice([1, 1, 1, 2]))))
        return f' {rng.choice(["class", "class", "id"])}={"'" + some + "'" if quoted else chr(34) + some + chr(34)}'

    def holder():
        return named([*HOLDERS, _words(rng, 1), _words(rng, 1)])

    def links(least, most):
        style = rng.choice(["ul", "ul", "plain", "div", "br"])
        html.append("<ul>" if style == "ul" else "")
        for _ in range(rng.randint(least, most)):
            put({"ul": "<li><a href='/x'>@</a></li>", "plain": "<p><a href='/x'>@</a></p>", "div": "<div><a href='/x'>@</a></div>", "br": "<a href='/x'>@</a><br>"}[style], _words(rng, rng.randint(1, 3)), False)
        html.append("</ul>" if style == "ul" else "")

    def clutter(kinds):
        kind = rng.choice([k for k in kinds if not (bare and k in ("ad", "notice", "comments"))] or ["menu"])
        if kind == "menu":
            tag = rng.choice(["nav", "nav", "div", "ul", "table"])
            if tag == "ul":
                html.append(f"<ul{named(MARKS[kind])}>")
                for _ in range(rng.randint(1, 12)):
                    put('<li><a href="/x">@</a></li>', _words(rng, rng.randint(1, 3)), False)
                html.append("</ul>")
            elif tag == "table":
                html.append("<table><tr>")
                for _ in range(rng.randint(2, 8)):
                    put('<td><a href="/x">@</a></td>', _words(rng, rng.randint(1, 2)), False)
                html.append("</tr></table>")
            else:
                html.append(f"<{tag}{named(MARKS[kind])}>")
                links(1, 12)
                html.append(f"</{tag}>")
        elif kind == "ad":
            tag = rng.choice(["div", "div", "aside", "section", "p"])
            put(f"<{tag}{named(MARKS[kind], True)}>@</{tag}>", _sentences(rng, 1, 3), False)
        elif kind == "notice":
            said = f"{_words(rng, rng.randint(1, 4)).capitalize()} {rng.choice(['cookies', 'consent', 'newsletter', 'privacy', 'cookie'])} {_words(rng, rng.randint(1, 5))}." if rng.random() < 0.5 else ""
            mark = "" if said and rng.random() < 0.5 else named(MARKS[kind], True)
            put(rng.choice([f"<div{mark}><p>@</p></div>", f"<div{mark}>@</div>", f"<p{mark}>@</p>"]), said or _sentences(rng, 1, 2), False)
        elif kind == "form":
            put(f"<form{named(MARKS[kind])}><label>@</label><input><button>ok</button></form>", _words(rng, 2), False)
            truth.append(False)
        elif kind == "sidebar":
            tag = "aside" if bare or rng.random() < 0.5 else "div"
            html.append(f"<{tag}{named(MARKS[kind], tag == 'div')}>")
            put("<h3>@</h3>", _words(rng, 2), False)
            for _ in range(rng.randint(1, 5)):
                put(rng.choice(["<p>@</p>", '<p><a href="/y">@</a></p>', "<li>@</li>", '<li><a href="/y">@</a></li>']), _sentences(rng, 1, 2), False)
            html.append(f"</{tag}>")
        elif kind == "header":
            tag = "header" if bare or rng.random() < 0.5 else "div"
            html.append(f"<{tag}{named(MARKS[kind], tag == 'div')}>")
            put(rng.choice(["<h2>@</h2>", "<p>@</p>", "<a href='/'>@</a>", "@"]), _words(rng, rng.randint(1, 4)), False)
            html.append(f"</{tag}>")
        elif kind == "comments":
            tag = rng.choice(["section", "div", "ol", "ul"])
            told = rng.random() < 0.35  # only the heading tells
            html.append(f"<{tag}{'' if told else named(MARKS[kind], True)}>")
            if told or rng.random() < 0.4:
                said = rng.choice(["Comments", "@ Comments", "@ comments", "@ Replies", "Responses", "Leave a reply", "Discussion"]).replace("@", str(rng.randint(2, 40)))
                put(f"<h{(k := rng.randint(2, 4))}>@</h{k}>", said if told or rng.random() < 0.5 else _words(rng, 1), False)
            entry = rng.choice(["<p>@</p>", '<div class="comment"><p>@</p></div>', "<li>@</li>"] if not told else ["<p>@</p>", "<div><p>@</p></div>", "<li>@</li>"])
            for _ in range(rng.randint(1, 5)):
                put(entry, _sentences(rng, 1, 3), False)
            html.append(f"</{tag}>")
        else:
            tag = "footer" if bare or rng.random() < 0.6 else "div"
            html.append(f"<{tag}{named(MARKS[kind], tag == 'div')}>")
            for _ in range(rng.choice([1, 1, 2])):
                put(rng.choice(["<p>@</p>", "@<br>", "<div>@</div>"]), rng.choice(["© ", "", "&copy; "]) + rng.choice([_words(rng, rng.randint(2, 8)), _sentences(rng, 1, 1)]), False)
            if rng.random() < 0.3:
                links(1, 4)
            html.append(f"</{tag}>")

    before, after = ["menu", "menu", "ad", "notice", "form", "header", "ad", "menu"], ["sidebar", "comments", "ad", "footer", "footer", "form", "notice", "menu"]
    layout = rng.choice(["article", "main", "section", "div", "div", "div", "div", "table", "flat"])
    outer = [f"<div{holder()}>" for _ in range(rng.choice([0, 0, 1, 2, 3]))]
    inside = rng.random() < 0.5  # does the clutter stand in the same divisions?
    html.append(f"<form{named(['aspnetForm', 'mainform', 'form1', 'pageform', *HOLDERS], not bare)}>" if wrapped else "")  # as some servers wrap every page
    html += outer if inside else []
    for _ in range(rng.randint(0, 4)):
        clutter(before)
    html += [] if inside else outer
    if layout == "table":
        html.append("<table><tr>")
        if rng.random() < 0.6:
            html.append("<td>")
            links(2, 8)
            html.append("</td>")
        html.append("<td>")
        close = "</td></tr></table>"
    else:
        html.append("" if layout == "flat" else f"<{layout}{holder()}>")
        close = "" if layout == "flat" else f"</{layout}>"
    if rng.random() < 0.7:
        put(rng.choice(["<h1>@</h1>", "<h1>@</h1>", "<header><h1>@</h1></header>", "<h2>@</h2>"]), rng.choice([_words(rng, rng.randint(1, 8)), _sentences(rng, 1, 1)]), True)
    plain = rng.choice(["<p>@</p>", "<p>@</p>", "<p>@", "<div>@</div>", "@<br><br>"]) if not linky else "<p><a href='/z'>@</a></p>"
    refrain = rng.choice([_words(rng, rng.randint(1, 6)), _sentences(rng, 1, 1)])
    again = rng.choice([0, 0, 0, 0.3, 0.8])  # pages that say one line over and over
    for _ in range(1 if rng.random() < 0.16 else rng.randint(1, 14) if rng.random() < 0.85 else rng.randint(15, 90)):
        what = rng.random()
        if rng.random() < again:
            put(plain, refrain, True)
        elif what < 0.7:
            put(rng.choice([plain, plain, "<p><b>@<br>", "<p><em>@</em></p>", "<p>@ <a href='/z'>more here</a></p>"]), _sentences(rng, 1, 6), True)
        elif what < 0.8:
            put(f"<h{(k := rng.randint(2, 4))}>@</h{k}>", _words(rng, rng.randint(1, 6)), True)
        elif what < 0.9:
            put(rng.choice(["<blockquote>@</blockquote>", "<pre>@</pre>", "<ul><li>@</li></ul>", "<table><tr><td>@</td></tr></table>"]), _words(rng, rng.randint(2, 12)), True)
        elif what < 0.95:
            clutter(["ad"]) if not bare else put(plain, _sentences(rng, 1, 2), True)
        else:
            put(plain, _words(rng, rng.randint(1, 3)), True)
    html.append(close)
    html += [] if inside else ["</div>"] * len(outer)
    for _ in range(rng.randint(0, 4)):
        clutter(after)
    html += ["</div>"] * len(outer) if inside else []
    html.append("</form>" if wrapped else "")
    head = rng.choice(["<html><head><title>t</title></head><body>", "<head><title>t</title><body>", "<title>t</title>"])
    return head + "".join(html) + "</body></html>", truth


def trained(n_pages: int = 2000, seed: int = 9) -> Labeller:
    """A labeller trained on made-up pages; the tables are never read for it."""
    rng = random.Random(seed)
    pages = []
    while len(pages) < n_pages:
        html, truth = made_page(rng)
        found = leaves(html)
        if len(found) == len(truth):
            pages.append((vectors(found), np.array(truth, np.float32)))
    return Labeller().train(pages)


def main_texts(model: Labeller, htmls: list[str]) -> list[str]:
    out = []
    for at in range(0, len(htmls), PAGES):
        found = [leaves(h) for h in htmls[at : at + PAGES]]
        order = sorted(range(len(found)), key=lambda i: len(found[i]))
        texts = [""] * len(found)
        k = 0
        while k < len(order):
            n = next((n for n in range(PAGES, 1, -1) if k + n <= len(order) and n * len(found[order[k + n - 1]]) <= STEPS), 1)
            group = [i for i in order[k : k + n] if found[i]]
            k += n
            if group:
                x, mask, _ = padded([vectors(found[i]) for i in group])
                main = model.score(x, mask) > 0
                for j, i in enumerate(group):
                    texts[i] = "\n".join(t for t, m in zip((t for _, t, _ in found[i]), main[: len(found[i]), j], strict=True) if m)
        out += texts
    return out


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text, n_chars): the main text of every page, blocks joined by line feeds.

    Null or empty html, and pages without a main block, give an empty text; broken markup is read as far as it goes; repeated rows give repeated rows;
    an empty table gives an empty result; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast((model or trained()).p)

    def run(batches):
        import pyarrow as pa

        own = Labeller()
        own.p = shared.value
        for batch in batches:
            texts = []
            for at in range(0, batch.num_rows, PAGES):
                texts += main_texts(own, [h or "" for h in batch.column(2).slice(at, PAGES).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op4_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
