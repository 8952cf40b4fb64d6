"""Main text of HTML pages: a bidirectional LSTM in numpy labels every block of a page.

A page becomes a sequence of leaf blocks: runs of text between block-level tags, without
scripts, styles and comments. A block's vector has its tag path (tags and the words of class,
id and role of all open elements, hashed), its words (hashed), and a few figures (length,
links, punctuation, place). The LSTM reads the sequence in both directions, so that each block
is labelled with the whole document as context; blocks labelled as main text are joined in
page order. No page, block or sequence is cut short.

The model is trained here, with a fixed seed, on pages that `sample_page` writes: many ways to
mark up an article amid menus, headers, footers, sidebars, notices, adverts, forms and reader
comments. It holds some 100 kB and goes to the workers with the function.

Defined results: null and empty pages, and pages without main text, give an empty text. Markup
that never closes ends with the page. Repeated rows are labelled one by one; `extract` keeps
other columns; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, lean

PATHS, WORDS, FIGURES, HIDDEN = 192, 48, 12, 24
WIDTH = PATHS + WORDS + FIGURES

# -- blocks ------------------------------------------------------------------

#: Elements whose content is no text of the page.
SILENT = {"script", "style", "template", "noscript", "title", "iframe", "svg", "math", "object", "audio", "video", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img", "ruby", "rb", "rt", "rp"}
#: What a start tag closes when it is open, up to the nearest of the barriers.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
BARRIER = {"ul", "ol", "dl", "table", "select", "div", "article", "section", "main", "body", "aside", "nav", "footer", "header", "form", "blockquote"}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMED = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_END = {name: re.compile(rf"</{name}\s*[^>]*>", re.I) for name in SILENT}


@dataclass
class Block:
    text: str = ""
    path: tuple[str, ...] = ()
    linked: int = 0


@lru_cache(maxsize=4096)
def _labels(tag: str, attributes: str) -> tuple[str, ...]:
    """The element's own path words: its tag, and the words of its names."""
    out = [tag]
    for kind, *values in _NAMED.findall(attributes):
        for value in _PART.findall("".join(values).lower()):
            out.append(("@" if kind.lower() in ("role", "itemprop", "aria-label") else ".") + value)
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; references are decoded, white space is one space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(p for p, _ in pieces)).split())
        if text:
            path = tuple(x for tag, own in stack if tag not in INLINE for x in own)
            linked = sum(len(" ".join(p.split())) for p, is_link in pieces if is_link)
            out.append(Block(text, path, linked))
        pieces.clear()

    at, n = 0, len(page)
    while at < n:
        found = _TAG.search(page, at)
        end = found.start() if found else n
        if end > at:
            pieces.append((page[at:end], links > 0))
        if not found:
            break
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append((" ", links > 0))
            continue
        if tag not in INLINE:
            flush()
        if closing:
            if any(t == tag for t, _ in stack):
                while stack:
                    t, _ = stack.pop()
                    links -= t == "a"
                    if t == tag:
                        break
            continue
        if tag in SILENT:
            if not attributes.rstrip().endswith("/"):
                close = _END[tag].search(page, at)
                at = close.end() if close else n
            continue
        shut = CLOSES.get(tag) or (set() if tag in INLINE else {"p"})
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in shut:
                links -= sum(t == "a" for t, _ in stack[k:])
                del stack[k:]
                if tag not in ("tr", "td", "th"):
                    break
            elif k < len(stack) and stack[k][0] in BARRIER:
                break
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in INLINE and len(attributes) > 1 and tag in ("hr", "input"):
            continue
        links += tag == "a"
        stack.append((tag, _labels(tag, attributes)))
    flush()
    return out


# -- vectors -----------------------------------------------------------------


@lru_cache(maxsize=1 << 16)
def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


@lru_cache(maxsize=1 << 14)
def _path_slots(path: tuple[str, ...]) -> np.ndarray:
    return np.array(sorted({_slot(x, PATHS) for x in set(path)}), np.int64)


def vectors(found: list[Block]) -> np.ndarray:
    """One row for each block of a page."""
    n = len(found)
    x = np.zeros((n, WIDTH), np.float32)
    for k, block in enumerate(found):
        # very long paths are not remembered, so that deep pages fill no memory
        x[k, _path_slots(block.path) if len(block.path) <= 64 else _path_slots.__wrapped__(block.path)] = 1
        text = block.text
        words = text.lower().split(" ")
        x[k, PATHS : PATHS + WORDS] = np.bincount([_slot(w, WORDS) for w in words], minlength=WORDS) / len(words)
        size = len(text)
        count = text.count(" ") + 1
        stops = text.count(".") + text.count("!") + text.count("?") + text.count(",")
        leaf = next((t for t in reversed(block.path) if t[0] not in ".@"), "")
        x[k, PATHS + WORDS :] = (
            np.log1p(size) / 8, np.log1p(count) / 6, min(1.0, block.linked / size), min(1.0, stops / count),
            size / count / 12, text[-1] in ".!?\"", leaf in ("p", "blockquote", "pre"), leaf in ("h1", "h2", "h3", "h4", "h5", "h6"),
            leaf in ("li", "dd", "dt"), k / n, np.log1p(k) / 6, "©" in text,
        )
    return x


# -- the network -------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """A bidirectional LSTM and a logistic unit over both states and the block's own vector."""

    parts: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def start(seed: int) -> Labeller:
        r = np.random.default_rng(seed)
        parts = {}
        for side in "fb":
            parts[f"{side}x"] = r.normal(0, 0.08, (WIDTH, 4 * HIDDEN))
            parts[f"{side}h"] = r.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
            bias = np.zeros(4 * HIDDEN)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            parts[f"{side}o"] = bias
        parts["out"] = r.normal(0, 0.1, 2 * HIDDEN)
        parts["own"] = np.zeros(WIDTH)
        parts["bias"] = np.zeros(1)
        return Labeller({k: v.astype(np.float32) for k, v in parts.items()})

    def _read(self, side: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """States (steps, pages, HIDDEN) of one direction, and what its gradient needs."""
        steps, pages, _ = x.shape
        gates_in = (x.reshape(-1, WIDTH) @ self.parts[f"{side}x"] + self.parts[f"{side}o"]).reshape(steps, pages, -1)
        h = c = np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        tape: list = [None] * steps
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = gates_in[t] + h @ self.parts[f"{side}h"]
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = f * c + i * g
            held = np.tanh(c_new)
            tape[t] = (i, f, o, g, c, h, held, m)
            c = np.where(m, c_new, c)
            h = np.where(m, o * held, h)
            out[t] = h
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        f, tf = self._read("f", x, mask)
        b, tb = self._read("b", x, mask)
        both = np.concatenate([f, b], axis=2)
        return both @ self.parts["out"] + x @ self.parts["own"] + self.parts["bias"], (both, tf, tb)

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        z, (both, tf, tb) = self.logits(x, mask)
        p = _sigmoid(z)
        total = max(1, int(mask.sum()))
        loss = float(-(np.log(np.where(y > 0, p, 1 - p) + 1e-7) * mask).sum() / total)
        dz = ((p - y) * mask / total).astype(np.float32)
        g = {"out": np.tensordot(dz, both, ([0, 1], [0, 1])), "own": np.tensordot(dz, x, ([0, 1], [0, 1])), "bias": dz.sum(keepdims=True).reshape(1)}
        for side, tape, lo in (("f", tf, 0), ("b", tb, HIDDEN)):
            dout = dz[:, :, None] * self.parts["out"][lo : lo + HIDDEN]
            steps = len(x)
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            dgates = np.zeros((steps, x.shape[1], 4 * HIDDEN), np.float32)
            gh = np.zeros_like(self.parts[f"{side}h"])
            for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
                i, f, o, gg, c0, h0, held, m = tape[t]
                full = dh + dout[t]
                d = full * m
                dcc = dc * m + d * o * (1 - held * held)
                dgates[t] = np.concatenate([dcc * gg * i * (1 - i), dcc * c0 * f * (1 - f), d * held * o * (1 - o), dcc * i * (1 - gg * gg)], axis=1)
                gh += h0.T @ dgates[t]
                dh = dgates[t] @ self.parts[f"{side}h"].T + full * ~m
                dc = dcc * f + dc * ~m
            flat = dgates.reshape(-1, 4 * HIDDEN)
            g[f"{side}x"], g[f"{side}h"], g[f"{side}o"] = x.reshape(-1, WIDTH).T @ flat, gh, flat.sum(axis=0)
        return loss, g

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is main text; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and hi - lo < 256 and len(pages[order[hi]]) * (hi - lo + 1) <= 20_000:
                hi += 1
            some = order[lo:hi]
            x, mask = _padded([pages[k] for k in some])
            z, _ = self.logits(x, mask)
            for j, k in enumerate(some):
                out[k] = z[: len(pages[k]), j] > 0
            lo = hi
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), bool)
    for j, page in enumerate(pages):
        x[: len(page), j], mask[: len(page), j] = page, True
    return x, mask


# -- training pages ----------------------------------------------------------

_PARTS = ["an", "er", "the", "tion", "in", "ou", "re", "st", "le", "con", "ver", "ge", "ado", "ez", "é", "ment", "ch", "ung", "que", "li", "ra", "so", "ti", "wh"]
_BOILER = {
    "nav": ("nav", ["nav", "menu", "navigation", "navbar", "breadcrumb", "topnav", "main-menu"]),
    "header": ("header", ["header", "masthead", "site-header", "topbar", "branding"]),
    "footer": ("footer", ["footer", "site-footer", "bottom", "copyright", "colophon"]),
    "side": ("aside", ["sidebar", "widget", "related", "rail", "side", "recommended", "popular", "more-stories"]),
    "ad": ("div", ["ad", "ads", "advert", "advertisement", "promo", "sponsored", "banner", "adbox"]),
    "notice": ("div", ["notice", "cookie", "cookies", "consent", "alert", "gdpr", "popup", "modal", "newsletter", "subscribe", "cookie-banner"]),
    "form": ("form", ["form", "search", "login", "signup", "contact-form", "search-form"]),
    "comments": ("section", ["comments", "comment", "comment-list", "responses", "disqus", "discussion", "replies"]),
    "share": ("div", ["share", "social", "tags", "author-box", "byline-links", "pagination"]),
}
_MAIN = [('<article>', "</article>"), ('<article class="post">', "</article>"), ('<main>', "</main>"), ('<main id="main"><article>', "</article></main>"), ('<div class="content">', "</div>"), ('<div id="content">', "</div>"), ('<div class="article-body">', "</div>"), ('<div class="entry-content">', "</div>"), ('<section class="story">', "</section>"), ('<div class="post-content"><div>', "</div></div>"), ('<div role="main">', "</div>"), ('<div itemprop="articleBody">', "</div>"), ("<div>", "</div>"), ("", "")]


_NEUTRAL = ["row", "col", "inner", "wrap", "outer", "box", "grid", "block", "item", "layout", "cell", "flex", "container", "unit", "md", "holder"]


def _word(r: random.Random) -> str:
    return "".join(r.choice(_PARTS) for _ in range(r.randint(1, 4)))


def _prose(r: random.Random, words: int) -> str:
    kind = r.random()
    out = []
    for k in range(words):
        w = _word(r)
        if kind < 0.08:
            w += r.choice(["###", "$$$", "%%%", "&amp;&amp;&amp;", "***"])
        elif kind < 0.14:
            w = w.upper() + "!!"
        elif kind < 0.2:
            w += r.choice([" |", ""])
        elif r.random() < 0.12:
            w += r.choice([",", ".", ".", "?"])
        out.append(w if k else w.capitalize())
    return " ".join(out) + r.choice([".", ".", ".", "", "!"])


def sample_page(r: random.Random) -> tuple[str, set[str]]:
    """(a page, the texts of its main blocks)."""
    main: set[str] = set()

    def said(words: int) -> str:
        text = _prose(r, words)
        main.add(" ".join(entities.unescape(text).split()))
        return text

    def nested(inner: str, closed: bool = True) -> str:
        """inner within many divs, which may stay open."""
        n = r.randint(4, 24)
        opened = "".join(f'<div class="{" ".join(r.choices(_NEUTRAL, k=r.randint(1, 4)))}">' for _ in range(n))
        return opened + inner + "</div>" * (n if closed else r.randint(0, n - 1))

    def boiler(kind: str) -> str:
        tag, names = _BOILER[kind]
        if r.random() < 0.4:
            tag = r.choice(["div", "section", "div", "ul" if kind == "nav" else "div"])
        plain = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.5
        name = "" if plain else f' {r.choice(["class", "id"])}="{r.choice(names)}"'
        form = r.random()
        if kind in ("nav", "share") or form < 0.25:
            items = "".join(f'<li><a href="/{_word(r)}">{_prose(r, r.randint(1, 3)) if r.random() < 0.3 else _word(r)}</a></li>' for _ in range(r.randint(2, 8)))
            inner = items if tag == "ul" else f"<ul>{items}</ul>" if r.random() < 0.8 else re.sub("</?li>", " ", items)
        elif kind == "form":
            inner = f'<label>{_word(r)}</label><input name="q"><button>{_word(r)}</button>' + (f"<p>{_prose(r, r.randint(3, 15))}</p>" if form < 0.6 else "")
        elif kind == "footer" and form < 0.8:
            inner = f"&copy; {_word(r)}.example.com &middot; {_prose(r, r.randint(2, 14))}"
        elif kind == "comments" or form < 0.65:
            wrap = ("<div class=\"comment\"><p>", "</p></div>") if kind == "comments" and form < 0.7 else ("<p>", "</p>")
            inner = "".join(f"{wrap[0]}{_prose(r, r.randint(2, 50) if r.random() < 0.85 else r.randint(50, 400))}{wrap[1]}" for _ in range(r.randint(1, 4)))
            if r.random() < 0.4:
                inner = f"<h3>{_prose(r, r.randint(1, 4))}</h3>" + inner
        else:
            inner = _prose(r, r.randint(2, 20) if r.random() < 0.85 else r.randint(20, 300))
        if r.random() < 0.12:
            inner = nested(inner, tag in ("div", "ul", "section") or r.random() < 0.5)
        return f"<{tag}{name}>{inner}</{tag}>"

    def article() -> str:
        out = []
        if r.random() < 0.85:
            out.append(f"<h1>{said(r.randint(1, 10))}</h1>")
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 14])):
            k = r.random()
            if k < 0.72:
                text = said(r.choice([1, 2, 6, 15, 40, 90]) if r.random() < 0.93 else r.randint(100, 400))
                out.append(f"<p>{text}</p>" if r.random() < 0.8 else f"<p><b>{text}<br>")
            elif k < 0.8:
                out.append(f"<h2>{said(r.randint(1, 6))}</h2>")
            elif k < 0.86:
                out.append("<ul>" + "".join(f"<li>{said(r.randint(2, 12))}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif k < 0.9:
                out.append(f"<blockquote>{said(r.randint(5, 30))}</blockquote>")
            elif k < 0.94:
                out.append("<table><tr>" + "".join(f"<td>{said(r.randint(1, 3))}</td>" for _ in range(3)) + "</tr></table>")
            elif k < 0.98:
                out.append(boiler(r.choice(["ad", "share", "notice", "side"])))
            else:
                out.append(f"<pre>{said(r.randint(3, 20))}</pre>")
        return "".join(out) or f"<p>{said(30)}</p>"

    before = [boiler(k) for k in ("header", "nav", "notice", "ad", "form", "side") if r.random() < 0.45]
    after = [boiler(k) for k in ("comments", "share", "side", "ad", "form", "notice", "footer") if r.random() < 0.4]
    if r.random() < 0.5 and not any("footer" in x for x in after):
        after.append(boiler("footer"))
    r.shuffle(before)
    opened, closed = r.choice(_MAIN)
    story = article()
    if r.random() < 0.12:
        story = nested(story)
    body = f"{''.join(before)}{opened}{story}{closed}{''.join(after)}"
    if r.random() < 0.12:
        body = nested(body, r.random() < 0.5)
    if r.random() < 0.3:
        body = f'<div class="{r.choice(["wrap", "page", "container", "site"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{_word(r)}</title><style>p{{}}</style></head><body>{body}</body></html>", main


@lru_cache(maxsize=2)
def trained(seed: int = 7, pages: int = 900, passes: int = 6, batch: int = 30, rate: float = 0.008) -> Labeller:
    """The labeller after training by Adam on `pages` written pages; the same each time."""
    r = random.Random(seed)
    examples = []
    for _ in range(pages):
        page, main = sample_page(r)
        found = blocks(page)
        examples.append((vectors(found), np.array([b.text in main for b in found], np.float32)))
    model = Labeller.start(seed)
    first = {k: np.zeros_like(v) for k, v in model.parts.items()}
    second = {k: np.zeros_like(v) for k, v in model.parts.items()}
    step = 0
    for turn in range(passes):
        r.shuffle(examples)
        groups = sorted(range(len(examples)), key=lambda k: len(examples[k][0]))
        lots = [groups[k : k + batch] for k in range(0, len(groups), batch)]
        r.shuffle(lots)
        for lot in lots:
            x, mask = _padded([examples[k][0] for k in lot])
            y = np.zeros(mask.shape, np.float32)
            for j, k in enumerate(lot):
                y[: len(examples[k][1]), j] = examples[k][1]
            _, g = model.gradient(x, mask, y)
            step += 1
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            pace = rate * (1 - 0.9 * turn / passes)
            for name, v in g.items():
                v = v * min(1.0, 1.0 / (size + 1e-9)) if size > 1 else v
                first[name] = 0.9 * first[name] + 0.1 * v
                second[name] = 0.999 * second[name] + 0.001 * v * v
                model.parts[name] -= (pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


# -- Spark -------------------------------------------------------------------


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    found = [blocks(page) for page in pages]
    labels = model.labels([vectors(x) for x in found])
    return ["\n".join(b.text for b, ok in zip(x, label) if ok) for x, label in zip(found, labels)]


def extract(pages: DataFrame, html: str = "html", out: str = "text", model: Labeller | None = None) -> DataFrame:
    """pages with the main text of each."""
    model = model or trained()
    out = fresh(pages, out)
    at = pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = main_texts(model, [x or "" for x in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    return pages.mapInArrow(lean(run), T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())]))
