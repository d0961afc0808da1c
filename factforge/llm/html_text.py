"""Main text of HTML pages: a bidirectional LSTM labels every text block with the whole page as context.

A page becomes its sequence of leaf blocks. Each block is a vector: hashed tags and classes of its path, hashed words, sizes,
whether it lies in the element that holds most of the page's text, and how it goes with the block before it. The network is
trained here, on the driver, over a bounded sample of whole pages (``SAMPLE_PAGES``, in the order of a hash of page_id). Its targets
are the blocks that HTML's own content elements mark. Each sampled page is also shown rebuilt under other templates: content in
paragraphs, lists, quotes, tables and preformatted blocks, under known or made-up names, and around it menus, notices, adverts,
forms, related links, footers and reader comments, in semantic elements or in plain ones under made-up names. So the
network learns wording, sizes, order and place, not a list of names. It is broadcast (under 200 kB) and reads every block of every page.

Parsing takes time and memory linear in a page, however deep it nests. Null and empty pages give an empty text. Pages cut off in
the middle of a tag or a comment lose what is unfinished of it. Repeated rows are read each on its own. Without any page the
network is untrained and labels nothing.
"""

from __future__ import annotations

import html
import re
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factforge.llm.common import map_text, texts

#: Most pages that training reads, each of them whole.
SAMPLE_PAGES = 300
#: Templates under which each sampled page is shown besides its own. Most steps of a batch over all its pages, unless one page alone has more.
TEMPLATES, BATCH_STEPS = 2, 20_000
#: Least number of training steps.
STEPS = 200
PATH, OWN, WORDS, SIZES = 64, 16, 32, 11
WIDTH, HIDDEN = PATH + OWN + WORDS + SIZES, 20

TOKENS = re.compile(r"""(<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg)\b.*?(?:</(?P=raw)\s*>|\Z)|</?[a-zA-Z!?](?:"[^"]*"|'[^']*'|[^'">])*>|<[a-zA-Z/!?][^>]*(?:>|\Z))""", re.S | re.I)
NAME = re.compile(r"<(/?)([a-zA-Z][\w-]*)")
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
MARK_WORDS = re.compile(r"[a-z]+")
# Elements that end a block, elements without content, content elements, elements and words around content.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
CONTENT = frozenset("article main content post entry story".split())
AROUND = frozenset("nav header footer aside form button select option label head title menu dialog ad ads advert advertisement banner breadcrumb comment comments consent cookie disclaimer login modal navigation newsletter notice popup promo related reply share sidebar signup social sponsor subscribe toolbar widget".split())


# Blocks of running text, which are never the element that holds the page's text.
RUNNING = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th title".split())


@dataclass
class Page:
    """Leaf blocks with text, in order, and the elements above them: node 0 is the page, parents come before their children."""

    text: list[str] = field(default_factory=list)
    node: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters inside links
    marks: list[bytes] = field(default_factory=list)  # the hashed path
    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    names: list[int] = field(default_factory=lambda: [0])  # CONTENT_BIT and the like, of the element or one above it


CONTENT_BIT, AROUND_BIT, BODY_BIT = 1, 2, 4


def parse(page: str) -> Page:
    out = Page()
    stack: list[tuple[int, tuple[str, ...]]] = []  # open elements: node, marks
    open_tags: dict[str, int] = {}
    open_marks: dict[str, int] = {}
    path = array("i", [0] * PATH)
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.text.append(text)
                out.node.append(stack[-1][0] if stack else 0)
                out.linked.append(linked)
                out.marks.append(path.tobytes())
            held.clear()
            linked = 0

    def enter(tag: str, marks: tuple[str, ...]) -> None:
        up = stack[-1][0] if stack else 0
        bits = out.names[up] | BODY_BIT * (tag == "body")
        for m in marks:
            name = m.rpartition(".")[2]
            bits |= CONTENT_BIT * (name in CONTENT) | AROUND_BIT * (name in AROUND)
            open_marks[m] = n = open_marks.get(m, 0) + 1
            if n == 1:
                at, sign = slot(m, PATH)
                path[at] += int(sign)
        out.parent.append(up)
        out.tag.append(tag)
        out.names.append(bits)
        stack.append((len(out.tag) - 1, marks))
        open_tags[tag] = open_tags.get(tag, 0) + 1

    def leave(i: int) -> None:
        """Closes the open elements from the i-th on."""
        while len(stack) > i:
            node, marks = stack.pop()
            open_tags[out.tag[node]] -= 1
            for m in marks:
                open_marks[m] -= 1
                if not open_marks[m]:
                    at, sign = slot(m, PATH)
                    path[at] -= int(sign)

    at = 0
    for found in TOKENS.finditer(page):
        if found.start() > at:
            held.append(page[at : found.start()])
            if open_tags.get("a"):
                linked += found.start() - at
        at = found.end()
        token = found.group()
        if found.group("raw") or not (name := NAME.match(token)):
            continue
        close, tag = name.group(1), name.group(2).lower()
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if close:
            if open_tags.get(tag):
                i = len(stack) - 1
                while out.tag[stack[i][0]] != tag:
                    i -= 1
                leave(i)
        elif tag not in EMPTY and not token.endswith("/>"):
            if tag in BLOCKS and stack:  # a new block ends an open paragraph, and an item an open item
                i = len(stack) - 1
                while i >= 0:
                    own = out.tag[stack[i][0]]
                    if own == "p" or own == tag and tag in ("li", "option", "dt", "dd", "tr", "td", "th"):
                        leave(i)
                        break
                    if own in BLOCKS:
                        break
                    i -= 1
            words = {f"{tag}.{w}" for m in MARKS.findall(token) for w in MARK_WORDS.findall(m.lower())}
            enter(tag, (tag, *sorted(words)))
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


def targets(page: Page) -> list[bool]:
    """Is each block content by HTML's own elements? On a page that marks no content, all of the body but what is around it."""
    marked = any(b & CONTENT_BIT for b in page.names)
    bits = [page.names[n] for n in page.node]
    return [not b & AROUND_BIT and bool(b & CONTENT_BIT if marked else b & BODY_BIT and page.tag[n] != "body") for b, n in zip(bits, page.node, strict=True)]


def holder(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """For each node: is it in the element that holds most of the page's text, and the share of the text in its parent element."""
    n = len(page.tag)
    chars, blocks = [0] * n, [0] * n
    for t, at in zip(page.text, page.node, strict=True):
        chars[at] += len(t)
        blocks[at] += 1
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
        blocks[page.parent[i]] += blocks[i]
    total, main, inside = max(1, chars[0]), 0, np.zeros(n, bool)
    for i in range(1, n):  # down the way of elements with over half of it
        if page.parent[i] == main and 2 * chars[i] > total and blocks[i] > 1 and page.tag[i] not in RUNNING:
            main = i
    inside[main] = True
    for i in range(main + 1, n):
        inside[i] = inside[page.parent[i]]
    return inside, np.array([chars[max(0, p)] / total for p in page.parent])


_SLOT: dict[tuple[int, str], tuple[int, float]] = {}


def slot(text: str, size: int) -> tuple[int, float]:
    key = (size, text)
    if (found := _SLOT.get(key)) is None:
        if len(_SLOT) > 500_000:
            _SLOT.clear()
        h = zlib.crc32(f"{size}{text}".encode())
        found = _SLOT[key] = (h // 2 % size, 1.0 if h % 2 else -1.0)
    return found


class WordCodes(dict):
    """Twice the slot of a word, and 1 for a negative sign."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = code = zlib.crc32(word.encode()) % (2 * WORDS)
        return code


_CODES = WordCodes()


def vectors(page: Page) -> np.ndarray:
    n = len(page.text)
    x = np.zeros((n, WIDTH), np.float32)
    if not n:
        return x
    x[:, :PATH] = np.clip(np.frombuffer(b"".join(page.marks), np.int32).reshape(-1, PATH), -4, 4)
    inside, share = holder(page)
    words = [t.split(" ") for t in page.text]
    count = np.array([len(w) for w in words])
    codes = np.fromiter((_CODES[w] for own in words for w in own), np.int64, int(count.sum()))
    hits = np.bincount(codes + 2 * WORDS * np.repeat(np.arange(n), count), minlength=2 * WORDS * n).reshape(n, WORDS, 2)
    # A word said a thousand times is no more than 1.
    x[:, PATH + OWN : PATH + OWN + WORDS] = np.clip((hits[:, :, 0] - hits[:, :, 1]) / (2 * count**0.5)[:, None], -1, 1)
    sizes, before = [], -1
    for i, (text, node, linked) in enumerate(zip(page.text, page.node, page.linked, strict=True)):
        x[i, PATH + slot(page.tag[node], OWN)[0]] = 1
        up, size = page.parent[node], len(text)
        digits = sum(map(str.isdigit, text)) / size if size <= 40 else 0  # dates and numbers stand in short blocks
        sizes.append((size, linked / (linked + size), i / n, text[-1] in ".!?…。", text[:1].isupper(), inside[node], share[node], page.tag[node] == page.tag[page.node[i - 1]] if i else 0, up == before, digits))
        before = up
    x[:, -SIZES + 1 :] = sizes
    x[:, -SIZES] = np.log1p(count) / 4
    x[:, -SIZES + 1] = np.log1p(x[:, -SIZES + 1]) / 6
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Direction:
    """One LSTM over a padded batch (steps, pages, width)."""

    def __init__(self, rng: np.random.Generator):
        self.w = (rng.standard_normal((WIDTH, 4 * HIDDEN)) / WIDTH**0.5).astype(np.float32)
        self.u = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / HIDDEN**0.5).astype(np.float32)
        self.b = np.zeros(4 * HIDDEN, np.float32)
        self.b[HIDDEN : 2 * HIDDEN] = 1

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> np.ndarray:
        steps, pages, _ = x.shape
        z = (x.reshape(-1, WIDTH) @ self.w + self.b).reshape(steps, pages, -1)
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, self.trace = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps):
            a = z[t] + h @ self.u
            s = sigmoid(a[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            squashed = np.tanh(new)
            if keep:
                self.trace.append((h, c, i, f, o, g, squashed, m))
            c, h = np.where(m, new, c), np.where(m, o * squashed, h)
            out[t] = h
        return out

    def backward(self, x: np.ndarray, dout: np.ndarray) -> list[np.ndarray]:
        dw, du, db = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        for t in range(len(x) - 1, -1, -1):
            h, c, i, f, o, g, squashed, m = self.trace[t]
            dh = dh + dout[t]
            live_h, live_c = dh * m, dc * m
            through = live_h * o * (1 - squashed**2) + live_c
            da = np.concatenate([through * g * i * (1 - i), through * c * f * (1 - f), live_h * squashed * o * (1 - o), through * i * (1 - g**2)], axis=1)
            dw += x[t].T @ da
            du += h.T @ da
            db += da.sum(axis=0)
            dh, dc = dh * ~m + da @ self.u.T, dc * ~m + through * f
        return [dw, du, db]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch, its mask, and for each step and page the step that mirrors it within the page."""
    sizes = np.array([len(p) for p in pages])
    x = np.zeros((sizes.max(), len(pages), WIDTH), np.float32)
    for n, p in enumerate(pages):
        x[: len(p), n] = p
    step = np.arange(len(x))[:, None]
    return x, step < sizes, np.where(step < sizes, sizes - 1 - step, step)


def like_length(sizes: list[int], order: list[int], most: int) -> list[list[int]]:
    """Batches of at most `most` pages and BATCH_STEPS padded steps, of pages of like length."""
    out, order = [], sorted((k for k in order if sizes[k]), key=lambda k: sizes[k])
    for k in order:
        if not out or len(out[-1]) == most or (len(out[-1]) + 1) * sizes[k] > BATCH_STEPS:
            out.append([])
        out[-1].append(k)
    return out


class BlockLabeller:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.ways = [Direction(rng), Direction(rng)]
        self.w, self.b = (rng.standard_normal(2 * HIDDEN) / HIDDEN).astype(np.float32), np.full(1, -1.0, np.float32)

    def forward(self, x: np.ndarray, mask: np.ndarray, mirror: np.ndarray, keep: bool = False) -> tuple[np.ndarray, ...]:
        pages = np.arange(x.shape[1])
        ahead = self.ways[0].forward(x, mask, keep)
        back = self.ways[1].forward(x[mirror, pages], mask, keep)[mirror, pages]
        both = np.concatenate([ahead, back], axis=2)
        return both, sigmoid(both @ self.w + self.b)

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], passes: int = 6, batch: int = 48, rate: float = 0.01, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        passes = max(passes, -(-STEPS // -(-len(pages) // batch)))  # few pages are shown more often
        weights = [*(p for d in self.ways for p in (d.w, d.u, d.b)), self.w, self.b]
        first, second, n = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights], 0
        most = passes * -(-len(pages) // batch)
        for _ in range(passes):
            order = rng.permutation(len(pages))
            for at in range(0, len(order), batch):
                own = order[at : at + batch].tolist()
                total, grads = sum(len(pages[k]) for k in own), [np.zeros_like(p) for p in weights]
                for part in like_length([len(p) for p in pages], own, batch):  # parts of one step, so that short pages are not padded to the longest
                    x, mask, mirror = padded([pages[k] for k in part])
                    y = np.zeros(mask.shape, np.float32)
                    for j, k in enumerate(part):
                        y[: len(labels[k]), j] = labels[k]
                    both, p = self.forward(x, mask, mirror, True)
                    d = ((p - y) * mask / total).astype(np.float32)
                    dboth, cols = d[:, :, None] * self.w, np.arange(x.shape[1])
                    more = self.ways[0].backward(x, dboth[:, :, :HIDDEN]) + self.ways[1].backward(x[mirror, cols], dboth[:, :, HIDDEN:][mirror, cols])
                    more += [np.einsum("tp,tph->h", d, both), d.sum(keepdims=True).reshape(1)]
                    for g, m in zip(grads, more, strict=True):
                        g += m
                n += 1
                now = rate * (1 - 0.95 * n / most)
                for w, g, a, b in zip(weights, grads, first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g**2 - b)
                    w -= now * (a / (1 - 0.9**n)) / (np.sqrt(b / (1 - 0.999**n)) + 1e-7)
        for d in self.ways:
            d.trace = []

    def content(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block of each page is content; pages of like length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        for own in like_length([len(p) for p in pages], list(range(len(pages))), 256):
            _, p = self.forward(*padded([pages[k] for k in own]))
            for j, k in enumerate(own):
                out[k] = p[: len(pages[k]), j] >= 0.5
        return out


# Elements of content and of what surrounds it, under which training shows pages; * stands for a made-up name.
CONTENT_NAMES = ("article", "main", "div.content", "div.post", "section.story", "div.entry", "div.*", "section.*", "div", "div.* div.*")
MENU, NOTICE, ADVERT = ("nav", "div.menu", "header", "div.*", "ul.*"), ("div.cookie", "div.notice", "dialog", "div.*", "section.*"), ("div.ad", "div.advert", "aside", "div.banner", "div.*")
COMMENTS, RELATED, FOOT, FORM = ("section.comments", "div.comments", "ol.comments", "div.*", "section.*", "ul.*"), ("aside", "div.related", "div.sidebar", "div.*", "section.*"), ("footer", "div.footer", "div.*"), ("form", "div.newsletter", "form.*")


def wrapped(inner: list[str], name: str, made_up) -> list[str]:
    """HTML pieces inside the elements of a name."""
    for one in reversed(name.split()):
        tag, _, mark = one.partition(".")
        mark = made_up() if mark == "*" else mark
        inner = [f"<{tag} class='{mark}'>" if mark else f"<{tag}>", *inner, f"</{tag}>"]
    return inner


def rebuilt(page: Page, truth: list[bool], pool: list[str], rng: np.random.Generator) -> tuple[str, list[bool]]:
    """The page's content under another template, among foreign blocks, as HTML; and whether each of its blocks is content."""
    one = lambda x: x[int(rng.integers(len(x)))]
    made_up = lambda: "".join(one("abcdefghijklmnopqrstuvwxyz") for _ in range(int(rng.integers(3, 9))))
    some = lambda least, most: " ".join(one(pool).split()[: int(rng.integers(least, most))]) or "x"
    e = html.escape
    line = lambda tag, text: f"<{tag}>{e(text)}</{tag}>"
    link = lambda text: f"<a href='/{made_up()}'>{e(text)}</a>"

    def menu() -> list[str]:
        items = [link(some(1, 4)) for _ in range(int(rng.integers(3, 13)))]
        return wrapped([f"<li>{x}</li>" for x in items] if rng.random() < 0.7 else [f"<div>{x}</div>" for x in items], one(MENU), made_up)

    def notice() -> list[str]:
        return wrapped([line("p", some(5, 30)), *([line("button", some(1, 3))] if rng.random() < 0.6 else [])], one(NOTICE), made_up)

    def advert() -> list[str]:
        return wrapped([line("p", some(3, 15)) if rng.random() < 0.5 else f"<div>{link(some(2, 9))}</div>"], one(ADVERT), made_up)

    def related() -> list[str]:
        return wrapped([line("h3", some(1, 4)), *(f"<li>{link(some(3, 12))}</li>" for _ in range(int(rng.integers(2, 7))))], one(RELATED), made_up)

    def form() -> list[str]:
        return wrapped([line("label", some(1, 4)), "<input>", line("button", some(1, 3))], one(FORM), made_up)

    def foot() -> list[str]:
        return wrapped([line(one(("p", "div")), one(("© ", "Copyright ", "")) + str(int(rng.integers(1995, 2030))) + " " + some(2, 12)), *(f"<div>{link(some(1, 3))}</div>" for _ in range(int(rng.integers(0, 4))))], one(FOOT), made_up)

    def comments() -> list[str]:
        """A heading, and for each comment its writer, often a date, and a short text."""
        name, tag, dated, out = one(COMMENTS), one(("p", "div", "li", "blockquote")), rng.random() < 0.6, []
        for _ in range(int(rng.integers(1, 9))):
            out += [line(one(("b", "h4", "div", "cite")) if tag != "p" else "div", some(1, 3))] if rng.random() < 0.8 else []
            out += [line("div", f"{int(rng.integers(1, 29))}.{int(rng.integers(1, 13))}.{int(rng.integers(2000, 2030))}")] if dated else []
            out += [line(tag, some(2, 40))]
        return wrapped([line("h3", some(1, 4)), *out] if rng.random() < 0.6 else out, name, made_up)

    body: list[tuple[list[str], bool]] = []
    at, kept = 0, [(t, page.tag[n]) for t, n, yes in zip(page.text, page.node, truth, strict=True) if yes]
    while at < len(kept):
        text, tag = kept[at]
        kind = rng.random()
        if tag in ("h1", "h2", "h3") or kind < 0.6:
            body.append(([line(tag if tag in RUNNING - {"title", "td", "th", "li", "dd", "dt"} else "p", text)], True))
            at += 1
            continue
        n = int(rng.integers(1, 6))
        run = [t for t, _ in kept[at : at + n]]
        short = [" ".join(t.split()[: int(rng.integers(3, 30))]) for t in run] if rng.random() < 0.5 else run
        at += n
        how = one(("li", "li", "quote", "bare", "pre", "table", "dl", "div", "figure"))
        if how == "li":
            body.append(([f"<{(k := one(('ul', 'ol')))}>", *(line("li", t) for t in short), f"</{k}>"], True))
        elif how == "quote":
            body.append((["<blockquote>", *(line("p", t) for t in run), "</blockquote>"], True))
        elif how == "table":
            body.append((["<table>", *(f"<tr><td>{e(t)}</td><td>{e(some(1, 6))}</td></tr>" for t in short), "</table>"], True))
        elif how == "dl":
            body.append((["<dl>", *(f"<dt>{e(some(1, 4))}</dt><dd>{e(t)}</dd>" for t in short), "</dl>"], True))
        else:
            tag = {"bare": "blockquote", "pre": "pre", "div": "div", "figure": "figcaption"}[how]
            body.append(([line(tag, t) for t in short], True))
    for _ in range(int(rng.integers(0, 3)) * (1 + len(body) // 60)):
        body.insert(int(rng.integers(1, len(body) + 1)) if body else 0, (one((advert, notice, related))(), False))
    inside = [comments()] if rng.random() < 0.3 else []
    name = one(CONTENT_NAMES)
    first, last = wrapped(["\0"], name, made_up)[: name.count(" ") + 1], wrapped(["\0"], name, made_up)[-1 - name.count(" ") :]
    parts: list[tuple[list[str], bool]] = [(["<html><head>", line("title", some(2, 9)), "</head><body>"], False)]
    parts += [(f(), False) for f in (menu, notice, advert, form) if rng.random() < 0.55]
    parts += [(first, False), *body, *((x, False) for x in inside), (last, False)]
    parts += [(f(), False) for f in (advert, related, comments, form, comments, notice, foot) if rng.random() < 0.4]
    shown, labels = [], []
    for pieces, yes in parts:
        shown += pieces
        labels += [yes] * len(parse("".join(pieces)).text)
    return "".join(shown), labels


def training_pages(pages: list[str], templates: int = TEMPLATES, seed: int = 7) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Vectors and targets of the sampled pages as they are, and of each rebuilt under other templates."""
    rng = np.random.default_rng(seed)
    parsed = [p for p in map(parse, pages) if p.text]
    pool = [t for p in parsed for t in p.text]
    x, y = [], []
    for page in parsed:
        truth = targets(page)
        x.append(vectors(page))
        y.append(np.array(truth, np.float32))
        for _ in range(templates):
            shown, labels = rebuilt(page, truth, pool, rng)
            again = parse(shown)
            if len(again.text) == len(labels):  # else a block of one part ran into the next
                x.append(vectors(again))
                y.append(np.array(labels, np.float32))
    return x, y


def train_labeller(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> BlockLabeller:
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    ids = pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)  # bounded
    rows = pages.join(F.broadcast(ids), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).toPandas().sort_values("page_id")
    model = BlockLabeller()
    x, y = training_pages([h for h in rows.html if h])
    if x:
        model.fit(x, y)
    return model


def main_text(pages: DataFrame, model: BlockLabeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (content blocks in page order, an empty line between them) and n_chars, of every whole page."""
    sent = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def work():
        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [parse(p) for p in texts(part, "html")]
            hits = sent.value.content([vectors(p) for p in found])
            out = ["\n\n".join(t for t, hit in zip(p.text, own, strict=True) if hit) for p, own in zip(found, hits, strict=True)]
            return pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

        return each

    return map_text(rows, work, "page_id long, url string, text string, n_chars long", "html", 4 << 20)
