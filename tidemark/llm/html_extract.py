"""Main-text extraction: a linear-chain conditional random field over a page's leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags, each with its open ancestors (tags, and words
of their class, id and role). Emission features are ancestor words, hashed to a fixed number of columns, and bucketed
text statistics (length, link density, punctuation, place in the page); two labels, article and not,
have transition weights. The weights maximise the likelihood of labelled pages by gradient steps over the
forward-backward marginals; Viterbi decodes. The labelled pages are written by training_pages(): layouts whose
parts are labelled where they are made, filled with random words, so no row of the table is used for training.

A null or empty html, or one without article blocks, gives an empty text; malformed markup is read as far as it
goes, in time that grows with the page's length: unclosed tags are closed by their parents, a "<" before plain words is
text, a tag or comment that never ends takes the rest of the page; scripts, styles, comments,
templates, forms' controls and the title are no blocks (one that is never closed hides nothing, a script or style
hides the rest). Repeated rows are extracted one by one; extra columns are not looked at.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: tags that end a block, tags without content, tags whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video select button textarea title".split())
#: A skipped tag's content ends at its literal closing tag, whatever is before it.
END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in SKIPPED_TAGS}
SECTIONS = frozenset("article aside body details dialog div footer form header main nav section table".split())
#: Open tags that an opening tag closes if they are the innermost block; an open p ends at any block.
CLOSES = {
    "li": ("li",),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tr": ("td", "th", "tr"),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "option": ("option",),
}

NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
#: What a tag may hold before its end: plain characters, and values in quotes after a "=".
INSIDE = re.compile(r"[^<>=]+")
VALUE = re.compile(r"=\s*")
ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
READ = frozenset("class id role itemprop hidden aria-hidden".split())
HUMP = re.compile("([a-z])([A-Z])")
WORD = re.compile(r"[a-z]+")

#: Columns: ancestors' words, words of the nearest section, the block's own tag, its statistics.
WIDTH = 1 << 11
TAGS = {tag: 2 * WIDTH + i for i, tag in enumerate(sorted(BLOCK_TAGS))}
FIRST_STAT = 2 * WIDTH + len(TAGS)
SIZE = FIRST_STAT + 40
#: Decoding adds weights as whole numbers of this part of one, so that a sum that follows the open tags stays exact.
SCALE = 1 << 24


class Block:
    """A run of text, its own tag, how much of it is linked, and what its open ancestors add: their columns, or with
    the weights at hand only these columns' sums for both labels."""

    __slots__ = ("text", "tag", "linked", "columns", "sums")

    def __init__(self, text: str, tag: str, linked: int, columns: tuple[int, ...], sums: tuple[int, int]):
        self.text, self.tag, self.linked, self.columns, self.sums = text, tag, linked, columns, sums


_MEMO: dict[str, int] = {}


def _column(word: str) -> int:
    got = _MEMO.get(word)
    if got is None:
        h = zlib.crc32(word.encode())
        got = (h ^ h >> 15) % WIDTH
        if len(_MEMO) < 50_000:
            _MEMO[word] = got
    return got


def _words(tag: str, attributes: str) -> tuple[str, ...]:
    """What a tag says about its content: its name and the words of some attributes."""
    found = {f"<{tag}>": None}
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in READ:
                mark = name if "hidden" in name else ""
                if mark and not value:
                    found[mark] = None
                for w in WORD.findall(HUMP.sub(r"\1 \2", value).lower()):
                    found[f"{mark}.{w}"] = None
    return tuple(found)


class _Open:
    """The open tags of a page. What its blocks take from them (columns or their sums, nearest section, own tag, links)
    is kept up to date by each tag that opens or closes, so that no block looks through the stack."""

    def __init__(self, weights: list[tuple[int, int]] | None):
        self.weights = weights
        self.stack: list[tuple] = []  # tag, columns, nearest section's columns, their sums, place of the innermost block tag
        self.places: dict[str, list[int]] = {}
        self.active: dict[int, int] = {}
        self.sums = (0, 0)

    def _weigh(self, columns: list[int], sign: int, sums: tuple[int, int]) -> tuple[int, int]:
        if self.weights is None:
            return sums
        x, y = sums
        for c in columns:
            p, q = self.weights[c]
            x, y = x + sign * p, y + sign * q
        return x, y

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        above = self.stack[-1] if self.stack else ("", (), (), (0, 0), -1)
        columns = [_column(w) for w in words]
        near, near_sums = above[2:4]
        if tag in SECTIONS:
            if above[0]:
                columns.append(_column(f"{above[0]}>{tag}"))
            if tag != "div" or len(words) > 1:
                near = tuple({WIDTH + _column(f"near {w}") for w in words})
                near_sums = self._weigh(near, 1, (0, 0))
        place = len(self.stack) if tag in BLOCK_TAGS else above[4]
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, columns, near, near_sums, place))
        fresh = []
        for c in columns:
            held = self.active.get(c, 0)
            self.active[c] = held + 1
            if not held:
                fresh.append(c)
        self.sums = self._weigh(fresh, 1, self.sums)

    def pop(self) -> str:
        tag, columns = self.stack.pop()[:2]
        self.places[tag].pop()
        gone = []
        for c in columns:
            self.active[c] -= 1
            if not self.active[c]:
                del self.active[c]
                gone.append(c)
        self.sums = self._weigh(gone, -1, self.sums)
        return tag

    def made(self, text: str, linked: int) -> Block:
        near, near_sums = self.stack[-1][2:4] if self.stack else ((), (0, 0))
        columns = () if self.weights is not None else (*self.active, *near)
        return Block(text, self.block(), min(linked, len(text)), columns, (self.sums[0] + near_sums[0], self.sums[1] + near_sums[1]))

    def block(self) -> str:
        """The innermost open block tag."""
        place = self.stack[-1][4] if self.stack else -1
        return self.stack[place][0] if place >= 0 else "body"

    def close(self, tag: str) -> None:
        """An end tag closes the last open tag of its name; that of an inline tag closes no block."""
        at = self.places.get(tag)
        if at and (tag in BLOCK_TAGS or at[-1] > self.stack[-1][4]):
            last = at[-1]
            while len(self.stack) > last:
                self.pop()

    def make_room(self, tag: str) -> None:
        """Closes what an opening block tag closes."""
        ends = CLOSES.get(tag, ())
        while (held := self.block()) == "p" or held in ends:
            while self.pop() != held:
                pass

    def linked(self) -> bool:
        return bool(self.places.get("a"))


def _tag_end(page: str, at: int, lost: set[str]) -> tuple[int, int]:
    """(end of the attributes, where to go on) of the tag whose name ends at `at`; (-1, at) if it is text. `lost` keeps
    which quotes do not occur any more, so that a quote that is never closed is looked for once."""
    start, quoted = at, False
    while True:
        found = INSIDE.match(page, at)
        at = found.end() if found else at
        if at >= len(page):
            return (at, at) if quoted else (-1, at)
        if page[at] == ">":
            return at, at + 1
        if page[at] == "<":  # a new tag begins: this one ends here, unless it is plain words
            plain = not quoted and page[start:at].strip() not in ("", "/")
            return (-1, at) if plain else (at, at)
        quoted = True
        at = VALUE.match(page, at).end()
        mark = page[at : at + 1]
        if mark and mark in "\"'" and mark not in lost:
            end = page.find(mark, at + 1)
            if end < 0:
                lost.add(mark)
            at = end + 1 if end >= 0 else at + 1


def leaf_blocks(page: str | None, weights: list[tuple[int, int]] | None = None) -> list[Block]:
    """The blocks of a page in order, with white space collapsed and character references decoded; with the sums of
    weights instead of columns if these are given."""
    if not page:
        return []
    out: list[Block] = []
    opened = _Open(weights)
    parts: list[str] = []
    linked, lost, unclosed = 0, set(), set()

    def put(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            linked += len(piece) if opened.linked() else 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(opened.made(text, linked))
        linked = 0

    def behind(tag: str, at: int) -> int:
        """Where the content of a skipped tag has ended, -1 if it never does."""
        if tag in unclosed:
            return -1
        found = END[tag].search(page, at)
        if not found:
            unclosed.add(tag)
            return -1
        end = page.find(">", found.end())
        return end + 1 if end >= 0 else len(page)

    at = 0
    while (start := page.find("<", at)) >= 0:
        put(page[at:start])
        named = NAME.match(page, start + 1)
        if not named:
            if page.startswith("<!--", start):
                short = re.compile("-?>").match(page, start + 4)
                end = short.end() - 3 if short else page.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(page)
            elif page.startswith("<![CDATA[", start):
                end = page.find("]]>", start)
                at = end + 3 if end >= 0 else len(page)
            elif page[start + 1 : start + 2] in ("!", "?"):
                end = page.find(">", start)
                at = end + 1 if end >= 0 else len(page)
            else:
                put("<")
                at = start + 1
            continue
        stop, after = _tag_end(page, named.end(), lost)
        if stop < 0:
            put(page[start:after])
            at = after
            continue
        attributes, at = page[named.end() : stop], after
        closing = page[start + 1] == "/"
        tag = named[0].lstrip("/").lower()
        if tag in BLOCK_TAGS:
            flush()
        if closing:
            opened.close(tag)
        elif tag in SKIPPED_TAGS:
            end = at if attributes.rstrip().endswith("/") and tag not in ("script", "style") else behind(tag, at)
            at = len(page) if end < 0 and tag in ("script", "style") else max(at, end)
        elif tag not in VOID_TAGS:
            if tag in BLOCK_TAGS:
                opened.make_room(tag)
            opened.push(tag, _words(tag, attributes))
    put(page[at:])
    flush()
    return out


_LENGTHS = [2, 4, 8, 15, 30, 60]
_DENSITY = [0.01, 0.3, 0.6, 0.95]
_MARKS = [0, 1, 2, 4]


def _bucket(edges: list, value: float) -> int:
    return sum(value > e for e in edges)


def own_columns(blocks: list[Block]) -> list[list[int]]:
    """Active columns of each block itself: its tag and statistics."""
    out = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        marks = sum(b.text.count(c) for c in ".,;!?")
        columns = [TAGS[b.tag]]
        at = FIRST_STAT
        for edges, value in ((_LENGTHS, words), (_DENSITY, b.linked / len(b.text)), (_MARKS, marks), (_MARKS, b.text.count(". "))):
            columns.append(at + _bucket(edges, value))
            at += len(edges) + 1
        columns.append(at + min(4, 5 * i // n))
        at += 5
        if "©" in b.text or "(c)" in b.text.lower():
            columns.append(at)
        columns.append(at + 1)
        out.append(columns)
    return out


def features(blocks: list[Block]) -> list[list[int]]:
    """Active columns of each block, with those of its ancestors."""
    return [[*b.columns, *own] for b, own in zip(blocks, own_columns(blocks), strict=True)]


class Crf:
    """w (SIZE x 2 emissions), t (2 x 2 transitions) and s (2 starts)."""

    def __init__(self):
        self.w, self.t, self.s = np.zeros((SIZE, 2)), np.zeros((2, 2)), np.zeros(2)

    def emissions(self, columns: list[list[int]]) -> np.ndarray:
        heads = np.cumsum([0, *map(len, columns)])[:-1]
        return np.add.reduceat(self.w[np.concatenate([np.asarray(c, np.int64) for c in columns])], heads)

    def whole(self) -> Crf:
        """The same model with whole weights, in parts of 1 / SCALE, as lists."""
        out = Crf()
        out.w, out.t, out.s = ([tuple(r) for r in np.rint(self.w * SCALE).astype(int).tolist()], *(np.rint(x * SCALE).astype(int) for x in (self.t, self.s)))
        return out

    def decode(self, emissions: list) -> list[int]:
        """Viterbi over the blocks' emissions."""
        (t00, t01), (t10, t11) = self.t.tolist()
        s0, s1 = self.s.tolist()
        a, b = emissions[0][0] + s0, emissions[0][1] + s1
        back = []
        for x, y in emissions[1:]:
            fa, fb = a + t00 < b + t10, a + t01 < b + t11
            back.append((fa, fb))
            a, b = (b + t10 if fa else a + t00) + x, (b + t11 if fb else a + t01) + y
        path = [int(b > a)]
        for fa, fb in reversed(back):
            path.append(int(fb if path[-1] else fa))
        return path[::-1]

    def gradient(self, pages: list[tuple[list[list[int]], list[int]]]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """The log-likelihood of the pages (columns and labels of the blocks) and its gradient by w, t and s, from the
        marginals of the forward and backward sums of all pages at once."""
        size = np.array([len(labels) for _, labels in pages])
        p, n = len(pages), int(size.max())
        inside = np.arange(n) < size[:, None]
        columns = [np.asarray(c, np.int64) for page, _ in pages for c in page]
        e, y = np.zeros((p, n, 2)), np.zeros((p, n), np.int64)
        e[inside] = self.emissions(columns)
        y[inside] = np.concatenate([labels for _, labels in pages])
        forward, backward = np.zeros((p, n, 2)), np.zeros((p, n, 2))
        forward[:, 0] = self.s + e[:, 0]
        for i in range(1, n):
            forward[:, i] = e[:, i] + np.logaddexp(forward[:, i - 1, :1] + self.t[0], forward[:, i - 1, 1:] + self.t[1])
        for i in range(n - 2, -1, -1):
            after = e[:, i + 1] + backward[:, i + 1]
            before = np.logaddexp(self.t[:, 0] + after[:, :1], self.t[:, 1] + after[:, 1:])
            backward[:, i] = np.where((i < size - 1)[:, None], before, 0)
        row = np.arange(p)
        last = forward[row, size - 1]
        total = np.logaddexp(last[:, 0], last[:, 1])
        share = np.exp(forward + backward - total[:, None, None])
        truth = np.eye(2)[y]
        rest = (truth - share)[inside]
        flat, counts = np.concatenate(columns), [len(c) for c in columns]
        gw = np.stack([np.bincount(flat, np.repeat(rest[:, k], counts), SIZE) for k in (0, 1)], 1)
        both = inside[:, 1:]
        moves = np.exp(forward[:, :-1, :, None] + self.t + (e + backward)[:, 1:, None, :] - total[:, None, None, None])
        seen = truth[:, :-1, :, None] * truth[:, 1:, None, :]
        score = (e * truth)[inside].sum() + self.s[y[:, 0]].sum() + (seen[both] * self.t).sum() - total.sum()
        return float(score), gw, (seen - moves)[both].sum(0), (truth - share)[:, 0].sum(0)

    def fit(self, pages: list[tuple[list[list[int]], list[int]]], rounds: int = 15, rate: float = 0.1, decay: float = 1e-4, seed: int = 3) -> Crf:
        rng = random.Random(seed)
        theta = [self.w, self.t, self.s]
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in theta]
        step = 0
        for _ in range(rounds):
            order = list(range(len(pages)))
            rng.shuffle(order)
            for at in range(0, len(order), 20):
                grads = self.gradient([pages[i] for i in order[at : at + 20]])[1:]
                step += 1
                for x, g, (m, v) in zip(theta, grads, moments, strict=True):
                    g = g / 20 - decay * x
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


# --------------------------------------------------------------------------- labelled pages

# Names that sites give to the parts of a page.
_ARTICLE = ["article", "post", "entry content", "post content", "article body", "story", "main content", "content", "text", "prose", "body copy", ""]
_OTHER = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "main nav", "topnav", "pagination", "toc", "skip link", "tabs", ""],
    "header": ["header", "masthead", "site header", "top bar", "banner", "logo", "site title", "branding", "tagline", ""],
    "footer": ["footer", "site footer", "copyright", "bottom", "colophon", "legal", "foot", ""],
    "aside": ["sidebar", "widget", "related", "recommended", "promo", "trending", "popular", "rail", "newsletter", "about author", "tags", "share", "social", ""],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "banner ad", "promo", "adsbygoogle", "ad slot", "promoted"],
    "notice": ["cookie", "cookie notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "subscribe", "paywall", "cookie banner", "disclaimer"],
    "form": ["search", "login", "signup", "newsletter form", "contact", "subscribe form", "comment form", ""],
    "comments": ["comments", "comment list", "comment", "replies", "disqus", "discussion", "user comments", "respond", "comment body", "reader comments"],
}


class _Writer:
    """A page in the making: markup, and the label of each block it makes."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []
        self.syllables = ["".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") for _ in range(1)) + rng.choice(["", "n", "r", "s", "t"]) for _ in range(60)]

    def words(self, n: int) -> str:
        rng = self.rng
        out = ["".join(rng.choice(self.syllables) for _ in range(rng.choice([1, 1, 2, 2, 3]))) for _ in range(n)]
        for i in range(len(out)):
            if i == 0 or out[i - 1].endswith("."):
                out[i] = out[i].capitalize()
            if rng.random() < 0.1:
                out[i] += rng.choice([".", ".", ",", ";", "!"])
        return " ".join(out) + rng.choice([".", ".", ""])

    def attribute(self, names: list[str]) -> str:
        name = self.rng.choice(names)
        if not name:
            return ""
        joined = self.rng.choice(["-", "_", " "]).join(name.split())
        return f' {self.rng.choice(["class", "class", "id"])}="{joined}"'

    def block(self, tag: str, text: str, label: int, inner: str = "") -> None:
        self.html.append(f"<{tag}>{inner}{text}" + ("" if tag == "br" else f"</{tag}>"))
        self.labels.append(label)

    def links(self, n: int) -> None:
        for _ in range(n):
            self.block("li", f'<a href="/x">{self.words(self.rng.choice([1, 1, 2, 3]))}</a>', 0)

    def part(self, kind: str) -> None:
        rng = self.rng
        named = self.attribute(_OTHER[kind])
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        if kind in ("ad", "notice", "comments") or rng.random() < 0.5 and named:
            tag = "div" if rng.random() < 0.8 else "section"
            named = self.attribute([x for x in _OTHER[kind] if x])
        if rng.random() < 0.1 and kind in ("nav", "header", "footer"):
            named += f' role="{dict(nav="navigation", header="banner", footer="contentinfo")[kind]}"'
        self.html.append(f"<{tag}{named}>")
        if kind == "nav":
            self.html.append("<ul>")
            self.links(rng.randint(2, 8))
            self.html.append("</ul>")
        elif kind == "header":
            self.block(rng.choice(["h1", "div", "p", "h2"]), self.words(rng.randint(1, 6)), 0)
            if rng.random() < 0.4:
                self.block("p", self.words(rng.randint(3, 12)), 0)
        elif kind == "footer":
            if rng.random() < 0.3:
                self.html.append("<ul>")
                self.links(rng.randint(1, 5))
                self.html.append("</ul>")
            text = rng.choice(["&copy; ", "&copy; 2020 ", "(c) ", ""]) + self.words(rng.randint(2, 25))
            if rng.random() < 0.5:
                self.html.append(text)
                self.labels.append(0)
            else:
                self.block(rng.choice(["p", "div", "small"]), text, 0)
        elif kind in ("ad", "notice"):
            if rng.random() < 0.6:
                self.html.append(self.words(rng.randint(2, 20)))
                self.labels.append(0)
            else:
                for _ in range(rng.randint(1, 2)):
                    self.block("p", self.words(rng.randint(3, 30)), 0)
        elif kind == "form":
            self.html.append('<input name="q">')
            self.block("label" if rng.random() < 0.5 else "p", self.words(rng.randint(1, 6)), 0)
            self.html.append("<button>go</button>")
        elif kind == "comments":
            self.block(rng.choice(["h2", "h3"]), self.words(2), 0)
            for _ in range(rng.randint(1, 5)):
                self.html.append(f"<div{self.attribute(['comment', 'comment body', 'reply', ''])}>")
                self.block(rng.choice(["p", "p", "div"]), self.words(rng.randint(4, 60)), 0)
                self.html.append("</div>")
        else:
            self.block(rng.choice(["h2", "h3", "h4", "p"]), self.words(rng.randint(1, 4)), 0)
            if rng.random() < 0.6:
                self.html.append("<ul>")
                self.links(rng.randint(2, 6))
                self.html.append("</ul>")
            else:
                self.block("p", self.words(rng.randint(4, 40)), 0)
        self.html.append(f"</{tag}>")

    def article(self) -> None:
        rng = self.rng
        outer = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
        bare = outer == "div" and rng.random() < 0.3
        named = "" if bare else self.attribute(_ARTICLE if outer in ("article", "main") else [x for x in _ARTICLE if x])
        loose = bare and rng.random() < 0.5  # straight in the body
        self.html.append("" if loose else f"<{outer}{named}>")
        inner = rng.random() < 0.3 and not bare
        if inner:
            self.html.append(f"<div{self.attribute(_ARTICLE)}>")
        headed = rng.random() < 0.15
        if rng.random() < 0.8:
            self.html.append("<header>" if headed else "")
            self.block("h1", self.words(rng.randint(1, 12)), 1)
            self.html.append("</header>" if headed else "")
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.7:
                text = self.words(rng.choice([1, 2, 3, 5, 20, 40, 80, 120]))
                self.block("p", text, 1, rng.choice(["", "", "", '<a href="/y">' + self.words(2) + "</a> "]))
            elif kind < 0.78:
                self.block(rng.choice(["h2", "h3"]), self.words(rng.randint(1, 6)), 1)
            elif kind < 0.86:
                self.html.append("<ul>")
                for _ in range(rng.randint(2, 4)):
                    self.block("li", self.words(rng.randint(2, 20)), 1)
                self.html.append("</ul>")
            elif kind < 0.9:
                self.html.append("<blockquote>")
                self.block("p", self.words(rng.randint(4, 40)), 1)
                self.html.append("</blockquote>")
            elif kind < 0.94:
                self.html.append("<p><b>" + self.words(rng.randint(3, 60)) + "<br>")
                self.labels.append(1)
            elif kind < 0.97:
                self.part(rng.choice(["ad", "aside", "form", "notice"]))
            else:
                self.html.append("<table><tr>")
                for _ in range(3):
                    self.block("td", self.words(rng.randint(1, 4)), 1)
                self.html.append("</tr></table>")
        if inner:
            self.html.append("</div>")
        self.html.append("" if loose else f"</{outer}>")

    def short_article(self) -> None:
        """An article of one to three blocks, in a section of its own or straight in the page."""
        rng = self.rng
        outer = rng.choice(["article", "main", "div", "section", "", "", "both"])
        self.html.append("<main><article>" if outer == "both" else f"<{outer}{self.attribute(_ARTICLE)}>" if outer else "")
        if rng.random() < 0.35:
            self.block(rng.choice(["h1", "h1", "h2"]), self.words(rng.randint(1, 10)), 1)
        if not outer and rng.random() < 0.4:
            self.html.append(self.words(rng.choice([4, 12, 30, 80])))
            self.labels.append(1)
        else:
            for _ in range(rng.choice([1, 1, 2, 3])):
                self.block("p", self.words(rng.choice([3, 8, 15, 25, 40, 80])), 1)
        self.html.append("</article></main>" if outer == "both" else f"</{outer}>" if outer else "")


def training_pages(n: int = 1000, seed: int = 11) -> list[tuple[str, list[int]]]:
    """(html, label of each leaf block) of n pages of varied layout; some are an article with little or nothing around."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        page = _Writer(rng)
        bare = rng.random() < 0.25
        page.html.append(rng.choice(["", "<body>", "<html><body>"]) if bare else "<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>")
        wrapped = rng.random() < (0.15 if bare else 0.4)
        if wrapped:
            page.html.append(f'<div{page.attribute(["wrapper", "page", "container", "site", "layout", "row", "app"])}>')
        around = rng.choice([0, 0.5, 0.8]) if bare else 1
        for kind in ("notice", "header", "nav", "form", "ad", "aside"):
            if rng.random() < around * {"header": 0.5, "nav": 0.8, "ad": 0.5, "notice": 0.3}.get(kind, 0.2):
                page.part(kind)
        if bare:
            page.short_article()
        elif rng.random() < 0.97:
            page.article()
        for kind in ("comments", "aside", "ad", "nav", "form", "footer", "notice"):
            if rng.random() < around * {"footer": 0.85, "comments": 0.35, "ad": 0.25}.get(kind, 0.2):
                page.part(kind)
        if wrapped:
            page.html.append("</div>")
        page.html.append("" if bare else "</body></html>")
        text = "".join(page.html)
        if page.labels and len(leaf_blocks(text)) == len(page.labels):
            out.append((text, page.labels))
    return out


def train(pages: list[tuple[str, list[int]]] | None = None) -> Crf:
    pages = training_pages() if pages is None else pages
    return Crf().fit([(features(leaf_blocks(text)), labels) for text, labels in pages])


def main_text(model: Crf, page: str | None) -> str:
    """The text of the blocks that the model, as whole() gives it, labels as article."""
    blocks = leaf_blocks(page, model.w)
    if not blocks:
        return ""
    emissions = []
    for b, own in zip(blocks, own_columns(blocks), strict=True):
        x, y = b.sums
        for c in own:
            p, q = model.w[c]
            x, y = x + p, y + q
        emissions.append((x, y))
    return "\n".join(b.text for b, label in zip(blocks, model.decode(emissions), strict=True) if label)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """Per row of pages(page_id, url, html): page_id, url, text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast((model or train()).whole())
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(shared.value, page.as_py()) for page in part.column("html")]
                yield pa.RecordBatch.from_pydict(
                    {
                        "page_id": part.column("page_id"),
                        "url": part.column("url"),
                        "text": pa.array(texts, pa.string()),
                        "n_chars": pa.array([len(x) for x in texts], pa.int64()),
                    }
                )

    schema = rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return rows.mapInArrow(run, schema)
