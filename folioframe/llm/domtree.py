"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element of a page is a node that is content or not. A node's own potential is a linear function of its
features (tag, words of its class and id, those of its ancestors, text length, share of link text, marks, depth and
place); each edge adds a potential of the two states of parent and child, by the child's kind of tag. Sum-product
messages pass upward from the leaves and downward from the root, which gives exact content marginals. Weights and
edge potentials are learned by gradient ascent on the likelihood of labelled pages, whose gradient is the difference
between the labels and those marginals.

Labelled pages: pages of the corpus that mark their main text themselves (one ``article`` or ``main`` element), at
most ``PAGES`` of them, each once more without names and marking tags, and layouts made of the same pages' blocks and
of further kinds of page parts (side bars, comments, notices, forms, adverts), whose names are known, invented or
absent. So the model learns to do without tags and names, by text, links, marks, place and share of the page's text.

Text: character references are decoded, white space within a block is one space, blocks are trimmed, empty ones
left out, and the rest joined in page order by two line breaks.

Rows: null html is an empty page; pages without content have empty text and 0 characters. Markup may be broken:
unclosed elements end with their parents. Repeated rows give repeated rows. Only the three named columns are read.
Where no page of a corpus marks its main text, the layouts are made of the blocks of any pages, so that what is known
of tags and of common names still tells menus and footers from content. Text in script, style, textarea, select, title,
iframe, template, svg and button elements is none of the page (left open, they end with their parents); that of noscript, math and (undecoded) xmp elements is.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.shared import blocks

#: Training pages of the corpus, rounds of training, size of the hashed weights.
PAGES, ROUNDS, WEIGHTS = 250, 160, 1 << 14
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*\Z", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACE = re.compile(r"\s+")

# Fixed values of HTML: elements without content, of left-out content, those of them without markup inside (with their
# closing tags), of inline level, and those that end an open <p>.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template svg select button".split())
LITERAL = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.IGNORECASE) for t in "script style textarea title iframe xmp".split()}
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label map mark meter nobr object output picture progress q rp rt ruby s samp slot small span strike strong sub sup time tt u var video".split())
FORMULA = frozenset("math merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Start tags at which a drawing ends, though it wasn't closed, unless they stand in one of its parts that hold text.
ENDS_DRAWING = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_TEXT = ("foreignobject", "desc", "title")
#: Kinds of child tags that have edge potentials of their own.
EDGE_KINDS = {t: k for k, t in enumerate("? div section p h li article main aside nav header footer form table td ul blockquote".split())}


#: Elements nested deeper become siblings there, as browsers do it; distinct names of ancestors that a node sees, nearest first.
DEEPEST, ABOVE = 512, 32


def is_inline(tag: str) -> bool:
    """Elements of running text; those of unknown names with a hyphen, which are custom elements, are of that kind too."""
    return tag in INLINE or tag in FORMULA or "-" in tag


class Page:
    """Nodes in page order: tag, parent, depth, names, whether in a link, and the texts between tags with their nodes.

    Time is in proportion to the source: what is open is also held by tag, and its blocks apart.
    """

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.depth, self.names, self.in_link = ["#root"], [-1], [0], [()], [False]
        self.pieces: list[tuple[int, int, str]] = []  # (node, block, text)
        self.n_blocks = 1
        stack, block, at, raw = [0], 0, 0, None
        within: dict[str, int] = {}  # open elements of a left-out one, itself included
        open_at: dict[str, list[int]] = {}  # places in the stack of the open elements of a tag
        open_blocks: list[int] = []  # and of those that aren't inline

        def new_block() -> int:
            self.n_blocks += 1
            return self.n_blocks - 1

        def cut(k: int) -> None:
            while len(stack) > k:
                tag = self.tag[stack.pop()]
                open_at[tag].pop()
                if open_blocks and open_blocks[-1] == len(stack):
                    open_blocks.pop()

        def last(tags: set[str]) -> int:
            return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

        look = 0  # where the next token is looked for
        while m := TOKEN.search(source, look):
            look = m.end()
            tag, closing = (m.group(1) or "").lower(), m.group().startswith("</")
            attributes = m.group(2) or ""
            inside = raw is not None
            if inside and tag not in LITERAL:
                if closing and within.get(tag):
                    within[tag] -= 1
                    if tag == raw and not within[tag]:
                        at, raw = look, None
                    continue
                if closing and open_at.get(tag) or raw == "svg" and not closing and tag in ENDS_DRAWING and not any(within.get(t) for t in HOLDS_TEXT):
                    at, raw, inside = m.start(), None, False  # left out elements end with their parents
                elif not closing and tag and tag not in VOID and not attributes.rstrip().endswith("/"):
                    within[tag] = within.get(tag, 0) + 1
            literal = None
            if tag in LITERAL and not closing and not attributes.rstrip().endswith("/"):
                # no markup up to the closing tag, whatever stands there
                end = LITERAL[tag].search(source, look)
                literal = source[look : end.start() if end else len(source)]
                look = end.end() if end else len(source)
            if inside:
                continue
            if m.start() > at:
                self.pieces.append((stack[-1], block, source[at : m.start()]))
            at = look
            if m.group(1) is None:
                continue
            inline = is_inline(tag)
            if closing:
                if open_at.get(tag):
                    k = open_at[tag][-1]
                    if inline and open_blocks and open_blocks[-1] > k:
                        continue  # a misnested inline element ends with the block that it began in
                    cut(k)
                    if not inline:
                        block = new_block()
                elif not inline:
                    block = new_block()
                continue
            if tag == "br" or tag == "wbr":
                self.pieces.append((stack[-1], block, " " if tag == "br" else ""))
                continue
            if tag in VOID:
                if tag == "hr":
                    block = new_block()
                continue
            if tag in ENDS_P and open_blocks and self.tag[stack[open_blocks[-1]]] == "p":
                cut(open_blocks[-1])
            if tag in CLOSES:
                ends, bar = CLOSES[tag]
                if last(ends) > last(bar):
                    cut(last(ends))
            if tag in RAW:
                if tag not in LITERAL and not attributes.rstrip().endswith("/"):
                    raw, within = tag, {tag: 1}
                continue
            names = tuple(p.lower() for a in ATTRIBUTE.finditer(attributes) for p in NAME_PART.findall(a.group(2) or a.group(3) or a.group(4) or "")) if attributes else ()
            if attributes and HIDDEN.search(attributes):
                names += ("#hidden",)
            parent = stack[-1] if self.depth[stack[-1]] < DEEPEST else self.parent[stack[-1]]
            self.tag.append(tag)
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
            self.names.append(names)
            self.in_link.append(tag == "a" or self.in_link[parent])
            if tag == "xmp":  # its source is its text
                if literal:
                    self.pieces.append((len(self.tag) - 1, new_block(), entities.escape(literal)))
                block = new_block()
                continue
            open_at.setdefault(tag, []).append(len(stack))
            if not inline:
                open_blocks.append(len(stack))
            stack.append(len(self.tag) - 1)
            if not inline and not attributes.rstrip().endswith("/"):
                block = new_block()
        if raw is None and at < len(source):
            self.pieces.append((stack[-1], block, source[at:]))


def _hash(feature: str) -> int:
    """The slot of a feature; the same in every process."""
    h = 2166136261
    for b in feature.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % WEIGHTS


class Slots(dict):
    def __missing__(self, feature: str) -> int:
        if len(self) > 200_000:
            self.clear()
        out = self[feature] = _hash(feature)
        return out


def _bucket(x: np.ndarray) -> np.ndarray:
    return np.where(x < 1e6, np.log2(np.minimum(x, 1e6) + 1) * 1.5, 30).astype(np.int64)


def _above(page: Page, slots: Slots) -> list[tuple[int, ...]]:
    """Slots of the names and tags of each node's ancestors, nearest first."""
    out: list[tuple[int, ...]] = [()]
    for k in range(1, len(page.tag)):
        p = page.parent[k]
        new = dict.fromkeys([slots[f"a:{x}"] for x in page.names[p]] + [slots[f"a:{page.tag[p]}"]])
        out.append(out[p] if all(x in out[p] for x in new) else tuple(dict.fromkeys([*new, *out[p]]))[:ABOVE])
    return out


class Forest:
    """The nodes of several pages, level by level, for messages over all of them at once."""

    def __init__(self, pages: list[Page], slots: Slots) -> None:
        sizes = [len(p.tag) for p in pages]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64).tolist()
        n = self.first[-1]
        base = np.repeat(self.first[:-1], sizes).astype(np.int64)
        parent = np.array([x for p in pages for x in p.parent], np.int64)
        self.parent = np.where(parent >= 0, parent + base, -1)
        depth = np.array([x for p in pages for x in p.depth], np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:] if n else []
        tags = ["h" if len(t) == 2 and t[0] == "h" and t[1].isdigit() else t for p in pages for t in p.tag]
        names, tag = np.unique(np.array(tags, object), return_inverse=True) if n else (np.zeros(0, object), np.zeros(0, np.int64))
        self.kind = np.array([EDGE_KINDS.get(t, 0) for t in names], np.int64)[tag] if n else tag
        # sizes of texts, in a node and under it
        node = np.array([b + x for p, b in zip(pages, self.first, strict=False) for x, _, _ in p.pieces], np.int64)
        of = [t for p in pages for _, _, t in p.pieces]
        own = np.bincount(node, [len(t) for t in of], n)
        text, marks = own.copy(), np.bincount(node, [t.count(".") + t.count(",") for t in of], n)
        link = own * np.array([x for p in pages for x in p.in_link], float)
        for nodes in reversed(self.levels):
            for x in (text, link, marks):
                np.add.at(x, self.parent[nodes], x[nodes])
        kids = np.bincount(self.parent[self.parent >= 0], minlength=n)
        before = np.cumsum(own) - own
        at = (before - before[base]) / np.maximum(text[base], 1) if n else own
        some = np.maximum(text, 1)
        table = lambda family, x: np.array([slots[f"{family}:{v}"] for v in range(int(x.max(initial=0)) + 1)], np.int64)[x]
        whole = lambda x: np.maximum(x, 0).astype(np.int64)
        by_tag = np.array([[slots[f"t+link:{t}:{v}"] for v in range(3)] for t in names], np.int64).reshape(-1, 3)
        fixed = [np.full(n, slots["bias"]), np.array([slots[f"t:{t}"] for t in names], np.int64)[tag] if n else tag]
        for family, x in (("len", _bucket(text)), ("own", _bucket(own)), ("link", whole(4 * link / some)), ("marks", _bucket(100 * marks / some)), ("depth", np.minimum(depth, 8)), ("at", whole(5 * at)), ("kids", _bucket(kids))):
            fixed.append(table(family, x))
        fixed.append(by_tag[tag, whole(2 * link / some)])
        plain = text - link  # how much of the running text of the page, and of its parent, is here
        above = np.maximum(self.parent, 0)
        paragraphs = np.bincount(self.parent[(self.parent >= 0) & np.isin(names[tag], ["p"])], minlength=n)
        whose = (("part", 10 * plain / np.maximum(plain[base], 1)), ("of", 5 * plain / np.maximum(plain[above], 1)), ("p", np.minimum(paragraphs, 6)), ("p+", np.minimum(paragraphs[above], 6)), ("rest", _bucket((plain[above] - plain).clip(0))))
        for family, x in whose if n else ():
            fixed.append(table(family, whole(x)))
        named = [[*(slots[f"n:{x}"] for x in names), *above] for p in pages for names, above in zip(p.names, _above(p, slots), strict=True)]
        self.slot = np.concatenate([*fixed, np.fromiter(itertools.chain.from_iterable(named), np.int64)])
        self.of = np.concatenate([np.tile(np.arange(n), len(fixed)), np.repeat(np.arange(n), [len(x) for x in named])]).astype(np.int64)

    def marginals(self, weight: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and P(parent's state, own state) of each node but roots (node, 2, 2).

        Messages are logarithms; upward from the deepest level, then downward.
        """
        n = len(self.kind)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.of, weight[self.slot], n)
        up, sent = own.copy(), np.zeros((n, 2))
        for nodes in reversed(self.levels):
            sent[nodes] = np.logaddexp.reduce(edge[self.kind[nodes]] + up[nodes][:, None, :], axis=2)
            np.add.at(up, self.parent[nodes], sent[nodes])
        down = np.zeros((n, 2))
        joint = np.zeros((n, 2, 2))
        for nodes in self.levels:
            rest = down[self.parent[nodes]] + up[self.parent[nodes]] - sent[nodes]
            both = rest[:, :, None] + edge[self.kind[nodes]]
            message = np.logaddexp.reduce(both, axis=1)
            down[nodes] = message - message.max(1, keepdims=True)
            both = both + up[nodes][:, None, :]
            both -= both.max((1, 2), keepdims=True)
            joint[nodes] = np.exp(both)
        joint /= np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)
        belief = up + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


class Model:
    def __init__(self) -> None:
        self.weight, self.edge = np.zeros(WEIGHTS), np.zeros((len(EDGE_KINDS), 2, 2))


def train(labelled: list[tuple[Page, np.ndarray]], rounds: int = ROUNDS, decay: float = 2e-4, rate: float = 0.15) -> Model:
    """Fit to pages with 0/1 labels of their nodes, by gradient steps scaled by past squares."""
    model = Model()
    if not labelled:
        return model
    forest = Forest([p for p, _ in labelled], Slots())
    y = np.concatenate([t for _, t in labelled]).astype(float)
    inner = np.flatnonzero(forest.parent >= 0)
    a, b = y[forest.parent[inner]].astype(int), y[inner].astype(int)
    seen = np.zeros_like(model.edge)
    np.add.at(seen, (forest.kind[inner], a, b), 1)
    n = len(y)
    squares = [np.full_like(model.weight, 1e-8), np.full_like(model.edge, 1e-8)]
    for _ in range(rounds):
        p, joint = forest.marginals(model.weight, model.edge)
        told = np.zeros_like(model.edge)
        np.add.at(told, forest.kind[inner], joint[inner])
        for w, s, d in ((model.weight, squares[0], np.bincount(forest.slot, (y - p)[forest.of], WEIGHTS) / n), (model.edge, squares[1], (seen - told) / n)):
            d = d - decay * w / 10
            s += d * d
            w += rate * d / np.sqrt(s)
    return model


def extract(page: Page, content: np.ndarray) -> str:
    """The text of the blocks whose text stands in content nodes."""
    out: list[str] = []
    last, parts = -1, []
    for node, block, text in page.pieces:
        if block != last:
            out.append("".join(parts))
            last, parts = block, []
        if content[node]:
            parts.append(text)
    out.append("".join(parts))
    return "\n\n".join(t for t in (SPACE.sub(" ", entities.unescape(x)).strip() for x in out) if t)


def self_labelled(page: Page) -> np.ndarray | None:
    """Labels of a page with one article, or else one main element, that stands in no other; None for other pages.

    Navigation, asides, footers, forms and reader comments (articles within the article, or parts named so) are not
    content, nor are headers, but those that hold the heading.
    """
    n = len(page.tag)
    within = [False] * n
    titled = [False] * n
    for k in range(1, n):
        within[k] = within[page.parent[k]] or page.tag[page.parent[k]] == "article"
    for k in range(n - 1, 0, -1):
        titled[page.parent[k]] |= titled[k] or len(page.tag[k]) == 2 and page.tag[k][0] == "h" and page.tag[k][1].isdigit()
    mains = [k for k, t in enumerate(page.tag) if t == "article" and not within[k]] or [k for k, t in enumerate(page.tag) if t == "main"]
    if len(mains) != 1:
        return None
    y = np.zeros(n, np.int8)
    for k in range(mains[0], n):
        p, tag = page.parent[k], page.tag[k]
        out = tag in ("nav", "aside", "footer", "form", "article") or tag == "header" and not titled[k] or not COMMENT_NAMES.isdisjoint(page.names[k])
        y[k] = k == mains[0] or (p >= mains[0] and y[p] and not out)
    return y


#: Parts of class names and ids that name reader comments.
COMMENT_NAMES = frozenset("comment comments discussion disqus replies reply respond".split())
# Names of page parts, in the words that style sheets commonly use; the first row names content.
CONTENT_NAMES = ["content", "post-content", "entry-content", "article-body", "main-content", "story", "post", "text", "body", "articleText"]
PARTS = {
    "nav": ["menu", "nav", "navbar", "breadcrumb", "pagination", "topnav", "links", "toc"],
    "side": ["sidebar", "widget", "related", "popular", "aside", "tags", "recommended", "archive"],
    "head": ["header", "site-header", "banner", "masthead", "logo", "topbar", "branding"],
    "foot": ["footer", "site-footer", "copyright", "legal", "bottom", "colophon"],
    "notice": ["cookie", "notice", "consent", "gdpr", "alert", "popup", "modal", "warning", "newsletter", "subscribe"],
    "ad": ["ad", "ads", "advert", "sponsor", "promo", "promotion", "sponsored", "banner-ad", "advertisement"],
    "comments": ["comments", "comment", "comment-list", "discussion", "replies", "reply", "respond", "reader-comments", "disqus"],
    "form": ["search", "login", "contact-form", "signup", "form"],
    "share": ["share", "social", "share-buttons", "author-box", "meta"],
}


#: Syllables of the invented names that the parts of some layouts bear.
SYLLABLES = "ba ko ti ru le mo sa ne vi du pro gan hel zit quo wex".split()


def anonymous(page: Page, rng: np.random.Generator) -> Page:
    """The page without its names, its telling tags as plain ones (those of menus and the like in part)."""
    out = Page("")
    out.__dict__ |= page.__dict__
    plain = {"article", "main", *(t for t in ("nav", "aside", "header", "footer", "section") if rng.random() < 0.3)}
    out.names = [tuple(x for x in names if x == "#hidden") for names in page.names]
    out.tag = ["div" if t in plain else t for t in page.tag]
    return out


def relaid(texts: list[str], rng: np.random.Generator) -> tuple[Page, np.ndarray]:
    """A page made of the blocks ``texts``, part of them as content and part in other page parts; its labels.

    Names are those that style sheets use in two fifths of the pages, invented ones in others, and absent in the rest;
    the content is in an element that marks it, a plain one, or none of its own.
    """
    safe = [entities.escape(t[:400]) for t in texts if t.strip()] or ["text"]
    naming = rng.choice(["known", "known", "invented", "none", "none"])
    invented = lambda: "".join(rng.choice(SYLLABLES, int(rng.integers(2, 5))))
    pick = lambda: safe[rng.integers(len(safe))]
    words = lambda k: " ".join(pick().split()[:k]) or "x"

    def named(known: list[str]) -> str:
        if naming == "none":
            return ""
        return f' {rng.choice(["class", "id"])}="{rng.choice(known) if naming == "known" else invented()}"'

    mark = lambda kind: named(PARTS[kind])
    links = lambda k: "<ul>" + "".join(f'<li><a href="/x">{words(3)}</a></li>' for _ in range(k)) + "</ul>"

    def part(kind: str) -> str:
        semantic = {"nav": "nav", "side": "aside", "head": "header", "foot": "footer", "form": "form"}.get(kind)
        # what has neither a telling tag nor a name can only be told by its links, place and length
        tag = semantic if semantic and (rng.random() < 0.6 or kind == "form") else rng.choice(["div", "section"])
        names = "" if tag == semantic and rng.random() < 0.5 else mark(kind)
        told = tag == semantic or naming == "known"
        k = int(rng.integers(1, 5))
        inside = {
            "nav": lambda: links(k + 2),
            "side": lambda: f"<h3>{words(3)}</h3>" + (links(k) if rng.random() < 0.6 or not told else f"<p>{pick()}</p>"),
            "head": lambda: f"<a href='/'>{words(3)}</a>" + (links(k) if rng.random() < 0.5 else f"<p>{words(8)}</p>"),
            "foot": lambda: f"<p>&copy; {words(6)}</p>" + (links(k) if rng.random() < 0.5 else ""),
            "notice": lambda: f"<p>{pick() if told else words(8)}</p><button>{words(1)}</button>" if rng.random() < 0.5 or not told else pick(),
            "ad": lambda: rng.choice([pick(), f"<p>{words(12)}</p>", f"<a href='/ad'>{words(8)}</a>"]) if told else f"<a href='/ad'>{words(8)}</a>",
            "comments": lambda: f"<h3>{words(2)}</h3>" * int(rng.integers(2)) + "".join(f'<{t}{mark("comments")}><p>{pick()}</p></{t}>' for t in [rng.choice(["div", "li", "article"])] for _ in range(k)),
            "form": lambda: f"<label>{words(2)}</label><input><p>{words(6)}</p><button>{words(1)}</button>",
            "share": lambda: links(k) if rng.random() < 0.5 or not told else f"<span>{words(4)}</span>",
        }[kind]()
        return f'<{tag}{names} class="yyout">{inside}</{tag}>'

    def some(kinds: list[str], p: float) -> str:
        return "".join(part(k) for k in kinds if rng.random() < p and (k != "comments" or naming == "known"))

    def prose(text: str) -> str:
        """Running text, part of it in elements of that kind."""
        some = text.split()
        for _ in range(int(rng.integers(0, 3))):
            k, tag = int(rng.integers(len(some))) if some else 0, rng.choice(["b", "i", "em", "strong", "a", "code", "span", "u", "sup"])
            some[k : k + 1] = [f"<{tag}{' href=/y' if tag == 'a' else ''}>{x}</{tag}>" for x in some[k : k + 1]]
        return " ".join(some)

    bare = rng.random() < 0.25  # the content has no element of its own
    own = ' class="yymark"' if bare else ""
    short = rng.random() < 0.2
    text = lambda: words(int(rng.integers(8, 25))) if short else pick()
    other = [lambda: f"<h2{own}>{words(5)}</h2>", lambda: f"<blockquote{own}><p>{pick()}</p></blockquote>", lambda: f"<ul{own}><li>{pick()}</li><li>{words(9)}</li></ul>", lambda: f"<table{own}><tr><td>{words(6)}</td><td>{words(4)}</td></tr></table>", lambda: f"<pre{own}>{pick()}</pre>"]
    block = rng.choice(["p", "p", "p", "div"])
    paragraphs = [f"<{block}{own}>{prose(text())}</{block}>" if rng.random() < 0.85 else other[rng.integers(len(other))]() for _ in range(int(rng.integers(2 if short else 1, 4 if short else 9)))]
    if rng.random() < 0.3:
        paragraphs.insert(int(rng.integers(len(paragraphs) + 1)), part(rng.choice(["ad", "share", "notice", "side", "form"] if naming == "known" else ["share", "form"])))
    tag = rng.choice(["article", "main", "div", "div", "section"] if naming == "known" else ["article", "div", "div", "div", "section"])
    inside = (f"<h1{own}>{words(6)}</h1>" if rng.random() < 0.8 else "") + "".join(paragraphs)
    for _ in range(int(rng.integers(0, 3)) if not bare and rng.random() < 0.4 else 0):
        inside = f"<div>{inside}</div>"
    body = inside if bare else f'<{tag} class="yymark"' + ("" if tag in ("article", "main") and rng.random() < 0.5 else named(CONTENT_NAMES)) + f">{inside}</{tag}>"
    wrap = (lambda x: f'<div{named(["wrapper", "container", "page", "row", "layout"])}>{x}</div>') if rng.random() < 0.5 else (lambda x: x)
    around = [some(["notice", "head", "nav", "ad", "form"], 0.5), some(["nav", "side", "ad"], 0.3), some(["share", "comments", "side", "ad", "notice", "form"], 0.45), some(["side", "nav", "notice"], 0.2), some(["foot"], 0.85)]
    if rng.random() < 0.08:
        around = [""] * 5  # nothing but content
    made = Page("<html><body>" + around[0] + wrap(around[1] + body + around[2]) + around[3] + around[4] + "</body></html>")
    y = np.zeros(len(made.tag), np.int8)
    for k in range(1, len(made.tag)):
        y[k] = "yymark" in made.names[k] or y[made.parent[k]] and "yyout" not in made.names[k] and made.tag[k] != "label"
    made.names = [tuple(x for x in names if x not in ("yymark", "yyout")) for names in made.names]
    return made, y


def labelled_pages(sources: list[str], layouts: int = 3, seed: int = 3, marked: bool = True) -> list[tuple[Page, np.ndarray]]:
    """Training pages from html sources: self-labelled ones, and layouts made of their blocks (or, unmarked, of any)."""
    rng = np.random.default_rng(seed)
    out = []
    for source in sources:
        page = Page(source)
        y = self_labelled(page)
        if y is not None:
            out += [(page, y), (anonymous(page, rng), y)]
        elif marked:
            continue
        texts = [t for t in extract(page, np.ones(len(page.tag)) if y is None else y).split("\n\n") if t]
        out += [relaid(texts, rng) for _ in range(layouts)]
    return out


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", most: int = PAGES, least: float = 0.5) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, by a model trained on a bounded sample of the pages themselves."""
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    marked = rows.where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    n = marked.count()
    some, n = (marked, n) if n else (rows.where(F.length("html") > 0), rows.count())
    every = max(1, n // (4 * most))
    sources = [r["html"] for r in some.where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).orderBy(F.xxhash64("page_id"), "html").limit(most).collect()]
    pages_of = labelled_pages(sorted(sources)) or labelled_pages(sorted(sources), marked=False)
    sent = spark.sparkContext.broadcast(train(pages_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, slots = sent.value, Slots()
        for batch in batches:
            column = batch.column("html")
            for i, j, _, _ in blocks(column):
                parsed = [Page(x or "") for x in column.slice(i, j - i).to_pylist()]
                forest = Forest(parsed, slots)
                content = forest.marginals(model.weight, model.edge)[0] >= least
                texts = [extract(p, content[a:b]) for p, a, b in zip(parsed, forest.first, forest.first[1:], strict=False)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {pages.schema[page_id].dataType.simpleString()}, url string, text string, n_chars bigint")
