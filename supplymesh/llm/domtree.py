"""Main text of web pages by a graphical model on the tree of their elements.

Each block element is a binary variable: content or not. What an element is like (tag, names in
class, id and role, amount and kind of its own text) gives its own potential; each edge from parent
to child has a potential that depends on the child's kind. Sum-product messages go from the leaves
up and from the root down, which gives exact marginals on a tree; an element's own text is kept if
content is the likelier state. The weights maximise the likelihood of labelled pages.

The pages to learn from are generated here: menus, site headers and footers, sidebars, notices,
adverts, forms and comments around articles, marked up in many ways, in random words, so that
nothing is learned about any language.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplymesh.llm.common import lean, prepare, schema_with, spare

# --- pages as trees ------------------------------------------------------------------------------

#: Fixed by HTML: elements that don't break a line, that have no content, whose content isn't markup.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is never shown as text of the page.
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I | re.A) for t in RAW}
UNSEEN = frozenset("head script style template noscript svg math iframe object canvas audio video select option optgroup datalist button textarea title map".split())
#: Start tags that end an open paragraph, and open elements that a start tag of the same group ends, up to an enclosing one.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt tr td th tbody thead tfoot".split())
SIBLINGS = {t: (frozenset(g.split()), frozenset(s.split())) for g, s in (("li", "ul ol menu"), ("dd dt", "dl"), ("td th", "tr table"), ("tr", "table tbody thead tfoot"), ("tbody thead tfoot", "table")) for t in g.split()}
#: Elements that a document's head may hold; any other start tag ends it.
HEAD = frozenset("head base link meta title style script noscript template".split())
_MARKUP = re.compile(r"<(?=[A-Za-z!?/])")
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*+)")
#: The rest of a tag with its end, which no quoted value holds. It fails only where the page ends first.
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_LONG_REFERENCE = re.compile(r"&#0*[0-9]{8,};?")
_NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")
_UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?<![\w=-])hidden(?![\w-])", re.I)


def hidden(attributes: str) -> bool:
    """Whether an element has the attribute ``hidden`` or a style that doesn't show it; names that hold the word don't count."""
    return bool(_UNSHOWN.search(attributes) or _HIDDEN.search(attributes) and _HIDDEN.search(_QUOTED.sub('""', attributes)))


@dataclass
class Tree:
    """Elements in page order; the first one is the page. Inline elements are among them if they are named or hidden. ``parts``: (element,
    raw text, whether a block's edge lies before it) in page order, a new one at each element's edge."""

    tag: list[str] = field(default_factory=lambda: ["#page"])
    attributes: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    parts: list[tuple[int, str, bool]] = field(default_factory=list)
    linked: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    controls: dict[int, int] = field(default_factory=lambda: defaultdict(int))


class _Builder:
    """Puts a tree together from text and tags. All that is looked up is kept at hand, so that each call takes constant time but for what it closes."""

    def __init__(self) -> None:
        self.tree, self.stack, self.texts = Tree(), [0], []
        self.edge, self.unseen = True, 0
        #: Depths in the stack of the block elements, and of the open elements of each tag.
        self.blocks, self.opened = [0], defaultdict(list)
        #: Open inline elements (tag, depth that they are in, whether they are in the tree), and where those of each tag are in the list.
        self.inline: list[tuple[str, int, bool]] = []
        self.inline_at: dict[str, list[int]] = defaultdict(list)

    def flush(self, block: bool) -> None:
        if self.texts:
            self.tree.parts.append((self.stack[-1], "".join(self.texts), self.edge))
            self.texts, self.edge = [], False
        self.edge |= block

    def take(self, raw: str) -> None:
        if raw and not self.unseen:
            self.texts.append(unescaped(raw) if "&" in raw else raw)
            if self.inline_at["a"]:
                self.tree.linked[self.stack[-1]] += len(raw.strip())

    def push(self, name: str, attributes: str) -> None:
        tree = self.tree
        self.opened[name].append(len(self.stack))
        tree.tag.append(name)
        tree.attributes.append(attributes)
        tree.parent.append(self.stack[-1])
        self.stack.append(len(tree.tag) - 1)
        self.unseen += name in UNSEEN

    def leave(self, depth: int) -> None:
        """Closes what is open at this depth and deeper."""
        self.flush(self.blocks[-1] >= depth)
        while len(self.stack) > depth:
            tag = self.tree.tag[self.stack.pop()]
            self.opened[tag].pop()
            self.unseen -= tag in UNSEEN
        while self.blocks[-1] >= depth:
            self.blocks.pop()
        while self.inline and self.inline[-1][1] > depth:
            self.inline_at[self.inline.pop()[0]].pop()

    def open_inline(self, name: str, attributes: str) -> None:
        if name == "a" and self.inline_at["a"]:
            self.close_inline("a")
        known = bool(attributes) and bool(hidden(attributes) or names(attributes))
        self.inline_at[name].append(len(self.inline))
        self.inline.append((name, len(self.stack), known))
        if known:
            self.flush(False)
            self.push(name, attributes)

    def close_inline(self, name: str) -> None:
        """Closes the innermost one within the current block, and inline elements in it; nothing if there is none."""
        at = self.inline_at[name]
        if not at or self.inline[at[-1]][1] <= self.blocks[-1]:
            return
        least, cut = at[-1], None
        while len(self.inline) > least:
            tag, depth, known = self.inline.pop()
            self.inline_at[tag].pop()
            cut = depth if known else cut
        if cut is not None:
            self.leave(cut)

    def close_block(self, name: str) -> None:
        if at := self.opened[name]:
            self.leave(at[-1])

    def open_block(self, name: str, attributes: str) -> None:
        if self.opened["head"] and name not in HEAD:
            self.close_block("head")
        if name in ENDS_P and self.tree.tag[self.stack[self.blocks[-1]]] == "p":
            self.leave(self.blocks[-1])
        if name in SIBLINGS:
            ended, within = (max((self.opened[t][-1] for t in tags if self.opened[t]), default=0) for tags in SIBLINGS[name])
            if ended > within:
                self.leave(ended)
        self.flush(True)
        self.blocks.append(len(self.stack))
        self.push(name, attributes)


def unescaped(raw: str) -> str:
    """Character references decoded; numbers beyond any character are the replacement character."""
    return entities.unescape(_LONG_REFERENCE.sub("\ufffd", raw) if "&#" in raw else raw)


def parse(page: str) -> Tree:
    """The tree of a page, however broken, in time linear in its length: what isn't closed ends with what encloses it, and closing what isn't open does nothing.

    A tag whose quotes would swallow the rest of the page ends at the next ``>``, and from there on quotes aren't looked at; ``<`` without a later ``>`` is text.
    """
    made, at, size = _Builder(), 0, len(page)
    last = page.rfind(">")
    quoted = True
    while at < size:
        m = _MARKUP.search(page, at, last + 1)
        if m is None:
            made.take(page[at:])
            break
        made.take(page[at : m.start()])
        at = m.end()
        tag = _NAME.match(page, at)
        if tag is None:
            if page.startswith("!--", at):
                end = page.find("-->", at + 1)
                at = size if end < 0 else end + 3
            elif page[at] == "/" and page[at + 1] in " \t\n\r\f":
                made.take(page[m.start() : at])
            else:
                at = page.find(">", at) + 1
            continue
        name, begin = tag[1].lower(), tag.end()
        rest = _REST.match(page, begin) if quoted else None
        if rest is None:
            quoted = False
        at = rest.end() if rest else page.find(">", begin) + 1
        if not at:  # the name reaches the last ">"
            made.take(page[m.start() :])
            break
        attributes = page[begin : at - 1]
        if page[m.end()] == "/":
            if name in INLINE:
                made.close_inline(name)
            else:
                made.close_block(name)
        elif name == "br":
            made.take("\n")
        elif name in VOID:
            if name == "input":
                made.tree.controls[made.stack[-1]] += 1
            elif name == "hr":
                made.flush(True)
        elif name in INLINE:
            made.open_inline(name, attributes)
        elif name in RAW:
            made.flush(True)
            if name == "textarea":
                made.tree.controls[made.stack[-1]] += 1
            end = _RAW_END[name].search(page, at)
            at = size if end is None else (page.find(">", end.start()) + 1 or size)
        elif attributes.endswith("/") and name == "svg":
            made.flush(True)
        else:
            if name in ("select", "button"):
                made.tree.controls[made.stack[-1]] += 1
            made.open_block(name, attributes)
    made.flush(True)
    return made.tree


# --- potentials ----------------------------------------------------------------------------------

#: What an edge's potential depends on.
KINDS = {**dict.fromkeys(("p", "blockquote", "pre", "figure", "figcaption", "dd", "dt"), "text"), **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), "heading"), **dict.fromkeys(("li", "ul", "ol", "dl", "menu"), "list"), **dict.fromkeys(("table", "tr", "td", "th", "tbody", "thead"), "table"), **dict.fromkeys(("div", "section", "body", "html", "main", "article", "center"), "box"), **dict.fromkeys(INLINE, "inline")}


def names(attributes: str) -> list[str]:
    return [w.lower() for m in _NAMES.finditer(attributes) for w in _WORDS.findall(m[1] or m[2] or m[3] or "")] if attributes else []


def features(tree: Tree) -> list[list[str]]:
    """What each element is like, and whether it is in an article, or no element of the page is one."""
    main = [tag in ("article", "main") for tag in tree.tag]
    inside = main.copy()
    for i, parent in enumerate(tree.parent[1:], 1):
        inside[i] |= inside[parent]
    covered = [bool(a) and hidden(a) for a in tree.attributes]
    for i, parent in enumerate(tree.parent[1:], 1):
        covered[i] |= covered[parent]
    none = not any(main)
    texts: dict[int, list[str]] = defaultdict(list)
    for node, raw, _ in tree.parts:
        texts[node].append(raw)
    whole = sum([len(raw.strip()) for _, raw, _ in tree.parts])
    children: dict[int, int] = defaultdict(int)
    for p in tree.parent:
        children[p] += 1
    out, named = [], []
    for i, (tag, attributes, parent) in enumerate(zip(tree.tag, tree.attributes, tree.parent)):
        raw = " ".join(texts[i]).strip() if i in texts else ""
        n = len(raw)
        own = ["1", f"tag {tag}", f"under {tree.tag[parent]}" if parent >= 0 else "root", f"chars {0 if not n else min(5, 1 + int(math.log2(1 + n / 16)))}"]
        place = "none" if none else "in" if inside[i] else "out"
        own += [place, f"{place} {KINDS.get(tag, 'other')}", f"{place} tag {tag}", f"{tag} under {tree.tag[parent]}" if parent >= 0 else "root"]
        named.append(names(attributes))
        own += [f"name {w}" for w in named[i]]
        if parent >= 0:
            own += [f"below {w}" for w in named[parent]]
        if n:
            linked = min(3, int(4 * tree.linked.get(i, 0) / n))
            own += [f"links {linked}", f"{place} links {linked}", f"share {min(4, 4 * n // max(1, whole))}"]
            own.append("stop" if raw[-1] in ".!?…。！？" else "no stop")
            if "©" in raw:
                own.append("copyright")
        if tree.controls.get(i):
            own.append("controls")
        if not children[i] and not n:
            own.append("bare")
        if covered[i]:
            own.append("hidden")
        out.append(own)
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    #: Log-potentials by child's kind: ((parent not, child not), (not, content), (content, not), (content, content)).
    edges: dict[str, list[float]] = field(default_factory=dict)

    def potentials(self, tree: Tree) -> tuple[list[float], list[list[float]]]:
        get = self.weights.get
        own = [math.exp(max(-30.0, min(30.0, sum([get(f, 0.0) for f in fs])))) for fs in features(tree)]
        flat = {k: [math.exp(x) for x in v] for k, v in self.edges.items()}
        none = [1.0, 1.0, 1.0, 1.0]
        return own, [flat.get(KINDS.get(t, "other"), none) for t in tree.tag]


def marginals(parent: list[int], own: list[float], edge: list[list[float]]) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """Each element's probability of content, and each edge's joint one, by one sweep up and one down.

    ``own``: potential of content against 1 of not; ``edge``: of (parent, child) states; parents come before children.
    """
    n = len(parent)
    up0, up1 = [1.0] * n, list(own)  # product of own potential and messages from children, kept to sum 1
    to0, to1 = [1.0] * n, [1.0] * n  # message to the parent
    for i in range(n - 1, -1, -1):
        a, b = up0[i], up1[i]
        s = a + b
        up0[i], up1[i] = a, b = a / s, b / s
        p = parent[i]
        if p >= 0:
            e = edge[i]
            x, y = e[0] * a + e[1] * b, e[2] * a + e[3] * b
            s = x + y
            to0[i], to1[i] = x, y = x / s, y / s
            x, y = up0[p] * x, up1[p] * y
            s = x + y
            if s < 1e-200:
                x, y = x * 1e200, y * 1e200
            up0[p], up1[p] = x, y
    down = [0.0] * n
    joint = [(0.0, 0.0, 0.0, 0.0)] * n
    for i in range(n):
        p = parent[i]
        if p < 0:
            down[i] = up1[i]
            continue
        # the parent without this child's message
        c1, c0 = down[p] / to1[i], (1 - down[p]) / to0[i]
        e, a, b = edge[i], up0[i], up1[i]
        q = (c0 * e[0] * a, c0 * e[1] * b, c1 * e[2] * a, c1 * e[3] * b)
        s = q[0] + q[1] + q[2] + q[3]
        joint[i] = (q[0] / s, q[1] / s, q[2] / s, q[3] / s)
        down[i] = (q[1] + q[3]) / s
    return down, joint


def train(pages: list[tuple[Tree, list[int]]], rounds: int = 12, rate: float = 0.3, ridge: float = 1e-3) -> Model:
    """The weights of greatest likelihood for pages with a label (0 or 1) for each element, by scaled gradients, page by page
    in an order drawn anew each round; the mean over the later half of the rounds, so that no page counts for its place."""
    model = Model()
    seen: dict[str, float] = defaultdict(float)
    prepared = [(tree, features(tree), labels) for tree, labels in pages]
    order, mean, later = random.Random(rounds), Model(), rounds - rounds // 2
    for turn in range(rounds):
        order.shuffle(prepared)
        for tree, fs, labels in prepared:
            own, edge = model.potentials(tree)
            p, joint = marginals(tree.parent, own, edge)
            steps: dict[str, float] = defaultdict(float)
            turns: dict[str, list[float]] = {}
            for i, label in enumerate(labels):
                for f in fs[i]:
                    steps[f] += label - p[i]
                if (q := tree.parent[i]) >= 0:
                    g = turns.setdefault(KINDS.get(tree.tag[i], "other"), [0.0] * 4)
                    for k in range(4):
                        g[k] += (k == 2 * labels[q] + label) - joint[i][k]
            for f, g in steps.items():
                g -= ridge * model.weights.get(f, 0.0)
                seen[f] += g * g
                model.weights[f] = model.weights.get(f, 0.0) + rate * g / math.sqrt(1e-6 + seen[f])
            for k, g in turns.items():
                e = model.edges.setdefault(k, [0.0] * 4)
                for j in range(4):
                    seen[f"{k}{j}"] += g[j] * g[j]
                    e[j] = max(-4.0, min(4.0, e[j] + rate * (g[j] - ridge * e[j]) / math.sqrt(1e-6 + seen[f"{k}{j}"])))
        if turn >= rounds - later:
            for f, w in model.weights.items():
                mean.weights[f] = mean.weights.get(f, 0.0) + w / later
            for k, e in model.edges.items():
                mean.edges[k] = [a + b / later for a, b in zip(mean.edges.get(k, [0.0] * 4), e)]
    return mean


def extract(page: str | None, model: Model) -> tuple[str, list[float]]:
    """The main text, and the marginal of each element. White space in a block is one space; blocks are joined by one space."""
    tree = parse(page or "")
    own, edge = model.potentials(tree)
    p, _ = marginals(tree.parent, own, edge)
    blocks: list[list[str]] = [[]]
    for node, raw, edge in tree.parts:
        if edge:
            blocks.append([])
        if p[node] >= 0.5:
            blocks[-1].append(raw)
    kept = (" ".join("".join(x).split()) for x in blocks)
    return " ".join(x for x in kept if x), p


# --- labelled pages ------------------------------------------------------------------------------


def _generate(r: random.Random) -> str:
    """A page whose content elements carry the attribute y."""
    letters = "".join(r.sample("abcdefghijklmnoprstuvwzäéñôßжд", 12))
    vocabulary = ["".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(150)]

    def words(least: int, most: int, stop: bool = True) -> str:
        text = " ".join(r.choices(vocabulary, k=r.randint(least, most)))
        return text.capitalize() + ("." if stop else "")

    def prose() -> str:
        sentences = [words(1, 16) for _ in range(r.choice((1, 1, 1, 2, 4, 9)))]
        text = " ".join(sentences)
        if r.random() < 0.2:
            text = f'{text} <a href="/{r.choice(vocabulary)}">{words(1, 3, False)}</a> {words(1, 8)}'
        if r.random() < 0.15:
            text = f"<b>{text}<br>"
        if r.random() < 0.15:
            tag = r.choice(("span", "span", "em", "a", "strong", "mark", "time"))
            text = f'{text} <{tag} y {r.choice(("class", "class", "id"))}="{r.choice(("highlight", "name", "term", "date", "link", "external", "reference", "lead", "dropcap", "nowrap", "quote", "text"))}">{words(1, 12, r.random() < 0.5)}</{tag}> {words(1, 8)}'
        if r.random() < 0.08:
            tag = r.choice(("span", "span", "a", "small", "ins"))
            text = f'{text} <{tag} class="{r.choice(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "ad-slot"))}">{words(1, 12, r.random() < 0.7)}</{tag}> {words(1, 8)}'
        return text

    def named(*choices: str) -> str:
        if r.random() < 0.12:
            return ""
        return f' {r.choice(("class", "class", "id"))}="{r.choice(choices)}"'

    def links(least: int, most: int) -> str:
        items = [f'<a href="/{r.choice(vocabulary)}">{words(1, 3, r.random() < 0.3)}</a>' for _ in range(r.randint(least, most))]
        if r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return r.choice((" ", " | ")).join(items)

    def box(tags: str, names_: str, inner: str) -> str:
        tag = r.choice(tags.split())
        semantic = tag not in ("div", "section", "p", "ul")
        attributes = named(*names_.split()) if not semantic or r.random() < 0.4 else ""
        if not semantic and not attributes:
            attributes = f' class="{r.choice(names_.split())}"'
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def some(share: float, make) -> str:
        return make() if r.random() < share else ""

    def menu() -> str:
        return box("nav nav nav div", "menu nav navbar navigation main-menu site-nav topnav breadcrumb breadcrumbs", links(2, 9))

    def head() -> str:
        return box("header header div", "header site-header masthead page-header top-bar branding", some(0.7, lambda: r.choice((f"<h1>{words(1, 4, False)}</h1>", f"<p>{words(1, 6)}</p>", f"<div>{words(1, 4, False)}</div>"))) + some(0.5, menu))

    def foot() -> str:
        return box("footer footer footer div", "footer site-footer page-footer bottom colophon copyright", some(0.6, lambda: "&copy; ") + r.choice((words(1, 14), f"<p>{words(2, 18)}</p>", f"<p>{words(2, 9)}</p>{links(2, 6)}")))

    def side() -> str:
        return box("aside aside div", "sidebar side-bar widget widget-area related related-posts recommended popular trending more-stories rail", some(0.6, lambda: f"<h3>{words(1, 3, False)}</h3>") + r.choice((links(2, 7), f"<p>{words(3, 30)}</p>", f"<ul><li>{words(1, 9)}</li><li>{words(1, 9)}</li></ul>")))

    def notice() -> str:
        return box("div div section", "cookie cookie-banner cookie-notice notice consent gdpr alert popup modal overlay banner privacy-notice", r.choice((words(4, 25), f"<p>{words(4, 25)}</p>")) + some(0.4, lambda: f"<button>{words(1, 2, False)}</button>"))

    def advert() -> str:
        return box("div div div aside section p", "ad ads advert advertisement ad-slot ad-container adsbox sponsor sponsored promo promotion banner-ad", r.choice((words(2, 30), f"<p>{words(2, 30)}</p>", f'<a href="/x">{words(1, 9)}</a>')))

    def form() -> str:
        return box("form form form div", "form search search-form newsletter subscribe signup login contact-form", f"<label>{words(1, 5, False)}</label><input name=q>" + some(0.5, lambda: f"<p>{words(2, 14)}</p>") + some(0.6, lambda: f"<button>{words(1, 2, False)}</button>"))

    def share_box() -> str:
        return box("div ul", "share social sharing social-links tags meta byline tag-list", links(2, 5))

    def comments() -> str:
        one = lambda: f'<{(t := r.choice(("div", "li", "article", "div")))} class="{r.choice(("comment", "reply", "comment-body", "user-comment"))}"><p>{words(1, 30)}</p></{t}>'
        return box("section div ol aside", "comments comment-list responses discussion reader-comments replies", some(0.6, lambda: f"<h3>{words(1, 3, False)}</h3>") + "".join(one() for _ in range(r.randint(1, 5))))

    def plain() -> str:
        """Often a name of no meaning."""
        return some(0.4, lambda: f' class="{r.choice(vocabulary)}"')

    def unseen() -> str:
        """Text that isn't shown."""
        tag = r.choice(("p", "div", "section", "ul"))
        return f'<{tag} {r.choice(("hidden", "style=display:none", 'style="display: none"', 'hidden="hidden"'))}>' + (f"<li>{words(1, 9)}</li>" if tag == "ul" else r.choice((prose, lambda: f"<p>{prose()}</p>"))()) + f"</{tag}>"

    def reference() -> str:
        return f'<li y>{some(0.4, lambda: words(1, 6, False) + " ")}<a href="/{r.choice(vocabulary)}">{words(1, 6, r.random() < 0.3)}</a>{some(0.4, lambda: " " + words(1, 6))}</li>'

    def article() -> str:
        parts = [f"<h1 y>{words(2, 12, r.random() < 0.3)}</h1>"] if r.random() < 0.85 else []
        if parts and r.random() < 0.2:
            parts = [f"<header y>{parts[0]}{some(0.3, lambda: f'<p y>{words(2, 12)}</p>')}</header>"]
        for _ in range(r.choice((1, 2, 2, 4, 4, 7, 12, 40))):
            kind = r.random()
            if kind < 0.74:
                parts.append(f"<p y>{prose()}" + r.choice(("</p>", "</p>", "")))
            elif kind < 0.82:
                parts.append(f"<h2 y>{words(1, 8, False)}</h2>")
            elif kind < 0.91:
                tag, item = r.choice(("ul", "ol")), r.choice((reference, lambda: f"<li y>{words(2, 20, r.random() < 0.6)}</li>", lambda: f"<li y>{words(2, 20, r.random() < 0.6)}</li>"))
                parts.append(f"<{tag} y>" + "".join(item() for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif kind < 0.92:
                parts.append(f"<details y><summary y>{words(1, 5, False)}</summary>" + r.choice((f"<p y>{prose()}</p>", words(2, 20))) + "</details>")
            elif kind < 0.94:
                parts.append(f"<blockquote y><p y>{prose()}</p></blockquote>")
            elif kind < 0.96:
                parts.append("<table y>" + "".join(f"<tr y><td y>{words(1, 4, False)}</td><td y>{words(1, 4, False)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.98:
                parts.append(f"<pre y>{words(4, 20, False)}</pre>")
            else:
                parts.append(f'<div y{plain() or some(0.2, lambda: ' class="overflow-hidden"')}>{prose()}</div>')
        for make in (advert, share_box, form, side, notice, unseen):
            if r.random() < 0.1:
                parts.insert(r.randint(0, len(parts)), make())
        if r.random() < 0.12:
            parts.append(f"<footer>{r.choice((words(1, 8, r.random() < 0.5), f'<p>{words(1, 12)}</p>'))}</footer>")
        inner = "".join(parts)
        if r.random() < 0.1:
            return r.choice((f"<div y>{inner}</div>", f"<section y>{inner}</section>", f"<main y>{inner}</main>", inner))
        if r.random() < 0.55:
            return f"<article y{named('post', 'entry', 'story', 'article') if r.random() < 0.4 else ''}>{inner}</article>"
        tag = r.choice(("div", "div", "section", "main"))
        names_ = "content article article-body post post-content entry-content main-content story story-body text body-text main page-content"
        return f'<{tag} y {r.choice(("class", "class", "id"))}="{r.choice(names_.split())}">{inner}</{tag}>'

    def bare() -> str:
        """Content with hardly any markup."""
        paragraphs = "".join(f"<p y>{words(1, 14)}</p>" for _ in range(r.choice((1, 1, 1, 2, 3))))
        items = "<ul y>" + "".join(f"<li y>{words(1, 6, r.random() < 0.4)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        heading = f"<h1 y>{words(1, 6, False)}</h1>"
        inner = r.choice((paragraphs, paragraphs, paragraphs + items, paragraphs + items.replace("ul", "ol"), prose(), f"{heading}{prose()}", f"<header y>{heading}</header>{paragraphs}"))
        tag = r.choice(("article", "article", "div", "section", "main", "p" if "<" not in inner else "div"))
        by = some(0.2 * (tag == "article"), lambda: f"<footer>{words(1, 5, False)}</footer>")
        return f"<{tag} y{plain()}>{inner}{by}</{tag}>" if inner != paragraphs or r.random() < 0.7 else inner

    kind = r.random()
    if kind < 0.05:  # no markup at all
        return "\n".join(words(1, 20, r.random() < 0.8) for _ in range(r.choice((1, 2, 6))))
    if kind < 0.14:  # text right in the body
        text = r.choice(("<br>", "<br><br>", "\n", "<hr>")).join(r.choice((prose, lambda: words(1, 8)))() for _ in range(r.choice((1, 1, 2, 5))))
        return f"<html><body y>{some(0.3, head)}{some(0.3, menu)}{text}{some(0.3, foot)}</body></html>"
    body = bare() if kind < 0.31 else article()
    if kind < 0.23:  # nothing around
        return r.choice((f"<body>{body}</body>", f"<!DOCTYPE html><html><head><title>{words(1, 8, False)}</title><body>{body}", body))
    if r.random() < 0.3:
        body = f'<{(t := r.choice(("main", "div")))} y class="{r.choice(("main", "content", "container", "wrapper"))}">{body}{some(0.3, comments)}</{t}>'
    before = "".join(some(s, m) for s, m in ((0.35, notice), (0.5, head), (0.6, menu), (0.4, advert), (0.2, form), (0.2, side)))
    after = "".join(some(s, m) for s, m in ((0.3, advert), (0.35, comments), (0.2, share_box), (0.4, side), (0.25, form), (0.75, foot), (0.15, notice)))
    if r.random() < 0.1:  # a layout by table
        cell = r.choice((lambda: links(2, 6), lambda: words(1, 4, False)))()
        body = f"<table y><tr y><td>{cell}</td><td y>{body}</td></tr></table>"
    whole = before + body + after
    if r.random() < 0.35:
        whole = f'<div {r.choice(("class", "id"))}="{r.choice(("wrapper", "page", "container", "layout", "site", "row"))}">{whole}</div>'
    return f"<!DOCTYPE html><html><head><title>{words(1, 8, False)}</title><style>p{{}}</style></head><body>{whole}</body></html>"


def labelled(count: int, seed: int) -> list[tuple[Tree, list[int]]]:
    """Generated pages with a label for each element."""
    r = random.Random(seed)
    trees = [parse(_generate(r)) for _ in range(count)]
    return [(t, [int(len(t.tag) == 1), *(int(a.startswith(" y")) for a in t.attributes[1:])]) for t in trees]


#: Generated pages to learn from.
PAGES, SEED = 800, 3
_TRAINED: dict[tuple[int, int], Model] = {}


def trained(pages: int = PAGES, seed: int = SEED) -> Model:
    """The model, trained once a process."""
    if (pages, seed) not in _TRAINED:
        _TRAINED[pages, seed] = train(labelled(pages, seed))
    return _TRAINED[pages, seed]


def extract_column(pages: DataFrame, model: Model, page: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of a column of HTML (null: empty, which has no text). A column named ``out`` gives way; no shuffle."""
    prepare(pages.sparkSession)
    source = spare(pages, "__page")
    kept = pages.withColumn(source, F.col(f"`{page}`").cast("string")).drop(out)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # bounded by the generated pages' features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(source)
            found = [extract(x, shared.value)[0] for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + [pa.array(found, pa.string())], names=[c for i, c in enumerate(batch.schema.names) if i != at] + [out])

    return kept.mapInArrow(lean(run), schema_with(kept.drop(source), (out, "string")))
