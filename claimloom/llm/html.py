"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text is a node with a hidden label: content or
not. A node's potential is a logistic model of its tag, class and id words, link density, text
length, share of the page's unlinked text, paragraphs and place; a parent-child potential says how labels pass down the tree. One
upward and one downward pass of sum-product messages give each node's exact marginal
probability of content, and the runs above one half make the text, in page order.

The model is trained once, when the query is built, on a small labelled page table: rows of html
in which ``data-content`` marks the elements that hold the article (``training_pages`` by default, or any
rows in that form, at most ``MAX_LABELLED``). Pages are judged one by one in Arrow batches;
nothing is shuffled.

Defined results: null html or a page without content gives an empty text; repeated rows are judged
each; an empty table gives an empty result; other columns pass through, but for text and n_chars,
which are replaced. Pages of any length and nesting are read whole, in linear time. End tags may be
left out where HTML allows it: a head ends at the first element or text of the body, an option at
the next one or with its list, and whatever hidden element is left open ends with its parent.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 2_000
#: Labelled pages that the coupling's scale is chosen on, and the scales.
CALIBRATION, SCALES = 120, (1.0, 1.5, 2.0, 2.5, 3.0)
#: Fixed HTML vocabulary: elements without content, of hidden text, and inside lines of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "script style noscript template svg annotation annotation-xml head title textarea select datalist optgroup option button iframe "
    "object".split()
)
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var wbr br math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace "
    "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: What may stand in a head; all else begins the body.
IN_HEAD = frozenset("base link meta noscript script style template title head html".split())
#: These never stand in a control, so they end one that was left open.
SECTIONS = frozenset("article aside body footer header main nav section".split())
CONTROLS = frozenset("select datalist optgroup option button".split())
#: What a start tag closes, if open.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"},
}
#: An open p ends where one of these starts.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
SCOPES = frozenset(("ul", "ol", "table", "dl", "div", "section", "article", "body"))


class Node:
    __slots__ = ("tag", "names", "parent", "children", "text", "linked", "label", "total", "links", "index", "paragraphs", "page")

    def __init__(self, tag, names, parent):
        self.tag, self.names, self.parent = tag, names, parent
        self.children, self.text, self.linked, self.label = [], None, 0, None


class Dom(HTMLParser):
    """Block elements and runs of text; inline elements only mark linked characters."""

    def __init__(self, ignored: frozenset = frozenset()):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", (), None)
        self.open: Counter = Counter()
        self.link: Node | None = None  # the block in which the open link began; links do not nest
        self.hidden: list[tuple[str, int]] = []  # open elements from the outermost hidden one on, with their numbers
        self.hiding: Counter = Counter()  # the same by tag
        self.starts, self.ignored = 0, ignored
        self.run: list[str] = []
        self.run_links = 0

    def hide(self, tag):
        self.hidden.append((tag, self.starts))
        self.hiding[tag] += 1

    def unhide(self, tag=None):
        """End the innermost hidden element of a tag and all inside, or all."""
        if tag is None:
            self.hidden.clear()
            self.hiding.clear()
            return
        while True:
            last, _ = self.hidden.pop()
            self.hiding[last] -= 1
            if last == tag:
                return

    def only_hidden(self, tags) -> bool:
        return sum(self.hiding[t] for t in tags) == len(self.hidden)

    def end_run(self):
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                leaf = Node("#text", (), self.at)
                leaf.text, leaf.linked = text, min(self.run_links, len(text))
                self.at.children.append(leaf)
            self.run, self.run_links = [], 0

    def end(self, node):
        """End ``node`` and all that is open inside."""
        self.end_run()
        while self.at is not node.parent:
            if self.at is self.link:
                self.link = None
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def opened(self, tags, stop=frozenset()):
        """The innermost open element of these tags, not looking past ``stop``."""
        if not any(self.open[t] for t in tags):
            return None
        node = self.at
        while node.parent is not None:
            if node.tag in tags:
                return node
            if node.tag in stop:
                return None
            node = node.parent
        return None

    def stays_hidden(self, tag) -> bool:
        """Whether a start tag lies inside the open hidden elements; ends those it does not lie in."""
        if len(self.hidden) == 1 and self.hidden[0][0] == "head" and tag not in IN_HEAD:
            self.unhide()
        elif tag in SECTIONS and (self.only_hidden(CONTROLS) or self.hidden[0][0] == "object"):
            self.unhide()
        elif tag == "option" and self.hidden[-1][0] == "option":
            self.unhide("option")
        if not self.hidden:
            return False
        if tag not in VOID:
            self.hide(tag)
        return True

    def handle_starttag(self, tag, attrs):
        self.starts += 1
        if self.hidden and self.stays_hidden(tag):
            return
        if tag == "br":
            self.run.append(" ")
            return
        if tag in HIDDEN:
            if self.starts not in self.ignored:
                self.hide(tag)
            return
        if tag in INLINE:
            if tag == "a":
                self.link = self.at if any(name == "href" for name, _ in attrs) else None
            return
        if tag in VOID:
            if tag == "hr":
                self.end_run()
            return
        if tag in ("html", "body"):
            self.end_run()
            if tag == "body" and self.at is self.root:
                self.push(tag, attrs)
            elif self.at is self.root and "data-content" in dict(attrs):
                self.root.label = True
            return
        if tag in ENDS_P and (p := self.opened({"p"}, SCOPES)):
            self.end(p)
        if tag in CLOSES:
            stop = {"ul", "ol", "dl"} if tag in ("li", "dt", "dd") else {"table"}
            while found := self.opened(CLOSES[tag], stop):
                self.end(found)
        self.push(tag, attrs)

    def push(self, tag, attrs):
        self.end_run()
        values = dict(attrs)
        words = " ".join(str(values.get(a) or "") for a in ("class", "id", "role"))
        names = tuple(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", words).lower()))
        node = Node(tag, names, self.at)
        if "data-content" in values:
            node.label = values["data-content"] != "no"
        self.at.children.append(node)
        self.at = node
        self.open[tag] += 1

    def handle_endtag(self, tag):
        if self.hidden:
            if self.hiding[tag]:
                self.unhide(tag)
                return
            if tag in ("body", "html") or not self.open[tag]:
                return
            self.unhide()  # an element around it ends
        if tag in INLINE:
            if tag == "a":
                self.link = None
            return
        if tag in ("body", "html"):
            return
        if node := self.opened({tag}):
            self.end(node)

    def handle_data(self, data):
        if len(self.hidden) == 1 and self.hidden[0][0] == "head" and not data.isspace():
            self.unhide()
        if not self.hidden:
            self.run.append(data)
            if self.link is not None:
                self.run_links += len(data)


#: What hides text whatever it holds: comments, declarations, and elements whose content is no markup.
_OPAQUE = re.compile(r"(?i)<!--|<!\[|<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>])")
_UNFINISHED = re.compile("<[a-zA-Z/!?]")


def without_opaque(html: str) -> str:
    """A page without comments, declarations and the contents of opaque elements; what is left unfinished at its end goes too.

    One pass that never looks back: what the parser would otherwise seek the end of again and again is settled here.
    """
    kept, at = [], 0
    while found := _OPAQUE.search(html, at):
        name = found[1]
        if name is None:
            kept.append(html[at:found.start()])
            mark = "-->" if found[0] == "<!--" else ">"
            # "<!-->" is a whole comment
            end = html.find(mark, found.start() + 2 if mark == "-->" else found.end())
            at = len(html) if end < 0 else end + len(mark)
            continue
        end_tag = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, found.end())
        inside = html.find(">", found.end())
        if end_tag is None or inside < 0:
            kept.append(html[at:found.start()])
            at = len(html)
            break
        kept.append(html[at:min(inside + 1, end_tag.start())])
        at = end_tag.start()
    kept.append(html[at:])
    clean = "".join(kept)
    last = clean.rfind(">") + 1  # no tag ends behind it
    cut = _UNFINISHED.search(clean, last)
    return clean[: cut.start()] if cut else clean


def parse(html: str) -> list[Node]:
    """All nodes of a page, parents before children, in page order.

    Hidden elements that are still open at the page's end hide nothing: the page is read again without their start tags (a second time at most).
    """
    html, ignored = without_opaque(html), frozenset()
    for _ in range(3):
        dom = Dom(ignored)
        dom.feed(html)
        dom.close()
        dom.end_run()
        left = {n for tag, n in dom.hidden if tag in HIDDEN and tag != "head"}
        if not left:
            break
        ignored |= left
    nodes, stack = [], [dom.root]
    while stack:
        node = stack.pop()
        node.index = len(nodes)
        nodes.append(node)
        stack.extend(reversed(node.children))
    for node in reversed(nodes):
        own = (len(node.text), node.linked) if node.text is not None else (0, 0)
        node.total = own[0] + sum(c.total for c in node.children)
        node.links = own[1] + sum(c.links for c in node.children)
        node.paragraphs = sum(c.tag == "p" or c.text is not None for c in node.children)
    page = nodes[0].total - nodes[0].links  # characters outside links
    for node in nodes:
        node.page = page
    return nodes


def _bucket(value: float, bounds: tuple) -> int:
    return sum(value >= b for b in bounds)


def features(node: Node) -> list[str]:
    parent, page = node.parent, node.page
    share = node.links / node.total if node.total else 0.0
    dense = "0" if share == 0 else "low" if share < 0.3 else "mid" if share < 0.7 else "high"
    if node.text is not None:
        size = _bucket(len(node.text), (20, 80, 200))
        return [f"text links {dense}", "text", f"text size {size}", f"text in {parent.tag}"]
    plain = _bucket((node.total - node.links) / page if page else 0.0, (0.1, 0.3, 0.6))
    blocks = _bucket(node.paragraphs, (1, 2, 4))
    out = [f"tag {node.tag}", f"links {dense}", "element", f"plain {plain}", f"blocks {blocks}", f"tag {node.tag} blocks {blocks}"]
    if parent is not None:
        out += [f"tag {node.tag} in {parent.tag}", f"beside {_bucket(parent.paragraphs, (1, 2, 4))}"]
    return out + [f"name {n}" for n in node.names]


def _logsum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


class Model:
    """Potentials: ``weights`` of features, and of a parent's and a child's labels.

    ``pairs`` has for elements and for runs of text the log potentials of (both content,
    parent only, child only), against zero for neither.
    """

    def __init__(self, weights: dict[str, float], pairs: dict[str, tuple[float, float, float]]):
        self.weights, self.pairs = weights, pairs

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content of every node by sum-product over the tree.

        Messages are log ratios of label 1 to label 0.
        """
        weights = self.weights
        up = [0.0] * len(nodes)
        below = [sum(weights.get(f, 0.0) for f in features(n)) for n in nodes]  # a node, and soon all below it
        for node in reversed(nodes[1:]):
            both, above, under = self.pairs["element" if node.text is None else "text"]
            b = below[node.index]
            up[node.index] = m = _logsum(above, both + b) - _logsum(0.0, under + b)
            below[node.parent.index] += m
        belief = below[:]  # the root's is complete; children add what their parent says
        for node in nodes[1:]:
            both, above, under = self.pairs["element" if node.text is None else "text"]
            i, rest = node.index, belief[node.parent.index] - up[node.index]
            belief[i] = below[i] + _logsum(under, both + rest) - _logsum(0.0, above + rest)
        return [1 / (1 + math.exp(-min(700.0, max(-700.0, b)))) for b in belief]


def _labelled(html: str) -> list[Node]:
    nodes = parse(html)
    for node in nodes:
        if node.label is None:
            node.label = node.parent.label if node.parent else False
    return nodes


def train(pages=None, rounds: int = 1000, rate: float = 1.0, decay: float = 3e-4) -> Model:
    """Fit all potentials by pseudo-likelihood: each node's label given those around it."""
    pages = list(training_pages() if pages is None else pages)[:MAX_LABELLED]
    counted: Counter = Counter()  # equal cases count together
    for html in pages:
        for node in _labelled(html):
            case = Counter(features(node))
            if node.parent:
                kind = "element" if node.text is None else "text"
                case.update({f"{kind} both": 1, f"{kind} above": -1} if node.parent.label else {f"{kind} under": 1})
            for child in node.children:
                kind = "element" if child.text is None else "text"
                case.update({f"{kind} both": 1, f"{kind} under": -1} if child.label else {f"{kind} above": 1})
            counted[tuple(sorted((f, x) for f, x in case.items() if x)), bool(node.label)] += 1
    names = sorted({f for fs, _ in counted for f, _ in fs})
    place = {f: i for i, f in enumerate(names)}
    cases = np.zeros((len(counted), len(names)))
    for k, (fs, _) in enumerate(counted):
        for f, x in fs:
            cases[k, place[f]] = x
    labels, times = np.array([float(label) for _, label in counted]), np.array([float(n) for n in counted.values()])
    seen = times @ (cases * cases) + 0.002 * times.sum()
    fitted = np.zeros(len(names))
    for _ in range(rounds):  # each feature steps by its own frequency
        error = times * (1 / (1 + np.exp(-np.clip(cases @ fitted, -500, 500))) - labels)
        fitted -= rate * (error @ cases / seen + decay * fitted)
    weights = dict(zip(names, fitted.tolist(), strict=True))
    pairs = {
        kind: tuple(weights.pop(f"{kind} {x}", 0.0) for x in ("both", "above", "under")) for kind in ("element", "text")
    }
    # Each node's own label given its parent's counts the coupling of elements too low: its scale is chosen by what the exact marginals get right.
    some = [_labelled(html) for html in pages[:: -(-len(pages) // CALIBRATION)]] if pages else []
    models = [Model(weights, {"element": tuple(scale * x for x in pairs["element"]), "text": pairs["text"]}) for scale in SCALES]
    return max(models, key=lambda model: sum(_right(model, nodes) for nodes in some))


def _right(model: Model, nodes: list[Node]) -> int:
    return sum(n.text is not None and (chance > 0.5) == n.label for n, chance in zip(nodes, model.marginals(nodes), strict=True))


def page_text(html: str | None, model: Model) -> str:
    if not html:
        return ""
    nodes = parse(html)
    chance = model.marginals(nodes)
    return " ".join(n.text for n in nodes if n.text is not None and chance[n.index] > 0.5)


def extract_text(pages: DataFrame, html: str = "html", labelled=None) -> DataFrame:
    """``pages`` without html, with text and n_chars."""
    model = train(labelled)

    @F.pandas_udf("string")
    def main_text(bodies: pd.Series) -> pd.Series:
        return pd.Series([page_text(x, model) for x in bodies], dtype=object)

    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    found = pages.select(*rest, main_text(F.col(html)).alias("text"))
    return found.select(*rest, "text", F.length("text").cast("long").alias("n_chars"))


# Labelled pages -----------------------------------------------------------------------

_WORDS = "the of and a to in is that it was for on are as with his they at be this from have or by one had not but what all".split()
_BEFORE = (
    '<nav><ul>{links}</ul></nav>', '<header class="site-header"><div class="logo">{short}</div>{nav}</header>',
    '<div id="top-menu" class="menu">{nav}</div>', '<div class="ad">{short}</div>', '<div class="advert banner">{sentence}</div>',
    '<div class="cookie-notice">{sentence} <a href="#">{short}</a></div>', '<div id="notice" class="alert notice">{sentence}</div>',
    '<ul class="breadcrumbs">{links}</ul>', '<form action="/s" class="search"><input name="q"><label>{short}</label></form>',
    '<aside class="sidebar"><h3>{short}</h3><ul>{links}</ul></aside>', '<div class="banner promo"><p>{sentence}</p></div>',
    '<div class="gdpr consent"><p>{sentence}</p><p>{sentence}</p></div>', '<div role="navigation" class="navbar">{nav}</div>',
    '<section class="notification popup"><p>{sentence}</p></section>', '<header><h2>{short}</h2><p>{sentence}</p></header>',
)
_AFTER = (
    '<footer>&copy; {short} &middot; {sentence}</footer>', '<aside class="related"><h3>{short}</h3><ul>{links}</ul></aside>',
    '<div id="comments" class="comments"><h3>{short}</h3><div class="comment"><p>{paragraph}</p></div><div class="comment"><p>{paragraph}</p></div></div>',
    '<section class="comments"><ol><li class="comment"><p>{paragraph}</p></li><li class="comment">{sentence}</li></ol></section>',
    '<form class="newsletter subscribe"><p>{sentence}</p><input></form>', '<div class="social share">{nav}</div>',
    '<div class="sponsored ads"><p>{sentence}</p></div>', '<div class="sidebar widget"><h4>{short}</h4><p>{sentence}</p><p>{paragraph}</p></div>',
    '<div class="footer" id="footer"><p>{sentence}</p><p>{nav}</p></div>', '<aside><p>{paragraph}</p><p>{sentence}</p></aside>',
    '<section id="responses" class="replies discussion"><article class="reply comment"><p>{paragraph}</p></article></section>',
    '<div class="disclaimer legal"><p>{sentence}</p></div>', '<form><p>{sentence}</p><label>{short}</label></form>',
    '<footer class="site-footer"><ul>{links}</ul><p>{sentence}</p></footer>', '<div class="pagination pager">{nav}</div>',
)
_AROUND = (
    '<article{mark}>{body}</article>', '<main><article{mark}>{body}</article></main>', '<main{mark}>{body}</main>',
    '<div class="content"{mark}>{body}</div>', '<div id="main"><div class="post-content entry"{mark}>{body}</div></div>',
    '<div class="article-body story"{mark}>{body}</div>', '<section class="post"{mark}>{body}</section>', '<div{mark}>{body}</div>',
    '<div id="wrapper" class="container"><div class="article text"{mark}>{body}</div></div>', '<div id="main"{mark}>{body}</div>',
    '<div class="main-content"><div class="row"><div{mark}>{body}</div></div></div>', '<div class="page"{mark}>{body}</div>', '<article class="post hentry"{mark}>{body}</article>',
)
_INSIDE = (
    '<aside data-content="no"><p>{sentence}</p></aside>', '<div class="ad" data-content="no">{sentence}</div>',
    '<div class="related links" data-content="no"><ul>{links}</ul></div>', '<div class="share" data-content="no">{nav}</div>',
    '<form data-content="no"><p>{sentence}</p></form>', '<nav data-content="no"><ul>{links}</ul></nav>',
    '<div class="comments" data-content="no"><p>{paragraph}</p></div>', '<footer data-content="no">{sentence}</footer>',
    '<section class="comments" data-content="no"><div class="comment"><p>{paragraph}</p><p>{paragraph}</p></div></section>',
)
_BODY = (
    "<p>{paragraph}</p>", "<p>{sentence}</p>", "<p>{short}.</p>", "<h2>{short}</h2>", "<ul><li>{sentence}</li><li>{short}</li></ul>",
    "<blockquote><p>{paragraph}</p></blockquote>", "<p><b>{sentence}<br>{sentence}", "<pre>{sentence}</pre>", "<p>{paragraph}",
    '<p>{sentence} <a href="/x">{short}</a> {sentence}</p>', "<table><tr><td>{short}</td><td>{sentence}</td></tr></table>",
    '<p><a href="/x">{sentence}</a></p>', '<h3><a href="/x">{short}</a></h3>', "<div>{paragraph}</div>", "<figure><figcaption>{sentence}</figcaption></figure>", "<ol><li><p>{sentence}</p></li></ol>", "<p>{word}.</p>",
)


#: Layouts in which no single element is the article.
_LOOSE = (
    "{first}{rest}", "<main{mark}>{first}{rest}</main>", '<main{mark}><div class="lead"{mark}>{first}</div><div class="body"{mark}>{rest}</div></main>',
    '<div{mark}>{first}</div><div{mark}>{rest}</div>', '<div class="col"{mark}><div class="block"{mark}>{first}</div><div class="block"{mark}>{rest}</div></div>',
    "<section{mark}>{first}</section><section{mark}>{rest}</section>",
)


def training_pages(n: int = 600, seed: int = 11, families: tuple[str, ...] = _AROUND + _LOOSE) -> list[str]:
    """Labelled pages made from families of layouts; ``data-content`` marks the article."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join(rng.choices(_WORDS, k=rng.randint(low, high)))

    def fill(layout: str) -> str:
        for name, make in (
            ("{paragraph}", lambda: ". ".join(words(6, 30).capitalize() for _ in range(rng.randint(2, 6))) + "."),
            ("{sentence}", lambda: words(4, 25).capitalize() + "."),
            ("{short}", lambda: words(1, 5)),
            ("{word}", lambda: words(1, 1)),
            ("{links}", lambda: "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(rng.randint(2, 8)))),
            ("{nav}", lambda: " ".join(f'<a href="/{i}">{words(1, 2)}</a>' for i in range(rng.randint(2, 6)))),
        ):
            while name in layout:
                layout = layout.replace(name, make(), 1)
        return layout

    pages = []
    for i in range(n):
        body = ["<h1>{short}</h1>"] * rng.randint(0, 1) + rng.choices(_BODY, k=rng.randint(1, 9))
        for _ in range(rng.choice((0, 1, 1, 2))):
            body.insert(rng.randint(1, len(body)), rng.choice(_INSIDE))
        around = families[i % len(families)]
        if around in _LOOSE:
            # no element of its own holds the article: every part is marked, and long enough to be one
            body += ["<p>{paragraph}</p>"] * rng.randint(1, 4)
            body = [x if x in _INSIDE else re.sub("^<([a-z0-9]+)", r'<\1 data-content="yes"', x) for x in body]
            half = rng.randint(1, len(body))
            article = around.replace("{first}", "".join(body[:half])).replace("{rest}", "".join(body[half:]) or '<p data-content="yes">{paragraph}</p>')
            article = article.replace("{mark}", ' data-content="yes"')
        else:
            article = around.replace("{mark}", ' data-content="yes"').replace("{body}", "".join(body))
        before = rng.sample(_BEFORE, rng.randint(0, 4))
        after = rng.sample(_AFTER, rng.randint(0, 4))
        outer = rng.choice(("{}", "{}", '<div class="page" id="wrapper">{}</div>', '<div class="container"><div class="row">{}</div></div>'))
        inner = outer.replace("{}", "".join([*before, article, *after]))
        pages.append(f"<!DOCTYPE html><html><head><title>x</title></head><body>{fill(inner)}</body></html>")
    bare = ('<html><body data-content="yes">{}</body></html>', '<html data-content="yes">{}')
    return pages + [fill(bare[k % 4 // 2].replace("{}", "{paragraph}" if k % 2 else "<p>{paragraph}</p>" * k)) for k in range(1, 1 + n // 12)]
