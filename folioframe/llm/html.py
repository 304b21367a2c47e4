"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements and text blocks. Each node is boilerplate, content, or a frame around
both; a node's features depend on its state, and its state on its parent's. Messages are summed upward from the leaves
and passed downward again, which gives each node's exact marginals; text blocks whose marginal is content are kept.
The potentials are counts over labelled pages, which this module composes from a small grammar of page parts.

No single sign decides: class names are counted on pages some of whose articles are misnamed, against what a node holds of the
page's text, its paragraphs, and where titles stand.

Defined results: null or empty html gives an empty text; unclosed and misnested tags are closed where browsers would
close them; a page without any content block gives an empty text; repeated rows give repeated results; pages of any
length and depth are read whole, without recursion; other columns of the input are not carried along.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, spread, table

#: Fixed values of the HTML standard: elements without end tag, with raw text, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr legend li main menu nav ol p pre section summary table caption colgroup thead tbody tfoot tr td th ul frameset search".split()
)
#: Elements that are nodes too, but stand within a paragraph without ending it.
PART = frozenset("audio button canvas datalist noscript object optgroup option select svg template video".split())
NODES = BLOCK | PART
#: Elements that a start tag closes when they are open within the same scope.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th"),
    "option": ("option",), "optgroup": ("option", "optgroup"), "body": ("head",),
}
SCOPES = {"option": ("select", "datalist", "optgroup"), "optgroup": ("select",), "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}

#: Words of class, id and role attributes, by the kind of part that they name.
KINDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip",
    "header": "header masthead banner topbar top logo branding",
    "footer": "footer foot bottom copyright legal imprint colophon contentinfo",
    "side": "sidebar side aside rail widget related recommended popular trending more tags complementary",
    "notice": "cookie cookies notice consent gdpr alert modal popup overlay newsletter subscribe paywall toast",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner dfp outbrain taboola",
    "form": "form search login signup register contact",
    "comments": "comment comments reply replies respond discussion disqus thread",
    "share": "share social sharing follow",
    "main": "article content main post entry story body text page blog prose",
}
KIND_OF = {word: kind for kind, words in KINDS.items() for word in words.split()}

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_REMARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_SIGN = re.compile("[>\"']")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BOILER, CONTENT, FRAME = range(3)
#: Elements that can hold an article, of which the share of the page's text is looked at.
HOLDERS = frozenset("address article aside body center details div dl fieldset form main nav ol section table td ul header footer".split())
#: Characters from which unlinked text is a paragraph, and the share of a page's unlinked text that is much.
PARAGRAPH = 80
MUCH = 0.35


class Node:
    """A block element or, with text, a run of text between block borders."""

    __slots__ = ("tag", "kinds", "parent", "text", "chars", "linked", "label", "titles", "paragraphs", "share", "late", "mains", "rival")

    def __init__(self, tag: str, kinds: tuple[str, ...], parent: int, label: int | None = None):
        self.tag, self.kinds, self.parent, self.text, self.chars, self.linked, self.label = tag, kinds, parent, None, 0, 0, label
        # Within the node; its share of the page's unlinked text; whether a title stands before it.
        self.titles, self.paragraphs, self.share, self.late = int(tag == "h1"), 0, 0.0, False
        # Elements named article or main within, and whether there are others that neither hold the node nor lie in it.
        self.mains, self.rival = int(tag in ("article", "main")), False


def kinds_of(attributes: str) -> tuple[str, ...]:
    """Kinds named by class, id and role; the first word of a name that has a kind counts."""
    out = []
    for m in _ATTR.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            found = [KIND_OF[w] for w in map(str.lower, _WORD.findall(name)) if w in KIND_OF]
            if found:
                out.append(next((k for k in found if k != "main"), "main"))
    return tuple(dict.fromkeys(out))


class TagEnds:
    """Where tags end: at the first > outside quotes, or at the first > at all where quotes do not close.

    What follows a quote is the same for every tag that meets it, so it is remembered, and a page is passed over once.
    """

    def __init__(self, html: str):
        self.html, self.known = html, {}

    def after(self, at: int) -> tuple[int, int]:
        """The end of the attributes that begin here, and the place behind the tag."""
        html, known, met, place = self.html, self.known, [], at
        while True:
            m = _SIGN.search(html, place)
            if m is None:
                end = -1
                break
            q = m.start()
            if html[q] == ">":
                end = q
                break
            if q in known:
                end = known[q]
                break
            met.append(q)
            close = html.find(html[q], q + 1)
            if close < 0:
                end = -1
                break
            place = close + 1
        for q in met:
            known[q] = end
        if end < 0:
            end = html.find(">", at)
        return (len(html), len(html)) if end < 0 else (end, end + 1)


def parsed(html: str) -> list[Node]:
    """Nodes in page order, parents before their children."""
    ends = TagEnds(html)
    nodes = [Node("#page", (), -1)]
    stack: list[tuple[str, int]] = [("#page", 0)]  # open elements and the node that each is in
    places: dict[str, list[int]] = {}  # where in the stack each tag is open, so that no end tag is searched for
    blocks = [0]  # and where elements that are nodes are
    text: list[str] = []
    linked = 0
    links = 0

    def flush() -> None:
        nonlocal linked
        if text:
            clean = " ".join(entities.unescape("".join(text)).split())
            if clean:
                leaf = Node("#text", (), stack[-1][1])
                leaf.text, leaf.chars, leaf.linked = clean, len(clean), min(linked, len(clean))
                nodes.append(leaf)
            text.clear()
        linked = 0

    def shut(k: int) -> None:
        """Close the open elements from k on."""
        nonlocal links
        if blocks[-1] >= k:
            flush()
        while len(stack) > k:
            tag, _ = stack.pop()
            places[tag].pop()
            links -= tag == "a"
        while blocks[-1] >= k:
            blocks.pop()

    def last_place(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def opened(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))

    def add(chunk: str) -> None:
        nonlocal linked
        if chunk:
            text.append(chunk)
            if links > 0:
                linked += len(chunk)

    at, end = 0, len(html)
    low = None
    while at < end:
        sign = html.find("<", at)
        if sign < 0:
            add(html[at:])
            break
        add(html[at:sign])
        m = _TAG.match(html, sign)
        if m is None:
            remark = _REMARK.match(html, sign)
            if remark is None:
                add("<")
                at = sign + 1
            else:
                at = remark.end()
            continue
        stop, at = ends.after(m.end())
        attributes = html[m.end() : stop]
        tag = m[2].lower()
        if m[1]:
            if tag in NODES:
                flush()
            if tag == "br":
                add(" ")
            k = last_place((tag,))
            if k > (0 if tag in NODES else blocks[-1]):
                shut(k)
            continue
        if tag in RAW and not attributes.endswith("/"):
            low = html.lower() if low is None else low
            if len(low) != end:  # lower-casing changed the length
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in html)
            close = low.find(f"</{tag}", at)
            stop = html.find(">", close) if close >= 0 else -1
            at = end if close < 0 or stop < 0 else stop + 1
            add(" ")
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            else:
                add(" " if tag == "br" else "")
            continue
        if tag in ("svg", "math") and attributes.endswith("/"):
            continue
        if tag in NODES:
            flush()
            if tag in BLOCK and stack[blocks[-1]][0] == "p":  # a paragraph ends where a block begins
                shut(blocks[-1])
            if tag in CLOSES:
                scope = last_place(SCOPES.get(tag, ()))
                if tag in ("tr", "thead", "tbody", "tfoot"):  # all of them within the table end, the outermost first
                    open_ones = [places[t][i] for t in CLOSES[tag] if places.get(t) and (i := bisect_right(places[t], scope)) < len(places[t])]
                    k = min(open_ones, default=0)
                else:
                    k = last_place(CLOSES[tag])
                if k > scope:
                    shut(k)
            kinds = kinds_of(attributes) if "=" in attributes else ()
            label = re.search(r"data-label=(\d)", attributes)
            nodes.append(Node(tag, kinds, stack[-1][1], int(label[1]) if label else None))
            blocks.append(len(stack))
            opened(tag, len(nodes) - 1)
        else:
            if tag == "a":
                links += 1
            opened(tag, stack[-1][1])
    flush()
    head = 0
    for n in range(len(nodes) - 1, 0, -1):
        x = nodes[n]
        if x.text is not None and not x.linked and x.chars >= PARAGRAPH:
            x.paragraphs = 1
        if x.tag == "head":
            head += x.chars
        p = nodes[x.parent]
        p.chars += x.chars
        p.linked += x.linked
        p.titles += x.titles
        p.paragraphs += x.paragraphs
        p.mains += x.mains
    own = max(nodes[0].chars - nodes[0].linked - head, 1)
    late, above = False, [0] * len(nodes)  # elements named article or main around each node
    for n, x in enumerate(nodes):
        if n:
            p = nodes[x.parent]
            above[n] = above[x.parent] + (p.tag in ("article", "main"))
        x.share, x.late, x.rival = (x.chars - x.linked) / own, late, nodes[0].mains > x.mains + above[n]
        late = late or x.tag == "h1"
    return nodes


def features(node: Node) -> list[str]:
    """What is seen of a node: its tag with the kinds of its names, both alone, its links, and what it holds of the page's text.

    Of text its length, links and ending.
    """
    share = node.linked / node.chars if node.chars else 0.0
    links = "links:" + ("none" if not share else "few" if share < 0.35 else "half" if share < 0.75 else "most")
    if node.text is None:
        holds = node.tag in HOLDERS
        # A name on what holds much of the page says less than one on a small part.
        much = holds and node.share >= MUCH and (node.titles > 0 or not node.rival)
        kinds = [f"{k}, much" if much else k for k in node.kinds or ("none",)]
        names = [f"{node.tag}/{k}" for k in kinds] + [f"tag:{node.tag}", *(f"kind:{k}" for k in kinds), links]
        if not holds:
            return names
        share, paragraphs = sum(node.share >= x for x in (0.03, 0.15, 0.35, 0.6)), sum(node.paragraphs >= x for x in (1, 2, 4))
        return [*names, f"holds:{share}/{paragraphs}/{node.titles > 0}/{node.late}"]
    size = "size:" + str(sum(node.chars >= x for x in (15, 60, 200)))
    return [links + ":text", size, "ends:" + str(node.text[-1] in ".!?:;\"')…")]


class TreeModel:
    """Potentials of states, features and parent-child pairs."""

    def __init__(self, pages: list[str], smoothing: float = 1e-5, doubt: float = 0.01):
        """``doubt``: what is added to the counts of features, so that none rules a state out by itself."""
        seen: dict[bool, dict[str, np.ndarray]] = {False: {}, True: {}}
        self.pairs = np.full((3, 3), smoothing)
        self.pairs[BOILER, CONTENT] = self.pairs[BOILER, FRAME] = 1e-6
        total = {False: np.full(3, smoothing), True: np.array([smoothing, smoothing, 1e-9])}
        for page in pages:
            nodes = labelled(parsed(page))
            for n in nodes[1:]:
                self.pairs[nodes[n.parent].label, n.label] += 1
                leaf = n.text is not None
                total[leaf][n.label] += 1
                for f in features(n):
                    seen[leaf].setdefault(f, np.full(3, doubt))[n.label] += 1
        self.pairs /= self.pairs.sum(axis=1, keepdims=True)
        self.seen = {leaf: {f: np.log(c / (total[leaf] + 2 * doubt)) for f, c in fs.items()} for leaf, fs in seen.items()}
        self.leaf_states = np.array([0.0, 0.0, -60.0])
        self.known: dict[tuple, np.ndarray] = {}

    def unary(self, node: Node) -> np.ndarray:
        """Likelihood of a node's features in each state; features never met say nothing."""
        leaf = node.text is not None
        fs = tuple(features(node))
        got = self.known.get((leaf, fs))
        if got is None:
            s = self.leaf_states.copy() if leaf else np.zeros(3)
            for f in fs:
                together = any("/" in g and g in self.seen[leaf] for g in fs)
                if not (together and f.startswith(("tag:", "kind:"))):  # what is known of both together says it all
                    s += self.seen[leaf].get(f, 0.0)
            got = np.exp(s - s.max())
            if len(self.known) < 100_000:
                self.known[leaf, fs] = got
        return got

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """Sum-product: children come after parents, so one loop runs upward and one downward."""
        n = len(nodes)
        own = np.ones((n, 3))
        up = np.ones((n, 3))
        for k in range(n - 1, 0, -1):
            own[k] *= self.unary(nodes[k])
            own[k] /= own[k].sum()
            up[k] = self.pairs @ own[k]
            own[nodes[k].parent] *= up[k]
            s = own[nodes[k].parent].sum()
            if s < 1e-100:
                own[nodes[k].parent] /= s
        out = own.copy()
        out[0] = np.array([0.0, 0.0, 1.0])
        for k in range(1, n):
            down = (out[nodes[k].parent] / up[k]) @ self.pairs
            out[k] = own[k] * down
            out[k] /= out[k].sum()
        return out

    def main_text(self, html: str | None) -> str:
        if not html:
            return ""
        nodes = parsed(html)
        m = self.marginals(nodes)
        return "\n\n".join(x.text for x, p in zip(nodes, m, strict=True) if x.text is not None and p[CONTENT] > 0.5)


def labelled(nodes: list[Node]) -> list[Node]:
    """Fill in labels: what a labelled element holds has its label, and what holds both is a frame."""
    for n in nodes[1:]:
        p = nodes[n.parent].label
        if n.label is None and p in (BOILER, CONTENT):
            n.label = p
    for n in nodes:
        n.label = FRAME if n.label is None else n.label
    return nodes


def training_pages(count: int = 1200, seed: int = 7) -> list[str]:
    """Labelled pages composed from parts: data-label=1 on content and data-label=0 on boilerplate."""
    r = random.Random(seed)
    syllables = "an the or ing re tion ed lo mi ra ve so ti na de".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(r.randint(a, b)))

    def sentence() -> str:
        return words(1, 30).capitalize() + r.choices([".", ""], [9, 1])[0]

    def named(*names: str) -> str:
        name = r.choice(names)
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="{name}-{words(1, 1).split()[0]}"', f' class="site-{name}"'])

    def links(a: int, b: int) -> str:
        return "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(r.randint(a, b)))

    def off(tag: str, attributes: str, inner: str) -> str:
        return f"<{tag}{attributes} data-label=0>{inner}</{tag}>"

    def bare_or(*names: str) -> str:
        return r.choice(["", named(*names)])

    everything = sorted(KIND_OF)

    def misnamed(often: float) -> str:
        """Names say little about some pages' articles: words from both sides, alone or joined, or words that say nothing."""
        if r.random() >= often:
            return ""
        name = "-".join(r.choice([r.choice(everything), words(1, 1)]) for _ in range(r.randint(1, 3)))
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {words(1, 1)}"'])

    def menu() -> str:
        return r.choice([off("nav", bare_or("menu", "nav"), f"<ul>{links(3, 9)}</ul>"), off("div", named("menu", "navbar", "breadcrumbs"), f"<ul>{links(2, 8)}</ul>"), off("ul", named("nav", "menu"), links(2, 8))])

    def header() -> str:
        inner = r.choice([f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 8)}</p>", f"<a href='#'>{words(1, 3)}</a><p>{sentence()}</p>", f"<h2>{words(1, 3)}</h2><ul>{links(2, 5)}</ul>"])
        return r.choice([off("header", bare_or("header", "masthead"), inner), off("div", named("header", "topbar", "masthead"), inner)])

    def footer() -> str:
        inner = r.choice([f"&copy; {words(1, 3)} &middot; {sentence()}", f"<p>{sentence()}</p><ul>{links(2, 4)}</ul>", f"<p>{words(2, 6)}</p>"])
        return r.choice([off("footer", bare_or("footer"), inner), off("div", named("footer", "copyright", "legal"), inner)])

    def prose(a: int, b: int) -> str:
        return "".join(f"<p>{' '.join(sentence() for _ in range(r.randint(1, 4)))}</p>" for _ in range(r.randint(a, b)))

    def side() -> str:
        inner = r.choice([f"<h3>{words(1, 3)}</h3><ul>{links(2, 6)}</ul>", prose(1, 2), sentence()])
        return r.choice([off("aside", bare_or("sidebar", "related"), inner), off("div", named("sidebar", "widget", "related", "popular"), inner)])

    def advert() -> str:
        return off(r.choice(["div", "div", "section", "aside", "p"]), named("ad", "ads", "advert", "sponsored", "promo"), r.choice([sentence(), f"<a href='#'>{sentence()}</a>"]))

    def advert_block() -> str:
        return off("div", named("ad", "advert", "sponsored", "promo"), r.choice([prose(1, 2), sentence()]))

    def notice() -> str:
        return off(r.choice(["div", "section", "dialog", "div"]), named("cookie", "notice", "consent", "newsletter", "popup", "alert"), r.choice([f"<p>{sentence()}</p>", sentence(), f"<p>{sentence()}</p><a href='#'>{words(1, 2)}</a>"]))

    def form() -> str:
        return off("form", bare_or("search", "login", "contact"), r.choice([f"<label>{words(1, 3)}</label><input>", f"<p>{sentence()}</p><label>{words(1, 2)}</label>", f"<fieldset><legend>{words(1, 3)}</legend>{words(1, 5)}</fieldset>"]))

    def comments() -> str:
        one = lambda: r.choice([f"<div class='comment'><p>{sentence()} {sentence()}</p></div>", f"<li class='reply'>{sentence()}</li>", f"<p>{sentence()}</p>", f"<article class='comment'><h4>{words(1, 2)}</h4><p>{sentence()}</p></article>"])
        return off(r.choice(["section", "div", "ol", "div"]), named("comments", "comment", "discussion", "replies", "respond"), f"<h3>{words(1, 3)}</h3>" * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 4))))

    def share() -> str:
        return off("div", named("share", "social"), r.choice([links(2, 4), words(1, 4)]))

    def body() -> str:
        short = r.random() < 0.2
        parts = [f"<h1>{words(1, 12)}</h1>"] * r.randint(0, 1) + [f"<p>{words(1, 4).capitalize()}.</p>" if short else prose(1, 7)]
        for _ in range(0 if short else r.randint(0, 3)):
            parts.append(
                r.choice(
                    [
                        f"<h2>{words(1, 6)}</h2>{prose(1, 3)}",
                        f"<ul>{''.join(f'<li>{sentence()}</li>' for _ in range(r.randint(2, 5)))}</ul>",
                        f"<ol>{''.join(f'<li>{words(1, 6)}</li>' for _ in range(r.randint(2, 5)))}</ol>",
                        f"<blockquote>{sentence()}</blockquote>",
                        f"<pre>{words(3, 12)}</pre>",
                        f"<table><tr><th>{words(1, 2)}</th><td>{words(1, 4)}</td></tr><tr><td>{words(1, 2)}</td><td>{words(1, 4)}</td></tr></table>",
                        f"<div>{prose(1, 3)}</div>",
                        f"<section>{prose(1, 2)}</section>",
                        f"<p>{sentence()} <a href='#'>{words(1, 3)}</a> {sentence()}</p>",
                        f"<figure><figcaption>{words(2, 9)}</figcaption></figure>",
                        f"<dl><dt>{words(1, 2)}</dt><dd>{sentence()}</dd></dl>",
                        f"<p><b>{sentence()}<br><p>{sentence()}</p>",
                    ]
                )
            )
        head, rest = parts[:1], parts[1:]
        r.shuffle(rest)
        inside = [f() for f in (advert, advert_block, share, form, notice, comments, menu, side) if r.random() < 0.05]
        for x in inside:
            rest.insert(r.randint(0, len(rest)), x)
        return "".join(head + rest)

    def article() -> str:
        return r.choice(
            [
                f"<article{misnamed(0.1)} data-label=1>{body()}</article>",
                f"<article data-label=1>{body()}</article>",
                f"<main><article{named('post', 'entry')} data-label=1>{body()}</article></main>",
                f"<main{misnamed(0.1)} data-label=1>{body()}</main>",
                f"<div{named('content', 'article', 'post', 'entry', 'story', 'main')} data-label=1>{body()}</div>",
                f"<div{misnamed(0.6)} data-label=1>{body()}</div>",
                f"<section{misnamed(0.3)} data-label=1>{body()}</section>",
                f"<div{named('content', 'main')}><div{named('entry', 'text')} data-label=1>{body()}</div>{comments()}</div>",
            ]
        )

    out = []
    for _ in range(count):
        before = [f() for f, p in ((header, 0.4), (menu, 0.8), (notice, 0.3), (advert, 0.5), (form, 0.2), (side, 0.15), (share, 0.1)) if r.random() < p]
        after = [f() for f, p in ((comments, 0.3), (side, 0.3), (advert, 0.2), (form, 0.15), (notice, 0.2), (share, 0.2), (menu, 0.1), (footer, 0.85)) if r.random() < p]
        r.shuffle(before)
        page = "".join(before) + article() + "".join(after)
        page = f"<div{bare_or('page', 'wrapper')}>{page}</div>" if r.random() < 0.25 else page
        out.append(f"<html><head data-label=0><title>{words(1, 5)}</title></head><body>{page}</body></html>")
    return out


_model: TreeModel | None = None


def model() -> TreeModel:
    """The trained model, made once a process."""
    global _model
    if _model is None:
        _model = TreeModel(training_pages())
    return _model


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of page_id, url and html."""

    m = model()  # trained on the driver; its counts go to the workers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [m.main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    small_batches(pages.sparkSession)
    return spread(pages.select("page_id", "url", "html")).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op8_main_text(spark, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    return main_texts(table(spark, sf_dir, "pages"))
