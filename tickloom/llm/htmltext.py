"""Main text of web pages by a site style tree.

All pages of a host are merged into one style tree: a node is a path of
elements (tag, class and id from the root down).  Two entropies, with the
number m of the host's pages that have the node as the base of the logarithm,
say how important a node is:

* presentation: the entropy of the ways in which pages lay out its children;
  a node that looks the same on every page scores 0;
* content: 1 less the mean entropy of its texts and links over pages; a text
  that all pages share scores 0, a text of one page scores 1.

A leaf counts by its content; an inner branch by its own presentation and, with
the larger weight the more it holds, by its children.  A page loses every branch
that is below a threshold with all its own branches, as well as elements that
are no reading matter by their kind (navigation, forms, scripts ...) or by
a class, id or role that says so as a whole; but an element that wraps a main
element, all articles or most of the page's text stays.  An article or main element is a landmark: if
a page has one, its text is the page's, and its declaration is a prior on the
importance of the branches inside, which go at a smaller importance than others.

Pages that are copies of one another add up to one page in the counts, so that
a text copied many times on its own host does not look like a template.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import cut_lineage

LOW = 0.3  # composite importance below which a branch goes
PRIOR = 0.15  # least importance of a branch inside a landmark; what its texts and layouts say fills the rest
LEAST_PAGES = 4  # different pages of a host, from which on its tree says something
DECAY = 0.9
# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "head script style noscript template svg math nav footer aside form button select option textarea input label "
    "iframe object embed canvas audio video map menu dialog title link meta fieldset legend".split()
)
# kinds of these that may wrap a page's text; the style tree reads them too
WRAPS = frozenset("form fieldset label aside dialog map".split())
NEVER = DROPPED - WRAPS  # never read, whatever is inside
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody "
    "tfoot tr td th figure figcaption header footer aside nav form address hr details summary hgroup fieldset center".split()
)
# an opening tag ends the open elements of these kinds, up to the nearest of the others
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "summary"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# classes, ids and roles that name what is no main text, alone or with a word of PLACE before or of BOX behind them
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "complementary contentinfo cookie cookies consent copyright disclaimer disqus footer gdpr header login masthead menu "
    "menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup popups promo promoted "
    "promotion recommended related replies respond search share sharing sidebar sidebars signup skip social sponsor "
    "sponsored subscribe subscription tags toc toolbar topbar widget widgets".split()
)
PLACE = frozenset("site page global top bottom left right main primary secondary post entry cookie google js".split())
BOX = frozenset(
    "area bar block box button buttons container content form group inner item items link links list message outer panel "
    "popup section slot unit widget wrap wrapper".split()
)
# names that inside a landmark are its own
OF_LANDMARK = frozenset("header notice notices disclaimer skip".split())
LANDMARKS = ("article", "main")

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMED = ("class", "id", "role", "hidden", "aria-hidden", "style", "href")
_SPLIT = re.compile(r"[-_]+")


@dataclass
class Node:
    """An element with its children, texts among them."""

    tag: str
    attributes: dict[str, str]
    parent: Node | None = None
    children: list = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    if not text.strip(" /\t\r\n"):
        return {}
    found = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        name = name.lower()
        if name in _NAMED and name not in found:
            found[name] = html.unescape(a or b or c)
    return found


def parse(source: str) -> Node:
    """The tree of a page; tags that are not closed end where HTML lets them, and nothing is refused."""
    root = Node("#page", {})
    open_ = root
    at = 0

    def say(text: str) -> None:
        if text:
            open_.children.append(html.unescape(text) if "&" in text else text)

    position = 0
    while m := _TAG.search(source, position):
        say(source[at: m.start()])
        at = position = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            node = open_
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                open_ = node.parent
            continue
        if tag in ENDS_PARAGRAPH:
            node = open_
            while node is not root and node.tag != "p" and (node.tag not in BLOCKS):
                node = node.parent
            if node.tag == "p":
                open_ = node.parent
        if tag in ENDS:
            ended, stops = ENDS[tag]
            node, last = open_, None
            while node is not root and node.tag not in stops:
                if node.tag in ended:
                    last = node
                node = node.parent
            if last is not None:
                open_ = last.parent
        node = Node(tag, _attributes(m[3]), open_)
        open_.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
            stop = end.start() if end else len(source)
            at = position = stop
            open_ = node
        elif tag not in VOID:
            open_ = node
    say(source[at:])
    return root


def _noise_names(node: Node) -> set[str]:
    """The words of NOISE that a class, id or role of an element is, as a whole; a heading's id is made from its text."""
    kinds = ("class", "role") if node.tag in HEADINGS else ("class", "id", "role")
    found = set()
    for name in " ".join(node.attributes.get(k, "") for k in kinds).split():
        words = [w for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
        while words and re.fullmatch(r"[\dx]*\d", words[-1]):  # numbers and sizes
            words.pop()
        if words:
            words[-1] = words[-1].rstrip("0123456789")
        while len(words) > 1 and words[0] in PLACE:
            words = words[1:]
        while len(words) > 1 and words[-1] in BOX:
            words.pop()
        if words and all(w in NOISE for w in words):
            found.update(words)
    return found


def no_reading(node: Node) -> bool:
    """Whether an element's kind, names or style say that it is no main text."""
    if node.tag in DROPPED:
        return True
    if node.tag == "header" and not _inside(node, LANDMARKS):
        return True
    return bool(node.attributes) and (_hidden(node) or _named_noise(node))


def _hidden(node: Node) -> bool:
    if "hidden" in node.attributes or node.attributes.get("aria-hidden", "").lower() == "true":
        return True
    style = node.attributes.get("style", "").replace(" ", "").lower()
    return "display:none" in style or "visibility:hidden" in style


def _named_noise(node: Node) -> bool:
    if node.tag in ("html", "body", "main", "article") or not any(k in node.attributes for k in ("class", "id", "role")):
        return False
    found = _noise_names(node)
    return bool(found) and not (found <= OF_LANDMARK and _inside(node, LANDMARKS))


class Reading:
    """Which elements of a page are read."""

    def __init__(self, page: Node):
        self.page = page
        self.answers: dict[int, bool] = {}
        self.whole: tuple[int, int] | None = None

    def leaves_out(self, node: Node) -> bool:
        key = id(node)  # nodes live as long as their page
        if key not in self.answers:
            self.answers[key] = no_reading(node) and (
                node.tag in NEVER or (bool(node.attributes) and _hidden(node)) or not self._wraps(node)
            )
        return self.answers[key]

    def _wraps(self, node: Node) -> bool:
        """Whether an element holds a main element, all articles of the page or most of its text."""
        letters, articles, mains = _held(node)
        if mains:
            return True
        if self.whole is None:
            self.whole = _held(self.page)[:2]
        # cards of other articles stand in an aside
        return 2 * letters > self.whole[0] or (0 < articles == self.whole[1] and node.tag != "aside")


def _held(node: Node) -> tuple[int, int, int]:
    """(characters of text, articles, main elements) below an element, without what is never read."""
    letters = articles = mains = 0
    stack = [node]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str):
                letters += len(c) - c.count(" ") - c.count("\n")
            elif c.tag not in NEVER and not (c.attributes and _hidden(c)):
                role = c.attributes.get("role", "")
                articles += "article" in (c.tag, role)
                mains += "main" in (c.tag, role)
                stack.append(c)
    return letters, articles, mains


def _inside(node: Node, tags: tuple[str, ...]) -> bool:
    node = node.parent
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _label(node: Node) -> str:
    """An element's part of its path; digits in names are numbers of the page, not of the template."""
    if not node.attributes:
        return node.tag
    names = re.sub(r"\d+", "", f"{node.attributes.get('class', '')}#{node.attributes.get('id', '')}")
    return f"{node.tag}.{' '.join(names.split())}"


def _digest(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))
    return value - (1 << 64) * (value >> 63)


def _own(node: Node) -> str:
    """An element's own text, with its link target, in one line."""
    own = " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())
    return f"{own} {node.attributes['href']}" if own and "href" in node.attributes else own


def style_rows(page: Node) -> list[tuple[int, int, str, int]]:
    """(path, depth, kind, digest) of a page's style nodes: its layouts and its texts, each once."""
    found = set()
    stack = [(page, _digest("#page"), 0)]
    while stack:
        node, path, depth = stack.pop()
        inner = [c for c in node.children if isinstance(c, Node) and c.tag not in NEVER]
        if inner:
            layout = []
            for c in inner:  # repeated siblings are one style
                label = _label(c)
                if not layout or layout[-1] != label:
                    layout.append(label)
            found.add((path, depth, "layout", _digest("|".join(layout))))
        own = _own(node)
        if own:
            found.add((path, depth, "text", _digest(own)))
        stack.extend((c, _below(path, _label(c)), depth + 1) for c in inner)
    return list(found)


@lru_cache(1 << 16)
def _below(path: int, label: str) -> int:
    """The path of a child."""
    return _digest(f"{path}>{label}")


class Importance:
    """Composite importance of a page's branches under its host's style tree."""

    def __init__(self, known: dict[int, tuple[float | None, float | None]]):
        self.known = known
        self.seen: dict[tuple[int, float], tuple[float, int, bool]] = {}

    def of(self, node: Node, path: int, prior: float) -> tuple[float, int, bool]:
        """(importance, weight of texts below, whether all of it is noise) of a branch; unknown nodes are important."""
        key = (id(node), prior)  # nodes live as long as their page
        if key not in self.seen:
            self.seen[key] = self._of(node, path, prior)
        return self.seen[key]

    def _of(self, node: Node, path: int, prior: float) -> tuple[float, int, bool]:
        layout, text = self.known.get(path, (None, None))
        total, weight, noise = 0.0, 0, True
        own = _own(node)
        if own:
            total, weight = 1.0 if text is None else prior + (1 - prior) * text, 1
            noise = total < LOW
        inner = False
        for c in node.children:
            if isinstance(c, Node) and c.tag not in NEVER:
                value, n, low = self.of(c, _below(path, _label(c)), prior)
                if n:
                    inner, noise = True, noise and low
                    total, weight = (total * weight + value * n) / (weight + n), weight + n
        if inner and layout is not None:
            # more texts below leave less say to the layout alone
            share = 1 - DECAY**weight
            total = (1 - share) * (prior + (1 - prior) * layout) + share * total
        return total, weight, noise and total < LOW


_DEEP = 400  # branches below are kept or dropped with the branch at this depth


def main_text(source: str, known: dict[int, tuple[float | None, float | None]]) -> str:
    """The main text of a page; ``known`` has (layout, text) importance by path for its host."""
    page = parse(source)
    reading = Reading(page)
    _flattened(page, reading)
    importance = Importance(known)

    def landmarks(node: Node, path: int) -> Iterator[tuple[Node, int]]:
        for c in node.children:
            if isinstance(c, Node) and not reading.leaves_out(c):
                below = _below(path, _label(c))
                if c.tag in LANDMARKS or c.attributes.get("role", "") in LANDMARKS:
                    # an article inside a main element is what that is about
                    inner = [x for x in landmarks(c, below) if x[0].tag == "article"] if c.tag != "article" else []
                    yield from inner or [(c, below)]
                else:
                    yield from landmarks(c, below)

    blocks: list[str] = []
    words: list[str] = []

    def flush() -> None:
        text = " ".join("".join(words).split())
        if text:
            blocks.append(text)
        words.clear()

    def read(node: Node, path: int, prior: float) -> None:
        """Append the blocks of a branch without its branches of low importance."""
        for c in node.children:
            if isinstance(c, str):
                words.append(c)
            elif c.tag in ("br", "wbr"):
                words.append(" ")
            elif not reading.leaves_out(c):
                below = _below(path, _label(c)) if known else path
                if known and (c.tag in BLOCKS or c.tag == "a"):
                    _, n, noise = importance.of(c, below, prior)
                    if n and noise:
                        continue
                block = c.tag in BLOCKS
                if block:
                    flush()
                read(c, below, prior)
                if block:
                    flush()

    top = _digest("#page")
    marks = list(landmarks(page, top))
    if marks:
        for node, path in marks:
            read(node, path, PRIOR)
            flush()
    else:
        read(page, top, 0.0)
    flush()
    return "\n".join(blocks)


def _flattened(page: Node, reading: Reading) -> Node:
    """The tree with elements below _DEEP levels joined to their ancestor there, so that recursion is bounded."""
    stack = [(page, 0)]
    while stack:
        node, depth = stack.pop()
        if depth < _DEEP:
            stack.extend((c, depth + 1) for c in node.children if isinstance(c, Node))
            continue
        flat, rest = [], list(reversed(node.children))
        while rest:
            c = rest.pop()
            if isinstance(c, str):
                flat.append(c)
            elif not reading.leaves_out(c):
                edge = [" "] if c.tag in BLOCKS or c.tag == "br" else []
                rest.extend([*edge, *reversed(c.children), *edge])
        node.children = flat
    return page


def host_of(url: Column) -> Column:
    """The host of an address, in lower case, without a port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, layout, text): the importance of each host's style nodes, where it is known and not full.

    Nodes whose two scores are both missing or 1 say nothing and are left out,
    so the table holds what a host's pages have in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out = []
                for host, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    page = parse(source)
                    rows = style_rows(_flattened(page, Reading(page)))
                    # pages with the same nodes are copies
                    same = _digest(",".join(map(str, sorted(r[3] for r in rows))))
                    out.extend((host, same, path, kind == "text", digest) for path, _, kind, digest in rows)
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()))],
                        ["host", "same", "path", "is_text", "digest"],
                    )

    known = pages.where("host <> '' AND html IS NOT NULL").select("host", "html")
    # written once: three aggregates read it, and parsing is what costs
    rows = cut_lineage(known.mapInArrow(run, "host string, same long, path long, is_text boolean, digest long"))
    # pages that show each style or text of a node; copies of a page are one
    shown = rows.distinct().groupBy("host", "path", "is_text", "digest").agg(F.count(F.lit(1)).alias("k"))
    node = shown.groupBy("host", "path", "is_text").agg(
        F.count(F.lit(1)).alias("kinds"),
        F.sum("k").alias("total"),
        F.sum(F.col("k") * F.log("k")).alias("klogk"),
        F.avg(F.log("k")).alias("mean_log"),
        F.max("k").alias("most"),
    )
    m = F.col("total").cast("double")
    # layouts: one of each page; -sum p log p = log m - sum k log k / m
    layout = (F.log(m) - F.col("klogk") / m) / F.log(m)
    # texts: a text on k of m pages has entropy log k / log m; a node may have several texts a page
    pages_of = rows.where("is_text").select("host", "path", "same").distinct().groupBy("host", "path").agg(F.count(F.lit(1)).alias("m"))
    layouts = node.where(f"NOT is_text AND total >= {LEAST_PAGES}").select("host", "path", layout.alias("layout"))
    texts = (
        node.where("is_text").join(pages_of, ["host", "path"]).where(f"m >= {LEAST_PAGES}")
        .select("host", "path", (1 - F.col("mean_log") / F.log(F.col("m").cast("double"))).alias("text"))
    )
    both = layouts.join(texts, ["host", "path"], "full")
    # a node that is important by its texts, or has none, needs no entry
    return both.where("text < 0.95 OR (text IS NULL AND layout < 0.95)")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages`` (page_id, url, html).

    Nulls: a null html gives an empty text; a page without a host, or on a host
    with fewer than LEAST_PAGES different pages, is judged by its elements
    alone.  Repeated rows are extracted each; an empty table gives no rows;
    other columns are not read.
    """
    base = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    tree = style_tree(base)
    per_host = cut_lineage(
        tree.groupBy("host").agg(F.collect_list(F.struct("path", "layout", "text")).alias("nodes"))
    )
    id_type = pages.schema["page_id"].dataType.simpleString()
    url_type = pages.schema["url"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                trees: dict[str, dict] = {}
                texts = []
                hosts = part.column(2).to_pylist()
                for i, (host, source) in enumerate(zip(hosts, part.column(3).to_pylist())):
                    if host not in trees:
                        trees[host] = {n["path"]: (n["layout"], n["text"]) for n in part.column(4)[i].as_py() or ()}
                    texts.append(main_text(source, trees[host]) if source else "")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    # the table just written has a known size: the planner sends it whole if small, else it shuffles
    joined = base.join(per_host, "host", "left").select("page_id", "url", "host", "html", "nodes")
    return joined.mapInArrow(run, f"page_id {id_type}, url {url_type}, text string, n_chars long")
