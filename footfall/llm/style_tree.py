"""Main text of web pages by a site style tree.

The DOMs of a host are merged: nodes with the same path of tags and classes are one node of the tree. An element node is
important if pages present it in many ways (the entropy of its child sequences), a text node if its contents differ from
page to page (one minus the entropy of each content over the pages that hold it). An element takes its importance from
its own presentations and from the texts below it. Branches of low importance are removed from every page, and what is
left is the text.

Tags that say what a branch is for count as presentation: a navigation or footer has no importance whatever it holds, and
where pages name their article, only that is looked at, if it holds enough of the text that is left (`main_branches`).
Class names and forms are weaker evidence (`settle`): a branch called sidebar goes if it is a small part of its page or if
the entropies say so too; reader comments go unless they are all there is. So a host of a few pages, where entropies say nothing, gives the same text as a large one. Nodes of
the tree are elements that form blocks; inline elements belong to their block.
"""

from __future__ import annotations

import heapq
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.arrow import map_slices
from footfall.llm.near_dedup import mixed
from footfall.operators.joins import salted_join
from footfall.sources.staging import stage

#: Tags without content, tags whose content is no text, and tags that begin a block (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg annotation annotation-xml textarea title select canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What closes an open p, and what closes an open element of its own kind (fixed values of HTML).
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "option", "optgroup"}
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
#: Where a search for an element to close ends.
SCOPES = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
#: Tags, roles and words of class names that tell a branch which is never main text. A header of an article holds its headline.
ASIDE_TAGS = frozenset("nav footer aside header menu dialog button head search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal "
    "overlay newsletter subscribe subscription signup login sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer "
    "header masthead topbar toolbar share sharing social related recommended recommendations widget comment comments disqus replies reply respond form".split()
)
#: Words that may stand beside them in a class or id (``comment-list``, ``site-nav``). Beside any other word they tell
#: nothing: ``has-sidebar`` is a layout, ``related-work`` a chapter, ``article-header`` a title.
CARRIERS = frozenset(
    "box boxes container wrapper wrap block area section list bar inner outer slot unit panel group top bottom left right site page global main primary "
    "secondary link links button buttons icon icons item items post posts article articles entry story blog".split()
)
#: Further words that tell an article which is not the page's.
TEASERS = frozenset("teaser teasers card cards preview previews tile tiles snippet snippets".split())
ARTICLE_WORDS = ASIDE_WORDS | TEASERS
TITLED = frozenset("post article entry story blog".split())
#: Names of threads of reader comments, which go however long they are.
THREAD_WORDS = frozenset("comment comments disqus respond".split())
#: Characters of a branch that are a small part of any page that has other text.
LINE = 80
#: Blocks whose classes and ids name asides.
NAMED = BLOCKS - frozenset("html body main h1 h2 h3 h4 h5 h6".split())
#: Weight of what lies below a node, least importance that stays, and pages that a node needs for its entropies to count.
BELOW, LEAST, PAGES = 0.9, 0.2, 8
#: Bins of a sketch, share of them in which near copies agree (pages without a named main text agree in their frame, too),
#: and pages that a bin is compared with.
BINS, COPY, COPY_WHOLE, HUBS = 32, 0.5, 0.9, 4
#: Levels of the tree; elements below belong to their ancestor there.
DEPTH = 64

#: Comments, declarations, and tags; a tag whose quotes do not match ends at the first ``>``.
TOKENS = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)(?:((?:[^>"']|"[^"]*"|'[^']*')*)>|([^>]*)(?:>|\Z))""", re.S
)
ATTRIBUTES = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACE = re.compile(r"\s+")


class Node:
    """An element: its name in the tree (tag, classes, id), its children (elements and texts), and its parent."""

    __slots__ = ("aside", "children", "name", "named", "outside", "parent", "size", "tag", "thread")

    def __init__(self, tag: str, name: str, aside: bool, parent: Node | None, named: bool = False, thread: bool = False):
        self.tag, self.name, self.aside, self.parent, self.named, self.thread = tag, name, aside, parent, named, thread
        self.children: list = []


#: What ``names_aside`` has said in this worker. A dictionary travels with the function; a caching decorator would only be found
#: where the package is installed.
_SAID: dict[tuple[str, frozenset[str]], bool] = {}


def names_aside(label: str, asides: frozenset[str] = ASIDE_WORDS) -> bool:
    """Whether a whole class or id is the name of an aside."""
    said = _SAID.get((label, asides))
    if said is None:
        words = set(re.findall(r"[^\W\d_]+", label))
        titled = "header" in words and words & TITLED
        said = not titled and not words.isdisjoint(asides) and words <= asides | CARRIERS
        if len(_SAID) >= 4096:
            _SAID.clear()
        _SAID[label, asides] = said
    return said


def _in_article(node: Node | None) -> bool:
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def _element(tag: str, attributes: str, parent: Node) -> Node:
    headline = tag == "header" and _in_article(parent)
    if "=" not in attributes and "hidden" not in attributes:
        return Node(tag, tag, tag in ASIDE_TAGS and not headline, parent, tag == "form")
    known = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTES.findall(attributes)}
    labels = f"{known.get('class', '')} {known.get('id', '')}".lower()
    hidden = "hidden" in known or known.get("aria-hidden") == "true" or "display:none" in known.get("style", "").replace(" ", "").lower()
    aside = bool(tag in ASIDE_TAGS and not headline or known.get("role", "").lower() in ASIDE_ROLES or hidden)
    words = ASIDE_WORDS if tag != "article" else ARTICLE_WORDS
    # Words of inline elements and headings tell what they say, not what they are for.
    named = not aside and not headline and tag in NAMED and any(names_aside(x, words) for x in labels.split())
    thread = named and any(names_aside(x, THREAD_WORDS) for x in labels.split())
    # Numbers in classes and ids differ from page to page; they are one name in the tree.
    label = re.sub(r"\d+", "#", SPACE.sub(".", labels.strip()))
    return Node(tag, f"{tag}.{label}" if label else tag, aside, parent, named or not aside and tag == "form", thread)


def parse(page: str) -> Node:
    """The DOM of a page: elements and texts, without comments, scripts and the like. Missing end tags are put where HTML
    puts them; a stray ``<`` is text."""
    root = at = Node("", "", False, None)
    place, raw, named, held = 0, None, [], []
    for m in TOKENS.finditer(page):
        if m.start() < place:
            continue
        if m.start() > place:
            at.children.append(page[place : m.start()])
        place = m.end()
        if not (tag := m[2]):
            continue
        tag = tag.lower()
        if m[1]:
            node = at
            while node.parent is not None and node.tag != tag:
                if tag not in BLOCKS and node.tag in BLOCKS - {"p"}:
                    node = root
                    break
                node = node.parent
            if node is not root:
                at = node.parent
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                raw = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, place)
                place = raw.end() if raw else len(page)
            at.children.append(Node(tag, tag, True, at))
            continue
        closes = {"p"} if tag in CLOSES_P else set()
        closes |= SIBLINGS.get(tag, set())
        if closes:
            node, end, stop = at, None, SCOPES.get(tag, set())
            while node.parent is not None and node.tag not in stop and (node.tag in closes or node.tag not in BLOCKS or node.tag == "p"):
                if node.tag in closes:
                    end = node
                node = node.parent
            if end is not None:
                at = end.parent
        attributes = m[3] or m[4] or ""
        child = _element(tag, attributes, at)
        at.children.append(child)
        if child.named:
            named.append(child)
        elif tag in ("article", "main"):
            held.append(child)
        if tag not in VOID and not attributes.endswith("/"):
            at = child
    if place < len(page):
        at.children.append(page[place:])
    if named:
        settle(root, named, held)
    return root


def settle(root: Node, named: list[Node], held: list[Node]) -> None:
    """Make asides of the named elements that are a small part of their page: no longer than the text outside of named
    elements, or than a line. Others are branches like any (the entropies may still remove them), all of their name with
    them, and what lies in them outside of further named elements counts as outside from then on. Threads of reader comments are
    asides whatever their length if text lies outside. Elements that hold a main element or the page's article are never asides; of
    several articles alike in length none is the page's. Forms are named elements: some hold the whole page. ``named`` and ``held`` (articles and main elements) are in page order.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and not c.aside]
    for node in reversed(order):
        size = outside = 0
        for c in node.children:
            if isinstance(c, str):
                n = len(c.strip())
                size += n
                outside += n
            elif not c.aside:
                size += c.size
                outside += 0 if c.named else c.outside
        node.size, node.outside = size, outside
    inside: dict[Node, dict[str, list[Node]]] = {}  # by the named element above and by name, as a list of cards is one thing
    seen = set(order)
    for node in named:
        if node in seen:
            over = node.parent
            while over is not root and not over.named:
                over = over.parent
            inside.setdefault(over, {}).setdefault(node.name, []).append(node)
    below, articles = set(), []
    for node in held:
        over = node.parent
        while over is not None and over not in below:
            over = over.parent
        if node.tag == "article" and node in seen and over is None:
            articles.append(node)
            below.add(node)
    articles.sort(key=lambda n: -n.size)
    held = [n for n in held if n.tag == "main" and n in seen]
    if articles and (len(articles) == 1 or articles[0].size >= 2 * articles[1].size):
        held.append(articles[0])
    holds = set()
    for node in held:
        while node is not None and node not in holds:
            holds.add(node)
            node = node.parent
    queue, n = [], 0

    def add(top: Node) -> None:
        nonlocal n
        for alike in inside.get(top, {}).values():
            n += 1
            size = max(min(x.size, 1) if x.thread else x.size for x in alike)
            heapq.heappush(queue, (holds.isdisjoint(alike), -size, n, alike))

    add(root)
    rest = root.outside
    while queue and (not queue[0][0] or -queue[0][1] > (max(rest, LINE) if rest else 0)):
        for node in heapq.heappop(queue)[3]:
            rest += node.outside
            add(node)
    for *_, alike in queue:
        for node in alike:
            node.aside = True


def step(path: str, node: Node) -> str:
    """The path of a child: its block's, if it forms none itself or lies deeper than the tree goes."""
    return f"{path}/{node.name}" if node.tag in BLOCKS and path.count("/") < DEPTH else path


def walk(root: Node) -> Iterator[tuple[Node, str]]:
    """All elements in page order, each with its path."""
    todo = [(root, "")]
    while todo:
        node, path = todo.pop()
        yield node, path
        todo += [(c, step(path, c)) for c in reversed(node.children) if isinstance(c, Node)]


def main_branches(root: Node, tree: list[tuple[Node, str]], removed: frozenset[str] = frozenset()) -> list[Node]:
    """The elements that are the main text, chosen by the amount of text in them without the branches in ``removed``.

    Articles are, if the longest holds half as much as lies outside of articles; else the main element or the whole page
    is, with the articles in it. A main element is the part of the page that is looked at, unless an article elsewhere is
    twice as long or twice as much lies outside of both. ``tree`` is the `walk` of the page.
    """
    def named(tops: list[Node]) -> tuple[list[Node], list[Node]]:
        """Topmost articles and main elements below ``tops``."""
        articles, mains, todo = [], [], [c for top in reversed(tops) for c in reversed(top.children)]
        while todo:
            node = todo.pop()
            if isinstance(node, str) or node.aside:
                continue
            if node.tag == "article":
                articles.append(node)
            elif node.tag == "main" or node.name.endswith(".main"):
                mains.append(node)
            else:
                todo += reversed(node.children)
        return articles, mains

    articles, mains = named([root])
    if not articles and not mains:
        return [root]
    for node, path in reversed(tree):
        size = 0
        if not node.aside and not (node.tag in BLOCKS and path in removed):
            for c in node.children:
                size += len(c.strip()) if isinstance(c, str) else c.size
        node.size = size

    def total(nodes: list[Node]) -> int:
        return sum(n.size for n in nodes)

    tops = [root]
    if mains and 2 * total(mains) >= max((n.size for n in articles), default=0) and 2 * total(mains) >= root.size - total(mains) - total(articles):
        tops, articles = mains, []
    while mains:  # a main element inside another adds nothing but its articles
        more, mains = named(mains)
        articles += more
    if articles and 2 * max(n.size for n in articles) >= total(tops) - total(articles):
        if len(articles) > 1:
            place = {node: i for i, (node, _) in enumerate(tree)}
            articles.sort(key=place.__getitem__)
        return articles
    return tops


def blocks(node: Node, path: str, removed: frozenset[str] = frozenset()) -> Iterator[tuple[str, str]]:
    """``path, text`` of every block below a node in page order, without the branches in ``removed`` and asides."""
    parts: list[str] = []
    at = path
    todo: list = [(node, path, False)]
    while todo:
        item, own, closing = todo.pop()
        if isinstance(item, str):
            if not parts:
                at = own
            parts.append(item)
            continue
        block = item.tag in BLOCKS or item is node
        if block and parts:
            if text := SPACE.sub(" ", html.unescape("".join(parts))).strip():
                yield at, text
            parts = []
        if closing:
            continue
        if item.tag == "br":
            parts.append(" ")
        if item is not node and (item.aside or block and own in removed):
            parts += [] if block else [" "]
            continue
        if block:
            todo.append((item, own, True))
        for c in reversed(item.children):
            todo.append((c, own if isinstance(c, str) else step(own, c), False))
    if parts and (text := SPACE.sub(" ", html.unescape("".join(parts))).strip()):
        yield at, text


def plain(node: Node) -> str:
    """All texts below a node without asides, a space between any two; cheaper than its blocks."""
    parts, todo = [], [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            parts.append(item)
        elif item is node or not item.aside:
            todo += reversed(item.children)
    return " ".join(html.unescape(" ".join(parts)).split())


def main_text(page: str, removed: frozenset[str] = frozenset()) -> str:
    """The blocks of the main branches, one per line, without asides and the branches in ``removed``."""
    root = parse(page)
    tree = list(walk(root))
    paths = dict(tree)
    lines: list[str] = []
    for branch in main_branches(root, tree, removed):
        lines += [text for _, text in blocks(branch, paths[branch], removed)]
    return "\n".join(lines)


def sketch(text: str) -> np.ndarray:
    """The least hash of word pairs in each of 32 bins; near copies agree in most. Scripts without spaces give characters."""
    words = text.encode().split()
    if len(text) > 20 * len(words):
        words = [c.encode() for c in text]
    h = np.array([zlib.crc32(w) for w in words], np.uint64)
    h = np.sort(mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) > 1 else h))
    bins = h >> np.uint64(64 - BINS.bit_length() + 1)
    return (h[np.diff(bins, prepend=np.uint64(BINS)) != 0] >> np.uint64(1)).astype(np.int64)


PAGE = "host string, key long, page long, whole boolean, bins array<long>, nodes array<struct<path:string,kind:int,feature:long>>"


def styles(pages: DataFrame) -> DataFrame:
    """A row per page of ``host, html``: hashes of its main text and of itself, whether the main text is the whole page, the
    sketch, and the nodes of its tree (kind 0: presentation, 1: content, 2: the longest main branch)."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, ids, whole, bins, sizes, nodes = [], [], [], [], [], []
            for page in batch.column("html").to_pylist():
                root, own = parse(page or ""), set()
                tree = list(walk(root))
                paths = dict(tree)
                for node, path in tree:
                    if node.tag not in BLOCKS and node is not root:
                        continue
                    names = [c.name for c in node.children if isinstance(c, Node) and c.tag in BLOCKS]
                    runs = [n for i, n in enumerate(names) if not i or names[i - 1] != n]  # a longer list is no other style
                    own.add((path, 0, xxhash.xxh64_intdigest(" ".join(runs)) >> 1))
                own |= {(path, 1, xxhash.xxh64_intdigest(text) >> 1) for path, text in blocks(root, "")}
                branches = main_branches(root, tree)
                held = [plain(b) for b in branches]
                longest = max(range(len(held)), key=lambda i: len(held[i]))
                own.add((paths[branches[longest]], 2, 0))
                text = " ".join(held)
                keys.append(xxhash.xxh64_intdigest(text) >> 1)
                ids.append(xxhash.xxh64_intdigest(page or "") >> 1)
                whole.append(branches == [root])
                bins.append(sketch(text))
                sizes.append(len(own))
                nodes += own
            path, kind, feature = zip(*nodes, strict=True)
            flat = pa.StructArray.from_arrays([pa.array(path, pa.string()), pa.array(kind, pa.int32()), pa.array(feature, pa.int64())], ["path", "kind", "feature"])
            ends = lambda lengths: pa.array(np.r_[0, np.cumsum(lengths)], pa.int32())
            columns = [
                batch.column("host"), pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(whole, pa.bool_()),
                pa.ListArray.from_arrays(ends([len(b) for b in bins]), pa.array(np.concatenate(bins))), pa.ListArray.from_arrays(ends(sizes), flat),
            ]
            return pa.RecordBatch.from_arrays(columns, ["host", "key", "page", "whole", "bins", "nodes"])

        return work

    return map_slices(pages, make, PAGE)


def near_copies(texts: DataFrame) -> DataFrame:
    """``host, key`` of the main texts that are near copies of another one of their host with a smaller key.

    Every bin of a sketch is compared with the texts of the smallest keys that share it, one of each of four classes of
    keys; a text that agrees with one of them in enough bins is its copy. The smallest key of a group is no copy.
    """
    least = F.when(F.col("whole"), COPY_WHOLE).otherwise(COPY) * F.size("bins")
    members = texts.select("host", "key", least.alias("least"), F.explode("bins").alias("bin"))
    of_class = [F.min(F.when(F.pmod("key", F.lit(HUBS)) == c, F.col("key"))) for c in range(HUBS)]
    shared = members.groupBy("host", "bin").agg(F.array_compact(F.array(*of_class)).alias("hubs"), F.count("*").alias("n")).where("n > 1")
    hubs = shared.select("host", "bin", F.explode("hubs").alias("hub"))
    met = salted_join(members, hubs, ["host", "bin"], ["key"]).where(F.col("hub") < F.col("key"))
    return met.groupBy("host", "key", "hub", "least").count().where(F.col("count") >= F.col("least")).select("host", "key").distinct()


def node_features(pages: DataFrame) -> DataFrame:
    """``host, path, kind, feature, n``: on how many pages of a host a node of the tree has a presentation (kind 0, the
    sequence of its children) or a content (kind 1, its text), and how often it is the longest main branch (kind 2).

    Pages of one main text count once, as do near copies: what copies repeat is no frame.
    """
    row = F.struct("whole", "bins", "nodes")
    texts = styles(pages).groupBy("host", "key").agg(F.min_by(row, "page").alias("row")).select("host", "key", "row.*")
    texts = stage(texts, "page-styles")
    counted = texts.join(near_copies(texts), ["host", "key"], "left_anti").select("host", F.explode("nodes").alias("node"))
    return counted.groupBy("host", "node.path", "node.kind", "node.feature").agg(F.count("*").alias("n"))


def importance(features: DataFrame) -> DataFrame:
    """``host, path, pages, main, importance`` of every node of the style trees; ``main`` if it is a longest main branch.

    With m pages and presentations of probability p, an element's own importance is the entropy of p to the base m. A
    content on n of m pages, as likely on each, has the entropy log n to the base m; the importance of a text node is one
    minus the mean over its contents. Both are 1 for a node of one page. An element weighs its own importance with
    1 - 0.9 and the mean of the texts below it, each by its number of contents, with 0.9.
    """
    shown = F.when(F.col("kind") == 0, F.col("n"))
    style = features.where("kind <> 1").groupBy("host", "path").agg(
        F.sum(shown).alias("pages"), F.sum(shown * F.log("n")).alias("s"), F.max(F.col("kind") == 2).alias("main")
    )
    own = F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    style = stage(style.select("host", "path", "pages", "main", own.alias("own")), "styles")
    held = features.where("kind = 1").groupBy("host", "path").agg(F.sum(F.log("n")).alias("logs"), F.count("*").alias("contents"))
    held = held.join(style.select("host", "path", "pages"), ["host", "path"])
    text = F.when(F.col("pages") > 1, 1 - F.col("logs") / F.col("contents") / F.log("pages")).otherwise(1.0)
    held = held.select("host", "path", "contents", F.greatest(text, F.lit(0.0)).alias("text"))
    # Every text counts for itself and all elements above it: the prefixes of its path.
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    below = held.select("host", F.explode(above).alias("path"), "contents", "text")
    below = below.groupBy("host", "path").agg((F.sum(F.col("text") * F.col("contents")) / F.sum("contents")).alias("below"))
    both = style.join(below, ["host", "path"], "left")
    value = (1 - BELOW) * F.col("own") + BELOW * F.coalesce("below", F.lit(0.0))
    return both.select("host", "path", "pages", "main", value.alias("importance"))


def low_branches(nodes: DataFrame, least: float = LEAST, pages: int = PAGES) -> DataFrame:
    """``host, removed``: the paths of a host whose importance is below ``least``, seen on at least ``pages`` pages.

    If the pages of a host are alike as a whole, nothing tells text from frame and no branch goes; if they are alike in
    their main branch, nothing goes there.
    """
    alike = nodes.where(((F.col("path") == "") | F.col("main")) & (F.col("importance") < least)).select(F.col("host").alias("h"), F.col("path").alias("top"))
    low = nodes.where((F.col("importance") < least) & (F.col("pages") >= pages) & (F.col("path") != ""))
    below = (F.col("host") == F.col("h")) & F.startswith(F.concat("path", F.lit("/")), F.concat("top", F.lit("/")))
    return low.join(alike, below, "left_anti").groupBy("host").agg(F.collect_set("path").alias("removed"))


def host_of(url: Column) -> Column:
    """The host of an address in small letters, without user and port; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(found)


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every row: the main text of the whole page.

    White space inside a block is one space, blocks are joined by a line feed in page order; a page without main text
    gives an empty text, as do null and empty pages. Rows without a host are one host. Repeated rows count as pages and
    give repeated results. Other columns are ignored.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    named = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(page).alias("html"), host_of(F.col(url)).alias("host"))
    nodes = importance(stage(node_features(named.select("host", "html")), "page-nodes"))
    low = stage(low_branches(nodes), "low-branches")
    rows = named.join(low.withColumnRenamed("host", "h"), F.col("host") == F.col("h"), "left").select("id", "url", "html", "removed")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            removed = [frozenset(r or ()) for r in batch.column("removed").to_pylist()]
            out = [main_text(p or "", r) for p, r in zip(batch.column("html").to_pylist(), removed, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])

        return work

    found = map_slices(rows, make, f"id {kind}, url string, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))


