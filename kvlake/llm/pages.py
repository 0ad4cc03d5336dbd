"""Main text of web pages by composite text density.

Each node of the parsed page has C characters, T tags, and among them LC characters and LT tags of links.
Its density is C/T, raised by a logarithm whose base grows as links take over the text and whose argument
falls as they do. The node whose children's densities sum highest holds the core of the article. The
smallest density on the path from it to the body is the threshold that every subtree beside that path must reach to come
along, links being less than half of it.

Tags and names weigh: what tags, attributes or names such as "sidebar" mark as noise weighs nothing, unless it holds most
of the page's text; names that may as well stand on a part of the article, such as "header" or "legal", halve a
density; and what stands in the same `article` or `main` as the core needs no threshold, as that tag says whose it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from kvlake.llm.shared import steps

#: Never main text, whatever their density.
_DROP = set("script style noscript template head title nav header footer aside form button select textarea input label fieldset iframe object embed applet canvas svg math menu dialog noframes audio video map".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {"script", "style", "textarea", "title", "noframes", "iframe", "noembed", "xmp"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ARTICLE = {"article", "main"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words in class, id or role that name what is not the article.
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|adbox|banner|sponsor(?:ed|s)?|promo(?:tion)?s?|sidebar|side|aside|widget|menu|menubar|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|foot|"
    r"comments?|commentlist|disqus|respond|replies|reply|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|recommendations|outbrain|taboola|pagination|pager|toolbar|"
    r"search|searchbox|copyright|legal|disclaimer|tags|tagcloud|complementary|contentinfo|hidden)(?:$|[\s_-])",
    re.I,
)
#: Of those the ones that no amount of text makes an article, unless they tell what a wrapper has.
_OTHERS = re.compile(r"(?:^|[\s_-])(?<!with[_-])(?<!has[_-])(?<!no[_-])(?:comments?|commentlist|disqus|respond|replies|reply|cookies?|consent|gdpr|related|recommended|recommendations|outbrain|taboola)(?:$|[\s_-])", re.I)
#: And those that may stand on a part of the article.
_EITHER = re.compile(r"(?:^|[\s_-])(?:side|header|masthead|foot|legal|disclaimer|copyright|tags|tagcloud|hidden|overlay|share|search|alert|modal)(?:$|[\s_-])", re.I)
#: Why a node is noise: its tag or attributes hide it, its name does, its name is one of _OTHERS, its name is of _EITHER only, which halves its density.
_HIDES, _NAMED, _NAMED_OTHERS, _DOUBTED = 1, 2, 3, 4
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: A start tag of the key closes an open one of the values, up to a barrier.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
_BARRIER = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
_BOUNDS = {"td", "th", "li", "div", "article", "section", "table", "button", "body"}
_SPACE = re.compile(r"\s+")


class Node:
    """near: the closest of the node and those above it that is a paragraph or bounds one; scope: likewise that is a block."""

    __slots__ = ("tag", "up", "kids", "noise", "chars", "tags", "link_chars", "link_tags", "density", "near", "scope", "cleared")

    def __init__(self, tag: str, up: Node | None, noise: int):
        self.tag, self.up, self.noise = tag, up, noise
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density, self.cleared = 0.0, False
        self.near = self if up is None or tag == "p" or tag in _BOUNDS else up.near
        self.scope = self if up is None or tag in _BLOCK else up.scope

    def weight(self) -> float:
        return 0.5 if self.noise == _DOUBTED else 1.0 - bool(self.noise)


def _is_noise(tag: str, attrs: str) -> int:
    if tag in _DROP:
        return _HIDES
    if not attrs or tag in ("html", "body", "main"):
        return 0
    if tag == "article":  # readers' comments are articles on some pages; other words name its topic or layout
        return _HIDES * any(n.lower() in ("class", "id") and re.search(r"(?:^|[\s_\"'-])(?:comment|reply)", v, re.I) is not None for n, v in _ATTR.findall(attrs))
    why = 0
    for name, value in _ATTR.findall(attrs):
        name = name.lower()
        if name in ("class", "id", "role", "itemtype") and _NOISE.search(given := unescape(value.strip("\"'"))):
            told = _NAMED_OTHERS if _OTHERS.search(given) else _NAMED if _NOISE.search(_EITHER.sub(" ", _EITHER.sub(" ", given))) else _DOUBTED
            if told != _DOUBTED:
                why = max(why if why != _DOUBTED else 0, told)
            elif not why and tag not in _HEADING:
                why = _DOUBTED
        if name == "hidden" or (name == "aria-hidden" and value.strip("\"'").lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return _HIDES
    return why


def parse(html: str) -> Node:
    """A tree of the page: unclosed, misnested and unknown tags are taken as browsers mostly do.

    Time grows with the page alone: what is open is counted, so an end tag of nothing open costs nothing, and a
    walk up closes what it passes.
    """
    root = now = Node("#root", None, 0)
    opened: Counter = Counter()  # open blocks by tag, and other open tags by the block they are in

    def close(upto: Node) -> Node:
        n = now
        while n is not upto:
            opened[n.tag if n.tag in _BLOCK else (id(n.scope), n.tag)] -= 1
            n = n.up
        return upto

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            now.kids.append(unescape(html[at:]))
            break
        if m.start() > at:
            now.kids.append(unescape(html[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            now.kids.append(m["cdata"])
        elif m["tag"] is not None:
            tag = m["tag"].lower()
            if tag in _BLOCK and now.near.tag == "p":  # a paragraph ends where a block begins, with what is open in it
                now = close(now.near.up)
            if tag in _CLOSES and any(opened[t] > 0 for t in _CLOSES[tag]):
                up = now
                while up.up is not None and up.tag not in _BARRIER[tag] and up.tag not in _CLOSES[tag]:
                    up = up.up
                while up.tag in _CLOSES[tag]:
                    up = now = close(up.up)
            node = Node(tag, now, _is_noise(tag, m["attrs"]))
            now.kids.append(node)
            if tag in _ARTICLE and not node.noise:  # a wrapper such as "with-sidebar" is not what it names
                up = now
                while up is not None and not up.cleared:
                    up.noise *= up.tag in _DROP
                    up.cleared = True
                    up = up.up
            if tag in _RAW:
                ended = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = ended.end() if ended else end
            elif tag not in _VOID and (not m["attrs"].endswith("/") or tag in _BLOCK):  # <div/> opens a div
                now = node
                opened[tag if tag in _BLOCK else (id(node.scope), tag)] += 1
        elif m["end"] is not None:
            tag = m["end"].lower()
            if opened[tag if tag in _BLOCK else (id(now.scope), tag)] > 0:  # an inline end tag doesn't close blocks
                up = now
                while up.tag != tag:
                    up = up.up
                now = close(up.up)
    return root


def _unname(root: Node) -> None:
    """A name is overruled where most of the text outside links stands under it: of the page's, or, in an `article` or `main`, of that.

    Text under readers' and others' names counts only on pages that have no other, and not in an article.
    """
    tops, todo = [], [root]
    while todo:  # the outermost
        n = todo.pop()
        if n.tag in _ARTICLE:
            tops.append(n)
        else:
            todo += [k for k in n.kids if isinstance(k, Node) and k.noise not in (_HIDES, _NAMED_OTHERS)]
    for others in (_NAMED_OTHERS, 0):
        for top in tops or [root]:
            held: dict[int, int] = {}
            order = _all(top, _HIDES, others or _HIDES)
            for n in reversed(order):
                held[id(n)] = sum(len(_SPACE.sub(" ", k).strip()) if isinstance(k, str) else held.get(id(k), 0) for k in n.kids if isinstance(k, str) or k.tag != "a")
            if held[id(top)]:
                for n in order:  # in an article, a name that says noise must stand on nearly all of it
                    if 2 * held[id(n)] > held[id(top)] and (not tops or n.noise == _DOUBTED or 10 * held[id(n)] > 9 * held[id(top)]):
                        n.noise = 0
        if tops or held[id(root)]:
            return


def _all(root: Node, *without: int) -> list[Node]:
    """Nodes under root but for those of these kinds of noise and what they hold, parents first; without recursion, for pages nested to any depth."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [k for k in reversed(n.kids) if isinstance(k, Node) and k.noise not in without]
    return out


def measure(root: Node) -> list[Node]:
    """The nodes outside noise with their counts and densities, parents first."""
    nodes = _all(root, _HIDES, _NAMED, _NAMED_OTHERS)
    for n in reversed(nodes):
        own = sum(len(_SPACE.sub(" ", k).strip()) for k in n.kids if isinstance(k, str))
        n.chars += own
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        if n.up is not None:
            n.up.chars += n.chars
            n.up.tags += n.tags + 1
            n.up.link_chars += n.link_chars
            n.up.link_tags += n.link_tags
    share = link_share(nodes)
    for n in nodes:
        n.density = n.weight() * composite(n.chars, n.tags, n.link_chars, n.link_tags, share)
    return nodes


def link_share(nodes: list[Node]) -> float:
    """The share of links in the text of the body, or of the page without one."""
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    return body.link_chars / max(1, body.chars)


def composite(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density; what would be a logarithm to a base of one, or a division by zero, is kept just above."""
    if not chars:
        return 0.0
    t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = log(chars / max(1, chars - link_chars) * link_chars + share * chars + e)
    return chars / t * log(max(1.0000001, chars / lc * t / lt)) / max(1e-9, log(max(base, 1.0000001)))


def _blocks(top: Node) -> list[str]:
    """Texts of the blocks under top in page order; of noise nothing."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    todo: list[tuple[Node | str, bool]] = [(top, False)]
    while todo:
        n, done = todo.pop()
        if isinstance(n, str):
            line.append(n)
        elif done:
            flush()
        elif not n.noise:
            if n.tag == "br":
                line.append(" ")
            if n.tag in _BLOCK:
                flush()
                todo.append((n, True))
            todo += [(k, False) for k in reversed(n.kids)]
    flush()
    return out


def _core(nodes: list[Node]) -> Node | None:
    """The node whose children's densities sum highest, the first on the page of those that tie; a node without such children counts its own."""
    best, most = None, 0.0
    for n in nodes:
        total = sum(k.density for k in n.kids if isinstance(k, Node))
        total = max(total, n.density if all(isinstance(k, str) or not k.chars for k in n.kids) else 0.0)
        if total > most:
            best, most = n, total
    return best


def _choose(nodes: list[Node], best: Node) -> Node:
    """What holds the article; what under it is none of it becomes noise."""
    path = [best]
    while path[-1].up is not None and path[-1].tag != "body":
        path.append(path[-1].up)
    threshold = min(n.density for n in path)
    for n in path:
        n.noise = 0
    top = next((n for n in path if n.tag in _ARTICLE), None)
    if top is None:
        top, share = path[-1], link_share(nodes)
        for child, up in zip(path, path[1:]):
            comes = [k is child or isinstance(k, Node) and 2 * k.link_chars <= k.chars and k.density >= threshold for k in up.kids]
            for i in range(len(comes) - 2, -1, -1):  # a heading comes with what follows it
                k = up.kids[i]
                if isinstance(k, Node) and k.tag in _HEADING and not k.noise and not k.link_chars:
                    j = next((j for j in range(i + 1, len(comes)) if isinstance(up.kids[j], Node) and up.kids[j].chars or isinstance(up.kids[j], str) and up.kids[j].strip()), i)
                    comes[i] = comes[i] or comes[j]
            for k, own in zip(up.kids, comes, strict=True):
                if isinstance(k, Node) and not own:
                    k.noise = _HIDES
            up.kids = [" " if isinstance(k, str) and composite(len(_SPACE.sub(" ", k).strip()), 1, 0, 0, share) < threshold else k for k in up.kids]
    for n in nodes:
        if n.noise == _DOUBTED:
            n.noise = 0 if n.density >= threshold and 2 * n.link_chars <= n.chars else _HIDES
    return top


def main_text(html: str | None) -> str:
    """The article's blocks joined by one newline; empty if the page has none.

    Null, empty and tagless inputs are defined: without any tag the text itself is one block. Of nodes that tie
    for the highest sum, the first on the page wins.
    """
    if not html:
        return ""
    root = parse(html)
    _unname(root)
    nodes = measure(root)
    best = _core(nodes)
    return "" if best is None else "\n".join(_blocks(_choose(nodes, best)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages; a null html gives an empty text.

    Rows are independent: null or repeated ids and urls are passed on, other columns are not read, an
    empty table gives no rows. A page is held by one task at a time, however long it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, 2):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
