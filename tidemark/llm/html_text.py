"""Main text of web pages by composite text density.

A page becomes a tree of its tags, without scripts, styles, comments, form controls and what is marked as hidden. What its
tag, class, id or role names as menu, header, footer, sidebar, notice, advert or form is cut off, unless it holds at least 500
unlinked characters and more than half of the page's (a form around the whole page, an article of class "widget-post"); what
is named as reader comments is cut off unless it holds at least 500 and more than nine tenths.

Of what is left, every node's density is its characters per tag, adjusted by the share of its characters and tags that are
links; a node's sum is that of its children's densities. The node with the largest sum is the core of the article and stays
whole. Of the other children of each node on its path to the body those stay that are headings, or that are not mostly links
and are mostly paragraphs, or have at least half as many unlinked characters a tag as the sparsest node on that path
(composite density grows with size, so it does not compare them), or stand between two that stay. Where the paragraphs are
the body's own, of its children only blocks that are mostly links, no headings or paragraphs and with at most 100 other
characters are left out. <article> and <main> count for no more than <div>, except that a <header> in them is theirs.

Tokens and tree take time linear in the page, however its tags nest or fail to close: as in browsers, a quote counts only
after an equals sign, and a tag, comment or script without an end reaches to the end of the page.

Nulls and repeats: a null or empty html gives an empty text; a page without tags is one block. Each row is a page of its
own; null ids and urls are kept. An empty table gives an empty result. Other columns are not read and may clash.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

# Possessive throughout: nothing is ever scanned twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)(>?)")
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {  # an open element of the key's tag ends where one of these begins
    "p": _BLOCKS - {"br", "body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}, "head": {"body"},
}
_STOPS = frozenset("table td th ul ol dl div section article main body html".split())
_UNSEEN = frozenset("head noscript template svg math button select datalist input object canvas audio video".split())
_NOISE_TAGS = frozenset("nav footer aside form fieldset dialog menu".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar "
    "footer masthead topbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login paywall "
    "share sharing social related recommended recommendations widget widgets pagination pager toolbar skip".split()
)
_TEXT_WORDS = frozenset("content article main story entry".split())
_REMARKS = frozenset("comment comments commentlist reply replies respond disqus".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = _HEADINGS | frozenset("p blockquote pre li dt dd".split())
_WORDS = re.compile(r"[a-z]+")
_SHOWN, _NAMED, _REMARK, _HIDDEN = range(4)
LARGE = 500  # unlinked characters of what a name alone does not cut off


def _kind(tag: str, attributes: str, in_article: bool) -> int:
    if tag in _UNSEEN:
        return _HIDDEN
    by_tag = _NAMED if tag in _NOISE_TAGS or tag == "header" and not in_article else _SHOWN
    if not attributes or tag in ("html", "body"):
        return by_tag
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or "hidden" in names.split():
        return _HIDDEN
    words = set(_WORDS.findall(names))
    if words & _REMARKS:
        return _REMARK
    if by_tag or found.get("role", "") in _NOISE_ROLES:
        return _NAMED
    if tag in ("article", "main") or words & _TEXT_WORDS:
        return _SHOWN
    return _NAMED if words & _NOISE_WORDS or "header" in words and not in_article else _SHOWN


class _Node:
    __slots__ = ("tag", "parent", "children", "kind", "near", "link", "article", "chars", "tags", "link_chars", "link_tags", "density", "sum", "in_prose", "prose")

    def __init__(self, tag, parent, kind=_SHOWN):
        self.tag, self.parent, self.kind = tag, parent, kind
        self.near = self if parent is None or tag in _CLOSES or tag in _STOPS else parent.near  # the next element up that may close or that stops the search
        self.link = tag == "a" or parent is not None and parent.link
        self.article = tag in ("article", "main") or parent is not None and parent.article
        self.in_prose = tag in _PROSE or parent is not None and parent.in_prose
        self.children = []
        if parent is not None:
            parent.children.append(self)


def _tokens(html: str):
    """Texts as (text, None, None), tags as (None, name, attributes), end tags as (None, "/" + name, None)."""
    at = 0
    while True:
        begin = html.find("<", at)
        if begin < 0:
            if at < len(html):
                yield html[at:], None, None
            return
        tag = _TAG.match(html, begin)
        if tag is None:
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 4)
                after = end + 3
            elif html.startswith(("<!", "<?", "</"), begin):
                end = html.find(">", begin)
                after = end + 1
            else:  # a less-than sign of the text, with all that has no tag behind it
                end = after = begin + 1
                yield html[at:end], None, None
                at = after
                continue
            if begin > at:
                yield html[at:begin], None, None
            if end < 0:
                return
            at = after
            continue
        if begin > at:
            yield html[at:begin], None, None
        if not tag[4]:
            return
        name, at = tag[2].lower(), tag.end()
        yield None, tag[1] + name, tag[3]
        if name in _RAW and not tag[1]:
            end = _RAW[name].search(html, at)
            if end is None:
                return
            at = end.start()


def _tree(html: str) -> _Node:
    """Children are nodes and strings."""
    root = node = _Node("html", None)
    opened = Counter()  # how often each tag is open, so that an end tag without a beginning needs no search

    def close(up):
        nonlocal node
        while node is not up.parent:
            opened[node.tag] -= 1
            node = node.parent

    for text, tag, attributes in _tokens(html):
        if tag is None:
            node.children.append(text)
        elif tag in _RAW or tag[1:] in _RAW:
            continue
        elif tag[0] == "/":
            if opened[tag[1:]]:
                up = node
                while up.tag != tag[1:]:
                    up = up.parent
                close(up)
            elif tag == "/p":
                node.children.append("\n")
        else:
            up, ends = node.near, None
            while up.parent is not None:
                if tag in _CLOSES.get(up.tag, ()):
                    ends = up
                if up.tag in _STOPS and ends is not up:
                    break
                up = up.parent.near
            if ends is not None:
                close(ends)
            if tag in _VOID:
                if tag in ("br", "hr"):
                    _Node(tag, node)
                continue
            child = _Node(tag, node, _kind(tag, attributes, node.article))
            if not attributes.rstrip().endswith("/"):
                node = child
                opened[tag] += 1
    return root


def _length(text: str) -> int:
    return len("".join(text.split()))


def _order(root: _Node) -> list[_Node]:
    """All nodes, parents before children."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in node.children if not isinstance(x, str))
    return order


def _count(order: list[_Node]) -> None:
    """Characters and tags of all nodes, all and in links, and characters in paragraphs outside links (prose)."""
    for node in order:
        own = sum(_length(x) for x in node.children if isinstance(x, str))
        node.chars, node.tags = own, 1
        node.link_chars, node.link_tags = own if node.link else 0, int(node.tag == "a")
        node.prose = own if node.in_prose and not node.link else 0
    for node in reversed(order):
        up = node.parent
        if up is not None:
            up.chars, up.tags, up.link_chars, up.link_tags, up.prose = (
                up.chars + node.chars, up.tags + node.tags, up.link_chars + node.link_chars, up.link_tags + node.link_tags, up.prose + node.prose)


def _cut(order: list[_Node], leaves) -> None:
    for node in order:
        node.children = [x for x in node.children if isinstance(x, str) or not leaves(x)]


def _without_noise(root: _Node) -> list[_Node]:
    _cut(_order(root), lambda x: x.kind == _HIDDEN)
    order = _order(root)
    _count(order)
    most = {_REMARK: 0.9 * (root.chars - root.link_chars), _NAMED: 0.5 * (root.chars - root.link_chars)}
    _cut(order, lambda x: x.kind != _SHOWN and x.chars - x.link_chars <= max(LARGE - 1, most[x.kind]))
    order = _order(root)
    _count(order)
    return order


def _measure(order: list[_Node]) -> None:
    """Composite densities and their sums."""
    root = order[0]
    all_chars, all_links = max(1, root.chars), root.link_chars
    for node in order:
        chars, links, link_tags = node.chars, max(1, node.link_chars), max(1, node.link_tags)
        plain = max(1, chars - node.link_chars)
        base = log(chars / plain * node.link_chars + all_links / all_chars * chars + e)
        node.density = chars / node.tags * log(max(1.0, chars / links * node.tags / link_tags)) / log(max(base, 1.0001)) if chars else 0.0
    for node in order:
        # Text that stands in the node itself counts as a child of one tag.
        own = sum(_length(x) for x in node.children if isinstance(x, str)) if not node.link else 0
        node.sum = sum(x.density for x in node.children if not isinstance(x, str)) + own


def _blocks(node: _Node) -> list[str]:
    blocks: list[list[str]] = [[]]
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        else:
            if x.tag in _BLOCKS:
                blocks.append([])
                stack.append(None)
            stack.extend(reversed(x.children))
    found = (" ".join(unescape("".join(x)).split()) for x in blocks)
    return [x for x in found if x]


def _leave_out(best: _Node, order: list[_Node]) -> None:
    """Cut off what does not belong to the article, beside the path from best to the body."""
    path, up = {x for x in order if x.tag in ("html", "body")}, best
    while up is not None:
        path.add(up)
        up = up.parent
    within = best.tag in ("html", "body")  # then the body's children are the article's
    threshold = min(((x.chars - x.link_chars) / x.tags for x in path if x.chars), default=0.0) / 2

    def belongs(x: _Node) -> bool:
        plain = x.chars - x.link_chars
        if x.tag in _HEADINGS or within and (x.tag == "p" or plain > 100):
            return True
        if within:
            return plain >= x.link_chars
        return plain >= x.link_chars and (2 * x.prose >= x.chars or plain / x.tags >= threshold)

    for node in path:
        if node is best and not within:
            continue
        blocks = [x for x in node.children if not isinstance(x, str) and x.tag in _BLOCKS]
        sure = [k for k, x in enumerate(blocks) if x in path or belongs(x)]
        stays = {x for k, x in enumerate(blocks) if x in path or belongs(x) or sure and sure[0] < k < sure[-1] and x.chars >= 2 * x.link_chars}
        kept, run = [], []  # run: text and inline elements that stand together
        for x in [*node.children, None]:
            if isinstance(x, str) or x is not None and x.tag not in _BLOCKS and x not in path:
                run.append(x)
                continue
            linked = sum(0 if isinstance(y, str) else y.link_chars for y in run)
            if within or sum(_length(y) if isinstance(y, str) else y.chars for y in run) >= 2 * linked:
                kept += run
            run = []
            if x is not None and (x in path or x in stays):
                kept.append(x)
        node.children = kept


def main_text(html: str | None) -> str:
    if not html:
        return ""
    order = _without_noise(_tree(html))
    _measure(order)
    _leave_out(max(order, key=lambda x: x.sum), order)
    return "\n".join(_blocks(order[0]))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, and text."""
    few = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], names=[*keep, "text"])

    schema = few.drop("_html").schema.add("text", "string")
    return few.mapInArrow(run, schema)


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
ORACLES = {}
