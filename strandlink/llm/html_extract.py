"""Main text of web pages: site template removal over element subtrees.

Elements outside articles are hashed with everything below them and counted for each host in Spark, over pages that
differ.  A subtree that recurs on many pages of its host is template and is deleted, as are elements whose kind says
they are no article text (menus, footers, forms and so on).  Of what is left, the text of the article element is taken
where there is one, else that of the body.

Nothing inside an article or main element counts as template, nor do the elements around a page's longest one:
passages, lists and tables that articles share are article text.  On pages without such an element, a container below
the body that directly holds text of its own holds passages, and in it only the kinds in REGION count.  Text with its
inline elements goes or stays as one.  A page that is template throughout keeps its text.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlink.llm.common import map_arrow
from strandlink.plans.stages import materialize

#: A subtree is template on this many differing pages of a host, or on two or more that are this share of them.
SHARE = 0.2
MIN_PAGES = 4

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes noscript".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Kinds that count as template in a container of passages, too; those in LISTED are part of its text.
REGION = set("aside center dd details div dl fieldset figure footer form header hgroup menu nav ol section table ul".split())
LISTED = set("dd dl figure ol table ul".split())
TEXT_BLOCK = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
DROPPED = set("nav header footer aside form script style noscript template iframe button select textarea input svg canvas dialog menu head title object embed audio video map search xmp noembed noframes".split())
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Whole class names and ids of adverts, reader comments, and menus, headers, footers, sidebars and notices.  Any other
#: boilerplate goes where it recurs on its host.
ADVERTS = set("ad ad-banner ad-block ad-box ad-container ad-slot ad-unit ad-wrapper ads advert advertisement advertisements adverts sponsor sponsored".split())
COMMENTS = set("comment comment-list comment-section comments comments-area comments-list comments-section disqus disqus_thread post-comments reader-comments replies reply respond user-comments".split())
MARKS = ADVERTS | COMMENTS | set(
    "breadcrumb breadcrumbs consent cookie cookie-banner cookie-bar cookie-consent cookie-notice cookies footer gdpr header left-sidebar main-menu main-nav main-navigation masthead menu nav nav-bar nav-menu navbar navigation notice notices page-footer page-header primary-menu right-sidebar secondary-menu side-bar sidebar sidebar-left sidebar-right site-footer site-header site-nav site-navigation site-notice top-bar topbar".split()
)
#: Kinds that may enclose a whole page.
ENCLOSING = set("form dialog map".split())
#: Start tags that end an open element of these kinds, up to the nearest of the bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
P_ENDS = BLOCK - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "title", "legend", "figcaption"}

# Nothing in a tag is matched in two ways and no part of a match is given back, and a name or attribute ends at
# the next "<", so tags that never end cost one pass, however many there are.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "start", "end", "kids", "parent", "level", "digest", "counts", "size", "spared")

    def __init__(self, tag, attrs, start, parent):
        self.tag, self.attrs, self.start, self.end, self.parent = tag, attrs, start, start, parent
        self.level = parent.level + 1 if parent else 0
        self.kids: list = []
        self.digest, self.counts, self.size, self.spared = 0, False, 0, False


def parse(page: str) -> Node:
    """A tree of elements and text spans; unclosed and crossed tags end where HTML's rules or their parents say.

    ``spared`` marks elements whose class does not make them boilerplate: those around the page's longest article, or,
    on a page without one, those that hold more than half of its text.
    """
    root = node = Node("", "", 0, None)
    at, size = 0, len(page)
    opened: dict[str, list[Node]] = {}  # of each kind the open elements, outer ones first
    blocks, articles = [], []

    def close(until: Node, where: int) -> Node:
        n = node
        while n is not until:
            n.end = where
            opened[n.tag].pop()
            n.parent.size += n.size
            n = n.parent
        return n

    def outermost(ends: set[str], bounds: set[str]) -> Node | None:
        """The outermost open element of ``ends`` within the nearest of ``bounds``."""
        floor = max((opened[t][-1].level for t in bounds if opened.get(t)), default=0)
        top = None
        for t in ends:
            for n in reversed(opened.get(t, ())):
                if n.level <= floor:
                    break
                if top is None or n.level < top.level:
                    top = n
        return top

    while at < size:
        m = _TOKEN.search(page, at)
        begin = m.start() if m else size
        if begin > at:
            node.kids.append((at, begin))
            node.size += begin - at
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if opened.get(tag):
                n = opened[tag][-1]
                n.end = at
                node = close(n.parent, at)
            elif tag == "br":
                node.kids.append("br")
            continue
        if tag in P_ENDS and opened.get("p"):
            node = close(opened["p"][-1].parent, begin)
        if tag in CLOSES:
            top = outermost(*CLOSES[tag])
            if top is not None:
                node = close(top.parent, begin)
        made = Node(tag, m[3], begin, node)
        made.end = at
        node.kids.append(made)
        if tag in VOID:
            continue
        if tag in RAW:
            e = re.compile(rf"</{re.escape(tag)}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            stop = e.start() if e else size
            made.kids.append((at, stop))
            at = made.end = e.end() if e else size
            continue
        opened.setdefault(tag, []).append(made)
        node = made
        if tag in BLOCK:
            blocks.append(made)
        if tag in ("article", "main"):
            articles.append(made)
    close(root, size)
    if articles:
        node = max(articles, key=lambda n: n.size)
        while node is not None:
            node.spared = True
            node = node.parent
    else:
        for node in blocks:
            node.spared = 2 * node.size > root.size
    return root


def _is_chrome(node: Node, within: bool = False) -> bool:
    """Whether the element's kind, role, class or id says that it is no article text; ``within`` an article, a class
    says nothing about headings, paragraphs and the like."""
    if node.tag in DROPPED and not (node.spared and node.tag in ENCLOSING):
        return True
    if not node.attrs or node.tag in ("html", "body", "article", "main") and "comment" not in node.attrs.lower():
        return False
    marks = MARKS if node.tag in BLOCK else ADVERTS  # an inline element is part of a text, whatever its class
    if within and node.tag in TEXT_BLOCK:
        marks = frozenset()
    if node.spared:
        marks = marks & COMMENTS
    for name, value in _ATTR.findall(node.attrs):
        name = name.lower()
        if name == "hidden":
            return True
        value = value.strip("\"'").lower()
        if name == "aria-hidden" and value == "true" or name == "role" and value in ROLES and not node.spared:
            return True
        if name in ("class", "id") and not marks.isdisjoint(value.split()):
            return True
    return False


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _blank(page: str, kid) -> bool:
    return not (type(kid) is tuple and page[kid[0] : kid[1]].strip())


def outline(page: str) -> tuple[Node, list[Node]]:
    """The parsed page and its elements outside articles, outer ones first, with subtree hashes (0: no text).

    A hash covers tags, attributes and text, but no elements that go by their kind.  ``counts`` marks what can be
    template: not what encloses the longest article, nor inline elements of a text.
    """
    root = parse(page)
    nodes, articles, stack = [], [], [(root, False)]
    while stack:
        node, part = stack.pop()
        if node is not root and (node.tag == "head" or _is_chrome(node)):
            continue
        nodes.append(node)
        if node.tag in ("article", "main"):
            articles.append(node)
            node.digest = _hash(_SPACE.sub(" ", page[node.start : node.end]))
            continue
        block = node.tag in BLOCK or node is root
        node.counts = node.tag not in ("", "html", "body") and not (part and not block)
        part = part and not block or node.tag in TEXT_BLOCK or not all(_blank(page, k) for k in node.kids)
        stack += [(k, part) for k in reversed(node.kids) if type(k) is Node]
    for node in reversed(nodes):
        if node.tag in ("article", "main"):
            continue
        parts = [str(k.digest) if type(k) is Node else _SPACE.sub(" ", page[k[0] : k[1]]).strip() for k in node.kids if type(k) is not str and (type(k) is not Node or k.digest)]
        parts = [x for x in parts if x]
        node.digest = _hash("\0".join((node.tag, _SPACE.sub(" ", node.attrs).strip(), *parts))) if parts else 0
        node.counts = node.counts and bool(parts)
    if articles:
        node = max(articles, key=lambda n: n.end - n.start)
        while node is not None:
            node.counts = False
            node = node.parent
    return root, nodes


def regions(page: str) -> set[int]:
    """Hashes of the page's elements that can be template, once each."""
    return {n.digest for n in outline(page)[1] if n.counts}


def _template_of(page: str, root: Node, template) -> set[int]:
    """Python ids of the outermost elements that go as template."""

    def own(kid) -> bool:
        """Whether a child is text of its own, outside of any element that recurs."""
        if type(kid) is not Node:
            return not _blank(page, kid)
        return bool(kid.digest) and not (kid.counts and kid.digest in template) and (kid.tag not in BLOCK or kid.tag in PROSE)

    gone, stack = set(), [(root, False)]
    while stack:
        node, passages = stack.pop()
        if node.counts and node.digest in template and not (passages and node.tag not in REGION):
            gone.add(id(node))
            continue
        if node.tag in ("article", "main"):
            continue
        passages = passages and (node.tag not in REGION or node.tag in LISTED)
        if not passages and node.tag not in ("", "html", "body"):
            passages = any(own(k) for k in node.kids)
        stack += [(k, passages) for k in node.kids if type(k) is Node]
    return gone


def main_text(page: str, template: set[int] | frozenset = frozenset()) -> str:
    """Blocks of the main text in page order, joined by a line feed."""
    if not template:
        return _text(page, parse(page), frozenset())
    root = outline(page)[0]
    gone = _template_of(page, root, template)
    return _text(page, root, gone) or (_text(page, root, frozenset()) if gone else "")


def _text(page: str, root: Node, gone: set[int] | frozenset) -> str:
    def dropped(node: Node, within: bool = False) -> bool:
        return id(node) in gone or _is_chrome(node, within)

    articles, stack = [], [root]
    while stack:  # outermost articles in page order
        node = stack.pop()
        if node is not root and dropped(node):
            continue
        if node.tag in ("article", "main"):
            articles.append(node)
            continue
        stack += [k for k in reversed(node.kids) if type(k) is Node]
    # an article inside a main element is the closer bound
    tops = []
    for a in articles:
        inner, stack = [], [k for k in reversed(a.kids) if type(k) is Node] if a.tag == "main" else []
        while stack:
            n = stack.pop()
            if dropped(n, True):
                continue
            if n.tag == "article":
                inner.append(n)
            else:
                stack += [k for k in reversed(n.kids) if type(k) is Node]
        tops += inner or [a]
    blocks: list[str] = []
    piece: list[str] = []

    def flush():
        if piece:
            text = _SPACE.sub(" ", html.unescape("".join(piece))).strip()
            if text:
                blocks.append(text)
            piece.clear()

    for top in tops or [root]:
        work: list = [top]
        flush()
        while work:
            item = work.pop()
            if item is None:
                flush()
            elif item == "br":
                piece.append(" ")
            elif type(item) is tuple:
                piece.append(page[item[0] : item[1]])
            elif item is not top and dropped(item, top is not root):
                if item.tag in BLOCK:
                    flush()
            elif item.tag == "br":
                piece.append(" ")
            else:
                if item.tag in BLOCK:
                    flush()
                    work.append(None)
                work += reversed(item.kids)
        flush()
    return "\n".join(blocks)


def _host(col):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(col, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row, duplicates included.

    A null or empty page has the text "" (0 characters), whatever its host's template.  A null url or one without a host
    belongs to the host "".  Null ids stay null.  Equal pages of a host count once as evidence of a template.  Tags that
    never end, cross or repeat make a text like any other.
    """
    spark = pages.sparkSession
    src = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    src = src.withColumn("host", _host(F.col("url")))
    marked = src.filter("html is not null").select("page_id", "host", "html", F.xxhash64("html").alias("sig"))

    def list_regions(b: pa.RecordBatch) -> pa.RecordBatch:
        hosts, sigs, hashes = [], [], []
        for host, sig, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            found = [0, *regions(page)]  # 0 counts the page itself
            hosts += [host] * len(found)
            sigs += [sig] * len(found)
            hashes += found
        return pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(sigs), pa.array(hashes, pa.int64())], names=["host", "sig", "hash"])

    # distinct on the page's own hash removes copies; both steps are partial aggregates, so a hot host is spread
    found = materialize(map_arrow(marked.select("host", "sig", "html"), list_regions, "host string, sig long, hash long").distinct(), "regions")
    counts = materialize(found.groupBy("host", "hash").agg(F.count("*").alias("n")), "counts")
    sizes = counts.filter("hash = 0").select("host", F.col("n").alias("pages"))
    recurring = counts.filter(f"hash <> 0 and n >= {min(2, min_pages)}").join(sizes, "host")
    template = materialize(recurring.filter((F.col("n") >= min_pages) | (F.col("n") >= share * F.col("pages"))).select("host", "hash"), "template")
    # a hot host can have more template than its pages can carry along: each gets what it holds
    own = materialize(found.join(template, ["host", "hash"]).groupBy("host", "sig").agg(F.collect_list("hash").alias("hashes")), "own")
    rows = src.withColumn("sig", F.xxhash64("html")).join(own, ["host", "sig"], "left").select("page_id", "url", "hashes", "html")

    def text_of(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p, frozenset(t or ())) if p else "" for p, t in zip(b.column(3).to_pylist(), b.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(rows, text_of, "page_id long, url string, text string, n_chars long")
