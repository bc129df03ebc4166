"""Main text of web pages: site templates removed by recurring element subtrees, furniture by role, the article kept.

Each page becomes a tree. Every element of the body that can be a template is hashed with all below it; Spark counts, for each
host, the pages of different text that have a subtree, and subtrees on some pages of a host are its template and are deleted
from all its pages, before the content is chosen. What menus, headers, footers, side bars, notices, adverts, forms and reader
comments are called (tags, roles, class and id words) removes those that differ from page to page. Within content elements (article,
main) only containers are counted, so that a paragraph many articles share stays; without such an element all that is left is text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_lists, cut, read

#: A subtree is a template if it is on so many pages of a host whose texts differ.
LEAST_PAGES = 5
#: Most templates (host and subtree) that are sent to every worker; beyond, pages are joined with those they hold by a shuffle.
MOST_BROADCAST = 200_000

# Element names of the HTML standard by how a parser treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript plaintext".split())
RAW_WITH_REFERENCES = frozenset("title textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body br caption col colgroup dd dt head html legend li optgroup option summary tbody td tfoot th thead title tr".split())
#: Elements that can be a template: not those within a line of text.
COUNTED = BLOCKS - frozenset("body br col colgroup head hr html".split())
#: Those that can be one within a content element: not what holds a passage of its text.
CONTAINERS = frozenset("article aside center details dialog dir div dl fieldset footer form header main menu nav ol section select table ul".split())
#: A start tag ends an open element of these names, unless one of the second group is nearer.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: Elements whose end tag closes all that is open within, but which an end tag inside them doesn't reach past.
WALLS = frozenset("article main section table td th body html nav header footer aside form".split())

# What page furniture is called.
FURNITURE_TAGS = frozenset("nav footer aside form script style noscript template iframe object embed svg math canvas audio video button select textarea input label menu dialog head title noembed noframes applet map".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog status".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adbox adslot banner breadcrumb breadcrumbs comment comments comentarios commentaires kommentare cookie cookies consent copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation navi newsletter notice notices overlay pager pagination paywall popup privacy promo promoted promotion recommended recommendations related respond replies reply search share sharing sidebar sidebars signup skip skyscraper social sponsor sponsored sponsors subscribe subscription survey toolbar tooltip topbar warning widget widgets".split()
)

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^<>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*(?:>|(?=<)|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []


def parse(page: str) -> Node:
    """The page's tree; what isn't well formed is closed as browsers would, roughly. Comments are left out."""
    root = Node("#root", "", None)
    at, here, n = 0, root, len(page)
    open_tags: Counter[str] = Counter()  # so that tags that close nothing cost nothing, however deep the page

    def close(to: Node) -> Node:
        """Closes what is open below an element."""
        node = here
        while node is not to:
            open_tags[node.tag] -= 1
            node = node.parent
        return to

    while at < n:
        start = page.find("<", at)
        if start < 0:
            here.children.append(html.unescape(page[at:]))
            break
        if start > at:
            here.children.append(html.unescape(page[at:start]))
        token = _TOKEN.match(page, start)
        if token is None:
            here.children.append("<")
            at = start + 1
            continue
        at, text = token.end(), token[0]
        if text.startswith("<![CDATA["):
            here.children.append(text[9:].removesuffix("]]>"))
            continue
        name = _NAME.match(text)
        if name is None:
            continue
        tag, attributes = name[1].lower(), text[name.end() :].rstrip(">")
        if text[1] == "/":
            if tag == "br":
                here.children.append(Node("br", "", here))
                continue
            node = here if open_tags[tag] else root
            while node is not root and node.tag != tag and not (node.tag in WALLS and tag not in WALLS):
                node = node.parent
            if node is not root and node.tag == tag:
                here = close(node.parent)
            elif tag == "p":
                here.children.append(Node("p", "", here))
            continue
        if tag in CLOSES_P and open_tags["p"]:
            node = here
            while node is not root and node.tag != "p" and node.tag not in WALLS and node.tag not in ("li", "dd", "dt", "div", "blockquote"):
                node = node.parent
            if node.tag == "p":
                here = close(node.parent)
        if tag in ENDS:
            ended, walls = ENDS[tag]
            node = here if any(open_tags[t] for t in ended) else root
            while node is not root and node.tag not in ended and node.tag not in walls:
                node = node.parent
            if node.tag in ended:
                here = close(node.parent)
        node = Node(tag, attributes, here)
        here.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW or tag in RAW_WITH_REFERENCES:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?|\Z", re.I).search(page, at)
            body = page[at : end.start()]
            node.children.append(html.unescape(body) if tag in RAW_WITH_REFERENCES else body)
            at = end.end()
        else:
            here = node
            open_tags[tag] += 1
    return root


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _words(value: str) -> set[str]:
    return {w.lower() for w in _PARTS.findall(value)}


def _is_furniture(node: Node, inside: bool) -> bool:
    """inside: within a content element, where a header is the article's own if a heading is in it."""
    if node.tag in FURNITURE_TAGS:
        return True
    if node.tag == "header":
        return not (inside and any(isinstance(c, Node) and c.tag in ("h1", "h2", "h3", "hgroup") for c in node.children))
    if not node.attributes.strip(" /"):
        return False
    own = _attributes(node.attributes)
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I):
        return True
    if own.get("role", "").lower() in FURNITURE_ROLES:
        return True
    if node.tag in ("body", "html", "main"):
        return False
    named = _words(own.get("class", "") + " " + own.get("id", ""))
    return bool(named & FURNITURE_WORDS) and not (node.tag == "article" and not named & {"comment", "comments", "reply", "replies"})


def _content(root: Node, gone: set[int] | frozenset[int] = frozenset()) -> list[Node]:
    """The page's content elements, outermost ones only, that aren't furniture or gone; empty if it names none."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "named": []}
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        kind = None
        if node is not root:
            if id(node) in gone or _is_furniture(node, True):
                continue
            own = _attributes(node.attributes) if node.attributes.strip(" /") else {}
            role = own.get("role", "").lower()
            if node.tag == "article" or role == "article":
                kind = "article"
            elif node.tag == "main" or role == "main":
                kind = "main"
            elif own.get("itemprop", "").lower() == "articlebody":
                kind = "named"
        if kind and not (kind == "article" and inside):
            found[kind].append(node)
        for c in reversed(node.children):
            if isinstance(c, Node):
                todo.append((c, inside or kind == "article"))
    return found["article"] or found["main"] or found["named"]


def _hashes(root: Node) -> dict[int, int]:
    """By id of each element that can be a template: the hash of its subtree, as a signed number."""
    content = {id(x) for x in _content(root)}
    out: dict[int, int] = {}
    counted: set[int] = set()
    todo: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while todo:
        node, inside, left = todo.pop()
        if not left:
            inside = inside or id(node) in content
            todo.append((node, inside, True))
            todo += [(c, inside, False) for c in node.children if isinstance(c, Node)]
            continue
        parts = [node.tag, *(" ".join(c.split()) if isinstance(c, str) else f"<{out[id(c)]}>" for c in node.children)]
        h = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))
        out[id(node)] = h - (1 << 64) if h >> 63 else h
        if node.tag in (CONTAINERS if inside else COUNTED):
            counted.add(id(node))
    return {k: out[k] for k in counted}


def host_of(url: str | None) -> str:
    """The url's host in lower case, without user and port; empty if it has none."""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\\]*)", url or "")
    return m[1].rpartition("@")[2].split(":")[0].lower() if m else ""


def subtrees(page: str | None) -> set[int]:
    """Hashes of the subtrees that count for the host's template."""
    return set(_hashes(parse(page or "")).values())


def main_text(page: str | None, template: set[int] | frozenset[int] = frozenset()) -> str:
    """The page's main text without the subtrees whose hashes are in template: one line a block."""
    root = parse(page or "")
    return _text(root, {k for k, h in _hashes(root).items() if h in template} if template else set())


def _text(root: Node, gone: set[int]) -> str:
    content = _content(root, gone)
    lines: list[str] = []
    run: list[str] = []

    def end() -> None:
        if line := " ".join("".join(run).split()):
            lines.append(line)
        run.clear()

    todo: list[tuple[Node | str, bool]] = [(x, bool(content)) for x in reversed(content or [root])]
    tops = {id(x) for x in content}
    while todo:
        node, inside = todo.pop()
        if isinstance(node, str):
            run.append(node)
            continue
        if node.tag == "#end":
            end()
            continue
        if id(node) in gone or (id(node) not in tops and node is not root and _is_furniture(node, inside)):
            if node.tag in BLOCKS:
                end()
            continue
        if node.tag in BLOCKS:
            end()
            todo.append((Node("#end", "", None), inside))
        elif node.tag in ("img", "wbr"):
            continue
        todo += [(c, inside or node.tag in ("article", "main")) for c in reversed(node.children)]
    end()
    return "\n".join(lines)


def _holders(least_pages: int):
    """(host, subtree, text: a hash of the page's text): of a task, at most least_pages texts of each subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], set[int]] = {}

        def rows() -> pa.RecordBatch:
            keys = [(*k, t) for k, texts in found.items() for t in texts]
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["host", "subtree", "text"])

        for urls, pages in column_lists(batches, "url", "html", rows=100):
            for u, p in zip(urls, pages, strict=True):
                host, root = host_of(u), parse(p or "")
                text = xxhash.xxh3_64_intdigest(_text(root, set()).encode("utf-8", "surrogatepass")) >> 1
                for h in set(_hashes(root).values()):
                    texts = found.setdefault((host, h), set())
                    if len(texts) < least_pages:
                        texts.add(text)
            if len(found) > 200_000:
                yield rows()
                found.clear()
        if found:
            yield rows()

    return run


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, subtree) of the subtrees that are on least_pages pages of a host whose texts differ. Copies of a page count once, so
    that they don't make its content a template."""
    held = pages.select(F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_holders(least_pages), "host string, subtree long, text long")
    return held.groupBy("host", "subtree").agg(F.count_distinct("text").alias("pages")).where(F.col("pages") >= least_pages).select("host", "subtree")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, digest, subtree) of pages (host, digest, html)."""
    for hosts, digests, pages in column_lists(batches, "host", "digest", "html", rows=100):
        rows = [(h, d, s) for h, d, p in zip(hosts, digests, pages, strict=True) for s in subtrees(p)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["host", "digest", "subtree"])


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text) of each row of pages (page_id, url, html).

    A null or empty html gives an empty text; a null url, or one without a host, belongs to the host named by an empty
    string; a null page_id is kept and repeated rows each get their row. Very long pages are read whole. Other columns are not looked at.
    """
    known = cut(templates(pages, least_pages), "templates")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    sent = None
    if known.count() <= MOST_BROADCAST:
        by_host: dict[str, set[int]] = {}
        for r in known.toLocalIterator():
            by_host.setdefault(r.host, set()).add(r.subtree)
        sent = pages.sparkSession.sparkContext.broadcast({h: frozenset(x) for h, x in by_host.items()})
        rows = rows.withColumn("subtrees", F.lit(None).cast("array<long>"))
    else:  # a page gets those of its host's templates that it holds
        host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#\\]*@)?([^/?#\\:@]*)", 1))
        rows = rows.withColumn("host", host).withColumn("digest", F.md5(F.col("html").cast("binary")))
        held = rows.select("host", "digest", "html").mapInArrow(_held, "host string, digest string, subtree long").distinct()
        of = cut(held.join(known, ["host", "subtree"]).groupBy("host", "digest").agg(F.collect_set("subtree").alias("subtrees")), "held-templates")
        rows = rows.join(of, ["host", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: frozenset[int] = frozenset()
        for ids, urls, bodies, known in column_lists(batches, "page_id", "url", "html", "subtrees", rows=100):
            texts = [main_text(p, sent.value.get(host_of(u), none) if sent else frozenset(k or ())) for u, p, k in zip(urls, bodies, known, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.select("page_id", "url", "html", "subtrees").mapInArrow(run, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
