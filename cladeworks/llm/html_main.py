"""Main text of web pages: site templates are found by counting element subtrees per host, then removed.

Every subtree is hashed bottom up twice: exactly (tag, text and children) and by shape (tag, class and id words and the
set of its children's shapes, without text), since a site varies its menus, adverts and footers from page to page but not
their markup. Spark counts, per host, the pages that hold each hash. Outside the article a shape on ``min_pages`` pages is a template and
goes with all below it. Article markup recurs as well, so content is guarded: an ``article`` or ``main`` element is
never a template, and on pages without one neither is a shape that holds much of its pages' text, nor anything
inside the innermost element whose place (path of tags, class and id) holds half of the text over the host's pages. Inside the
article only exact subtrees on a share of the host's pages go, and never running text: sentences and articles that a
host prints twice are content.

A host with too few pages to count has no templates. What the counts leave is judged by the kind of element
(navigation, forms, adverts, comments and so on), and where a page has an article, by standing outside it. Scripts, styles and hidden parts never are text.

Pages are read twice: to count, and to extract, with the verdicts of the page's host beside it. Html is shuffled only if the verdicts
of all hosts are too many to be sent to every task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeworks.llm.shared import written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open paragraph, and that stand as blocks of text of their own.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul html head title".split())
#: Elements that are not the article whatever they hold.
DROPPED = frozenset("script style noscript template head title nav footer aside form fieldset button select option datalist input textarea label iframe frame frameset svg canvas object applet audio video dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words of a class or id that mark what is not the article.
MARKS = frozenset("ad ads adbox adsense advert adverts advertisement advertisements advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login sidebar sidebars widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs menu menus nav navbar navigation topnav pagination pager footer masthead comment comments disqus respond replies toolbar skip".split())
SITE_HEADS = frozenset(("site-header", "page-header", "top-header", "global-header", "main-header"))
#: An open element of the key is ended by the start of one of these.
ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"])}
LISTS = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "option": frozenset(["select"])}
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre code li dd dt figcaption td th b i em strong a span u s small sub sup q cite br".split())
#: Elements that frame a page; they hold its content whatever recurs.
FRAME = frozenset(("#page", "html", "body", "article", "main"))
MIN_PAGES, MIN_SHARE, TEMPLATE_TEXT, CONTENT_TEXT = 10, 0.3, 0.3, 0.5
EXACT, SHAPE, PLACE = 1, 2, 3
BROADCAST_BYTES = 8 << 20  # verdicts up to this size go to every task; larger ones are joined by page


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash", "shape", "place", "chars")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.hash = self.shape = self.place = self.chars = 0


class Tree(HTMLParser):
    """A forgiving tree: end tags that HTML leaves out are supplied, stray ones are ignored, cut-off pages end where they end.

    Elements nest as deep as the page has them; nothing here or below recurses.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#page", {})
        self.open, self.held = [self.root], Counter()

    def _end(self, tag: str, until: frozenset[str] = frozenset()) -> None:
        if not self.held[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self.held.subtract(node.tag for node in self.open[at:])
                del self.open[at:]
                return
            if self.open[at].tag in until:
                return

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """In HTML any marked section is a comment that ends with the next angle bracket."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end("p", frozenset(["button", "table", "td", "th", "article", "div", "section", "li", "body"]))
        for name, enders in ENDS.items():
            if tag in enders:
                self._end(name, LISTS.get(name, frozenset()))
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.held[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("svg", "path", "use", "g", "circle", "rect"):
            self.open.pop()
            self.held[tag] -= 1

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID and tag not in ("html", "body"):
            self._end(tag, frozenset(["table"]) if tag not in ("table", "div", "article", "main", "section", "body") else frozenset())

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)


def parse(html: str | None) -> Node:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _hash(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def seal(node: Node) -> None:
    """Hash every subtree exactly and by shape, name its place and count its characters other than white space."""
    order, stack = [], [(node, 0)]
    while stack:
        top, above = stack.pop()
        order.append(top)
        top.shape = _hash(f"{top.tag} {' '.join(sorted(_words(top.attrs)))}") if top.attrs else _hash(top.tag)
        top.place = _hash(f"{above} {top.shape}")
        stack.extend((k, top.place) for k in top.kids if not isinstance(k, str))
    for top in reversed(order):
        parts, shapes, chars = [top.tag], set(), 0
        for k in top.kids:
            if isinstance(k, str):
                words = k.split()
                parts.append(" ".join(words))
                chars += sum(map(len, words))
            else:
                parts.append(f"\x01{k.hash}")
                shapes.add(k.shape)
                chars += k.chars
        top.hash, top.chars = _hash("\x00".join(parts)), 0 if top.tag in ("script", "style", "head", "template", "noscript") else chars
        if shapes:
            top.shape = _hash(f"{top.shape} {sorted(shapes)}")


def structural(node: Node, in_article: bool) -> bool:
    """Whether the element's kind says that it is not the article."""
    tag, attrs = node.tag, node.attrs
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("html", "body", "article", "main") and not ({"comment", "comments"} & _words(attrs)):
        return False
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return True
    names = _words(attrs)
    return bool(names & MARKS) or bool(SITE_HEADS & {c.lower() for c in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()})


def _words(attrs: dict[str, str]) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower()))


def articles(root: Node) -> list[Node]:
    """The outermost articles that stand in nothing dropped; else the outermost main elements; else none."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    stack = [(root, frozenset())]
    while stack:
        node, inside = stack.pop()
        if structural(node, False):
            continue
        kind = "article" if node.tag == "article" or node.attrs.get("itemprop", "").lower() == "articlebody" else "main" if node.tag == "main" or node.attrs.get("role", "").lower() == "main" else None
        if kind and kind not in inside:
            found[kind].append(node)
        below = inside | {kind} if kind else inside
        stack.extend((k, below) for k in reversed(node.kids) if not isinstance(k, str))
    return found["article"] or found["main"]


def above(root: Node, some: set[int]) -> set[int]:
    """The ids of the elements ``some`` and of all that hold one of them."""
    out, stack, path = set(), [(root, 0)], []
    while stack:
        node, depth = stack.pop()
        del path[depth:]
        path.append(id(node))
        if path[-1] in some:
            out.update(path)
        stack.extend((k, depth + 1) for k in node.kids if not isinstance(k, str))
    return out


def evidence(root: Node) -> dict[tuple[int, int], float]:
    """(kind, hash) -> share of the page's text, for every subtree of a page for which a verdict could count.

    Where the page says what its article is, shapes outside it have no share in the text.
    """
    roots = articles(root)
    own = {id(r) for r in roots}
    frame = above(root, own) | {id(root)}
    if not roots:
        seal(root)
    found: dict[tuple[int, int], float] = {}
    stack = [(root, False, bool(roots), not roots)]
    while stack:
        node, inside, barred, sealed = stack.pop()
        if node.tag in ("script", "style", "head"):
            continue
        inside, barred = inside or id(node) in own, barred or structural(node, False)
        if id(node) not in frame and node.tag not in FRAME:
            running = node.tag in RUNNING
            if not sealed and not (inside and running):
                seal(node)
                sealed = True
            if node.kids and (not running or not inside and not roots):
                found[EXACT, node.hash] = 0.0
            if not inside and not running:
                share = 0.0 if roots or not root.chars else node.chars / root.chars
                found[SHAPE, node.shape] = found.get((SHAPE, node.shape), 0.0) + share
                if not barred:
                    found[PLACE, node.place] = found.get((PLACE, node.place), 0.0) + share
        stack.extend((k, inside, barred, sealed) for k in node.kids if not isinstance(k, str))
    return found


def extract(root: Node, exact: set[int], shapes: set[int], places: set[int]) -> tuple[list[str], int, int]:
    """The text blocks that stay, in page order; how many subtrees went as templates of the host, and how many by their kind."""
    roots = articles(root)
    stated, told = bool(roots), bool(exact or shapes or places)
    if told and not stated:
        seal(root)
    own = {id(r) for r in roots}
    if not stated and places:
        # the innermost elements at places of content
        stack, spots = [root], []
        while stack:
            node = stack.pop()
            if structural(node, False):
                continue
            if node.place in places:
                spots.append(node)
            stack.extend(k for k in node.kids if not isinstance(k, str))
        outer = above(root, {id(n) for n in spots})
        own = {id(n) for n in spots if not any(not isinstance(k, str) and id(k) in outer for k in n.kids)}
    frame = above(root, own) | {id(root)}
    out: list[str] = []
    parts: list[str] = []
    by_count = by_kind = 0

    def close() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(text)

    steps: list[object] = [(root, False, not told or not stated)]
    while steps:
        item = steps.pop()
        if item is None:
            close()
            continue
        if isinstance(item, str):
            parts.append(item)
            continue
        node, inside, sealed = item
        if id(node) in frame:
            inside = inside or id(node) in own
        else:
            running = node.tag in RUNNING
            if not sealed and (not inside or exact and not running):
                seal(node)
                sealed = True
            if node.tag not in FRAME and (not running and not inside and node.shape in shapes or (not running or not inside and not stated) and node.hash in exact):
                by_count += 1
                continue
            if (stated and not inside) or structural(node, inside):
                by_kind += 1
                continue
        if node.tag in ("br", "img", "wbr"):
            parts.append("" if node.tag == "wbr" else " ")
            continue
        if node.tag in BLOCKS:
            close()
            steps.append(None)
        # white space and text beside an article are not of it
        steps.extend(k if isinstance(k, str) else (k, inside, sealed) for k in reversed(node.kids) if inside or not stated or not isinstance(k, str))
    close()
    return out, by_count, by_kind


def host_of(url: Column) -> Column:
    """The host of an address in lower case; null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)", 1))
    return F.when(host != "", host)


def evidence_counts(pages: DataFrame) -> DataFrame:
    """(host, kind, hash, pages, share): of columns host and html, on how many pages of its host a hash stands, and its mean share of their text; kind 0 counts the host's pages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, kinds, hashes, shares = [], [], [], []
            for host, html in zip(*(column.to_pylist() for column in batch.columns)):
                found = {(0, 0): 0.0} | evidence(parse(html))
                hosts += [host] * len(found)
                kinds += [k for k, _ in found]
                hashes += [h for _, h in found]
                shares += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(kinds, pa.int32()), pa.array(hashes, pa.int64()), pa.array(shares, pa.float64())], ["host", "kind", "hash", "share"])

    found = pages.where("host IS NOT NULL").select("host", "html").mapInArrow(count, "host string, kind int, hash long, share double")
    return found.groupBy("host", "kind", "hash").agg(F.count(F.lit(1)).alias("pages"), F.avg("share").alias("share"))


def verdicts(counts: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, template_text: float = TEMPLATE_TEXT, content_text: float = CONTENT_TEXT) -> DataFrame:
    """(host, exact, shapes, places): the hashes of the host's templates, and of the places of its content."""
    total = counts.where("kind = 0").select("host", F.col("pages").alias("of"))
    many = counts.where((F.col("kind") > 0) & (F.col("pages") >= min_pages))
    counted = (F.col("kind") == EXACT) & (F.col("pages") >= F.lit(float(min_share)) * F.col("of"))
    shaped = (F.col("kind") == SHAPE) & (F.col("share") < template_text)
    content = (F.col("kind") == PLACE) & (F.col("share") >= content_text) & (F.col("pages") >= F.lit(float(min_share)) * F.col("of"))
    said = many.join(total, "host").where(counted | shaped | content)
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("hash")))
    return said.groupBy("host").agg(of(EXACT).alias("exact"), of(SHAPE).alias("shapes"), of(PLACE).alias("places"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points of the text), n_templates and n_kinds (subtrees removed by counts and by kind).

    Outside the article a shape on at least ``min_pages`` pages of the host is a template, however many pages the
    host has; an exact subtree is one from ``min_pages`` pages and ``min_share`` of the host's pages on. Null html is an empty page with empty text. A page
    without a host, and without a url, has no templates. Repeated rows repeat in the result and count as pages of their own; null ids are carried
    along. Cut-off and malformed pages are read as far as they go, marked sections are comments, and elements may
    nest to any depth. Two articles of one page stay both, equal or not. An empty table gives an empty result; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    id_type = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counted, kinds = [], [], []
            for html, *said in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                blocks, by_count, by_kind = extract(parse(html), *(set(s or ()) for s in said))
                texts.append("\n\n".join(blocks))
                counted.append(by_count)
                kinds.append(by_kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counted, pa.int64()), pa.array(kinds, pa.int64())], ["page_id", "url", "text", "n_templates", "n_kinds"])

    said = written(verdicts(written(evidence_counts(rows), "subtree-counts"), min_pages, min_share), "template-verdicts")
    size = said.agg(F.coalesce(F.sum(F.size("exact") + F.size("shapes") + F.size("places") + 8), F.lit(0))).first()[0] * 8
    judged = rows.join(F.broadcast(said) if size <= BROADCAST_BYTES else said, "host", "left").select("page_id", "url", "html", "exact", "shapes", "places")
    out = judged.mapInArrow(run, f"page_id {id_type}, url string, text string, n_templates long, n_kinds long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_templates", "n_kinds")
