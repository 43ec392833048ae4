"""Main text of web pages: structural boxes and what recurs across the pages of a host go, the article stays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.llm.texts import map_rows, text_struct
from adloom.session import materialize

# Elements without content, without text, that end a paragraph, and that stand for a part of the site.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set(
    "head title script style noscript template iframe object svg canvas audio video map annotation annotation-xml select textarea button datalist "
    "dialog nav footer aside form menu".split()
)
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot "
    "thead caption tr ul".split()
)
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption li dt dd tr".split())
ROLES = set(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
# Beginnings of class names that tell of the page and not of the element.
ABOUT = re.compile(r"(?:no|not|has|have|with|without|is|hide|show)[-_]")
# Words of class and id names of boxes that belong to the site.
BOXES = set(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies cta disclaimer discussion disqus dropdown footer footnav gdpr login masthead menu "
    "menus modal nav navbar navigation newsletter notice notices notification overlay pager paging pagination paywall "
    "popup promo promoted promotion reactions recirc recommended related replies reply respond responses share sharing "
    "sidebar sidebars signin signup skip social sponsor sponsored sponsors subscribe subscription teaser teasers toolbar "
    "topbar warning widget widgets".split()
)
#: Elements that an opening tag closes if they are the innermost open ones.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"},
    "tfoot": {"tr", "td", "th", "thead", "tbody"},
    "thead": {"tr", "td", "th"},
}
#: Elements an end tag or an implied end does not reach out of.
FENCES = set("html body table td th article main section".split())


class Node:
    """An element: its tag, marks of its role, children (elements and strings), and a hash of all it holds.

    `size` counts the words below it, `bulk` tells that they are most of those of the article around it.
    """

    __slots__ = ("tag", "words", "role", "hidden", "children", "mark", "article", "size", "bulk")

    def __init__(self, tag: str, attrs: list[tuple[str, str | None]] = ()):
        named = {k: v or "" for k, v in attrs}
        self.tag = tag
        names = f"{named.get('class', '')} {named.get('id', '')}".lower().split()
        self.words = {w for name in names if not ABOUT.match(name) for w in re.split(r"[^a-z0-9]+", name)} - {""}
        self.role = named.get("role", "").lower()
        self.hidden = "hidden" in named or named.get("aria-hidden", "").lower() == "true"
        self.hidden |= bool(re.search(r"display\s*:\s*none", named.get("style", "").lower()))
        self.children: list[Node | str] = []
        self.mark = 0
        self.article = False
        self.size = 0
        self.bulk = False


class _Reader(HTMLParser):
    """Builds the tree of a page; it takes any text and closes what is left open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        # How many elements of each tag are open since the last fence and before it, and how many fences.
        self.since: list[dict[str, int]] = [{}]
        self.fences: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.open[:4]):
            return
        if tag in BLOCK:
            self._close("p")
        for inner in CLOSES.get(tag, ()):
            if self.open[-1].tag in CLOSES[tag]:
                self._pop()
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            if tag in FENCES:
                self.since.append({})
                self.fences[tag] = self.fences.get(tag, 0) + 1
            else:
                self.since[-1][tag] = self.since[-1].get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def _pop(self) -> None:
        tag = self.open.pop().tag
        if tag in FENCES:
            self.since.pop()
            self.fences[tag] -= 1
        else:
            self.since[-1][tag] -= 1

    def _close(self, tag: str) -> None:
        """Close the innermost open element of a tag, unless a fence lies before it; each element is closed once."""
        if self.fences.get(tag) if tag in FENCES else self.since[-1].get(tag):
            while self.open[-1].tag != tag:
                self._pop()
            self._pop()


def tree(html: str) -> Node:
    """The tree of a page with the hashes of all subtrees: tag, names, and the hashes and texts in order."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    todo: list[tuple[Node, bool]] = [(reader.root, False)]
    while todo:
        node, done = todo.pop()
        inner = [c for c in node.children if isinstance(c, Node)]
        if not done:
            todo.append((node, True))
            todo.extend((c, False) for c in inner)
            continue
        said = []
        for c in node.children:
            if isinstance(c, str):
                words = c.split()
                node.size += len(words)
                said.append(" ".join(words))
            else:
                node.size += 0 if c.tag in SILENT else c.size
                said.append(str(c.mark))
        names = " ".join(sorted(node.words))
        node.mark = xxhash.xxh64_intdigest("\0".join([node.tag, node.role, names, *filter(None, said)])) - (1 << 63)
        node.article = node.tag in ("article", "main") or node.role == "main" or any(c.article for c in inner)
    around = [(reader.root, 0)] if reader.root.article else []
    while around:
        node, words = around.pop()
        node.bulk = 2 * node.size > words > 0
        words = node.size if node.tag in ("article", "main") or node.role == "main" else words
        around.extend((c, words) for c in node.children if isinstance(c, Node))
    return reader.root


def is_box(node: Node, inside: bool) -> bool:
    """Whether an element is a part of the site by its tag, role or names; `inside` an article or not."""
    if node.tag in SILENT or node.hidden:
        return True
    if node.tag in ("html", "body", ""):
        return False
    if node.article:
        return bool(inside and node.tag == "article" and node.words & {"comment", "comments", "teaser", "related", "promo"})
    if node.role in ROLES or (node.words & BOXES and not (inside and node.bulk)):
        return True
    return not inside and (node.tag == "header" or "header" in node.words)


def marks(root: Node) -> set[int]:
    """The hashes of the subtrees that may be template: elements that hold text, but not the prose of an article."""
    found: set[int] = set()
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inner = inside or node.tag in ("article", "main") or node.role == "main"
        for child in node.children:
            if isinstance(child, str) or child.tag in ("head", "script", "style"):
                continue
            todo.append((child, inner))
            if child.tag in BLOCK and not child.article and child.tag not in ("html", "body"):
                if not inner or child.tag not in PROSE:
                    found.add(child.mark)
    return found


def main_text(root: Node, template: set[int]) -> str:
    """The blocks of the article, or of the page if it has none, without boxes and subtrees of the template.

    An element that holds most of an article's words is judged by its parts, and an article that would lose most of its
    words to the template keeps them all: it is a copy, not a box.
    """

    def parts(inside: Node) -> Iterator[tuple[Node, bool]]:
        todo = [(inside, inside.tag in ("article", "main"))]
        while todo:
            node, within = todo.pop()
            yield node, within
            for child in reversed(node.children):
                if isinstance(child, Node) and not gone(child, within):
                    todo.append((child, within or child.tag in ("article", "main") or child.role == "main"))

    def gone(node: Node, inside: bool) -> bool:
        return is_box(node, inside) or recurs(node, inside)

    def recurs(node: Node, inside: bool) -> bool:
        if node.article or node.mark not in template or node.tag in ("html", "body"):
            return False
        return node.tag in BLOCK and (not inside or (node.tag not in PROSE and not node.bulk))

    every = [n for n, _ in parts(root)]
    roots = [n for n in every if n.tag == "article"] or [n for n in every if n.tag == "main" or n.role == "main"]
    below: set[int] = set()
    for n in roots:
        if id(n) not in below:
            below |= {id(m) for m, _ in parts(n) if m is not n}
    roots = [n for n in roots if id(n) not in below] or [root]
    line: list[str] = []

    def end(blocks: list[str]) -> None:
        said = " ".join("".join(line).split())
        if said:
            blocks.append(said)
        line.clear()

    def read(top: Node, boxes_alone: bool = False) -> tuple[list[str], bool]:
        blocks: list[str] = []
        lost = False  # whether the article loses an element to the template
        # A string is text, None the end of a block, a pair an element still to be opened.
        todo: list = [(top, top is not root)]
        while todo:
            item = todo.pop()
            if item is None:
                end(blocks)
            elif isinstance(item, str):
                line.append(item)
            else:
                node, inside = item
                if node.tag in BLOCK:
                    end(blocks)
                    todo.append(None)
                elif node.tag in ("br", "td", "th"):
                    line.append(" ")
                for child in reversed(node.children):
                    if isinstance(child, str):
                        todo.append(child)
                    elif is_box(child, inside):
                        continue
                    elif boxes_alone or not recurs(child, inside):
                        todo.append((child, inside))
                    elif inside:
                        lost |= child.size > 0
                        todo.append(None)
        end(blocks)
        return blocks, lost

    said: list[str] = []
    for top in roots:
        blocks, lost = read(top)
        if lost:
            whole, _ = read(top, boxes_alone=True)
            blocks = whole if 2 * _count(blocks) < _count(whole) else blocks
        said += blocks
    return "\n\n".join(said)


def _count(blocks: list[str]) -> int:
    """How many words there are in blocks with single spaces."""
    return sum(b.count(" ") + 1 for b in blocks)


def host_of(url: Column) -> Column:
    """The host of an address in small letters; empty for a null address or one without a host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))


def templates(pages: DataFrame, least_pages: int = 5, least_percent: int = 10) -> DataFrame:
    """The subtrees that recur across a host: `_host` and `_template`, an array of hashes.

    A subtree is template if at least `least_pages` pages of the host and `least_percent` percent of them hold it. That
    bounds the array: a host has at most (subtrees of a page) * 100 / `least_percent` such subtrees however many pages.
    Pages of a host with one main text, boxes aside, are one page, which holds what any of them holds; those without any
    are one if their html is. Inside articles, elements other than prose are counted like those around them.
    """

    def rows(slices: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in slices:
            out: dict[str, list] = {"_host": part["_host"], "_page": [], "_marks": []}
            for html in part["html"]:
                root = tree(html or "")
                out["_page"].append(xxhash.xxh64_intdigest(main_text(root, set()) or html or "") - (1 << 63))
                out["_marks"].append(sorted(marks(root)))
            yield out

    schema = "_host string, _page long, _marks array<long>"
    read = map_rows(pages.select(host_of(F.col("url")).alias("_host"), "html"), schema, rows)
    # The null mark of each page counts the pages themselves, so that one pass over them is enough.
    every = F.explode(F.concat(F.array(F.lit(None).cast("long")), F.col("_marks"))).alias("_mark")
    counts = read.select("_host", "_page", every).distinct().groupBy("_host", "_mark").agg(F.count("*").alias("_n"))
    counts = materialize(counts.filter(F.col("_n") >= least_pages), "subtrees")
    total = counts.filter(F.col("_mark").isNull()).select("_host", F.col("_n").alias("_pages"))
    often = counts.filter(F.col("_mark").isNotNull()).join(total, "_host")
    often = often.filter(100 * F.col("_n") >= least_percent * F.col("_pages"))
    # Stored, so that a join with it is fed by shuffles alone and pages of a hot host can be split.
    return materialize(often.groupBy("_host").agg(F.collect_list("_mark").alias("_template")), "templates")


def extract_text(pages: DataFrame, least_pages: int = 5, least_percent: int = 10, name: str = "text") -> DataFrame:
    """Add the main text of each page as `name`: blocks with single spaces, joined by blank lines.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments go by tag, role and names, and so do
    subtrees that recur across the host. Inside an article, paragraphs, headings, quotes and items are never template of
    themselves, however often they are quoted, and no article loses most of its words to the template. Null or empty html
    gives an empty text, copies of a page have its text and count once for the template, no rows give none, other columns
    stay, save one called `name`, which is replaced.
    """
    own = [c for c in pages.columns if c != name]
    known = templates(pages, least_pages, least_percent)
    joined = pages.withColumn("_host", host_of(F.col("url"))).join(known, "_host", "left")
    both = F.struct(F.col("html").alias("html"), F.col("_template").alias("template"))
    return joined.select(*own, text_struct(both, "text string", _texts)["text"].alias(name))


def _texts(page: dict) -> tuple[str]:
    return (main_text(tree(page["html"] or ""), set(page["template"] or ())),)


def extraction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op10_site_template_removal": extraction_query}
ORACLE: dict[str, str] = {}
