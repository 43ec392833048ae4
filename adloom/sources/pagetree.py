"""One page of HTML into the few parts that ads are made of.

The parser is the one of the standard library; this module only keeps the tree it reports and
reads named parts off it. Which part ends up in which field is decided in Column expressions.
"""

from __future__ import annotations

from html.parser import HTMLParser

_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = {"script", "style", "template", "noscript", "head"}
_BLOCK = set(
    "address article aside blockquote dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6"
    " header hr li main nav ol p pre section table tr ul".split()
)
# Start tags that end an open element of these kinds.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}, "a": {"a"}}
_CLOSES_WITHIN = {"ul", "ol", "dl", "table", "select"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "index")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.index = len(parent.children) if parent else 0

    def elements(self):
        """All elements below, in document order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def siblings_after(self):
        peers = self.parent.children if self.parent else []
        for i in range(self.index + 1, len(peers)):
            if isinstance(peers[i], Node):
                yield peers[i]

    def classes(self):
        return (self.attrs.get("class") or "").split()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._end("p", stop=_BLOCK - {"p"})
        for closed in _CLOSES.get(tag, ()):
            self._end(closed, stop=_CLOSES_WITHIN)
        node = Node(tag, dict(attrs), self.open)
        self.open.children.append(node)
        if tag not in _VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._end(tag)

    def handle_data(self, data):
        self.open.children.append(data)

    def _end(self, tag, stop=frozenset()):
        node = self.open
        while node.parent is not None and node.tag != tag:
            if node.tag in stop:
                return
            node = node.parent
        if node.parent is not None:
            self.open = node.parent


def _pieces(node):
    stack = [iter([node])]
    closing = [""]
    while stack:
        for child in stack[-1]:
            if isinstance(child, str):
                yield " ".join(f"|{child}|".split())[1:-1]
            elif child.tag == "br":
                yield "\n"
            elif child.tag not in _HIDDEN:
                edge = "\n" if child.tag in _BLOCK else ""
                yield edge
                closing.append(edge)
                stack.append(iter(child.children))
                break
        else:
            stack.pop()
            yield closing.pop()


def shown_text(node):
    """Text as displayed: runs of whitespace are one space, blocks and breaks start a line."""
    lines = "".join(_pieces(node)).split("\n")
    return "\n".join(line for line in (" ".join(raw.split()) for raw in lines) if line)


def plain_text(node):
    """All text with whitespace runs made one space."""
    return " ".join("".join(_strings(node)).split())


def _short_texts(elements, longest):
    """Plain text of the elements that have at most `longest` characters besides whitespace.

    Built from the innermost elements outwards, so that nesting costs nothing extra.
    """
    texts = {}
    for e in reversed(elements):
        parts = [c if isinstance(c, str) else texts.get(c) for c in e.children]
        if None not in parts:
            words = f"|{''.join(parts)}|".split()
            if sum(map(len, words)) - 2 <= longest:
                texts[e] = " ".join(words)[1:-1]
    return {e: text.strip() for e, text in texts.items()}


def _strings(node):
    stack = [iter(node.children)]
    while stack:
        for child in stack[-1]:
            if isinstance(child, str):
                yield child
            else:
                stack.append(iter(child.children))
                break
        else:
            stack.pop()


def _heading(node, tags):
    """First element below that is one of the tags or has "title" in its class."""
    for e in node.elements():
        if e.tag in tags or "title" in (e.attrs.get("class") or ""):
            return shown_text(e)
    return None


def _picked(elements, selectors):
    """Text of the first element per `#id`, `.class` or `attribute=value` that has one."""
    found = {}
    for e in elements:
        has = {f"{k}={v}" for k, v in e.attrs.items()} | {f".{c}" for c in e.classes()}
        has.add(f"#{e.attrs.get('id')}")
        for s in has & selectors:
            found.setdefault(s, e)
    return {s: shown_text(e) for s, e in found.items()}


def _flat(node):
    return " ".join(shown_text(node).split())


def _beside(elements, labels, cards):
    """Values next to labels: of any element's next sibling, and of the card around the label."""
    beside, carded, named = {}, {}, set()
    texts = _short_texts(elements, max(map(len, [*labels, *cards]), default=0))
    for e in elements:
        text = texts.get(e)
        if text in labels and text not in beside:
            after = next(e.siblings_after(), None)
            if after is not None:
                beside[text] = _flat(after)
        # An element inside with the same text is the label proper.
        inner = any(isinstance(c, Node) and texts.get(c) == text for c in e.children)
        if text in cards and text not in named and not inner:
            named.add(text)
            value = next((c for c in e.parent.elements() if cards[text] in c.classes()), None)
            if value is not None:
                carded[text] = shown_text(value)
    return beside, carded


def _labelled(elements, labels, beside):
    """Value of each label: exact term, else term that contains it, else any element beside it.

    Of each way only the first match counts, and the first value that is not empty is taken.
    """
    terms = []
    for e in elements:
        after = e.siblings_after() if e.tag == "dt" else ()
        value = next((s for s in after if s.tag == "dd"), None)
        if value is not None:
            terms.append((plain_text(e), _flat(value)))
    found = {}
    for label in labels:
        exact = next((v for t, v in terms if t == label), "")
        part = next((v for t, v in terms if label in t), "")
        value = exact or part or beside.get(label)
        if value:
            found[label] = value
    return found


def _elements(html):
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return list(tree.root.elements())


PARTS = frozenset({"title", "after_h1", "labels", "cards", "described", "blocks"})


def read_fields(html, labels, cards, selectors, wanted=PARTS):
    """The wanted parts of one page that make up an ad; see `PAGE_TYPE` in `pages.py` for their shape."""
    elements = _elements(html)
    page = {}
    if wanted & {"title", "after_h1"}:
        headings = [e for e in elements if e.tag == "h1"]
        page["title"] = shown_text(headings[0]) if headings else None
        page["after_h1"] = {}
        if "after_h1" in wanted:
            for e in (next(h.siblings_after(), None) for h in headings):
                if e is not None:
                    page["after_h1"].setdefault(e.tag, shown_text(e))
    if wanted & {"labels", "cards"}:
        beside, page["cards"] = _beside(elements, labels, cards)
        page["labels"] = _labelled(elements, labels, beside) if "labels" in wanted else {}
    if "described" in wanted:
        titles = (e for e in elements if e.tag == "h3" and plain_text(e) == "Description")
        block = next((b for b in (next(t.siblings_after(), None) for t in titles) if b is not None), None)
        page["described"] = _flat(block) if block is not None else None
    if "blocks" in wanted:
        page["blocks"] = _picked(elements, selectors)
    return page


def read_links(html, marker):
    """The anchors of one page with the headings in and around them."""
    around = {}
    links = []
    for a in _elements(html):
        if a.tag != "a" or not a.attrs.get("href"):
            continue
        marked = a.attrs.get(marker[0]) == marker[1]
        own, near = _heading(a, ("h3", "h4")), None
        if marked and not own:
            if a.parent not in around:
                around[a.parent] = _heading(a.parent, ("h3", "h4"))
            near = around[a.parent]
        h4 = next((shown_text(e) for e in a.elements() if e.tag == "h4"), None)
        links.append({"href": a.attrs["href"], "marked": marked, "own": own, "near": near, "h4": h4})
    return links
