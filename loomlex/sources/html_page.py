"""Reading of one HTML page: meta values, links, issue pages and the texts of named blocks."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HEADINGS = ("h1", "h2", "h3")


def squeeze(text: str | None) -> str:
    return " ".join((text or "").split())


class Node:
    """An element with its attributes, classes and children (elements and strings)."""

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.classes = frozenset((attrs.get("class") or "").split())
        self.children: list[Node | str] = []

    def walk(self):
        """Elements below this one in the order of the page."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self):
        todo: list[Node | str] = list(reversed(self.children))
        while todo:
            one = todo.pop()
            if isinstance(one, str):
                yield one
            else:
                todo += reversed(one.children)

    def text(self, sep: str = " ") -> str:
        return sep.join(t for s in self.strings() if (t := s.strip()))

    def find(self, *path: tuple[str | None, str | None]) -> list[Node]:
        """Elements reached by steps of (tag, class) at any depth; None stands for any."""
        found = [self]
        for tag, name in path:
            found = list({id(n): n for f in found for n in f.walk() if (tag is None or n.tag == tag) and (name is None or name in n.classes)}.values())
        return found

    def above(self, tag: str | None = None, name: str | None = None) -> Node | None:
        up = self.parent
        while up is not None and not ((tag is None or up.tag == tag) and (name is None or name in up.classes)):
            up = up.parent
        return up


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        up = self.at
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None and up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def meta_values(root: Node) -> dict[str, list[str]]:
    """Contents of meta elements by name or property, in order, blank ones left out (SRC5)."""
    out: dict[str, list[str]] = {}
    for n in root.find(("meta", None)):
        key, value = n.attrs.get("name") or n.attrs.get("property"), squeeze(n.attrs.get("content"))
        if key and value:
            out.setdefault(key, []).append(value)
    return out


def read_page(html: str | None, url: str = "") -> dict:
    """Meta values, absolute links in order, headings, and the blocks that stand in for missing meta values."""
    root = tree(html)
    links = [urljoin(url, href) for n in root.find(("a", None)) if (href := squeeze(n.attrs.get("href")))]
    abstract = next((n.text("\n") for n in root.find((None, "abstract"), (None, "value")) if "item" in (n.above(name="abstract") or n).classes), "")
    blocks = [n for n in root.find((None, "references"), (None, "value"), ("p", None)) if "item" in (n.above(name="references") or n).classes]
    return {
        "meta": meta_values(root), "links": list(dict.fromkeys(links)), "headings": [t for n in root.walk() if n.tag in _HEADINGS and (t := squeeze(n.text()))],
        "abstract": abstract, "references": [t for n in blocks if (t := squeeze(n.text()))],
    }


#: Fixed value: the class of the heading of an issue page; themes may have others.
HEADING_CLASSES = ("current_issue_title",)


def read_issue(html: str | None, url: str = "", headings: tuple[str, ...] = HEADING_CLASSES) -> dict:
    """Heading, day of publication and the articles of an issue page by section (SRC4).

    The heading is the first element of the first class in ``headings`` that the page has, or empty.  A page without section blocks is one section.
    """
    root = tree(html)
    heading = next((squeeze(n.text()) for name in headings for n in root.find((None, name))[:1]), "")
    published = ""
    for n in root.walk():
        if any(isinstance(c, str) and re.search("опубликован", c, re.I) for c in n.children):
            near = n if "published" in n.classes else n.above(name="published") or (n if n.tag == "section" else n.above(tag="section"))
            published = next((squeeze(v.text()) for v in near.find((None, "value"))), "") if near else ""
            break
    articles = []
    for block in root.find((None, "sections"), (None, "section")) or [root]:
        titles = [n for n in block.walk() if n.tag in ("h2", "h3")]
        own = next((n for n in titles if n.parent is block), titles[0] if titles else None)
        section = squeeze(own.text()) if own else ""
        for summary in block.find((None, "obj_article_summary")):
            title = next((a for h in summary.find(("h3", "title")) for a in h.find(("a", None))), None)
            if title is None:
                continue
            galley = next((n for n in summary.find((None, "obj_galley_link")) if "/article/view/" in (n.attrs.get("href") or "")), None)
            articles.append({"url": urljoin(url, title.attrs.get("href") or ""), "pdf_url": urljoin(url, galley.attrs["href"]) if galley else "", "section": section or "Статьи"})
    return {"heading": heading, "published": published, "articles": articles}
