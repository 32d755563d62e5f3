"""A tolerant HTML tree over the standard library's tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

#: Elements without content, elements whose start closes an open one, and raw text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
BLOCKS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SCOPE = {"table", "td", "th", "ul", "ol", "dl", "select", "body", "html"}
HEAD = {"title", "meta", "link", "style", "script", "base", "noscript"}


class Node:
    """An element or, with tag '', a run of text; `tag` '#' is the document."""

    __slots__ = ("attrs", "children", "data", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, data: str = ""):
        self.tag, self.attrs, self.data = tag, attrs or {}, data
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def walk(self) -> Iterator[Node]:
        """This node and all below, in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def elements(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag in tags)

    def first(self, *tags: str) -> Node | None:
        return next(self.elements(*tags), None)

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def text(self) -> str:
        """Text below, each element's part trimmed before it is joined."""
        if not self.tag:
            return self.data
        return "".join(c.text() for c in self.children).strip()

    def raw_text(self) -> str:
        return "".join(n.data for n in self.walk() if not n.tag)

    def html(self) -> str:
        if not self.tag:
            raw = self.parent is not None and self.parent.tag in ("script", "style")
            return self.data if raw else self.data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        inner = "".join(c.html() for c in self.children)
        if self.tag == "#":
            return inner
        attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" if self.tag in VOID else f"<{self.tag}{attrs}>{inner}</{self.tag}>"


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#")
        self.html = self.root.add(Node("html"))
        self.head = self.html.add(Node("head"))
        self.body: Node | None = None
        self.at = self.html

    def _open_body(self) -> None:
        if self.body is None:
            self.body = self.html.add(Node("body"))
            self.at = self.body

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {k: v or "" for k, v in reversed(attrs)}
        if tag in ("html", "body", "head"):
            if tag == "body":
                self._open_body()
            target = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in values.items():
                target.attrs.setdefault(k, v)
            if tag == "head" and self.body is None:
                self.at = self.head
            return
        if self.body is None:
            if tag in HEAD:
                if self.at is self.html:
                    self.at = self.head
            elif self.at.tag not in ("noscript",):
                self._open_body()
        if tag in BLOCKS_P:
            self._close({"p"})
        if tag in CLOSES:
            self._close(CLOSES[tag])
        if tag == "tr" and self.at.tag == "table":
            self.at = self.at.add(Node("tbody"))
        node = self.at.add(Node(tag, values))
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent or self.root

    def _close(self, tags: set[str]) -> None:
        """Close the innermost open element of these tags, unless a scope lies between."""
        n: Node | None = self.at
        while n is not None and n.tag not in SCOPE | {"#"} or n is not None and n.tag in tags:
            if n.tag in tags:
                self.at = n.parent or self.root
                n = self.at
                if n.tag not in tags:
                    return
                continue
            n = n.parent

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            self.at = self.html
            return
        n: Node | None = self.at
        while n is not None and n.tag != tag:
            if n in (self.body, self.html, self.head, self.root):
                return
            n = n.parent
        if n is not None:
            self.at = n.parent or self.root

    def handle_data(self, data: str) -> None:
        if self.body is None and self.at.tag in ("html", "head"):
            if not data.strip():
                return
            self._open_body()
        self.at.add(Node("", data=data))


def parse(html: str) -> Node:
    """The document; whatever the input, it has html, head and body."""
    b = _Builder()
    b.feed(html)
    b.close()
    b._open_body()
    return b.root
