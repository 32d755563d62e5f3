"""Page boilerplate and main content (problem 5).

A page becomes a flat row of text blocks (the lines of its markdown, each matched with the block of the html it
came from). A block is described by its own and its neighbours' word counts and link densities, and by the html
element that holds it; a decision tree, trained on a small table of labelled blocks that this module writes
itself (training_pages), tells boilerplate from main content.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.llm.tree import Tree

TOKEN = re.compile(r"<!--.*?-->|<(script|style|title|noscript)\b.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
KEY = re.compile(r"[\W_]+")
LINK = re.compile(r"\[([^\]\n]*)\]\([^)\s]*(?:\s+\"[^\"]*\")?\)")
LIST = re.compile(r"\s*(?:[*+-]|\d{1,3}[.)])\s+")
ATTRS = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Elements, and words in class, id or role that tell what an element is for.
INLINE = {"a", "b", "strong", "em", "span", "code", "sup", "sub", "u", "s", "img", "font", "abbr", "time", "label", "kbd", "q", "cite", "mark", "del", "ins", "tt", "big"}
VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "col", "base", "area", "embed"}
ASIDE = {"nav", "aside", "footer", "header", "small", "i", "center", "form", "menu", "dialog"}
HOLDERS = ASIDE | {"main", "article", "section", "div", "td", "body"}
SIDE_WORDS = re.compile(r"nav|menu|cookie|consent|gdpr|banner|share|social|tools|sidebar|widget|colophon|foot|bottom|crumb|related|comment|reply|promo|advert|sponsor|legal|dialog|popup|subscribe|pager|toolbar|skip|complementary|contentinfo", re.I)
MAIN_WORDS = re.compile(r"entry|post|article|content|story|main|body|text", re.I)
TAGS = {"h1": 1, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "p": 3, "li": 4, "tr": 5, "blockquote": 6, "pre": 7, "div": 8, "text": 9}
SENTENCE_END = (".", "!", "?", "…", "。", "»", "”", ":")


@dataclass
class Holder:
    """An element that holds blocks."""

    tag: str
    parent: int
    side: int
    hint: int
    h1: int = 0
    prose: int = 0
    words: int = 0
    linked: int = 0


@dataclass
class Block:
    key: str
    tag: int
    holder: int


@dataclass
class Line:
    """A markdown line with more than white space."""

    no: int
    text: str
    kind: str  # heading, list, table, quote, code, fence, plain
    words: int
    linked: int
    key: str
    block: Block | None = None
    main: bool = True
    level: int = 0


def parse_html(html: str) -> tuple[list[Block], list[Holder]]:
    """Blocks of text in order and the elements that hold them; tolerant of unclosed and misnested elements."""
    holders, blocks = [Holder("body", -1, 0, 0)], []
    stack: list[list] = [["body", 0, False]]  # tag, holder, has block children
    text: list[str] = []
    linked, anchor, at = 0, 0, 0

    def flush(closing: str = "") -> None:
        nonlocal text, linked
        if not text:
            return
        raw = html_lib.unescape(" ".join(text))
        text, link, linked = [], linked, 0
        if not raw or raw.isspace():
            return
        top = stack[-1]
        tag, holder = top[0], top[1]
        if tag in ("div", "section", "td", "th", "dd", "dt", "caption", "figcaption") and closing == tag and not top[2] and len(top) > 3:
            tag, holder = "div", holders[holder].parent
            holder = max(holder, 0)
        elif tag in HOLDERS:
            tag = "text"
        code = TAGS.get(tag, 9)
        h = holders[holder]
        for piece in raw.split("\n") if code == 7 else (raw,):
            k = KEY.sub("", piece.lower())
            if k:
                n = len(piece.split())
                h.words += n
                h.linked += min(link, n)
                h.h1 |= code == 1
                h.prose += n if code == 3 else 0
                blocks.append(Block(k, code, holder))

    for m in TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            text.append(piece)
            if anchor:
                linked += len(piece.split())
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if name == "a":
            anchor = 0 if m[2] else 1
            continue
        if name in INLINE or name == "br" or (name == "i" and not html.startswith("\n", at) and not m[2] and stack[-1][0] != "i"):
            if name not in ("i",) or not m[2]:
                continue
        if name in ("td", "th") and (m[2] and stack[-1][0] not in ("td", "th") or not m[2] and not m[4].strip()):
            text.append(" ")
            continue
        if m[2]:
            if any(s[0] == name for s in stack[-12:]):
                while stack[-1][0] != name and len(stack) > 1:
                    flush()
                    stack.pop()
                flush(name)
                if len(stack) > 1:
                    stack.pop()
            else:
                flush()
            continue
        flush()
        stack[-1][2] = True
        if name in VOID or name in ("html", "body", "head"):
            continue
        if name == stack[-1][0] and name in ("p", "li", "tr", "td"):
            stack.pop()
        attrs = m[4]
        inside = stack[-1][1]
        plain = not attrs.strip()
        if name in HOLDERS or (name in ("p", "ul", "ol", "table") and ATTRS.search(attrs)):
            words = " ".join(ATTRS.findall(attrs)) if not plain else ""
            side = 1 if name in ASIDE else 2 if name in ("main", "article") else 0
            hint = 1 if words and SIDE_WORDS.search(words) and not MAIN_WORDS.search(words) else 2 if words and MAIN_WORDS.search(words) else 1 if words and SIDE_WORDS.search(words) else 0
            holders.append(Holder(name, inside, side or (1 if holders[inside].side == 1 else 0), hint or holders[inside].hint))
            stack.append([name, len(holders) - 1, False, *(["leaf"] if plain else [])])
        else:
            stack.append([name, inside, False])
    if at < len(html):
        text.append(html[at:])
    flush()
    return blocks, holders


def parse_markdown(markdown: str) -> list[Line]:
    """The lines with more than white space, with their kind."""
    out, fence = [], ""
    for no, raw in enumerate(markdown.split("\n")):
        s = raw.strip()
        if not s:
            continue
        level = 0
        if s.startswith(("```", "~~~")) and (not fence or s.startswith(fence)):
            kind, fence = "fence", "" if fence else s[:3]
        elif fence:
            kind = "code"
        elif s[0] == "#" and s.lstrip("#")[:1] in (" ", ""):
            kind, level = "heading", len(s) - len(s.lstrip("#"))
        elif s[0] == ">":
            kind = "quote"
        elif s[0] == "|" and s.count("|") >= 2:
            kind = "table"
        elif LIST.match(raw):
            kind = "list"
        else:
            kind = "plain"
        linked, words = 0, s
        if "](" in s:
            linked = sum(len(x.split()) for x in LINK.findall(s))
            words = LINK.sub(r"\1", s)
        out.append(Line(no, s, kind, len(words.split()), linked, KEY.sub("", words.lower()), level=level))
    return out


def match(lines: list[Line], blocks: list[Block]) -> None:
    """Give each line the html block it came from: the same letters and digits, in order; a block may hold several lines."""
    where: dict[str, list[int]] = {}
    for k, b in enumerate(blocks):
        where.setdefault(b.key, []).append(k)
    at = 0
    for line in lines:
        found = where.get(line.key) if line.key else None
        if found:
            k = next((x for x in found if x >= at), found[-1])
            line.block, at = blocks[k], max(at, k + 1)
        elif len(line.key) >= 4:
            line.block = next((b for b in blocks[max(0, at - 1) : at + 3] if line.key in b.key), None)


KINDS = {"heading": 1, "list": 2, "table": 3, "quote": 4, "code": 5, "fence": 5, "plain": 6}
FEATURES = 20


def features(lines: list[Line], holders: list[Holder]) -> np.ndarray:
    """One row a line: own and neighbouring word counts and link densities, kind, place, and html element."""
    n = len(lines)
    x = np.zeros((n, FEATURES))
    title = next((k for k, b in enumerate(lines) if b.level == 1), None)
    if title is None:
        title = next((k for k, b in enumerate(lines) if b.block is not None and b.block.tag == 1), None)
    best = max((k for k in range(n)), key=lambda k: lines[k].words - lines[k].linked, default=0)
    longest = lines[best].words if n else 0
    for k, line in enumerate(lines):
        density = line.linked / line.words if line.words else 0.0
        x[k, 0], x[k, 1] = min(line.words, 60), density
        x[k, 6], x[k, 7] = KINDS[line.kind], line.level
        x[k, 8] = line.text.rstrip("*_ »\"'").endswith(SENTENCE_END)
        x[k, 9] = 0 if title is None else 1 if k < title else 2 if k == title else 3
        x[k, 10] = 0 if title is None else min(max(k - title, -4), 6)
        x[k, 11] = min(max(k - best, -6), 6) if longest >= 15 else -9
        if line.block is None:
            x[k, 12:] = -1
        else:
            h = holders[line.block.holder]
            inner, up = 0, h.parent
            while up >= 0:
                inner |= holders[up].h1 or holders[up].prose > 0
                up = holders[up].parent
            x[k, 12:] = line.block.tag, h.h1, min(h.prose, 60), h.linked / h.words if h.words else 0, h.side, h.hint, inner, min(h.words, 60)
    if n > 1:
        x[1:, 2], x[1:, 3] = x[:-1, 0], x[:-1, 1]
        x[:-1, 4], x[:-1, 5] = x[1:, 0], x[1:, 1]
    return x


def page_lines(html: str | None, markdown: str) -> tuple[list[Line], np.ndarray]:
    lines = parse_markdown(markdown)
    blocks, holders = parse_html(html) if html else ([], [])
    match(lines, blocks)
    return lines, features(lines, holders)


# ---- the labelled table -------------------------------------------------------------------------------------

_WORDS = "harbour valley garden bridge market teacher window winter letter summer station river evening paper village corner branch record number season doctor castle ticket engine story basket museum travel kitchen orange silver cotton planet forest music button travel meadow".split()
_LAYOUTS = (
    {"nav": ("<nav>", "</nav>"), "body": ("<main><article>", "</article></main>"), "side": ("<aside>", "</aside>"), "share": ('<div class="share">', "</div>"), "foot": ("<footer>", "</footer>"), "consent": ('<div id="cookie-box">', "</div>")},
    {"nav": ("<header><nav>", "</nav></header>"), "body": ("<article>", "</article>"), "side": ("<section>", "</section>"), "share": ("<ul class=social><li>", "</li></ul>"), "foot": ('<section class="colophon">', "</section>"), "consent": ('<section class="gdpr">', "</section>")},
    {"nav": ('<div class="menu">', "</div>"), "body": ('<div class="entry">', "</div>"), "side": ('<div class="sidebar">', "</div>"), "share": ('<p class="tools">', "</p>"), "foot": ('<div class="site-bottom">', "</div>"), "consent": ('<div class="consent">', "</div>")},
    {"nav": ('<div class="q7">', "</div>"), "body": ('<div class="q1">', "</div>"), "side": ('<div class="k3">', "</div>"), "share": ('<div class="z9">', "</div>"), "foot": ('<div class="v2">', "</div>"), "consent": ('<div class="w4">', "</div>")},
    {"nav": ("<table><tr><td width=120>", "</td>"), "body": ("<td valign=top>", "</td>"), "side": ("<td bgcolor=#ddd>", "</td>"), "share": ("<i>", "</i>"), "foot": ("</tr></table><hr><small>", "</small>"), "consent": ("<center>", "</center>")},
)


@dataclass
class _Page:
    html: list[str] = field(default_factory=list)
    md: list[str] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)

    def add(self, html: str, md: list[str], label: int) -> None:
        self.html.append(html)
        self.md += [*md, ""]
        self.labels += [label] * len([x for x in md if x.strip()])


def training_pages(pages: int = 600, seed: int = 11) -> list[tuple[str, str, list[int]]]:
    """(html, markdown, label of each line that is not blank); label 1 is boilerplate. The bound on the table is `pages`."""
    rng = random.Random(seed)
    some = lambda a, b: " ".join(rng.choice(_WORDS) for _ in range(rng.randint(a, b)))
    link = lambda t: (f'<a href="https://x.example/{rng.randint(1, 999)}">{t}</a>', f"[{t}](https://x.example/{rng.randint(1, 999)})")
    out = []
    for number in range(pages):
        layout, p = _LAYOUTS[number % len(_LAYOUTS)], _Page()

        def chrome(part: str, rows: int, p: _Page = p, layout: dict = layout) -> None:
            p.html.append(layout[part][0])
            for _ in range(rows):
                t = some(1, 10)
                if rng.random() < 0.4:
                    t += "."
                t = rng.choice([t, t.upper(), t.capitalize()])
                if rng.random() < 0.15:
                    p.add(f"<div><strong>{t}</strong></div>", [f"**{t}**"], 1)
                else:
                    p.add(f"<div>{t}</div>", [t], 1)
            p.html.append(layout[part][1])

        def links(part: str, head: bool, p: _Page = p, layout: dict = layout) -> None:
            p.html.append(layout[part][0])
            if head:
                t = some(2, 4)
                p.add(f"<h2>{t}</h2>", [f"## {t}"], 1)
            all_links = [link(some(1, 3) if not head else some(3, 8)) for _ in range(rng.randint(2, 6))]
            if head or rng.random() < 0.5:
                p.add("<ul>" + "".join(f"<li>{a}</li>" for a, _ in all_links) + "</ul>", [f"* {b}" for _, b in all_links], 1)
            elif rng.random() < 0.7:
                p.add(" | ".join(a for a, _ in all_links), [" | ".join(b for _, b in all_links)], 1)
            else:
                p.add(f"<div>{all_links[0][0]} » {some(1, 2)} » {some(3, 8)}</div>", [f"{all_links[0][1]} » {some(1, 2)}"], 1)
                p.md[-2] = LINK.sub(r"\1", p.md[-2]) and p.md[-2]
            p.html.append(layout[part][1])

        for _ in range(rng.choice([0, 1, 1, 2])):
            rng.choice([lambda: links("nav", False), lambda: chrome("nav", rng.randint(1, 4)), lambda: chrome("consent", rng.randint(1, 3))])()
        if rng.random() < 0.2:
            links("side", True)
        p.html.append(layout["body"][0])
        style = rng.random()
        if style > 0.06:
            t = some(3, 9)
            p.add(f"<h1>{t}</h1>", [f"# {t}"], 0)
            for _ in range(rng.choice([0, 1, 1, 2])):
                t = rng.choice([f"By {some(2, 3)}", f"Last updated {rng.randint(1, 28)}.03.2021 at 10:{rng.randint(10, 59)}", some(4, 7)])
                p.add(f"<div>{t}</div>", [t], 0)
        bare = rng.random()
        if style <= 0.06 and bare < 0.7:
            t = str(rng.randint(100, 999)) if bare < 0.1 else some(1, 5).capitalize() + "."
            code = [f"{some(1, 3)}: {rng.randint(1, 99)}" for _ in range(rng.randint(1, 4))]
            p.add(*((f"<p>{t}</p>", [t]) if bare < 0.3 else ("<pre><code>" + "\n".join(code) + "</code></pre>", ["```", *code, "```"])), 0)
        for _ in range(0 if style <= 0.06 and bare < 0.7 else rng.randint(1, 7) if style > 0.15 else rng.randint(1, 2)):
            what = rng.random()
            if what < 0.6 or style < 0.06:
                t = ". ".join(some(4, 18) for _ in range(rng.randint(1, 4) if style > 0.15 else 1)) + "."
                a, b = link(some(1, 1))
                if rng.random() < 0.3:
                    p.add(f"<p>{t} {a} {t}</p>", [f"{t} {b} {t}"], 0)
                else:
                    p.add(f"<p>{t}</p>", [t], 0)
            elif what < 0.7:
                t = some(2, 8)
                p.add(f"<h2>{t}</h2>", [f"## {t}"], 0)
            elif what < 0.8:
                plain = rng.random() < 0.7
                rows = [(t, t) if plain else link(t) for t in (some(1, 8) for _ in range(rng.randint(2, 12)))]
                p.add("<ul>" + "".join(f"<li>{a}</li>" for a, _ in rows) + "</ul>", [f"* {b}" for _, b in rows], 0)
            elif what < 0.88:
                rows = [(some(1, 2), str(rng.randint(1, 900))) for _ in range(rng.randint(2, 5))]
                p.add("<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in rows) + "</table>", [f"| {a} | {b} |" for a, b in rows], 0)
            elif what < 0.94:
                t = some(6, 20)
                p.add(f"<blockquote>{t}</blockquote>", [f"> {t}"], 0)
            else:
                code = [f"{some(1, 2)} = {rng.randint(1, 99)}" for _ in range(rng.randint(1, 4))]
                p.add("<pre><code>" + "\n".join(code) + "</code></pre>", ["```", *code, "```"], 0)
            if rng.random() < 0.05:
                chrome("share", rng.randint(1, 2))
        if rng.random() < 0.5:
            chrome("share", rng.randint(1, 3))
        p.html.append(layout["body"][1])
        for _ in range(rng.choice([0, 1, 2, 2])):
            rng.choice([lambda: links("side", True), lambda: chrome("foot", rng.randint(1, 4)), lambda: chrome("consent", rng.randint(1, 2)), lambda: links("foot", False)])()
        page = f"<html><head><title>x</title></head><body>{chr(10).join(p.html)}</body></html>"
        out.append((page, "\n".join(p.md), p.labels))
    return out


@lru_cache(2)
def classifier(pages: int = 600) -> Tree:
    """The tree, fitted on the labelled table: each page once with its html and, every fifth, once without."""
    xs, ys = [], []
    for k, (html, md, labels) in enumerate(training_pages(pages)):
        for h in (html, None) if k % 5 == 0 else (html,):
            _, x = page_lines(h, md)
            xs.append(x)
            ys += labels
    return Tree(depth=12).fit(np.vstack(xs), np.array(ys))


def label_pages(pages: list[tuple[str | None, str]], tree: Tree) -> list[list[Line]]:
    """Lines of each page with `main` set; lines without letters or digits follow their neighbour."""
    all_lines, xs = [], []
    for html, md in pages:
        lines, x = page_lines(html, md)
        all_lines.append(lines)
        xs.append(x)
    if not any(all_lines):
        return all_lines
    side = tree.predict(np.vstack(xs)) >= 0.5
    at = 0
    for lines in all_lines:
        for line in lines:
            line.main = not side[at]
            at += 1
        for k, line in enumerate(lines):
            if not line.key:
                near = lines[k + 1] if line.kind == "fence" and k + 1 < len(lines) and lines[k + 1].kind == "code" else lines[k - 1] if k else None
                line.main = near.main if near is not None else True
    return all_lines


def labelled(batches: Iterator[pa.RecordBatch], tree: Tree, size: int = 256) -> Iterator[tuple[pa.RecordBatch, list[list[Line]]]]:
    """Slices of batches of (id, html, markdown, …) with the labelled lines of their rows (none where markdown is null)."""
    for b in batches:
        for start in range(0, b.num_rows, size):
            part = b.slice(start, size)
            yield part, label_pages([(h, m or "") for h, m in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)], tree)


def find_boilerplate(pages: DataFrame, page_id: str = "page_id", html: str = "html", markdown: str = "markdown") -> DataFrame:
    """(page_id, line_no) of each markdown line outside the main body.

    Rows with null markdown have no lines; a null html leaves the markdown's own features; empty tables give an
    empty result; repeated rows give repeated rows; other columns are ignored. Whole texts are read, row by row.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    tree = classifier()
    id_type = to_arrow_type(pages.schema[page_id].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, all_lines in labelled(batches, tree):
            ids = b.column(0).to_pylist()
            rows = [(i, line.no) for i, lines in zip(ids, all_lines, strict=True) for line in lines if not line.main]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), pa.array([r[1] for r in rows], pa.int32())], names=[page_id, "line_no"])

    schema = f"`{page_id}` {pages.schema[page_id].dataType.simpleString()}, line_no int"
    return pages.where(f"`{markdown}` is not null").select(page_id, html, markdown).mapInArrow(run, schema)


def main_text(pages: DataFrame, page_id: str = "page_id", html: str = "html", markdown: str = "markdown") -> DataFrame:
    """(page_id, main_text): the markdown's main body alone. Same cases as find_boilerplate."""
    from pyspark.sql.pandas.types import to_arrow_type

    tree = classifier()
    id_type = to_arrow_type(pages.schema[page_id].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, all_lines in labelled(batches, tree):
            texts = ["\n".join(line.text for line in lines if line.main) for lines in all_lines]
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_pylist(), id_type), pa.array(texts, pa.string())], names=[page_id, "main_text"])

    schema = f"`{page_id}` {pages.schema[page_id].dataType.simpleString()}, main_text string"
    return pages.where(f"`{markdown}` is not null").select(page_id, html, markdown).mapInArrow(run, schema)
