"""Classic variants of the page operators, which weigh the same evidence by other numbers."""

from __future__ import annotations

import math
import re
from statistics import pvariance

from webloom.dom.extract import DROPPED
from webloom.dom.tree import Node, parse

#: Weights of elements and class words of the classic pruning.
TAGS = {"div": 0.5, "p": 1.0, "article": 1.5, "section": 1.0, "span": 0.3, "li": 0.5, "ul": 0.5, "ol": 0.5, "h1": 1.2, "h2": 1.1, "h3": 1.0, "h4": 0.9, "h5": 0.8, "h6": 0.7}
NEGATIVE = re.compile(r"nav|footer|header|sidebar|ads|comment|promo|advert|social|share", re.I)


def table_score(table: Node) -> int:
    """How much a table looks like data: head, body, header cells, even rows, caption, dense text, size; nesting and layout cost."""
    rows = [[c for c in r.children if c.tag in ("td", "th")] for r in table.elements("tr")]
    rows = [r for r in rows if r]
    score = 2 * (table.first("thead") is not None) + (table.first("tbody") is not None)
    heads = sum(c.tag == "th" for r in rows for c in r)
    if heads:
        score += 2 + (bool(rows) and any(c.tag == "th" for c in rows[0]))
    score -= 3 * any(n is not table for n in table.elements("table"))
    score -= 3 * (table.attrs.get("role", "").lower() in ("presentation", "none"))
    widths = [len(r) for r in rows]
    if widths and pvariance(widths) < 1:
        score += 2
    score += 2 * (table.first("caption") is not None) + bool(table.attrs.get("summary"))
    tags = sum(1 for n in table.walk() if n.tag)
    ratio = len(table.raw_text().strip()) / (tags + 1e-9)
    score += 3 if ratio > 20 else 2 if ratio > 10 else 0
    score += sum(0.5 for a in table.attrs if a.startswith("data-"))
    if widths and sum(widths) / len(widths) >= 2 and len(rows) >= 2:
        score += 2
    return score


def data_tables(html: str, threshold: float = 7) -> list[dict]:
    """[{headers, rows, caption, score}] of the tables that reach the threshold; cells that span columns are repeated.

    Rows are brought to the width of the headers; without header cells the headers are "Column 1" and so on.
    """
    out = []
    for t in parse(html).elements("table"):
        score = table_score(t)
        if score < threshold:
            continue
        spread, heads = [], []
        for r in t.elements("tr"):
            cells = [c for c in r.children if c.tag in ("td", "th")]
            values = [c.text() for c in cells for _ in range(max(1, int(c.attrs["colspan"]) if c.attrs.get("colspan", "").isdigit() else 1))]
            if cells and not heads and all(c.tag == "th" for c in cells):
                heads = values
            elif cells:
                spread.append(values)
        width = len(heads) or max((len(r) for r in spread), default=0)
        heads = heads or [f"Column {k + 1}" for k in range(width)]
        caption = t.first("caption")
        out.append({"headers": heads, "rows": [(r + [""] * width)[:width] for r in spread], "caption": caption.text() if caption else "", "score": score})
    return out


def prune(html: str, threshold: float = 0.48) -> list[str]:
    """HTML of the body's children that survive a fixed threshold, from the top down."""
    body = parse(html).first("body")

    def score(n: Node) -> float:
        text = n.raw_text().strip()
        size, length = len(n.html()), len(text)
        linked = sum(len(c.raw_text().strip()) for c in n.children if c.tag == "a")
        marks = n.attrs.get("class", "") + " " + n.attrs.get("id", "")
        density = length / size if size else 0.0
        return 0.4 * density + 0.2 * (1 - (linked / length if length else 0.0)) + 0.2 * TAGS.get(n.tag, 0.5) + 0.1 * (0.5 if not NEGATIVE.match(marks.strip()) else 0.0) + 0.1 * math.log(length + 1)

    def keep(n: Node) -> None:
        for c in list(n.children):
            if c.tag and (c.tag in DROPPED or not c.raw_text().strip() or score(c) < threshold):
                n.children.remove(c)
            elif c.tag:
                keep(c)

    if body is None:
        return []
    keep(body)
    return [c.html() for c in body.children if c.tag]
