"""Relevance within one page: its text chunks, its own query, and BM25 between them."""

from __future__ import annotations

import math
from collections import Counter

from webloom.dom.tree import Node
from webloom.functions.stem import stem
from webloom.functions.text import STOP_WORDS

#: Elements that make a chunk, those whose text is none, and weights of elements.
BLOCKS = {"p", "div", "section", "article", "main", "li", "td", "th", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "title", "figcaption", "dd", "dt", "summary", "address"}
SILENT = {"script", "style", "noscript", "nav", "footer", "header", "aside", "form", "iframe"}
WEIGHTS = {"h1": 5.0, "h2": 4.0, "h3": 3.0, "h4": 2.5, "h5": 2.0, "h6": 2.0, "title": 4.0, "strong": 2.0, "b": 1.5, "em": 1.5, "code": 2.0, "pre": 1.5, "th": 1.5, "blockquote": 2.0}
_STOP = set(STOP_WORDS)


def tokens(text: str) -> list[str]:
    """Stems of the lower-case words of at least two bytes that are no stop words."""
    cut = (w.strip(".,;:!?\"'()[]{}") for w in text.lower().split())
    return [stem(w) for w in cut if len(w.encode()) >= 2 and w not in _STOP]


def text_chunks(doc: Node) -> list[tuple[str, str]]:
    """(tag of the nearest block, text) of each run of text with at least two words."""
    out = []
    for n in doc.walk():
        if n.tag or len(n.data.split()) < 2:
            continue
        above = list(n.ancestors())
        if not any(a.tag in SILENT for a in above):
            out.append((next((a.tag for a in above if a.tag in BLOCKS), "body"), " ".join(n.data.split())))
    return out


def page_query(doc: Node) -> str:
    """What the page is about by its own words: title, else first heading, keywords, description, first long paragraph."""
    for tag in ("title", "h1"):
        n = doc.first(tag)
        if n is not None and n.raw_text().strip():
            return n.raw_text().strip()
    for name in ("keywords", "description"):
        for m in doc.elements("meta"):
            if m.attrs.get("name", "").lower() == name and m.attrs.get("content", "").strip():
                return m.attrs["content"].strip()
    return next((p.text() for p in doc.elements("p") if len(p.text().encode()) > 150), "")


def relevant(chunks: list[tuple[str, str]], query: str, threshold: float = 0.0, k1: float = 2.0, b: float = 0.75) -> list[tuple[int, str, str, float]]:
    """(index, tag, text, score) of the chunks that reach the threshold, in their order; all without a query.

    The page's chunks are the corpus; a query word counts as often as it is repeated.
    """
    asked = tokens(query)
    wanted = sorted(set(asked))
    if not wanted:
        return [(i, t, x, 0.0) for i, (t, x) in enumerate(chunks)]
    counts = [Counter(tokens(x)) for _, x in chunks]
    sizes = [sum(c.values()) for c in counts]
    mean, n = sum(sizes) / max(1, len(sizes)), len(chunks)
    idf = {q: math.log((n - df + 0.5) / (df + 0.5) + 1) for q in wanted for df in (sum(q in c for c in counts),)}
    out = []
    for i, ((tag, text), c, size) in enumerate(zip(chunks, counts, sizes, strict=True)):
        score = sum(asked.count(q) * idf[q] * c[q] * (k1 + 1) / (c[q] + k1 * (1 - b + b * size / mean)) for q in wanted if c[q]) * WEIGHTS.get(tag, 1.0)
        if score >= threshold:
            out.append((i, tag, text, score))
    return out


def okapi(corpus: list[list[str]], query: list[str], k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> list[float]:
    """Okapi BM25 of each text: a word in more than half of them counts by `floor` times the mean weight, not below 0."""
    n = len(corpus)
    counts = [Counter(t) for t in corpus]
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean_idf = sum(idf.values()) / max(1, len(idf))
    idf = {w: v if v >= 0 else floor * mean_idf for w, v in idf.items()}
    mean = sum(map(len, corpus)) / max(1, n)
    return [sum(idf.get(q, 0.0) * c[q] * (k1 + 1) / (c[q] + k1 * (1 - b + b * len(t) / (mean or 1.0))) for q in query if c[q]) for c, t in zip(counts, corpus, strict=True)]


def classic_relevant(doc: Node, query: str | None = None, threshold: float = 1.0, least_words: int = 0) -> list[tuple[str, str, float]]:
    """(kind, text, score) of the page's text runs that reach the threshold, in their order, each text once.

    Words are cut at white space and stemmed; stop words don't count. Without a query the page's own is taken; a page
    without one has none.
    """
    from webloom.dom.scrape import page_query, text_runs

    asked = [stem(w) for w in (query or page_query(doc)).lower().split()]
    asked = [w for w in asked if w not in _STOP and len(w) > 1]
    runs = text_runs(doc, least_words)
    if not asked or not runs:
        return []
    corpus = [[w for w in (stem(x) for x in t.lower().split()) if w not in _STOP and len(w) > 1] for _, t in runs]
    out: dict[str, tuple[str, str, float]] = {}
    for (kind, text), score in zip(runs, okapi(corpus, asked), strict=True):
        if score >= threshold:
            out.setdefault(text, (kind, text, score))
    return list(out.values())
