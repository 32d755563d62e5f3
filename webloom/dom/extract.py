"""What a page's tree yields: links, metadata, tables, media, structure, pruned content, Markdown, records by schema."""

from __future__ import annotations

import json
import math
import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from webloom.dom.select import css, xpath
from webloom.dom.tree import Node, parse
from webloom.functions.urls import TRACKING

#: Link schemes left out, and elements and class words by which pruning weighs an element.
SKIPPED = ("javascript:", "mailto:", "tel:", "data:", "ftp:")
DROPPED = {"nav", "footer", "header", "aside", "script", "style", "form", "iframe", "noscript"}
TAG_WEIGHT = {"div": 0.5, "p": 1.0, "article": 1.5, "section": 1.0, "span": 0.3, "li": 0.5, "ul": 0.5, "ol": 0.5, "h1": 1.2, "h2": 1.1, "h3": 1.0, "h4": 0.9, "h5": 0.8, "h6": 0.7}
NEGATIVE = re.compile(r"nav|footer|header|sidebar|ads|comment|promo|advert|social|share", re.I)
ICONS = ("icon", "logo", "avatar", "sprite", "favicon", "badge", "button", "arrow", "bullet")


def normalize(href: str, base: str) -> str:
    """Absolute form of a link on a page, '' if it can't be read; host in lower case, no fragment, no tracking."""
    try:
        u = urlsplit(urljoin(base, href.strip()))
    except ValueError:
        return ""
    pairs = parse_qsl(u.query, keep_blank_values=True)
    kept = [(k, v) for k, v in pairs if k.lower() not in TRACKING]
    query = u.query if len(kept) == len(pairs) else urlencode(sorted(kept, key=lambda x: x[0]))
    return urlunsplit((u.scheme, u.netloc.lower(), u.path.rstrip("/") or "/", query, ""))


def absolute(base: str, href: str) -> str:
    """href made absolute, or as it is if it can't be read."""
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def base_domain(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower().removeprefix("www.")
    except ValueError:
        return ""


def links(doc: Node, base: str) -> list[dict]:
    """[{href, text, is_external}] of the page's links, the first of each target."""
    own, out, seen = base_domain(base), [], set()
    for a in doc.elements("a"):
        href = a.attrs.get("href", "").strip()
        if not href or href.startswith("#") or href.lower().startswith(SKIPPED):
            continue
        target = normalize(href, base)
        if target and target not in seen:
            seen.add(target)
            host = base_domain(target)
            out.append({"href": target, "text": a.text(), "is_external": not (host == own or host.endswith("." + own))})
    return out


def metadata(doc: Node) -> dict:
    """title, description, keywords, author, language, canonical, open_graph, twitter_card, json_ld."""
    out: dict = {"title": "", "description": "", "keywords": "", "author": "", "language": "", "canonical": "", "open_graph": {}, "twitter_card": {}, "json_ld": []}
    html = doc.first("html")
    out["language"] = html.attrs.get("lang", "") if html else ""
    for n in doc.walk():
        if n.tag == "title" and not out["title"]:
            out["title"] = n.raw_text().strip()
        elif n.tag == "meta":
            name, prop, content = n.attrs.get("name", "").lower(), n.attrs.get("property", "").lower(), n.attrs.get("content", "")
            if name in ("description", "keywords", "author") and not out[name]:
                out[name] = content
            for key in (prop, name):
                if key.startswith("og:"):
                    out["open_graph"][key[3:]] = content
                elif key.startswith("twitter:"):
                    out["twitter_card"][key[8:]] = content
        elif n.tag == "link" and n.attrs.get("rel", "").lower() == "canonical" and not out["canonical"]:
            out["canonical"] = n.attrs.get("href", "")
        elif n.tag == "script" and n.attrs.get("type", "").lower() == "application/ld+json":
            raw = n.raw_text().strip()
            try:
                json.loads(raw)
            except ValueError:
                continue
            out["json_ld"].append(raw)
    out["title"] = out["title"] or out["open_graph"].get("title", "")
    out["description"] = out["description"] or out["open_graph"].get("description", "")
    return out


def _rows(table: Node) -> list[Node]:
    """Rows of this table, not of tables inside it."""
    return [r for r in table.elements("tr") if next((a for a in r.ancestors() if a.tag == "table"), None) is table]


def _markup_size(cell: Node) -> int:
    """Bytes of a cell's content with its tags and attributes, no sign escaped."""
    tags = [n for n in cell.walk() if n.tag and n is not cell]
    return sum(len(n.data.encode()) for n in cell.walk() if not n.tag) + sum(5 + 2 * len(n.tag) + sum(4 + len(f"{k}{v}".encode()) for k, v in n.attrs.items()) for n in tags)


def tables(doc: Node) -> list[dict]:
    """[{headers, rows, caption, score, is_data_table}] of the outermost tables."""
    out = []
    for t in doc.elements("table"):
        if any(a.tag == "table" for a in t.ancestors()):
            continue
        parsed = [(r, [c for c in r.children if c.tag in ("td", "th")]) for r in _rows(t)]
        parsed = [(r, cells) for r, cells in parsed if cells]
        caption = next((c.text() for c in t.children if c.tag == "caption"), "")
        has_th = any(c.tag == "th" for _, cells in parsed for c in cells)
        headers: list[str] = []
        rows: list[list[str]] = []
        for k, (_, cells) in enumerate(parsed):
            values = [c.text() for c in cells]
            if not headers and (any(c.tag == "th" for c in cells) if has_th else k == 0):
                headers = values
            else:
                rows.append(values)
        nested = any(n.tag == "table" for c in t.children for n in c.walk())
        widths = [len(r) for r in rows]
        ref = len(headers) or max(set(widths), key=widths.count, default=0)
        steady = bool(widths) and sum(w == ref for w in widths) >= 0.8 * len(widths)
        cells = [c for _, cs in parsed for c in cs]
        inner = sum(_markup_size(c) for c in cells)
        dense = not inner or sum(len(c.text().encode()) for c in cells) / inner > 0.7
        score = 0.3 * has_th + 0.2 * bool(caption) + 0.3 * steady + 0.1 * (len(rows) > 1) + 0.1 * (not nested) + 0.1 * dense
        out.append({"headers": headers, "rows": rows, "caption": caption, "score": round(score, 6), "is_data_table": score >= 0.5 - 1e-9})
    return out


def _size(v: str) -> int:
    m = re.match(r"\s*(\d+)", v or "")
    return int(m[1]) if m else 0


def images(doc: Node, base: str) -> list[dict]:
    """[{url, alt, width, height, source_tag, score}], the best first; background and preview images included."""
    out, seen = [], set()

    def put(url: str, tag: str, n: Node, score: float) -> None:
        url = absolute(base, url.strip())
        if url and url not in seen:
            seen.add(url)
            out.append({"url": url, "alt": n.attrs.get("alt", ""), "width": n.attrs.get("width", ""), "height": n.attrs.get("height", ""), "source_tag": tag, "score": round(score, 6)})

    for n in doc.walk():
        if n.tag == "img":
            src = n.attrs.get("src") or n.attrs.get("data-src") or ""
            if src and not src.startswith("data:"):
                tags = {a.tag for a in n.ancestors()}
                main = bool(tags & {"article", "main"}) or any("content" in a.attrs.get("class", "").lower() for a in n.ancestors())
                marks = (src + " " + n.attrs.get("class", "")).lower()
                put(src, "img", n, 0.2 * (bool(n.attrs.get("alt", "").strip()) + (max(_size(n.attrs.get("width", "")), _size(n.attrs.get("height", ""))) >= 200) + (not tags & {"nav", "footer", "header", "aside"}) + (not any(i in marks for i in ICONS)) + main))
        elif n.tag == "source" and n.parent is not None and n.parent.tag == "picture" and n.attrs.get("srcset"):
            put(n.attrs["srcset"].split(",")[0].split()[0], "picture", n, 0.5)
        elif n.tag == "meta" and n.attrs.get("property") == "og:image" and n.attrs.get("content"):
            put(n.attrs["content"], "og:image", n, 0.6)
        m = re.search(r"background(?:-image)?\s*:[^;]*url\(\s*['\"]?([^'\")]+)", n.attrs.get("style", "")) if n.attrs else None
        if m:
            put(m[1], "background", n, 0.3)
    return sorted(out, key=lambda x: -x["score"])


def structure(doc: Node) -> dict:
    count = lambda *t: sum(1 for _ in doc.elements(*t))
    heads = {h: [n.text() for n in doc.elements(h)] for h in ("h1", "h2", "h3")}
    return heads | {"forms": count("form"), "links": count("a"), "images": count("img"), "scripts": count("script"), "styles": count("style"), "iframes": count("iframe"), "navs": count("nav")} | {f"has_{t}": count(t) > 0 for t in ("main", "article", "aside", "header", "footer")}


def prune(doc: Node, threshold: float = 0.48) -> str:
    """HTML of the body without boilerplate: from the top down, elements that score below their threshold go.

    Sizes of markup, text and link text are summed once from the leaves up; what is dropped inside an element later
    doesn't change its own score.
    """
    body = doc.first("body") or doc
    sizes: dict[int, tuple[int, str, int]] = {}

    def measure(n: Node) -> tuple[int, str, int]:
        """(bytes of markup, text, bytes of link text)."""
        if not n.tag:
            return len(n.html().encode()), n.data, 0
        parts = [measure(c) for c in n.children]
        shell = Node(n.tag, n.attrs)
        text = "".join(p[1] for p in parts)
        linked = sum(p[2] for p in parts) + (len(text.strip().encode()) if n.tag == "a" else 0)
        sizes[id(n)] = len(shell.html().encode()) + sum(p[0] for p in parts), text, linked
        return sizes[id(n)]

    measure(body)

    def score(n: Node) -> tuple[float, float]:
        """(score, threshold) of an element; -1 if it is empty."""
        size, raw, linked = sizes[id(n)]
        t = raw.strip()
        if not t:
            return -1.0, threshold
        text = len(t.encode())
        density, link = text / size if size else 0.0, linked / text
        weight = TAG_WEIGHT.get(n.tag, 0.5)
        marks = n.attrs.get("class", "") + " " + n.attrs.get("id", "")
        s = 0.4 * density + 0.2 * (1 - link) + 0.2 * weight + 0.1 * (0.2 if NEGATIVE.search(marks) else 1.0) + 0.1 * min(1.0, math.log(text + 1) / 10)
        limit = threshold * (0.8 if weight > 1 else 1.0) * (0.9 if density > 0.4 else 1.0) * (1.2 if link > 0.6 else 1.0)
        return s, limit

    def keep(n: Node) -> None:
        for c in list(n.children):
            if not c.tag:
                continue
            s, limit = score(c) if c.tag not in DROPPED else (-1.0, 0.0)
            if s < limit:
                n.children.remove(c)
            else:
                keep(c)

    keep(body)
    return "".join(c.html() for c in body.children).strip()


def markdown(doc: Node, base: str = "", inline_links: bool = False) -> str:
    """Markdown of the body, links as numbered references at the end, or where they stand if inline_links."""
    refs: list[str] = []

    def inline(n: Node) -> str:
        if not n.tag:
            return re.sub(r"\s+", " ", n.data)
        inner = "".join(inline(c) for c in n.children)
        if n.tag == "br":
            return "\n"
        if n.tag == "a" and n.attrs.get("href") and inner.strip():
            url = absolute(base, n.attrs["href"])
            if inline_links:
                return f"[{inner.strip()}]({url})"
            if url not in refs:
                refs.append(url)
            return f"{inner} [{refs.index(url) + 1}]"
        if n.tag in ("strong", "b") and inner.strip():
            return f"**{inner.strip()}**"
        if n.tag in ("em", "i") and inner.strip():
            return f"*{inner.strip()}*"
        if n.tag == "code" and inner.strip():
            return f"`{inner.strip()}`"
        if n.tag == "img":
            return f"![{n.attrs.get('alt', '')}]({absolute(base, n.attrs.get('src', ''))})"
        return "" if n.tag in ("script", "style", "noscript", "head") else inner

    out: list[str] = []

    def block(n: Node, prefix: str = "") -> None:
        run: list[str] = []

        def end() -> None:
            t = re.sub(r" *\n *", "\n", "".join(run)).strip()
            run.clear()
            if t:
                out.append("\n".join(prefix + x for x in t.split("\n")))

        for k, c in enumerate(n.children):
            if c.tag in ("script", "style", "noscript", "head"):
                continue
            if c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                end()
                out.append(f"{prefix}{'#' * int(c.tag[1])} {''.join(inline(x) for x in c.children).strip()}")
            elif c.tag in ("ul", "ol"):
                end()
                items = [x for x in c.children if x.tag == "li"]
                out.append("\n".join(f"{prefix}{'-' if c.tag == 'ul' else f'{i + 1}.'} {''.join(inline(y) for y in x.children).strip()}" for i, x in enumerate(items)))
            elif c.tag == "pre":
                end()
                out.append(f"```\n{c.raw_text().strip(chr(10))}\n```")
            elif c.tag == "blockquote":
                end()
                block(c, prefix + "> ")
            elif c.tag == "hr":
                end()
                out.append("---")
            elif c.tag == "table":
                end()
                rows = [[x.text() for x in r.children if x.tag in ("td", "th")] for r in _rows(c)]
                if rows:
                    out.append("\n".join(["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:])]))
            elif c.tag in ("p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "body", "html", "form", "figure", "center", "dl", "td"):
                end()
                block(c, prefix)
            else:
                run.append(inline(c))
            if k + 1 == len(n.children):
                end()

    block(doc.first("body") or doc)
    text = "\n\n".join(x for x in out if x.strip())
    return text + ("\n\n## References\n\n" + "\n".join(f"[{i + 1}]: {u}" for i, u in enumerate(refs)) if refs else "")


def records(doc: Node, schema: dict, how: str = "css") -> list[dict]:
    """One record for each match of schema['base']; fields are {name, selector, type, attribute, fields}.

    Types: text, attribute, html, list (texts of all matches), nested (a record), nested_list. What is missing is
    '', [], or {}. how: css or xpath.
    """
    select = css if how == "css" else xpath

    def value(n: Node, f: dict):  # noqa: ANN202
        found = select(n, f["selector"]) if f.get("selector") else [n]
        kind = f.get("type", "text")
        if kind == "list":
            return [x.text() for x in found]
        if kind == "nested_list":
            return [{g["name"]: value(x, g) for g in f["fields"]} for x in found]
        if not found:
            return {} if kind == "nested" else ""
        if kind == "nested":
            return {g["name"]: value(found[0], g) for g in f["fields"]}
        if kind == "attribute":
            return found[0].attrs.get(f["attribute"], "")
        return found[0].html() if kind == "html" else found[0].text()

    return [{f["name"]: value(n, f) for f in schema["fields"]} for n in select(doc, schema["base"])]


def page(html: str | None, base: str | None) -> dict:
    """Everything that one parse of a page yields."""
    doc = parse(html or "")
    out = {"links": links(doc, base or ""), "metadata": metadata(doc), "tables": tables(doc), "images": images(doc, base or ""), "structure": structure(doc), "markdown": markdown(doc, base or "")}
    return out | {"text": (doc.first("body") or doc).text(), "fit_html": prune(doc)}
