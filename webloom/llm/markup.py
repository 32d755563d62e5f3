"""Markup residue in text documents (problem 6).

A field is cut into flat text blocks (its lines, long lines at sentence ends). Each block is described by how often
bare signs stand in it and in what shape (angle brackets before a name, an element or a digit, dollars before digits
or in pairs, backslashes before braces or in paths, and so on), by its word count and link density and by those of
its neighbours. No sign is proof: one decision tree a kind of markup, trained on a small labelled table written here
in which look-alikes (prices, paths, template fields, generic types, sums, comparison signs) carry the same signs,
tells what is markup. Affected fields can be turned into clean text that keeps headings, lists, code and formulas.
"""

from __future__ import annotations

import bisect
import html as html_lib
import html.entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import residue
from webloom.llm.blocks import LINK, classifier, label_pages, parse_markdown
from webloom.llm.notices import notices
from webloom.llm.residue import CODE_SPAN, SLOT
from webloom.llm.tree import Tree
from webloom.session import materialize

KINDS = ("html", "latex", "markdown", "wiki")
#: Names of HTML elements.
ELEMENTS = "a abbr address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr"
_TAG = re.compile(r"<(?:/(?:" + ELEMENTS.replace(" ", "|") + r")\s*|(?:" + ELEMENTS.replace(" ", "|") + r")(?:\s[^<>\n]*?)?/?|!--[^\n]{0,200}?--)>", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")
#: Bare signs and their shapes, counted in each block; a shape includes look-alikes of the markup that it also serves.
SIGNS: dict[str, re.Pattern] = {
    "angle name": re.compile(r"</?[a-zA-Z][\w-]*"),
    "angle element": re.compile(r"</?(?:" + ELEMENTS.replace(" ", "|") + r")(?=[\s/>]|$)", re.I),
    "angle closed": re.compile(r"</?[a-zA-Z][^<>\n]*>"),
    "angle alone": re.compile(r"<(?![a-zA-Z/!])"),
    "angle after letter": re.compile(r"\w<[A-Za-z]"),
    "angle ref": re.compile(r"<ref[ >/]|</ref>", re.I),
    "comment": re.compile(r"<!--[^\n]{0,200}?-->"),
    "amp closed": re.compile(r"&#?\w{1,32};"),
    "amp known": _ENTITY,
    "amp alone": re.compile(r"&(?!#?\w{1,32};)"),
    "backslash name": re.compile(r"\\[a-zA-Z]+"),
    "backslash brace": re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{"),
    "backslash bracket": re.compile(r"\\[()\[\]]"),
    "backslash pair": re.compile(r"\\\([^\n]{1,200}?\\\)|\\\[[^\n]{1,400}?\\\]"),
    "backslash path": re.compile(r"\b[A-Za-z]:\\|\\\\\w|\w\\\w+\\"),
    "dollar": re.compile(r"\$"),
    "dollar digit": re.compile(r"\$\d"),
    "dollar pair": re.compile(r"(?<![\\\w$])\$(?=[^\s$])[^$\n]*\$"),
    "dollar formula": re.compile(r"(?<![\\\w$])\$(?=[^$\n]*(?:\\[a-zA-Z]|[\^_][\w{]))[^$\s][^$\n]*\$"),
    "stars": re.compile(r"\*\*"),
    "stars pair": re.compile(r"\*\*(?=\S)[^*\n]+?(?<=\S)\*\*"),
    "star": re.compile(r"(?<!\*)\*(?!\*)"),
    "tildes pair": re.compile(r"~~(?=\S)[^~\n]+~~"),
    "lines": re.compile(r"__"),
    "lines pair": re.compile(r"(?<![\w_])__(?=[a-z0-9])[^_\n]+ [^_\n]*__(?![\w_])"),
    "hash": re.compile(r"#"),
    "hash heading": re.compile(r"(?:^|(?<=\s))#{1,6} (?=\w)"),
    "tick": re.compile(r"`"),
    "tick pair": re.compile(r"(?<!`)`(?=[^`\s])[^`\n]*`(?!`)|```"),
    "square": re.compile(r"\[[^\[\]\n]*\]"),
    "square round": re.compile(r"\]\("),
    "square link": re.compile(r"!?\[[^\[\]\n]*\]\((?:https?:|/|\.|#|mailto:|www\.)[^()\s]*"),
    "square address": re.compile(r"(?<!\[)\[https?://[^\s\]]+ [^\]\n]+\](?!\()"),
    "squares": re.compile(r"\[\[[^\[\]\n]+\]\]"),
    "squares other": re.compile(r"\[\[(?![A-Z][A-Z0-9_.]+\]\])[^\[\]\n]+\]\]"),
    "squares capital": re.compile(r"\[\[[A-Z][A-Z0-9_.]+\]\]"),
    "curlies": re.compile(r"\{\{"),
    "curlies bar": re.compile(r"\{\{[^{}|\n]+\|[^{}\n]*\}\}"),
    "curly table": re.compile(r"\{\|[^\n]*|^\|-"),
    "bar rule": re.compile(r"\|\s?:?-{3,}:?\s?\|"),
    "apostrophes": re.compile(r"''"),
    "apostrophes pair": re.compile(r"(?<!')('{2,3}|'{5})(?=[^'\s])[^\n]*?[^'\s]\1(?!')"),
    "equals": re.compile(r"=="),
    "equals pair": re.compile(r"(?:^|(?<=\s))(={2,6}) [^=\n]+ \1(?=\s|$)"),
    "greater": re.compile(r">"),
    "greater quote": re.compile(r"(?:^|(?<=\s))> (?=[^\W\d_]+\s+[^\W_])"),
}
NAMES = tuple(SIGNS)
#: Characters without at least one of which a text holds no markup.
HINT = re.compile(r"[<&\\$*#`>|\[{'=~]|__")
CUT = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_])")
LONG = 400
#: Signs that go over a line end, which SIGNS leaves out, by name; a formula ends at an empty line.
_WIDE_TAG = re.compile(r"<(?:" + ELEMENTS.replace(" ", "|") + r")(?=\s[^<>]*>)(?=[^<>]*\n)[^<>]*>", re.I)
_WIDE_TEMPLATE = re.compile(r"\{\{(?=[^{}]*\n)[^{}|]+\|[^{}]*\}\}")
_WIDE_MATH = re.compile(r"(?<![\\\w$])(\$\$?)(?=[^$]*\\[a-zA-Z])(?=[^$\n]*\n)(?:[^$\n]|\n(?![ \t]*\n))+\1(?!\$)")
#: Signs of one line inside which it isn't cut.
_WHOLE = re.compile(r"\{\{[^{}\n]*\}\}|\[\[[^\[\]\n]*\]\]|\[https?://[^\]\n]*\]|'{2,5}[^'\n]+'{2,5}|<[^<>\n]*>|\*\*[^*\n]+\*\*|~~[^~\n]+~~|\$(?=[^$\n]*\\[a-zA-Z])[^$\n]*\$")


def enclosed(text: str, start: str, end: str, over: bool) -> list[tuple[int, int]]:
    """Spans from each start sign to the next end sign, in one scan; not over empty lines unless `over`."""
    out, i = [], text.find(start)
    while i >= 0:
        j = text.find(end, i + len(start))
        if j < 0:
            break
        if not over:
            i = text.rfind(start, i, j)  # the last start sign before the end
        if over or not re.search(r"\n[ \t]*\n", text[i:j]):
            out.append((i, j + len(end)))
        i = text.find(start, j + len(end))
    return out


def wide_signs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of the signs that go over a line end or are longer than SIGNS takes."""
    out = [(a, b, "comment") for a, b in enclosed(text, "<!--", "-->", True) if b - a > 207 or "\n" in text[a:b]]
    for start, end, longest in (("\\(", "\\)", 204), ("\\[", "\\]", 404)):
        out += [(a, b, "backslash pair") for a, b in enclosed(text, start, end, False) if b - a > longest or "\n" in text[a:b]]
    if "\n" in text:
        for name, pattern, sign in (("angle closed", _WIDE_TAG, "<"), ("curlies bar", _WIDE_TEMPLATE, "{{"), ("dollar formula", _WIDE_MATH, "$")):
            if sign in text:
                out += [(*m.span(), name) for m in pattern.finditer(text)]
    return out


def placed_blocks(text: str, wide: list[tuple[int, int, str]]) -> list[tuple[int, str]]:
    """(place, block): lines with more than white space; long ones are cut at sentence ends outside of signs."""
    out, at = [], 0
    for line in text.split("\n"):
        if line and not line.isspace():
            if len(line) <= LONG:
                out.append((at, line))
            else:
                inside = sorted([m.span() for m in _WHOLE.finditer(line)] + [(a - at, b - at) for a, b, _ in wide if a < at + len(line) and b > at])
                start = k = reach = 0
                for m in CUT.finditer(line):
                    while k < len(inside) and inside[k][0] < m.end():
                        reach = max(reach, inside[k][1])
                        k += 1
                    if m.start() - start >= LONG // 2 and reach <= m.start():
                        out.append((at + start, line[start : m.start()]))
                        start = m.end()
                out.append((at + start, line[start:]))
        at += len(line) + 1
    return out


def text_features(text: str) -> np.ndarray:
    """Features of a text's blocks; a sign that no block holds whole counts for the one it begins in."""
    wide = wide_signs(text)
    placed = placed_blocks(text, wide)
    x = features([b for _, b in placed])
    starts = [a for a, _ in placed]
    for a, _, name in wide:
        k, j = max(0, bisect.bisect_right(starts, a) - 1), NAMES.index(name)
        x[k, j] = min(x[k, j] + 1, 9)
    return x


def features(blocks: list[str]) -> np.ndarray:
    """A row a block: signs of each kind, words and link density, and these two of the blocks before and after."""
    n, k = len(blocks), len(NAMES)
    x = np.zeros((n, k + 6))
    for i, b in enumerate(blocks):
        if HINT.search(b):
            for j, name in enumerate(NAMES):
                found = SIGNS[name].findall(b)
                if name == "amp known":
                    found = [e for e in found if e[1] == "#" or e[1:] in html.entities.html5]
                x[i, j] = min(len(found), 9)
        words = len(b.split())
        x[i, k], x[i, k + 1] = min(words, 90), sum(len(t.split()) for t in LINK.findall(b)) / max(1, words) if "](" in b else 0
    if n > 1:
        x[1:, k + 2 : k + 4], x[:-1, k + 4 : k + 6] = x[:-1, k : k + 2], x[1:, k : k + 2]
    return x


_WORDS = "the garden near old bridge was open again after long winter many visitors came from valley school house river paper market teacher evening une maison der alte fluss el camino".split()


def training_blocks(rows: int = 6000, seed: int = 5) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Features and, by kind, labels of the small labelled table; `rows` bounds it."""
    rng = random.Random(seed)
    some = lambda a, b: " ".join(rng.choice(_WORDS) for _ in range(rng.randint(a, b)))
    w = lambda: rng.choice(_WORDS)
    num = lambda: rng.randint(2, 900)
    cap = lambda: w().capitalize()
    make = {
        "html": [lambda: f"<p>{some(2, 6)}", lambda: f"{w()}<br>", lambda: f'<span class="x{num()}">{some(1, 5)}</span>', lambda: f"{w()}&nbsp;{w()}", lambda: f"{w()} &amp; {w()}", lambda: f"{w()}&#8217;s", lambda: f'<a href="/{w()}">{w()}</a>', lambda: f"<sup>{num()}</sup>", lambda: f"&copy; {w()}", lambda: f"<b>{w()}</b> {num()}", lambda: f"{w()}<!-- {w()} -->", lambda: f"{w()} <div\n", lambda: f"&lt;{w()}&gt;", lambda: f"<li>{w()}", lambda: f"</td><td>{w()}"],
        "latex": [lambda: f"\\emph{{{w()}}}", lambda: f"\\section{{{some(1, 3)}}}", lambda: f"~\\cite{{{w()}{num()}}}", lambda: f"$\\frac{{{num()}}}{{{num()}}}$", lambda: f"\\(a^{{{num()}}} \\leq b_n\\)", lambda: "\\begin{equation} y_i = \\alpha x_i \\end{equation}", lambda: f"$x_{{{num()}}}$", lambda: f"\\footnote{{{w()}}}", lambda: f"$a_{w()[0]} + b^{num()}$", lambda: f"\\[ {w()[0]} = {num()} \\]", lambda: f"\\( {w()[0]} + {w()[0]} = {num()} \\)", lambda: f"\\begin{{itemize}} \\item {w()}"],
        "markdown": [lambda: f"**{some(1, 2)}**", lambda: f"[{some(1, 2)}](https://x.example/{num()})", lambda: f"## {some(2, 4)}", lambda: f"`{w()}`", lambda: f"~~{w()}~~", lambda: f"![{w()}](/img/{num()}.png)", lambda: f"> {some(4, 8)}", lambda: f"__{w()} {w()}__", lambda: "| --- | --- |", lambda: f"# {cap()} {w()}", lambda: f"```{w()}"],
        "wiki": [lambda: f"[[{w()}]]", lambda: f"[[{w()}|{some(1, 2)}]]", lambda: f"'''{w()}'''", lambda: f"== {some(1, 3)} ==", lambda: f"{{{{cite|{w()}|year={num()}}}}}", lambda: f"[[Category:{w()}]]", lambda: f"''{w()}'' [http://x.example {w()}]", lambda: f"[http://x.example/{num()} {w()}]", lambda: f"<ref>{w()}</ref>", lambda: f"''{some(1, 3)}''", lambda: '{| class="wikitable"', lambda: f"{{{{{cap()} {w()}|{num()}}}}}", lambda: f"[[{cap()} {w()}]]"],
        # look-alikes with the same signs
        "": [
            lambda: f"from ${num()} to ${num()}", lambda: f"${num()}.{num()}, not ${num()}", lambda: f"{num()} < {num()} crates", lambda: f"x > 0.{num()} & y < {num()}", lambda: f"C:\\{w()}\\{w()}", lambda: f"D:\\{w()}", lambda: f"\\\\{w()}\\{w()}", lambda: f"my_{w()}_{w()}", lambda: f"{{{{ {w()} }}}}", lambda: f"{{{{{w()}.{w()}}}}}", lambda: f"[[{w().upper()}]] {{{{ {w()} }}}} [[{w().upper()}_{w().upper()}]]", lambda: f"#{num()}", lambda: f"{num()} * {num()} = {num()}", lambda: f"[{w()}]", lambda: f"{w()}/{w()}", lambda: f"%%{w().upper()}%%", lambda: f"[[{w().upper()}]]", lambda: f"[[{w().upper()}.{w().upper()}]]", lambda: f"<<{w()}>>", lambda: f"${{{w()}}}", lambda: f"#{{{w()}.{w()}}}", lambda: f"{w()} - {w()}", lambda: f"it’s '{w()}' {w()}", lambda: f"a*b and c_d, {w()} = {num()}",
            lambda: f"List<{cap()}>", lambda: f"Map<{cap()}, {cap()}>", lambda: f"<{w()}@x.example>", lambda: f"<{w()}_{w()}>", lambda: f"<% {w()} %>", lambda: f"a <- {num()}", lambda: f"{cap()}&{cap()};", lambda: f"{cap()[0]}&{cap()[0]}", lambda: f"{w()} & {w()};", lambda: f"\\{w()}", lambda: f"{num()}**{num()}", lambda: f"{w()} ** {w()}", lambda: f"__{w()}__", lambda: f"__{w().upper()}__", lambda: f"{w()}__{w()}", lambda: f"C# {num()}", lambda: f"{w()} #{w()}", lambda: f"[{num()}] ({w()})", lambda: f"[{w()}]({w()})", lambda: f"{num()}''", lambda: f"{num()}'{num()}''", lambda: f"'' {w()}", lambda: f"{w()} == {num()}", lambda: "=====", lambda: f"-> {w()}", lambda: f"{w()} > {num()}", lambda: f"|{w()}| = {num()}", lambda: f"it`s {w()}", lambda: f"@@{w()}@@", lambda: f"{{% {w()} %}}", lambda: f"US${num()} or ${num()}m",
            lambda: f"[Your {w()} here]", lambda: f"\\( {w()}", lambda: f"{w()} \\)", lambda: f"{num()} <!-- {w()}", lambda: f"* {w()}", lambda: f"\\n and \\t", lambda: f"~{num()}",
        ],
    }
    blocks, kinds = [], []
    for _ in range(rows):
        has = set(rng.sample(KINDS, rng.choice([1, 1, 1, 1, 2, 3]))) if rng.random() < 0.55 else set()
        parts = [make[k][rng.randrange(len(make[k]))]() for k in sorted(has) for _ in range(rng.randint(1, 2))]
        parts += [rng.choice(make[""])() for _ in range(rng.choice([0, 1, 1, 2, 3, 5]))]
        rng.shuffle(parts)
        text = some(0, 12)
        for p in parts:
            text = f"{text} {p} {some(0, 10)}" if not p.startswith(("## ", "> ")) else f"{text} {p}"
        blocks.append(text.strip())
        kinds.append(has)
    return features(blocks), {k: np.array([k in h for h in kinds], float) for k in KINDS}


@lru_cache(1)
def trees(rows: int = 6000) -> dict[str, Tree]:
    x, y = training_blocks(rows)
    return {k: Tree(depth=14, leaf=2).fit(x, y[k]) for k in KINDS}


def kinds_of(texts: list[str], forest: dict[str, Tree], allowed: tuple[str, ...] = KINDS) -> list[set[str]]:
    """Kinds of markup in each text."""
    owner, blocks, out = [], [], [set() for _ in texts]
    for k, t in enumerate(texts):
        if t and HINT.search(t):
            own = text_features(t)
            blocks.append(own)
            owner += [k] * len(own)
    if owner:
        x, own = np.vstack(blocks), np.array(owner)
        for kind in allowed:
            for k in np.unique(own[forest[kind].predict(x) >= 0.5]).tolist():
                out[k].add(kind)
    return out


def without_code(markdown: str) -> str:
    """Markdown without its fenced and inline code, and without its own link targets."""
    text = "\n".join(x.text for x in parse_markdown(markdown) if x.kind not in ("code", "fence")) if "```" in markdown or "~~~" in markdown else markdown
    return LINK.sub(r"\1", CODE_SPAN.sub(" ", text))


def clean(text: str, kinds: set[str]) -> str:
    """Text without markup of these kinds; headings, lists, code and formulas stay, as Markdown writes them."""
    if "latex" in kinds:
        text = re.sub(r"\\(?:sub)*section\*?\{([^{}\n]*)\}", r"\n## \1\n", text)
        text = re.sub(r"\\begin\{(equation|align|displaymath)\*?\}(.*?)\\end\{\1\*?\}", lambda m: f"$${m[2].strip()}$$", text, flags=re.S)
        text = re.sub(r"\\item\s*", "\n* ", re.sub(r"\\(?:begin|end)\{(?:itemize|enumerate|document|center|quote)\}", "\n", text))
        text = re.sub(r"~?\\(?:cite|ref|label|footnote|pageref|index)\w*\{[^{}\n]*\}", "", text)
        keep = re.compile(r"\$\$.*?\$\$|\$[^$\n]+\$|\\\(.*?\\\)|\\\[.*?\\\]", re.S)
        out, at = [], 0
        for m in keep.finditer(text):
            out += [re.sub(r"\\[a-zA-Z]+\{([^{}\n]*)\}", r"\1", text[at : m.start()]), m[0]]
            at = m.end()
        text = "".join([*out, re.sub(r"\\[a-zA-Z]+\{([^{}\n]*)\}", r"\1", text[at:])])
    if "html" in kinds:
        text = re.sub(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ", text, flags=re.S | re.I)
        text = re.sub(r"<h([1-6])\b[^<>]*>(.*?)</h\1\s*>", lambda m: f"\n{'#' * int(m[1])} {m[2].strip()}\n", text, flags=re.S | re.I)
        text = re.sub(r"<li\b[^<>]*>\s*", "\n* ", re.sub(r"<pre\b[^<>]*>(.*?)</pre\s*>", r"\n```\n\1\n```\n", text, flags=re.S | re.I), flags=re.I)
        text = re.sub(r"<code\b[^<>]*>(.*?)</code\s*>", r"`\1`", text, flags=re.S | re.I)
        text = re.sub(r"</?(?:p|div|br|tr|ul|ol|table|blockquote|hr)\b[^<>]*>", "\n", text, flags=re.I)
        text = html_lib.unescape(_TAG.sub("", _WIDE_TAG.sub("", text))).replace("\xa0", " ")
    if "wiki" in kinds:
        text = re.sub(r"(?:^|(?<=\s))(={2,6}) ([^=\n]+) \1(?=\s|$)", lambda m: f"\n{'#' * len(m[1])} {m[2]}\n", text)
        text = re.sub(r"\[\[(?:Category|File|Image|Kategorie|Catégorie|Categoría):[^\[\]\n]*\]\]", "", text, flags=re.I)
        text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", text)
        text = re.sub(r"\{\{[^{}|]+\|[^{}]*\}\}", "", text)
        text = re.sub(r"\[https?://[^\s\]]+ ([^\]\n]+)\]", r"\1", text)
        text = re.sub(r"'{2,5}", "", text)
    if "markdown" in kinds:
        text = re.sub(r"!\[([^\[\]\n]*)\]\([^()\n]*\)", r"\1", text)
        text = LINK.sub(r"\1", text)
        text = re.sub(r"\*\*(?=\S)([^*\n]+?)\*\*|~~([^~\n]+)~~", lambda m: m[1] or m[2], text)
        text = re.sub(r"(?<=\S)\s+(#{1,6} (?=\w))", r"\n\1", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def find_in_plain_text(scraped: DataFrame, page_id: str = "page_id", text: str = "plain_text") -> DataFrame:
    """(page_id, field_name, markup, clean_text) of each plain text that holds markup, one row a kind.

    Null and empty texts hold none; repeated rows give repeated rows; other columns are ignored.
    """
    return _find(scraped.where(f"`{text}` is not null").select(page_id, text), page_id, "plain_text", KINDS)


def find_in_markdown(pages: DataFrame, page_id: str = "page_id", html: str = "html", markdown: str = "markdown") -> DataFrame:
    """The same for the main body of a page's markdown and the kinds foreign to it; code and residue pages are no cases."""
    forest, tree, model = trees(), classifier(), notices()
    allowed = ("html", "latex", "wiki")
    fields = (*residue.FIELDS, ("markup", pa.list_(pa.string())), ("clean_text", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                ids, htmls, texts = (part.column(k).to_pylist() for k in range(3))
                maybe = [k for k, (t, got) in enumerate(zip(texts, kinds_of([without_code(t) if t else "" for t in texts], forest, allowed), strict=True)) if got]
                all_lines = label_pages([(htmls[k], texts[k]) for k in maybe], tree)
                bodies = [LINK.sub(r"\1", CODE_SPAN.sub(" ", "\n".join(x.text for x in lines if x.main and x.kind not in ("code", "fence")))) for lines in all_lines]
                rows = []
                for k, lines, got in zip(maybe, all_lines, kinds_of(bodies, forest, allowed), strict=True):
                    if got:
                        rows.append((ids[k], *[None] * (len(residue.FIELDS) - 1), sorted(got), clean("\n".join(x.text for x in lines if x.main), got)))
                        rows += [(*r, None, None) for r in residue.page_rows(ids[k], lines, model)]
                cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    src = pages.where(f"`{markdown}` is not null").select(F.col(page_id).cast("long"), html, markdown)
    rows = materialize(src.mapInArrow(run, residue.SCHEMA + ", markup array<string>, clean_text string"), "markup")
    bad = residue.decide(rows.where("markup is null").select(*residue.NAMES))
    found = rows.where("markup is not null").join(bad, "row", "left_anti")
    return found.select(F.col("row").cast(pages.schema[page_id].dataType).alias(page_id), F.lit("markdown").alias("field_name"), F.explode("markup").alias("markup"), "clean_text")


def _find(df: DataFrame, page_id: str, field: str, allowed: tuple[str, ...]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    forest, id_type = trees(), to_arrow_type(df.schema[page_id].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = [(i, field, k, clean(t, got)) for i, t, got in zip(ids, texts, kinds_of([t or "" for t in texts], forest, allowed), strict=True) for k in sorted(got)]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (id_type, pa.string(), pa.string(), pa.string()), strict=True)], names=[page_id, "field_name", "markup", "clean_text"])

    return df.mapInArrow(run, f"`{page_id}` {df.schema[page_id].dataType.simpleString()}, field_name string, markup string, clean_text string")
