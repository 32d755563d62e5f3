"""Reading level of each document (problem 1).

The English running prose of a page's main body is cut into sentences and words; syllables are counted by
hyphenation patterns (see hyphens.py); the grade is the median of several classic readability formulas.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import residue, stuffing
from webloom.llm.blocks import LINK, Line, classifier, labelled
from webloom.llm.hyphens import syllables
from webloom.llm.language import scores
from webloom.llm.notices import notices
from webloom.session import materialize

#: Words of prose a page must have, and the grades below and above which it is easy and hard.
MIN_WORDS, EASY, HARD = 80, 6, 12
#: Grades by which each formula runs above Flesch-Kincaid on ordinary school prose.
BIAS = (0.0, 2.0, 1.5, 1.5, 0.7)
#: Share of English function words from which a paragraph is English (and more than of any other language).
ENGLISH = 0.15

#: Short forms whose dot ends no sentence.
SHORT = set("mr mrs ms dr prof st sr jr vs etc e.g i.e eg ie cf fig figs no nos vol pp p ed eds al approx dept est inc ltd co corp gen col capt lt sgt rev hon gov sen rep jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun ave blvd rd u.s u.k a.m p.m am pm ca sec min max art ch".split())
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
TOKEN = re.compile(r"\S*[^\W_]\S*")  # numbers are words of the text, though not of the formulas
TAG = re.compile(r"<[^<>\n]{1,200}>")
MARK = re.compile(r"(\*\*|__|~~|'''|'')|\{\{[^{}\n]*\}\}|\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]*)\]\]|!\[[^\]\n]*\]\([^)\n]*\)|\\(?:emph|textbf|textit|texttt|underline)\{([^{}\n]*)\}|\\(?:cite|ref|label|footnote)\w*\{[^{}\n]*\}|\$[^$\n]{1,80}\$|\\\(.{1,80}?\\\)|`[^`\n]*`")
BREAK = re.compile(r"([.!?…]+)([\"”’')\]]*)(\s+|$)")


def plain_text(text: str) -> str:
    """Running text without links' targets, emphasis, tags, entities and formulas."""
    if "](" in text:
        text = LINK.sub(r"\1", text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html_lib.unescape(html_lib.unescape(text))
    if any(c in text for c in "*_~{[\\$`'!"):
        text = MARK.sub(lambda m: m[2] or m[3] or "", text)
    return text


def sentences(text: str) -> list[str]:
    """Sentences; a dot in a number or after a short form or initial ends none, nor one followed by a small letter."""
    out, start = [], 0
    for m in BREAK.finditer(text):
        if m[1] == ".":
            before = text[start : m.start()].rsplit(None, 1)
            last = before[-1].strip("(\"“‘[").lower() if before else ""
            after = text[m.end() : m.end() + 1]
            if after and (last in SHORT or (len(last) == 1 and last.isalpha() and last != "i") or "." in last and last.replace(".", "").isalpha()):
                if last in ("etc", "a.m", "p.m", "u.s", "u.k", "am", "pm") and after.isupper():
                    pass
                else:
                    continue
            if after.islower():
                continue
        elif m[1] in ("…", "...") and text[m.end() : m.end() + 1].islower():
            continue
        part = text[start : m.end()].strip()
        if part:
            out.append(part)
        start = m.end()
    rest = text[start:].strip()
    if rest:
        out.append(rest)
    return out


def grades(text_words: int, n_sentences: int, letters: int, syl: int, poly: int) -> list[float]:
    """School grades by Flesch-Kincaid, Gunning fog, SMOG, Coleman-Liau and the automated readability index.

    The last four run higher than the first on ordinary school prose; BIAS brings them on its scale.
    """
    w, s = max(1, text_words), max(1, n_sentences)
    raw = (
        0.39 * w / s + 11.8 * syl / w - 15.59,
        0.4 * (w / s + 100 * poly / w),
        1.043 * math.sqrt(30 * poly / s) + 3.1291,
        5.88 * letters / w - 29.6 * s / w - 15.8,
        4.71 * letters / w + 0.5 * w / s - 21.43,
    )
    return [g - b for g, b in zip(raw, BIAS, strict=True)]


def prose(lines: list[Line]) -> list[str]:
    """English paragraphs of the main body, without title, author lines, headings, lists, tables, quotes and code."""
    title = next((k for k, x in enumerate(lines) if x.level == 1), None)
    out = []
    for k, line in enumerate(lines):
        if not line.main or line.kind != "plain" or (line.block is not None and line.block.tag in (8, 4, 5, 6, 7) and title is not None and k > title):
            continue
        text = plain_text(line.text)
        if line.words < 25 and not BREAK.search(text):
            continue
        hits, n = scores(text)
        if n and hits["en"] >= ENGLISH * n and hits["en"] == max(hits.values()):
            out.append(text)
    return out


def measure(paragraphs: list[str]) -> tuple[int, float]:
    """(words, grade)."""
    n = s = letters = syl = poly = 0
    for p in paragraphs:
        for sent in sentences(p):
            words = WORD.findall(sent)
            if not words:
                continue
            s += 1
            n += len(words)
            for w in words:
                k = syllables(w)
                letters += len(w)
                syl += k
                # names are no hard words
                poly += k >= 3 and not (w[0].isupper() and w is not words[0])
    return n, median(grades(n, s, letters, syl, poly))


def band(grade: float) -> str:
    """School grades are whole numbers: easy is below EASY, hard beyond HARD, after rounding."""
    return "easy" if round(grade) < EASY else "middle" if round(grade) <= HARD else "hard"


def page_reading(lines: list[Line]) -> tuple[int, float] | None:
    """(words, grade) of a page with enough English prose, else None."""
    paragraphs = prose(lines)
    n = sum(len(TOKEN.findall(p)) for p in paragraphs)
    if n < MIN_WORDS:
        return None
    return n, measure(paragraphs)[1]


def reading_levels(pages: DataFrame, page_id: str = "page_id", html: str = "html", markdown: str = "markdown") -> DataFrame:
    """(page_id, words, grade, band) of each page with at least MIN_WORDS words of English prose in its main body.

    Null markdown, and bodies without enough English, have no row; null html leaves the markdown's own features;
    repeated rows give repeated rows; empty tables give an empty result; other columns are ignored.
    """
    rows = _one_pass(pages, page_id, html, markdown, spam=False)
    return rows.where("kind = 'r'").select(F.col("row").cast(pages.schema[page_id].dataType).alias(page_id), F.col("words"), "grade", "band")


FIELDS = (*residue.FIELDS, *stuffing.FIELDS[1:], ("kind", pa.string()), ("grade", pa.float64()), ("band", pa.string()))


def _one_pass(pages: DataFrame, page_id: str, html: str, markdown: str, spam: bool) -> DataFrame:
    """Reading rows ('r') and, if spam, the rows by which residue ('m') and stuffing ('b') decide, from one parse of each page."""
    tree, model = classifier(), notices()
    n_m, n_b = len(residue.FIELDS), len(stuffing.FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, all_lines in labelled(batches, tree):
            rows = []
            for i, lines in zip(b.column(0).to_pylist(), all_lines, strict=True):
                got = page_reading(lines)
                if got:
                    rows.append((i, *[None] * (n_m + 1), got[0], *[None] * (n_b - 4), "r", got[1], band(got[1])))
                    if spam:
                        rows += [(*x, *[None] * (n_b - 1), "m", None, None) for x in residue.page_rows(i, lines, model)]
                if spam:
                    rows += [(x[0], *[None] * (n_m - 1), *x[1:], "b", None, None) for x in stuffing.page_rows(i, lines)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, FIELDS, strict=True)], names=[n for n, _ in FIELDS])

    schema = f"{residue.SCHEMA}, {stuffing.SCHEMA.split(', ', 1)[1]}, kind string, grade double, band string"
    src = pages.where(f"`{markdown}` is not null").select(F.col(page_id).cast("long").alias("row"), html, markdown)
    return src.mapInArrow(run, schema)


def find_bands(pages: DataFrame, page_id: str = "page_id", html: str = "html", markdown: str = "markdown") -> DataFrame:
    """(page_id, band) as reading_levels, without the cases of template residue and keyword stuffing. Same edge cases."""
    rows = materialize(_one_pass(pages, page_id, html, markdown, spam=True), "profile")
    bad = residue.decide(rows.where("kind = 'm'").select(*residue.NAMES))
    bad = bad.unionByName(stuffing.decide(rows.where("kind = 'b'").select(*[n for n, _ in stuffing.FIELDS])).select("row"))
    levels = rows.where("kind = 'r'").select("row", "band").distinct()
    return levels.join(bad, "row", "left_anti").select(F.col("row").cast(pages.schema[page_id].dataType).alias(page_id), "band")
