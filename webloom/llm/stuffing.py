"""Keyword-stuffed and link-list pages (problem 7).

The main body is cut into blocks (paragraphs, runs of list items). Each block is compressed, one byte a character
so that scripts compare, and its ratio is held against what blocks of its language and length have over the whole
corpus. A block that is extremely redundant, or more redundant than usual and confirmed by next to no sentence
punctuation, counts as stuffed, as does one made of links; a page is spam if stuffed blocks are the greater part of
its main body.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.blocks import LINK, Line, classifier, labelled
from webloom.llm.language import FUNCTION_WORDS, guess
from webloom.session import materialize

#: A body of fewer words is too short to judge. Redundancy that alone is proof (phrases that each end with a mark),
#: redundancy that is proof where sentences are missing (both as ratio to the usual one), sentence ends a word below
#: which they are missing, and between which a block counts as prose when the usual ratio is taken.
MIN_WORDS, EXTREME, HIGH, FEW_ENDS, LINKED, SHARE = 25, 0.7, 0.9, 0.01, 0.5, 0.5
PROSE_ENDS = (0.02, 0.2)
#: Usual ratio before anything is seen, blocks that count for it and for the line of all languages, and their sizes
#: (half octaves of length, 32 to 16,384 characters).
START, PRIOR_ALL, PRIOR, SPREAD = 0.55, 1, 100, range(12, 30)
END = re.compile(r"[.!?…。](?=[\s\"”»)]|$)")
#: An item that gives a quantity: "3 cups of …", "…: 12.5 km", a time, a date, a price.
QUANTITY = re.compile(r"^\W*\d[\d.,/]*\s?[^\W\d]+\b|:\s*[\d(]|\b\d{1,2}[:.h]\d\d\b|\b\d+([.,]\d+)?\s?(kg|g|mg|km|m|cm|mm|ml|l|cl|h|min|s|kw|v|hours?|volts?|%|°)\b|[€$£]\s?\d", re.I)
CITATION = re.compile(r"\(\d{4}\)|\b(19|20)\d\d\b|\bpp?\. ?\d|\bdoi\b|\bISBN\b", re.I)


def one_byte(text: str) -> bytes:
    """One byte a character: what is no ASCII keeps its lowest seven bits and sets the eighth."""
    return text.encode("ascii") if text.isascii() else bytes(ord(c) if ord(c) < 128 else 128 | (ord(c) & 127) for c in text)


def body_blocks(lines: list[Line]) -> list[tuple[str, list[Line]]]:
    """(kind, lines) of the main body without title, author lines and headings; runs of items and of short lines are one block."""
    title = next((k for k, x in enumerate(lines) if x.level == 1), None)
    out: list[tuple[str, list[Line]]] = []
    for k, line in enumerate(lines):
        if not line.main or line.kind in ("heading", "fence") or (line.block is not None and line.block.tag == 8 and title is not None and k > title):
            continue
        kind = line.kind if line.kind != "plain" or line.words >= 15 else "short"
        if out and out[-1][0] == kind and kind != "plain":
            out[-1][1].append(line)
        else:
            out.append((kind, [line]))
    return out


def measure(kind: str, lines: list[Line]) -> tuple[int, int, float, float, float]:
    """(words, characters, compression ratio, sentence ends a word, share of links) of a block; ratio -1 where a list gives quantities."""
    text = "\n".join(LINK.sub(r"\1", x.text) if x.linked else x.text for x in lines)
    words = max(1, sum(x.words for x in lines))
    raw = one_byte(text.lower())
    ratio = len(zlib.compress(raw, 9)) / max(1, len(raw))
    if kind in ("table", "code") or (kind in ("list", "short") and sum(bool(QUANTITY.search(x.text.lstrip("*+- "))) or bool(CITATION.search(x.text)) for x in lines) >= 0.5 * len(lines)):
        ratio = -1.0
    links = sum(x.linked for x in lines) / words
    if links and kind != "plain":
        pieces = [p for x in lines for p in re.split(r"\s[|·/,]\s|\s{2,}", x.text) if p.strip()]
        links = max(links, sum("](" in p for p in pieces) / max(1, len(pieces)))
    return words, len(raw), ratio, len(END.findall(text)) / words, links


FIELDS = (("row", pa.int64()), ("lang", pa.string()), ("size", pa.int32()), ("words", pa.int32()), ("ratio", pa.float32()), ("ends", pa.float32()), ("links", pa.float32()))
SCHEMA = "row long, lang string, size int, words int, ratio float, ends float, links float"


def page_rows(row: int, lines: list[Line]) -> list[tuple]:
    """Rows (see FIELDS) of a page's blocks; none where the body is too short."""
    blocks = body_blocks(lines)
    if sum(x.words for _, part in blocks for x in part) < MIN_WORDS:
        return []
    lang, out = guess(" ".join(x.text for _, part in blocks for x in part if x.kind == "plain")), []
    for kind, part in blocks:
        words, chars, ratio, ends, links = measure(kind, part)
        out.append((row, lang, chars.bit_length() * 2 + (chars >> max(0, chars.bit_length() - 2) & 1), words, ratio, ends, links))
    return out


def _blocks(tree):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, all_lines in labelled(batches, tree):
            rows = [x for i, lines in zip(b.column(0).to_pylist(), all_lines, strict=True) for x in page_rows(i, lines)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, FIELDS, strict=True)], names=[n for n, _ in FIELDS])

    return run


def usual_ratios(seen: list[tuple[str, int, float, int]]) -> list[tuple[str, int, float]]:
    """(language, size, usual ratio) for all sizes: a line through the observed log-ratios of (language, size, ratio, n).

    The line keeps a length at which spam prevails from becoming its own yardstick. Languages and half octaves of
    length are few, so this is small whatever the corpus. A language's line is fitted to its own blocks and PRIOR
    blocks on the line of all, which is fitted to all blocks and PRIOR_ALL blocks of the ratio START, so that no
    number of blocks switches from one line to another.
    """
    sizes = np.arange(64)

    def line(rows: list[tuple[str, int, float, int]], prior: np.ndarray, weight: float) -> np.ndarray:
        x = np.array([r[1] for r in rows] + list(SPREAD), float)
        y = np.array([math.log(max(r[2], 1e-3)) for r in rows] + [prior[k] for k in SPREAD])
        n = np.array([r[3] for r in rows] + [weight / len(SPREAD)] * len(SPREAD))
        return np.polyval(np.polyfit(x, y, 1, w=np.sqrt(n)), sizes)

    everything = line([r for r in seen if r[0]], np.full(64, math.log(START)), PRIOR_ALL)
    out = []
    for lang in {r[0] for r in seen} | {""} | set(FUNCTION_WORDS):
        use = np.exp(line([r for r in seen if r[0] == lang], everything, PRIOR) if lang else everything)
        out += [(lang, int(k), float(v)) for k, v in zip(sizes, use, strict=True)]
    return out


def find_stuffed(pages: DataFrame, page_id: str = "page_id", html: str = "html", markdown: str = "markdown") -> DataFrame:
    """(page_id, stuffed, words) of each page the greater part of whose main body is keywords, goods, places or links.

    Null markdown and bodies below MIN_WORDS are no cases; repeated rows with one id count together; empty tables
    give an empty result; other columns are ignored.
    """
    src = pages.where(f"`{markdown}` is not null").select(F.col(page_id).cast("long"), html, markdown)
    blocks = materialize(src.mapInArrow(_blocks(classifier()), SCHEMA), "blocks")
    return decide(blocks).select(F.col("row").cast(pages.schema[page_id].dataType).alias(page_id), "stuffed", "words")


def decide(blocks: DataFrame) -> DataFrame:
    """(row, stuffed, words) of the cases among page_rows."""
    sentences = (F.col("ratio") > 0) & F.col("ends").between(*PROSE_ENDS) & (F.col("links") < 0.2)
    seen = blocks.where(sentences).groupBy("lang", "size").agg(F.percentile_approx("ratio", 0.7, 1000).alias("usual"), F.count(F.lit(1)).alias("n"))
    spark = blocks.sparkSession
    expected = spark.createDataFrame(usual_ratios([tuple(r) for r in seen.collect()]), "lang string, size int, expect double")
    known = blocks.join(F.broadcast(expected), ["lang", "size"])
    expect = F.col("expect")
    relative = F.col("ratio") / expect
    stuffed = (F.col("links") >= LINKED) | ((F.col("ratio") > 0) & ((relative < EXTREME) | ((relative < HIGH) & (F.col("ends") < FEW_ENDS))))
    per = known.groupBy("row").agg(F.sum(F.when(stuffed, F.col("words")).otherwise(0)).alias("stuffed"), F.sum("words").alias("words"))
    return per.where((F.col("words") >= MIN_WORDS) & (F.col("stuffed") > F.col("words") * SHARE))
