"""Template residue and error-page text (problem 2).

Short lines of main bodies are messages. Over all bodies that hold little else they are mined for templates by a
prefix tree of fixed depth: number of tokens, first and second token (numbers, addresses, places in programs and the
like masked by type). In a leaf, a token that recurs at its place is kept and any other becomes a wildcard. Every
template is classified once, by the log odds of its words and by the company it keeps over the corpus (see
notices.py), and its verdict goes to all its messages. Pages whose main body is for the greater part error message,
script notice or filler are found that way; unresolved slots are looked for separately, in the running text of every
page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.blocks import Line, classifier, labelled
from webloom.llm.notices import Notices, notices, stems, tokens
from webloom.session import materialize

#: A message has at most this many tokens; longer lines are text. Share of a leaf's messages in which a token must
#: recur at its place to be kept (and in two of them at least), and share of its tokens a message must keep to be
#: merged with others.
MESSAGE, RECURS, SIMILAR = 30, 0.1, 0.5
#: Mean log odds from which a sentence of a longer text looks like a message.
LOOKS = 0.4


def _pattern(text: str, flags: int) -> re.Pattern:
    """Alternatives over several lines; line ends and the indent after them are no part of the pattern."""
    return re.compile(re.sub(r"\n\s*", "", text), flags)


#: First four letters of the words of the public filler text "lorem ipsum".
LOREM = set("lore lori ipsu dolo dola amet cons adip elit sed sedu eius temp inci labo magn aliq enim mini veni quis nost exer ulla nisi nisa comm duis aute irur repr volu veli esse cill fugi null pari exce sint occa occae cupi non proi sunt culp qui offi dese moll anim est laborum sitt".split())
SLOT = _pattern(
    r"""\*\|[A-Z][A-Z0-9_:]*\|\*|\{\{[\#/^][A-Za-z][\w. ]*\}\}|(?<![\w\\}\]_^{$\#])\{[a-z]+_[a-z_]+\}|<\?(?:php|=)\s[^>\n]{0,60}\?>|\[(?:[A-Z]+[_ ]?)*(?:NAME|DATE|EMAIL|CITY|PHONE|ADDRESS|TITLE|COMPANY|PRICE|AMOUNT)\](?!\()
    |\{\{\s*[A-Za-z_][\w.\- ]{0,40}\s*\}\}|\[\[[A-Z][A-Z0-9_.]+\]\]|[$\#]\{\s*[A-Za-z_][\w.]{0,40}\s*\}|<%=?\s*[A-Za-z_][\w.]*\s*%>|\{%\s*[A-Za-z_][\w. ]*\s*%\}|%%[A-Za-z_][\w.]*%%|@@[A-Za-z_][\w.]*@@|(?<![\w_])__[A-Z][A-Z0-9_.]*__(?![\w_])|<<[A-Za-z_][\w.]*>>
    |\[(?:[Ii]nsert|INSERT)\s[^\]\n]{1,40}\](?!\()|\[(?:[Yy]our|YOUR|[Tt]he)\s[^\]\n]{1,40}\shere\](?!\()|\[(?:[Cc]ompany|[Ff]irst|[Ll]ast|[Uu]ser|[Pp]roduct|[Cc]ustomer)[ _][Nn]ame\](?!\()
    |\b(?:Hello|Hi|Dear|Welcome|Welcome\ back),?\s(?:undefined|null|NaN|None)\b|\b(?:in|by|of|for|at|from|to)\s(?:null|undefined|NaN)\s*[.,!?]|\bhave\sNaN\b|\[object\ Object\]""",
    0,
)
CODE_SPAN = re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)")
QUOTED = re.compile(r"“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|\"[^\"\n]{1,80}\"")
WORD = re.compile(r"[^\W\d_]+")


def is_lorem(text: str) -> bool:
    words = [w.lower() for w in WORD.findall(text)]
    return len(words) >= 4 and sum(w[:4] in LOREM for w in words) >= 0.6 * len(words)


def has_slot(line: Line) -> bool:
    """A template field left open in running text, title or list; code, quotations and inline code don't count."""
    if line.kind in ("code", "fence", "quote"):
        return False
    t = line.text
    if not any(s in t for s in ("{", "[", "%", "@@", "__", "<<", "<?", "*|", "undefined", "null", "NaN", "None")):
        return False
    t = QUOTED.sub(" ", CODE_SPAN.sub(" ", t)).replace("\\_", "_")
    return SLOT.search(t) is not None


def examine(lines: list[Line], model: Notices) -> tuple[bool, int, int, list[tuple[str, int, bool]]]:
    """(slots, words of text, words of filler, messages as (text, words, is heading)) of a page's main body."""
    slots, text, filler, messages = False, 0, 0, []
    title = next((k for k, x in enumerate(lines) if x.level == 1), None)
    for k, line in enumerate(lines):
        if not line.main or line.kind == "fence":
            continue
        slots = slots or has_slot(line)
        if line.block is not None and line.block.tag == 8 and title is not None and k > title:
            continue  # the author or date line
        # what a text quotes it only speaks of
        own = line.text if line.kind == "code" else QUOTED.sub(" ", CODE_SPAN.sub(" ", line.text)).strip() or line.text
        if is_lorem(line.text):
            filler += line.words
        elif len(line.text.split()) > MESSAGE:
            # a paragraph may string messages together: then each sentence is one
            parts = re.split(r"(?<=[.!?])\s+", own)
            if len(line.text.split()) <= 12 * len(parts) and all(model.looks(stems(tokens(p))) > LOOKS for p in parts[:1]) and sum(model.looks(stems(tokens(p))) > LOOKS for p in parts) > len(parts) / 2:
                messages += [(p, len(p.split()), False) for p in parts]
            else:
                text += line.words
        else:
            messages.append((own, max(1, line.words), line.kind == "heading"))
    return slots, text, filler, messages


FIELDS = (("row", pa.int64()), ("sure", pa.bool_()), ("base", pa.int32()), ("message", pa.string()), ("length", pa.int32()), ("heading", pa.bool_()), ("company", pa.float32()))
SCHEMA = "row long, sure boolean, base int, message string, length int, heading boolean, company float"
NAMES = tuple(n for n, _ in FIELDS)


def page_rows(row: int, lines: list[Line], model: Notices) -> list[tuple]:
    """Rows (see FIELDS) of a page that is or can be a case: its other words, then each message (masked tokens) and its words; else none."""
    slots, text, filler, messages = examine(lines, model)
    short = sum(n for _, n, _ in messages)
    if slots or (filler and filler >= text + sum(n for _, n, h in messages if not h)):
        return [(row, True, 0, None, 0, False, 0.0)]
    # a page without bad messages is no case by itself, but counts together with a repeated row
    if not messages or text > filler + short:
        return []
    split = [tokens(t) for t, _, _ in messages]
    company = model.company([stems(t) for t in split]) * short / max(1, text + filler + short)
    return [(row, False, text - filler, None, 0, False, 0.0)] + [(row, False, 0, " ".join(t), n, h, company) for t, (_, n, h) in zip(split, messages, strict=True)]


def _messages(tree, model):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, all_lines in labelled(batches, tree):
            rows = [x for i, lines in zip(b.column(0).to_pylist(), all_lines, strict=True) for x in page_rows(i, lines, model)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, FIELDS, strict=True)], names=list(NAMES))

    return run


def _rows(pages: DataFrame, page_id: str, html: str, markdown: str) -> DataFrame:
    src = pages.where(f"`{markdown}` is not null").select(F.col(page_id).cast("long"), html, markdown)
    return materialize(src.mapInArrow(_messages(classifier(), notices()), SCHEMA), "messages")


def find_residue(pages: DataFrame, page_id: str = "page_id", html: str = "html", markdown: str = "markdown") -> DataFrame:
    """(page_id) of each page whose main body is an error message, a script notice or filler, or holds open slots.

    Null markdown is no case, nor is an empty main body; null html leaves the markdown's own features; repeated
    rows with one id count together; empty tables give an empty result; other columns are ignored.
    """
    return decide(_rows(pages, page_id, html, markdown)).select(F.col("row").cast(pages.schema[page_id].dataType).alias(page_id))


def find_templates(pages: DataFrame, page_id: str = "page_id", html: str = "html", markdown: str = "markdown") -> DataFrame:
    """(template, messages, occurrences, company, verdict) of the templates mined. Same edge cases as find_residue."""
    of = judged(_rows(pages, page_id, html, markdown))
    per = of.groupBy("template", "verdict").agg(F.count(F.lit(1)).alias("messages"), F.sum("n").alias("occurrences"), F.sum("company").alias("c"))
    return per.select("template", "messages", "occurrences", F.round(F.col("c") / F.col("occurrences"), 4).alias("company"), "verdict")


def mined(rows: DataFrame) -> DataFrame:
    """(message, template, n, company): each distinct message among page_rows, its template, occurrences and their summed company.

    The counts of a leaf's tokens are combined before each shuffle and joined in, so no leaf is ever in one task.
    """
    distinct = rows.where("message is not null").groupBy("message").agg(F.count(F.lit(1)).alias("n"), F.sum("company").alias("company"))
    parts = distinct.withColumn("t", F.split("message", " "))
    leaf = F.xxhash64(F.size("t"), F.col("t")[0], F.get("t", F.lit(1))).alias("leaf")
    placed = parts.select("message", leaf, F.posexplode("t").alias("place", "token"))
    often = placed.groupBy("leaf", "place", "token").agg(F.count(F.lit(1)).alias("often"))
    # each message of a leaf has one first token, which is the leaf's own
    size = often.where("place = 0").groupBy("leaf").agg(F.sum("often").alias("all"))
    kept = often.join(size.hint("merge"), "leaf").select("leaf", "place", "token", (F.col("often") >= F.greatest(F.least(F.col("all"), F.lit(2)), F.col("all") * RECURS)).alias("keep"))
    told = placed.join(kept.hint("merge"), ["leaf", "place", "token"]).groupBy("message").agg(F.sort_array(F.collect_list(F.struct("place", F.when(F.col("keep"), F.col("token")).otherwise("*").alias("token")))).alias("t"))
    keeps = F.size(F.filter("t", lambda x: x["token"] != "*")) >= F.size("t") * SIMILAR
    template = F.when(keeps, F.array_join(F.transform("t", lambda x: x["token"]), " ")).otherwise(F.col("message"))
    return told.select("message", template.alias("template")).join(distinct.hint("merge"), "message")


def judged(rows: DataFrame) -> DataFrame:
    """mined, with the verdict of each message's template."""
    model, messages = notices(), materialize(mined(rows), "mined")
    per = messages.groupBy("template").agg((F.sum("company") / F.sum("n")).alias("company"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.verdicts([t.split(" ") for t in b.column(0).to_pylist()], b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=["template", "verdict"])

    return messages.join(per.mapInArrow(run, "template string, verdict string").hint("merge"), "template")


def decide(rows: DataFrame) -> DataFrame:
    """(row) of the cases among page_rows; rows of one id count together."""
    known = rows.join(judged(rows).select("message", "verdict").hint("merge"), "message", "left")
    bad = F.coalesce(F.sum(F.when(F.col("verdict") == "bad", F.col("length"))), F.lit(0)).alias("bad")
    other = F.sum(F.col("base") + F.when(F.col("message").isNotNull() & F.col("verdict").isNull() & ~F.col("heading"), F.col("length")).otherwise(0)).alias("other")
    return known.groupBy("row").agg(F.max("sure").alias("sure"), bad, other).where("sure or (bad > 0 and bad >= other)").select("row")
