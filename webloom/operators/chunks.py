"""Chunkers: from a text column to an array of chunks, by higher-order functions where semantics allow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.text import WS, fields


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def _present(parts: Column) -> Column:
    return F.filter(F.transform(parts, trimmed), lambda p: p != "")


def windows(text: Column, size: int, step: int) -> Column:
    """Windows of so many characters, trimmed, empty ones left out; the first that reaches the end is the last."""
    step = max(1, step)
    n = F.char_length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(_present(cut))


def overlapping_windows(text: Column, size: int = 500, overlap: int = 50) -> Column:
    overlap = min(max(0, overlap), size - 1)
    return windows(text, size, size - overlap)


def regex_split(text: Column, pattern: str = "\n\n") -> Column:
    """Trimmed parts between matches; the whole text if no part is left."""
    parts = _present(F.split(text, pattern))
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(text)).otherwise(parts)


def sentences(text: Column) -> Column:
    """Parts that end after . ! or ? before white space, or at a line end."""
    return _present(F.split(text, rf"(?<=[.!?]){WS}+|\n"))


def word_windows(text: Column, size: int, step: int | None = None) -> Column:
    """Runs of `size` words, `step` apart (by default adjacent), joined by spaces; the last may be shorter."""
    step = step or size
    w = fields(text)
    count = F.ceil(F.size(w) / step).cast("int")
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(w, i * step + 1, size), " ")))


def aligned_word_windows(text: Column, size: int, step: int) -> Column:
    """Full runs of `size` words, `step` apart, and one more that ends with the text if words are left over."""
    w = fields(text)
    n = F.size(w)
    full = F.floor((n - size) / step).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(full, F.lit(0))), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))
    tail = F.array_join(F.slice(w, F.greatest(n - size, F.lit(0)) + 1, size), " ")
    return F.when(n <= size, F.array(F.array_join(w, " "))).when((n - size) % step == 0, runs).otherwise(F.concat(runs, F.array(tail)))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared share of the smaller of two sets; 0 if either is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / small)


def topics(text: Column, threshold: float = 0.1) -> Column:
    """Paragraphs, merged with the one before while their word sets overlap by at least the threshold."""
    parts = _present(F.split(text, "\n\n"))
    with_words = F.transform(parts, lambda p: F.struct(p.alias("p"), F.array_distinct(fields(F.lower(p))).alias("w")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        k = F.size(acc["done"])
        joined = F.concat(F.slice(acc["done"], 1, F.greatest(k - 1, F.lit(0))), F.array(F.concat(F.element_at(acc["done"], -1), F.lit("\n\n"), x["p"])))
        merge = (k > 0) & (overlap_ratio(acc["last"], x["w"]) >= threshold)
        return F.struct(F.when(merge, joined).otherwise(F.concat(acc["done"], F.array(x["p"]))).alias("done"), x["w"].alias("last"))

    return F.aggregate(with_words, start, step)["done"]


def explode_chunks(df: DataFrame, chunks: Column, name: str = "chunk") -> DataFrame:
    """One row a chunk, with its index; rows without chunks are left out."""
    return df.withColumn("_c", chunks).select(*df.columns, F.posexplode("_c").alias("chunk_index", name))


# ---- greedy chunkers, one text at a time --------------------------------------------------------------------


def fixed_size(text: str, size: int, overlap: int = 0) -> list[str]:
    """About `size` characters each, ended after the last paragraph break, sentence end or space that fits."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end < n:
            window = text[at:end]
            cut = window.rfind("\n\n")
            if cut <= 0:
                cut = max(window.rfind(". "), window.rfind("! "), window.rfind("? "))
            if cut <= 0:
                cut = max(window.rfind(" "), window.rfind("\n"))
            if cut > 0:
                end = at + cut + 1
        piece = text[at:end].strip()
        if piece:
            out.append(piece)
        if end >= n:
            break
        at = max(end - overlap, at + 1)
    return out


def token_aware(text: str, max_tokens: int = 512, overlap: int = 0, separator: str = "\n\n") -> list[str]:
    """Segments filled up to max_tokens (estimated), the last ones of a chunk repeated up to `overlap` tokens."""

    def size(s: str) -> int:
        return (len(s.split()) * 4 + 2) // 3

    out: list[str] = []
    held: list[str] = []
    for seg in (s for s in text.split(separator) if s.strip()):
        if held and sum(map(size, held)) + size(seg) > max_tokens:
            out.append(separator.join(held))
            back: list[str] = []
            for h in reversed(held):
                if sum(map(size, back)) + size(h) > overlap:
                    break
                back.insert(0, h)
            held = back if sum(map(size, back)) + size(seg) <= max_tokens else []
        held.append(seg)
    return [*out, separator.join(held)] if held else out


def hard_split(text: str, size: int) -> list[str]:
    """At most `size` characters each, ended after the last paragraph break, else sentence end, else space, that fits."""
    out, at = [], 0
    while len(text) - at > size:
        end = at + size
        cut = text.rfind("\n\n", at, end) + 2
        if cut <= at + 2:
            cut = max(text.rfind(x, at, end) for x in ".!?") + 1
        if cut <= at + 1:
            cut = text.rfind(" ", at, end) + 1
        if cut <= at + 1:
            cut = end
        out.append(text[at:cut].strip())
        at = cut
    return [x for x in (*out, text[at:].strip()) if x]


def split_section(section: str, size: int) -> list[str]:
    """Parts of a section of at most `size` characters; a fence stays whole, even if it is longer."""
    units: list[list[str]] = [[]]
    fence = False
    for line in section.split("\n"):
        mark = line.lstrip().startswith("```")
        if mark and not fence:
            units.append([])
        units[-1].append(line)
        if mark and fence:
            units.append([])
        fence = fence != mark
    out: list[str] = []
    for unit in ("\n".join(u).strip("\n") for u in units):
        if unit.strip():
            first, *rest = [unit] if unit.lstrip().startswith("```") else hard_split(unit, size)
            if out and len(out[-1]) + 2 + len(first) <= size:
                out[-1] += "\n\n" + first
            else:
                out.append(first)
            out += rest
    return out


def markdown_sections(text: str, max_chars: int = 2000, split: bool = False) -> list[str]:
    """Sections by heading; fences are never cut, short neighbours are merged up to max_chars, longer sections split if asked."""
    sections: list[list[str]] = [[]]
    fence = False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fence = not fence
        elif not fence and line.startswith("#") and any(x.strip() for x in sections[-1]):
            sections.append([])
        sections[-1].append(line)
    out: list[str] = []
    joins = False
    for s in ("\n".join(x).strip() for x in sections):
        if not s:
            continue
        if joins and len(out[-1]) + 2 + len(s) <= max_chars:
            out[-1] += "\n\n" + s
            continue
        # nothing joins the rest of a split section
        joins = not split or len(s) <= max_chars
        out += [s] if joins else split_section(s, max_chars)
    return out


def greedy_chunks(df: DataFrame, text: str, how: str = "fixed_size", **options: int) -> DataFrame:
    """df with (chunk_index, chunk) by one of the greedy chunkers; null texts have no chunks."""
    chunker = {"fixed_size": fixed_size, "token_aware": token_aware, "markdown": markdown_sections}[how]
    schema = T.StructType([*df.schema.fields, T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts = [chunker(t, **options) if isinstance(t, str) else [] for t in f[text]]
            if not any(parts):
                continue
            rows = f.loc[f.index.repeat([len(p) for p in parts])].reset_index(drop=True)
            rows["chunk_index"] = [i for p in parts for i in range(len(p))]
            rows["chunk"] = [c for p in parts for c in p]
            yield rows

    return df.mapInPandas(run, schema)


def _heading(paragraph: str, following: str) -> str:
    """A paragraph's text if it is a heading: marked as one, or a short line without a stop before a longer one."""
    if paragraph.startswith("#"):
        return paragraph.lstrip("#").split("\n", 1)[0].strip()
    first, _, rest = paragraph.partition("\n")
    longer = rest or following
    return first.strip() if 0 < len(first) <= 80 and len(first) < len(longer) and not first.rstrip().endswith((".", "!", "?", ",", ";", ":")) else ""


def semantic(text: str, max_chars: int = 1000) -> list[tuple[str, str]]:
    """(heading, chunk): paragraphs of one heading, merged up to max_chars; a paragraph longer than that stands alone."""
    paragraphs = [p.strip() for p in text.split("\n\n") if p.strip()]
    out: list[tuple[str, str]] = []
    heading = ""
    for k, p in enumerate(paragraphs):
        own = _heading(p, paragraphs[k + 1] if k + 1 < len(paragraphs) else "")
        heading = own or heading
        if out and not own and out[-1][0] == heading and len(out[-1][1]) + 2 + len(p) <= max_chars:
            out[-1] = (heading, out[-1][1] + "\n\n" + p)
        else:
            out.append((heading, p))
    return out


def semantic_chunks(df: DataFrame, text: str, max_chars: int = 1000) -> DataFrame:
    """df with (chunk_index, heading, chunk); null texts have no chunks."""
    schema = T.StructType([*df.schema.fields, T.StructField("chunk_index", T.IntegerType()), T.StructField("heading", T.StringType()), T.StructField("chunk", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts = [semantic(t, max_chars) if isinstance(t, str) else [] for t in f[text]]
            if not any(parts):
                continue
            rows = f.loc[f.index.repeat([len(p) for p in parts])].reset_index(drop=True)
            rows["chunk_index"] = [i for p in parts for i in range(len(p))]
            rows["heading"], rows["chunk"] = [h for p in parts for h, _ in p], [c for p in parts for _, c in p]
            yield rows

    return df.mapInPandas(run, schema)


def whole(text: Column) -> Column:
    """The text as its only chunk."""
    return F.array(text)


def text_blocks(html: Column, least: int = 20) -> Column:
    """Visible text cut at double spaces, blocks of more than `least` bytes; as visible text has none, that is one block or none."""
    from webloom.functions.text import html_to_text

    return F.filter(F.transform(F.split(html_to_text(html), "  "), trimmed), lambda b: F.octet_length(b) > least)


def queued_words(text: Column, tokens: int, overlap: int = 0, rate: float = 0.75) -> Column:
    """Runs of words worth `tokens` less those worth `overlap`, while that much is left, and then the rest."""
    size, back = max(1, int(tokens / rate + 1e-9)), int(overlap / rate + 1e-9)
    step = max(1, size - back)
    w = fields(text)
    full = F.greatest(F.lit(0), F.floor((F.size(w) - tokens / rate) / step + 1e-9) + 1).cast("int")
    runs = F.when(full > 0, F.transform(F.sequence(F.lit(0), full - 1), lambda i: F.array_join(F.slice(w, i * step + 1, step), " "))).otherwise(F.array().cast("array<string>"))
    rest = F.array_join(F.slice(w, full * step + 1, F.greatest(F.lit(0), F.size(w) - full * step)), " ")
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.filter(F.concat(runs, F.array(rest)), lambda x: x != ""))


def merged_to_size(texts: Column, target: int, overlap: int = 0) -> Column:
    """The words of all texts in runs of `target`, each after the first beginning with the last `overlap` of the one before; the last run takes the rest."""
    w = F.flatten(F.transform(texts, fields))
    n = F.size(w)
    runs = F.ceil(n / target).cast("int")
    step = max(1, target - overlap)
    cut = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.array_join(F.slice(w, i * step + 1, F.when(i == runs - 1, F.greatest(n - i * step, F.lit(0))).otherwise(target)), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.filter(cut, lambda x: x != ""))


def merged_below(chunks: Column, tokens: float, factor: float = 1.3) -> Column:
    """Adjacent chunks joined by an empty line while their words times the factor stay below `tokens`."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"), F.lit(0.0).alias("sum"), F.lit(False).alias("any"))

    def step(acc: Column, c: Column) -> Column:
        n = F.size(fields(c)) * factor
        fits = acc["sum"] + n < tokens
        joined = F.when(acc["any"], F.concat(acc["now"], F.lit("\n\n"), c)).otherwise(c)
        return F.struct(F.when(fits | ~acc["any"], acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"]))).alias("out"), F.when(fits, joined).otherwise(c).alias("now"), F.when(fits, acc["sum"] + n).otherwise(n).alias("sum"), F.lit(True).alias("any"))

    done = F.aggregate(chunks, start, step)
    return F.when(F.size(chunks) == 0, F.array().cast("array<string>")).otherwise(F.concat(done["out"], F.array(done["now"])))
