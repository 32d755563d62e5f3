"""Page operators: each page is parsed once, and only the wanted parts leave the Arrow batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from webloom.dom import classic, extract, relevance, scrape
from webloom.dom.tree import parse

_S, _B, _I, _D = T.StringType(), T.BooleanType(), T.IntegerType(), T.DoubleType()
_MAP = T.MapType(_S, _S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PARTS: dict[str, T.DataType] = {
    "links": T.ArrayType(_struct(href=_S, text=_S, is_external=_B)),
    "metadata": _struct(title=_S, description=_S, keywords=_S, author=_S, language=_S, canonical=_S, open_graph=_MAP, twitter_card=_MAP, json_ld=T.ArrayType(_S)),
    "tables": T.ArrayType(_struct(headers=T.ArrayType(_S), rows=T.ArrayType(T.ArrayType(_S)), caption=_S, score=_D, is_data_table=_B)),
    "images": T.ArrayType(_struct(url=_S, alt=_S, width=_S, height=_S, source_tag=_S, score=_D)),
    "structure": _struct(h1=T.ArrayType(_S), h2=T.ArrayType(_S), h3=T.ArrayType(_S), forms=_I, links=_I, images=_I, scripts=_I, styles=_I, iframes=_I, navs=_I, has_main=_B, has_article=_B, has_aside=_B, has_header=_B, has_footer=_B),
    "text": _S,
    "markdown": _S,
    "quick_links": T.ArrayType(_struct(href=_S, text=_S, is_external=_B)),
    "classic_metadata": _MAP,
    "preview": _struct(title=_S, description=_S, image=_S, site_name=_S, type=_S),
    "head": _struct(title=_S, charset=_S, lang=_S, meta=_MAP, link=T.MapType(_S, T.ArrayType(_S)), jsonld=T.ArrayType(_S)),
    "head_text": _S,
    "classic_images": T.ArrayType(_struct(src=_S, alt=_S, score=_I, group_id=_I, format=_S, width=_S)),
    "classic_query": _S,
    "text_runs": T.ArrayType(_struct(kind=_S, text=_S)),
    "classic_relevant": T.ArrayType(_struct(kind=_S, text=_S, score=_D)),
    "table_markdown": _S,
    "table_json": _S,
    "data_tables": T.ArrayType(_struct(headers=T.ArrayType(_S), rows=T.ArrayType(T.ArrayType(_S)), caption=_S, score=_D)),
    "written": _struct(raw=_S, cited=_S, references=_S, fit=_S, fit_html=_S),
    "scraped": _struct(clean_html=_S, plain_text=_S, links=T.ArrayType(_struct(url=_S, text=_S, is_external=_B)), images=T.ArrayType(_struct(url=_S, alt=_S, width=_S, height=_S, score=_D)), metadata=_MAP),
    "classic_html": _S,
    "reduced_html": _S,
    "classic_fit": T.ArrayType(_S),
    "fit_html": _S,
}
#: Parts that change the tree and so get one of their own.
OWN_TREE = {"scraped", "classic_html", "written", "fit_html"}


def _written(doc, base: str) -> dict:  # noqa: ANN001
    """Markdown as it is, with citations and their list, and that of the pruned page."""
    raw = extract.markdown(doc, base, inline_links=True)
    cited, references = scrape.cited(raw, base)
    fit_html = extract.prune(doc)
    return {"raw": raw, "cited": cited, "references": references, "fit": extract.markdown(parse(f"<div>{fit_html}</div>"), base, inline_links=True), "fit_html": fit_html}


_MAKE = {
    "links": lambda doc, base: extract.links(doc, base),
    "metadata": lambda doc, base: extract.metadata(doc),
    "tables": lambda doc, base: extract.tables(doc),
    "images": lambda doc, base: extract.images(doc, base),
    "structure": lambda doc, base: extract.structure(doc),
    "text": lambda doc, base: (doc.first("body") or doc).text(),
    "markdown": lambda doc, base: extract.markdown(doc, base),
    "quick_links": lambda doc, base: scrape.quick_links(doc, base),
    "classic_metadata": lambda doc, base: scrape.classic_metadata(doc),
    "preview": lambda doc, base: scrape.preview(doc),
    "head": lambda doc, base: scrape.head_facts(doc),
    "head_text": lambda doc, base: scrape.head_text(scrape.head_facts(doc)),
    "classic_images": lambda doc, base: scrape.classic_images(doc),
    "classic_query": lambda doc, base: scrape.page_query(doc),
    "text_runs": lambda doc, base: [{"kind": k, "text": t} for k, t in scrape.text_runs(doc)],
    "classic_relevant": lambda doc, base: [{"kind": k, "text": t, "score": round(v, 6)} for k, t, v in relevance.classic_relevant(doc)],
    "table_markdown": lambda doc, base: scrape.table_markdown(extract.tables(doc)),
    "table_json": lambda doc, base: json.dumps(extract.tables(doc), ensure_ascii=False, sort_keys=True),
    "data_tables": lambda doc, base: classic.data_tables(doc.html()),
    "written": _written,
    "scraped": scrape.scrape,
    "classic_html": lambda doc, base: scrape.classic_scrape(doc),
    "reduced_html": lambda doc, base: scrape.reduce_html(doc.html()),
    "classic_fit": lambda doc, base: classic.prune(doc.html()),
    "fit_html": lambda doc, base: extract.prune(doc),
}


def crawl_pages(pages: DataFrame, parts: list[str], key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, *parts) of each page; null html counts as an empty page, null url as no base."""
    order = [p for p in PARTS if p in parts]
    schema = T.StructType([pages.schema[key], *[T.StructField(p, PARTS[p]) for p in order]])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 128):
                part = b.slice(start, 128)
                cols: list[list] = [[] for _ in order]
                for u, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    doc = parse(h or "")
                    for c, p in zip(cols, order, strict=True):
                        c.append(_MAKE[p](parse(h or "") if p in OWN_TREE and len(order) > 1 else doc, u or ""))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, f.type) for c, f in zip(cols, list(target)[1:], strict=True)]], names=target.names)

    return pages.select(key, url, html).mapInArrow(run, schema)


def extract_records(pages: DataFrame, schema: dict, how: str = "css", key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, record_index, record as JSON), one row a record of the extraction schema (see dom.extract.records)."""
    return _records(pages, lambda doc: extract.records(doc, schema, how), key, html)


def link_table(pages: DataFrame) -> DataFrame:
    """(page_id, src_url, dst_url, text, is_external, pos): one row a link."""
    keyed = pages.where("html is not null").select(F.struct("page_id", F.col("url").alias("src_url")).alias("k"), "url", "html")
    with_links = crawl_pages(keyed, ["links"], key="k").select("k.page_id", "k.src_url", F.posexplode("links").alias("pos", "l"))
    return with_links.select("page_id", "src_url", F.col("l.href").alias("dst_url"), F.col("l.text").alias("text"), F.col("l.is_external").alias("is_external"), "pos")


def relevant_chunks(pages: DataFrame, query: str | None = None, threshold: float = 1.0, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, chunk_index, tag, text, score) of each page's chunks that fit the query, by default the page's own."""
    id_type = to_arrow_type(pages.schema[key].dataType)
    types = (id_type, pa.int32(), pa.string(), pa.string(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if h:
                    doc = parse(h)
                    rows += [(i, k, t, x, round(s, 6)) for k, t, x, s in relevance.relevant(relevance.text_chunks(doc), query if query is not None else relevance.page_query(doc), threshold)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[key, "chunk_index", "tag", "text", "score"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, chunk_index int, tag string, text string, score double")


def prune_blocks(blocks: DataFrame, text: str) -> DataFrame:
    """blocks with `score` (1 or 0) and `kept`: whether anything of a block survives pruning; null blocks are not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [bool(t and extract.prune(parse(f"<html><body><div>{t}</div></body></html>"))) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([float(k) for k in kept]), pa.array(kept)], names=[*b.schema.names, "score", "kept"])

    return blocks.mapInArrow(run, T.StructType([*blocks.schema.fields, T.StructField("score", _D), T.StructField("kept", _B)]))


def engine_records(pages: DataFrame, schema: dict, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, record_index, record as JSON) of a schema whose fields each say how they select: css, xpath or regex (see dom.schema)."""
    from webloom.dom import schema as engine

    return _records(pages, lambda doc: engine.records(doc, schema), key, html)


def classic_records(pages: DataFrame, schema: dict, how: str = "css", key: str = "page_id", html: str = "html") -> DataFrame:
    """The same of a classic schema, with type pipelines, defaults, transforms, siblings and computed fields."""
    from webloom.dom import schema as engine

    return _records(pages, lambda doc: engine.classic_records(doc, schema, how), key, html)


def _records(pages: DataFrame, make, key: str, html: str) -> DataFrame:  # noqa: ANN001
    id_type = to_arrow_type(pages.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, json.dumps(r, ensure_ascii=False, sort_keys=True)) for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if h for k, r in enumerate(make(parse(h)))]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (id_type, pa.int32(), pa.string()), strict=True)], names=[key, "record_index", "record"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, record_index int, record string")


def good_media(column: str, least: float) -> Column:
    """The items of a media array that reach the least score."""
    return F.filter(column, lambda x: x["score"] >= least)


def citations(texts: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, cited, references, numbers): Markdown with its links as numbered citations (see dom.scrape.cited), and the numbers by address."""
    schema = T.StructType([texts.schema[key], T.StructField("cited", _S), T.StructField("references", _S), T.StructField("numbers", T.ArrayType(_struct(url=_S, number=_I)))])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [scrape.cited(t) if t else ("", "") for t in b.column(1).to_pylist()]
            listed = [[{"url": u, "number": k + 1} for k, u in enumerate(scrape.cited_urls(t or ""))] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string()), pa.array(listed, target.field("numbers").type)], names=target.names)

    return texts.select(key, markdown).mapInArrow(run, schema)
