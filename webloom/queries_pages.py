"""Queries of page parts, schemas, patterns, chunk merging and what a crawl knows, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import filters, patterns, text, urls
from webloom.operators import chunks, graph, knowledge, pages, rank, stats
from webloom.plans import pipelines
from webloom.queries import SQL, _ASKED, _BM25, _TITLE, _WS, _docs, _meta_of, _pages, _stemmed, _unescaped, _words, query
from webloom.session import table
from webloom.sources import crawl
from webloom.streaming import crawl as streaming


def _html(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("html is not null")


_TRIM = "chr(32) || chr(9) || chr(10) || chr(13)"
_DESCRIPTION = _meta_of("description")
_IMG = "regexp_extract(html, '<img[^>]*src=\"([^\"]*)\"', 1)"


# ---- page parts: of HTML that SQL can't read, so held to hand-made pages in the tests -----------------------


@query()
def d22_scraped(spark: SparkSession, d: str) -> DataFrame:
    s = pages.crawl_pages(_pages(spark, d), ["scraped"])
    return s.select("page_id", F.sha2("scraped.clean_html", 256).alias("html_hash"), F.sha2("scraped.plain_text", 256).alias("text_hash"), F.size("scraped.links").alias("links"), F.size("scraped.images").alias("images"), F.size("scraped.metadata").alias("meta"))


@query()
def d23_classic_scrape(spark: SparkSession, d: str) -> DataFrame:
    return pages.crawl_pages(_pages(spark, d), ["classic_html"]).select("page_id", F.sha2("classic_html", 256).alias("hash"), F.length("classic_html").alias("size"))


@query()
def d6_written(spark: SparkSession, d: str) -> DataFrame:
    w = pages.crawl_pages(_pages(spark, d), ["written"])
    return w.select("page_id", *[F.sha2(f"written.{c}", 256).alias(c) for c in ("raw", "cited", "references", "fit", "fit_html")])


@query()
def d9_quick_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.crawl_pages(_pages(spark, d), ["quick_links"]).select("page_id", F.posexplode("quick_links").alias("pos", "l")).select("page_id", "pos", "l.*")


@query(f"SELECT page_id, 'title' AS name, trim({_TITLE}, {_TRIM}) AS value FROM crawled_data WHERE trim({_TITLE}, {_TRIM}) <> '' UNION ALL SELECT page_id, 'description', trim({_DESCRIPTION}, {_TRIM}) FROM crawled_data WHERE regexp_matches(html, '<meta name=\"description\" content=')")
def d11_classic_metadata(spark: SparkSession, d: str) -> DataFrame:
    return pages.crawl_pages(_pages(spark, d), ["classic_metadata"]).select("page_id", F.explode("classic_metadata").alias("name", "value"))


@query(f"SELECT page_id, coalesce(nullif(regexp_extract(html, '<meta property=\"og:title\" content=\"([^\"]*)\"', 1), ''), trim({_TITLE}, {_TRIM})) AS title, {_DESCRIPTION} AS description, {_IMG} AS image, '' AS site_name, '' AS type FROM crawled_data")
def m3_preview(spark: SparkSession, d: str) -> DataFrame:
    return pages.crawl_pages(_pages(spark, d), ["preview"]).select("page_id", "preview.*")


@query(f"SELECT page_id, trim({_TITLE}, {_TRIM}) AS title, lower(regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1)) AS charset, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, CAST(len(list_distinct(regexp_extract_all(html, '<meta (?:name|property|http-equiv)=\"([^\"]*)\"', 1))) AS INTEGER) AS metas, CAST(len(list_distinct(regexp_extract_all(html, '<link rel=\"([^\" ]*)\"', 1))) AS INTEGER) AS relations, CAST(len(regexp_extract_all(html, '<script type=\"application/ld.json\"')) AS INTEGER) AS jsonld FROM crawled_data")
def m5_head_facts(spark: SparkSession, d: str) -> DataFrame:
    return pages.crawl_pages(_pages(spark, d), ["head"]).select("page_id", "head.title", "head.charset", "head.lang", F.size("head.meta").alias("metas"), F.size("head.link").alias("relations"), F.size("head.jsonld").alias("jsonld"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<img[^>]*src=\"([^\"]*)\"', 1)) AS INTEGER) AS variants FROM crawled_data")
def d20_classic_images(spark: SparkSession, d: str) -> DataFrame:
    return pages.crawl_pages(_pages(spark, d), ["classic_images"]).select("page_id", F.size("classic_images").alias("variants"))


@query("SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '<img[^>]*src=\"([^\"]*)\"', 1))) AS INTEGER) AS images, 0 AS good FROM crawled_data")
def d18_good_images(spark: SparkSession, d: str) -> DataFrame:
    some = pages.crawl_pages(_pages(spark, d), ["images"])
    return some.select("page_id", F.size("images").alias("images"), F.size(pages.good_media("images", 0.5)).alias("good"))


@query()
def d25_reduced_html(spark: SparkSession, d: str) -> DataFrame:
    return pages.crawl_pages(_pages(spark, d), ["reduced_html"]).select("page_id", F.sha2("reduced_html", 256).alias("hash"), F.length("reduced_html").alias("size"))


_H1 = _unescaped("regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")
_LONG = _unescaped("regexp_replace(coalesce(list_filter(regexp_extract_all(html, '(?s)<p(?: [^>]*)?>(.*?)</p>', 1), lambda x: length(regexp_replace(x, '<[^>]*>', '', 'g')) > 150)[1], ''), '<[^>]*>', '', 'g')")


@query(f"SELECT page_id, array_to_string(list_filter([{_TITLE}, {_H1}, CASE WHEN {_DESCRIPTION} <> '' THEN {_DESCRIPTION} ELSE substr({_LONG}, 1, 150) END], lambda x: x <> ''), ' ') AS classic_query FROM crawled_data")
def d27_classic_query(spark: SparkSession, d: str) -> DataFrame:
    return pages.crawl_pages(_pages(spark, d), ["classic_query"])


@query()
def d29_text_runs(spark: SparkSession, d: str) -> DataFrame:
    return pages.crawl_pages(_pages(spark, d), ["text_runs"]).select("page_id", F.posexplode("text_runs").alias("pos", "r")).select("page_id", "pos", "r.*")


@query()
def r4_classic_relevant(spark: SparkSession, d: str) -> DataFrame:
    return pages.crawl_pages(_pages(spark, d), ["classic_relevant"]).select("page_id", F.posexplode("classic_relevant").alias("pos", "r")).select("page_id", "pos", "r.*")


@query()
def d14_data_tables(spark: SparkSession, d: str) -> DataFrame:
    return pages.crawl_pages(_pages(spark, d), ["data_tables"]).select("page_id", F.posexplode("data_tables").alias("pos", "t")).select("page_id", "pos", F.size("t.headers").alias("columns"), F.size("t.rows").alias("rows"), "t.score")


@query()
def a23_table_widths(spark: SparkSession, d: str) -> DataFrame:
    per = pages.crawl_pages(_pages(spark, d), ["tables"]).select("page_id", F.posexplode("tables").alias("pos", "t")).select("page_id", "pos", F.explode("t.rows").alias("r"))
    return stats.width_stats(per.select("page_id", "pos", F.size("r").alias("n")), ["page_id", "pos"], "n")


@query()
def s18_table_markdown(spark: SparkSession, d: str) -> DataFrame:
    return pages.crawl_pages(_pages(spark, d), ["table_markdown", "table_json"]).select("page_id", "table_markdown", F.sha2("table_json", 256).alias("json_hash"))


@query()
def f20_classic_pruned(spark: SparkSession, d: str) -> DataFrame:
    return pages.crawl_pages(_pages(spark, d), ["classic_fit"]).select("page_id", F.size("classic_fit").alias("kept"))


@query()
def f22_prune_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "scraping_result").select("page_id", "plain_text")
    return pages.prune_blocks(blocks, "plain_text").select("page_id", "score", "kept")


@query()
def x8_engine_records(spark: SparkSession, d: str) -> DataFrame:
    schema = {"base": "body", "fields": [{"name": "title", "type": "css", "selector": "h1"}, {"name": "links", "type": "xpath", "selector": "//a", "attribute": "href", "is_list": True}, {"name": "years", "type": "regex", "selector": r"\b(?:19|20)\d\d\b", "is_list": True}]}
    return pages.engine_records(_pages(spark, d), schema)


@query()
def x9_classic_records(spark: SparkSession, d: str) -> DataFrame:
    fields = [{"name": "text", "type": "text", "transform": "strip"}, {"name": "number", "type": ["text", "regex"], "pattern": r"(\d+)", "default": "0"}, {"name": "double", "type": "computed", "expression": "int(number) * 2"}]
    return pages.classic_records(_pages(spark, d), {"baseSelector": "p", "fields": fields})


@query()
def r5_head_relevance(spark: SparkSession, d: str) -> DataFrame:
    heads = pages.crawl_pages(_pages(spark, d), ["head_text"])
    return rank.scaled(rank.bm25(heads, "page_id", "head_text", "river museum garden news"), "score")


# ---- patterns and texts -------------------------------------------------------------------------------------


def _preprocess_sql() -> str:
    out = "html"
    for tag in text.BULK[:2]:
        out = f"regexp_replace({out}, '(?i)<{tag}[\\s>][\\s\\S]*?</{tag}>', '', 'g')"
    out = f"regexp_replace({out}, '<!--[\\s\\S]*?-->', '', 'g')"
    for tag in text.BULK[2:]:
        out = f"regexp_replace({out}, '(?i)<{tag}[\\s>][\\s\\S]*?</{tag}>', '', 'g')"
    kept = "|".join(text.ATTRIBUTES)
    return f"""WITH a AS (SELECT page_id, {out} AS h FROM crawled_data WHERE html IS NOT NULL), p AS (SELECT page_id, regexp_extract_all(h, '[^<]+|<[a-zA-Z][a-zA-Z0-9]*(?:\\s+[^>]*?)?>|<') AS pieces FROM a),
r AS (SELECT page_id, array_to_string(list_transform(pieces, lambda x: CASE WHEN regexp_matches(x, '^<[a-zA-Z][a-zA-Z0-9]*\\s+[^>]*>$') THEN '<' || regexp_extract(x, '^<([a-zA-Z][a-zA-Z0-9]*)', 1) || coalesce(' ' || nullif(array_to_string(list_filter(regexp_extract_all(x, '\\s+([a-zA-Z][\\w-]*(?:\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s>]*))?)', 1), lambda y: regexp_matches(lower(y), '^({kept})(\\s*=|$)')), ' '), ''), '') || '>' ELSE x END), '') AS h FROM p)
SELECT page_id, sha256(trim(regexp_replace(h, '\\s{{2,}}', ' ', 'g'), chr(32) || chr(9) || chr(13) || chr(10) || chr(11) || chr(12))) AS hash FROM r"""


@query(_preprocess_sql())
def d24_preprocess(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark, d).select("page_id", F.sha2(text.preprocess(F.col("html")), 256).alias("hash"))


@query("""WITH m AS (SELECT page_id, regexp_extract_all(markdown, '!?\\[[^\\]]+\\]\\([^)\\s]+(?:\\s+"[^"]*")?\\)') AS m FROM crawled_data WHERE markdown IS NOT NULL), e AS (SELECT page_id, generate_subscripts(m, 1) AS pos, unnest(m) AS x FROM m), u AS (SELECT page_id, pos, regexp_extract(x, '\\]\\(([^)\\s]+)', 1) AS url FROM e), f AS (SELECT page_id, url, min(pos) AS pos FROM u GROUP BY ALL)
SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS number FROM f""")
def d5_citations(spark: SparkSession, d: str) -> DataFrame:
    cited = pages.citations(_pages(spark, d).where("markdown is not null"), "page_id", "markdown")
    return cited.select("page_id", F.explode("numbers").alias("n")).select("page_id", "n.url", "n.number")


@query("""WITH a AS (SELECT doc_id, text, 'amount' AS pattern, '(\\d+) (km|days|cups)' AS p, 1 AS g FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, text, 'date', '(\\d{4})-(\\d{2})', 0 FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, pattern, CASE WHEN pattern = 'amount' THEN regexp_extract_all(text, '(\\d+) (km|days|cups)', 1) ELSE regexp_extract_all(text, '(\\d{4})-(\\d{2})', 0) END AS v, CASE WHEN pattern = 'amount' THEN regexp_extract_all(text, '(\\d+) (km|days|cups)', 2) ELSE regexp_extract_all(text, '(\\d{4})-(\\d{2})', 2) END AS w FROM a)
SELECT doc_id, pattern, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, unnest(v) AS value, unnest(w) AS second FROM m""")
def x5_groups(spark: SparkSession, d: str) -> DataFrame:
    wanted = [("amount", r"(\d+) (?<second>km|days|cups)", 1), ("date", r"(\d{4})-(?<second>\d{2})", 7)]
    got = patterns.extract_groups(_docs(spark, d).select("doc_id", "text"), "text", wanted)
    return got.select("doc_id", "pattern", "pos", "value", F.element_at("named", "second").alias("second"))


_BOUNDED = [n for n, p in patterns.CLASSIC.items() if r"\b" in p]
_UNBOUNDED = [n for n in patterns.CLASSIC if n not in _BOUNDED]


def _classic_sql() -> str:
    # DuckDB's classes are those of ASCII, the catalog's of all scripts
    wide = lambda p: p.replace(r"[\w]", r"[\p{L}\p{M}\p{N}_]").replace(r"[\w", r"[\p{L}\p{M}\p{N}_").replace(r"\d", r"\p{Nd}").replace(chr(39), chr(39) * 2)
    parts = [f"SELECT doc_id, '{n}' AS label, regexp_extract_all(text, '(?im){wide(patterns.CLASSIC[n])}') AS m FROM documents WHERE text IS NOT NULL" for n in _UNBOUNDED]
    return f"WITH a AS ({' UNION ALL '.join(parts)}) SELECT doc_id, label, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS pos, unnest(m) AS value FROM a"


@query(_classic_sql())
def x7_classic_values(spark: SparkSession, d: str) -> DataFrame:
    return patterns.classic_values(_docs(spark, d).select("doc_id", "text"), "text", _UNBOUNDED).drop("text")


@query()
def x7_bounded_values(spark: SparkSession, d: str) -> DataFrame:
    return patterns.classic_values(_docs(spark, d).select("doc_id", "text"), "text", _BOUNDED).drop("text")


@query()
def x7_classic_spans(spark: SparkSession, d: str) -> DataFrame:
    return patterns.classic_spans(_docs(spark, d), "doc_id", "text")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^0-9A-Za-z\\x{100}-\\x{10FFFF}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(w) AS INTEGER) AS n, sha256(array_to_string(w, ' ')) AS hash FROM w""")
def c20_symbol_words(spark: SparkSession, d: str) -> DataFrame:
    w = _docs(spark, d).select("doc_id", filters.symbol_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n"), F.sha2(F.array_join("w", " "), 256).alias("hash"))


@query(f"WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN n <= 100 THEN text ELSE substr(text, 1, 97) || '...' END AS short, sha256(replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')) AS escaped_hash FROM t")
def d30_short_and_escaped(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.shortened(F.col("text"), 100).alias("short"), F.sha2(text.escaped_json(F.col("text")), 256).alias("escaped_hash"))


@query(f"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, w, CAST(greatest(0, floor((len(w) - 300 / 0.75) / 360 + 1e-9) + 1) AS INTEGER) AS full_runs FROM w), c AS (SELECT doc_id, w, full_runs, unnest(range(0, full_runs + 1)) AS i FROM f), x AS (SELECT doc_id, i AS pos, array_to_string(CASE WHEN i < full_runs THEN w[i * 360 + 1 : i * 360 + 360] ELSE w[full_runs * 360 + 1 :] END, ' ') AS t FROM c) SELECT doc_id, CAST(pos AS INTEGER) AS pos, sha256(t) AS hash FROM x WHERE t <> ''")
def h14_queued_words(spark: SparkSession, d: str) -> DataFrame:
    c = _docs(spark, d).select("doc_id", F.posexplode(chunks.queued_words(F.col("text"), 300, 30)).alias("pos", "c"))
    return c.select("doc_id", "pos", F.sha2("c", 256).alias("hash"))


@query(f"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, w, CAST(ceil(len(w) / 200.0) AS INTEGER) AS runs FROM w WHERE len(w) > 0), e AS (SELECT doc_id, w, runs, unnest(range(0, runs)) AS i FROM c), x AS (SELECT doc_id, i AS pos, array_to_string(CASE WHEN i = runs - 1 THEN w[i * 180 + 1 :] ELSE w[i * 180 + 1 : i * 180 + 200] END, ' ') AS t FROM e) SELECT doc_id, CAST(pos AS INTEGER) AS pos, sha256(t) AS hash FROM x WHERE t <> ''")
def h14_merged_to_size(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("text", "\n")
    c = _docs(spark, d).select("doc_id", F.posexplode(chunks.merged_to_size(parts, 200, 20)).alias("pos", "c"))
    return c.select("doc_id", "pos", F.sha2("c", 256).alias("hash"))


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS c FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, i, c, CAST(len(list_filter(regexp_split_to_array(c, '{_WS}+'), lambda x: x <> '')) * 1.3 AS DOUBLE) AS n FROM p),
r AS (SELECT doc_id, i, n AS total, 0 AS chunk FROM n WHERE i = 1 UNION ALL SELECT n.doc_id, n.i, CASE WHEN r.total + n.n < 150 THEN r.total + n.n ELSE n.n END, CASE WHEN r.total + n.n < 150 THEN r.chunk ELSE r.chunk + 1 END FROM r JOIN n ON n.doc_id = r.doc_id AND n.i = r.i + 1)
SELECT doc_id, CAST(chunk AS INTEGER) AS pos, sha256(string_agg(c, chr(10) || chr(10) ORDER BY i)) AS hash FROM r JOIN n USING (doc_id, i) GROUP BY doc_id, chunk""")
def h14_merged_below(spark: SparkSession, d: str) -> DataFrame:
    c = _docs(spark, d).select("doc_id", F.posexplode(chunks.merged_below(F.split("text", "\n"), 150)).alias("pos", "c"))
    return c.select("doc_id", "pos", F.sha2("c", 256).alias("hash"))


@query("WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\\t\\n\\f\\r ]+', ' ', 'g'), ' ') AS t FROM crawled_data WHERE html IS NOT NULL) SELECT page_id, CAST(CASE WHEN strlen(t) > 20 THEN 1 ELSE 0 END AS INTEGER) AS blocks FROM t")
def h13_text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark, d).select("page_id", F.size(chunks.text_blocks(F.col("html"))).alias("blocks"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def h15_whole(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode(chunks.whole(F.col("text"))).alias("c")).select("doc_id", F.sha2("c", 256).alias("hash"))


@query("WITH i AS (SELECT page_id, unnest(from_json(json_extract(media, '$.images'), '[\"JSON\"]')) AS x FROM crawled_data WHERE media IS NOT NULL) SELECT page_id, count(*) AS images FROM i GROUP BY page_id")
def s16_media_rows(spark: SparkSession, d: str) -> DataFrame:
    from webloom.sources.crawl import json_items

    return json_items(_pages(spark, d), "media", "$.images").groupBy("page_id").agg(F.count(F.lit(1)).alias("images"))


# ---- what a crawl knows -------------------------------------------------------------------------------------


_TERMS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '[\\t\\n\\v\\f\\r ]+'), lambda x: length(x) >= 3))"


@query(f"WITH t AS (SELECT item_id, {_TERMS} AS t FROM benchmark WHERE text IS NOT NULL), p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS n, len(b.t) AS m FROM t a JOIN t b ON a.item_id < b.item_id) SELECT a, b, round(i / (n + m - i), 6) AS overlap FROM p WHERE i / (n + m - i) >= 0.1 - 1e-9")
def j7_overlapping(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.overlapping(table(spark, d, "benchmark"), "item_id", "text", 0.1)


@query(f"WITH t AS (SELECT item_id, {_TERMS} AS t FROM benchmark WHERE text IS NOT NULL), p AS (SELECT len(list_intersect(a.t, b.t)) AS i, len(a.t) AS n, len(b.t) AS m FROM t a JOIN t b ON a.item_id < b.item_id) SELECT round(avg(i / (n + m - i)), 6) AS consistency FROM p")
def a12_mean_overlap(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.mean_overlap(table(spark, d, "benchmark"), "item_id", "text")


@query(f"WITH w AS (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '[\\t\\n\\v\\f\\r ]+') AS w FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(w) AS term FROM w), t AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM x WHERE length(term) >= 3 GROUP BY term), n AS (SELECT (SELECT count(*) FROM w) AS docs, max(tf) AS top FROM t) SELECT round(least(1.0, sqrt(sum(df / docs * (1 + 0.5 * ln(1 + tf) / ln(1 + top))) / 4)), 6) AS coverage FROM t, n WHERE term IN ('river', 'museum', 'winter', 'zeppelin')")
def a12_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    each = docs.select("doc_id", F.explode(filters.letter_words(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    terms = each.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
    return knowledge.classic_coverage(terms, ["river", "museum", "winter", "zeppelin"], docs.count())


@query("""WITH h AS (SELECT doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL), e AS (SELECT arg_max(n_chars, doc_id) AS last, arg_min(n_chars, doc_id) AS first FROM h) SELECT round(greatest(0.0, least(1.0, 1 - greatest(last, 1) / greatest(first, 1))), 6) AS saturation FROM e""")
def a12_saturation(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.classic_saturation(table(spark, d, "documents").where("n_chars is not null").select("doc_id", "n_chars"), "doc_id", "n_chars")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all, queries: ids divisible by 50, known: the rest)."""
    v = table(spark, d, "embeddings").where("embedding is not null")
    return v, v.where("vec_id % 50 = 0"), v.where("vec_id % 50 <> 0")


_COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[]))"
_GAPS = f"g AS (SELECT q.vec_id AS query_id, round(1 - max(round({_COS}, 6)), 6) AS gap FROM embeddings q, embeddings k WHERE q.vec_id % 50 = 0 AND k.vec_id % 50 <> 0 AND q.embedding IS NOT NULL AND k.embedding IS NOT NULL GROUP BY 1)"


@query(f"WITH {_GAPS} SELECT * FROM g")
def a17_gaps(spark: SparkSession, d: str) -> DataFrame:
    _, asked, known = _vectors(spark, d)
    return knowledge.gaps(known, asked)


@query(f"WITH {_GAPS} SELECT round(avg(1 - gap), 6) AS confidence, round(max(gap), 6) AS widest FROM g")
def a17_validation(spark: SparkSession, d: str) -> DataFrame:
    _, asked, known = _vectors(spark, d)
    return knowledge.validation(knowledge.gaps(known, asked))


@query(f"""WITH {_GAPS}, w AS (SELECT e.embedding, gap FROM g JOIN embeddings e ON e.vec_id = query_id WHERE gap > 0.2), n AS (SELECT count(*) AS need FROM w),
gain AS (SELECT k.vec_id, sum(greatest(0, q.gap - (1 - {_COS}))) AS gain FROM embeddings k, w q WHERE k.embedding IS NOT NULL GROUP BY 1), near AS (SELECT k.vec_id, max({_COS}) AS near FROM embeddings k, embeddings q WHERE q.vec_id % 50 = 0 AND k.embedding IS NOT NULL AND q.embedding IS NOT NULL GROUP BY 1)
SELECT vec_id, round(coalesce(gain, 0) * 2 / greatest(1, need) * (1 - CASE WHEN near > 0.85 THEN (near - 0.85) * 2 ELSE 0 END), 6) AS score FROM near LEFT JOIN gain USING (vec_id), n""")
def r17_expansion(spark: SparkSession, d: str) -> DataFrame:
    every, asked, known = _vectors(spark, d)
    return knowledge.expansion(every, knowledge.gaps(known, asked), asked, asked)


@query(f"SELECT q.vec_id FROM embeddings q, embeddings k WHERE q.vec_id % 50 = 0 AND k.vec_id % 50 <> 0 AND q.embedding IS NOT NULL AND k.embedding IS NOT NULL GROUP BY q.vec_id HAVING max(round({_COS}, 6)) < 0.6")
def r22_novel(spark: SparkSession, d: str) -> DataFrame:
    _, asked, known = _vectors(spark, d)
    return knowledge.novel(asked, known, 0.6)


@query("""WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), u AS (SELECT label, vec_id, generate_subscripts(e, 1) AS dim, unnest(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))) AS x FROM v WHERE list_dot_product(e, e) > 0),
s AS (SELECT label, vec_id, sum(x) OVER w AS s, count(*) OVER w AS k FROM u WINDOW w AS (PARTITION BY label, dim ORDER BY vec_id ROWS UNBOUNDED PRECEDING)), a AS (SELECT label, vec_id, CASE WHEN max(k) > 1 THEN round(1 - (sum(s * s) - max(k)) / (max(k) * (max(k) - 1)), 6) ELSE 0.0 END AS coverage FROM s GROUP BY ALL),
t AS (SELECT label, min(vec_id) AS stop FROM a WHERE coverage >= 0.3 GROUP BY label) SELECT label, vec_id, coverage FROM a LEFT JOIN t USING (label) WHERE stop IS NULL OR vec_id <= stop""")
def a15_until_covered(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.until_covered(table(spark, d, "embeddings").where("embedding is not null"), "label", "vec_id", threshold=0.3)


@query("""WITH l AS (SELECT DISTINCT dst_url, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '[\\t\\n\\v\\f\\r ]+'), lambda x: length(x) >= 3))) AS t FROM site_links WHERE dst_url IS NOT NULL),
b AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '[\\t\\n\\v\\f\\r ]+'), lambda x: length(x) >= 3)) AS term FROM benchmark WHERE text IS NOT NULL), k AS (SELECT list(term) AS k FROM b),
s AS (SELECT dst_url, CASE WHEN len(t) = 0 THEN 0.0 ELSE len(list_intersect(t, ['museum', 'garden', 'news'])) / 3.0 END::DOUBLE AS relevance, CASE WHEN len(t) = 0 THEN 0.5 ELSE len(list_filter(t, lambda x: NOT list_contains(k, x))) / len(t) END::DOUBLE AS novelty FROM l, k),
m AS (SELECT dst_url, max(struct_pack(score := 0.5 * relevance + 0.3 * novelty + 0.2, relevance := relevance, novelty := novelty)) AS m FROM s GROUP BY dst_url) SELECT dst_url, round(m.relevance, 6) AS relevance, round(m.novelty, 6) AS novelty, round(m.score, 6) AS score FROM m""")
def r16_rank_links(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "benchmark").where("text is not null").select(F.explode(filters.letter_words(F.col("text"))).alias("term"))
    return knowledge.rank_links(table(spark, d, "site_links"), known, "museum garden news")


def _seed(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("url like 'https://lanternquay-gazette.example/%'").agg(F.min("url").alias("url"))


@query("""WITH RECURSIVE f AS (SELECT DISTINCT url FROM crawl_cache WHERE url IS NOT NULL UNION SELECT DISTINCT url FROM crawled_data WHERE url IS NOT NULL), e AS (SELECT DISTINCT src_url, dst_url FROM site_links WHERE src_url IS NOT NULL AND dst_url IS NOT NULL),
b(url, depth) AS (SELECT url, 0 FROM (SELECT min(url) AS url FROM crawled_data WHERE url LIKE 'https://lanternquay-gazette.example/%') WHERE url IS NOT NULL UNION SELECT e.dst_url, b.depth + 1 FROM b JOIN f ON b.url = f.url JOIN e ON b.url = e.src_url WHERE b.depth < 3),
m AS (SELECT url, min(depth) AS depth FROM b GROUP BY url) SELECT m.url, CAST(depth AS INTEGER) AS depth, f.url IS NOT NULL AS ok FROM m LEFT JOIN f USING (url)""")
def t7_classic_levels(spark: SparkSession, d: str) -> DataFrame:
    fetched = table(spark, d, "crawl_cache").select("url").unionByName(_pages(spark, d).select("url")).where("url is not null")
    return graph.classic_breadth_first(table(spark, d, "site_links"), _seed(spark, d), fetched, max_pages=10**9).select("url", "depth", "ok")


@query()
def t8_classic_depth_first(spark: SparkSession, d: str) -> DataFrame:
    return graph.depth_first(table(spark, d, "site_links"), _seed(spark, d), max_pages=20, fetched=_pages(spark, d).select("url"))


@query()
def t9_classic_best_first(spark: SparkSession, d: str) -> DataFrame:
    score = urls.composite_score([(urls.keyword_score(F.col("url"), ["museum", "garden"]), 0.6), (urls.depth_score(F.col("url")), 0.4)])
    return graph.best_first(table(spark, d, "site_links"), _seed(spark, d), score, max_pages=30, classic=True)


_PREVIEWS = "(SELECT page_id AS doc_id, coalesce(json_extract_string(metadata, '$.title'), '') || ' ' || coalesce(json_extract_string(metadata, '$.description'), '') AS text FROM crawled_data)"


@query(f"WITH {_stemmed(source=_PREVIEWS)}, {_BM25} SELECT doc_id AS page_id, score FROM s")
def r3_previews(spark: SparkSession, d: str) -> DataFrame:
    get = lambda k: F.coalesce(F.get_json_object("metadata", f"$.{k}"), F.lit(""))
    return rank.bm25(_pages(spark, d).select("page_id", F.concat(get("title"), F.lit(" "), get("description")).alias("preview")), "page_id", "preview", _ASKED)


# ---- sources, streams and small functions -------------------------------------------------------------------


@query(f"SELECT normal AS url, CAST(min(page_id) AS VARCHAR) AS timestamp FROM crawled_data JOIN ({SQL['c1_normalize_content']}) USING (url) WHERE url <> '' GROUP BY normal")
def s9_capture_index(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).where("url is not null").select("url", F.lpad(F.col("page_id").cast("string"), 20, "0").alias("timestamp"), F.lit("text/html; charset=utf-8").alias("mime"), F.lit("200").alias("status"))
    found = crawl.capture_index(rows.select(F.to_json(F.struct("url", "timestamp", "mime", "status")).alias("value")))
    return found.select("url", F.col("timestamp").cast("long").cast("string").alias("timestamp"))


@query("SELECT CAST(page_id AS VARCHAR) AS source, page_id % 10 / 10.0 AS priority, count(*) AS entries FROM crawled_data WHERE url IS NOT NULL GROUP BY ALL")
def s7_sitemap_entries(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("<urlset><url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>2024-05-06</lastmod><priority>"), (F.col("page_id") % 10 / 10.0).cast("string"), F.lit("</priority></url></urlset>"))
    files = _pages(spark, d).where("url is not null").select(F.col("page_id").cast("string").alias("source"), body.alias("body"))
    return crawl.sitemap_urls(files).groupBy("source", "priority").agg(F.count("lastmod").alias("entries"))


@query("SELECT CAST(page_id AS VARCHAR) AS host, 'https://h.example/' || page_id || '.xml' AS url FROM crawled_data")
def s8_robots_sitemaps(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("User-agent: *\nDisallow: /x\n siteMAP: https://h.example/"), F.col("page_id").cast("string"), F.lit(".xml \nSitemap:\n"))
    return crawl.robots_sitemaps(_pages(spark, d).select(F.col("page_id").cast("string").alias("host"), body.alias("body")))


@query("SELECT DISTINCT user_id, event_type FROM events")
def w4_first_seen(spark: SparkSession, d: str) -> DataFrame:
    events = streaming.bounded_stream(spark, f"{d}/events*.parquet", table(spark, d, "events")._jdf.schema().toDDL(), 10)
    urls_of = events.select(F.concat_ws(" ", "user_id", "event_type").alias("url"), "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return streaming.drain(streaming.first_seen(urls_of, delay="3650 days"), "first").select("user_id", "event_type")


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'error'")
def w1_emitted(spark: SparkSession, d: str) -> DataFrame:
    events = streaming.bounded_stream(spark, f"{d}/events*.parquet", table(spark, d, "events")._jdf.schema().toDDL(), 10)
    return streaming.drain(events.where("event_type = 'error'").select("event_id", "event_type", "value"), "emitted")


@query(f"WITH p AS (SELECT url, max(markdown) AS a FROM crawled_data WHERE url IS NOT NULL AND markdown IS NOT NULL GROUP BY url), c AS (SELECT url, max(markdown) AS b FROM crawl_cache WHERE url IS NOT NULL AND markdown IS NOT NULL GROUP BY url), w AS (SELECT url, list_distinct({_words('a')}) AS a, list_distinct({_words('b')}) AS b FROM p JOIN c USING (url)), i AS (SELECT *, len(list_intersect(a, b)) AS i FROM w) SELECT url, round(CASE WHEN len(a) + len(b) - i > 0 THEN i / (len(a) + len(b) - i) ELSE 0 END, 6) AS jaccard, round(CASE WHEN least(len(a), len(b)) > 0 THEN i / least(len(a), len(b)) ELSE 0 END, 6) AS smaller FROM i")
def u3_overlap(spark: SparkSession, d: str) -> DataFrame:
    per = lambda t, n: table(spark, d, t).where("url is not null and markdown is not null").groupBy("url").agg(F.max("markdown").alias(n))
    both = per("crawled_data", "a").join(per("crawl_cache", "b"), "url").select("url", text.overlap(text.words(F.col("a")), text.words(F.col("b"))).alias("o"))
    return both.select("url", F.round("o.jaccard", 6).alias("jaccard"), F.round("o.smaller", 6).alias("smaller"))


@query(f"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, w, CASE WHEN len(w) <= 100 THEN [1::BIGINT] ELSE list_concat(range(1, len(w) - 100 + 2, 60), CASE WHEN (len(w) - 100) % 60 <> 0 THEN [len(w) - 100 + 1] ELSE [] END) END AS starts FROM w), e AS (SELECT doc_id, w, generate_subscripts(starts, 1) - 1 AS pos, unnest(starts) AS a FROM s) SELECT doc_id, CAST(pos AS INTEGER) AS pos, sha256(array_to_string(w[a : a + 99], ' ')) AS hash FROM e")
def h11_aligned_windows(spark: SparkSession, d: str) -> DataFrame:
    c = _docs(spark, d).select("doc_id", F.posexplode(chunks.aligned_word_windows(F.col("text"), 100, 60)).alias("pos", "c"))
    return c.select("doc_id", "pos", F.sha2("c", 256).alias("hash"))


@query("SELECT page_id, CAST(len(list_filter(regexp_extract_all(media, '\\{[^{}]*\\}'), lambda x: json_valid(x))) AS INTEGER) AS objects FROM crawled_data WHERE media IS NOT NULL")
def x14_json_objects(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("media is not null").select("page_id", F.size(text.json_objects(F.col("media"))).alias("objects"))


@query()
def c8_xxh64(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.xxh64(F.col("text")).alias("hash"))


@query("WITH q AS (SELECT page_id, lower(coalesce(json_extract_string(metadata, '$.title'), '')) AS t FROM crawled_data) SELECT page_id FROM q WHERE contains(t, 'garden')")
def f29_search_entries(spark: SparkSession, d: str) -> DataFrame:
    entries = _pages(spark, d).select("page_id", F.get_json_object("metadata", "$.title").alias("title"), F.lit("").alias("summary"))
    return pipelines.search_entries(entries, "Garden", ["title", "summary"]).select("page_id")
