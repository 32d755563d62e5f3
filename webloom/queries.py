"""Queries of the engine's own operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import patterns, scoring, text, urls
from webloom.operators import chunks, diff, graph, pages, rank, stats, vectors
from webloom.plans import pipelines
from webloom.session import table
from webloom.sources import crawl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_WS = r"[\t\n\v\f\r ]"
_WIDE = r"""^[.,;:!?"''()\[\]{}<>\-_/\\@#$%^&*+=~`]+|[.,;:!?"''()\[\]{}<>\-_/\\@#$%^&*+=~`]+$"""
_EDGE = r"""^[.,;:!?"''()\[\]{}]+|[.,;:!?"''()\[\]{}]+$"""
_EDGES = "^[\\t\\n\\v\\f\\r ]+|[\\t\\n\\v\\f\\r ]+$"
_PART = r"'^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"


def _part(n: int, url: str = "url") -> str:
    return f"regexp_extract({url}, {_PART}, {n})"


def _host(url: str = "url") -> str:
    return f"lower(regexp_replace(regexp_replace({_part(2, url)}, '^[^@]*@', ''), ':\\d*$', ''))"


def _words(column: str, edge: str = _WIDE) -> str:
    return f"list_filter(list_transform(list_filter(regexp_split_to_array(lower({column}), '{_WS}+'), lambda x: x <> ''), lambda x: regexp_replace(x, '{edge}', '', 'g')), lambda x: x <> '')"


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawled_data")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


# ---- text ---------------------------------------------------------------------------------------------------


_HTML_TEXT = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\\t\\n\\f\\r ]+', ' ', 'g'), ' ')"


@query(f"SELECT page_id, {_HTML_TEXT} AS text FROM crawled_data")
def d1_html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query(f"""WITH w AS (SELECT doc_id, text, {_words('text')} AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(w) AS INTEGER) AS word_count, CAST(len(list_distinct(list_filter(w, lambda x: strlen(x) >= 3 AND x NOT IN ({_STOP})))) AS INTEGER) AS unique_words, CAST(strlen(text) AS INTEGER) AS char_count,
CAST(len(regexp_extract_all(text, '[.!?]')) AS INTEGER) AS sentence_count,
CAST(len(regexp_extract_all(array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_replace(x, '{_WS}', '', 'g') = '' THEN '0' ELSE '1' END), ''), '1+')) AS INTEGER) AS paragraph_count FROM w""")
def a1_word_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.word_stats(_docs(spark, d), "doc_id", "text")


_TOP = "SELECT doc_id, term, count, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, term) AS rank FROM c) WHERE rank <= 10"


@query(f"""WITH w AS (SELECT doc_id, unnest({_words('text')}) AS term FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, term, count(*) AS count FROM w WHERE strlen(term) >= 3 AND term NOT IN ({_STOP}) GROUP BY ALL) {_TOP}""")
def a1_top_words(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_terms(_docs(spark, d), "doc_id", "text", 10)


@query(f"""WITH w AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(list_zip(w[1:len(w)-1], w[2:])) AS p FROM w WHERE len(w) > 1),
c AS (SELECT doc_id, p[1] || ' ' || p[2] AS term, count(*) AS count FROM p WHERE strlen(p[1]) >= 2 AND strlen(p[2]) >= 2 AND p[1] NOT IN ({_STOP}) AND p[2] NOT IN ({_STOP}) GROUP BY ALL) {_TOP}""")
def a1_top_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_terms(_docs(spark, d), "doc_id", "text", 10, bigrams=True)


_SYL = "CASE WHEN strlen(x) <= 2 THEN 1 ELSE greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN x LIKE '%e' AND x NOT LIKE '%le' THEN 1 ELSE 0 END - CASE WHEN regexp_matches(x, '[^td]ed$') AND strlen(x) > 3 THEN 1 ELSE 0 END) END"


@query(f"""WITH w AS (SELECT doc_id, list_transform(list_transform(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> ''), lambda x: lower(regexp_replace(x, '{_EDGE}', '', 'g'))), lambda x: {_SYL}) AS s, greatest(1, len(regexp_extract_all(text, '[.!?]'))) AS sents FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, len(s) AS n, sents, CAST(coalesce(list_sum(s), 0) AS BIGINT) AS syl, len(list_filter(s, lambda x: x >= 3)) AS hard FROM w),
r AS (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE floor((0.39::DOUBLE * (n::DOUBLE / sents) + 11.8::DOUBLE * (syl::DOUBLE / n) - 15.59::DOUBLE) * 100 + 0.5) / 100.0 END AS fk FROM v)
SELECT doc_id, CAST(n AS INTEGER) AS word_count, CAST(CASE WHEN n = 0 THEN 0 ELSE sents END AS INTEGER) AS sentence_count, CAST(syl AS INTEGER) AS syllable_count, fk AS flesch_kincaid,
CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE floor((206.835::DOUBLE - 1.015::DOUBLE * (n::DOUBLE / sents) - 84.6::DOUBLE * (syl::DOUBLE / n)) * 100 + 0.5) / 100.0 END AS flesch_reading_ease, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE floor((0.4::DOUBLE * (n::DOUBLE / sents + 100::DOUBLE * hard / n)) * 100 + 0.5) / 100.0 END AS gunning_fog,
CASE WHEN n = 0 THEN '' WHEN fk < 1 THEN 'kindergarten' WHEN fk < 6 THEN 'elementary' WHEN fk < 9 THEN 'middle_school' WHEN fk < 13 THEN 'high_school' WHEN fk < 17 THEN 'college' ELSE 'graduate' END AS reading_level FROM r""")
def a2_readability(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.readability(F.col("text")).alias("r")).select("doc_id", "r.*")


def _language_sql() -> str:
    hits = ", ".join(f"len(list_intersect(seen, [{', '.join(repr(w) for w in ws.split())}])) AS h_{k}" for k, ws in text.LANGUAGE_WORDS.items())
    names = {"latin": "[A-Za-z\\x{AA}\\x{B5}\\x{BA}\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]", "cyrillic": "[\\x{400}-\\x{481}\\x{48A}-\\x{4FF}]", "cjk": "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3041}-\\x{3096}\\x{309D}-\\x{309F}\\x{30A1}-\\x{30FA}\\x{30FC}-\\x{30FF}]"}
    counts = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS n_{k}" for k, p in names.items())
    best = f"greatest({', '.join(f'h_{k}' for k in text.LANGUAGE_WORDS)})"
    latin = " ".join(f"WHEN h_{k} = {best} THEN '{k}'" for k in text.LANGUAGE_WORDS)
    return f"""WITH a AS (SELECT doc_id, text, list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}\\-\\x{{AD}}\\x{{2010}}]+')) AS seen, len(regexp_extract_all(text, '\\p{{L}}')) AS letters, {counts} FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, {hits} FROM a), c AS (SELECT *, greatest(n_latin, n_cyrillic, n_cjk) AS top, {best} AS best FROM b),
s AS (SELECT *, CASE WHEN regexp_replace(text, '{_WS}', '', 'g') = '' THEN 'unknown' WHEN letters = 0 OR top < 0.3 * letters OR n_latin = top THEN 'latin' WHEN n_cyrillic = top THEN 'cyrillic' ELSE 'cjk' END AS script FROM c)
SELECT doc_id, CASE script WHEN 'unknown' THEN 'unknown' WHEN 'cjk' THEN CASE WHEN regexp_matches(text, '[\\x{{3040}}-\\x{{30FF}}]') THEN 'ja' ELSE 'zh' END WHEN 'cyrillic' THEN 'ru' ELSE CASE WHEN best = 0 THEN 'unknown' {latin} END END AS language,
CASE script WHEN 'unknown' THEN 0.0 WHEN 'cjk' THEN 0.8 WHEN 'cyrillic' THEN 0.75 ELSE best / 20.0 END AS confidence, script FROM s"""


@query(_language_sql())
def c12_language(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.language(F.col("text")).alias("r")).select("doc_id", "r.*")


@query(f"SELECT doc_id, CAST(ceil(len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '')) / 0.75) AS BIGINT) AS tokens, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def c15_tokens_and_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.content_hash(F.col("text")).alias("hash"))


# ---- urls ---------------------------------------------------------------------------------------------------


def _normal_sql(crawl: bool) -> str:
    drop = ", ".join(f"'{p}'" for p in (urls.TRACKING_CRAWL if crawl else urls.TRACKING))
    scheme = f"lower({_part(1)})" if crawl else _part(1)
    place = f"CASE {scheme} WHEN 'http' THEN regexp_replace(lower({_part(2)}), ':80$', '') WHEN 'https' THEN regexp_replace(lower({_part(2)}), ':443$', '') ELSE lower({_part(2)}) END" if crawl else f"lower({_part(2)})"
    chosen = "q" if crawl else "CASE WHEN len(kept) = len(pairs) THEN raw ELSE q END"
    return f"""WITH a AS (SELECT DISTINCT url FROM crawled_data WHERE url IS NOT NULL UNION SELECT DISTINCT dst_url FROM site_links WHERE dst_url IS NOT NULL),
p AS (SELECT url, {scheme} AS scheme, {place} AS place, regexp_replace({_part(3)}, '/+$', '') AS path, {_part(4)} AS raw, list_filter(string_split({_part(4)}, '&'), lambda x: x <> '') AS pairs FROM a),
k AS (SELECT *, list_filter(pairs, lambda x: lower(split_part(x, '=', 1)) NOT IN ({drop})) AS kept FROM p),
s AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(kept, lambda x: {{'k': split_part(x, '=', 1), 'v': CASE WHEN contains(x, '=') THEN x ELSE x || '=' END}})), lambda x: x.v), '&') AS q FROM k)
SELECT url, scheme || '://' || place || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN {chosen} = '' THEN '' ELSE '?' || {chosen} END AS normal FROM s"""


def _all_urls(spark: SparkSession, d: str) -> DataFrame:
    one, two = _pages(spark, d).select("url"), table(spark, d, "site_links").select(F.col("dst_url").alias("url"))
    return one.unionByName(two).where("url is not null").distinct()


@query(_normal_sql(False))
def c1_normalize_content(spark: SparkSession, d: str) -> DataFrame:
    return _all_urls(spark, d).select("url", urls.normalize(F.col("url")).alias("normal"))


@query(_normal_sql(True))
def c2_normalize_crawl(spark: SparkSession, d: str) -> DataFrame:
    return _all_urls(spark, d).select("url", urls.normalize(F.col("url"), "crawl").alias("normal"))


_BASE = "regexp_replace({0}, '^www\\.', '')"


@query(f"""SELECT DISTINCT src_url, dst_url, {_BASE.format(_host('src_url'))} AS base, NOT ({_BASE.format(_host('dst_url'))} = {_BASE.format(_host('src_url'))} OR {_BASE.format(_host('dst_url'))} LIKE '%.' || {_BASE.format(_host('src_url'))}) AS external FROM site_links WHERE src_url IS NOT NULL AND dst_url IS NOT NULL""")
def c5_external_links(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "site_links").where("src_url is not null and dst_url is not null").select("src_url", "dst_url", urls.base_domain(F.col("src_url")).alias("base"))
    return links.withColumn("external", urls.is_external(F.col("dst_url"), F.col("base"))).distinct()


_EXT = f"lower(regexp_extract({_part(3)}, '\\.[^./]*$', 0))"


@query(f"""WITH a AS (SELECT DISTINCT url FROM crawled_data WHERE url IS NOT NULL UNION SELECT DISTINCT dst_url FROM site_links WHERE dst_url IS NOT NULL)
SELECT url FROM a WHERE regexp_matches(url, '(?i).*/news/.*|2024.11') AND NOT ({_host()} = 'lanternquay-gazette.example' OR {_host()} LIKE '%.lanternquay-gazette.example') AND {_EXT} IN ('', '.html')""")
def f1_filter_chain(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _all_urls(spark, d).where(urls.matches_globs(u, ["*/news/*", "2024?11"]) & urls.domain_allowed(u, blocked=["lanternquay-gazette.example"]) & urls.extension_allowed(u, ["", ".html"]))


def _scores_sql() -> str:
    low = "lower(url)"
    kw = f"(CAST(contains({low}, 'museum') AS INTEGER) + CAST(contains({low}, 'garden') AS INTEGER) + CAST(contains({low}, 'news') AS INTEGER)) / 3.0"
    path = f"trim({_part(3)}, '/')"
    depth = f"1.0 / (1.0 + abs(CASE WHEN {path} = '' THEN 0 ELSE len(string_split({path}, '/')) END - 2))"
    ext = "CASE " + " ".join(f"WHEN {_EXT} = '{e}' THEN {v}" for e, v in urls.EXTENSION_SCORES.items()) + " ELSE 0.5 END"
    year = f"try_cast(regexp_extract({_part(3)}, '(?:^|/)(\\d{{4}})[-/](\\d{{1,2}})(?:[-/](\\d{{1,2}}))?(?:/|$)', 1) AS INTEGER)"
    fresh = "CASE WHEN y IS NULL OR y < 1990 OR y > 2026 THEN 0.5 WHEN 2025 - y = 0 THEN 1.0 WHEN 2025 - y = 1 THEN 0.8 WHEN 2025 - y = 2 THEN 0.6 WHEN 2025 - y <= 4 THEN 0.4 ELSE 0.2 END"
    return f"""WITH a AS (SELECT DISTINCT url FROM crawled_data WHERE url IS NOT NULL UNION SELECT DISTINCT dst_url FROM site_links WHERE dst_url IS NOT NULL),
s AS (SELECT url, round({kw}, 6) AS keyword, round({depth}, 6) AS depth, CAST({ext} AS DOUBLE) AS kind, {year} AS y FROM a), t AS (SELECT *, CAST({fresh} AS DOUBLE) AS freshness FROM s)
SELECT url, CAST(keyword AS DOUBLE) AS keyword, CAST(depth AS DOUBLE) AS depth, kind, freshness, round((0.5 * keyword + 0.3 * depth + 0.2 * freshness) / 1.0, 6) AS score FROM t"""


@query(_scores_sql())
def r12_url_scores(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    one = _all_urls(spark, d).select("url", F.round(urls.keyword_score(u, ["museum", "garden", "news"]), 6).alias("keyword"), F.round(urls.depth_score(u), 6).alias("depth"), urls.content_type_score(u).alias("kind"), urls.freshness_score(u, 2025).alias("freshness"))
    return one.withColumn("score", F.round(urls.composite_score([(F.col("keyword"), 0.5), (F.col("depth"), 0.3), (F.col("freshness"), 0.2)]), 6))


# ---- patterns and block pages -------------------------------------------------------------------------------


def _patterns_sql(names: list[str]) -> str:
    parts = []
    for n in names:
        pattern, low, high = patterns.CATALOG[n]
        parts.append(f"SELECT doc_id, '{n}' AS pattern, list_filter(regexp_extract_all(text, '{pattern}'), lambda v: strlen(v) BETWEEN {low} AND {high}) AS m FROM documents WHERE text IS NOT NULL")
    return f"WITH a AS ({' UNION ALL '.join(parts)}) SELECT doc_id, pattern, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS pos, unnest(m) AS value FROM a"


@query(_patterns_sql(list(patterns.CATALOG)))
def x6_patterns(spark: SparkSession, d: str) -> DataFrame:
    return patterns.extract_patterns(_docs(spark, d).select("doc_id", "text"), "text").drop("text")


def _blocked_sql() -> str:
    code = "html"
    for p in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?is)<noscript[^>]*>.*?</noscript>"):
        code = f"regexp_replace({code}, '{p}', ' ', 'g')"
    head = "\n".join(f"WHEN regexp_matches(substr(html, 1, 15000), '{p}') THEN '{n}'" for p, n in patterns.BLOCK_ANY)
    small = "\n".join(f"WHEN size < 10000 AND regexp_matches(html, '{p}') THEN '{n}'" for p, n in patterns.BLOCK_SMALL)
    return f"""WITH c AS (SELECT url, max(status_code) AS status FROM crawl_cache GROUP BY url),
p AS (SELECT page_id, coalesce(status, 0) AS status, coalesce(html, '') AS html FROM crawled_data LEFT JOIN c USING (url)),
f AS (SELECT *, strlen(html) AS size, {code} AS code, NOT regexp_matches(html, '{patterns.CONTENT_TAGS}') AS bare FROM p),
g AS (SELECT *, strlen(trim(regexp_replace(regexp_replace(code, '<[^>]*>', '', 'g'), '[\\t\\n\\f\\r ]+', ' ', 'g'), ' ')) AS visible FROM f),
s AS (SELECT *, CAST(NOT regexp_matches(html, '(?i)<body') AS INTEGER) + CAST(visible < 50 AS INTEGER) + CAST(bare AS INTEGER) + CAST(regexp_matches(html, '(?i)<script[\\s>]') AND bare AND visible < 100 AS INTEGER) AS signals FROM g)
SELECT page_id, CASE WHEN status = 429 THEN 'rate limited (429)' WHEN status IN (403, 503) AND NOT regexp_matches(html, '^[\\t\\n\\f\\r ]*(\\{{|\\[|<\\?xml)') THEN 'blocked (' || status || ')'
{head} {small} WHEN status = 200 AND size < 100 THEN 'near-empty response' WHEN size < 50000 AND signals >= 2 THEN 'structural integrity failure' WHEN size < 50000 AND signals >= 1 AND size < 5000 THEN 'structural integrity failure (small page)' END AS reason FROM s"""


@query(_blocked_sql())
def f17_blocked(spark: SparkSession, d: str) -> DataFrame:
    status = table(spark, d, "crawl_cache").groupBy("url").agg(F.max("status_code").alias("status"))
    src = _pages(spark, d).select("page_id", "url", "html").join(status, "url", "left")
    return src.select("page_id", patterns.blocked_reason(F.col("status"), F.col("html")).alias("reason"))


# ---- chunks -------------------------------------------------------------------------------------------------


_TRIM = f"list_filter(list_transform({{0}}, lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '')"
_CHUNKS = "SELECT doc_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS chunk_index, unnest(c) AS chunk FROM a"


@query(f"WITH a AS (SELECT doc_id, {_TRIM.format('list_transform(range(0, CAST(greatest(0, ceil((length(text) - 400) / 300)) AS BIGINT) + 1), lambda i: substr(text, i * 300 + 1, 400))')} AS c FROM documents WHERE text <> '') {_CHUNKS}")
def h3_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunks.explode_chunks(_docs(spark, d).select("doc_id", "text"), chunks.overlapping_windows(F.col("text"), 400, 100)).drop("text")


_PARAS = _TRIM.format("regexp_split_to_array(text, '\\n')")


@query(f"WITH b AS (SELECT doc_id, text, {_PARAS} AS p FROM documents WHERE text <> ''), a AS (SELECT doc_id, CASE WHEN len(p) = 0 THEN [text] ELSE p END AS c FROM b) {_CHUNKS}")
def h6_regex_split(spark: SparkSession, d: str) -> DataFrame:
    return chunks.explode_chunks(_docs(spark, d).select("doc_id", "text"), chunks.regex_split(F.col("text"), "\n")).drop("text")


_SENT = _TRIM.format(f"string_split(regexp_replace(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), '\\n', chr(1), 'g'), chr(1))")


@query(f"WITH a AS (SELECT doc_id, {_SENT} AS c FROM documents WHERE text <> '') {_CHUNKS}")
def h8_sentences(spark: SparkSession, d: str) -> DataFrame:
    return chunks.explode_chunks(_docs(spark, d).select("doc_id", "text"), chunks.sentences(F.col("text"))).drop("text")


_FIELDS = f"list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '')"


@query(f"WITH w AS (SELECT doc_id, {_FIELDS} AS w FROM documents WHERE text IS NOT NULL), a AS (SELECT doc_id, list_transform(range(0, CAST(ceil(len(w) / 100) AS BIGINT)), lambda i: array_to_string(w[i * 100 + 1:i * 100 + 100], ' ')) AS c FROM w) {_CHUNKS}")
def h10_fixed_words(spark: SparkSession, d: str) -> DataFrame:
    return chunks.explode_chunks(_docs(spark, d).select("doc_id", "text"), chunks.word_windows(F.col("text"), 100)).drop("text")


@query(f"WITH w AS (SELECT doc_id, {_FIELDS} AS w FROM documents WHERE text IS NOT NULL), a AS (SELECT doc_id, list_transform(range(0, CAST(ceil(len(w) / 50) AS BIGINT)), lambda i: array_to_string(w[i * 50 + 1:i * 50 + 50], ' ')) AS c FROM w) {_CHUNKS}")
def h12_sections(spark: SparkSession, d: str) -> DataFrame:
    return chunks.explode_chunks(_docs(spark, d).select("doc_id", "text"), chunks.word_windows(F.col("text"), 50)).drop("text")


def _rfind(sign: str) -> str:
    return f"CASE WHEN contains(w, {sign}) THEN length(w) - length(string_split(w, {sign})[-1]) - length({sign}) ELSE -1 END"


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, text, n, 0::BIGINT AS start, 0::BIGINT AS stop, ''::VARCHAR AS piece, -1::BIGINT AS k, 0::BIGINT AS next FROM d UNION ALL
SELECT doc_id, text, n, start, stop, regexp_replace(substr(text, start + 1, stop - start), '{_EDGES}', '', 'g'), k + 1, CASE WHEN stop >= n THEN n ELSE greatest(stop - 50, start + 1) END FROM (
SELECT *, CASE WHEN start + 500 >= n THEN n WHEN c > 0 THEN start + c + 1 ELSE start + 500 END AS stop FROM (SELECT *, CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE e END AS c FROM (SELECT *, {_rfind("chr(10) || chr(10)")} AS a, greatest({_rfind("'. '")}, {_rfind("'! '")}, {_rfind("'? '")}) AS b, greatest({_rfind("' '")}, {_rfind("chr(10)")}) AS e FROM (SELECT doc_id, text, n, next AS start, k, substr(text, next + 1, 500) AS w FROM r WHERE next < n)))))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, piece AS chunk FROM r WHERE k >= 0 AND piece <> ''""")
def h2_fixed_size(spark: SparkSession, d: str) -> DataFrame:
    return chunks.greedy_chunks(_docs(spark, d).select("doc_id", "text"), "text", "fixed_size", size=500, overlap=50).drop("text")


@query()
def h1_token_aware(spark: SparkSession, d: str) -> DataFrame:
    src = _pages(spark, d).where("markdown is not null").select("page_id", "markdown")
    return chunks.greedy_chunks(src, "markdown", "token_aware", max_tokens=256, overlap=32).drop("markdown")


@query()
def h5_markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return chunks.greedy_chunks(_pages(spark, d).where("markdown is not null").select("page_id", "markdown"), "markdown", "markdown", max_chars=1500, split=True).drop("markdown")


@query(f"""WITH p AS (SELECT page_id, list_filter(list_transform(string_split(markdown, chr(10) || chr(10)), lambda x: regexp_replace(x, '{_EDGES}', '', 'g')), lambda x: x <> '') AS p FROM crawled_data WHERE markdown IS NOT NULL),
e AS (SELECT page_id, generate_subscripts(p, 1) AS i, unnest(p) AS t FROM p), w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(t), '{_WS}+'), lambda x: x <> '')) AS w FROM e), l AS (SELECT *, lag(w) OVER (PARTITION BY page_id ORDER BY i) AS b FROM w),
f AS (SELECT *, CASE WHEN b IS NULL OR least(len(w), len(b)) = 0 OR len(list_intersect(w, b)) / least(len(w), len(b)) < 0.1 THEN 1 ELSE 0 END AS fresh FROM l), g AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY i) - 1 AS g FROM f)
SELECT page_id, CAST(g AS INTEGER) AS chunk_index, string_agg(t, chr(10) || chr(10) ORDER BY i) AS chunk FROM g GROUP BY page_id, g""")
def h9_topics(spark: SparkSession, d: str) -> DataFrame:
    return chunks.explode_chunks(_pages(spark, d).where("markdown is not null").select("page_id", "markdown"), chunks.topics(F.col("markdown"))).drop("markdown")


# ---- joins, differences, cache ------------------------------------------------------------------------------


_LATEST = "SELECT url, markdown FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {0}) AS r FROM {1}) WHERE r = 1 AND markdown IS NOT NULL"
_LINES = f"SELECT url, line, count(*) AS n FROM (SELECT url, regexp_replace(unnest(string_split(markdown, chr(10))), '^{_WS}+|{_WS}+$', '', 'g') AS line FROM {{0}}) WHERE line <> '' GROUP BY ALL"


def _latest(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each url, without a window: the greatest of (order, columns) structs, combined before the shuffle."""
    newest = df.groupBy("url").agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("m"))
    return newest.select("url", *[f"m.{c}" for c in columns])


@query(f"""WITH o AS ({_LATEST.format('cache_id DESC', 'crawl_cache')}), n AS ({_LATEST.format('page_id DESC', 'crawled_data')}),
a AS ({_LINES.format('o')}), b AS ({_LINES.format('n')}), k AS (SELECT url FROM o JOIN n USING (url)),
j AS (SELECT coalesce(a.url, b.url) AS url, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.url = b.url AND a.line = b.line),
s AS (SELECT url, sum(greatest(y - x, 0)) AS added, sum(greatest(x - y, 0)) AS removed, sum(least(x, y)) AS unchanged, sum(CAST(x > 0 AS INTEGER) + CAST(y > 0 AS INTEGER)) AS kinds FROM j GROUP BY url)
SELECT url, CAST(coalesce(added, 0) AS BIGINT) AS added, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(unchanged, 0) AS BIGINT) AS unchanged, CASE WHEN coalesce(kinds, 0) > 0 THEN round(2.0 * unchanged / kinds, 6) ELSE 0.0 END AS similarity FROM k LEFT JOIN s USING (url)""")
def u2_line_diff(spark: SparkSession, d: str) -> DataFrame:
    old = _latest(table(spark, d, "crawl_cache"), ["cache_id"], ["cache_id", "markdown"])
    new = _latest(_pages(spark, d), ["page_id"], ["page_id", "markdown"])
    return diff.line_diff(old, new, "url", "markdown")


@query("SELECT DISTINCT dst_url AS url FROM site_links WHERE dst_url IS NOT NULL AND dst_url NOT IN (SELECT url FROM crawled_data WHERE url IS NOT NULL)")
def j1_undiscovered(spark: SparkSession, d: str) -> DataFrame:
    return graph.discover(table(spark, d, "site_links"), _pages(spark, d).select("url").distinct())


@query("SELECT c.cache_id, c.url, p.page_id, p.success FROM crawl_cache c LEFT JOIN (SELECT url, max(page_id) AS page_id, max_by(success, page_id) AS success FROM crawled_data GROUP BY url) p ON c.url = p.url")
def j8_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    newest = _latest(_pages(spark, d).where("url is not null"), ["page_id"], ["page_id", "success"])
    return table(spark, d, "crawl_cache").select("cache_id", "url").join(newest, "url", "left").select("cache_id", "url", "page_id", "success")


@query("SELECT url, max(cache_id) AS cache_id, 'cache' AS origin FROM crawl_cache WHERE url IS NOT NULL GROUP BY url UNION ALL SELECT url, max(page_id), 'pages' FROM crawled_data WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM crawl_cache WHERE url IS NOT NULL) GROUP BY url")
def s15_cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    per = lambda t, i, o: table(spark, d, t).where("url is not null").groupBy("url").agg(F.max(i).alias("cache_id")).withColumn("origin", F.lit(o))
    return crawl.upsert(per("crawled_data", "page_id", "pages"), per("crawl_cache", "cache_id", "cache"), "url")


# ---- aggregates ---------------------------------------------------------------------------------------------


@query(f"SELECT {_host()} AS host, count(*) AS pages, count(*) FILTER (WHERE NOT success) AS failed, count(DISTINCT url) AS urls, CAST(sum(strlen(html)) AS BIGINT) AS bytes, max(cached_at) AS last FROM crawled_data WHERE url IS NOT NULL GROUP BY ALL")
def a3_crawl_stats(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).where("url is not null").select(urls.host(F.col("url")).alias("host"), "url", "success", F.octet_length("html").alias("b"), "cached_at")
    # two steps, so that a host with a large share of all rows is counted in parts
    per_url = p.groupBy("host", "url").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("f"), F.sum("b").alias("b"), F.max("cached_at").alias("t"))
    return per_url.groupBy("host").agg(F.sum("n").alias("pages"), F.sum("f").alias("failed"), F.count("url").alias("urls"), F.sum("b").alias("bytes"), F.max("t").alias("last"))


@query(f"WITH a AS (SELECT {_BASE.format(_host())} AS domain, CASE WHEN success THEN 1.0 ELSE 0.2 END AS q FROM crawled_data WHERE url IS NOT NULL) SELECT domain, count(q) AS pages, round(avg(q), 6) AS mean, round(avg(q) * (1 + 0.1 * log2(count(q) + 1)), 6) AS score FROM a GROUP BY ALL ORDER BY score DESC, domain LIMIT 20")
def a5_domain_authority(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).where("url is not null").select(urls.base_domain(F.col("url")).alias("domain"), F.when(F.col("success"), 1.0).otherwise(0.2).alias("q"))
    return stats.domain_authority(p, "domain", "q").orderBy(F.desc("score"), "domain").limit(20)


@query("WITH e AS (SELECT user_id, event_id, ts, event_type, value, CASE WHEN event_type = 'error' THEN row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts DESC, event_id DESC) END AS k FROM events) SELECT user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value), 4) AS total, max(ts) AS last, coalesce(array_to_string(list(event_id ORDER BY k) FILTER (WHERE k <= 5), ','), '') AS last_errors FROM e GROUP BY user_id")
def a6_monitor(spark: SparkSession, d: str) -> DataFrame:
    return stats.monitor(table(spark, d, "events"), "user_id", "event_id", "ts", F.col("event_type") == "error", "value")


_TERMS = f"SELECT doc_id, unnest({_words('text')}) AS term FROM documents WHERE text IS NOT NULL"


@query(f"WITH w AS ({_TERMS}) SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w WHERE strlen(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY term")
def a7_term_statistics(spark: SparkSession, d: str) -> DataFrame:
    return stats.term_statistics(_docs(spark, d), "doc_id", "text")


@query(f"WITH w AS ({_TERMS}), n AS (SELECT count(*) AS docs FROM documents WHERE text IS NOT NULL), t AS (SELECT term, count(*) / max(docs) AS r FROM w, n WHERE strlen(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY term) SELECT round(1 / (1 + stddev_pop(r) / avg(r)), 6) AS consistency FROM t")
def a9_consistency(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return stats.consistency(stats.term_statistics(docs, "doc_id", "text"), docs.count())


@query(f"WITH w AS ({_TERMS}), f AS (SELECT term, min(doc_id) AS doc_id FROM w WHERE strlen(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY term) SELECT doc_id, count(*) AS terms FROM f GROUP BY doc_id")
def a13_new_terms(spark: SparkSession, d: str) -> DataFrame:
    return stats.new_terms(_docs(spark, d), "doc_id", "text", "doc_id")


# ---- relevance, vectors, traversal --------------------------------------------------------------------------


_QUERY = "river museum winter schedule"


_ASKED = "rivers museum winter schedules river"


def _stemmed(columns: str = "doc_id", source: str = "documents") -> str:
    """CTEs: w (columns, w), tf (doc_id, term, tf) of stems, q (term, times) of the query."""
    from webloom.functions import stem

    asked = ", ".join(f"'{t}'" for t in rank.query_tokens(_ASKED))
    return f"""w AS (SELECT {columns}, list_filter({_words('text', _EDGE)}, lambda x: strlen(x) >= 2 AND x NOT IN ({_STOP})) AS w FROM {source} WHERE text IS NOT NULL),
{stem.sql('SELECT DISTINCT unnest(w) AS t FROM w')},
tf AS (SELECT doc_id, stem AS term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM w) JOIN stem_of USING (t) GROUP BY ALL), q AS (SELECT term, count(*) AS times FROM (SELECT unnest([{asked}]) AS term) GROUP BY term)"""


_BM25 = "n AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w), d AS (SELECT term, count(*) AS df FROM tf GROUP BY term), s AS (SELECT doc_id, round(sum(times * ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 3.0 / (tf + 2.0 * (0.25 + 0.75 * len(w) / mean))), 6) AS score FROM tf JOIN q USING (term) JOIN d USING (term) JOIN w USING (doc_id), n GROUP BY doc_id)"


@query(f"WITH {_stemmed()}, {_BM25} SELECT * FROM s")
def r1_bm25(spark: SparkSession, d: str) -> DataFrame:
    return rank.bm25(_docs(spark, d), "doc_id", "text", _ASKED)


@query(f"WITH {_stemmed()}, {_BM25}, m AS (SELECT min(score) AS lo, max(score) AS hi FROM s) SELECT doc_id, round((score - lo) / (hi - lo), 6) AS score FROM s, m")
def r5_scaled_bm25(spark: SparkSession, d: str) -> DataFrame:
    return rank.scaled(rank.bm25(_docs(spark, d), "doc_id", "text", _ASKED), "score")


_RELEVANT = "r AS (SELECT doc_id, round(coalesce(sum(times * ln(2.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / 100.0))), 0), 6) AS score FROM w LEFT JOIN (SELECT * FROM tf JOIN q USING (term)) USING (doc_id) GROUP BY doc_id)"


@query(f"WITH {_stemmed()}, {_RELEVANT} SELECT doc_id, score, score >= 0.5 AS kept FROM r")
def f24_relevance(spark: SparkSession, d: str) -> DataFrame:
    return rank.relevant_texts(_docs(spark, d), "text", _ASKED).select("doc_id", "score", "kept")


@query(f"""WITH {_stemmed()}, {_RELEVANT}, c AS (SELECT doc_id, len(text) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, score, score >= 0.5 AS kept FROM r JOIN c USING (doc_id) WHERE n >= 500""")
def f25_filter_pipeline(spark: SparkSession, d: str) -> DataFrame:
    long_enough = lambda df: df.withColumn("score", F.lit(1.0)).withColumn("kept", F.length("text") >= 500)
    return rank.run_filters(_docs(spark, d).select("doc_id", "text"), [long_enough, lambda df: rank.relevant_texts(df, "text", _ASKED)]).drop("text")


@query(f"""WITH {_stemmed('doc_id, source')}, n AS (SELECT source, count(*) AS docs, avg(len(w)) AS mean FROM w GROUP BY source), d AS (SELECT source, term, count(*) AS df FROM tf JOIN w USING (doc_id) GROUP BY ALL),
s AS (SELECT doc_id, sum(times * ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 3.0 / (tf + 2.0 * (0.25 + 0.75 * len(w) / mean))) AS score FROM tf JOIN q USING (term) JOIN w USING (doc_id) JOIN n ON n.source IS NOT DISTINCT FROM w.source JOIN d ON d.source IS NOT DISTINCT FROM w.source AND d.term = tf.term GROUP BY doc_id)
SELECT doc_id, coalesce(score, 0) >= 1.0 AS kept, CASE WHEN coalesce(score, 0) >= 1.0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM w LEFT JOIN s USING (doc_id)""")
def f23_bm25_blocks(spark: SparkSession, d: str) -> DataFrame:
    return rank.bm25_blocks(_docs(spark, d).select("doc_id", "source", "text"), "source", "doc_id", "text", _ASKED).select("doc_id", "score", "kept")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id, round(list_cosine_similarity(q.v, e.v), 9) AS s FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbour_id) AS rank FROM p) SELECT query_id, neighbour_id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def r19_nearest(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return vectors.nearest(v, v.where("vec_id % 50 = 0"), 5)


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM e GROUP BY ALL""")
def a18_shape(spark: SparkSession, d: str) -> DataFrame:
    return vectors.shape(table(spark, d, "embeddings"), "label")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.label, 1 - list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id),
n AS (SELECT label, count(*) AS vectors FROM e GROUP BY label) SELECT n.label, vectors, round(coalesce(avg(s), 0), 6) AS spread FROM n LEFT JOIN p ON n.label = p.label GROUP BY ALL""")
def a14_spread(spark: SparkSession, d: str) -> DataFrame:
    return vectors.spread(table(spark, d, "embeddings"), "label")


_SEED = "SELECT min(url) AS url FROM crawled_data WHERE url LIKE 'https://lanternquay-gazette.example/%'"


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src_url, dst_url FROM site_links WHERE src_url IS NOT NULL AND dst_url IS NOT NULL),
b(url, depth) AS (SELECT url, 0 FROM ({_SEED}) WHERE url IS NOT NULL UNION SELECT e.dst_url, b.depth + 1 FROM b JOIN e ON b.url = e.src_url WHERE b.depth < 4)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY url""")
def t2_breadth_first(spark: SparkSession, d: str) -> DataFrame:
    seeds = _pages(spark, d).where("url like 'https://lanternquay-gazette.example/%'").agg(F.min("url").alias("url"))
    return graph.breadth_first(table(spark, d, "site_links"), seeds, 4)


@query()
def t4_best_first(spark: SparkSession, d: str) -> DataFrame:
    seeds = _pages(spark, d).where("url like 'https://lanternquay-gazette.example/%'").agg(F.min("url").alias("url"))
    u = F.col("url")
    score = urls.composite_score([(urls.keyword_score(u, ["museum", "garden"]), 0.6), (urls.depth_score(u), 0.4)])
    return graph.best_first(table(spark, d, "site_links"), seeds, score, max_pages=30)


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN 429 WHEN value < 20 THEN 404 ELSE 200 END AS s FROM events) SELECT user_id, count(*) AS responses, count(*) FILTER (WHERE s = 429) AS limited FROM e GROUP BY user_id""")
def w2_rate_summary(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("responses"), F.count_if(F.col("status") == 429).alias("limited"))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 429).when(F.col("value") < 20, 404).otherwise(200)
    return table(spark, d, "events").select("user_id", "ts", "event_id", status.alias("status"))


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE WHEN event_type = 'error' THEN 429 WHEN value < 20 THEN 404 ELSE 200 END AS s FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, 1000.0::DOUBLE AS d, 0 AS f FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT e.user_id, e.i, CASE WHEN s IN (429, 503) THEN least(d * 2, 30000) WHEN s BETWEEN 200 AND 299 THEN greatest(d * 0.75, 100) ELSE d END, CASE WHEN s IN (429, 503) THEN f + 1 WHEN s BETWEEN 200 AND 299 THEN 0 ELSE f END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, round(arg_max(d, i), 6) AS delay_ms, arg_max(f, i) AS fails FROM r GROUP BY user_id""")
def w2_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return stats.delay_after(_responses(spark, d).withColumn("o", F.struct("ts", "event_id")), "user_id", "o", "status")


# ---- pages --------------------------------------------------------------------------------------------------


def _parsed(spark: SparkSession, d: str, *parts: str) -> DataFrame:
    return pages.crawl_pages(_pages(spark, d), list(parts))


@query()
def d8_links(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, "links").select("page_id", F.posexplode("links").alias("pos", "l")).select("page_id", "pos", "l.href", "l.text", "l.is_external")


def _unescaped(column: str) -> str:
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
        column = f"replace({column}, '{code}', '{sign}')"
    return column


def _meta_of(name: str) -> str:
    return _unescaped(f"regexp_extract(html, '(?i)<meta\\s+name=\"{name}\"\\s+content=\"([^\"]*)\"', 1)")


_TITLE = _unescaped("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
_CANONICAL = _unescaped("regexp_extract(html, '<link rel=.canonical. href=.([^ >]*?).>', 1)")


@query(f"""SELECT page_id, trim({_TITLE}, chr(32) || chr(9) || chr(10) || chr(13)) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, {_meta_of('description')} AS description, {_meta_of('keywords')} AS keywords, {_meta_of('author')} AS author, {_CANONICAL} AS canonical,
CAST(len(list_distinct(regexp_extract_all(html, '<meta [^>]*property="og:([^"]*)"', 1))) AS INTEGER) AS open_graph, CAST(len(list_distinct(regexp_extract_all(html, '<meta [^>]*name="twitter:([^"]*)"', 1))) AS INTEGER) AS twitter, CAST(len(regexp_extract_all(html, '<script type="application/ld.json"')) AS INTEGER) AS json_ld FROM crawled_data""")
def d10_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = pages.crawl_pages(_pages(spark, d), ["metadata"])
    return m.select("page_id", "metadata.title", "metadata.language", "metadata.description", "metadata.keywords", "metadata.author", "metadata.canonical", F.size("metadata.open_graph").alias("open_graph"), F.size("metadata.twitter_card").alias("twitter"), F.size("metadata.json_ld").alias("json_ld"))


_COUNTS = {"forms": "form", "links": "a", "images": "img", "scripts": "script", "styles": "style", "iframes": "iframe", "navs": "nav", "h1": "h1", "h2": "h2", "h3": "h3"}


@query("SELECT page_id, " + ", ".join(f"CAST(len(regexp_extract_all(html, '<{t}[ >]')) AS INTEGER) AS {n}" for n, t in _COUNTS.items()) + ", " + ", ".join(f"regexp_matches(html, '<{t}[ >]') AS has_{t}" for t in ("main", "article", "aside", "header", "footer")) + " FROM crawled_data")
def d21_structure(spark: SparkSession, d: str) -> DataFrame:
    one = pages.crawl_pages(_pages(spark, d), ["structure"])
    return one.select("page_id", *[F.size(f"structure.{h}").alias(h) for h in ("h1", "h2", "h3")], *[f"structure.{n}" for n in ("forms", "links", "images", "scripts", "styles", "iframes", "navs")], *[f"structure.has_{t}" for t in ("main", "article", "aside", "header", "footer")])


@query()
def d12_tables(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, "tables").select("page_id", F.posexplode("tables").alias("pos", "t")).select("page_id", "pos", F.size("t.headers").alias("columns"), F.size("t.rows").alias("rows"), "t.score", "t.is_data_table")


@query()
def d3_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, "markdown")


@query()
def f19_pruned(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, "fit_html")


_LI_LABEL = _unescaped("regexp_replace(regexp_extract(x, '(?s)<a[^>]*>(.*?)</a>', 1), '<[^>]*>', '', 'g')")
_LI_TARGET = _unescaped("coalesce(nullif(regexp_extract(x, '(?s)<a[^>]*\\shref=\"([^\"]*)\"', 1), ''), regexp_extract(x, '(?s)<a[^>]*\\shref=''?([^\"'' >]*)', 1))")


@query(f"""WITH u AS (SELECT page_id, generate_subscripts(regexp_extract_all(html, '(?s)<ul[^>]*>.*?</ul>'), 1) AS i, unnest(regexp_extract_all(html, '(?s)<ul[^>]*>(.*?)</ul>', 1)) AS u FROM crawled_data WHERE html IS NOT NULL), l AS (SELECT page_id, i, generate_subscripts(regexp_extract_all(u, '(?s)<li[^>]*>.*?(?:</li>|$)'), 1) AS j, unnest(regexp_extract_all(u, '(?s)<li[^>]*>(.*?)(?:</li>|$)', 1)) AS x FROM u),
r AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i, j) - 1 AS INTEGER) AS record_index, trim({_LI_LABEL}, ' ' || chr(9) || chr(10) || chr(13)) AS label, {_LI_TARGET} AS target FROM l)
SELECT page_id, record_index, '{{"label": "' || replace(replace(label, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '", "target": "' || replace(replace(target, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"}}' AS record FROM r""")
def x2_css_records(spark: SparkSession, d: str) -> DataFrame:
    schema = {"base": "ul > li", "fields": [{"name": "label", "selector": "a", "type": "text"}, {"name": "target", "selector": "a", "type": "attribute", "attribute": "href"}]}
    return pages.extract_records(_pages(spark, d), schema)


@query()
def x4_xpath_records(spark: SparkSession, d: str) -> DataFrame:
    schema = {"base": "//table//tr", "fields": [{"name": "first", "selector": "td[1]", "type": "text"}, {"name": "last", "selector": "td[last()]", "type": "text"}]}
    return pages.extract_records(_pages(spark, d), schema, "xpath")


# ---- more of the crawl --------------------------------------------------------------------------------------


@query("SELECT page_id, CAST(len(p) AS INTEGER) AS kept, sha256(array_to_string(p, chr(10) || chr(10))) AS hash FROM (SELECT page_id, list_filter(string_split(markdown, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(10)) <> '' AND (trim(p, ' ' || chr(9) || chr(10)) LIKE '#%' OR (CAST(contains(lower(p), 'river') AS INTEGER) + CAST(contains(lower(p), 'garden') AS INTEGER)) / 2.0 >= 0.5)) AS p FROM crawled_data WHERE markdown IS NOT NULL)")
def d7_fit_markdown(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda p: F.btrim(p, F.lit(" \t\n"))
    good = lambda p: (blank(p) != "") & (blank(p).startswith("#") | ((F.lower(p).contains("river").cast("int") + F.lower(p).contains("garden").cast("int")) / 2.0 >= 0.5))
    one = _pages(spark, d).where("markdown is not null").select("page_id", F.filter(F.split("markdown", "\n\n"), good).alias("p"))
    return one.select("page_id", F.size("p").alias("kept"), text.content_hash(F.array_join("p", "\n\n")).alias("hash"))


@query(r"WITH m AS (SELECT page_id, regexp_extract_all(markdown, '\]\(([^()\s#][^()\s]*)\)', 1) AS l FROM crawled_data WHERE markdown IS NOT NULL), e AS (SELECT page_id, unnest(l) AS url, generate_subscripts(l, 1) AS pos FROM m), f AS (SELECT page_id, url, min(pos) AS pos FROM e GROUP BY ALL) SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS ref FROM f")
def d4_references(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("markdown", F.lit(r"\]\(([^()\s#][^()\s]*)\)"), F.lit(1)))
    return _pages(spark, d).where("markdown is not null").select("page_id", F.posexplode(found).alias("pos", "url")).select("page_id", "url", (F.col("pos") + 1).alias("ref"))


def _nonsense_sql() -> str:
    import re

    path = f"lower({_part(3)})"
    files, paths = "|".join(re.escape(f) for f in urls.UTILITY_FILES), "|".join(re.escape(p) for p in urls.UTILITY_PATHS)
    return f"""SELECT DISTINCT dst_url AS url, regexp_matches(p, '/(robots\\.txt|sitemap\\.xml|sitemap_index\\.xml)$') OR (contains(p, '/sitemap') AND regexp_matches(p, '(\\.xml|\\.xml\\.gz|\\.txt)$')) OR regexp_matches(p, '/({files})$') OR regexp_matches(p, '/\\.') OR regexp_matches(p, '{paths}')
OR regexp_matches(lower(dst_url), '[?&]print=|/print/|_print\\.') OR (length(trim(p, '/')) < 3 AND p NOT IN ('/', '/en', '/de', '/fr', '/es', '/it')) AS nonsense FROM (SELECT dst_url, {path.replace('url,', 'dst_url,')} AS p FROM site_links WHERE dst_url IS NOT NULL)"""


@query(_nonsense_sql())
def f12_nonsense(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "site_links").where("dst_url is not null").select(F.col("dst_url").alias("url")).distinct().withColumn("nonsense", urls.is_nonsense(F.col("url")))


_CONFIGS = [("https://lanternquay-gazette.example/news", "front"), ("lanternquay-gazette.example", "gazette"), ("https://*/guide/*", "guides")]


@query(f"WITH a AS (SELECT DISTINCT url FROM crawled_data WHERE url IS NOT NULL) SELECT url, CASE WHEN url LIKE 'https://lanternquay-gazette.example/news%' THEN 'front' WHEN {_host()} = 'lanternquay-gazette.example' OR {_host()} LIKE '%.lanternquay-gazette.example' THEN 'gazette' WHEN regexp_matches(lower(url), '^https://[^/]*/guide/[^/]*$') THEN 'guides' END AS config FROM a")
def f14_run_config(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.first_config(_pages(spark, d).where("url is not null").select("url").distinct(), _CONFIGS)


@query(f"WITH a AS (SELECT DISTINCT url, {_part(3)} AS p, {_host()} AS h FROM crawled_data WHERE url IS NOT NULL) SELECT url, NOT (h = 'lanternquay-gazette.example' AND p LIKE '/a/%') OR p = '/a/x' AS allowed FROM a")
def f15_robots(spark: SparkSession, d: str) -> DataFrame:
    body = "User-agent: *\nDisallow: /\n\nUser-agent: loom\nDisallow: /a/*\nAllow: /a/x$\n"
    rules = crawl.robots_rules(spark.createDataFrame([("lanternquay-gazette.example", body)], "host string, body string"))
    return crawl.allowed_by_robots(_pages(spark, d).where("url is not null").select("url").distinct(), rules, "Loom/1.0")


@query("WITH r AS (SELECT page_id, url, head_fingerprint AS f, lag(head_fingerprint) OVER (PARTITION BY url ORDER BY page_id) AS before, count(*) OVER (PARTITION BY url ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM crawled_data WHERE url IS NOT NULL) SELECT page_id, CASE WHEN k = 1 THEN 'unknown' WHEN f IS NULL OR before IS NULL THEN 'unknown' WHEN f = before THEN 'fresh' ELSE 'stale' END AS state FROM r")
def c10_freshness(spark: SparkSession, d: str) -> DataFrame:
    versions = Window.partitionBy("url").orderBy("page_id")
    one = _pages(spark, d).where("url is not null").select("page_id", F.col("head_fingerprint").alias("f"), F.lag("head_fingerprint").over(versions).alias("b"))
    return one.select("page_id", F.when(F.col("f").isNull() | F.col("b").isNull(), "unknown").when(F.col("f") == F.col("b"), "fresh").otherwise("stale").alias("state"))


@query("WITH l AS (SELECT url, max(fetched_at) AS t FROM crawl_cache WHERE url IS NOT NULL AND fetched_at IS NOT NULL GROUP BY url), n AS (SELECT max(t) AS now FROM l), v AS (SELECT url, t, epoch(date_trunc('second', now)) - epoch(date_trunc('second', t)) <= 30 * 86400 AS live FROM l, n), r AS (SELECT url, live, row_number() OVER (PARTITION BY live ORDER BY t DESC, url) AS k FROM v) SELECT url FROM r WHERE live AND k <= 100")
def w3_time_to_live(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "crawl_cache")
    now = cache.agg(F.max("fetched_at").alias("m")).first().m
    return stats.live_entries(cache, "url", "fetched_at", now, 30 * 86400, 100).select("url")


@query(f"""WITH {_stemmed('doc_id, source')}, {_BM25}, x AS (SELECT doc_id, source, score FROM s JOIN w USING (doc_id)),
g AS (SELECT * FROM x WHERE score > (SELECT avg(score) + 0.25 * stddev_pop(score) FROM x)), p AS (SELECT source, count(*) AS matches, round(sum(score), 4) AS score FROM g GROUP BY source)
SELECT * FROM p ORDER BY matches * 1.5 + score DESC, source NULLS LAST LIMIT 10""")
def r23_search_sources(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.search_sources(_docs(spark, d), _ASKED)


@query(f"WITH w AS (SELECT doc_id, list_distinct(list_filter({_words('text')}, lambda x: strlen(x) >= 2)) AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(list_intersect(w, ['river', 'museum', 'winter', 'schedule'])) AS INTEGER) AS shared FROM w ORDER BY shared DESC, doc_id LIMIT 20")
def r18_most_relevant(spark: SparkSession, d: str) -> DataFrame:
    return text.most_relevant(_docs(spark, d), "doc_id", "text", _QUERY, 20)


@query(f"WITH w AS ({_TERMS}), t AS (SELECT DISTINCT term FROM w) SELECT round(count(*) / 5.0, 6) AS coverage FROM t WHERE term IN ('river', 'museum', 'winter', 'schedule', 'zeppelin')")
def a8_coverage(spark: SparkSession, d: str) -> DataFrame:
    return stats.coverage(stats.term_statistics(_docs(spark, d), "doc_id", "text"), [*_QUERY.split(), "zeppelin"])


@query("SELECT CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN 'http' WHEN url LIKE 'file://%' THEN 'file' WHEN url LIKE 'raw:%' THEN 'raw' ELSE 'other' END AS kind, count(*) AS n FROM crawled_data WHERE url IS NOT NULL GROUP BY ALL")
def s3_source_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("url is not null").groupBy(crawl.source_kind(F.col("url")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT url FROM (SELECT url FROM crawled_data UNION ALL SELECT url FROM crawl_cache UNION ALL SELECT dst_url FROM site_links) WHERE url IS NOT NULL AND regexp_matches(url, '^https?://[^/?#]*\\.')")
def u1_seeds(spark: SparkSession, d: str) -> DataFrame:
    every = _pages(spark, d).select("url").unionByName(table(spark, d, "crawl_cache").select("url")).unionByName(table(spark, d, "site_links").select(F.col("dst_url").alias("url")))
    return every.where(urls.is_fetchable(F.col("url"))).distinct()


@query()
def plan_analyse(spark: SparkSession, d: str) -> DataFrame:
    status = table(spark, d, "crawl_cache").groupBy("url").agg(F.max("status_code").alias("status"))
    return pipelines.analyse_pages(_pages(spark, d), status)


# ---- scores -------------------------------------------------------------------------------------------------


def _link_sql() -> str:
    ext = "CASE " + " ".join(f"WHEN {_EXT} = '{e}' THEN {v}" for e, v in scoring.LINK_EXTENSIONS.items()) + " ELSE 0.5 END"
    path = f"trim({_part(3)}, '/')"
    depth = f"1.0 / (1.0 + abs(CASE WHEN {path} = '' THEN 0 ELSE len(string_split({path}, '/')) END - 2))"
    params = f"len(list_distinct(list_transform(list_filter(string_split({_part(4)}, '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 1))))"
    stop = ", ".join(f"'{w}'" for w in scoring.ANCHOR_STOP)
    return f"""WITH a AS (SELECT src_url, pos, dst_url AS url, coalesce(text, '') AS t FROM site_links WHERE src_url IS NOT NULL AND dst_url IS NOT NULL),
s AS (SELECT src_url, pos, url, ({depth} + 1.0 / (1.0 + {params} * 0.1) + {ext}) / 3.0 AS i, list_filter({_words('t', _EDGE)}, lambda x: strlen(x) >= 2 AND x NOT IN ({stop})) AS w FROM a)
SELECT src_url, pos, url, round(i, 6) AS intrinsic, round(c, 6) AS contextual, round(0.4 * i + 0.6 * c, 6) AS total FROM (SELECT *, ln(1.5) * (len(list_filter(w, lambda x: x = 'museum')) * 3.0 / (len(list_filter(w, lambda x: x = 'museum')) + 2.0) + len(list_filter(w, lambda x: x = 'garden')) * 3.0 / (len(list_filter(w, lambda x: x = 'garden')) + 2.0)) AS c FROM s)"""


@query(_link_sql())
def r13_link_scores(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "site_links").where("src_url is not null and dst_url is not null").select("src_url", "pos", F.col("dst_url").alias("url"), F.coalesce("text", F.lit("")).alias("t"))
    return links.select("src_url", "pos", "url", F.round(scoring.intrinsic_link_score(F.col("url")), 6).alias("intrinsic"), F.round(scoring.contextual_link_score(F.col("t"), "museum garden"), 6).alias("contextual"), F.round(scoring.link_score(F.col("url"), F.col("t"), "museum garden"), 6).alias("total"))


def _classic_link_sql() -> str:
    generic = ", ".join(f"'{g}'" for g in scoring.GENERIC)
    n = f"len(list_filter(regexp_split_to_array(t, '{_WS}+'), lambda x: x <> ''))"
    return f"""WITH a AS (SELECT src_url, pos, dst_url AS url, trim(coalesce(text, ''), ' ') AS t FROM site_links WHERE src_url IS NOT NULL AND dst_url IS NOT NULL)
SELECT src_url, pos, url, least(10.0, greatest(0.0, CAST(CASE WHEN regexp_matches(lower(url), '{scoring.HIGH_PATH}') THEN 2.0 WHEN regexp_matches(lower(url), '{scoring.MEDIUM_PATH}') THEN 1.0 ELSE 0.0 END - CASE WHEN regexp_matches(lower(url), '{scoring.BAD_PATH}') THEN 1.5 ELSE 0.0 END
+ CASE WHEN len(regexp_extract_all(url, '/')) - 2 <= 2 THEN 1.0 WHEN len(regexp_extract_all(url, '/')) - 2 > 5 THEN -0.5 ELSE 0.0 END + CASE WHEN url LIKE 'https://%' THEN 0.5 ELSE 0.0 END + CASE WHEN length(t) > 3 THEN 1.0 ELSE 0.0 END
+ CASE WHEN {n} >= 2 THEN 0.5 ELSE 0.0 END + CASE WHEN {n} >= 4 THEN 0.5 ELSE 0.0 END - CASE WHEN lower(t) IN ({generic}) THEN 1.0 ELSE 0.0 END AS DOUBLE))) AS score FROM a"""


@query(_classic_link_sql())
def r14_classic_link_scores(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "site_links").where("src_url is not null and dst_url is not null")
    none = F.lit(None).cast("string")
    return links.select("src_url", "pos", F.col("dst_url").alias("url"), scoring.classic_link_score(F.col("dst_url"), F.col("text"), none, none, none).alias("score"))


@query()
def r6_url_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _all_urls(spark, d).select("url", F.round(scoring.url_relevance(F.col("url"), "museum garden"), 6).alias("score"))


@query(f"WITH a AS (SELECT DISTINCT url FROM crawled_data WHERE url IS NOT NULL), l AS (SELECT url, string_split({_BASE.format(_host())}, '.') AS p FROM a) SELECT url, array_to_string(CASE WHEN len(p) > 2 AND p[len(p) - 1] IN ('co', 'com', 'org', 'gov', 'edu', 'net', 'mil', 'int', 'ac', 'ad', 'ae', 'af', 'ag') THEN p[len(p) - 2:] ELSE p[greatest(1, len(p) - 1):] END, '.') AS domain FROM l")
def c6_registrable_domain(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("url is not null").select("url").distinct().withColumn("domain", scoring.registrable_domain(F.col("url")))


@query(f"WITH a AS (SELECT DISTINCT url, {_part(3)} AS p FROM crawled_data WHERE url IS NOT NULL) SELECT url FROM a WHERE split_part(string_split(p, '/')[-1], '.', -1) = 'html' OR regexp_matches(p, '^/news(?:[/?#]|$)') OR regexp_matches(url, '^https://[^.]*-(?:blog|wiki).*\\.example/.*$')")
def f6_classic_patterns(spark: SparkSession, d: str) -> DataFrame:
    one = _pages(spark, d).where("url is not null").select("url").distinct()
    return one.where(scoring.matches_patterns(F.col("url"), ["*.html", "/news/*", r"^https://[^.]*-(?:blog|wiki).*\.example/.*$"]))


@query()
def f11_seo_scores(spark: SparkSession, d: str) -> DataFrame:
    one = _parsed(spark, d, "metadata", "structure", "text")
    score = scoring.page_seo_score(F.col("metadata.title"), F.col("metadata.description"), F.size("structure.h1"), F.size("structure.h2"), F.col("text"))
    return one.select("page_id", F.round(score, 6).alias("score"))


@query(f"WITH b AS (SELECT page_id, unnest(string_split(markdown, chr(10) || chr(10))) AS t, generate_subscripts(string_split(markdown, chr(10) || chr(10)), 1) - 1 AS pos FROM crawled_data WHERE markdown IS NOT NULL), n AS (SELECT *, strlen(t) AS size, strlen(array_to_string(regexp_extract_all(t, '\\[([^\\]]*)\\]\\(', 1), '')) AS linked, len(list_filter(regexp_split_to_array(t, '{_WS}+'), lambda x: x <> '')) AS n, {' + '.join(f'CAST(contains(lower(t), {p!r}) AS INTEGER)' for p in scoring.BOILERPLATE)} AS hits FROM b) SELECT page_id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN size < 25 OR n < 3 OR linked / size > 0.7 THEN 0.0 ELSE greatest(0.0, least(0.3, ln(size + 1.0) / 20.0) + least(0.2, n / 100.0) + 0.3 * (1 - linked / size) - hits * 0.15) END, 6) AS score FROM n")
def f21_block_scores(spark: SparkSession, d: str) -> DataFrame:
    one = _pages(spark, d).where("markdown is not null").select("page_id", F.posexplode(F.split("markdown", "\n\n")).alias("pos", "t"))
    linked = F.octet_length(F.array_join(F.regexp_extract_all("t", F.lit(r"\[([^\]]*)\]\("), F.lit(1)), ""))
    return one.select("page_id", "pos", F.round(scoring.block_score(F.col("t"), linked), 6).alias("score"))


# ---- heads, batches, adaptive measures ----------------------------------------------------------------------


_HEAD = "split_part(html, '</head>', 1)"


def _meta_sql(name: str) -> str:
    before = f"regexp_extract({_HEAD}, '(?i)<meta\\s[^>]*(?:name|property)=\"{name}\"[^>]*content=\"([^\"]*)\"', 1)"
    after = f"regexp_extract({_HEAD}, '(?i)<meta\\s[^>]*content=\"([^\"]*)\"[^>]*(?:name|property)=\"{name}\"', 1)"
    return f"CASE WHEN {before} <> '' THEN {before} ELSE {after} END"


@query(f"""WITH h AS (SELECT page_id, trim(regexp_extract({_HEAD}, '(?i)<title[^>]*>([^<]*)</title>', 1), ' ') AS title, {_meta_sql('description')} AS description, {_meta_sql('og:title')} AS og_title, regexp_extract({_HEAD}, '(?i)<link\\s[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) AS canonical, regexp_extract({_HEAD}, '(?i)<html[^>]*\\slang="([^"]*)"', 1) AS language FROM crawled_data WHERE html IS NOT NULL)
SELECT page_id, title, description, canonical, language, sha256(title || '|' || description || '|' || og_title || '|' || canonical) AS fingerprint FROM h""")
def c9_head_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    one = _pages(spark, d).where("html is not null").select("page_id", text.head_facts(F.col("html")).alias("h"))
    return one.select("page_id", "h.title", "h.description", "h.canonical", "h.language", text.head_fingerprint(F.col("h")).alias("fingerprint"))


@query("SELECT u.url, p.page_id, CASE WHEN p.page_id IS NULL THEN 'not found' WHEN NOT p.success THEN 'failed' END AS error FROM (SELECT DISTINCT url FROM crawl_cache WHERE url IS NOT NULL) u LEFT JOIN (SELECT url, max(page_id) AS page_id, max_by(success, page_id) AS success FROM crawled_data GROUP BY url) p ON u.url = p.url")
def s4_batch_crawl(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.batch_crawl(table(spark, d, "crawl_cache").select("url"), _pages(spark, d))


_TEXTS = f"SELECT doc_id, len(list_distinct(list_filter({_words('text')}, lambda x: strlen(x) >= 2 AND x NOT IN ({_STOP})))) AS n FROM documents WHERE text IS NOT NULL"


@query(f"WITH t AS ({_TEXTS}), m AS (SELECT quantile_disc(doc_id, 0.5) AS m FROM t) SELECT coalesce(round(greatest(0.0, 1 - avg(n) FILTER (WHERE doc_id > m) / avg(n)), 6), 0.0) AS saturation FROM t, m")
def a10_saturation(spark: SparkSession, d: str) -> DataFrame:
    return stats.saturation(_docs(spark, d), "text", "doc_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type <> 'error' AS ok, CAST(trunc(value) AS BIGINT) AS l FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS m, 0 AS f, 0::BIGINT AS crawled, 0::BIGINT AS failed FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT e.user_id, e.i, CASE WHEN NOT ok OR l <= 0 THEN m WHEN m = 0 THEN l ELSE (m * 3 + l) // 4 END, CASE WHEN ok THEN 0 ELSE f + 1 END, crawled + CAST(ok AS INTEGER), failed + CAST(NOT ok AS INTEGER) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, max(crawled) AS crawled, max(failed) AS failed, arg_max(f, i) AS failing, arg_max(m, i) AS latency_ms FROM r GROUP BY user_id""")
def a4_dispatch(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("o"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("l"))
    return stats.dispatch_stats(log, "user_id", "o", "ok", "l")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, max(list_cosine_similarity(q.v, e.v)) AS best FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT count(*) AS queries, round(avg(best), 5) AS confidence, round(min(best), 5) AS weakest FROM p""")
def a16_confidence(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    best = vectors.nearest(v, v.where("vec_id % 50 = 0"), 1)
    return best.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("similarity"), 5).alias("confidence"), F.round(F.min("similarity"), 5).alias("weakest"))


@query()
def r1_page_chunks(spark: SparkSession, d: str) -> DataFrame:
    return pages.relevant_chunks(_pages(spark, d))


SQL["r19_nearest"] = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id, list_cosine_similarity(q.v, e.v) AS s FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, neighbour_id) AS rank FROM p) SELECT query_id, neighbour_id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""


@query()
def t3_depth_first(spark: SparkSession, d: str) -> DataFrame:
    seeds = _pages(spark, d).where("url like 'https://lanternquay-gazette.example/%'").agg(F.min("url").alias("url"))
    return graph.depth_first(table(spark, d, "site_links"), seeds, 20, 4)


@query()
def t5_adaptive(spark: SparkSession, d: str) -> DataFrame:
    seeds = _pages(spark, d).where("url like 'https://lanternquay-gazette.example/%'").agg(F.min("url").alias("url"))
    return graph.adaptive(table(spark, d, "site_links"), _pages(spark, d).where("url is not null").select("url", F.col("markdown").alias("text")), seeds, "museum garden", 20, 10)


@query("""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.e IS NOT NULL AND b.e IS NOT NULL AND round(list_cosine_similarity(a.e, b.e), 6) >= 0.6),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.vec_id) SELECT vec_id, min(root) AS cluster, (SELECT count(*) FROM p WHERE p.a = r.vec_id) AS links FROM r GROUP BY vec_id""")
def r20_clusters(spark: SparkSession, d: str) -> DataFrame:
    return vectors.clusters(table(spark, d, "embeddings"), 0.6)


@query()
def h4_semantic(spark: SparkSession, d: str) -> DataFrame:
    return chunks.semantic_chunks(_pages(spark, d).where("markdown is not null").select("page_id", "markdown"), "markdown", 1000).drop("markdown")


from webloom import queries_links, queries_pages  # noqa: E402, F401  (register their queries)
