"""Queries of url filters, head scores, caches, queues and crawl statistics, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import filters, scoring, urls
from webloom.operators import frontier
from webloom.queries import _EXT, _all_urls, _docs, _host, _pages, _part, _words, query
from webloom.session import table

_URLS = "a AS (SELECT DISTINCT url FROM crawled_data WHERE url IS NOT NULL UNION SELECT DISTINCT dst_url FROM site_links WHERE dst_url IS NOT NULL)"
_ENDING = "CASE WHEN contains(name, '.') THEN lower(regexp_extract(name, '\\.([^.]*)$', 1)) ELSE '' END"
_NAME = "regexp_extract(regexp_extract(regexp_replace(url, '^.*?://', ''), '^[^/]*(/.*)$', 1), '([^/]*)$', 1)"
_HEAD = "split_part(html, '</head>', 1)"


def _heads(spark: SparkSession, d: str) -> DataFrame:
    head = F.substring_index(F.col("html"), "</head>", 1)
    return _pages(spark, d).where("html is not null and url is not null").select("page_id", "url", head.alias("head")).select("page_id", "url", "head", filters.head_title(F.col("head")).alias("title"), filters.head_meta(F.col("head")).alias("meta"))


@query(f"WITH {_URLS}, n AS (SELECT url, {_NAME} AS name FROM a), e AS (SELECT url, {_ENDING} AS ending FROM n) SELECT url, ending, ending = '' OR ending IN ('txt', 'html', 'htm', 'css', 'csv', 'ics') AS text, ending = '' OR ending IN ('bmp', 'gif', 'jpeg', 'jpg', 'png', 'svg', 'tiff', 'ico', 'webp') AS image FROM e")
def f7_type_allowed(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _all_urls(spark, d).select("url", filters.file_ending(u).alias("ending"), filters.type_allowed(u, ["text/"]).alias("text"), filters.type_allowed(u, ["image/"]).alias("image"))


@query("SELECT page_id, json_extract_string(response_headers, '$.content-type') AS content_type, coalesce(lower(trim(split_part(json_extract_string(response_headers, '$.content-type'), ';', 1))), '') = '' OR lower(trim(split_part(json_extract_string(response_headers, '$.content-type'), ';', 1))) LIKE 'text/%' AS allowed, contains(lower(json_extract_string(response_headers, '$.content-type')), 'text/html') OR contains(lower(json_extract_string(response_headers, '$.content-type')), 'application/xhtml+xml') AS is_html FROM crawled_data")
def f5_mime_allowed(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("content_type")
    return _pages(spark, d).select("page_id", F.get_json_object("response_headers", "$.content-type").alias("content_type")).select("page_id", "content_type", filters.mime_allowed(kind, ["text/"]).alias("allowed"), filters.is_html_mime(kind).alias("is_html"))


_BLOCKED = ("lanternquay-gazette.example", "example:8080")
_DOMAIN = "lower(regexp_extract(url, '://([^/]+)', 1))"


@query(f"WITH {_URLS}, n AS (SELECT url, {_DOMAIN} AS o FROM a) SELECT url, o AS domain, NOT (o = '{_BLOCKED[0]}' OR o LIKE '%.{_BLOCKED[0]}' OR o = '{_BLOCKED[1]}' OR o LIKE '%.{_BLOCKED[1]}') AS allowed, o LIKE '%.example' OR o = 'example' AS inside FROM n")
def f8_classic_domains(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _all_urls(spark, d).select("url", filters.domain_with_port(u).alias("domain"), filters.classic_domain_allowed(u, blocked=list(_BLOCKED)).alias("allowed"), filters.classic_domain_allowed(u, allowed=["example"]).alias("inside"))


_META = f"""m AS (SELECT page_id, url, {_HEAD} AS head, regexp_extract({_HEAD}, '(?is)<title>(.*?)</title>', 1) AS title, regexp_extract_all({_HEAD}, '<meta[^>]+>') AS tags FROM crawled_data WHERE html IS NOT NULL AND url IS NOT NULL),
t AS (SELECT page_id, generate_subscripts(tags, 1) AS pos, unnest(tags) AS t FROM m),
k AS (SELECT page_id, pos, CASE WHEN regexp_matches(t, 'name=["''](.*?)["'']') THEN regexp_extract(t, 'name=["''](.*?)["'']', 1) WHEN regexp_matches(t, 'property=["''](.*?)["'']') THEN regexp_extract(t, 'property=["''](.*?)["'']', 1) END AS key, CASE WHEN regexp_matches(t, 'content=["''](.*?)["'']') THEN regexp_extract(t, 'content=["''](.*?)["'']', 1) END AS value FROM t),
kv AS (SELECT page_id, key, arg_max(value, pos) AS value, max(pos) AS pos FROM k WHERE key IS NOT NULL AND value IS NOT NULL GROUP BY page_id, key),
h AS (SELECT m.page_id, url, head, title, coalesce(max(value) FILTER (WHERE key = 'description'), '') AS description, coalesce(max(value) FILTER (WHERE key = 'keywords'), '') AS keywords, coalesce(max(value) FILTER (WHERE key = 'robots'), '') AS robots, coalesce(max(value) FILTER (WHERE key = 'canonical'), '') AS canonical, coalesce(string_agg(value, ' ' ORDER BY pos), '') AS everything, count(key) AS n FROM m LEFT JOIN kv USING (page_id) GROUP BY m.page_id, url, head, title)"""


@query(f"WITH {_META} SELECT page_id, title, description, keywords, CAST(n AS INTEGER) AS n_meta FROM h")
def d31_head_meta(spark: SparkSession, d: str) -> DataFrame:
    get = lambda k: F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit("")).alias(k)
    return _heads(spark, d).select("page_id", "title", get("description"), get("keywords"), F.size("meta").alias("n_meta"))


_REL = "river museum garden"


def _relevance_sql() -> str:
    part = " + ".join(f"(ln(2.0 / (tf{k} + 0.5) + 1) * (tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * len(t) / 1000.0))))" for k in range(3))
    tfs = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{k}" for k, w in enumerate(sorted(_REL.split())))
    return f"""WITH {_META}, w AS (SELECT page_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', repeat(title, 3), repeat(description, 2), keywords, everything)), '[\\t\\n\\v\\f\\r ]+'), lambda x: x <> '') AS t FROM h),
f AS (SELECT page_id, t, {tfs} FROM w) SELECT page_id, round({part}, 6) AS score FROM f"""


@query(_relevance_sql())
def f9_head_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _heads(spark, d).select("page_id", filters.head_relevance(F.col("title"), F.col("meta"), _REL).alias("score"))


@query(f"""WITH {_META}, p AS (SELECT *, lower({_part(3)}) AS path, {_part(4)} AS q FROM h)
SELECT page_id, round(0.15 * CASE WHEN length(title) BETWEEN 50 AND 60 THEN 1.0 WHEN length(title) BETWEEN 40 AND 70 THEN 0.7 ELSE 0.3 END + 0.18 * least(len(regexp_extract_all(title, '(?i)\\b(museum|garden)\\b')) * 0.3, 1.0)
+ 0.12 * CASE WHEN length(description) BETWEEN 140 AND 160 THEN 1.0 WHEN length(description) BETWEEN 120 AND 200 THEN 0.5 ELSE 0.2 END + 0.10 * CASE WHEN canonical = '' THEN 0.5 WHEN canonical = url THEN 1.0 ELSE 0.2 END
+ 0.20 * CASE WHEN contains(robots, 'noindex') THEN 0.0 ELSE 1.0 END + 0.10 * CASE WHEN regexp_matches(head, '<script[^>]+type=["'']application/ld\\+json') THEN 1.0 ELSE 0.0 END
+ 0.15 * (CASE WHEN length(path) > 80 THEN 0.7 ELSE 1.0 END * CASE WHEN regexp_matches(path, '\\d{{4}}') THEN 0.8 ELSE 1.0 END * CASE WHEN q <> '' THEN 0.6 ELSE 1.0 END * CASE WHEN contains(path, '_') THEN 0.9 ELSE 1.0 END)::DOUBLE, 6)::DOUBLE AS score FROM p""")
def f10_classic_seo(spark: SparkSession, d: str) -> DataFrame:
    return _heads(spark, d).select("page_id", filters.classic_seo_score(F.col("url"), F.col("head"), F.col("title"), F.col("meta"), ["museum", "garden"]).alias("score"))


@query(f"WITH {_URLS}, b AS (SELECT url, CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://(.*)$', 1) ELSE url END AS bare FROM a), c AS (SELECT url, bare, regexp_replace(bare, '^www\\.', '') AS naked FROM b) SELECT url, url GLOB '*gazette*/news/*' OR bare GLOB '*gazette*/news/*' AS news, url GLOB 'lanternquay*' OR bare GLOB 'lanternquay*' OR (bare LIKE 'www.%' AND naked GLOB 'lanternquay*') AS home FROM c")
def f13_seed_match(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _all_urls(spark, d).select("url", filters.seed_match(u, "*gazette*/news/*").alias("news"), filters.seed_match(u, "lanternquay*").alias("home"))


@query(f"WITH {_URLS} SELECT url, url GLOB '*/news/*' OR url GLOB '*.html' AS any_of, url GLOB '*/news/*' AND url GLOB '*.html' AS all_of, TRUE AS unset, FALSE AS empty FROM a")
def f30_config_match(spark: SparkSession, d: str) -> DataFrame:
    u, globs = F.col("url"), ["*/news/*", "*.html"]
    return _all_urls(spark, d).select("url", filters.config_match(u, globs).alias("any_of"), filters.config_match(u, globs, every=True).alias("all_of"), filters.config_match(u, None).alias("unset"), filters.config_match(u, []).alias("empty"))


@query(f"WITH {_URLS}, n AS (SELECT url, {_part(1)} AS s, {_part(2)} AS h, regexp_replace({_part(3)}, '/+$', '') AS p, {_part(3)} AS p0, {_part(4)} AS q FROM a) SELECT url, CASE WHEN h = '' THEN '' ELSE lower(s) || '://' || lower(h) || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS capture, lower(s) || '://' || lower(h) || CASE WHEN p0 = '' THEN '/' ELSE p0 END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS light, CASE WHEN lower(s) = 'http' THEN 'https' ELSE lower(s) END || '://' || lower(h) || CASE WHEN p0 = '' THEN '/' ELSE p0 END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS secure FROM n")
def c4_light_normal(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _all_urls(spark, d).select("url", filters.capture_normal(u).alias("capture"), filters.light_normal(u).alias("light"), filters.light_normal(u, https=True).alias("secure"))


_WEIGHTS = {"lanternquay-gazette.example": 1.0, "www.lanternquay-gazette.example": 0.8}


@query(f"WITH {_URLS} SELECT url, CAST(CASE lower(regexp_replace(regexp_extract(regexp_replace(url, '^.*?://', ''), '^([^/?#]*)', 1), ':[^:]*$', '')) WHEN 'lanternquay-gazette.example' THEN 1.0 WHEN 'www.lanternquay-gazette.example' THEN 0.8 ELSE 0.5 END AS DOUBLE) AS weight, round(CAST(least(1.0, 0.5 + CASE WHEN contains(lower(url), '/docs/') OR contains(lower(url), '/documentation/') THEN 0.2 ELSE 0.0 END + CASE WHEN contains(lower(url), '/api/') OR contains(lower(url), '/reference/') THEN 0.2 ELSE 0.0 END + CASE WHEN contains(lower(url), '/guide/') OR contains(lower(url), '/tutorial/') THEN 0.1 ELSE 0.0 END + CASE WHEN lower(url) LIKE '%.pdf' THEN 0.1 WHEN regexp_matches(lower(url), '\\.(jpg|png|gif)$') THEN -0.3 ELSE 0.0 END) AS DOUBLE), 6) AS authority FROM a")
def r11_domain_weight(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _all_urls(spark, d).select("url", filters.domain_weight(u, _WEIGHTS).alias("weight"), F.round(filters.authority(u), 6).alias("authority"))


@query("WITH m AS (SELECT cache_id, CASE cache_id % 5 WHEN 0 THEN 'enabled' WHEN 1 THEN 'disabled' WHEN 2 THEN 'read_only' WHEN 3 THEN 'write_only' ELSE 'bypass' END AS mode, starts_with(url, 'http') AS cacheable, coalesce(status_code, 0) >= 500 AS bypass FROM crawl_cache) SELECT cache_id, mode, NOT bypass AND cacheable AND mode IN ('enabled', 'read_only') AS may_read, NOT bypass AND cacheable AND mode IN ('enabled', 'write_only') AS may_write FROM m")
def c11_cache_modes(spark: SparkSession, d: str) -> DataFrame:
    mode = F.element_at(F.array(*[F.lit(m) for m in ("enabled", "disabled", "read_only", "write_only", "bypass")]), (F.col("cache_id") % 5 + 1).cast("int"))
    rows = table(spark, d, "crawl_cache").select("cache_id", mode.alias("mode"), F.col("url").startswith("http").alias("cacheable"), (F.coalesce("status_code", F.lit(0)) >= 500).alias("bypass"))
    three = (F.col("mode"), F.col("cacheable"), F.col("bypass"))
    return rows.select("cache_id", "mode", filters.may_read(*three).alias("may_read"), filters.may_write(*three).alias("may_write"))


@query("""WITH s AS (SELECT regexp_extract(url, '^[A-Za-z]+://([^/]+)', 1) AS site, min(fetched_at) AS created, count(*) AS url_count, CAST(max(fetched_at) AS VARCHAR) AS lastmod, CAST(min(fetched_at) AS VARCHAR) AS cached_lastmod FROM crawl_cache WHERE fetched_at IS NOT NULL GROUP BY 1), n AS (SELECT max(fetched_at) AS now FROM crawl_cache)
SELECT site, url_count > 0 AND epoch(date_trunc('second', now)) - epoch(date_trunc('second', created)) <= 2400 * 3600 AS by_age, url_count > 0 AND NOT (lastmod > cached_lastmod) AS by_lastmod FROM s, n""")
def f31_sitemap_cache(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "crawl_cache").where("fetched_at is not null")
    now = cache.agg(F.max("fetched_at").alias("now")).first().now
    per = cache.groupBy(F.regexp_extract("url", "^[A-Za-z]+://([^/]+)", 1).alias("site")).agg(F.min("fetched_at").alias("created"), F.count(F.lit(1)).alias("n"), F.max("fetched_at").cast("string").alias("last"), F.min("fetched_at").cast("string").alias("first"))
    args = (F.lit(1), F.col("created"), F.lit(now), F.col("n"), F.col("first"), F.col("last"))
    return per.select("site", filters.sitemap_cache_valid(*args, 2400, by_lastmod=False).alias("by_age"), filters.sitemap_cache_valid(*args, 0).alias("by_lastmod"))


@query("SELECT DISTINCT dst_url FROM site_links WHERE dst_url IS NOT NULL AND dst_url <> '' AND NOT coalesce(is_external, FALSE) AND (dst_url GLOB '*/news/*' OR dst_url GLOB '*.html') AND NOT dst_url GLOB '*print*'")
def f27_link_filter(spark: SparkSession, d: str) -> DataFrame:
    return frontier.filter_links(table(spark, d, "site_links"), "dst_url", "is_external", include=["*/news/*", "*.html"], exclude=["*print*"])


_ATTEMPTS = "t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS attempt, event_type <> 'error' AND value >= 60 AS ok FROM events)"


@query("SELECT user_id, CAST(coalesce(min(attempt) FILTER (WHERE ok), max(attempt)) + 1 AS INTEGER) AS attempts, min(attempt) FILTER (WHERE ok) IS NOT NULL AS succeeded FROM (WITH " + _ATTEMPTS + " SELECT * FROM t) WHERE attempt <= 3 GROUP BY user_id")
def w7_first_success(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    tries = table(spark, d, "events").select("user_id", turn.alias("attempt"), ((F.col("event_type") != "error") & (F.col("value") >= 60)).alias("ok"))
    return frontier.first_success(tries, "user_id", "attempt", "ok")


@query("WITH c AS (SELECT url, max(markdown) AS markdown FROM crawl_cache WHERE url IS NOT NULL GROUP BY url), p AS (SELECT url, max(markdown) AS markdown FROM crawled_data WHERE url IS NOT NULL GROUP BY url) SELECT coalesce(c.url, p.url) AS url, sha256(coalesce(p.markdown, c.markdown)) AS hash, CASE WHEN p.markdown IS NOT NULL THEN 'primary' WHEN c.markdown IS NOT NULL THEN 'fallback' END AS source FROM p FULL JOIN c USING (url)")
def w7_fallback(spark: SparkSession, d: str) -> DataFrame:
    per = lambda t: table(spark, d, t).where("url is not null").groupBy("url").agg(F.max("markdown").alias("markdown"))
    both = frontier.with_fallback(per("crawled_data"), per("crawl_cache"), "url", "markdown")
    return both.select("url", F.sha2("markdown", 256).alias("hash"), "source")


@query("WITH l AS (SELECT dst_url AS url FROM site_links), n AS (SELECT count(*) AS total, count(*) FILTER (WHERE url GLOB '*/news/*') AS a, count(*) FILTER (WHERE url LIKE '%.html') AS b FROM l) SELECT 'news' AS filter, total, a AS passed, total - a AS rejected FROM n UNION ALL SELECT 'html', total, b, total - b FROM n")
def a20_filter_stats(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("dst_url")
    return frontier.check_stats(table(spark, d, "site_links"), {"news": filters.glob_match(u, "*/news/*"), "html": u.endswith(".html")})


@query(f"WITH s AS (SELECT 1.0 / (1.0 + abs(CASE WHEN trim({_part(3, 'dst_url')}, '/') = '' THEN 0 ELSE len(string_split(trim({_part(3, 'dst_url')}, '/'), '/')) END - 2)) AS s FROM site_links WHERE dst_url IS NOT NULL) SELECT count(s) AS count, round(CAST(sum(s) AS DOUBLE), 4) AS total, round(CAST(avg(s) AS DOUBLE), 6) AS average, round(CAST(min(s) AS DOUBLE), 6) AS lowest, round(CAST(max(s) AS DOUBLE), 6) AS highest FROM s")
def a19_score_stats(spark: SparkSession, d: str) -> DataFrame:
    return frontier.score_stats(table(spark, d, "site_links"), urls.depth_score(F.col("dst_url")))


@query("WITH k AS (SELECT DISTINCT url FROM crawl_cache WHERE url IS NOT NULL), r AS (SELECT dst_url AS url FROM site_links) SELECT (SELECT count(*) FROM r) AS requests, (SELECT count(*) FROM r SEMI JOIN k USING (url)) AS hits, (SELECT count(*) FROM r) - (SELECT count(*) FROM r SEMI JOIN k USING (url)) AS misses, (SELECT count(*) FROM k) AS entries")
def a22_cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return frontier.cache_stats(table(spark, d, "site_links").select(F.col("dst_url").alias("url")), table(spark, d, "crawl_cache"), "url")


@query(f"SELECT source, count(*) AS calls, CAST(sum(ceil(len(regexp_extract_all(text, '[^ \\t\\r\\n\\v\\f]+')) / 0.75)) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(n_tokens, 0)) AS BIGINT) AS completion_tokens, CAST(sum(ceil(len(regexp_extract_all(text, '[^ \\t\\r\\n\\v\\f]+')) / 0.75) + coalesce(n_tokens, 0)) AS BIGINT) AS total_tokens FROM documents WHERE text IS NOT NULL GROUP BY source")
def a21_token_usage(spark: SparkSession, d: str) -> DataFrame:
    from webloom.functions.text import token_estimate
    from webloom.operators.stats import token_usage

    docs = _docs(spark, d).select("source", token_estimate(F.col("text")).alias("prompt"), F.coalesce("n_tokens", F.lit(0)).alias("completion"))
    return token_usage(docs, "source", "prompt", "completion")


@query(f"WITH w AS (SELECT doc_id, text, list_filter({_words('text')}, lambda x: strlen(x) >= 2) AS w FROM documents WHERE text IS NOT NULL), t AS (SELECT unnest(w) AS t FROM w) SELECT (SELECT count(*) FROM w) AS pages, (SELECT CAST(sum(length(text)) AS BIGINT) FROM w) AS characters, (SELECT count(DISTINCT t) FROM t) AS distinct_terms, (SELECT count(*) FROM t) AS total_terms")
def a24_coverage_stats(spark: SparkSession, d: str) -> DataFrame:
    from webloom.operators.stats import coverage_stats

    return coverage_stats(_docs(spark, d), "text")


@query("WITH n AS (SELECT max(ts) AS now FROM events), q AS (SELECT event_type AS status, epoch(date_trunc('second', now)) - epoch(date_trunc('second', ts)) AS wait, value FROM events, n) SELECT status, count(*) AS tasks, round(max(wait), 3) AS longest_wait, round(avg(wait), 3) AS mean_wait, round(max(value), 3) AS peak_memory FROM q GROUP BY status")
def a25_queue_summary(spark: SparkSession, d: str) -> DataFrame:
    from webloom.operators.stats import queue_summary

    events = table(spark, d, "events")
    return queue_summary(events, "event_type", "ts", "value", events.agg(F.max("ts").alias("now")).first().now)


@query(f"WITH c AS (SELECT {_host()} AS domain, count(*) AS pages FROM crawled_data WHERE url IS NOT NULL GROUP BY 1) SELECT domain, pages FROM c ORDER BY pages DESC, domain LIMIT 10")
def k2_top_domains(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where("url is not null").groupBy(urls.host(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages")).orderBy(F.desc("pages"), "domain").limit(10)


_INTRINSIC = f"""CAST(({{depth}} + {{param}} + CASE {_EXT.replace('url', 'dst_url')} WHEN '' THEN 0.5 ELSE 0.5 END) AS DOUBLE)"""


@query(f"WITH l AS (SELECT DISTINCT src_url, dst_url FROM site_links WHERE src_url IS NOT NULL AND dst_url IS NOT NULL), s AS (SELECT *, 1.0 / (1.0 + abs(CASE WHEN trim({_part(3, 'dst_url')}, '/') = '' THEN 0 ELSE len(string_split(trim({_part(3, 'dst_url')}, '/'), '/')) END - 2)) AS s FROM l), r AS (SELECT src_url, dst_url, row_number() OVER (PARTITION BY src_url ORDER BY s DESC, dst_url) AS rank FROM s) SELECT src_url, dst_url, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def k6_within_capacity(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "site_links").where("src_url is not null and dst_url is not null").select("src_url", "dst_url").distinct()
    return frontier.within_capacity(links, "src_url", urls.depth_score(F.col("dst_url")), "dst_url", 5)


@query("WITH n AS (SELECT max(ts) AS now FROM events), q AS (SELECT event_id, epoch(date_trunc('second', now)) - epoch(date_trunc('second', ts)) AS wait, event_id % 4 AS retries, least(greatest(value / 100.0, 0), 1) AS importance FROM events, n) SELECT event_id, CASE WHEN wait > 864000 THEN -wait ELSE CAST(retries AS DOUBLE) END AS priority, wait > 864000 AS urgent, CAST(4 - greatest(0, least(4, floor(importance * 4))) AS INTEGER) AS level FROM q")
def w10_fair_queue(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now")).first().now
    wait = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("ts")).cast("double")
    importance = F.least(F.greatest(F.col("value") / 100.0, F.lit(0.0)), F.lit(1.0))
    return frontier.queue(events, F.col("event_id"), wait, F.col("event_id") % 4, 864000.0).select("event_id", "priority", "urgent", filters.queue_level(importance, 5).alias("level"))


@query("WITH m AS (SELECT url, min(struct_pack(title := json_extract_string(metadata, '$.title'), language := json_extract_string(metadata, '$.language'))) AS h FROM crawled_data WHERE url IS NOT NULL AND json_extract_string(metadata, '$.title') IS NOT NULL AND json_extract_string(metadata, '$.language') IS NOT NULL GROUP BY url) SELECT l.src_url, l.dst_url, l.pos, m.h.title AS title, m.h.language AS language FROM site_links l LEFT JOIN m ON l.dst_url = m.url")
def j10_link_heads(spark: SparkSession, d: str) -> DataFrame:
    heads = _pages(spark, d).select(F.col("url").alias("dst_url"), F.get_json_object("metadata", "$.title").alias("title"), F.get_json_object("metadata", "$.language").alias("language")).where("title is not null and language is not null")
    return frontier.head_by_url(table(spark, d, "site_links").select("src_url", "dst_url", "pos"), heads, "dst_url")


@query("SELECT page_id FROM crawled_data SEMI JOIN (SELECT url FROM crawl_cache WHERE status_code = 200) USING (url)")
def j9_survivors(spark: SparkSession, d: str) -> DataFrame:
    from webloom.plans.pipelines import survivors

    return survivors(_pages(spark, d), table(spark, d, "crawl_cache").where("status_code = 200"), "url").select("page_id")


@query("SELECT page_id, status, status >= 500 OR status = 429 AS retryable, CASE WHEN status = 429 THEN 'rate_limited' WHEN status IN (403, 451) THEN 'blocked' WHEN status >= 400 THEN 'http_status' END AS kind FROM (SELECT cache_id AS page_id, status_code AS status FROM crawl_cache)")
def c16_error_kinds(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    return table(spark, d, "crawl_cache").select(F.col("cache_id").alias("page_id"), F.col("status_code").alias("status")).select("page_id", "status", scoring.is_retryable(s).alias("retryable"), filters.error_kind(s).alias("kind"))


def _classic_blocked_sql() -> str:
    from webloom.functions.patterns import BLOCK_ANY, BLOCK_SMALL

    ws = "chr(32) || chr(9) || chr(13) || chr(10) || chr(11) || chr(12)"
    any_of = lambda col, rows: "(" + " OR ".join("regexp_matches({}, '{}')".format(col, p.replace("'", "''")) for p, _ in rows) + ")"
    return f"""WITH c AS (SELECT cache_id, coalesce(status_code, 0) AS status, coalesce(html, '') AS html FROM crawl_cache),
x AS (SELECT *, trim(html, {ws}) AS t, length(html) AS size, regexp_replace(regexp_replace(html, '(?i)<script\\b[\\s\\S]*?</script>', '', 'g'), '(?i)<style\\b[\\s\\S]*?</style>', '', 'g') AS deep, CASE WHEN regexp_matches(html, '(?i)<body\\b[^>]*>[\\s\\S]*</body>') THEN regexp_extract(html, '(?i)<body\\b[^>]*>([\\s\\S]*)</body>', 1) ELSE html END AS body FROM c),
y AS (SELECT *, CASE WHEN t = '' THEN FALSE WHEN substr(t, 1, 1) IN ('{{', '[') THEN TRUE WHEN lower(substr(t, 1, 10)) LIKE '<html%' OR lower(substr(t, 1, 10)) LIKE '<!%' THEN regexp_matches(substr(t, 1, 500), '(?i)<body[^>]*>\\s*<pre[^>]*>\\s*[{{\\[]') ELSE substr(t, 1, 1) = '<' END AS data,
length(trim(regexp_replace(regexp_replace(regexp_replace(body, '(?i)<script\\b[\\s\\S]*?</script>', '', 'g'), '(?i)<style\\b[\\s\\S]*?</style>', '', 'g'), '<[^>]+>', '', 'g'), {ws})) AS visible, NOT regexp_matches(html, '(?i)<(?:p|h[1-6]|article|section|li|td|a|pre)\\b') AS bare FROM x),
z AS (SELECT *, CAST(visible < 50 AS INTEGER) + CAST(bare AS INTEGER) + CAST(regexp_matches(html, '(?i)<script\\b') AND bare AND visible < 100 AS INTEGER) AS signals FROM y)
SELECT cache_id, CASE WHEN status = 429 THEN TRUE WHEN {any_of('substr(html, 1, 15000)', BLOCK_ANY)} THEN TRUE WHEN size > 15000 AND {any_of('substr(deep, 1, 30000)', BLOCK_ANY)} THEN TRUE WHEN status IN (403, 503) AND NOT data THEN TRUE
WHEN status >= 400 AND size < 10000 AND {any_of('substr(html, 1, 15000)', BLOCK_SMALL)} THEN TRUE WHEN status = 200 AND length(t) < 100 AND NOT data THEN TRUE
WHEN size > 50000 OR data THEN FALSE WHEN NOT regexp_matches(html, '(?i)<body\\b') THEN TRUE ELSE signals >= 2 OR (signals = 1 AND size < 5000) END AS blocked FROM z"""


@query(_classic_blocked_sql())
def f18_classic_blocked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_cache").select("cache_id", filters.is_classic_blocked(F.col("status_code"), F.col("html")).alias("blocked"))


@query("SELECT event_id, CASE WHEN validated AND validation > 0.4 THEN CASE WHEN learning < 0.4 THEN 0.7 WHEN learning > 0.7 THEN 0.95 ELSE round(0.7 + (learning - 0.4) * 0.833, 6) END ELSE round(learning * 0.8, 6) END AS confidence FROM (SELECT event_id, value / 200.0 AS learning, (event_id % 10) / 10.0 AS validation, event_type <> 'error' AS validated FROM events)")
def a17_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", (F.col("value") / 200.0).alias("learning"), ((F.col("event_id") % 10) / 10.0).alias("validation"), (F.col("event_type") != "error").alias("passed"))
    return rows.select("event_id", filters.rounded(filters.quality(F.col("learning"), F.col("validation"), F.col("passed"))).alias("confidence"))


@query()
def u5_maybe_member(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "site_links").select(F.col("dst_url").alias("url"))
    cache = table(spark, d, "crawl_cache")
    return frontier.maybe_member(links.distinct(), "url", cache, "url", items=max(1000, cache.count()))


@query(f"WITH {_URLS} SELECT url FROM a WHERE url <> '' AND (url GLOB '*gazette*' OR regexp_replace(url, '^.*?://', '') GLOB '*gazette*') ORDER BY url LIMIT 500")
def s10_seeding(spark: SparkSession, d: str) -> DataFrame:
    from webloom.plans import pipelines

    sources = [_pages(spark, d).select("url"), table(spark, d, "site_links").select(F.col("dst_url").alias("url"))]
    return pipelines.seed(sources, pipelines.Seeding("*gazette*", sound_only=False, most=500)).select("url")


@query()
def s10_scored_seeding(spark: SparkSession, d: str) -> DataFrame:
    from webloom.plans import pipelines

    sources = [_pages(spark, d).select("url"), table(spark, d, "site_links").select(F.col("dst_url").alias("url"))]
    return pipelines.seed(sources, pipelines.Seeding(query="museum garden news", least=0.1))
