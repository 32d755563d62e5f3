"""Predicates and scores over urls, heads, cache entries and queued tasks: columns in, columns out.

Null in gives null out unless said; nothing here leaves generated code.
"""

from __future__ import annotations

import fnmatch
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.patterns import BLOCK_SMALL
from webloom.functions.text import fields, let, literals

#: Media type of a file name's ending.
MIME = {
    "txt": "text/plain", "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "css": "text/css", "csv": "text/csv", "ics": "text/calendar", "js": "application/javascript",
    "bmp": "image/bmp", "gif": "image/gif", "jpeg": "image/jpeg", "jpg": "image/jpeg", "png": "image/png", "svg": "image/svg+xml", "tiff": "image/tiff", "ico": "image/x-icon", "webp": "image/webp",
    "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "m4a": "audio/mp4", "aac": "audio/aac", "mp4": "video/mp4", "mpeg": "video/mpeg", "webm": "video/webm", "avi": "video/x-msvideo", "mov": "video/quicktime",
    "json": "application/json", "xml": "application/xml", "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip", "tar": "application/x-tar", "doc": "application/msword", "rtf": "application/rtf",
    "php": "application/x-httpd-php", "php3": "application/x-httpd-php", "php4": "application/x-httpd-php", "php5": "application/x-httpd-php", "php7": "application/x-httpd-php", "phtml": "application/x-httpd-php", "phps": "application/x-httpd-php-source",
}
#: Weights of the head factors, and of the parts of a link's rank.
SEO_WEIGHTS = {"title_length": 0.15, "title_kw": 0.18, "meta_description": 0.12, "canonical": 0.10, "robot_ok": 0.20, "schema_org": 0.10, "url_quality": 0.15}
RANK_WEIGHTS = (0.5, 0.3, 0.2)


def glob(pattern: str) -> str:
    """A shell pattern as an anchored regular expression that both engines read; * goes over line ends, [!x] is [^x]."""
    out = fnmatch.translate(pattern)
    body = re.sub(r"\(\?>(.*?)\)", r"(?:\1)", out.removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z"))
    return f"^(?s:{body})$"


def glob_match(url: Column, pattern: str) -> Column:
    return url.rlike(glob(pattern))


def seed_match(url: Column, pattern: str) -> Column:
    """The pattern fits the url, the url without its scheme, or that without a leading `www.`."""
    bare = F.when(url.contains("://"), F.regexp_extract(url, r"^.*?://([\s\S]*)$", 1)).otherwise(url)
    return glob_match(url, pattern) | glob_match(bare, pattern) | (bare.startswith("www.") & glob_match(F.regexp_replace(bare, r"^www\.", ""), pattern))


def config_match(url: Column, patterns: list[str] | None, every: bool = False) -> Column:
    """No patterns (None) fit any url, an empty list none; else one of them must fit, or all of them if `every`."""
    if patterns is None:
        return F.lit(True)
    if not patterns:
        return F.lit(False)
    out = F.lit(every)
    for p in patterns:
        out = out & glob_match(url, p) if every else out | glob_match(url, p)
    return out


def file_ending(url: Column) -> Column:
    """What follows the last dot of the last path segment (query and fragment included), in lower case; '' without one."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"^.*?://([\s\S]*)$", 1)).otherwise(url)
    path = F.regexp_extract(rest, r"^[^/]*(/[\s\S]*)$", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.contains("."), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))).otherwise("")


def type_allowed(url: Column, types: list[str]) -> Column:
    """The file ending stands for one of the media types (or a part of their names); urls without an ending pass."""
    wanted = [t.lower() for t in types]
    known = [e for e, m in MIME.items() if any(t in m for t in wanted)]
    ending = file_ending(url)
    return (ending == "") | (ending.isin(known) if known else F.lit(False))


def mime_allowed(content_type: Column, types: list[str]) -> Column:
    """The response's media type starts with one of the given; responses without one pass."""
    kind = F.lower(F.btrim(F.substring_index(content_type, ";", 1)))
    out = F.lit(False)
    for t in types:
        out = out | kind.startswith(t.lower())
    return content_type.isNull() | (kind == "") | out


def is_html_mime(mime: Column) -> Column:
    low = F.lower(mime)
    return low.contains("text/html") | low.contains("application/xhtml+xml")


def domain_with_port(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "://([^/]+)", 1))


def classic_domain_allowed(url: Column, allowed: list[str] | None = None, blocked: list[str] | None = None) -> Column:
    """As urls.domain_allowed, the port being a part of the domain."""
    own = domain_with_port(url)

    def under(domains: list[str]) -> Column:
        out = F.lit(False)
        for d in domains:
            out = out | (own == d.lower()) | own.endswith("." + d.lower())
        return out

    ok = ~under(blocked or [])
    return ok if allowed is None else ok & under(allowed)


def domain_weight(url: Column, weights: dict[str, float], default: float = 0.5) -> Column:
    """Weight of the url's host, without port."""
    own = F.regexp_replace(F.lower(F.regexp_extract(F.regexp_replace(url, r"^.*?://", ""), r"^([^/?#]*)", 1)), r":[^:]*$", "")
    if not weights:
        return F.lit(default)
    table = F.map_from_arrays(literals([w.lower() for w in weights]), F.array(*[F.lit(float(v)) for v in weights.values()]))
    return F.coalesce(F.try_element_at(table, own), F.lit(default))


def head_meta(head: Column) -> Column:
    """Map of a head's meta elements, name before property, either quote; the last of a name wins."""
    tags = F.regexp_extract_all(head, F.lit(r"<meta[^>]+>"), F.lit(0))

    def entry(t: Column) -> Column:
        # one element's attributes: (present, value) of name, property and content
        got = lambda a: F.regexp_extract(t, rf"""{a}=["'](.*?)["']""", 1)
        has = lambda a: t.rlike(rf"""{a}=["'](.*?)["']""")
        key = F.when(has("name"), got("name")).when(has("property"), got("property"))
        return F.struct(key.alias("key"), F.when(has("content"), got("content")).alias("value"))

    kept = F.filter(F.transform(tags, entry), lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    last = let(kept, lambda k: F.filter(k, lambda e, i: ~F.exists(F.slice(k, i + 2, F.size(k)), lambda o: o["key"] == e["key"])))
    return F.map_from_entries(last)


def head_title(head: Column) -> Column:
    """Text of the title element as it stands; '' without one."""
    return F.regexp_extract(head, r"(?is)<title>(.*?)</title>", 1)


def head_relevance(title: Column, meta: Column, query: str, k1: float = 1.2, b: float = 0.75, mean: float = 1000.0) -> Column:
    """BM25 of a head against a query: the title three times, the description twice, the keywords, and all meta values."""
    get = lambda k: F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit(""))
    text = F.lower(F.concat_ws(" ", F.repeat(title, 3), F.repeat(get("description"), 2), get("keywords"), F.array_join(F.map_values(meta), " ")))
    wanted = sorted(set(query.lower().split()))

    def part(t: Column, word: str) -> Column:
        tf = F.size(F.filter(t, lambda x: x == word))
        return F.log(2.0 / (tf + 0.5) + 1) * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size(t) / mean)))

    def score(t: Column) -> Column:
        return F.round(sum((part(t, w) for w in wanted), F.lit(0.0)), 6)

    return let(fields(text), score)


def classic_seo_score(url: Column, head: Column, title: Column, meta: Column, keywords: list[str]) -> Column:
    """Weighted sum of seven head factors; a page passes from 0.65 on."""
    get = lambda k: F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit(""))
    n, d, path = F.length(title), F.length(get("description")), F.lower(urls.part(url, 3))
    hits = F.regexp_count(title, F.lit(rf"(?i)\b({'|'.join(map(re.escape, keywords))})\b")) if keywords else F.lit(0)
    factors = {
        "title_length": F.when(n.between(50, 60), 1.0).when(n.between(40, 70), 0.7).otherwise(0.3),
        "title_kw": F.least(hits * 0.3, F.lit(1.0)),
        "meta_description": F.when(d.between(140, 160), 1.0).when(d.between(120, 200), 0.5).otherwise(0.2),
        "canonical": F.when(get("canonical") == "", 0.5).when(get("canonical") == url, 1.0).otherwise(0.2),
        "robot_ok": F.when(get("robots").contains("noindex"), 0.0).otherwise(1.0),
        "schema_org": F.when(head.rlike(r"""<script[^>]+type=["']application/ld\+json"""), 1.0).otherwise(0.0),
        "url_quality": F.when(F.length(path) > 80, 0.7).otherwise(1.0) * F.when(path.rlike(r"\d{4}"), 0.8).otherwise(1.0) * F.when(urls.part(url, 4) != "", 0.6).otherwise(1.0) * F.when(path.contains("_"), 0.9).otherwise(1.0),
    }
    total = F.lit(0.0)
    for name, weight in SEO_WEIGHTS.items():
        total = total + weight * factors[name]
    return F.round(total, 6)


def looks_like_data(html: Column) -> Column:
    """JSON, JSON in a browser's pre element, or XML that is no HTML."""
    start = F.btrim(html, F.lit(" \t\r\n\x0b\f"))
    low = F.lower(F.substring(start, 1, 10))
    wrapped = F.substring(start, 1, 500).rlike(r"(?i)<body[^>]*>\s*<pre[^>]*>\s*[{\[]")
    return F.when(start == "", False).when(F.substring(start, 1, 1).isin("{", "["), True).when(low.startswith("<html") | low.startswith("<!"), wrapped).otherwise(F.substring(start, 1, 1) == "<")


def is_classic_blocked(status: Column, html: Column) -> Column:
    """Whether the classic detector takes a response for a block page by its status, its size or its structure.

    The signs that hold for any page are those of patterns.blocked_reason; here come the status rules in their
    classic order: signs of small pages need a status from 400 on, and no body element is proof by itself.
    """
    from webloom.functions.patterns import BLOCK_ANY

    html = F.coalesce(html, F.lit(""))
    size, data = F.length(html), looks_like_data(html)
    code, style = r"(?i)<script\b[\s\S]*?</script>", r"(?i)<style\b[\s\S]*?</style>"
    start = F.substring(html, 1, 15000)
    any_sign, small_sign = F.lit(False), F.lit(False)
    for pattern, _ in BLOCK_ANY:
        any_sign = any_sign | start.rlike(pattern)
    deep = F.substring(F.regexp_replace(F.regexp_replace(html, code, ""), style, ""), 1, 30000)
    deep_sign = F.lit(False)
    for pattern, _ in BLOCK_ANY:
        deep_sign = deep_sign | deep.rlike(pattern)
    for pattern, _ in BLOCK_SMALL:
        small_sign = small_sign | start.rlike(pattern)
    body = F.coalesce(F.nullif(F.regexp_extract(html, r"(?i)<body\b[^>]*>([\s\S]*)</body>", 1), F.lit("")), F.when(html.rlike(r"(?i)<body\b[^>]*>[\s\S]*</body>"), F.lit("")).otherwise(html))
    visible = F.length(F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, code, ""), style, ""), "<[^>]+>", ""), F.lit(" \t\r\n\x0b\f")))
    bare = ~html.rlike(r"(?i)<(?:p|h[1-6]|article|section|li|td|a|pre)\b")
    signals = (visible < 50).cast("int") + bare.cast("int") + (html.rlike(r"(?i)<script\b") & bare & (visible < 100)).cast("int")
    broken = F.when((size > 50000) | data, False).when(~html.rlike(r"(?i)<body\b"), True).otherwise((signals >= 2) | ((signals == 1) & (size < 5000)))
    near_empty = F.length(F.btrim(html, F.lit(" \t\r\n\x0b\f"))) < 100
    status = F.coalesce(status, F.lit(0))
    return (
        F.when(status == 429, True).when(any_sign, True).when((size > 15000) & deep_sign, True).when(status.isin(403, 503) & ~data, True)
        .when((status >= 400) & (size < 10000) & small_sign, True).when((status == 200) & near_empty & ~data, True).otherwise(broken)
    )


def capture_normal(url: Column) -> Column:
    """Normal form for capture indexes: scheme and host in lower case, no fragment, no slash at the end; '' without a host."""
    path = F.regexp_replace(urls.part(url, 3), "/+$", "")
    query = urls.part(url, 4)
    return F.when(urls.part(url, 2) == "", "").otherwise(
        F.concat(F.lower(urls.part(url, 1)), F.lit("://"), F.lower(urls.part(url, 2)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    )


def light_normal(url: Column, https: bool = False) -> Column:
    """The classic light form of an absolute url: host in lower case, no fragment; a slash for an empty path; https kept if told."""
    scheme = F.lower(urls.part(url, 1))
    scheme = F.when(scheme == "http", "https").otherwise(scheme) if https else scheme
    query = urls.part(url, 4)
    return F.concat(scheme, F.lit("://"), F.lower(urls.part(url, 2)), F.when(urls.part(url, 3) == "", "/").otherwise(urls.part(url, 3)), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def may_read(mode: Column, cacheable: Column, bypass: Column) -> Column:
    return ~bypass & cacheable & mode.isin("enabled", "read_only")


def may_write(mode: Column, cacheable: Column, bypass: Column) -> Column:
    return ~bypass & cacheable & mode.isin("enabled", "write_only")


def sitemap_cache_valid(version: Column, created: Column, now: Column, url_count: Column, cached_lastmod: Column, lastmod: Column, ttl_hours: float, by_lastmod: bool = True) -> Column:
    """Version 1, young enough (any age if ttl_hours is 0), not older than the sitemap, and not empty; null times are invalid."""
    ok = (version == 1) & (F.coalesce(url_count, F.lit(0)) > 0)
    if ttl_hours > 0:
        ok = ok & (F.unix_timestamp(now) - F.unix_timestamp(created) <= ttl_hours * 3600)
    if by_lastmod:
        ok = ok & ~F.coalesce((lastmod > cached_lastmod) & (cached_lastmod != ""), F.lit(False))
    return F.coalesce(ok, F.lit(False))


def srcset(value: Column) -> Column:
    """Variants (url, width) of a srcset; width only where it is given as a number and `w`."""
    parts = F.filter(F.transform(F.split(value, ","), lambda p: F.btrim(p)), lambda p: p != "")

    def variant(p: Column) -> Column:
        words = F.split(p, r"\s+")
        second = F.get(words, F.lit(1))
        return F.struct(words[0].alias("url"), F.when(second.endswith("w"), F.substring_index(F.regexp_replace(second, "w+$", ""), ".", 1)).alias("width"))

    return F.transform(parts, variant)


def dimension(value: Column) -> Column:
    """Struct (number, unit) of a CSS size, px where no unit is given; nulls where it starts with no number."""
    number = F.regexp_extract(value, r"^(\d+)", 1)
    unit = F.regexp_extract(value, r"^\d+(\D*)", 1)
    return F.struct(F.when(number != "", number.cast("int")).alias("number"), F.when(number != "", F.when(unit == "", "px").otherwise(unit)).alias("unit"))


def symbol_words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of characters beyond Latin-1; all else parts them."""
    return F.filter(F.split(text, r"[^0-9A-Za-z\x{100}-\x{10FFFF}]+"), lambda w: w != "")


def letter_words(text: Column, least: int = 3) -> Column:
    """Lower-case words of at least `least` characters, cut at all that is no letter, digit, underscore or white space."""
    return F.filter(fields(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " ")), lambda w: F.length(w) >= least)


def error_kind(status: Column) -> Column:
    """rate_limited, blocked or http_status for a status from 400 on; null else."""
    return F.when(status == 429, "rate_limited").when(status.isin(403, 451), "blocked").when(status >= 400, "http_status")


def queue_level(priority: Column, levels: int) -> Column:
    """Queue of a task by its priority from 0 to 1, the most urgent first."""
    return (levels - 1 - F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.floor(priority * (levels - 1))))).cast("int")


def fair_priority(wait: Column, retries: Column, fairness: float) -> Column:
    """Lower is sooner: those that wait longer than `fairness` come first, the longest of them foremost, else fewer retries."""
    return F.when(wait > fairness, -wait).otherwise(retries.cast("double"))


def authority(url: Column, intrinsic: Column | None = None) -> Column:
    """Authority of a link by its address, and by its intrinsic score where there is one."""
    low, has = F.lower(url), lambda *p: sum(((F.lower(url).contains(x)).cast("int") for x in p[1:]), F.lower(url).contains(p[0]).cast("int")) > 0
    s = F.lit(0.5) + F.when(has("/docs/", "/documentation/"), 0.2).otherwise(0.0) + F.when(has("/api/", "/reference/"), 0.2).otherwise(0.0) + F.when(has("/guide/", "/tutorial/"), 0.1).otherwise(0.0)
    s = s + F.when(low.endswith(".pdf"), 0.1).when(low.rlike(r"\.(jpg|png|gif)$"), -0.3).otherwise(0.0)
    if intrinsic is not None:
        s = F.when(intrinsic.isNotNull(), 0.7 * s + 0.3 * intrinsic).otherwise(s)
    return F.when(url == "", 0.0).otherwise(F.least(s, F.lit(1.0)))


def link_gain(text: Column, known: Column, query: str) -> Column:
    """Expected gain of a link by its text: half its share of the query's words, its new words, and a fifth for authority.

    known: array of the words met so far (bounded: those of the query and of the link itself, joined in).
    """
    wanted = sorted(set(w for w in re.sub(r"[^\w\s]", " ", query.lower()).split() if len(w) > 2))
    a, b, c = RANK_WEIGHTS

    def gain(t: Column) -> Column:
        relevance = F.size(F.array_intersect(t, literals(wanted))) / max(1, len(wanted))
        novelty = F.when(F.size(t) == 0, 0.5).otherwise(F.size(F.array_except(t, known)) / F.size(t))
        return F.round(a * F.when(F.size(t) == 0, 0.0).otherwise(relevance) + b * novelty + c, 6)

    return let(F.array_distinct(letter_words(F.coalesce(text, F.lit("")))), gain)


def quality(learning: Column, validation: Column, passed: Column, validation_min: float = 0.4, low: float = 0.7, high: float = 0.95, factor: float = 0.833) -> Column:
    """Confidence shown to a user: raised where the coverage was validated, else four fifths of the learning score."""
    good = F.when(learning < 0.4, low).when(learning > 0.7, high).otherwise(low + (learning - 0.4) * factor)
    return F.when(passed & (validation > validation_min), good).otherwise(learning * 0.8)


def rounded(x: Column, places: int = 6) -> Column:
    """x as SQL rounds doubles: scaled, half away from zero, scaled back; x itself where scaling is beyond a double.

    Spark's round goes by the shortest decimal, so that 0.7054144999999999 is rounded down where its millionfold is
    705414.5 and SQL rounds up.
    """
    scaled = F.round(x * 10.0**places) / 10.0**places
    return F.when(F.abs(scaled) == math.inf, x).otherwise(scaled)


def covered(df: Column, tf: Column, docs: int, max_tf: int) -> Column:
    """Share of the documents that hold a term, raised by up to half for frequent terms."""
    return F.when(df > 0, df / docs * (1 + 0.5 * F.log1p(tf) / math.log1p(max_tf))).otherwise(0.0)
