"""Scores of links, images, pages and responses, as Columns over plain attributes."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.functions.text import EDGE, fields, let, words

#: Extension scores of links, stop words of anchors, and signs of good and bad links.
LINK_EXTENSIONS = {"": 1.0, ".html": 1.0, ".htm": 1.0, ".php": 0.8, ".asp": 0.7, ".aspx": 0.7, ".jsp": 0.7, ".pdf": 0.5, ".xml": 0.3, ".json": 0.3, ".txt": 0.2, ".css": 0.0, ".js": 0.0, ".png": 0.0, ".jpg": 0.0, ".gif": 0.0, ".svg": 0.0}
ANCHOR_STOP = "a an the and or but in on at to for of is it be as was with by that this from are".split()
GOOD_CLASS, BAD_CLASS = "nav|menu|primary|main|important", "ad|sponsor|track|promo|banner"
GOOD_REL, BAD_REL = "canonical|next|prev|chapter", "nofollow|sponsored|ugc"
HIGH_PATH, MEDIUM_PATH, BAD_PATH = "/docs/|/api/|/guide/|/tutorial/|/reference/|/manual/", "/blog/|/article/|/post/|/news/", "/admin/|/login/|/cart/|/checkout/|/track/|/click/"
GENERIC = ["click here", "read more", "more info", "link", "here"]
ICONS = "icon|logo|avatar|sprite|favicon|badge|button|arrow|bullet"
BOILERPLATE = ["cookie", "privacy policy", "terms of service", "subscribe", "newsletter", "sign up", "log in", "advertisement", "sponsored", "all rights reserved", "copyright", "follow us"]
SECOND_LEVEL = "co com org gov edu net mil int ac ad ae af ag".split()


def registrable_domain(url: Column) -> Column:
    """The last two labels of the host, three after a common second level."""
    labels = F.split(urls.base_domain(url), r"\.")
    n = F.size(labels)
    three = (n > 2) & F.get(labels, n - 2).isin(SECOND_LEVEL)
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), n - F.when(three, 2).otherwise(1)), 3), ".")


def intrinsic_link_score(url: Column, optimal_depth: int = 2) -> Column:
    """Mean of depth, parameter and extension scores."""
    names = F.array_distinct(F.transform(F.filter(F.split(urls.part(url, 4), "&"), lambda p: p != ""), lambda p: F.substring_index(p, "=", 1)))
    ext = F.lit(0.5)
    for e, v in LINK_EXTENSIONS.items():
        ext = F.when(urls.extension(url) == e, v).otherwise(ext)
    return (urls.depth_score(url, optimal_depth) + 1.0 / (1.0 + F.size(names) * 0.1) + ext) / 3.0


def contextual_link_score(context: Column, query: str, k1: float = 2.0) -> Column:
    """BM25 of an anchor and its surroundings as a corpus of one, unstemmed."""
    tokens = F.filter(words(context, EDGE), lambda w: (F.octet_length(w) >= 2) & ~w.isin(ANCHOR_STOP))
    wanted = [w for w in (x.strip(".,;:!?\"'()[]{}") for x in query.lower().split()) if len(w.encode()) >= 2 and w not in ANCHOR_STOP]

    def score(t: Column) -> Column:
        parts = F.transform(F.array(*[F.lit(q) for q in wanted]).cast("array<string>"), lambda q: F.size(F.filter(t, lambda x: x == q)))
        return F.aggregate(parts, F.lit(0.0), lambda s, tf: s + math.log(1.5) * tf * (k1 + 1) / (tf + k1))

    return let(tokens, score)


def link_score(url: Column, context: Column, query: str) -> Column:
    return 0.4 * intrinsic_link_score(url) + 0.6 * contextual_link_score(context, query)


def classic_link_score(url: Column, text: Column, title: Column, css_class: Column, rel: Column) -> Column:
    """Quality of a link from 0 to 10 by its attributes, path and text, without the page's context."""
    blank = lambda c: F.btrim(F.coalesce(c, F.lit("")))
    low_class, low_rel, low = F.lower(F.coalesce(css_class, F.lit(""))), F.lower(F.coalesce(rel, F.lit(""))), F.lower(url)
    depth = F.regexp_count(url, F.lit("/")) - 2
    t, n = blank(text), F.size(fields(blank(text)))
    yes = lambda cond, value: F.when(cond, value).otherwise(0.0)
    total = yes(F.char_length(blank(title)) > 3, 1.0) + yes(low_class.rlike(GOOD_CLASS), 1.5) - yes(low_class.rlike(BAD_CLASS), 1.0) + yes(low_rel.rlike(GOOD_REL), 1.0) - yes(low_rel.rlike(BAD_REL), 0.5)
    total = total + F.when(low.rlike(HIGH_PATH), 2.0).when(low.rlike(MEDIUM_PATH), 1.0).otherwise(0.0) - yes(low.rlike(BAD_PATH), 1.5)
    total = total + F.when(depth <= 2, 1.0).when(depth > 5, -0.5).otherwise(0.0) + yes(url.startswith("https://"), 0.5)
    total = total + yes(F.char_length(t) > 3, 1.0) + yes(n >= 2, 0.5) + yes(n >= 4, 0.5) - yes(F.lower(t).isin(GENERIC), 1.0)
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), total))


def image_score(url: Column, alt: Column, width: Column, height: Column, blocked: list[str] | None = None, low: int = 50, narrow: float = 0.2, wide: float = 5.0) -> Column:
    """0 to 1 by size, shape, alternative text and address; 0 for blocked addresses; sizes that are no numbers count as unknown."""
    w, h = F.coalesce(width.try_cast("int"), F.lit(0)), F.coalesce(height.try_cast("int"), F.lit(0))
    known = (w > 0) & (h > 0)
    area = F.least(F.lit(0.35), F.log(w.cast("double") * h + 1) / 15.0)
    shape = F.when((w / h >= narrow) & (w / h <= wide), 0.2).otherwise(0.05)
    size = F.when(known, F.when((w < low) | (h < low), 0.05).otherwise(area) + shape).otherwise(0.15)
    n = F.size(fields(F.coalesce(alt, F.lit(""))))
    score = size + F.when(n > 0, 0.15).otherwise(0.0) + F.when(n >= 3, 0.10).otherwise(0.0) + F.when(F.lower(url).rlike(ICONS), 0.0).otherwise(0.2)
    bad = F.lit(False)
    for b in blocked or []:
        bad = bad | F.lower(url).contains(b.lower())
    return F.when(bad, 0.0).otherwise(F.least(F.lit(1.0), score))


def _band(n: Column, steps: list[tuple[int, float]], last: float) -> Column:
    """The value of the first step whose bound n doesn't reach, else the last."""
    out = F.when(n < steps[0][0], steps[0][1])
    for bound, value in steps[1:]:
        out = out.when(n < bound, value)
    return out.otherwise(last)


def page_seo_score(title: Column, description: Column, h1: Column, h2: Column, body: Column) -> Column:
    """Weighted mean of title, description, heading and content scores; h1 and h2 are counts."""
    t, d = F.octet_length(F.coalesce(title, F.lit(""))), F.octet_length(F.coalesce(description, F.lit("")))
    title_score = _band(t, [(1, 0.0), (10, 0.3), (30, 0.6), (61, 1.0), (91, 0.7)], 0.4)
    description_score = _band(d, [(1, 0.0), (50, 0.3), (120, 0.6), (161, 1.0), (201, 0.7)], 0.4)
    heading = F.when((h1 == 1) & (h2 >= 2), 1.0).when((h1 == 1) & (h2 >= 1), 0.8).when(h1 == 1, 0.6).when(h1 > 1, 0.4).when(h2 > 0, 0.3).otherwise(0.0)
    n = F.size(fields(body))
    content = _band(n, [(1, 0.0), (100, 0.2), (300, 0.4), (800, 0.7)], 1.0)
    own = fields(F.lower(F.coalesce(title, F.lit(""))))
    share = F.size(F.filter(own, lambda w: (F.octet_length(w) >= 3) & F.lower(body).contains(w))) / F.size(own)
    content = F.when((F.size(own) > 0) & (n > 0), F.least(F.lit(1.0), content + share * 0.2)).otherwise(content)
    return 0.25 * title_score + 0.20 * description_score + 0.25 * heading + 0.30 * content


def block_score(text: Column, linked: Column, least: int = 25, least_words: int = 3, most_links: float = 0.7) -> Column:
    """Score of a text block by length, words, share of link text (bytes) and boilerplate phrases; 0 below the minimums."""
    size, n = F.octet_length(text), F.size(fields(text))
    density = F.when(size > 0, linked / size).otherwise(0.0)
    hits = F.lit(0)
    for phrase in BOILERPLATE:
        hits = hits + F.lower(text).contains(phrase).cast("int")
    score = F.least(F.lit(0.3), F.log(size + 1.0) / 20.0) + F.least(F.lit(0.2), n / 100.0) + (1.0 - density) * 0.3 - hits * 0.15
    return F.when((size < least) | (n < least_words) | (density > most_links), 0.0).otherwise(F.greatest(F.lit(0.0), score))


def matches_patterns(url: Column, patterns: list[str], reverse: bool = False) -> Column:
    """Classic pattern filter: *.ext, /path/*, globs with ** and {a,b}, and regular expressions; any one is enough."""
    path, out = urls.part(url, 3), F.lit(False)
    for p in patterns:
        if p.startswith("^") or p.endswith("$") or "\\d" in p:
            out = out | url.rlike(p)
        elif p.count("*") == 1 and p.startswith("*."):
            out = out | (F.substring_index(F.substring_index(path, "/", -1), ".", -1) == p[2:])
        elif p.count("*") == 1 and p.endswith("/*"):
            target = url if "://" in p else path
            out = out | target.rlike("^" + re.escape(p[:-2]) + "(?:[/?#]|$)")
        else:
            rx, k = "", 0
            while k < len(p):
                group = re.match(r"\{([^}]+)\}", p[k:])
                if group:
                    rx += "(?:" + "|".join(re.escape(x) for x in group[1].split(",")) + ")"
                    k += len(group[0])
                else:
                    rx += ".*" if p[k] == "*" else "." if p[k] == "?" else re.escape(p[k])
                    k += 1
            out = out | url.rlike(f"(?s)^{rx}$")
    return ~out if reverse else out


def backoff(attempt: Column, base_ms: int = 1000, most_ms: int = 30000, factor: float = 2.0) -> Column:
    """Wait before a further attempt (from 0), without jitter."""
    return F.least(F.lit(float(most_ms)), base_ms * F.pow(F.lit(factor), attempt)).cast("long")


def is_retryable(status: Column) -> Column:
    """Whether a response may be better next time: too many requests and server errors."""
    return (status == 429) | (status >= 500)


def url_relevance(url: Column, query: str) -> Column:
    """How well a url's parts fit a query: whole matches, covered words, shared trigrams; better ones weigh more."""
    q = query.lower()
    host = F.split(F.regexp_replace(F.lower(urls.part(url, 2)), r"www\.", ""), r"\.")
    path = F.filter(F.split(F.lower(urls.part(url, 3)), "/"), lambda p: p != "")
    params = F.flatten(F.transform(F.filter(F.split(F.lower(urls.part(url, 4)), "&"), lambda p: p.contains("=")), lambda p: F.split(p, "=", 2)))

    def score(parts: Column) -> Column:
        whole = F.filter(F.transform(parts, lambda p: F.when(p.contains(q), 1.0).when(F.lit(q).contains(p), 0.9)), lambda v: v.isNotNull())

        def covered(token: Column) -> Column:
            each = F.transform(parts, lambda p: F.when(p.contains(token), 0.7 * F.char_length(token) / F.char_length(p)).when(token.contains(p), 0.6 * F.char_length(p) / F.char_length(token)))
            return F.array_max(each)

        by_token = F.filter(F.transform(F.array(*[F.lit(t) for t in q.split()]).cast("array<string>"), covered), lambda v: v.isNotNull())
        joined = F.array_join(parts, " ")
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(joined) - 2)), lambda i: F.substring(joined, i, F.lit(3))))
        own = F.array(*[F.lit(q[i : i + 3]) for i in range(max(0, len(q) - 2))]).cast("array<string>")
        own = F.array_distinct(own)
        fuzzy = F.when((F.char_length(joined) >= 3) & (F.size(own) > 0), F.array(0.5 * F.size(F.array_intersect(grams, own)) / F.size(F.array_union(grams, own)))).otherwise(F.array().cast("array<double>"))
        ranked = F.sort_array(F.concat(whole, by_token, fuzzy), asc=False)
        weighted = F.transform(ranked, lambda v, i: v / (i + 1))
        total, weight = F.aggregate(weighted, F.lit(0.0), lambda s, v: s + v), F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ranked))), F.lit(0.0), lambda s, i: s + 1.0 / i)
        return F.when(F.size(ranked) == 0, 0.0).otherwise(F.least(F.lit(1.0), total / weight))

    return let(F.filter(F.concat(host, path, params), lambda p: p != ""), score)
