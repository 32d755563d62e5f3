"""URL functions and predicates over columns of absolute urls; null in gives null out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, for page links and for the crawl's own normal form.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content utm_id fbclid gclid ref msclkid".split()
TRACKING_CRAWL = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid gclsrc dclid gbraid wbraid fbclid fb_action_ids fb_action_types fb_source fb_ref msclkid "
    "hsa_acc hsa_cam hsa_grp hsa_ad hsa_src hsa_tgt hsa_kw hsa_mt hsa_net hsa_ver _hsenc _hsmi __hstc __hssc __hsfp mc_cid mc_eid ref referrer source click_id campaign_id ad_id _ga _gl _ke trk sc_campaign s_kwcid ef_id s_cid"
).split()
#: How much a file extension promises content; other extensions score half.
EXTENSION_SCORES = {"": 1.0, ".html": 1.0, ".htm": 1.0, ".php": 0.8, ".asp": 0.8, ".aspx": 0.8, ".jsp": 0.8, ".pdf": 0.5, ".xml": 0.3, ".json": 0.3, ".txt": 0.2, ".css": 0.0, ".js": 0.0, ".png": 0.0, ".jpg": 0.0, ".gif": 0.0, ".svg": 0.0, ".ico": 0.0, ".woff": 0.0, ".woff2": 0.0}

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 host with port, 3 path, 4 query; '' where there is none."""
    return F.regexp_extract(url, _PARTS, group)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^[^@]*@", ""), r":\d*$", ""))


def base_domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def is_external(url: Column, base: Column) -> Column:
    """Neither the base domain nor under it."""
    own = base_domain(url)
    return ~((own == base) | own.endswith(F.concat(F.lit("."), base)))


def extension(url: Column) -> Column:
    """From the last dot of the last path segment on, in lower case; '' without one."""
    return F.lower(F.regexp_extract(part(url, 3), r"\.[^./]*$", 0))


def normalize(url: Column, profile: str = "content") -> Column:
    """Normal form of an absolute url.

    content: host in lower case, no fragment, no tracking parameters (a query that had some is sorted), no slash at
    the end. crawl: besides, scheme in lower case, no default port, and the query always sorted.
    """
    url = F.btrim(url)
    crawl = profile == "crawl"
    drop = TRACKING_CRAWL if crawl else TRACKING
    scheme = F.lower(part(url, 1)) if crawl else part(url, 1)
    place = F.lower(part(url, 2))
    if crawl:
        place = F.when(scheme == "http", F.regexp_replace(place, ":80$", "")).when(scheme == "https", F.regexp_replace(place, ":443$", "")).otherwise(place)
    path = F.regexp_replace(part(url, 3), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: p != "")
    kept = F.filter(pairs, lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(drop))
    full = F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    by_key = F.array_sort(full, lambda a, b: F.when(F.substring_index(a, "=", 1) < F.substring_index(b, "=", 1), -1).when(F.substring_index(a, "=", 1) > F.substring_index(b, "=", 1), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    if crawl:
        query = F.array_join(by_key, "&")
    else:
        query = F.when(F.size(kept) == F.size(pairs), part(url, 4)).otherwise(F.array_join(by_key, "&"))
    built = F.concat(scheme, F.lit("://"), place, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike(_PARTS), built).otherwise(url)


def glob_regex(pattern: str) -> str:
    """`*` any run, `?` any one character, in either case, found anywhere."""
    return "(?i)" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)


def matches_globs(url: Column, patterns: list[str]) -> Column:
    """One of the patterns is found; true without patterns."""
    out = F.lit(not patterns)
    for p in patterns:
        out = out | url.rlike(glob_regex(p))
    return out


def domain_allowed(url: Column, blocked: list[str] | None = None, allowed: list[str] | None = None) -> Column:
    """Not under a blocked domain, and under an allowed one if there are any."""

    def under(domains: list[str]) -> Column:
        out = F.lit(False)
        for d in domains:
            out = out | (host(url) == d.lower()) | host(url).endswith("." + d.lower())
        return out

    ok = ~under(blocked or [])
    return ok & under(allowed) if allowed else ok


def extension_allowed(url: Column, extensions: list[str]) -> Column:
    known = [e.lower() if not e or e.startswith(".") else "." + e.lower() for e in extensions]
    return extension(url).isin(known) if known else F.lit(True)


def keyword_score(url: Column, keywords: list[str]) -> Column:
    """Share of the keywords that stand in the url."""
    if not keywords:
        return F.lit(0.0)
    low = F.lower(url)
    total = F.lit(0)
    for k in keywords:
        total = total + low.contains(k.lower()).cast("int")
    return total / float(len(keywords))


def depth_score(url: Column, optimal: int = 2) -> Column:
    """1 / (1 + distance of the path's depth from the optimal one)."""
    path = F.btrim(part(url, 3), F.lit("/"))
    depth = F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))
    return 1.0 / (1.0 + F.abs(depth - optimal))


def content_type_score(url: Column) -> Column:
    score = F.lit(0.5)
    for ext, value in EXTENSION_SCORES.items():
        score = F.when(extension(url) == ext, value).otherwise(score)
    return score


def freshness_score(url: Column, as_of_year: int) -> Column:
    """By the age of a year and month in the path; half without a plausible one."""
    found = F.regexp_extract(part(url, 3), r"(?:^|/)(\d{4})[-/](\d{1,2})(?:[-/](\d{1,2}))?(?:/|$)", 1)
    year = F.when(found != "", found.cast("int"))
    age = as_of_year - year
    score = F.when(age <= 0, 1.0).when(age == 1, 0.8).when(age == 2, 0.6).when(age <= 4, 0.4).otherwise(0.2)
    score = F.when(age == -1, 0.4).otherwise(score)
    return F.when(year.isNull() | (year < 1990) | (year > as_of_year + 1), 0.5).otherwise(score)


def composite_score(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean; 0 without parts or weight."""
    weight = sum(w for _, w in parts)
    if not weight:
        return F.lit(0.0)
    total = F.lit(0.0)
    for score, w in parts:
        total = total + score * w
    return total / weight


def is_fetchable(url: Column) -> Column:
    """http or https, and a host with a dot."""
    return F.lower(part(url, 1)).isin("http", "https") & part(url, 2).contains(".")


#: Files and paths that hold no content.
UTILITY_FILES = "ads.txt humans.txt security.txt .well-known/security.txt crossdomain.xml browserconfig.xml manifest.json apple-app-site-association .well-known/apple-app-site-association favicon.ico apple-touch-icon.png android-chrome-192x192.png".split()
UTILITY_PATHS = "/wp-admin /wp-includes /wp-content/uploads /admin /login /signin /signup /register /checkout /cart /account /profile /search /404 /error /.git /.svn /.hg /cgi-bin /scripts /includes".split()


def is_nonsense(url: Column) -> Column:
    """A url that can't lead to content: robots and sitemap files, utility files and paths, print versions, stubs."""
    path, low = F.lower(part(url, 3)), F.lower(url)
    out = path.rlike(r"/(robots\.txt|sitemap\.xml|sitemap_index\.xml)$") | (path.contains("/sitemap") & path.rlike(r"(\.xml|\.xml\.gz|\.txt)$"))
    out = out | path.rlike("/(" + "|".join(re.escape(f) for f in UTILITY_FILES) + ")$") | path.rlike(r"/\.")
    out = out | path.rlike("|".join(re.escape(p) for p in UTILITY_PATHS)) | low.rlike(r"[?&]print=|/print/|_print\.")
    return out | ((F.char_length(F.btrim(path, F.lit("/"))) < 3) & ~path.isin("/", "/en", "/de", "/fr", "/es", "/it"))
