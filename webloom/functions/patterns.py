"""Regular expressions of common values and of pages that block crawlers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import let

#: Name -> (pattern, least and greatest length in bytes).
CATALOG: dict[str, tuple[str, int, int]] = {
    "email": (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", 5, 254),
    "phone": (r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}|\+\d{1,3}[-.\s]?\d{1,14}", 7, 10**9),
    "url": (r"https?://[^\s<>\"`\{\}\|\\\^\[\]]+", 10, 10**9),
    "ipv4": (r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\b", 7, 15),
    "ipv6": (r"(?i)[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}|(?:[0-9a-f]{1,4}:){1,7}:|::(?:[0-9a-f]{1,4}:){0,5}[0-9a-f]{1,4}", 2, 10**9),
    "credit_card": (r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2})[-\s]?\d{4,6}[-\s]?\d{4,5}(?:[-\s]?\d{4})?\b", 13, 22),
    "date_iso": (r"\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:T\d{2}:\d{2}(?::\d{2})?(?:Z|[+\-]\d{2}:?\d{2})?)?\b", 10, 10**9),
    "price": (r"[$€£]\s?\d{1,3}(?:[,.]?\d{3})*(?:[.,]\d{1,2})?|\d{1,3}(?:[,.]?\d{3})*(?:[.,]\d{1,2})?\s?[$€£]", 2, 10**9),
}

#: Signs of block pages that hold for any page, and those that hold for small ones.
BLOCK_ANY = (
    (r"Reference #\d+\.[0-9a-f]+\.\d+\.[0-9a-f]+", "Akamai reference"), (r"(?i)Pardon Our Interruption", "Akamai interruption"),
    (r"(?i)challenge-form.*__cf_chl_f_tk=", "Cloudflare challenge"), (r'<span class="cf-error-code">\d{4}</span>', "Cloudflare error"),
    (r"/cdn-cgi/challenge-platform/\S+orchestrate", "Cloudflare orchestrate"), (r"window\._pxAppId\s*=", "PerimeterX"),
    (r"(?i)captcha\.px-cdn\.net", "PerimeterX captcha"), (r"(?i)captcha-delivery\.com", "DataDome"), (r"_Incapsula_Resource", "Imperva/Incapsula"),
    (r"(?i)Incapsula incident ID", "Imperva incident"), (r"(?i)Sucuri WebSite Firewall", "Sucuri"),
    (r"KPSDK\.scriptStart\s*=\s*KPSDK\.now\(\)", "Kasada"), (r"(?i)blocked by network security", "generic network block"),
)
BLOCK_SMALL = (
    (r"(?i)Access Denied", "access denied"), (r"(?i)Checking your browser", "browser check"), (r"(?i)Just a moment", "Cloudflare wait"),
    (r'(?i)class="g-recaptcha"', "reCAPTCHA"), (r'(?i)class="h-captcha"', "hCaptcha"), (r"(?i)Access to This Page Has Been Blocked", "PerimeterX block"),
    (r"(?i)blocked by security", "security block"), (r"(?i)Request unsuccessful", "request failed"),
)
HEAD, SMALL, MEDIUM = 15_000, 10_000, 50_000
CONTENT_TAGS = r"(?i)<(?:p|h[1-6]|article|section|li|td|a|pre)[\s>]"


def find_all(text: Column, name: str) -> Column:
    """All values of a catalog pattern in a text, in order, of plausible length."""
    pattern, low, high = CATALOG[name]
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: (F.octet_length(v) >= low) & (F.octet_length(v) <= high))


def extract_patterns(df: DataFrame, text: str, names: list[str] | None = None) -> DataFrame:
    """df with (pattern, pos, value), one row a match; rows of df without a match are left out."""

    def rows(name: str) -> Column:
        return F.transform(find_all(F.col(text), name), lambda v, i: F.struct(F.lit(name).alias("pattern"), i.alias("pos"), v.alias("value")))

    each = [rows(n) for n in names or list(CATALOG)]
    return df.withColumn("_m", F.explode(F.flatten(F.array(*each)))).select(*df.columns, "_m.pattern", "_m.pos", "_m.value")


def _first_sign(text: Column, signs: tuple) -> Column:
    """Name of the first sign in a text, else null; one search for any of them spares sound texts the single ones."""
    name = F.when(F.lit(False), "")
    for pattern, label in signs:
        name = name.when(text.rlike(pattern), label)
    return F.when(text.rlike("|".join(f"(?:{p})" for p, _ in signs)), name)


def blocked_reason(status: Column, html: Column) -> Column:
    """Why a response is a block page, or null if it is none. Null html counts as empty, null status as 0.

    What costs a pass over the page is computed once: the page without code, and its visible size.
    """
    html, status = F.coalesce(html, F.lit("")), F.coalesce(status, F.lit(0))
    no_code = html
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<noscript[^>]*>.*?</noscript>"):
        no_code = F.regexp_replace(no_code, pattern, " ")

    def decide(f: Column) -> Column:
        size, code = F.octet_length(f["html"]), f["status"]
        start = F.regexp_extract(f["html"], r"^[\t\n\f\r ]*(\{|\[|<\?xml)", 1)
        visible = F.octet_length(F.btrim(F.regexp_replace(F.regexp_replace(f["no_code"], "<[^>]*>", ""), r"[\t\n\f\r ]+", " "), F.lit(" ")))
        bare = ~f["html"].rlike(CONTENT_TAGS)
        signals = (~f["html"].rlike("(?i)<body")).cast("int") + (visible < 50).cast("int") + bare.cast("int") + (f["html"].rlike(r"(?i)<script[\s>]") & bare & (visible < 100)).cast("int")
        broken = F.when(size < MEDIUM, let(signals, lambda n: F.when(n >= 2, "structural integrity failure").when((n >= 1) & (size < 5000), "structural integrity failure (small page)")))
        first = F.when(code == 429, "rate limited (429)").when(code.isin(403, 503) & (start == ""), F.concat(F.lit("blocked ("), code.cast("string"), F.lit(")")))
        return F.coalesce(
            first, _first_sign(F.substring(f["html"], 1, HEAD), BLOCK_ANY), F.when(size > HEAD, _first_sign(f["no_code"], BLOCK_ANY)),
            F.when(size < SMALL, _first_sign(f["html"], BLOCK_SMALL)), F.when((code == 200) & (size < 100), "near-empty response"), broken,
        )

    return let(F.struct(status.alias("status"), html.alias("html"), no_code.alias("no_code")), decide)


#: Labels of the classic catalog, read without regard to case, with letters and digits of all scripts.
CLASSIC: dict[str, str] = {
    "email": r"[\w.+-]+@[\w-]+\.[\w.-]+", "phone_intl": r"\+?\d[\d .()-]{7,}\d", "phone_us": r"\(?\d{3}\)?[ -. ]?\d{3}[ -. ]?\d{4}", "url": r"https?://[^\s\"'<>]+",
    "ipv4": r"(?:\d{1,3}\.){3}\d{1,3}", "ipv6": r"[A-F0-9]{1,4}(?::[A-F0-9]{1,4}){7}", "uuid": r"[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}",
    "currency": r"(?:USD|EUR|RM|\$|€|£)\s?\d+(?:[.,]\d{2})?", "percentage": r"\d+(?:\.\d+)?%", "number": r"\b\d{1,3}(?:[,.\s]\d{3})*(?:\.\d+)?\b", "date_iso": r"\d{4}-\d{2}-\d{2}", "date_us": r"\d{1,2}/\d{1,2}/\d{2,4}",
    "time_24h": r"\b(?:[01]?\d|2[0-3]):[0-5]\d(?:[:.][0-5]\d)?\b", "postal_us": r"\b\d{5}(?:-\d{4})?\b", "postal_uk": r"\b[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b", "html_color_hex": r"#[0-9A-Fa-f]{6}\b",
    "twitter_handle": r"@[\w]{1,15}", "hashtag": r"#[\w-]+", "mac_addr": r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}", "iban": r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", "credit_card": r"\b(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|3[47]\d{13}|6(?:011|5\d{2})\d{12})\b",
}


def extract_groups(df: DataFrame, text: str, wanted: list[tuple[str, str, int]]) -> DataFrame:
    """df with (pattern, pos, value, named), one row a match of each (name, regular expression, group).

    value is the chosen group (the whole match if there is none of that number); named maps each (?<name>…) group of
    the pattern to what it holds.
    """
    import re

    def rows(name: str, pattern: str, group: int) -> Column:
        python = pattern.replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace("(?P<!", "(?<!").replace("(?PP<", "(?P<")
        java = pattern.replace("(?P<", "(?<")
        found = re.compile(python)
        group = group if 0 <= group <= found.groups else 0
        whole = F.regexp_extract_all(F.col(text), F.lit(java), F.lit(group))
        names = {k: F.regexp_extract_all(F.col(text), F.lit(java), F.lit(i)) for k, i in found.groupindex.items()}

        def one(v: Column, i: Column) -> Column:
            named = F.map_from_arrays(F.array(*[F.lit(k) for k in names]), F.array(*[F.get(c, i) for c in names.values()])) if names else F.create_map().cast("map<string,string>")
            return F.struct(F.lit(name).alias("pattern"), i.alias("pos"), v.alias("value"), named.alias("named"))

        return F.transform(whole, one)

    each = F.flatten(F.array(*[rows(*w) for w in wanted]))
    return df.withColumn("_m", F.explode(each)).select(*df.columns, "_m.pattern", "_m.pos", "_m.value", "_m.named")


def classic_values(df: DataFrame, text: str, labels: list[str] | None = None) -> DataFrame:
    """df with (label, pos, value), one row a match of the classic catalog."""
    each = [_labelled(text, n) for n in labels or list(CLASSIC)]
    return df.withColumn("_m", F.explode(F.flatten(F.array(*each)))).select(*df.columns, "_m.label", "_m.pos", "_m.value")


def _labelled(text: str, name: str) -> Column:
    found = F.regexp_extract_all(F.col(text), F.lit(f"(?imU){CLASSIC[name]}"), F.lit(0))
    return F.transform(found, lambda v, i: F.struct(F.lit(name).alias("label"), i.alias("pos"), v.alias("value")))


def classic_spans(df: DataFrame, key: str, text: str, labels: list[str] | None = None) -> DataFrame:
    """(key, label, value, start, stop) of all matches, with their places in characters."""
    import re
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    made = {n: re.compile(CLASSIC[n], re.I | re.M) for n in labels or list(CLASSIC)}
    types = (to_arrow_type(df.schema[key].dataType), pa.string(), pa.string(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, m[0], m.start(), m.end()) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for n, r in made.items() for m in r.finditer(t)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[key, "label", "value", "start", "stop"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, label string, value string, start int, stop int")
