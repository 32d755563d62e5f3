"""Text functions over columns: all built-in expressions, so they stay in generated code.

White space is space, tab, newline, carriage return, vertical tab and form feed. Null in gives null out.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

WS = r"[\t\n\x0B\f\r ]"
#: Characters cut from the ends of words.
EDGE = ".,;:!?\"'()[]{}"
EDGE_WIDE = EDGE + "<>-_/\\@#$%^&*+=~`"

#: English stop words.
STOP_WORDS = "a an the and or but in on at to for of is it be as was with by that this from are were been have has had not no do does did will would can could should may might i you he she we they me him her us them my your his its our their".split()

#: The twenty commonest function words of each Latin-script language, in order of precedence.
LANGUAGE_WORDS = {
    "en": "the be to of and a in that have i it for not on with he as you do at",
    "es": "de la que el en y a los se del las un por con no una su para es al",
    "fr": "de la le et les des en un du une que est dans qui au ce il pas plus sur",
    "de": "der die und in den von zu das mit sich des auf ist ein dem nicht eine als auch es",
    "pt": "de a o que e do da em um para com uma os no se na por mais as dos",
    "it": "di e il la in che un per del una dei le della con si da al lo sono gli",
    "nl": "de het een van en in is dat op te voor zijn met die niet aan er maar ook als",
    "ro": "de in la si cu din pe un ce mai care este nu se o pentru sau lui sunt dar",
    "sv": "och i att en det som har med av den till var inte ett om jag han hade vid kan",
    "da": "og i at en det er til den af som med har han var jeg ikke et hun blev kan",
    "no": "og i det er en til som har med av den at ikke han var jeg et hun ble kan",
    "pl": "i w na nie to jest sie z do jak ale ze co tak za od po ich ten tego",
}
#: Unicode ranges by script, in order of precedence, and the language a script stands for.
SCRIPTS = {"latin": r"[\x{41}-\x{24F}&&\p{L}]", "cyrillic": r"[\x{400}-\x{4FF}&&\p{L}]", "cjk": r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}&&\p{L}]", "arabic": r"[\x{600}-\x{6FF}&&\p{L}]", "devanagari": r"[\x{900}-\x{97F}&&\p{L}]", "hangul": r"[\x{AC00}-\x{D7AF}&&\p{L}]"}
SCRIPT_LANGUAGE = {"cyrillic": ("ru", 0.75), "arabic": ("ar", 0.75), "devanagari": ("hi", 0.75), "hangul": ("ko", 0.85)}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def html_to_text(html: Column) -> Column:
    """Visible text: script, style and noscript blocks and all tags become a space, white space runs one space."""
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<noscript[^>]*>.*?</noscript>", r"<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    return F.btrim(F.regexp_replace(html, r"[\t\n\f\r ]+", " "), F.lit(" "))


def fields(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, WS + "+"), lambda w: w != "")


def words(text: Column, edge: str = EDGE_WIDE) -> Column:
    """Lower-case runs without white space, without punctuation at their edges; what is then empty is out."""
    cut = F.transform(fields(F.lower(text)), lambda w: F.btrim(w, F.lit(edge)))
    return F.filter(cut, lambda w: w != "")


def content_words(tokens: Column, least: int = 3) -> Column:
    """Tokens of at least so many bytes that are no stop words."""
    return F.filter(tokens, lambda w: (F.octet_length(w) >= least) & ~w.isin(STOP_WORDS))


def sentence_marks(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[.!?]"))


def paragraphs(text: Column) -> Column:
    """Blocks of lines with more than white space."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(F.regexp_replace(x, WS, "") == "", F.lit("0")).otherwise(F.lit("1")))
    return F.regexp_count(F.array_join(lines, ""), F.lit("1+"))


def syllables(word: Column) -> Column:
    """Vowel groups of a lower-case word, less silent endings, at least one."""
    n = F.regexp_count(word, F.lit("[aeiouy]+"))
    n = n - F.when(word.endswith("e") & ~word.endswith("le"), 1).otherwise(0)
    n = n - F.when(word.rlike(r"[^td]ed$") & (F.octet_length(word) > 3), 1).otherwise(0)
    return F.when(F.octet_length(word) <= 2, 1).otherwise(F.greatest(n, F.lit(1)))


def readability(text: Column) -> Column:
    """Struct of counts, the three classic scores (two decimals, half up) and the reading level; zeros and '' without words."""
    # syllables of each word, counted once and used three times
    syl = F.transform(fields(text), lambda x: let(F.lower(F.btrim(x, F.lit(EDGE))), syllables))
    facts = let(syl, lambda x: F.struct(F.size(x).alias("n"), F.aggregate(x, F.lit(0), lambda a, b: a + b).alias("total"), F.size(F.filter(x, lambda k: k >= 3)).alias("hard"), F.greatest(sentence_marks(text), F.lit(1)).alias("s")))

    def scores(f: Column) -> Column:
        per_sentence, per_word = f["n"] / f["s"], f["total"] / f["n"]
        return F.struct(
            f["n"].alias("n"), F.when(f["n"] == 0, 0).otherwise(f["s"]).alias("s"), f["total"].alias("total"),
            F.when(f["n"] == 0, 0.0).otherwise(F.floor((206.835 - 1.015 * per_sentence - 84.6 * per_word) * 100 + 0.5) / 100.0).alias("ease"),
            F.when(f["n"] == 0, 0.0).otherwise(F.floor((0.39 * per_sentence + 11.8 * per_word - 15.59) * 100 + 0.5) / 100.0).alias("grade"),
            F.when(f["n"] == 0, 0.0).otherwise(F.floor((0.4 * (per_sentence + 100 * f["hard"] / f["n"])) * 100 + 0.5) / 100.0).alias("fog"),
        )

    def named(r: Column) -> Column:
        g = r["grade"]
        level = F.when(r["n"] == 0, "").when(g < 1, "kindergarten").when(g < 6, "elementary").when(g < 9, "middle_school").when(g < 13, "high_school").when(g < 17, "college").otherwise("graduate")
        return F.struct(
            r["n"].cast("int").alias("word_count"), r["s"].cast("int").alias("sentence_count"), r["total"].cast("int").alias("syllable_count"),
            r["ease"].alias("flesch_reading_ease"), g.alias("flesch_kincaid"), r["fog"].alias("gunning_fog"), level.alias("reading_level"),
        )

    return let(let(facts, scores), named)


def token_estimate(text: Column) -> Column:
    """Words / 0.75, rounded up."""
    return F.floor((F.size(fields(text)).cast("long") * 4 + 2) / 3).cast("long")


def language(text: Column) -> Column:
    """Struct language, confidence, script, by the script of the letters and, for Latin, by common words."""
    seen = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\-\x{AD}\x{2010}]+"))
    facts = F.struct(
        F.array(*[F.regexp_count(text, F.lit(pattern)) for pattern in SCRIPTS.values()]).alias("counts"), F.regexp_count(text, F.lit(r"\p{L}")).alias("letters"),
        let(seen, lambda x: F.array(*[F.size(F.array_intersect(x, literals(ws.split()))) for ws in LANGUAGE_WORDS.values()])).alias("hits"),
        text.rlike(r"[\x{3040}-\x{30FF}]").alias("kana"), (F.regexp_replace(text, WS, "") == "").alias("empty"),
    )

    def decide(f: Column) -> Column:
        top, best = F.array_max(f["counts"]), F.array_max(f["hits"])
        # the first place of the greatest count decides ties
        named = F.element_at(literals(list(SCRIPTS)), F.array_position(f["counts"], top).cast("int"))
        script = F.when(f["empty"], "unknown").when((f["letters"] == 0) | (top < 0.3 * f["letters"]), "latin").otherwise(named)
        latin = F.when(best == 0, "unknown").otherwise(F.element_at(literals(list(LANGUAGE_WORDS)), F.array_position(f["hits"], best).cast("int")))
        return F.struct(script.alias("script"), latin.alias("latin"), (best / 20.0).alias("share"), f["kana"].alias("kana"))

    def name(r: Column) -> Column:
        lang = F.when(r["script"] == "unknown", "unknown").when(r["script"] == "cjk", F.when(r["kana"], "ja").otherwise("zh"))
        confidence = F.when(r["script"] == "unknown", 0.0).when(r["script"] == "cjk", 0.8)
        for script, (code, value) in SCRIPT_LANGUAGE.items():
            lang, confidence = lang.when(r["script"] == script, code), confidence.when(r["script"] == script, value)
        return F.struct(lang.otherwise(r["latin"]).alias("language"), confidence.otherwise(r["share"]).alias("confidence"), r["script"].alias("script"))

    return let(let(facts, decide), name)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def head_facts(html: Column) -> Column:
    """Struct title, description, keywords, og_title, canonical, language of a page's head, without parsing it."""
    head = F.substring_index(html, "</head>", 1)

    def meta(name: str) -> Column:
        before = F.regexp_extract(head, rf'(?i)<meta\s[^>]*(?:name|property)="{name}"[^>]*content="([^"]*)"', 1)
        after = F.regexp_extract(head, rf'(?i)<meta\s[^>]*content="([^"]*)"[^>]*(?:name|property)="{name}"', 1)
        return F.when(before != "", before).otherwise(after)

    return F.struct(
        F.btrim(F.regexp_extract(head, r"(?i)<title[^>]*>([^<]*)</title>", 1)).alias("title"), meta("description").alias("description"), meta("keywords").alias("keywords"), meta("og:title").alias("og_title"),
        F.regexp_extract(head, r'(?i)<link\s[^>]*rel="canonical"[^>]*href="([^"]*)"', 1).alias("canonical"), F.regexp_extract(head, r'(?i)<html[^>]*\slang="([^"]*)"', 1).alias("language"),
    )


def head_fingerprint(facts: Column) -> Column:
    """SHA-256 of the signals by which a page's head is known again."""
    return F.sha2(F.concat_ws("|", facts["title"], facts["description"], facts["og_title"], facts["canonical"]), 256)


def strip_fences(text: Column) -> Column:
    """Text without the Markdown fence around it."""
    return F.btrim(F.regexp_replace(F.btrim(text, F.lit(" \t\r\n")), r"^```[A-Za-z0-9_-]*[ \t]*\r?\n|\r?\n?```$", ""), F.lit(" \t\r\n"))


def tag_contents(text: Column, tag: str) -> Column:
    """What stands between each <tag> and </tag>, trimmed."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), lambda x: F.btrim(x, F.lit(" \t\r\n")))


#: Elements taken out of HTML before its structure is read, and attributes that are kept.
BULK = ("script", "style", "noscript", "svg", "header", "footer", "nav")
ATTRIBUTES = "href src alt title class id type name content property rel".split()


def preprocess(html: Column, strict: bool = False, most: int = 0) -> Column:
    """HTML with its structure but without bulk: no scripts, styles, comments, drawings, page heads and feet, other attributes.

    strict also takes asides, forms, images and empty elements, and cuts the result at `most` characters if that is
    above 0. White space runs of two and more become one space.
    """
    for tag in BULK[:2]:
        html = F.regexp_replace(html, rf"(?i)<{tag}[\s>][\s\S]*?</{tag}>", "")
    html = F.regexp_replace(html, r"<!--[\s\S]*?-->", "")
    for tag in BULK[2:]:
        html = F.regexp_replace(html, rf"(?i)<{tag}[\s>][\s\S]*?</{tag}>", "")
    # cut each start tag's attributes: the tags between the text pieces are rewritten one by one
    pieces = F.regexp_extract_all(html, F.lit(r"[^<]+|<[a-zA-Z][a-zA-Z0-9]*(?:\s+[^>]*?)?>|<"), F.lit(0))

    def rewrite(p: Column) -> Column:
        name = F.regexp_extract(p, r"^<([a-zA-Z][a-zA-Z0-9]*)", 1)
        found = F.regexp_extract_all(p, F.lit(r"""\s+([a-zA-Z][\w-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?)"""), F.lit(1))
        kept = F.filter(found, lambda a: F.lower(F.regexp_extract(a, r"^([a-zA-Z][\w-]*)", 1)).isin(ATTRIBUTES))
        return F.when(p.rlike(r"^<[a-zA-Z][a-zA-Z0-9]*\s+[^>]*>$"), F.concat(F.lit("<"), name, F.when(F.size(kept) > 0, F.concat(F.lit(" "), F.array_join(kept, " "))).otherwise(""), F.lit(">"))).otherwise(p)

    html = F.array_join(F.transform(pieces, rewrite), "")
    html = F.btrim(F.regexp_replace(html, r"\s{2,}", " "), F.lit(" \t\r\n\x0b\f"))
    if strict:
        for tag in ("aside", "form"):
            html = F.regexp_replace(html, rf"(?i)<{tag}[\s>][\s\S]*?</{tag}>", "")
        html = F.regexp_replace(F.regexp_replace(html, r"<img[^>]*>", ""), r"<[a-z][a-z0-9]*[^>]*>\s*</[a-z][a-z0-9]*>", "")
        html = F.btrim(F.regexp_replace(html, r"\s{2,}", " "), F.lit(" \t\r\n\x0b\f"))
        html = F.substring(html, 1, most) if most > 0 else html
    return html


def json_objects(text: Column) -> Column:
    """The parts of a text that are flat JSON objects and can be read; what stands between them is left out."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda x: F.try_parse_json(x).isNotNull())


def escaped_json(text: Column) -> Column:
    """A text as it stands inside a JSON string."""
    for sign, code in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return F.regexp_replace(text, r"[\x00-\x1f]", "")


def shortened(text: Column, most: int) -> Column:
    """At most so many characters, the last three of them dots where something is cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(0, most - 3)), F.lit("...")))


def overlap(a: Column, b: Column) -> Column:
    """Struct (jaccard, smaller): what two word sets share of their union and of the smaller one; 0 where that is empty."""

    def measure(x: Column) -> Column:
        both, least = F.size(F.array_intersect(x["a"], x["b"])), F.least(F.size(x["a"]), F.size(x["b"]))
        union = F.size(x["a"]) + F.size(x["b"]) - both
        return F.struct(F.when(union > 0, both / union).otherwise(0.0).alias("jaccard"), F.when(least > 0, both / least).otherwise(0.0).alias("smaller"))

    return let(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), measure)


def most_relevant(df: DataFrame, key: str, text: str, query: str, k: int) -> DataFrame:
    """(key, shared): the k texts that share most words with the query, a report; ties by key, null texts left out."""
    wanted = sorted(set(w.strip(EDGE_WIDE) for w in query.lower().split()) - {""})
    shared = F.size(F.array_intersect(F.array_distinct(words(F.col(text))), literals(wanted)))
    return df.where(F.col(text).isNotNull()).select(key, shared.alias("shared")).orderBy(F.desc("shared"), key).limit(k)


@arrow_udf(StringType())
def xxh64(text: pa.Array) -> pa.Array:
    """The 64-bit xxHash of a text (seed 0) in hexadecimal, null for null."""
    import xxhash

    return pa.array([None if t is None else xxhash.xxh64_hexdigest(t) for t in text.to_pylist()], pa.string())
