"""English stems (the second Porter algorithm), as a function of words, of Arrow word lists and of columns.

A column of word lists is stemmed in Arrow batches: each batch's words are made distinct before anything is stemmed.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

VOWELS = "aeiouy"
#: Fixed values of the published algorithm: irregular words, words left alone, and endings with their replacements.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
ALONE = set("inning outing canning herring earring proceed exceed succeed".split())
SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
SHORT = re.compile(r"^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$")
DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(w: str) -> tuple[int, int]:
    """Where the first and the second region begin."""
    m = re.match("gener|commun|arsen", w) or REGION.match(w)
    first = m.end() if m else len(w)
    m = REGION.match(w, first)
    return first, m.end() if m else len(w)


def _ending(w: str, endings) -> str | None:  # noqa: ANN001
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters are their own."""
    w = word.replace("’", "'").replace("‘", "'").lstrip("'")
    if len(w) <= 2:
        return word
    if w in IRREGULAR:
        return IRREGULAR[w]
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", w))
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].+s$", w):
        w = w[:-1]
    if w in ALONE:
        return w
    # past and progressive forms
    e = _ending(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and re.search("[aeiouy]", w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLE):
            w = w[:-1]
        elif r1 >= len(w) and SHORT.search(w):
            w += "e"
    if re.search(".[^aeiouy][yY]$", w):
        w = w[:-1] + "i"
    # longer endings, each in its region
    e = _ending(w, (*SECOND, "ogi", "li"))
    if e and len(w) - len(e) >= r1:
        before = w[: -len(e)]
        if e in SECOND:
            w = before + SECOND[e]
        elif (e == "ogi" and before.endswith("l")) or (e == "li" and before.endswith(tuple("cdeghkmnrt"))):
            w = before + ("og" if e == "ogi" else "")
    e = _ending(w, (*THIRD, "ative"))
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + THIRD.get(e, "")
    e = _ending(w, (*FOURTH, "ion"))
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not SHORT.search(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem_lists(words: pa.Array) -> pa.Array:
    """Lists of words with each word stemmed, null lists null."""
    flat = words.flatten().dictionary_encode()
    stems = pa.array([None if x is None else stem(x) for x in flat.dictionary.to_pylist()], pa.string())
    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = [0, *lengths.cumsum().tolist()]
    out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), stems.take(flat.indices))
    if not words.null_count:
        return out
    return pa.ListArray.from_arrays(pa.array([None if n else o for o, n in zip(offsets, [*words.is_null().to_pylist(), False], strict=True)], pa.int32()), out.values)


def stems(words: Column) -> Column:
    """A column of word lists, stemmed."""
    return _stems(words)


@arrow_udf(ArrayType(StringType()))
def _stems(words: pa.Array) -> pa.Array:
    return stem_lists(words)


def _in(region: str, ending: str) -> str:
    return f"length(w) - {len(ending)} >= {region}"


def sql(vocabulary: str) -> str:
    """CTEs over a one-column query of distinct words `t` that end in stem_of(t, stem): the algorithm again, for tests."""
    cut = lambda e: f"left(w, length(w) - {len(e)})"
    r = "'^[^aeiouy]*[aeiouy]+[^aeiouy]'"
    special = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    keep = ", ".join(f"'{w}'" for w in ALONE)
    short = "'^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$'"
    li = "regexp_matches(w, '[cdeghkmnrt]li$')"
    second = sorted([*SECOND, "ogi", "li"], key=len, reverse=True)
    two = " ".join(f"WHEN w LIKE '%{e}' THEN CASE WHEN {_in('r1', e)} " + (f"THEN {cut(e)} || '{SECOND[e]}'" if e in SECOND else f"AND w LIKE '%logi' THEN {cut(e)} || 'og'" if e == "ogi" else f"AND {li} THEN {cut(e)}") + " ELSE w END" for e in second)
    third = sorted([*THIRD, "ative"], key=len, reverse=True)
    three = " ".join(f"WHEN w LIKE '%{e}' THEN CASE WHEN {_in('r2' if e == 'ative' else 'r1', e)} THEN {cut(e)} || '{THIRD.get(e, '')}' ELSE w END" for e in third)
    fourth = sorted([*FOURTH, "ion"], key=len, reverse=True)
    four = " ".join(f"WHEN w LIKE '%{e}' THEN CASE WHEN {_in('r2', e)}" + (" AND regexp_matches(w, '[st]ion$')" if e == "ion" else "") + f" THEN {cut(e)} ELSE w END" for e in fourth)
    return f"""st0 AS (SELECT t, ltrim(replace(replace(t, '’', ''''), '‘', ''''), '''') AS o FROM ({vocabulary})),
st1 AS (SELECT t, o, regexp_replace(regexp_replace(o, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM st0),
st2 AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)')) WHEN regexp_matches(w, {r}) THEN length(regexp_extract(w, {r})) ELSE length(w) END AS r1 FROM st1),
st3 AS (SELECT * EXCLUDE (w), regexp_replace(w, '(''s''|''s|'')$', '') AS w, r1 + CASE WHEN regexp_matches(substr(w, r1 + 1), {r}) THEN length(regexp_extract(substr(w, r1 + 1), {r})) ELSE length(substr(w, r1 + 1)) END AS r2 FROM st2),
st4 AS (SELECT * EXCLUDE (w), CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2) WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END) WHEN regexp_matches(w, '[us]s$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, length(w) - 1) ELSE w END AS w FROM st3),
st5 AS (SELECT *, w AS alone, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$') AS e FROM st4),
st6 AS (SELECT *, e NOT IN ('', 'eed', 'eedly') AND regexp_matches(left(w, length(w) - length(e)), '[aeiouy]') AS gone FROM st5),
st7 AS (SELECT * EXCLUDE (w), CASE WHEN e IN ('eed', 'eedly') AND length(w) - length(e) >= r1 THEN left(w, length(w) - length(e)) || 'ee' WHEN gone THEN left(w, length(w) - length(e)) ELSE w END AS w FROM st6),
st8 AS (SELECT * EXCLUDE (w), CASE WHEN NOT gone THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN regexp_matches(w, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(w, length(w) - 1) WHEN r1 >= length(w) AND regexp_matches(w, {short}) THEN w || 'e' ELSE w END AS w FROM st7),
st9 AS (SELECT * EXCLUDE (w), CASE WHEN regexp_matches(w, '.[^aeiouy][yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM st8),
st10 AS (SELECT * EXCLUDE (w), CASE {two} ELSE w END AS w FROM st9), st11 AS (SELECT * EXCLUDE (w), CASE {three} ELSE w END AS w FROM st10), st12 AS (SELECT * EXCLUDE (w), CASE {four} ELSE w END AS w FROM st11),
st13 AS (SELECT * EXCLUDE (w), CASE WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(left(w, length(w) - 1), {short}))) THEN left(w, length(w) - 1) WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END AS w FROM st12),
stem_of AS (SELECT t, CASE WHEN length(o) <= 2 THEN t WHEN alone IN ({keep}) THEN alone ELSE CASE o {special} ELSE replace(w, 'Y', 'y') END END AS stem FROM st13)"""
