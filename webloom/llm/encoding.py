"""Garbled text from wrong character encoding (problem 10).

Adjacent characters are scored by their mutual information over the whole corpus; the table tells every letter of
Latin-1 and Cyrillic and every sign in common use apart and takes other characters by class, so its size is fixed.
Pairs that few documents hold count as improbable however well they go together, as garbled characters always do.
Maximum-scoring segments of improbable pairs isolate the suspicious runs, and inverse mappings are tried only inside
them: bytes of a single-byte encoding that are valid UTF-8, Windows punctuation read as Latin-1, and Cyrillic
encodings mixed up with one another. A mapping counts only if what it restores is more probable.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Single-byte encodings that UTF-8 is wrongly read in, Cyrillic bytes and what they are wrongly read in.
UTF8_READ_AS = ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251", "cp850", "cp1250", "koi8-r")
CYRILLIC_READ_AS = (("cp1251", "latin-1"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("koi8-r", "latin-1"), ("cp1251", "koi8-r"), ("cp866", "cp1251"))
#: A run must reach this score in bits; offset taken from each pair's improbability; rounds of wrong decoding undone.
MIN_SCORE, OFFSET, ROUNDS = 1.0, 0.3, 3
#: Bits a letter by which a Cyrillic reading must be more probable than the text as it stands, and letters needed.
GAIN, LETTERS = 1.5, 4
#: Share of the documents outside ASCII below which a pair counts as improbable by the bits it lies below.
RARE = 0.1
CLASSES = 256
UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}")
STRETCH, PIECES = re.compile(r"[^\x00-\x7f]+"), re.compile(r"[^\x00-\x7f]+|[\x00-\x7f]+")
#: A word of one letter before and after a place.
BEFORE, AFTER = re.compile(r"(?:^|\s)(\S)\s\Z"), re.compile(r"\s(\S)(?!\S)")
#: Words between ASCII white space, what a Cyrillic mix-up may have made, and bits by which a run of words may sink below its peak.
TOKEN, MIXED, SINK = re.compile(r"[^ \t\r\n]+"), re.compile(r"[À-ÿ]{4}|[Ѐ-ӿ]{2}"), 20.0


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of each code point below 0x10000: one each for Latin-1, Cyrillic and common signs, else by script and kind."""
    out = np.full(0x10000, 1, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if c < 0x80:
            out[c] = {"Lu": 2, "Ll": 3, "Nd": 4}.get(kind, 5 if ch in " \t\r\n" else 6)
        elif c < 0xA0:
            out[c] = 7
        elif c < 0x250:
            out[c] = 8 if kind == "Lu" else 9
        elif 0x370 <= c < 0x400:
            out[c] = 10 if kind == "Lu" else 11
        elif 0x400 <= c < 0x530:
            out[c] = 12 if kind == "Lu" else 13
        elif 0x2000 <= c < 0x2070:
            out[c] = 14
        elif 0x20A0 <= c < 0x2100:
            out[c] = 15
        elif 0x2100 <= c < 0x2200:
            out[c] = 16
        elif 0x2200 <= c < 0x2300:
            out[c] = 17
        elif 0x2500 <= c < 0x2600:
            out[c] = 18
        elif c >= 0x2000:
            out[c] = 19
    for first, last, cls in ((0x3000, 0x3040, 20), (0x3040, 0x30A0, 21), (0x30A0, 0x3100, 22), (0x3400, 0xA000, 23), (0xAC00, 0xD7B0, 24), (0xFF00, 0xFFF0, 25), (0xFFFD, 0xFFFE, 26)):
        out[first:last] = cls
    alone = [*range(0xA0, 0x100), *range(0x410, 0x450), 0x401, 0x451, *map(ord, "ŒœŠšŽžŸƒĄąĆćĘęŁłŃńŚśŹźŻżĂăŐőŰűĞğİıŞş"), *map(ord, "–—‘’‚“”„†‡•…‰‹›€™−№")]
    out[alone] = np.arange(32, 32 + len(alone))
    return out


def class_of(codes: np.ndarray) -> np.ndarray:
    return class_table()[np.minimum(codes, 0xFFFF)]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all texts, each followed by a line end; places of pairs that are not both ASCII; the text of each such pair)."""
    codes = codes_of("\n".join(texts) + "\n")
    strange = codes > 0x7F
    hot = np.flatnonzero(strange[:-1] | strange[1:])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return codes, hot, np.searchsorted(ends, hot, "right")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each pair of classes, each sign and each pair of lower-cased Cyrillic letters, one row each a task."""
    pairs, letters, digrams, seen = np.zeros(CLASSES * CLASSES, np.int64), np.zeros(0x10000, np.int64), np.zeros(256 * 256, np.int64), 0
    low = np.arange(256)
    low[0x10:0x30] += 0x20
    low[0x00:0x10] += 0x50
    for b in batches:
        for start in range(0, b.num_rows, 512):
            texts = [t for t in b.column(0).slice(start, 512).to_pylist() if t and not t.isascii()]
            if not texts:
                continue
            seen += len(texts)
            codes, hot, doc = _joined(texts)
            c, doc = class_of(codes).astype(np.int64), doc.astype(np.int64)
            # once a document, so that one long garbled text has no more weight than another
            pairs += np.bincount(np.unique(doc << 16 | c[hot] << 8 | c[hot + 1]) & 0xFFFF, minlength=CLASSES * CLASSES)
            at = codes[hot]
            pick = at > 0x7F
            letters += np.bincount(np.unique(doc[pick] << 16 | np.minimum(at[pick], 0xFFFF).astype(np.int64)) & 0xFFFF, minlength=0x10000)
            x, y = codes[hot].astype(np.int64) - 0x400, codes[hot + 1].astype(np.int64) - 0x400
            pick = (x >= 0) & (x < 256) & (y >= 0) & (y < 256)
            digrams += np.bincount(np.unique(doc[pick] << 16 | low[x[pick]] << 8 | low[y[pick]]) & 0xFFFF, minlength=256 * 256)
    rows = [(kind, k, int(table[k])) for kind, table in (("p", pairs), ("c", letters), ("d", digrams)) for k in np.flatnonzero(table).tolist()]
    if rows:
        rows.append(("n", 0, seen))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], (pa.string(), pa.int32(), pa.int64())[i]) for i in range(3)], names=["kind", "key", "n"])


class Model:
    """Scores of the corpus; its size is bounded by the alphabet, not by the number of documents."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        n = np.zeros((CLASSES, CLASSES))
        self.chars: dict[str, int] = {}
        self.digrams: dict[str, int] = {}
        self.readings: dict[tuple[str, str, str], tuple[str, float, int]] = {}
        docs = 1
        for kind, key, v in rows:
            if kind == "p":
                n[key >> 8, key & 255] = v
            elif kind == "c":
                self.chars[chr(key)] = v
            elif kind == "d":
                self.digrams[chr(0x400 + (key >> 8)) + chr(0x400 + (key & 255))] = v
            else:
                docs = max(1, v)
        total = max(1.0, n.sum())
        left, right = n.sum(1) / total, n.sum(0) / total
        mi = np.log2(((n + 0.5) / total) / np.maximum(np.outer(left, right), 0.5 / total))
        # garbled characters go together all the time, so their information alone would make them look normal: a pair
        # that fewer than RARE of the documents hold counts as improbable by as many bits as it lies below
        share = (n + 0.5) / docs
        self.improbable = np.clip(np.where(share < RARE, np.maximum(-mi, np.log2(RARE / share)), np.minimum(-mi, 0)), -4, 8)

    def suspicious(self, texts: list[str]) -> np.ndarray:
        """Whether each text holds an improbable pair, a control or a replacement sign, without which it has no run."""
        codes, hot, doc = _joined(texts)
        c = class_of(codes)
        bad = (self.improbable[c[hot], c[hot + 1]] > OFFSET) | np.isin(c[hot], (7, 26))
        return np.bincount(doc[bad], minlength=len(texts)) > 0

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Maximum-scoring segments of improbable adjacent characters, widened to whole stretches outside ASCII."""
        codes = codes_of(text)
        strange = codes > 0x7F
        c = class_of(codes)
        out: list[tuple[int, int]] = []
        hot = np.flatnonzero(strange[:-1] | strange[1:])
        score = self.improbable[c[hot], c[hot + 1]] - OFFSET
        k, n, places, scores = 0, len(hot), hot.tolist(), score.tolist()
        starts = np.flatnonzero(score > 0).tolist()
        for first in starts:
            if first < k:
                continue
            # a segment begins at an improbable pair and ends where its sum falls to nothing or far below its peak
            cum = top = 0.0
            k, end, last = first, first, places[first] - 1
            while k < n:
                cum += scores[k] - 2.0 * (places[k] - last - 1)
                if cum <= 0 or cum < top - 6:
                    break
                if cum > top:
                    top, end = cum, k
                last = places[k]
                k += 1
            k = end + 1
            if top >= MIN_SCORE:
                out.append((places[first], places[end] + 2))
        for a in np.flatnonzero((codes >= 0x80) & (codes < 0xA0) | (codes == 0xFFFD)).tolist():
            out.append((a, a + 1))
        wide: list[tuple[int, int]] = []
        for a, b in sorted(out):
            while a > 0 and strange[a - 1]:
                a -= 1
            while b < len(codes) and strange[b]:
                b += 1
            if wide and a <= wide[-1][1] + 1:
                wide[-1] = (wide[-1][0], max(b, wide[-1][1]))
            else:
                wide.append((a, b))
        return wide

    def known(self, ch: str) -> bool:
        """A character that stands in the corpus, one of a script or sign range in common use, or a control that itself needs undoing."""
        c = ord(ch)
        return 0xA1 <= c < 0x180 or 0x410 <= c < 0x450 or c in (0x401, 0x451) or 0x2010 <= c < 0x2040 or 0x3000 <= c < 0x3100 or 0x4E00 <= c < 0xA000 or 0xFF00 <= c < 0xFF66 or c in (0xA0, 0x20AC, 0x2122, 0x2212, 0x2116) or 0x80 <= c < 0xA0 or (c < 0xFFFD and self.chars.get(ch, 0) >= 3)

    def reading(self, word: str, right: str, wrong: str) -> tuple[str, float, int]:
        """(word with the mix-up undone, bits by which it is more probable, pairs of letters changed)."""
        if word.isascii():
            return word, 0.0, 0
        known = self.readings.get((word, right, wrong))
        if known is None:
            if len(self.readings) >= 200_000:
                self.readings.clear()
            table = to_bytes(wrong)
            fixed = "".join(c if c < "\x80" or ord(c) not in table else bytes([table[ord(c)]]).decode(right, "ignore") or c for c in word)
            pairs = [(word[i : i + 2], fixed[i : i + 2]) for i in range(len(word) - 1) if word[i] > "\x7f" and word[i + 1] > "\x7f" and word[i : i + 2] != fixed[i : i + 2]]
            gain = sum(math.log2((self.digrams.get(y.lower(), 0) + 0.1) / (self.digrams.get(x.lower(), 0) + 0.1)) for x, y in pairs)
            known = self.readings[word, right, wrong] = (fixed, gain, len(pairs))
        return known


@lru_cache(16)
def to_bytes(encoding: str) -> dict[int, int]:
    """Character -> byte of a single-byte encoding; bytes it leaves open stand for themselves."""
    out = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            ch = chr(b)
        out[ord(ch)] = b
    return out


def undo(part: str, model: Model) -> str:
    """part with the UTF-8 sequences that one wrong single-byte decoding made of it restored, or as it is."""
    best, gain = part, 0
    for encoding in UTF8_READ_AS:
        table = to_bytes(encoding)
        made, i, n = [], 0, 0
        while i < len(part):
            j = i
            while j < len(part) and ord(part[j]) in table:
                j += 1
            piece = part[i:j]
            if piece:
                raw, at = bytes(table[ord(c)] for c in piece), 0
                for m in UTF8.finditer(raw):
                    ch = m[0].decode("utf-8")
                    if not model.known(ch):
                        continue
                    made += [piece[at : m.start()], ch]
                    at = m.end()
                    n += len(m[0])
                made.append(piece[at:])
            if j < len(part):
                made.append(part[j])
            i = max(j + 1, i + 1)
        if n > gain:
            best, gain = "".join(made), n
    return best


def repair(text: str, model: Model) -> tuple[bool, bool, str]:
    """(garbled, whole again, text). Null or ASCII text is never garbled."""
    garbled = lost = False
    for _ in range(ROUNDS):
        changed, out, at = False, [], 0
        for a, b in _spans(text, model.runs(text)):
            part = text[a:b]
            fixed = _cyrillic_words(part, model)
            if fixed == part:
                fixed = "".join(_undone(x, model) if x[0] > "\x7f" else x for x in PIECES.findall(part))
            out += [text[at:a], fixed]
            changed |= fixed != part
            at = b
        out.append(text[at:])
        text = "".join(out)
        garbled |= changed
        if not changed:
            break
    lost = "\ufffd" in text or any(0x80 <= ord(c) < 0xA0 for c in text)
    return garbled or lost, garbled and not lost, text


def _spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs widened to whole words and to the single letters beside them; runs with nothing between are one."""
    out: list[tuple[int, int]] = []
    for a, b in runs:
        while a > 0 and text[a - 1] not in " \t\r\n":
            a -= 1
        while b < len(text) and text[b] not in " \t\r\n":
            b += 1
        while (m := BEFORE.search(text, max(0, a - 4), a)) and m[1] > "\x7f":
            a = m.start(1)
        while (m := AFTER.match(text, b)) and m[1] > "\x7f":
            b = m.end(1)
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _undone(part: str, model: Model) -> str:
    fixed = undo(part, model)
    return _controls(part) if fixed == part else fixed


def _controls(part: str) -> str:
    """C1 controls are Windows punctuation read as Latin-1, unless the byte has no meaning there."""
    if not any("\x80" <= c <= "\x9f" for c in part):
        return part
    return "".join(bytes([ord(c)]).decode("cp1252", "ignore") or c if "\x80" <= c <= "\x9f" else c for c in part)


def _cyrillic_words(text: str, model: Model) -> str:
    """Maximum-scoring runs of words that become clearly more probable Cyrillic by a mix-up are read that way, the rest stays."""
    if not MIXED.search(text):
        return text
    words, runs = list(TOKEN.finditer(text)), []
    for right, wrong in CYRILLIC_READ_AS:
        got = [model.reading(w[0], right, wrong) for w in words]
        latin = wrong in ("latin-1", "cp1252")
        k = 0
        while k < len(got):
            if got[k][1] <= 0:
                k += 1
                continue
            a, b, peak, score, n, pairs = k, k + 1, 0.0, 0.0, 0, 0
            while k < len(got):
                score += got[k][1]
                pairs += got[k][2]
                if score <= 0 or score < peak - SINK:
                    break
                if score > peak:
                    b, peak, n = k + 1, score, pairs
                k += 1
            k = b
            if latin:
                if not any(sum("À" <= c <= "ÿ" for c in x) >= LETTERS for w in words[a:b] for x in STRETCH.findall(w[0])):
                    continue
                # single Latin letters beside garbled words belong to them
                while a and got[a - 1][2] == 0 and got[a - 1][0] != words[a - 1][0]:
                    a -= 1
                while b < len(got) and got[b][2] == 0 and got[b][0] != words[b][0]:
                    b += 1
            if n >= LETTERS - 1 and peak > GAIN * n:
                runs.append((-peak, a, b, [x for x, _, _ in got[a:b]]))
    fixed: dict[int, str] = {}
    for _, a, b, new in sorted(runs):
        if not any(k in fixed for k in range(a, b)):
            fixed.update(zip(range(a, b), new, strict=True))
    out, at = [], 0
    for k in sorted(fixed):
        out += [text[at : words[k].start()], fixed[k]]
        at = words[k].end()
    return "".join([*out, text[at:]])


def train(documents: DataFrame, text: str = "text") -> Model:
    """Counts over all documents; what comes back is bounded by the alphabet of the corpus."""
    counts = documents.select(text).mapInArrow(_count, "kind string, key int, n long")
    return Model([tuple(r) for r in counts.groupBy("kind", "key").agg(F.sum("n")).collect()])


def find_garbled(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restorable, restored) of each document with at least one garbled character.

    restored is null where characters were lost. Null, empty and plain ASCII texts are never garbled; repeated
    rows give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(train(documents, text))
    schema = f"`{doc_id}` {documents.schema[doc_id].dataType.simpleString()}, restorable boolean, restored string"
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(documents.schema[doc_id].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            ids, ok, out = [], [], []
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                some = [(d, t) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if t and not t.isascii()]
                for (d, t), odd in zip(some, m.suspicious([t for _, t in some]) if some else (), strict=True):
                    if odd:
                        garbled, whole, fixed = repair(t, m)
                        if garbled:
                            ids.append(d)
                            ok.append(whole)
                            out.append(fixed if whole else None)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(ok, pa.bool_()), pa.array(out, pa.string())], names=[doc_id, "restorable", "restored"])

    return documents.select(doc_id, text).mapInArrow(run, schema)
