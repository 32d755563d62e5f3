"""English syllables by hyphenation patterns.

The patterns work as in typesetting: letters with numbers between them, the greatest number at a place decides, and
an odd one divides. They are not a copied list but made from rules: a vowel takes the consonant before it, or the
cluster that may begin a syllable; vowels that don't run together are parted; silent endings stay with what they
follow. A word has one syllable more than it has divisions.
"""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS, CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"
#: Clusters that begin syllables.
ONSETS = "bl br ch cl cr dr dw fl fr gh gl gr kn ph pl pr sc sh sk sl sm sn sp st sw th tr tw wh wr scr sch shr spl spr str thr".split()
#: Vowels in hiatus, endings in which they run together, and openings and words of their own.
HIATUS = "i1a i1o i1u e1o u1a u1o i1e1t i1e1nc i1e1nt u1ou a1o a1ing e1ing i1ing o1ing u1ing y1ing ay1o e1um u1um".split()
TOGETHER = "ti2on si2on ci2on gi2on xi2on li2on ni2on ti2a si2a ci2a gi2a ti2ou ci2ou gi2ou xi2ou ci2en ti2en ge2on pe2op qu2a qu2o gu2a gu2e li2ar ie2u iou2".split()
OPENINGS = [".pre1e", ".co1op", "cre1at", ".are1a", ".ide1a", ".be1ing", ".sci1e", ".the1a", ".re1act", "ti3at", ".re1al1i"]


def _split(pattern: str) -> tuple[str, tuple[int, ...]]:
    letters, values = "", [0]
    for c in pattern:
        if c.isdigit():
            values[-1] = int(c)
        else:
            letters += c
            values.append(0)
    return letters, tuple(values)


@lru_cache(1)
def patterns() -> dict[str, tuple[int, ...]]:
    """All patterns by their letters; a dot is an end of the word."""
    out: dict[str, list[int]] = {}

    def add(pattern: str) -> None:
        letters, values = _split(pattern)
        old = out.setdefault(letters, [0] * len(values))
        out[letters] = [max(a, b) for a, b in zip(old, values, strict=True)]

    for v in VOWELS:
        for c in CONSONANTS:
            add(f"1{c}{v}")
        for o in ONSETS:
            add(f"3{'4'.join(o)}{v}" if len(o) < 3 else f"5{'6'.join(o)}{v}")
    add("q2u")
    for p in HIATUS:
        add(p)
    for p in [*TOGETHER, *OPENINGS]:
        add(re.sub(r"\d", lambda m: str(int(m[0]) + 2), p))
    # endings: an e at the end is silent but after a consonant and l, one before s or d but after what makes it heard
    for c in CONSONANTS:
        add(f"8{c}e.")
        add(f"8{c}es.")
        add(f"8{c}ed.")
        # and before endings of their own
        for end in ("fu", "less", "ness", "ly.", "some."):
            add(f"8{c}e{end}")
    for c in "bcdfgkpstz":
        for end in ("le.", "les.", "led."):
            add(f"9{c}8{end}")
    for o in ONSETS:
        add(f"8{'8'.join(o)}e.")
        add(f"8{'8'.join(o)}es.")
        add(f"8{'8'.join(o)}ed.")
    for c in ("s", "x", "z", "ch", "sh", "c", "g"):
        add(f"9{c}es.")
    for c in "td":
        add(f"9{c}ed.")
    return {k: tuple(v) for k, v in out.items()}


_LONGEST = 8


@lru_cache(200_000)
def syllables(word: str) -> int:
    """Number of syllables; at least one."""
    w = re.sub(r"[^a-z]", "", word.lower())
    if len(w) <= 3:
        return 1
    known, dotted = patterns(), f".{w}."
    at = [0] * (len(dotted) + 1)
    for i in range(len(dotted)):
        for j in range(i + 1, min(len(dotted), i + _LONGEST) + 1):
            values = known.get(dotted[i:j])
            if values:
                for k, v in enumerate(values):
                    if v > at[i + k]:
                        at[i + k] = v
    # a division counts if there is a vowel on either side of it
    n, heard, start = 0, False, 0
    for k in range(1, len(w) + 1):
        if k == len(w) or at[k + 1] % 2:
            has = any(c in VOWELS for c in w[start:k])
            if has:
                n += 1
            start = k if has or k == len(w) else start
            heard = heard or has
    return max(1, n)
