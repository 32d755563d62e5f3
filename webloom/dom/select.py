"""Selectors: a CSS subset and an XPath subset, compiled once and applied to many documents."""

from __future__ import annotations

import re
from functools import lru_cache

from webloom.dom.tree import Node

_SIMPLE = re.compile(r"([.#]?[\w-]+|\*)|\[\s*([\w:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]*))\s*)?\]")
_STEP = re.compile(r"(//|/)?\s*(@?[\w:*-]+(?:\(\))?)((?:\[[^\]]*\])*)")


@lru_cache(512)
def compile_css(selector: str) -> tuple:
    """Union of chains; a chain is [(combinator, tag, [(attribute, value, whole)])]."""
    parts = []
    for one in selector.split(","):
        chain, combinator = [], " "
        for token in re.findall(r">|[^\s>\[]+(?:\[[^\]]*\])*|(?:\[[^\]]*\])+", one.strip()):
            if token == ">":
                combinator = ">"
                continue
            tag, tests = "", []
            for m in _SIMPLE.finditer(token):
                if m[1]:
                    if m[1][0] == ".":
                        tests.append(("class", m[1][1:], False))
                    elif m[1][0] == "#":
                        tests.append(("id", m[1][1:], True))
                    elif m[1] != "*":
                        tag = m[1].lower()
                else:
                    tests.append((m[2].lower(), next((g for g in m.groups()[2:] if g is not None), None), True))
            chain.append((combinator, tag, tuple(tests)))
            combinator = " "
        if chain:
            parts.append(tuple(chain))
    return tuple(parts)


def _fits(n: Node, tag: str, tests: tuple) -> bool:
    if not n.tag or n.tag == "#" or (tag and n.tag != tag):
        return False
    for name, value, whole in tests:
        if name not in n.attrs:
            return False
        if value and (n.attrs[name] != value if whole else value not in n.attrs[name].split()):
            return False
    return True


def css(root: Node, selector: str) -> list[Node]:
    """Elements below root, those of each part of a union in document order, without repetition."""
    out: list[Node] = []
    seen: set[int] = set()
    for chain in compile_css(selector):
        for n in root.walk():
            if n is root or not _fits(n, *chain[-1][1:]) or id(n) in seen:
                continue
            if _leads_to(n, root, chain, len(chain) - 1):
                seen.add(id(n))
                out.append(n)
    return out


def _leads_to(n: Node, root: Node, chain: tuple, k: int) -> bool:
    if k == 0:
        return True
    combinator, (_, tag, tests) = chain[k][0], chain[k - 1]
    for a in n.ancestors():
        if _fits(a, tag, tests) and _leads_to(a, root, chain, k - 1):
            return True
        if combinator == ">" or a is root:
            return False
    return False


@lru_cache(512)
def compile_xpath(path: str) -> tuple:
    """[(descend, test, predicates)]; a leading bare tag looks at children."""
    steps = []
    for m in _STEP.finditer(path.strip()):
        predicates = tuple(p.strip() for p in re.findall(r"\[([^\]]*)\]", m[3]))
        steps.append((m[1] == "//", m[2], predicates))
    return tuple(steps)


def xpath(root: Node, path: str) -> list[Node]:
    """Nodes of an XPath subset: / // tag * text() @a, [@a] [@a="v"] [N] [last()]; positions count in each context."""
    now = [root]
    for descend, test, predicates in compile_xpath(path):
        if test.startswith("@"):
            return [Node("", data=n.attrs[test[1:]]) for n in now if test[1:] in n.attrs]
        following: list[Node] = []
        seen: set[int] = set()
        for n in now:
            pool = [c for c in n.walk() if c is not n] if descend else n.children
            found = [c for c in pool if (not c.tag if test == "text()" else c.tag and (test == "*" or c.tag == test.lower()))]
            for p in predicates:
                if p == "last()":
                    found = found[-1:]
                elif p.isdigit():
                    found = found[int(p) - 1 : int(p)] if int(p) > 0 else []
                else:
                    m = re.fullmatch(r"@([\w:-]+)\s*(?:=\s*[\"']([^\"']*)[\"'])?", p)
                    found = [c for c in found if m and m[1] in c.attrs and (m[2] is None or c.attrs[m[1]] == m[2])]
            for c in found:
                if id(c) not in seen:
                    seen.add(id(c))
                    following.append(c)
        now = following
    return now
