"""Records by schemas whose fields choose their own selector, and by classic schemas with type pipelines and computed fields."""

from __future__ import annotations

import ast
import operator
import re

from webloom.dom.select import css, xpath
from webloom.dom.tree import Node

_OPERATORS = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Eq: operator.eq, ast.NotEq: operator.ne,
    ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.USub: operator.neg, ast.Not: operator.not_,
}
_CALLS = {"len": len, "str": str, "int": int, "float": float, "round": round, "min": min, "max": max, "lower": str.lower, "upper": str.upper, "strip": str.strip}


def records(doc: Node, schema: dict) -> list[dict]:
    """One record for each match of schema['base'] (css); fields are {name, type: css|xpath|regex, selector, attribute, is_list, children, transform}.

    transform is a function of a text. What is missing is '', [] or {}.
    """

    def value(n: Node, f: dict):  # noqa: ANN202
        change = f.get("transform") or (lambda v: v)
        if f["type"] == "regex":
            text = n.text()
            found = [m[0] for m in re.finditer(f["selector"], text)]
            return [change(v) for v in found] if f.get("is_list") else change(found[0] if found else "")
        matches = (css if f["type"] == "css" else xpath)(n, f["selector"])
        if f.get("children"):
            made = [{g["name"]: value(m, g) for g in f["children"]} for m in matches]
            return made if f.get("is_list") else made[0] if made else {}
        texts = [change(m.attrs.get(f["attribute"], "") if f.get("attribute") else m.text()) for m in matches]
        return texts if f.get("is_list") else texts[0] if texts else ""

    return [{f["name"]: value(n, f) for f in schema["fields"]} for n in css(doc, schema["base"])]


def compute(expression: str, item: dict):  # noqa: ANN201
    """A computed field: arithmetic, comparisons, a conditional and a few functions over the record's fields; nothing else is allowed."""

    def run(n: ast.AST):  # noqa: ANN202
        if isinstance(n, ast.Expression):
            return run(n.body)
        if isinstance(n, ast.Constant):
            return n.value
        if isinstance(n, ast.Name):
            return item[n.id]
        if isinstance(n, ast.BinOp) and type(n.op) in _OPERATORS:
            return _OPERATORS[type(n.op)](run(n.left), run(n.right))
        if isinstance(n, ast.UnaryOp) and type(n.op) in _OPERATORS:
            return _OPERATORS[type(n.op)](run(n.operand))
        if isinstance(n, ast.Compare) and len(n.ops) == 1 and type(n.ops[0]) in _OPERATORS:
            return _OPERATORS[type(n.ops[0])](run(n.left), run(n.comparators[0]))
        if isinstance(n, ast.IfExp):
            return run(n.body) if run(n.test) else run(n.orelse)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _CALLS and not n.keywords:
            return _CALLS[n.func.id](*[run(a) for a in n.args])
        raise ValueError(f"not allowed: {type(n).__name__}")

    return run(ast.parse(expression, mode="eval"))


def _following(n: Node, source: str) -> Node | None:
    """The next sibling that fits "+ selector"."""
    if not source.startswith("+") or n.parent is None:
        return None
    siblings = [c for c in n.parent.children if c.tag]
    at = next(k for k, c in enumerate(siblings) if c is n)
    chosen = {id(m) for m in css(n.parent, source[1:].strip())}
    return next((c for c in siblings[at + 1 :] if id(c) in chosen), None)


def classic_records(doc: Node, schema: dict, how: str = "css") -> list[dict]:
    """Records of {baseSelector, baseFields, fields}; a field that yields nothing and has no default is left out.

    Types: text, attribute, html, regex, a list of these (each step takes what the one before gave), nested, list,
    nested_list and computed (an expression over the fields before it).
    """
    select = css if how == "css" else xpath

    def single(n: Node, f: dict):  # noqa: ANN202
        found = select(n, f["selector"]) if "selector" in f else [n]
        if not found:
            return f.get("default")
        value = found[0]
        for step in f["type"] if isinstance(f["type"], list) else [f["type"]]:
            if step == "text":
                value = value.text()
            elif step == "attribute":
                value = value.attrs.get(f["attribute"])
            elif step == "html":
                value = value.html()
            elif step == "regex":
                m = re.search(f["pattern"], value if isinstance(value, str) else value.text())
                value = m[f.get("group", 1)] if m else None
            if value is None:
                return f.get("default")
        if isinstance(value, str):
            value = {"lowercase": str.lower, "uppercase": str.upper, "strip": str.strip}.get(f.get("transform", ""), str)(value)
        return value

    def field(n: Node, f: dict):  # noqa: ANN202
        if "source" in f:
            other = _following(n, f["source"])
            if other is None:
                return f.get("default")
            n = other
        if f["type"] == "nested":
            found = select(n, f["selector"])
            return item(found[0], f["fields"]) if found else {}
        if f["type"] in ("list", "nested_list"):
            return [item(m, f["fields"]) for m in select(n, f["selector"])]
        return single(n, f)

    def item(n: Node, fields: list[dict]) -> dict:
        out: dict = {}
        for f in fields:
            if f["type"] == "computed":
                try:
                    value = compute(f["expression"], out)
                except (ValueError, KeyError, TypeError, ZeroDivisionError, SyntaxError):
                    value = f.get("default")
            else:
                value = field(n, f)
            if value is not None:
                out[f["name"]] = value
        return out

    made = [{f["name"]: v for f in schema.get("baseFields", []) if (v := single(n, f)) is not None} | item(n, schema["fields"]) for n in select(doc, schema["baseSelector"])]
    return [r for r in made if r]
