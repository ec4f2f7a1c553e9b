"""Boolean field expressions: ``NOT``, ``AND``, ``OR``, parentheses, ``field=='text'`` and ``field=%'regex'``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern of the expression language.
TOKEN = re.compile(r"\(|\)|[^\s']+?(?:==|=%)'[^']*'|[^\s']+")
ATOM = re.compile(r"([^\s']+?)(==|=%)'([^']*)'")


class BadExpression(ValueError):
    """The expression cannot be read; as a rule it is false."""


def whole(value: Column, pattern: str) -> Column:
    """True where the pattern matches the whole value; unlike ``^...$`` a last line break counts."""
    return value.rlike(rf"\A(?:{pattern})\z")


def atom_verdict(n: Column, valid: Column, quantifier: str) -> Column:
    """Quantifiers as expression atoms use them: ZERO_OR_MORE always holds."""
    return {"ONE_ONLY": valid == 1, "ONE_OR_MORE": valid >= 1, "ZERO_OR_MORE": F.lit(True), "ZERO_ONLY": valid == 0, "ALL": valid == n}[quantifier]


def atom_fields(text: str) -> list[str]:
    """The field of each readable atom, in order; an atom that stands twice counts twice."""
    found = [ATOM.fullmatch(t) for t in TOKEN.findall(text or "") if t not in ("(", ")", "AND", "OR", "NOT")]
    return [f.group(1) for f in found if f]


def compile_expression(text: str, field: Callable[[str], Column], quantifier: str = "ONE_OR_MORE") -> Column:
    """One boolean column; ``field`` gives the array of a field's occurrences. Unreadable expressions are false."""
    tokens = TOKEN.findall(text or "")
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise BadExpression(text)
        at += 1
        return tokens[at - 1]

    def any_of() -> Column:
        left = all_of()
        while peek() == "OR":
            take()
            left = left | all_of()
        return left

    def all_of() -> Column:
        left = unary()
        while peek() == "AND":
            take()
            left = left & unary()
        return left

    def unary() -> Column:
        token = take()
        if token == "NOT":
            return ~unary()
        if token == "(":
            inner = any_of()
            if take() != ")":
                raise BadExpression(text)
            return inner
        if token in (")", "AND", "OR"):
            raise BadExpression(text)
        found = ATOM.fullmatch(token)
        if not found:
            return F.lit(False)
        name, operator, wanted = found.groups()
        if operator == "=%":
            try:
                re.compile(wanted)
            except re.error:
                return F.lit(False)
        occ = field(name)
        valid = F.size(F.filter(occ, lambda v: v == wanted if operator == "==" else whole(v, wanted)))
        return atom_verdict(F.size(occ), valid, quantifier)

    try:
        out = any_of()
        if peek() is not None:
            raise BadExpression(text)
        return out
    except BadExpression:
        return F.lit(False)
