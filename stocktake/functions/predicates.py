"""Predicates with the semantics of typed selection: null is a value, order of evaluation is kept, misuse of null fails."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal(a: Column, b: Column) -> Column:
    """Null is a value: null equals null."""
    return a.eqNullSafe(b)


def strict(value: Column, what: str = "value") -> Column:
    """The value; a null one fails the query, as ordering, arithmetic and patterns need a value."""
    return F.coalesce(value, F.raise_error(F.lit(f"{what} is null where a value is needed")))


def less(a: Column, b: Column) -> Column:
    return strict(a) < strict(b)


def both(a: Column, b: Column) -> Column:
    """b is not evaluated where a is false."""
    return F.when(a, b).otherwise(False)


def either(a: Column, b: Column) -> Column:
    return F.when(a, True).otherwise(b)


def divided(a: Column, b: Column) -> Column:
    """Integer division that truncates; division by zero fails."""
    return ((strict(a) - strict(a) % strict(b)) / strict(b)).cast("long")


def member(value: Column, *of: Column) -> Column:
    """Null-safe membership."""
    return reduce(lambda a, b: a | b, [value.eqNullSafe(x) for x in of], F.lit(False))


def between(value: Column, low: Column, high: Column) -> Column:
    return strict(value).between(low, high)


def glob_regex(pattern: str) -> str:
    """`*` and `?` stay inside a component, `**` crosses; the whole text must match."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = [*out, ".*"], i + 2
            continue
        c = pattern[i]
        out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"


def glob(value: Column, pattern: str) -> Column:
    return F.rlike(strict(value), F.lit(glob_regex(pattern)))


def matches(value: Column, pattern: str) -> Column:
    """An unanchored regular expression in Java's dialect."""
    return F.rlike(strict(value), F.lit(pattern))


def key_pattern(key: Column, pattern: str) -> Column:
    """Whole-key match; the literal prefix is a condition of its own, so that scans can skip files by it."""
    literal = re.split(r"[*?]", pattern, maxsplit=1)[0]
    fits = F.rlike(key, F.lit(glob_regex(pattern)))
    return F.startswith(key, F.lit(literal)) & fits if literal else fits


def last_rule_wins(rules: Sequence[tuple[Column, bool]]) -> Column:
    """What the last of ordered rules (condition, answer) that holds says; false where none does."""
    out = F.lit(False)
    for holds, answer in rules:
        out = F.when(holds, F.lit(answer)).otherwise(out)
    return out
