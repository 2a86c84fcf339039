"""Predicates over named facts, some of which cost a read: what a listing alone decides, which facts the rest needs.

Each node is evaluated to a pair: whether the listing decides it, and its value. A fact that is not listed is undecided, which is
not the same as a null one: whether a missing owner makes a default hold can only be said once the owner has been looked up.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """op: fact, value, call, all, any, not, if or first."""

    op: str
    args: tuple
    of: Callable[..., Column] | None = None

    def __and__(self, other: Node) -> Node:
        return Node("all", (self, other))

    def __or__(self, other: Node) -> Node:
        return Node("any", (self, other))

    def __invert__(self) -> Node:
        return Node("not", (self,))


def fact(name: str) -> Node:
    return Node("fact", (name,))


def value(v) -> Node:
    return Node("value", (v,))


def _node(x) -> Node:
    return x if isinstance(x, Node) else value(x)


def call(of: Callable[..., Column], *args) -> Node:
    """A function of columns, decided where all its arguments are: comparisons, arithmetic, text."""
    return Node("call", tuple(map(_node, args)), of)


def equal(a, b) -> Node:
    """Null equals null only."""
    return call(lambda x, y: x.eqNullSafe(y), a, b)


def below(a, b) -> Node:
    return call(lambda x, y: x < y, a, b)


def absent(a) -> Node:
    return call(lambda x: x.isNull(), a)


def choose(condition: Node, then, otherwise) -> Node:
    """A null condition does not hold."""
    return Node("if", (condition, _node(then), _node(otherwise)))


def first_of(*args) -> Node:
    """The first argument that is not null."""
    return Node("first", tuple(map(_node, args)))


def facts(node: Node) -> set[str]:
    """The names of all facts that the node speaks of."""
    return {node.args[0]} if node.op == "fact" else set() if node.op == "value" else set().union(*map(facts, node.args))


def _evaluated(node: Node, known: Collection[str], column: Callable[[str], Column]) -> tuple[Column, Column]:
    """Whether the node is decided (never null), and its value, which means something only there."""
    if node.op == "fact":
        name = node.args[0]
        return (F.lit(True), column(name)) if name in known else (F.lit(False), F.lit(None))
    if node.op == "value":
        return F.lit(True), F.lit(node.args[0])
    if not facts(node) - set(known):
        return F.lit(True), _value(node, column)
    pairs = [_evaluated(x, known, column) for x in node.args]
    if node.op == "not":
        ((decided, v),) = pairs
        return decided, ~v.cast("boolean")
    if node.op == "call":
        return reduce(lambda a, b: a & b, (d for d, _ in pairs)), node.of(*(v for _, v in pairs))
    if node.op in ("all", "any"):
        # one side settles it, whatever the other is: a false one for `all`, a true one for `any`
        settles = [d & F.coalesce(v.cast("boolean") == F.lit(node.op == "any"), F.lit(False)) for d, v in pairs]
        decided = reduce(lambda a, b: a & b, (d for d, _ in pairs)) | reduce(lambda a, b: a | b, settles)
        masked = [F.when(d, v.cast("boolean")) for d, v in pairs]
        return decided, reduce((lambda a, b: a & b) if node.op == "all" else (lambda a, b: a | b), masked)
    if node.op == "if":
        (c, holds), (a, then), (b, otherwise) = pairs
        holds = F.coalesce(holds.cast("boolean"), F.lit(False))
        either = ~c & a & b & then.eqNullSafe(otherwise)  # both ways lead to one value
        return (c & F.when(holds, a).otherwise(b)) | either, F.when(either | holds, then).otherwise(otherwise)
    if node.op == "first":
        # a decided null hands on to the next argument, and after the last one null is the value
        decided, found = F.lit(True), F.lit(None)
        for d, v in reversed(pairs):
            decided, found = d & (v.isNotNull() | decided), F.coalesce(v, found)
        return decided, found
    raise ValueError(f"unknown node {node.op!r}")


def _value(node: Node, column: Callable[[str], Column]) -> Column:
    """The value where every fact is known."""
    if node.op == "fact":
        return column(node.args[0])
    if node.op == "value":
        return F.lit(node.args[0])
    v = [_value(x, column) for x in node.args]
    if node.op == "call":
        return node.of(*v)
    if node.op == "not":
        return ~v[0].cast("boolean")
    if node.op in ("all", "any"):
        return reduce((lambda a, b: a & b) if node.op == "all" else (lambda a, b: a | b), (x.cast("boolean") for x in v))
    if node.op == "if":
        return F.when(v[0].cast("boolean"), v[1]).otherwise(v[2])
    return F.coalesce(*v)


@dataclass(frozen=True)
class Tiers:
    """cheap: true or false where listed facts decide, null elsewhere; full: the predicate where all facts are known; needed: the facts that are not listed."""

    cheap: Column
    full: Column
    needed: tuple[str, ...]


def derive_tiers(predicate: Node, known: Collection[str], column: Callable[[str], Column] = F.col) -> Tiers:
    """Both tiers of one predicate; known: the facts that a listing has. A null result does not hold."""
    decided, v = _evaluated(predicate, set(known), column)
    full = F.coalesce(_value(predicate, column).cast("boolean"), F.lit(False))
    return Tiers(F.when(decided, F.coalesce(v.cast("boolean"), F.lit(False))), full, tuple(sorted(facts(predicate) - set(known))))


def undecided(listing: DataFrame, predicate: Node) -> DataFrame:
    """The rows whose stored facts have to be read; directories never do."""
    tiers = derive_tiers(predicate, listing.columns)
    return listing.filter((F.col("kind") != "dir") & tiers.cheap.isNull())
