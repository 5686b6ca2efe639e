"""Run-time values: Python values on the driver, columns inside plans, series over tables.

A function of the language is a Python function of one argument. Applied to columns it builds a
column expression, so a lambda given to ``map`` over a table becomes part of the table's plan; sequences
on the driver are lazy and may be infinite.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.operators.series import Series


@dataclass(frozen=True)
class Rec:
    """Fields in order; a later one hides an earlier one of its name. No field: the unit value."""

    fields: tuple[tuple[str, Any], ...] = ()

    def get(self, name: str) -> Any:
        return next(v for n, v in reversed(self.fields) if n == name)

    def extend(self, name: str, value: Any) -> Rec:
        return Rec((*self.fields, (name, value)))


@dataclass(frozen=True)
class Tagged:
    tag: str
    value: Any


@dataclass(frozen=True)
class Seq:
    """A sequence that can be run through again and again."""

    start: Callable[[], Iterator]

    def __iter__(self) -> Iterator:
        return self.start()


@dataclass(frozen=True)
class Red:
    """A reducer; full says that no further item can change the result.

    known() is the same reducer as aggregates of columns (or None); table takes a series to the result where that is better than an aggregate.
    """

    seed: Any
    push: Callable[[Any, Any], Any]
    term: Callable[[Any], Any] = lambda s: s
    full: Callable[[Any], bool] = lambda s: False
    known: Callable[[], Any] | None = None
    table: Callable[[Series], Any] | None = None


@dataclass(frozen=True)
class Map:
    pairs: tuple


@dataclass(frozen=True)
class Shape:
    spec: Any


UNIT = Rec()


def is_column(x) -> bool:
    return isinstance(x, Column)


def to_column(x) -> Column:
    """Any value without functions as a column."""
    if isinstance(x, Column):
        return x
    if isinstance(x, tuple):
        return F.struct(to_column(x[0]).alias("_1"), to_column(x[1]).alias("_2"))
    if isinstance(x, Rec):
        if not x.fields:
            return F.lit(None)
        last = dict(x.fields)
        return F.struct(*[to_column(v).alias(n) for n, v in last.items()])
    if isinstance(x, Seq):
        return F.array(*map(to_column, x))
    if isinstance(x, bool) or not isinstance(x, int):
        return F.lit(x)
    return F.lit(x).cast("bigint")


def any_column(*xs) -> bool:
    return any(is_column(x) or isinstance(x, tuple) and any_column(*x) or isinstance(x, Rec) and any_column(*(v for _, v in x.fields)) for x in xs)


def seq(items) -> Seq:
    items = tuple(items)
    return Seq(lambda: iter(items))


def lazy(make: Callable[[], Iterator]) -> Seq:
    return Seq(make)


# -- display -----------------------------------------------------------------------


def show(x, most: int = 100) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return str(x)
    if isinstance(x, str):
        return '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'
    if isinstance(x, tuple):
        parts = []
        while isinstance(x, tuple):
            parts.append(show(x[0]))
            x = x[1]
        return "(" + ", ".join([*parts, show(x)]) + ")"
    if isinstance(x, Rec):
        return "{" + ", ".join(f"{n} = {show(v)}" for n, v in x.fields) + "}" if x.fields else "()"
    if isinstance(x, Seq):
        some = list(itertools.islice(iter(x), most + 1))
        return "[" + ", ".join([show(v) for v in some[:most]] + ["..."] * (len(some) > most)) + "]"
    if isinstance(x, Series):
        return x.show("[", ", ", "]", most)
    if isinstance(x, Map):
        return "<mapping>"
    if isinstance(x, Tagged):
        return f"{x.tag}({show(x.value)})"
    return str(x)


# -- JSON on the driver ----------------------------------------------------------------

_JSON = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|([A-Za-z_][A-Za-z0-9_]*)|([\[\](){},:]))', re.S)


def parse_json(text: str):
    """JSON with unquoted field names and tuples in round brackets; ValueError otherwise."""
    toks, at = [], 0
    while at < len(text.rstrip()):
        m = _JSON.match(text, at)
        if m is None:
            raise ValueError(text)
        toks.append(m)
        at = m.end()
    k = 0

    def take():
        nonlocal k
        if k >= len(toks):
            raise ValueError(text)
        k += 1
        return toks[k - 1]

    def peek() -> str:
        return toks[k][4] if k < len(toks) else ""

    def items(end: str) -> list:
        out = []
        while peek() != end:
            out.append(one())
            if peek() == ",":
                take()
            elif peek() != end:
                raise ValueError(text)
        take()
        return out

    def one():
        m = take()
        if m[1]:
            return json.loads(m[1], strict=False)
        if m[2]:
            return json.loads(m[2])
        if m[3]:
            if m[3] not in ("true", "false", "null"):
                raise ValueError(text)
            return json.loads(m[3])
        if m[4] == "[":
            return items("]")
        if m[4] == "(":
            return items(")")
        if m[4] == "{":
            out = []
            while peek() != "}":
                n = take()
                name = json.loads(n[1]) if n[1] else n[3]
                if name is None or take()[4] != ":":
                    raise ValueError(text)
                out.append((name, one()))
                if peek() == ",":
                    take()
                elif peek() != "}":
                    raise ValueError(text)
            take()
            return dict(reversed(out))  # the first of equal names counts
        raise ValueError(text)

    out = one()
    if k != len(toks):
        raise ValueError(text)
    return out


def from_json(shape, x):
    """The value of a shape, or ValueError."""
    if shape == "Int":
        if isinstance(x, str) and re.fullmatch(r"[+-]?[0-9]+", x):
            return int(x)
        if isinstance(x, bool) or not isinstance(x, int):
            raise ValueError(x)
        return x
    if shape == "Bool":
        if x in ("true", "false"):
            return x == "true"
        if not isinstance(x, bool):
            raise ValueError(x)
        return x
    if shape == "String":
        if not isinstance(x, str):
            raise ValueError(x)
        return x
    if shape[0] == "list":
        if not isinstance(x, list):
            raise ValueError(x)
        return seq([from_json(shape[1], y) for y in x])
    if shape[0] == "tuple":
        if len(shape) == 1:
            if x is not None:
                raise ValueError(x)
            return UNIT
        if not isinstance(x, list) or len(x) != len(shape) - 1:
            raise ValueError(x)
        out = from_json(shape[-1], x[-1])
        for s, y in zip(reversed(shape[1:-1]), reversed(x[:-1])):
            out = (from_json(s, y), out)
        return out
    if not isinstance(x, dict):
        raise ValueError(x)
    fields = []
    for n, s in shape[1:]:
        if n not in x:
            raise ValueError(n)
        fields.append((n, from_json(s, x[n])))
    return Rec(tuple(fields))


def to_json(x) -> str:
    if isinstance(x, tuple):
        parts = []
        while isinstance(x, tuple):
            parts.append(to_json(x[0]))
            x = x[1]
        return "(" + ",".join([*parts, to_json(x)]) + ")"
    if isinstance(x, Rec):
        return "{" + ",".join(f"{json.dumps(n)}:{to_json(v)}" for n, v in x.fields) + "}" if x.fields else "null"
    if isinstance(x, Seq):
        return "[" + ",".join(map(to_json, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


def plain(x):
    """A value that compares by structure."""
    if isinstance(x, tuple):
        return ("pair", plain(x[0]), plain(x[1]))
    if isinstance(x, Rec):
        return ("rec", tuple(sorted((n, plain(v)) for n, v in dict(x.fields).items())))
    if isinstance(x, Seq):
        return ("seq", *map(plain, x))
    if isinstance(x, Map):
        return ("map", frozenset((plain(k), plain(v)) for k, v in x.pairs))
    if isinstance(x, Tagged):
        return ("tag", x.tag, plain(x.value))
    return x
