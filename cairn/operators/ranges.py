"""Range predicates: expressions over one value, their normal forms, and interval algebra.

``Expr`` nodes are comparisons, And, Or, Not. ``dnf`` gives a list of conjunctions of comparisons without
negation ([] is empty, [[]] is everything); ``intervals`` gives the sorted, disjoint, maximal intervals
of an expression, which become an OR of pushed-down comparisons.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Half:
    """One comparison with a bound: op in EQ NE LT LE GT GE; EMPTY and FULL have none."""

    op: str
    bound: Any = None

    def holds(self, v) -> bool:
        b = self.bound
        match self.op:
            case "EMPTY":
                return False
            case "FULL":
                return True
            case "EQ":
                return v == b
            case "NE":
                return v != b
            case "LT":
                return v < b
            case "LE":
                return v <= b
            case "GT":
                return v > b
        return v >= b

    def column(self, c: Column) -> Column:
        b = F.lit(self.bound)
        return {"EMPTY": lambda: F.lit(False), "FULL": lambda: F.lit(True), "EQ": lambda: c == b, "NE": lambda: c != b, "LT": lambda: c < b, "LE": lambda: c <= b, "GT": lambda: c > b, "GE": lambda: c >= b}[self.op]()


@dataclass(frozen=True)
class And:
    left: Any
    right: Any


@dataclass(frozen=True)
class Or:
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    inner: Any


Expr = Half | And | Or | Not
EMPTY, FULL = Half("EMPTY"), Half("FULL")
_OPPOSITE = {"EMPTY": "FULL", "FULL": "EMPTY", "LT": "GE", "LE": "GT", "GT": "LE", "GE": "LT", "NE": "EQ"}


def eq(b) -> Half:
    return Half("EQ", b)


def ne(b) -> Half:
    return Half("NE", b)


def lt(b) -> Half:
    return Half("LT", b)


def le(b) -> Half:
    return Half("LE", b)


def gt(b) -> Half:
    return Half("GT", b)


def ge(b) -> Half:
    return Half("GE", b)


def between(low, high) -> Expr:
    return And(ge(low), le(high))


def negate(e: Expr) -> Expr:
    match e:
        case Half("EQ", b):
            return Or(lt(b), gt(b))
        case Half(op, b):
            return Half(_OPPOSITE[op], b)
        case And(a, b):
            return Or(negate(a), negate(b))
        case Or(a, b):
            return And(negate(a), negate(b))
        case Not(a):
            return remove_negation(a)


def remove_negation(e: Expr) -> Expr:
    """The same without Not and NE: negation is pushed to the comparisons."""
    match e:
        case Half("NE", b):
            return Or(lt(b), gt(b))
        case Half():
            return e
        case And(a, b):
            return And(remove_negation(a), remove_negation(b))
        case Or(a, b):
            return Or(remove_negation(a), remove_negation(b))
        case Not(a):
            return negate(a)


def dnf(e: Expr) -> list[list[Half]]:
    """Disjunctive normal form of comparisons."""

    def of(e: Expr) -> list[list[Half]]:
        match e:
            case Half("EMPTY"):
                return []
            case Half("FULL"):
                return [[]]
            case Half():
                return [[e]]
            case Or(a, b):
                return of(a) + of(b)
            case And(a, b):
                return [x + y for x in of(a) for y in of(b)]

    return of(remove_negation(e))


@dataclass(frozen=True)
class Interval:
    """low and high are (bound, included) or None where unbounded."""

    low: tuple | None
    high: tuple | None

    @property
    def empty(self) -> bool:
        if self.low is None or self.high is None:
            return False
        (a, ai), (b, bi) = self.low, self.high
        return a > b or (a == b and not (ai and bi))

    def contains(self, v) -> bool:
        return (self.low is None or v > self.low[0] or (v == self.low[0] and self.low[1])) and (self.high is None or v < self.high[0] or (v == self.high[0] and self.high[1]))

    def column(self, c: Column) -> Column:
        parts = []
        if self.low is not None:
            parts.append(c >= F.lit(self.low[0]) if self.low[1] else c > F.lit(self.low[0]))
        if self.high is not None:
            parts.append(c <= F.lit(self.high[0]) if self.high[1] else c < F.lit(self.high[0]))
        out = parts[0] if parts else F.lit(True)
        return out & parts[1] if len(parts) == 2 else out


def max_lower_bound(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return a or b
    # at an equal bound the excluded one is the tighter
    return max(a, b, key=lambda x: (x[0], not x[1]))


def min_upper_bound(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return a or b
    return min(a, b, key=lambda x: (x[0], x[1]))


def intersect(a: Interval, b: Interval) -> Interval:
    return Interval(max_lower_bound(a.low, b.low), min_upper_bound(a.high, b.high))


def overlap(a: Interval, b: Interval) -> bool:
    return not intersect(a, b).empty


def _interval(conjunction: list[Half]) -> Interval:
    out = Interval(None, None)
    for h in conjunction:
        b = h.bound
        out = intersect(out, {"EQ": Interval((b, True), (b, True)), "LT": Interval(None, (b, False)), "LE": Interval(None, (b, True)), "GT": Interval((b, False), None), "GE": Interval((b, True), None)}[h.op])
    return out


def intervals(e: Expr) -> list[Interval]:
    """Sorted, disjoint and maximal: intervals that overlap or touch are merged."""
    some = [i for i in map(_interval, dnf(e)) if not i.empty]
    # unbounded first, then by bound; at an equal bound the included one first
    unbounded = [i for i in some if i.low is None]
    rest = sorted((i for i in some if i.low is not None), key=lambda i: (i.low[0], not i.low[1]))
    out: list[Interval] = []
    for i in unbounded + rest:
        if not out:
            out.append(i)
            continue
        last = out[-1]
        joins = i.low is None or last.high is None or i.low[0] < last.high[0] or (i.low[0] == last.high[0] and (i.low[1] or last.high[1]))
        if joins:
            highs = (last.high, i.high)
            out[-1] = Interval(last.low, None if None in highs else max(highs, key=lambda x: (x[0], x[1])))
        else:
            out.append(i)
    return out


def contain(e: Expr, v) -> bool:
    match e:
        case Half():
            return e.holds(v)
        case And(a, b):
            return contain(a, v) and contain(b, v)
        case Or(a, b):
            return contain(a, v) or contain(b, v)
        case Not(a):
            return not contain(a, v)


def column(e: Expr, c: Column) -> Column:
    """The predicate as an OR of interval tests, which parquet scans can use."""
    out = F.lit(False)
    for k, i in enumerate(intervals(e)):
        out = i.column(c) if k == 0 else out | i.column(c)
    return out


def overlap_join(left, right, left_bounds: tuple[str, str], right_bounds: tuple[str, str], width):
    """Pairs of rows whose closed intervals overlap: an equi-join on buckets of ``width``.

    Each side is copied to the buckets its interval touches; a pair is kept in the first bucket both share.
    """
    (a, b), (c, d) = left_bounds, right_bounds
    buckets = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    x = left.where(F.col(a) <= F.col(b)).withColumn("_bucket", buckets(a, b))
    y = right.where(F.col(c) <= F.col(d)).withColumn("_other", buckets(c, d))
    first = F.floor(F.greatest(a, c) / width)
    return x.join(y, (F.col("_bucket") == F.col("_other")) & (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("_bucket") == first)).drop("_bucket", "_other")
