"""Binary relations with access paths, and conjunctive queries over them.

A relation is a table of pairs (``_l``, ``_r``), a function of the left value, or a predicate on
both. Its capabilities say what it can do: generate all pairs, map left to right, invert, check.
A query is a list of clauses over variables; a capability check decides in which order clauses can
run at all (filter, then map, then inverse, then generate), Catalyst orders and executes the joins.
Multiplicities (partial/total, singular/plural) are carried along as metadata.
"""

from __future__ import annotations

import enum
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Multiplicity(enum.Enum):
    """Whether there may be no result (partial) and whether there may be several (plural)."""

    PARTIAL_PLURAL = (True, True)
    PARTIAL_SINGULAR = (True, False)
    TOTAL_SINGULAR = (False, False)
    TOTAL_PLURAL = (False, True)

    @property
    def partial(self) -> bool:
        return self.value[0]

    @property
    def plural(self) -> bool:
        return self.value[1]

    @property
    def total(self) -> bool:
        return not self.partial

    @property
    def singular(self) -> bool:
        return not self.plural

    @staticmethod
    def of(partial: bool, plural: bool) -> Multiplicity:
        return Multiplicity((partial, plural))

    def __mul__(self, other: Multiplicity) -> Multiplicity:
        return Multiplicity.of(self.partial or other.partial, self.plural or other.plural)

    def make_partial(self) -> Multiplicity:
        return Multiplicity.of(True, self.plural)

    def make_plural(self) -> Multiplicity:
        return Multiplicity.of(self.partial, True)


ANY, OPTIONAL, ONE, SOME = Multiplicity.PARTIAL_PLURAL, Multiplicity.PARTIAL_SINGULAR, Multiplicity.TOTAL_SINGULAR, Multiplicity.TOTAL_PLURAL


@dataclass(frozen=True)
class Relation:
    #: Pairs as columns _l and _r; None for a computed relation.
    pairs: DataFrame | None = None
    #: A function of the left value (a column, or an array column if plural).
    function: Callable[[Column], Column] | None = None
    plural_function: bool = False
    #: A function of the right value that gives the left.
    inverse_function: Callable[[Column], Column] | None = None
    #: A test of both values.
    predicate: Callable[[Column, Column], Column] | None = None
    forward: Multiplicity = ANY
    backward: Multiplicity = ANY

    # -- capabilities ------------------------------------------------------
    @property
    def can_generate(self) -> bool:
        return self.pairs is not None

    @property
    def can_map(self) -> bool:
        return self.pairs is not None or self.function is not None

    @property
    def can_invert(self) -> bool:
        return self.pairs is not None or self.inverse_function is not None

    @property
    def can_check(self) -> bool:
        return self.predicate is not None or self.can_map

    # -- construction ------------------------------------------------------
    @staticmethod
    def of_table(df: DataFrame, left: str, right: str, forward: Multiplicity = ANY, backward: Multiplicity = ANY) -> Relation:
        return Relation(df.select(F.col(left).alias("_l"), F.col(right).alias("_r")), forward=forward, backward=backward)

    @staticmethod
    def of_function(f: Callable[[Column], Column], inverse: Callable[[Column], Column] | None = None) -> Relation:
        return Relation(function=f, inverse_function=inverse, forward=ONE)

    @staticmethod
    def of_plural_function(f: Callable[[Column], Column]) -> Relation:
        return Relation(function=f, plural_function=True)

    @staticmethod
    def of_predicate(p: Callable[[Column, Column], Column]) -> Relation:
        return Relation(predicate=p)

    @staticmethod
    def of_mapping(df: DataFrame, key: str, value: str) -> Relation:
        """A mapping's keys to its values: at most one of each key."""
        return Relation.of_table(df, key, value, OPTIONAL)

    @staticmethod
    def of_grouped(df: DataFrame, key: str, values: str) -> Relation:
        """A mapping from keys to arrays as a relation to their items."""
        return Relation(df.select(F.col(key).alias("_l"), F.explode(values).alias("_r")))

    @staticmethod
    def of_collection(df: DataFrame, column: str) -> Relation:
        """A collection as a relation from the unit value."""
        return Relation(df.select(F.lit(0).alias("_l"), F.col(column).alias("_r")), backward=OPTIONAL)

    # -- algebra -----------------------------------------------------------
    def inverse(self) -> Relation:
        if self.pairs is not None:
            return Relation(self.pairs.select(F.col("_r").alias("_l"), F.col("_l").alias("_r")), forward=self.backward, backward=self.forward)
        flipped = None if self.predicate is None else lambda a, b: self.predicate(b, a)
        return Relation(function=self.inverse_function, inverse_function=self.function if not self.plural_function else None, predicate=flipped, forward=self.backward, backward=self.forward)

    def compose(self, other: Relation) -> Relation:
        """(a, b) then (b, c), keeping duplicates."""
        if self.pairs is None and other.pairs is None:
            if self.function and other.function and not self.plural_function and not other.plural_function:
                return Relation.of_function(lambda x: other.function(self.function(x)))
            raise NoPlan("neither relation can generate")
        if self.pairs is None:
            return other.inverse().compose(self.inverse()).inverse()
        left = self.pairs.select("_l", F.col("_r").alias("_m"))
        if other.pairs is not None:
            right = other.pairs.select(F.col("_l").alias("_m2"), "_r")
            df = left.join(right, F.col("_m") == F.col("_m2")).select("_l", "_r")
        elif other.function is not None:
            value = other.function(F.col("_m"))
            df = left.select("_l", (F.explode(value) if other.plural_function else value).alias("_r"))
        else:
            raise NoPlan("the second relation can only check")
        return Relation(df, forward=self.forward * other.forward, backward=self.backward * other.backward)

    def collection(self) -> DataFrame:
        """A relation from the unit value as a collection."""
        return self.pairs.select("_r")

    def group(self, agg: Column) -> DataFrame:
        return self.pairs.groupBy("_l").agg(agg)


def theta(op: str) -> Relation:
    """eq, ne, lt, gt, le, ge as relations; only eq can also map and invert."""
    tests = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "gt": lambda a, b: a > b, "le": lambda a, b: a <= b, "ge": lambda a, b: a >= b}
    if op == "eq":
        return Relation(function=lambda x: x, inverse_function=lambda x: x, predicate=tests["eq"], forward=ONE, backward=ONE)
    return Relation(predicate=tests[op])


class NoPlan(ValueError):
    """No order of the clauses can be executed with their relations' capabilities."""


class Unbounded(ValueError):
    """A selected variable is bound by no clause."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: Any


class _Wildcard:
    """Matches anything; bound and dropped, so the multiplicity of matches is kept."""


__ = _Wildcard()


@dataclass(frozen=True)
class Clause:
    left: Any
    relation: Relation
    right: Any


def var(name: str) -> Var:
    return Var(name)


def value(v) -> Const:
    return Const(v)


@dataclass
class Plan:
    """The order of clauses with their access paths, and the multiplicity of the result."""

    steps: list[tuple[str, Clause]]
    multiplicity: Multiplicity


def plan(clauses: list[Clause]) -> Plan:
    """Greedy by capability: the first clause that can filter, else map, else invert, else generate."""
    left = list(clauses)
    bound: set[str] = set()
    known = lambda t: isinstance(t, Const) or (isinstance(t, Var) and t.name in bound)
    steps, mult = [], ONE
    tests = [
        ("filter", lambda c: known(c.left) and known(c.right) and c.relation.can_check),
        ("map", lambda c: known(c.left) and not known(c.right) and c.relation.can_map),
        ("inverse", lambda c: known(c.right) and not known(c.left) and c.relation.can_invert),
        ("generate", lambda c: not known(c.left) and not known(c.right) and c.relation.can_generate),
    ]
    while left:
        found = next(((how, c) for how, ok in tests for c in left if ok(c)), None)
        if found is None:
            raise NoPlan("no clause can run with what is bound: " + ", ".join(sorted(bound)))
        how, c = found
        left.remove(c)
        steps.append(found)
        bound |= {t.name for t in (c.left, c.right) if isinstance(t, Var)}
        mult = mult.make_partial() if how == "filter" else mult * {"map": c.relation.forward, "inverse": c.relation.backward, "generate": ANY}[how]
    return Plan(steps, mult)


def run(spark, selection: list[Var], clauses: list[Clause]) -> DataFrame:
    """The selected variables' bindings, with duplicates."""
    steps = plan(clauses).steps
    names = {t.name for c in clauses for t in (c.left, c.right) if isinstance(t, Var)}
    for v in selection:
        if v.name not in names:
            raise Unbounded(v.name)
    records: DataFrame | None = None
    count = 0

    def term(t) -> Column:
        return F.lit(t.value) if isinstance(t, Const) else F.col(t.name)

    for how, c in steps:
        r = c.relation
        count += 1
        ln, rn = f"_l{count}", f"_r{count}"
        if records is None and how != "generate":
            records = spark.range(1).select(F.lit(0).alias("_unit"))
        if how == "filter":
            if r.predicate is not None:
                records = records.where(r.predicate(term(c.left), term(c.right)))
            elif r.function is not None:
                made = r.function(term(c.left))
                records = records.where(F.exists(made, lambda y: y == term(c.right)) if r.plural_function else made == term(c.right))
            else:
                pairs = r.pairs.select(F.col("_l").alias(ln), F.col("_r").alias(rn))
                records = records.join(pairs, (term(c.left) == F.col(ln)) & (term(c.right) == F.col(rn)), "left_semi")
            continue
        if how in ("map", "inverse") and r.pairs is None:
            f, known, new = (r.function, c.left, c.right) if how == "map" else (r.inverse_function, c.right, c.left)
            made = f(term(known))
            made = F.explode(made) if r.plural_function and how == "map" else made
            name = new.name if isinstance(new, Var) else rn
            records = records.select("*", made.alias(name))
            records = records if isinstance(new, Var) else records.drop(name)
            continue
        pairs = r.pairs.select(F.col("_l").alias(ln), F.col("_r").alias(rn))
        if isinstance(c.left, Const):
            pairs = pairs.where(F.col(ln) == F.lit(c.left.value))
        if isinstance(c.right, Const):
            pairs = pairs.where(F.col(rn) == F.lit(c.right.value))
        if how == "generate":
            records = pairs if records is None else records.crossJoin(pairs)
        else:
            known, side = (c.left, ln) if how == "map" else (c.right, rn)
            records = records.crossJoin(pairs) if isinstance(known, Const) else records.join(pairs, term(known) == F.col(side))
        same = isinstance(c.left, Var) and isinstance(c.right, Var) and c.left.name == c.right.name
        if same:
            records = records.where(F.col(ln) == F.col(rn))
        for t, n in ((c.left, ln), (c.right, rn)):
            if isinstance(t, Var) and t.name not in records.columns:
                records = records.withColumn(t.name, F.col(n))
        records = records.drop(ln, rn)
    return records.select(*[v.name for v in selection])
