"""Reducers: a seed, a push and a final projection, compiled to aggregate expressions.

A reducer with a known monoid becomes a built-in aggregate (partial and final, combined before the
shuffle), also when it is filtered or flat-mapped. A monoid of the caller's own is folded in chunks of consecutive
items, whose results are folded again (``Series.reduce`` and ``Series.group`` do that by its ``plus``). Nested groups
become an inner and an outer aggregation (``nested``). Any other reducer is an ordered fold over the collected group.
``make`` gives all parts of a reducer: seed, push, plus (where partial states can be joined), finish and full.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]
Plus = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Reducer:
    #: Aggregates rows: (item, position, which rows count or None) -> aggregate column.
    rows: Callable[[Column, Column, Column | None], Column]
    #: Folds an array of items.
    array: Callable[[Column], Column]
    #: Applied to the aggregate.
    finish: Fn = lambda c: c
    #: Applied to each item before it is pushed.
    before: Fn = lambda x: x
    #: Aggregates the results of ``array`` over parts, in the order of position.
    join: Callable[[Column, Column, Column | None], Column] | None = None
    #: Joins two unfinished results of consecutive parts.
    plus: Plus | None = None
    #: The result over no items, unfinished.
    seed: Column | None = None
    #: Adds one item.
    push: Plus | None = None
    #: Whether no further item can change a state.
    full: Fn | None = None
    #: The aggregate as a window function over at least one row, unfinished.
    running: Fn | None = None
    #: (key, value, reducer) of a nested grouping, whose unfinished result is a map.
    nested: tuple[Fn, Fn, Reducer] | None = None

    def over_rows(self, x: Column, pos: Column, keep: Column | None = None) -> Column:
        return self.finish(self.rows(self.before(x), pos, keep))

    def over_array(self, xs: Column) -> Column:
        return self.finish(self.array(F.transform(xs, self.before)))

    @property
    def chunked(self) -> bool:
        """Whether a table is to be folded in chunks."""
        return self.plus is not None and self.join is None

    # -- transformers ------------------------------------------------------
    def project(self, f: Fn) -> Reducer:
        old = self.finish
        return replace(self, finish=lambda c: f(old(c)))

    def mapping(self, f: Fn) -> Reducer:
        old = self.before
        return replace(self, before=lambda x: old(f(x)))

    def filtering(self, p: Fn) -> Reducer:
        """Pushes only items that pass p: the same aggregate over fewer rows."""
        rows, array, before, push = self.rows, self.array, self.before, self.push
        return replace(
            self,
            rows=lambda x, pos, keep=None: rows(before(x), pos, _and(keep, F.coalesce(p(x), F.lit(False)))),
            array=lambda xs: array(F.transform(F.filter(xs, p), before)),
            before=lambda x: x,
            running=None,
            push=None if push is None else lambda s, x: F.when(F.coalesce(p(x), F.lit(False)), push(s, before(x))).otherwise(s),
            nested=None,
        )

    def flat_mapping(self, f: Fn) -> Reducer:
        """Pushes every item of f(x). A row's items are folded at once; only such results are aggregated where they can be joined."""
        array, before, push = self.array, self.before, self.push
        inner = lambda x: F.transform(f(x), before)
        if self.join is not None:
            rows = lambda x, pos, keep=None: self.join(array(inner(x)), pos, keep)
        else:
            rows = lambda x, pos, keep=None: array(F.flatten(_ordered(inner(x), pos, keep)))
        return replace(
            self,
            rows=rows,
            array=lambda xs: array(F.flatten(F.transform(xs, inner))),
            before=lambda x: x,
            running=None,
            push=None if push is None else lambda s, x: F.aggregate(inner(x), s, push),
            nested=None,
        )

    def unnesting(self, f: Fn) -> Reducer:
        return self.flat_mapping(lambda x: F.transform(f(x), lambda y: F.struct(y.alias("_1"), x.alias("_2"))))


def _and(a: Column | None, b: Column) -> Column:
    return b if a is None else a & b


def _if(keep: Column | None, x: Column) -> Column:
    return x if keep is None else F.when(keep, x)


def _ordered(x: Column, pos: Column, keep: Column | None = None) -> Column:
    """The group's items in order; those that don't count never reach the aggregate's buffer."""
    some = F.collect_list(_if(keep, F.struct(pos.alias("p"), x.alias("x"))))
    return F.transform(F.array_sort(some), lambda s: s["x"])


def _zero(c: Column, zero) -> Column:
    return F.coalesce(c, F.lit(zero))


def make(seed: Column, push: Plus, plus: Plus | None = None, finish: Fn = lambda s: s, full: Fn | None = None) -> Reducer:
    """A reducer from its parts. With plus, which must be associative with seed as its zero, tables are folded in chunks.

    A state that is full is left as it is.
    """
    step = push if full is None else lambda s, x: F.when(full(s), s).otherwise(push(s, x))
    fold_ = lambda xs: F.aggregate(xs, seed, step)
    joined = plus if plus is None or full is None else lambda a, b: F.when(full(a), a).otherwise(plus(a, b))
    return Reducer(rows=lambda x, pos, keep=None: fold_(_ordered(x, pos, keep)), array=fold_, finish=finish, plus=joined, seed=seed, push=step, full=full)


def monoid(zero: Column, plus: Plus) -> Reducer:
    """Any associative plus with its zero, folded in order."""
    return make(zero, plus, plus)


def fold(zero: Column, push: Plus, finish: Fn = lambda s: s) -> Reducer:
    return make(zero, push, None, finish)


def monoid_with_maximum_check(zero: Column, plus: Plus, is_maximum: Fn) -> Reducer:
    """A monoid with an absorbing element: once reached, the rest is not looked at."""
    return make(zero, plus, plus, full=is_maximum)


def monoid_with_maximum(zero: Column, plus: Plus, maximum: Column | Fn) -> Reducer:
    return monoid_with_maximum_check(zero, plus, maximum if callable(maximum) and not isinstance(maximum, Column) else lambda a: a.eqNullSafe(maximum))


def with_seed(seed: Column, plus: Plus) -> Reducer:
    """A monoid whose fold begins with seed, which need not be its zero; so it isn't folded in chunks."""
    return make(seed, plus)


def of_buffer(capacity: int) -> Reducer:
    """The first ``capacity`` items as a list; full after that."""
    return list_().project(lambda xs: F.slice(xs, 1, capacity))


def hash_reducer(key: Fn, value: Fn, r: Reducer) -> Reducer:
    """A table from key to r of the key's values: nested grouping."""
    return group(key, value, r)


def _known(rows, array, join, plus: Plus, seed: Column, push: Plus, running: Fn) -> Reducer:
    return Reducer(rows=rows, array=array, join=join, plus=plus, seed=seed, push=push, running=running)


_INT = "bigint"


def sum_() -> Reducer:
    add = lambda a, x: a + x
    total = lambda x, _, keep=None: _zero(F.sum(_if(keep, x)), 0)
    return _known(total, lambda xs: F.aggregate(xs, F.lit(0).cast(_INT), add), total, add, F.lit(0).cast(_INT), add, F.sum)


def product_() -> Reducer:
    """Exact for integers (the built-in product is a double)."""
    return monoid(F.lit(1).cast(_INT), lambda a, x: a * x)


def count() -> Reducer:
    add = lambda a, b: a + b
    return _known(lambda x, _, keep=None: F.count(F.lit(1)) if keep is None else F.count_if(keep), lambda xs: F.size(xs).cast(_INT), lambda n, _, keep=None: _zero(F.sum(_if(keep, n)), 0), add, F.lit(0).cast(_INT), lambda s, _: s + 1, lambda x: F.count(F.lit(1)))


def and_() -> Reducer:
    both = lambda a, b: a & b
    all_ = lambda x, _, keep=None: _zero(F.bool_and(_if(keep, x)), True)
    return _known(all_, lambda xs: F.forall(xs, lambda x: x), all_, both, F.lit(True), both, F.bool_and)


def or_() -> Reducer:
    either = lambda a, b: a | b
    some = lambda x, _, keep=None: _zero(F.bool_or(_if(keep, x)), False)
    return _known(some, lambda xs: F.exists(xs, lambda x: x), some, either, F.lit(False), either, F.bool_or)


def first() -> Reducer:
    return Reducer(lambda x, pos, keep=None: F.min_by(F.struct(x.alias("x")), _if(keep, pos))["x"], lambda xs: F.get(xs, F.lit(0)))


def last() -> Reducer:
    return Reducer(lambda x, pos, keep=None: F.max_by(F.struct(x.alias("x")), _if(keep, pos))["x"], lambda xs: F.get(F.reverse(xs), F.lit(0)))


def first_or(default: Column) -> Reducer:
    return first().project(lambda c: F.coalesce(c, default))


def last_or(default: Column) -> Reducer:
    return last().project(lambda c: F.coalesce(c, default))


def list_() -> Reducer:
    return Reducer(_ordered, lambda xs: xs, join=lambda xs, pos, keep=None: F.flatten(_ordered(xs, pos, keep)), plus=lambda a, b: F.concat(a, b), push=lambda s, x: F.array_append(s, x))


def bag() -> Reducer:
    """All items, in no order that callers may rely on: the latest first."""
    return list_().project(F.reverse)


def set_() -> Reducer:
    distinct = lambda xs: F.array_sort(F.array_distinct(xs))
    return Reducer(lambda x, _, keep=None: F.array_sort(F.collect_set(_if(keep, x))), distinct, join=lambda xs, _, keep=None: distinct(F.flatten(F.collect_set(_if(keep, xs)))), plus=lambda a, b: distinct(F.concat(a, b)))


def bag_union() -> Reducer:
    return list_().project(F.flatten)


def set_union() -> Reducer:
    return set_().flat_mapping(lambda xs: xs)


def maximum() -> Reducer:
    top = lambda x, _, keep=None: F.max(_if(keep, x))
    return Reducer(top, F.array_max, join=top, plus=lambda a, b: F.greatest(a, b), running=F.max)


def minimum() -> Reducer:
    least = lambda x, _, keep=None: F.min(_if(keep, x))
    return Reducer(least, F.array_min, join=least, plus=lambda a, b: F.least(a, b), running=F.min)


def text(separator: str = "") -> Reducer:
    return list_().project(lambda xs: F.array_join(xs, separator))


def show(opening: str = "[", separator: str = "; ", closing: str = "]") -> Reducer:
    return list_().project(lambda xs: F.concat(F.lit(opening), F.array_join(xs, separator), F.lit(closing)))


def void(value: Column) -> Reducer:
    return Reducer(lambda x, _, keep=None: F.coalesce(F.min(F.when(F.lit(False), value)), value), lambda xs: value)


def product(r: Reducer, s: Reducer) -> Reducer:
    """Pairs of items to a pair of results."""
    return Reducer(
        rows=lambda x, pos, keep=None: F.struct(r.over_rows(x["_1"], pos, keep).alias("_1"), s.over_rows(x["_2"], pos, keep).alias("_2")),
        array=lambda xs: F.struct(r.over_array(F.transform(xs, lambda x: x["_1"])).alias("_1"), s.over_array(F.transform(xs, lambda x: x["_2"])).alias("_2")),
    )


def union(r: Reducer) -> Reducer:
    """Reduces a series of series."""
    return r.flat_mapping(lambda xs: xs)


# -- on pairs: what is done to one part while the other stays ---------------------------------


def _both(a: Column, b: Column) -> Column:
    return F.struct(a.alias("_1"), b.alias("_2"))


def map_fst(r: Reducer, f: Fn) -> Reducer:
    return r.mapping(lambda x: _both(f(x["_1"]), x["_2"]))


def map_snd(r: Reducer, f: Fn) -> Reducer:
    return r.mapping(lambda x: _both(x["_1"], f(x["_2"])))


def filter_fst(r: Reducer, p: Fn) -> Reducer:
    return r.filtering(lambda x: p(x["_1"]))


def filter_snd(r: Reducer, p: Fn) -> Reducer:
    return r.filtering(lambda x: p(x["_2"]))


def filter_map(r: Reducer, f: Fn) -> Reducer:
    """Pushes what f makes, where it isn't null."""
    return r.flat_mapping(lambda x: F.filter(F.array(f(x)), lambda y: y.isNotNull()))


def filter_map_fst(r: Reducer, f: Fn) -> Reducer:
    return r.flat_mapping(lambda x: F.transform(F.filter(F.array(f(x["_1"])), lambda y: y.isNotNull()), lambda y: _both(y, x["_2"])))


def filter_map_snd(r: Reducer, f: Fn) -> Reducer:
    return r.flat_mapping(lambda x: F.transform(F.filter(F.array(f(x["_2"])), lambda y: y.isNotNull()), lambda y: _both(x["_1"], y)))


# -- nested groups ------------------------------------------------------------------------------


def group(key: Fn, value: Fn, r: Reducer) -> Reducer:
    """Nested grouping: a map from key to r of the group's values. Over tables an inner and an outer aggregation."""

    def run(xs: Column) -> Column:
        keys = F.array_sort(F.array_distinct(F.transform(xs, key)))
        entry = lambda k: F.struct(k.alias("key"), r.over_array(F.transform(F.filter(xs, lambda x: key(x).eqNullSafe(k)), value)).alias("value"))
        return F.map_from_entries(F.transform(keys, entry))

    return Reducer(rows=lambda x, pos, keep=None: run(_ordered(x, pos, keep)), array=run, nested=(key, value, r))


def signed_bag() -> Reducer:
    """A bag as element -> count, from (element, sign) pairs; elements of count 0 vanish."""
    counted = group(lambda x: x["_1"], lambda x: x["_2"].cast(_INT), sum_())
    return counted.project(lambda m: F.map_filter(m, lambda _, n: n != 0))
