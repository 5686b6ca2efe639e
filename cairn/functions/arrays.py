"""The series operators over array columns: nested or small series, inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def range_(low: Column, high: Column) -> Column:
    """low..high included, empty when low > high (sequence alone would count down)."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def range_open(low: Column, high: Column, open_low: bool, open_high: bool) -> Column:
    return range_(low + 1 if open_low else low, high - 1 if open_high else high)


def iterate(n: int, step: Fn, start: Column) -> Column:
    """[start, step(start), ...], n items."""
    if n <= 0:
        return F.slice(F.array(start), 1, 0)
    rest = F.array_repeat(F.lit(0), n - 1)
    return F.aggregate(rest, F.array(start), lambda acc, _: F.array_append(acc, step(F.element_at(acc, -1))))


def bounded_generate(seed: Column, step: Callable[[Column], tuple[Column, Column]], done: Fn, most: int) -> Column:
    """Unfolds (state, item) until done(state), at most ``most`` items."""
    state, item = step(seed)
    zero = F.struct(seed.alias("s"), F.slice(F.array(item), 1, 0).alias("out"))

    def push(acc: Column, _: Column) -> Column:
        nxt, x = step(acc["s"])
        return F.when(done(acc["s"]), acc).otherwise(F.struct(nxt.alias("s"), F.array_append(acc["out"], x).alias("out")))

    return F.aggregate(F.array_repeat(F.lit(0), most), zero, push, lambda acc: acc["out"])


def _first_failure(xs: Column, p: Fn) -> Column:
    """The 1-based place of the first item that fails p, or size + 1."""
    place = F.array_position(F.transform(xs, lambda x: F.coalesce(p(x), F.lit(False))), False)
    return F.when(place == 0, F.size(xs) + 1).otherwise(place).cast("int")


def take(xs: Column, n: int) -> Column:
    return F.slice(xs, 1, max(0, n))


def drop(xs: Column, n: int) -> Column:
    return F.slice(xs, F.lit(max(0, n) + 1), F.greatest(F.size(xs) - max(0, n), F.lit(0)))


def take_while(xs: Column, p: Fn) -> Column:
    return F.slice(xs, F.lit(1), _first_failure(xs, p) - 1)


def drop_while(xs: Column, p: Fn) -> Column:
    at = _first_failure(xs, p)
    return F.slice(xs, at, F.size(xs) - at + 1)


def dedupe(xs: Column) -> Column:
    """Without items that equal the one before."""
    return F.transform(F.filter(F.transform(xs, lambda x, i: F.struct(x.alias("x"), ((i == 0) | ~x.eqNullSafe(F.get(xs, i - 1))).alias("k"))), lambda s: s["k"]), lambda s: s["x"])


def unique(xs: Column) -> Column:
    return F.array_distinct(xs)


def interpose(xs: Column, sep: Column) -> Column:
    return F.flatten(F.transform(xs, lambda x, i: F.when(i == 0, F.array(x)).otherwise(F.array(sep, x))))


def before_each(xs: Column, sep: Column) -> Column:
    return F.flatten(F.transform(xs, lambda x: F.array(sep, x)))


def after_each(xs: Column, sep: Column) -> Column:
    return F.flatten(F.transform(xs, lambda x: F.array(x, sep)))


def decorate(xs: Column, first: Column, last: Column) -> Column:
    return F.concat(F.array(first), xs, F.array(last))


def unnest(xs: Column, f: Fn) -> Column:
    """(item, parent) pairs."""
    return F.flatten(F.transform(xs, lambda x: F.transform(f(x), lambda y: F.struct(y.alias("_1"), x.alias("_2")))))


def windows_of(xs: Column, n: int) -> Column:
    """All runs of n consecutive items."""
    return F.when(F.size(xs) >= n, F.transform(F.sequence(F.lit(1), F.size(xs) - n + 1), lambda i: F.slice(xs, i, F.lit(n)))).otherwise(F.slice(F.array(xs), 1, 0))


def power_set(xs: Column) -> Column:
    """All sets of the items; an item that a set already has adds nothing to it."""
    none = F.array(F.slice(xs, 1, 0))
    return F.aggregate(xs, none, lambda sets, x: F.concat(sets, F.transform(sets, lambda s: F.when(F.exists(s, lambda y: y.eqNullSafe(x)), s).otherwise(F.array_append(s, x)))))


def cross_product(xs: Column, ys: Column) -> Column:
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("_1"), y.alias("_2")))))


def power(base: Column, exponent: Column) -> Column:
    """Exact integer power as a product of repeats."""
    return F.aggregate(F.array_repeat(base.cast("bigint"), exponent.cast("int")), F.lit(1).cast("bigint"), lambda a, x: a * x)


def string_split(text: Column, regex: str) -> Column:
    """Pieces between matches; one empty piece at each end is dropped, inner ones stay."""
    parts = F.split(text, regex, -1)
    head = F.when((F.size(parts) > 1) & (F.get(parts, F.lit(0)) == ""), 2).otherwise(1)
    tail = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.slice(parts, head, F.greatest(F.size(parts) - (head - 1) - tail, F.lit(0))))


def string_extract(text: Column, regex: str) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(0))


def string_words(text: Column) -> Column:
    return string_extract(text, "[a-zA-Z]+")
