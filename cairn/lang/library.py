"""The standard library of the language.

Reducers carry the aggregates of ``cairn.functions.reducer``, grouping and windows go to ``cairn.operators`` where they meet
tables; on the driver's sequences the same names work on Python values.
"""

from __future__ import annotations

import itertools
from typing import Any

from pyspark.sql import functions as F

from cairn.functions import reducer as R
from cairn.lang import builtins as B
from cairn.lang.values import Map, Rec, Red, Seq, any_column, is_column, lazy, plain, seq, to_column, to_json
from cairn.operators import windows as W
from cairn.operators.mapping import Mapping, cogroup as cogroup_tables
from cairn.operators.series import Series

LIBRARY: dict[str, tuple[str, Any]] = {}

# Priorities of the library's operators, 0 binds least.
OPERATORS = {">>": (0, "left"), "<<": (0, "right"), "|>": (0, "left"), "<|": (0, "right"), "..": (1, "left"), "..<": (1, "left"), "<..": (1, "left"), "<..<": (1, "left"), "&": (3, "left"), "**": (8, "left")}


def name(name_: str, type_: str, arity: int = 1):
    """Registers a function of ``arity`` curried arguments."""

    def add(f):
        LIBRARY[name_] = (type_, B.curry(arity, f))
        return f

    return add


def value(name_: str, type_: str, v: Any) -> Any:
    LIBRARY[name_] = (type_, v)
    return v


def part(pair, k: int):
    """A component of a pair, on the driver or in a plan."""
    return pair[f"_{k + 1}"] if is_column(pair) else pair[k]


# -- time windows: { size, offset } and { size, slide, offset } ------------------------------------


def tumbling(t, size: int, offset: int):
    return W.tumbling_id(t, size, offset) if is_column(t) else B._quotient(t - offset, size)


def sliding(t, size: int, slide: int, offset: int):
    """The newest window first; size / slide more behind it."""
    if is_column(t):
        return W.sliding_ids(t, size, slide, offset)
    newest = B._quotient(t - offset, slide)
    return seq(newest - k for k in range(size // slide + 1))


_TUMBLING, _SLIDING = "{ size: Int, offset: Int }", "{ size: Int, slide: Int, offset: Int }"


@name("get_tumbling_window", f"{_TUMBLING} -> Int -> Int", 2)
def get_tumbling_window(w: Rec, t):
    return tumbling(t, w.get("size"), w.get("offset"))


@name("get_sliding_windows", f"{_SLIDING} -> Int -> [Int]", 2)
def get_sliding_windows(w: Rec, t):
    return sliding(t, w.get("size"), w.get("slide"), w.get("offset"))


@name("tumbling_window", f"{_TUMBLING} -> (a -> Int) -> Reducer(a,s,c) -> [a] -> {{Int -> c}}", 4)
def tumbling_window(w: Rec, time, r: Red, xs):
    return B.group(lambda x: get_tumbling_window(w, time(x)), lambda x: x, r, xs)


@name("sliding_windows", f"{_SLIDING} -> (a -> Int) -> Reducer(a,s,c) -> [a] -> {{Int -> c}}", 4)
def sliding_windows(w: Rec, time, r: Red, xs):
    placed = B.unnest(lambda x: get_sliding_windows(w, time(x)), xs)
    return B.group(lambda p: part(p, 0), lambda p: part(p, 1), r, placed)


# -- reducers: the driver's fold beside the aggregate for tables ---------------------------------------


def _at_most(n: int) -> Red:
    return Red(0, lambda s, _: s + 1, full=lambda s: s >= n, table=lambda t: t.count_at_most(max(0, n)).first()[0])


def _joined(a, b):
    return B.append(a, b)


def _together(a, b):
    """Both without repetitions, the first of equal items."""
    return B.BUILTINS["unique"][1](B.append(a, b))


def _gathered(known, join, one=None) -> Red:
    """Collects items (each made a sequence by ``one``)."""
    return Red(seq(()), (lambda s, x: join(s, x)) if one is None else (lambda s, x: join(s, one(x))), known=known)


_single = lambda x: seq((x,))
SUM = value("sum", "Reducer(Int,Int,Int)", Red(0, B.ADD, known=R.sum_))
COUNT = value("count", "Reducer(a,Int,Int)", Red(0, lambda s, _: B.ADD(s, 1), known=R.count))
value("product", "Reducer(Int,Int,Int)", Red(1, B.MULT, known=R.product_))
ALL = value("and_reducer", "Reducer(Bool,Bool,Bool)", Red(True, B.AND, full=lambda s: s is False, known=R.and_))
SOME = value("or_reducer", "Reducer(Bool,Bool,Bool)", Red(False, B.OR, full=lambda s: s is True, known=R.or_))
BAG = value("bag", "Reducer(a,[a],[a])", _gathered(R.list_, _joined, _single))
value("bag_union", "Reducer([a],[a],[a])", _gathered(R.bag_union, _joined))
value("set", "Reducer(a,[a],[a])", _gathered(R.set_, _together, _single))
value("set_union", "Reducer([a],[a],[a])", _gathered(R.set_union, _together))
name("count_at_most", "Int -> Reducer(a,Int,Int)")(_at_most)


# -- questions about whole collections ------------------------------------------------------------------


@name("at_least", "Int -> [a] -> Bool", 2)
def at_least(n: int, xs):
    return B.reduce(_at_most(n), xs) >= n


@name("at_most", "Int -> [a] -> Bool", 2)
def at_most(n: int, xs):
    return B.reduce(_at_most(n + 1), xs) <= n


@name("is_empty", "[a] -> Bool")
def is_empty(xs):
    if isinstance(xs, Series):
        return xs.is_empty().first()[0]
    return F.size(xs) == 0 if is_column(xs) else next(iter(xs), xs) is xs


name("forall", "(a -> Bool) -> [a] -> Bool", 2)(lambda p, xs: B.reduce(ALL, B.map_(p, xs)))
name("exists", "(a -> Bool) -> [a] -> Bool", 2)(lambda p, xs: B.reduce(SOME, B.map_(p, xs)))


# -- grouping ---------------------------------------------------------------------------------------------


@name("partition", "(a -> k) -> [a] -> {k -> [a]}", 2)
def partition(p, xs):
    return B.group(p, lambda x: x, BAG, xs)


def _side(xs: Series, key, value_) -> Any:
    return xs.df.select(to_column(key(xs.x)).alias("k"), to_column(value_(xs.x)).alias("v"), F.col(xs.pos).alias("p"))


def _met(xs, ys, left: R.Reducer, right: R.Reducer, kx, vx, ky, vy) -> Mapping:
    """Both tables are aggregated by key before they meet."""
    a, b = _side(xs, kx, vx), _side(ys, ky, vy)
    v, p = F.col("v"), F.col("p")
    zero = lambda r, df: r.over_array(F.array().cast(f"array<{df.schema['v'].dataType.simpleString()}>"))
    got = cogroup_tables(a, b, "k", left.over_rows(v, p).alias("l"), right.over_rows(v, p).alias("r"), zero(left, a), zero(right, b))
    return Mapping(got.select("k", F.struct(F.col("l").alias("_1"), F.col("r").alias("_2")).alias("v")), "k", "v")


def _folded(xs, ys, kx, vx, ky, vy, left: Red, right: Red) -> Map:
    """The same on the driver: keys in the order in which they are met."""
    held: dict[Any, list] = {}
    for side, items, key, value_, r in ((1, xs, kx, vx, left), (2, ys, ky, vy, right)):
        for x in items:
            k = key(x)
            entry = held.setdefault(plain(k), [k, left.seed, right.seed])
            entry[side] = r.push(entry[side], value_(x))
    return Map(tuple((k, (left.term(a), right.term(b))) for k, a, b in held.values()))


@name("cogroup", "(a -> k) -> (a -> v) -> (b -> k) -> (b -> w) -> [a] -> [b] -> {k -> ([v], [w])}", 6)
def cogroup(kx, vx, ky, vy, xs, ys):
    """Each key's values of both sides."""
    if isinstance(xs, Series):
        return _met(xs, ys, R.list_(), R.list_(), kx, vx, ky, vy)
    return _folded(xs, ys, kx, vx, ky, vy, BAG, BAG)


_MONOID = "{ zero: %s, unit: %s -> %s, plus: %s -> %s -> %s }"


def _of_record(r: Rec) -> Red:
    zero, unit, plus = r.get("zero"), r.get("unit"), lambda a, b: r.get("plus")(a)(b)
    known = lambda: R.monoid(to_column(zero), lambda a, b: to_column(plus(a, b))).mapping(lambda x: to_column(unit(x)))
    return Red(zero, lambda s, x: plus(s, unit(x)), known=known)


@name("co_group", f"{_MONOID % (('s', 'a', *['s'] * 4))} -> {_MONOID % (('t', 'b', *['t'] * 4))} -> [(k, a)] -> [(k, b)] -> {{k -> (s, t)}}", 4)
def co_group(rx: Rec, ry: Rec, xs, ys):
    """Each key's values of both sides, reduced by a monoid each."""
    left, right = _of_record(rx), _of_record(ry)
    ends = lambda p: part(p, 0), lambda p: part(p, 1)
    if isinstance(xs, Series):
        return _met(xs, ys, left.known(), right.known(), *ends, *ends)
    return _folded(xs, ys, *ends, *ends, left, right)


# -- collections ---------------------------------------------------------------------------------------------


@name("power_set", "[a] -> [[a]]")
def power_set(xs) -> Seq:
    """All sets of the items; an item that a set already has adds nothing to it."""

    def run():
        sets: list[list] = [[]]
        for x in xs:
            sets += [s if any(plain(x) == plain(y) for y in s) else [*s, x] for s in sets]
        return map(seq, sets)

    return lazy(run)


@name("window_of", "Int -> [a] -> [[a]]", 2)
def window_of(n: int, xs):
    if isinstance(xs, Series):
        s = xs.windows_of(n, "w")
        return Series(s.df.withColumnRenamed("w", xs.item), xs.item, s.pos)

    def run():
        held: list = []
        for x in xs:
            held = [*held, x][-n:]
            if len(held) == n:
                yield seq(held)

    return lazy(run)


@name("cross_product", "[a] -> [b] -> [(a, b)]", 2)
def cross_product(xs, ys):
    if isinstance(xs, Series) and isinstance(ys, Series):
        both = xs.df.select(xs.x.alias("_a"), F.col(xs.pos).alias("_i")).crossJoin(ys.df.select(ys.x.alias("_b"), F.col(ys.pos).alias("_j")))
        return Series(both.select(F.struct("_j", "_i").alias("_pos"), F.struct(F.col("_a").alias("_1"), F.col("_b").alias("_2")).alias("item")), "item")
    return B.unnest(lambda _: xs, ys)


@name("map_cross_product", "(a -> b -> c) -> [a] -> [b] -> [c]", 3)
def map_cross_product(f, xs, ys):
    return B.map_(lambda p: f(part(p, 0))(part(p, 1)), cross_product(xs, ys))


@name("decorate", "a -> a -> [a] -> [a]", 3)
def decorate(first, last, xs):
    return xs.decorate(to_column(first), to_column(last)) if isinstance(xs, Series) else B.cons(first, B.sonc(xs, last))


@name("remove", "(a -> Bool) -> [a] -> [a]", 2)
def remove(p, xs):
    if isinstance(xs, Series):
        return xs.remove(B._col(p))
    return B.filter_(lambda x: B.BUILTINS["not"][1](p(x)), xs)


name("&", "[a] -> [a] -> [a]", 2)(_joined)
name("union", "[a] -> [a] -> [a]", 2)(lambda xs, ys: xs.union(ys) if isinstance(xs, Series) else _together(xs, ys))
name("string_words", "String -> [String]")(B.BUILTINS["string_extract"][1]("[a-zA-Z]+"))


# -- generators -------------------------------------------------------------------------------------------------


def _steps(x, f):
    while True:
        yield x
        x = f(x)


value("integers", "[Int]", lazy(itertools.count))
name("iterate", "a -> (a -> a) -> [a]", 2)(lambda x, f: lazy(lambda: _steps(x, f)))
name("series", "a -> (a -> a) -> [a]", 2)(lambda x, f: lazy(lambda: itertools.islice(_steps(x, f), 1, None)))


@name("transduce", "{ seed: s, step: a -> s -> (s, [b]), term: s -> [b] } -> [a] -> [b]", 2)
def transduce(t: Rec, xs):
    return B.transduce(t.get("seed"), t.get("step"), t.get("term"), xs)


def _between(first: int, last: int):
    return lambda a, b: B.range_(B.ADD(a, first), B.ADD(b, -last))


for _name, _ends in {"..": (0, 0), "..<": (0, 1), "<..": (1, 0), "<..<": (1, 1)}.items():
    name(_name, "Int -> Int -> [Int]", 2)(_between(*_ends))


@name("**", "Int -> Int -> Int", 2)
def power(m, n):
    if any_column(m, n):
        from cairn.functions.arrays import power as of_columns

        return of_columns(to_column(m), to_column(n))
    return B._int64(lambda a, b: a**b)(m, max(0, n))


# -- comparisons, also as sections whose bound comes first ---------------------------------------------------------


def _same(a, b):
    return to_column(a).eqNullSafe(to_column(b)) if any_column(a, b) else plain(a) == plain(b)


_COMPARE = "a -> a -> Bool"
name("==", _COMPARE, 2)(_same)
name("eq", _COMPARE, 2)(_same)
name("!=", _COMPARE, 2)(lambda a, b: ~_same(a, b) if any_column(a, b) else not _same(a, b))
for _name, _sign in {"gt": ">", "ge": ">=", "lt": "<", "le": "<="}.items():
    name(_name, _COMPARE, 2)(lambda bound, x, f=B.BUILTINS[_sign][1]: f(x)(bound))


# -- functions ----------------------------------------------------------------------------------------------------------

for _name, _type, _arity, _f in (
    ("id", "a -> a", 1, lambda x: x),
    ("constant", "a -> b -> a", 2, lambda x, _: x),
    ("flip", "(a -> b -> c) -> b -> a -> c", 3, lambda f, y, x: f(x)(y)),
    ("curry", "((a, b) -> c) -> a -> b -> c", 3, lambda f, x, y: f((x, y))),
    ("uncurry", "(a -> b -> c) -> (a, b) -> c", 2, lambda f, p: f(part(p, 0))(part(p, 1))),
    ("pair", "a -> b -> (a, b)", 2, lambda x, y: (x, y)),
    ("pair_with", "(a -> b) -> a -> (b, a)", 2, lambda f, x: (f(x), x)),
    ("dup", "a -> (a, a)", 1, lambda x: (x, x)),
    ("swap", "(a, b) -> (b, a)", 1, lambda p: (part(p, 1), part(p, 0))),
    (">>", "(a -> b) -> (b -> c) -> a -> c", 3, lambda f, g, x: g(f(x))),
    ("<<", "(b -> c) -> (a -> b) -> a -> c", 3, lambda g, f, x: g(f(x))),
    ("|>", "a -> (a -> b) -> b", 2, lambda x, f: f(x)),
    ("<|", "(a -> b) -> a -> b", 2, lambda f, x: f(x)),
):
    name(_name, _type, _arity)(_f)


# -- codecs ----------------------------------------------------------------------------------------------------------------

name("shape", "a -> Shape(a)")(lambda _: None)


def _format(encode, decode) -> Rec:
    return Rec((("encode", encode), ("decode", decode), ("print", lambda x: seq((to_json(x),)))))


_CODEC = "{ encode: Shape(a) -> a -> [String], decode: Shape(b) -> String -> [b], print: c -> [String] }"
for _name in ("json", "marshal"):
    value(_name, _CODEC, _format(B.BUILTINS[f"{_name}_encode"][1], B.BUILTINS[f"{_name}_decode"][1]))
value("no_encoding", "{ encode: a -> a, decode: b -> b }", Rec((("encode", lambda x: x), ("decode", lambda x: x))))


@name("encoding", "a with { encode: Shape(b) -> c, decode: Shape(b) -> d } -> Shape(b) -> { encode: c, decode: d }", 2)
def encoding(codec: Rec, shape):
    return Rec(tuple((side, codec.get(side)(shape)) for side in ("encode", "decode")))
