"""The built-in functions: name -> (type, curried implementation).

Each works on driver values, and where it makes sense on columns (inside plans) and on series (tables).
"""

from __future__ import annotations

import itertools
import re
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import arrays as A
from cairn.functions import codecs as C
from cairn.functions import reducer as R
from cairn.lang.values import UNIT, Map, Rec, Red, Seq, Shape, any_column, from_json, is_column, lazy, parse_json, plain, seq, to_column, to_json
from cairn.operators.series import Series

BUILTINS: dict[str, tuple[str, Any]] = {}


def curry(n: int, f: Callable) -> Callable:
    if n == 1:
        return f
    return lambda x: curry(n - 1, lambda *rest: f(x, *rest))


def define(name: str, type_: str, n: int = 1):
    def add(f):
        BUILTINS[name] = (type_, curry(n, f))
        return f

    return add


def constant(name: str, type_: str, value) -> None:
    BUILTINS[name] = (type_, value)


def _col(f: Callable[[Any], Any]) -> Callable[[Column], Column]:
    """A function of the language as a function of columns."""
    return lambda x: to_column(f(x))


def _num(name: str, on_values: Callable, on_columns: Callable, type_: str = "Int -> Int -> Int") -> Callable:
    def run(a, b):
        return on_columns(to_column(a), to_column(b)) if any_column(a, b) else on_values(a, b)

    BUILTINS[name] = (type_, curry(2, run))
    return run


def _quotient(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def _int64(f: Callable[[int, int], int]) -> Callable[[int, int], int]:
    """Integers have 64 bits, as in plans; what doesn't fit is an error."""

    def run(a, b):
        c = f(a, b)
        if not -(2**63) <= c < 2**63:
            raise OverflowError(f"{c} is no 64-bit integer")
        return c

    return run


ADD = _num("+", _int64(lambda a, b: a + b), lambda a, b: a + b)
BUILTINS["add"] = BUILTINS["+"]
_num("-", _int64(lambda a, b: a - b), lambda a, b: a - b)
MULT = _num("*", _int64(lambda a, b: a * b), lambda a, b: a * b)
BUILTINS["mult"] = BUILTINS["*"]
_num("/", _quotient, lambda a, b: F.call_function("div", a, b))
_num("mod", lambda a, b: a - b * _quotient(a, b), lambda a, b: a % b)
constant("zero", "Int", 0)
constant("one", "Int", 1)
_COMPARE = "a -> a -> Bool"
for _name, _f in {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}.items():
    _num(_name, _f, _f, _COMPARE)
AND = _num("and", lambda a, b: a and b, lambda a, b: a & b, "Bool -> Bool -> Bool")
OR = _num("or", lambda a, b: a or b, lambda a, b: a | b, "Bool -> Bool -> Bool")
_num("++", lambda a, b: a + b, lambda a, b: F.concat(a, b), "String -> String -> String")
define("not", "Bool -> Bool")(lambda a: ~a if is_column(a) else not a)
constant("true", "Bool", True)
constant("false", "Bool", False)
define("fst", "(a, b) -> a")(lambda p: p["_1"] if is_column(p) else p[0])
define("snd", "(a, b) -> b")(lambda p: p["_2"] if is_column(p) else p[1])
define("equal", "Shape(a) -> a -> a -> Bool", 3)(lambda _, a, b: to_column(a).eqNullSafe(to_column(b)) if any_column(a, b) else plain(a) == plain(b))
define("generic", "(Shape(a) -> b) -> b")(lambda f: f(Shape(None)))


@define("if_then_else", "Bool -> (() -> a) -> (() -> a) -> a", 3)
def if_then_else(test, yes, no):
    if is_column(test):
        return F.when(test, to_column(yes(UNIT))).otherwise(to_column(no(UNIT)))
    return yes(UNIT) if test else no(UNIT)


# -- sequences -------------------------------------------------------------------------

constant("empty_sequence", "[a]", seq(()))


@define("cons", "a -> [a] -> [a]", 2)
def cons(x, xs):
    if isinstance(xs, Series):
        return xs.cons(to_column(x))
    if any_column(x, xs):
        return F.array_prepend(to_column(xs), to_column(x))
    return lazy(lambda: itertools.chain([x], xs))


@define("sonc", "[a] -> a -> [a]", 2)
def sonc(xs, x):
    if isinstance(xs, Series):
        return xs.sonc(to_column(x))
    if is_column(xs):
        return F.array_append(xs, to_column(x))
    return lazy(lambda: itertools.chain(xs, [x]))


@define("append", "[a] -> [a] -> [a]", 2)
def append(a, b):
    if isinstance(a, Series):
        return a.append(b)
    return F.concat(to_column(a), to_column(b)) if any_column(a, b) else lazy(lambda: itertools.chain(a, b))


@define("map", "(a -> b) -> [a] -> [b]", 2)
def map_(f, xs):
    if isinstance(xs, Series):
        return xs.map(_col(f))
    return F.transform(xs, _col(f)) if is_column(xs) else lazy(lambda: map(f, xs))


@define("filter", "(a -> Bool) -> [a] -> [a]", 2)
def filter_(p, xs):
    if isinstance(xs, Series):
        return xs.filter(_col(p))
    return F.filter(xs, _col(p)) if is_column(xs) else lazy(lambda: filter(p, xs))


@define("flat_map", "(a -> [b]) -> [a] -> [b]", 2)
def flat_map(f, xs):
    if isinstance(xs, Series):
        return xs.flat_map(_col(f))
    return F.flatten(F.transform(xs, _col(f))) if is_column(xs) else lazy(lambda: (y for x in xs for y in f(x)))


@define("unnest", "(a -> [b]) -> [a] -> [(b, a)]", 2)
def unnest(f, xs):
    if isinstance(xs, Series):
        s = xs.unnest(_col(f))
        return Series(s.df.withColumn(s.item, F.struct(F.col(s.item).alias("_1"), F.col("parent").alias("_2"))).drop("parent"), s.item, s.pos)
    return A.unnest(xs, _col(f)) if is_column(xs) else lazy(lambda: ((y, x) for x in xs for y in f(x)))


define("concat", "[[a]] -> [a]")(lambda xs: flat_map(lambda x: x, xs))


@define("range", "Int -> Int -> [Int]", 2)
def range_(a, b):
    return A.range_(to_column(a), to_column(b)) if any_column(a, b) else lazy(lambda: iter(range(a, b + 1)))


def _times(n, x):
    return F.array_repeat(to_column(x), to_column(n).cast("int")) if any_column(n, x) else lazy(lambda: itertools.repeat(x, max(0, n)))


define("repeat", "Int -> a -> [a]", 2)(_times)
define("times", "Int -> a -> [a]", 2)(_times)


@define("iterate", "Int -> (a -> a) -> a -> [a]", 3)
def iterate(n, f, x):
    if any_column(x):
        return A.iterate(n, _col(f), to_column(x))
    return lazy(lambda: itertools.islice(itertools.accumulate(itertools.repeat(x), lambda a, _: f(a)), max(0, n)))


@define("generator", "a -> (a -> (a, b)) -> [b]", 2)
def generator(seed, step):
    def run():
        s = seed
        while True:
            s, x = step(s)
            yield x

    return lazy(run)


@define("bounded_generator", "a -> (a -> (a, b)) -> (a -> Bool) -> [b]", 3)
def bounded_generator(seed, step, done):
    def run():
        s = seed
        while not done(s):
            s, x = step(s)
            yield x

    return lazy(run)


def _ordered(name, type_, on_series, on_array, on_values):
    def run(a, xs):
        if isinstance(xs, Series):
            return on_series(xs, a)
        return on_array(xs, a) if is_column(xs) else lazy(lambda: on_values(xs, a))

    BUILTINS[name] = (type_, curry(2, run))


_ordered("take", "Int -> [a] -> [a]", lambda s, n: s.take(n), A.take, lambda xs, n: itertools.islice(iter(xs), max(0, n)))
_ordered("drop", "Int -> [a] -> [a]", lambda s, n: s.drop(n), A.drop, lambda xs, n: itertools.islice(iter(xs), max(0, n), None))
_ordered("take_while", "(a -> Bool) -> [a] -> [a]", lambda s, p: s.take_while(_col(p)), lambda xs, p: A.take_while(xs, _col(p)), lambda xs, p: itertools.takewhile(p, xs))
_ordered("drop_while", "(a -> Bool) -> [a] -> [a]", lambda s, p: s.drop_while(_col(p)), lambda xs, p: A.drop_while(xs, _col(p)), lambda xs, p: itertools.dropwhile(p, xs))


def _interposed(xs, sep):
    for k, x in enumerate(xs):
        if k:
            yield sep
        yield x


_ordered("interpose", "a -> [a] -> [a]", lambda s, x: s.interpose(to_column(x)), lambda xs, x: A.interpose(xs, to_column(x)), _interposed)
_ordered("before_each", "a -> [a] -> [a]", lambda s, x: s.before_each(to_column(x)), lambda xs, x: A.before_each(xs, to_column(x)), lambda xs, x: (y for z in xs for y in (x, z)))
_ordered("after_each", "a -> [a] -> [a]", lambda s, x: s.after_each(to_column(x)), lambda xs, x: A.after_each(xs, to_column(x)), lambda xs, x: (y for z in xs for y in (z, x)))


def _whole(name, on_series, on_array, on_values):
    def run(xs):
        if isinstance(xs, Series):
            return on_series(xs)
        return on_array(xs) if is_column(xs) else lazy(lambda: on_values(xs))

    BUILTINS[name] = ("[a] -> [a]", run)


def _unique(xs):
    seen = set()
    for x in xs:
        k = plain(x)
        if k not in seen:
            seen.add(k)
            yield x


def _last(xs):
    out: list = []
    for x in xs:
        out = [x]
    return iter(out)


_whole("unique", lambda s: s.unique(), A.unique, _unique)
_whole("dedupe", lambda s: s.dedupe(), A.dedupe, lambda xs: (next(g) for _, g in itertools.groupby(xs, plain)))
_whole("take_first", lambda s: s.take_first(), lambda xs: A.take(xs, 1), lambda xs: itertools.islice(iter(xs), 1))
_whole("take_last", lambda s: s.take_last(), lambda xs: F.slice(F.reverse(xs), 1, 1), _last)


@define("transduce", "s -> (a -> s -> (s, [b])) -> (s -> [b]) -> [a] -> [b]", 4)
def transduce(seed, step, term, xs):
    def run():
        s = seed
        for x in xs:
            s, made = step(x)(s)
            yield from made
        yield from term(s)

    return lazy(run)


# -- reducers ---------------------------------------------------------------------------------


def _push2(plus):
    return lambda s, x: plus(s)(x)


define("monoid", "a -> (a -> a -> a) -> Reducer(a,a,a)", 2)(lambda zero, plus: Red(zero, _push2(plus)))
define("monoid_with_maximum", "a -> (a -> a -> a) -> a -> Reducer(a,a,a)", 3)(lambda zero, plus, top: Red(zero, _push2(plus), full=lambda s: s == top))
define("monoid_with_maximum_check", "a -> (a -> a -> a) -> (a -> Bool) -> Reducer(a,a,a)", 3)(lambda zero, plus, top: Red(zero, _push2(plus), full=top))
def _if_known(r: Red, make: Callable):
    """A function that gives what make gives for the reducer as aggregates, or None where it has none."""

    def later():
        known = _known(r)
        return None if known is None else make(known if r.known is not None else known.project(_col(r.term)))

    return later


@define("mapping", "(a -> b) -> Reducer(b,s,c) -> Reducer(a,s,c)", 2)
def mapping(f, r):
    return Red(r.seed, lambda s, x: r.push(s, f(x)), r.term, r.full, _if_known(r, lambda k: k.mapping(_col(f))))


@define("project", "(c -> d) -> Reducer(a,s,c) -> Reducer(a,s,d)", 2)
def project(f, r):
    return Red(r.seed, r.push, lambda s: f(r.term(s)), r.full, _if_known(r, lambda k: k.project(_col(f))))


@define("filtering", "(a -> Bool) -> Reducer(a,s,c) -> Reducer(a,s,c)", 2)
def filtering(p, r):
    return Red(r.seed, lambda s, x: if_then_else(p(x), lambda _: r.push(s, x), lambda _: s), r.term, r.full, _if_known(r, lambda k: k.filtering(_col(p))))


def _fold(r: Red, xs):
    s = r.seed
    if r.full(s) is True:
        return s
    for x in xs:
        s = r.push(s, x)
        if r.full(s) is True:
            break
    return s


def _fold_column(r: Red, xs: Column) -> Column:
    return F.aggregate(xs, to_column(r.seed), lambda s, x: to_column(r.push(s, x)))


@define("flat_mapping", "(a -> [b]) -> Reducer(b,s,c) -> Reducer(a,s,c)", 2)
def flat_mapping(f, r):
    def push(s, x):
        items = f(x)
        if is_column(items) or any_column(s, x):
            return F.aggregate(to_column(items), to_column(s), lambda a, y: to_column(r.push(a, y)))
        return _fold(Red(s, r.push, full=r.full), items)

    return Red(r.seed, push, r.term, r.full, _if_known(r, lambda k: k.flat_mapping(_col(f))))


@define("unnesting", "(a -> [b]) -> Reducer((b, a),s,c) -> Reducer(a,s,c)", 2)
def unnesting(f, r):
    return flat_mapping(lambda x: map_(lambda y: (y, x), f(x)), r)


define("union_reducer", "Reducer(a,s,c) -> Reducer([a],s,c)")(lambda r: flat_mapping(lambda xs: xs, r))


@define("product_reducer", "Reducer(a,b,c) -> Reducer(d,e,f) -> Reducer((a, d),(b, e),(c, f))", 2)
def product_reducer(r, q):
    part = lambda p, k: p[f"_{k + 1}"] if is_column(p) else p[k]
    return Red((r.seed, q.seed), lambda s, x: (r.push(part(s, 0), part(x, 0)), q.push(part(s, 1), part(x, 1))), lambda s: (r.term(part(s, 0)), q.term(part(s, 1))), lambda s: r.full(part(s, 0)) is True and q.full(part(s, 1)) is True, _if_known(r, lambda k: _if_known(q, lambda m: R.product(k, m))()))


@define("group_reducer", "(a -> k) -> (a -> v) -> Reducer(v,s,w) -> Reducer(a,{k -> s},{k -> w})", 3)
def group_reducer(key, value, r):
    def push(m, x):
        k = plain(key(x))
        old = dict(m.pairs)
        keys = {plain(q): q for q in old}
        at = keys.get(k, key(x))
        old[at] = r.push(old.get(at, r.seed), value(x))
        return Map(tuple(old.items()))

    return Red(Map(()), push, lambda m: Map(tuple((k, r.term(s)) for k, s in m.pairs)))


@define("top", "(a -> k) -> (a -> v) -> Int -> Reducer(a,[a],[a])", 3)
def top(key, value, n):
    """The n largest by value, one for each key; of equal ones the earlier stays first."""

    def push(held, x):
        items = [y for y in held]
        same = [y for y in items if plain(key(y)) == plain(key(x))]
        if same and not value(x) > value(same[0]):
            return held
        items = [y for y in items if not same or y is not same[0]]
        at = next((i for i, y in enumerate(items) if value(x) > value(y)), len(items))
        return seq([*items[:at], x, *items[at:]][:n])

    def of_table(xs: Series):
        rows = xs.top(_col(key), _col(value), n)
        return seq([from_spark(r[0]) for r in rows.select(xs.item).collect()])

    return Red(seq(()), push, table=of_table)


def _ends(take: str) -> Callable[[Series], Seq]:
    return lambda xs: seq([from_spark(r[0]) for r in getattr(xs, take)().df.select(xs.item).collect()])


constant("first", "Reducer(a,[a],[a])", Red(seq(()), lambda s, x: s if any(True for _ in s) else seq((x,)), full=lambda s: any(True for _ in s), table=_ends("take_first")))
constant("last", "Reducer(a,[a],[a])", Red(seq(()), lambda _, x: seq((x,)), table=_ends("take_last")))
define("first_or", "a -> Reducer(a,(Bool, a),a)")(lambda d: Red((False, d), lambda s, x: s if s[0] else (True, x), lambda s: s[1], lambda s: s[0], lambda: R.first_or(to_column(d))))
define("last_or", "a -> Reducer(a,a,a)")(lambda d: Red(d, lambda _, x: x, known=lambda: R.last_or(to_column(d))))


@define("reduce", "Reducer(a,s,c) -> [a] -> c", 2)
def reduce(r, xs):
    """Over a table the fold runs inside the plan: one row, whose value is fetched."""
    if isinstance(xs, Series):
        if r.table is not None:
            return r.table(xs)
        known = _known(r)
        red = known or R.fold(to_column(r.seed), lambda s, x: to_column(r.push(s, x)))
        got = from_spark(xs.reduce(red, "v").first()["v"])
        return got if known is not None and r.known is not None else r.term(got)
    if is_column(xs):
        return to_column(r.term(_fold_column(r, xs)))
    return r.term(_fold(r, xs))


def from_spark(x):
    """A fetched value as a value of the language."""
    if hasattr(x, "asDict"):
        d = x.asDict()
        if list(d) == ["_1", "_2"]:
            return (from_spark(d["_1"]), from_spark(d["_2"]))
        return Rec(tuple((n, from_spark(v)) for n, v in d.items()))
    return seq(map(from_spark, x)) if isinstance(x, list) else x


def _known(r: Red):
    """The reducer as aggregates of columns; one that adds integers is recognised by what it does to a probe column."""
    if r.known is not None:
        return r.known()
    if isinstance(r.seed, int) and not isinstance(r.seed, bool) and r.seed == 0:
        s, x = F.col("_s"), F.col("_x")
        try:
            if str(r.push(s, x)) == str(s + x):
                return R.sum_()
        except Exception:  # the reducer isn't one over columns
            return None
    return None


@define("rolling", "Reducer(a,s,c) -> [a] -> [c]", 2)
def rolling(r, xs):
    if isinstance(xs, Series):
        known = _known(r)
        if known is None or known.plus is None or known.running is None:
            raise ValueError("rolling over a table takes a reducer with an aggregate, such as sum, count or and_reducer")
        s = xs.rolling(lambda x: known.running(known.before(x)), "rolled", None, known.plus)
        finish = known.finish if r.known is not None else (lambda c: to_column(r.term(known.finish(c))))
        return Series(s.df.select(s.pos, finish(F.col("rolled")).alias(xs.item)), xs.item, s.pos)
    if is_column(xs):
        all_ = F.aggregate(xs, F.array(to_column(r.seed)), lambda acc, x: F.array_append(acc, to_column(r.push(F.element_at(acc, -1), x))))
        return F.transform(A.drop(all_, 1), _col(r.term))

    def run():
        s = r.seed
        for x in xs:
            s = r.push(s, x)
            yield r.term(s)

    return lazy(run)


@define("group", "(a -> k) -> (a -> v) -> Reducer(v,s,w) -> [a] -> {k -> w}", 4)
def group(key, value, r, xs):
    if isinstance(xs, Series):
        red = _if_known(r, lambda k: k)() or R.fold(to_column(r.seed), lambda s, x: to_column(r.push(s, x)), lambda s: to_column(r.term(s)))
        return xs.group(_col(key), _col(value), red)
    return reduce(group_reducer(key, value, r), xs)


def _pairs(m):
    if isinstance(m, Map):
        return seq(m.pairs)
    df = m.pairs()
    return Series(df.select(F.monotonically_increasing_id().alias("_pos"), F.struct(F.col(m.key).alias("_1"), F.col(m.value).alias("_2")).alias("item")), "item")


define("pairs", "{k -> v} -> [(k, v)]")(_pairs)
define("keys", "{k -> v} -> [k]")(lambda m: map_(BUILTINS["fst"][1], _pairs(m)))
define("values", "{k -> v} -> [v]")(lambda m: map_(BUILTINS["snd"][1], _pairs(m)))
define("value", "k -> {k -> v} -> [v]", 2)(lambda k, m: map_(BUILTINS["snd"][1], filter_(lambda p: BUILTINS["equal"][1](None)(BUILTINS["fst"][1](p))(k), _pairs(m))))


@define("group_updates", "(a -> k) -> (a -> v) -> Reducer(v,s,w) -> ((k, w) -> b) -> ((k, w) -> b) -> [a] -> [b]", 6)
def group_updates(key, value, r, insert, remove, xs):
    def run():
        held: dict = {}
        for x in xs:
            k = key(x)
            at = plain(k)
            old = held.get(at)
            new = r.push(r.seed if old is None else old[0], value(x))
            if plain(new) == plain(r.seed if old is None else old[0]):
                continue
            if old is not None:
                yield remove((k, r.term(old[0])))
            held[at] = (new,)
            yield insert((k, r.term(new)))

    return lazy(run)


# -- strings and codecs -------------------------------------------------------------------------


@define("string_split", "String -> String -> [String]", 2)
def string_split(regex, text):
    if any_column(text):
        return A.string_split(to_column(text), regex)
    parts = re.split(regex, text) if text else []
    if len(parts) > 1 and parts[0] == "":
        parts = parts[1:]
    if len(parts) > 1 and parts[-1] == "":
        parts = parts[:-1]
    return seq(parts)


@define("string_extract", "String -> String -> [String]", 2)
def string_extract(regex, text):
    return A.string_extract(text, regex) if any_column(text) else seq(m[0] for m in re.finditer(regex, text))


def codec_shape(spec) -> C.Shape:
    if isinstance(spec, str):
        return C.Atom(spec)
    if spec[0] == "list":
        return C.ListOf(codec_shape(spec[1]))
    if spec[0] == "tuple":
        return C.TupleOf(tuple(map(codec_shape, spec[1:]))) if len(spec) > 1 else C.Unit
    return C.RecordOf(tuple((n, codec_shape(s)) for n, s in spec[1:]))


def _decode(shape, text):
    if is_column(text):
        return C.json_decode(codec_shape(shape.spec), text)
    try:
        return seq((from_json(shape.spec, parse_json(text)),))
    except ValueError:
        return seq(())


define("json_decode", "Shape(a) -> String -> [a]", 2)(_decode)
define("json_encode", "Shape(a) -> a -> [String]", 2)(lambda s, x: F.array(C.json_encode(codec_shape(s.spec), to_column(x))) if any_column(x) else seq((to_json(x),)))
BUILTINS["marshal_decode"] = BUILTINS["json_decode"]
BUILTINS["marshal_encode"] = BUILTINS["json_encode"]


@define("time_ms", "(a -> b) -> a -> (Int, b)", 2)
def time_ms(f, x):
    began = time.perf_counter()
    y = f(x)
    return (int((time.perf_counter() - began) * 1000), y)
