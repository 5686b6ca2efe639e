"""The interpreter: text to typed expressions to values or plans, and how they are shown."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.lang import parser as P
from cairn.lang.builtins import BUILTINS, curry, flat_map, from_spark, map_
from cairn.lang.infer import UnknownValue, infer, read_type
from cairn.lang.types import BOOL, INT, STRING, UNIT, Record, Scheme, Type, TypeProblem, is_data, list_of, pair, show_scheme
from cairn.lang.values import UNIT as UNIT_VALUE
from cairn.lang.values import Rec, Seq, Shape, Tagged, is_column, show
from cairn.operators.series import Series


def evaluate(e, env: dict[str, Any], local: dict[str, Any]) -> Any:
    match e:
        case P.Name(n):
            return local[n] if n in local else env[n]
        case P.Lit(v):
            return v
        case P.Unit():
            return UNIT_VALUE
        case P.Fun(x, body):
            return lambda v: evaluate(body, env, {**local, x: v})
        case P.App(f, x):
            return evaluate(f, env, local)(evaluate(x, env, local))
        case P.Pair(a, b):
            return (evaluate(a, env, local), evaluate(b, env, local))
        case P.Part(k, x):
            v = evaluate(x, env, local)
            return v[f"_{k + 1}"] if is_column(v) else v[k]
        case P.Extend(base, n, v):
            b, x = evaluate(base, env, local), evaluate(v, env, local)
            if is_column(b):
                from cairn.lang.values import to_column

                return b.withField(n, to_column(x))
            return b.extend(n, x)
        case P.Dot(n):
            return lambda r: r[n] if is_column(r) else r.get(n)
        case P.Tag(tag, v):
            return Tagged(tag, evaluate(v, env, local))
        case P.Cases(cases):

            def choose(s: Tagged):
                for tag, x, body in cases:
                    if s.tag == tag:
                        return evaluate(body, env, {**local, x: s.value})
                raise ValueError(s.tag)

            return choose
        case P.ShapeLit(s):
            return Shape(s)
    raise TypeError(e)


class Session:
    """Definitions so far; ``run`` takes program text and gives the lines to show."""

    def __init__(self, stdlib: bool = False, spark: SparkSession | None = None):
        self.parser = P.Parser()
        self.types: dict[str, Scheme] = {n: read_type(t) for n, (t, _) in BUILTINS.items()}
        self.values: dict[str, Any] = {n: v for n, (_, v) in BUILTINS.items()}
        if spark is not None:
            for n, (t, v) in sources(spark).items():
                self.types[n], self.values[n] = read_type(t), v
        if stdlib:
            from cairn.lang.library import LIBRARY, OPERATORS

            self.parser.operators |= OPERATORS
            self.types |= {n: read_type(t) for n, (t, _) in LIBRARY.items()}
            self.values |= {n: v for n, (_, v) in LIBRARY.items()}

    def table(self, name: str, df: DataFrame, pos: str) -> None:
        """Makes a table's rows, in the order of pos, a sequence of records of the language."""
        rows = df.select(F.col(pos).alias("_pos"), F.struct(*[F.col(f.name).cast("bigint").alias(f.name) if f.dataType in (T.IntegerType(), T.ShortType()) else F.col(f.name) for f in df.schema if language_type(f.dataType) is not None]).alias("item"))
        t: Type = UNIT
        for f in df.schema:
            own = language_type(f.dataType)
            if own is not None:
                t = Record(t, f.name, own)
        self.types[name], self.values[name] = Scheme(list_of(t)), Series(rows, "item")

    def run(self, program: str) -> list[str]:
        """The shown results; the first problem ends the program with its message."""
        out: list[str] = []
        try:
            self._run(program, out)
        except (TypeProblem, UnknownValue) as e:
            out.append(str(e))
        except P.Incomplete:
            raise
        except P.ParseProblem as e:
            out.append(f"SYNTAX ERROR: {e}")
        return out

    def _run(self, program: str, out: list[str] | None = None) -> None:
        for name, e in self.parser.program(program):
            t = infer(e, self.types, {})
            v = evaluate(e, self.values, {})
            if name is not None:
                self.types[name], self.values[name] = Scheme(t), v
            if out is not None:
                shown = is_data(t)
                text = show(fetched(v) if shown else v) if shown else show_scheme(t)
                out.append(text if name is None else f"{name} {'=' if shown else ':'} {text}")

    def value(self, text: str) -> Any:
        """The value of one expression: a driver value, or a series whose ``df`` is its plan."""
        ((_, e),) = self.parser.program(text)
        infer(e, self.types, {})
        return evaluate(e, self.values, {})


def sources(spark: SparkSession) -> dict[str, tuple[str, Any]]:
    """Files and key-value tables as functions of the language."""
    from cairn.sources import files
    from cairn.sources.keyvalue import KeyValue

    def series(df: DataFrame, item) -> Series:
        # the order of a scan: files by name, lines by place
        return Series(df.select(F.monotonically_increasing_id().alias("_pos"), item.alias("item")), "item")

    def by_key(df: DataFrame, item) -> Series:
        return Series(df.select(F.col("k").alias("_pos"), item.alias("item")), "item")

    def pairs(df: DataFrame) -> Series:
        return by_key(df, F.struct(F.col("k").alias("_1"), F.col("v").alias("_2")))

    def kyoto(path: str) -> Rec:
        kv = KeyValue(spark, path)
        return Rec((
            ("keys", by_key(kv.keys(), F.col("k"))),
            ("pairs", pairs(kv.pairs())),
            ("values", lambda k: series(kv.get(k), F.col("v"))),
            ("pairs_with_prefix", lambda p: pairs(kv.pairs_with_prefix(p))),
            ("pairs_within_range", lambda low: lambda high: pairs(kv.pairs_within_range(low, high))),
        ))

    def kyoto_encoded_as(decode, shape, path: str) -> Rec:
        """The same with decoded values: none or one for each pair."""
        store, read = kyoto(path), decode(shape)
        each = lambda xs: map_(lambda p: map_(lambda v: (_part(p, 0), v), read(_part(p, 1))), xs)
        return Rec((
            ("keys", store.get("keys")),
            ("pairs", each(store.get("pairs"))),
            ("values", lambda k: flat_map(read, store.get("values")(k))),
            ("pairs_with_prefix", lambda p: each(store.get("pairs_with_prefix")(p))),
            ("pairs_within_range", lambda low: lambda high: each(store.get("pairs_within_range")(low)(high))),
        ))

    store = "{ keys: [String], pairs: [%s], values: String -> [%s], pairs_with_prefix: String -> [%s], pairs_within_range: String -> String -> [%s] }"
    of = lambda pair, v: store % (pair, v, pair, pair)
    return {
        "files": ("String -> [String]", lambda p: series(files.files(spark, p), F.col("path"))),
        "file_lines": ("String -> [String]", lambda p: series(files.file_lines(spark, p), F.col("value"))),
        "file_words": ("String -> [String]", lambda p: series(files.words(files.file_lines(spark, p)), F.col("word"))),
        "file_chunks": ("String -> [String]", lambda p: series(files.file_chunks(spark, p), F.decode("chunk", "UTF-8"))),
        "kyoto": (f"String -> {of('(String, String)', 'String')}", kyoto),
        "kyoto_encoded_as": (f"(s -> String -> [a]) -> s -> String -> {of('[(String, a)]', 'a')}", curry(3, kyoto_encoded_as)),
    }


def _part(pair, k: int):
    return pair[f"_{k + 1}"] if is_column(pair) else pair[k]


def fetched(v):
    """The first items of a series as values; other values as they are."""
    if isinstance(v, Series):
        rows = v.take(101).df.orderBy(v.pos).select(v.item).collect()
        return Seq(lambda: iter([from_spark(r[0]) for r in rows]))
    return v


def language_type(t: T.DataType) -> Type | None:
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType)):
        return INT
    if isinstance(t, T.StringType):
        return STRING
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, T.ArrayType):
        own = language_type(t.elementType)
        return None if own is None else list_of(own)
    if isinstance(t, T.StructType):
        if [f.name for f in t] == ["_1", "_2"]:
            a, b = language_type(t[0].dataType), language_type(t[1].dataType)
            return None if a is None or b is None else pair(a, b)
        out: Type = UNIT
        for f in t:
            own = language_type(f.dataType)
            if own is not None:
                out = Record(out, f.name, own)
        return out
    return None
