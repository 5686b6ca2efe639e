"""Schema-driven codecs: shapes to Spark types, strict JSON, a binary-safe text format, equality.

A shape is one of ``Int Float Bool String Unit``, ``ListOf(shape)``, ``TupleOf(shapes)``,
``RecordOf(fields)``, ``MapOf(value, key)`` or ``SumOf(cases)``. Decoding gives an array with the value, or an empty one for
text that is not JSON, has a wrong type or lacks a field: such rows vanish when it is exploded.
Extra fields are ignored, of fields with one name the first counts. Numbers and booleans may also be written as strings; field
names may be unquoted. Tuples are JSON arrays of exactly their arity; units are null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Shape:
    def data_type(self) -> T.DataType:
        raise NotImplementedError


@dataclass(frozen=True)
class Atom(Shape):
    name: str

    def data_type(self) -> T.DataType:
        return {"Int": T.LongType(), "Float": T.DoubleType(), "Bool": T.BooleanType(), "String": T.StringType(), "Unit": T.StringType()}[self.name]


Int, Float, Bool, String, Unit = (Atom(n) for n in ("Int", "Float", "Bool", "String", "Unit"))


@dataclass(frozen=True)
class ListOf(Shape):
    item: Shape

    def data_type(self) -> T.DataType:
        return T.ArrayType(self.item.data_type())


@dataclass(frozen=True)
class TupleOf(Shape):
    items: tuple[Shape, ...]

    def data_type(self) -> T.DataType:
        return T.StructType([T.StructField(f"_{k + 1}", s.data_type()) for k, s in enumerate(self.items)])


@dataclass(frozen=True)
class RecordOf(Shape):
    fields: tuple[tuple[str, Shape], ...]

    def data_type(self) -> T.DataType:
        return T.StructType([T.StructField(n, s.data_type()) for n, s in self.fields])


@dataclass(frozen=True)
class MapOf(Shape):
    """MapOf(value, key): from an object, or from a list of (key, value) pairs."""

    value: Shape
    key: Shape = String

    def data_type(self) -> T.DataType:
        return T.MapType(self.key.data_type(), self.value.data_type())


@dataclass(frozen=True)
class SumOf(Shape):
    """A tag with a payload column for each case."""

    cases: tuple[tuple[str, Shape], ...]

    def data_type(self) -> T.DataType:
        return T.StructType([T.StructField("tag", T.StringType())] + [T.StructField(n, s.data_type()) for n, s in self.cases])


def record(**fields: Shape) -> RecordOf:
    return RecordOf(tuple(fields.items()))


def tuple_of(*items: Shape) -> TupleOf:
    return TupleOf(items)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


_STRING = r'"(?:[^"\\]|\\.)*+"'
#: What stands before a bare field name, from the end of the last match on, and the name with its colon.
_BARE = rf'\G((?:{_STRING}|[A-Za-z_][A-Za-z0-9_]*+(?!\s*+:)|[0-9.+-][0-9.eE+-]*+|[^"A-Za-z_])*+)([A-Za-z_][A-Za-z0-9_]*+)\s*+:'
#: A value that neither has fields nor ends one: of a list only if nothing in it has fields.
_PLAIN = rf'(?:{_STRING}(?!:)|[^"{{}}\[\],]++|\{{\}}|\[(?:{_STRING}(?!:)|\{{\}}|[^"{{}}\[\]])*+\])'
#: A field's name with the comma before it and a plain value after it, other plain values, and single signs.
_PIECE = rf'(?s),?+{_STRING}:{_PLAIN}*+|{_PLAIN}++|.'
_NAMED = rf'^,?+({_STRING}):'


def _repaired(text: Column) -> Column:
    """text with bare field names quoted, and of fields with one name only the first; without white space.

    Only outside of strings. Pieces are gone through in order: ``path`` has the number of each open object or list, a name is
    the text of its object's number and the name, ``skip`` is the depth at which a repeated field is being left out, and
    ``cut`` has the pieces that are left out.
    """
    dense = F.regexp_replace(F.regexp_replace(text, _BARE, r'$1"$2":'), rf"({_STRING})|\s++", "$1")

    def step(s: Column, x: Column) -> Column:
        piece, depth = x["piece"], F.size(s["path"])
        opens, closes = piece.isin("{", "["), piece.isin("}", "]")
        # a left-out field ends at the comma or the bracket of its own object
        free = (s["skip"] < 0) | ((depth == s["skip"]) & (closes | piece.startswith(",")))
        name = F.when((x["name"] != "") & free, F.concat(F.coalesce(F.try_element_at(s["path"], F.lit(-1)), F.lit(0)).cast("string"), F.lit("/"), x["name"]))

        def of(y: Column) -> Column:
            repeated = F.array_contains(s["names"], y["name"])
            return F.struct(
                F.when(~y["free"] | F.coalesce(repeated, F.lit(False)), F.array_append(s["cut"], x["at"])).otherwise(s["cut"]).alias("cut"),
                F.when(opens, F.array_append(s["path"], s["next"])).when(closes & (depth > 0), F.slice(s["path"], 1, depth - 1)).otherwise(s["path"]).alias("path"),
                F.when(opens, s["next"] + 1).otherwise(s["next"]).alias("next"),
                F.when(~repeated, F.array_append(s["names"], y["name"])).otherwise(s["names"]).alias("names"),
                F.when(repeated, depth).when(y["free"], F.lit(-1)).otherwise(s["skip"]).alias("skip"),
            )

        return _let(F.struct(free.alias("free"), name.alias("name")), of)

    start = F.struct(F.array().cast("array<int>").alias("cut"), F.array().cast("array<int>").alias("path"), F.lit(1).alias("next"), F.array().cast("array<string>").alias("names"), F.lit(-1).alias("skip"))

    def of(pieces: Column) -> Column:
        placed = F.transform(pieces, lambda p, i: F.struct(p.alias("piece"), i.alias("at"), F.regexp_extract(p, _NAMED, 1).alias("name")))
        return F.aggregate(placed, start, step, lambda s: F.array_join(F.filter(pieces, lambda _, i: ~F.array_contains(s["cut"], i)), ""))

    return _let(F.regexp_extract_all(dense, F.lit(_PIECE), F.lit(0)), of)


def _parse(text: Column) -> Column:
    """A variant; a text that plain parsing refuses is repaired and tried again."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(_repaired(text)))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _get(v: Column, path: str, type_: str = "variant") -> Column:
    return F.try_variant_get(v, path, type_)


def _atom(v: Column, shape: Atom) -> Column:
    """The value, or null if v is not of this type."""

    def of(x: Column) -> Column:
        kind, text = x["kind"], x["text"]
        if shape.name == "String":
            return F.when(kind == "STRING", text)
        if shape.name == "Int":
            return F.when((kind == "BIGINT") | ((kind == "STRING") & text.rlike(r"^[+-]?[0-9]+$")), text.try_cast("bigint"))
        if shape.name == "Float":
            return F.when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "BIGINT", "STRING"), text.try_cast("double"))
        return F.when((kind == "BOOLEAN") | ((kind == "STRING") & text.isin("true", "false")), text.try_cast("boolean"))

    return _let(F.struct(_kind(v).alias("kind"), _get(v, "$", "string").alias("text")), of)


def _decode(v: Column, shape: Shape) -> Column:
    """An array: the decoded value, or nothing."""
    none = F.array().cast(T.ArrayType(shape.data_type()))
    if isinstance(shape, Atom):
        if shape.name == "Unit":
            return F.when(F.is_variant_null(v), F.array(F.lit(None).cast("string"))).otherwise(none)
        return F.filter(F.array(_atom(v, shape)), lambda x: x.isNotNull())
    if isinstance(shape, ListOf):
        items = _get(v, "$", "array<variant>")
        got = F.transform(items, lambda x: _decode(x, shape.item))
        return _let(got, lambda g: F.when(g.isNotNull() & F.forall(g, lambda x: F.size(x) == 1), F.array(F.flatten(g))).otherwise(none))
    if isinstance(shape, TupleOf):
        return _let(_get(v, "$", "array<variant>"), lambda items: _all(items.isNotNull() & (F.size(items) == len(shape.items)), [_decode(F.get(items, F.lit(k)), s) for k, s in enumerate(shape.items)], [f"_{k + 1}" for k in range(len(shape.items))], none))
    if isinstance(shape, RecordOf):
        return _all(_kind(v).startswith("OBJECT"), [_decode(_get(v, f"$['{n}']"), s) for n, s in shape.fields], [n for n, _ in shape.fields], none)
    if isinstance(shape, MapOf):
        entry = F.struct
        from_object = F.transform(F.map_entries(_get(v, "$", "map<string,variant>")), lambda e: entry(F.filter(F.array(e["key"].try_cast(shape.key.data_type())), lambda k: k.isNotNull()).alias("k"), _decode(e["value"], shape.value).alias("g")))
        # or a list of pairs; of equal keys the first counts
        from_list = F.transform(_get(v, "$", "array<variant>"), lambda e: entry(_decode(_get(e, "$[0]"), shape.key).alias("k"), _decode(_get(e, "$[1]"), shape.value).alias("g")))

        def of(got: Column) -> Column:
            ok = got.isNotNull() & F.forall(got, lambda e: (F.size(e["k"]) == 1) & (F.size(e["g"]) == 1))
            pairs = F.transform(got, lambda e: F.struct(F.get(e["k"], F.lit(0)).alias("key"), F.get(e["g"], F.lit(0)).alias("value")))
            keys = F.transform(pairs, lambda p: p["key"])
            first = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
            return F.when(ok, F.array(F.map_from_entries(first))).otherwise(none)

        return _let(F.when(_kind(v).startswith("OBJECT"), from_object).otherwise(from_list), of)
    if isinstance(shape, SumOf):
        # ["Tag", payload]
        tag = _get(v, "$[0]", "string")
        out = none
        for name, s in shape.cases:
            out = F.when(tag == name, _let(_decode(_get(v, "$[1]"), s), _case(shape, name, tag, none))).otherwise(out)
        return out
    raise TypeError(shape)


def _case(shape: SumOf, name: str, tag: Column, none: Column):
    """The payload's array to an array of the tagged value."""

    def of(got: Column) -> Column:
        payloads = [(F.get(got, F.lit(0)) if n == name else F.lit(None).cast(q.data_type())).alias(n) for n, q in shape.cases]
        return F.when(F.size(got) == 1, F.array(F.struct(tag.alias("tag"), *payloads))).otherwise(none)

    return of


def _all(ok: Column, parts: list[Column], names: list[str], none: Column) -> Column:
    """The record of all parts (each computed once), if every one is there."""
    if not parts:
        return F.when(ok, F.array(F.struct())).otherwise(none)

    def of(x: Column) -> Column:
        good = ok
        for n in names:
            good = good & (F.size(x[n]) == 1)
        return F.when(good, F.array(F.struct(*[F.get(x[n], F.lit(0)).alias(n) for n in names]))).otherwise(none)

    return _let(F.struct(*[p.alias(n) for p, n in zip(parts, names)]), of)


def json_decode(shape: Shape, text: Column) -> Column:
    """An array with the decoded value, empty if the text doesn't have the shape. The text is parsed once."""
    none = F.array().cast(T.ArrayType(shape.data_type()))
    return _let(_parse(text), lambda v: F.when(v.isNotNull(), _decode(v, shape)).otherwise(none))


def json_encode(shape: Shape, value: Column) -> Column:
    """JSON text; tuples as arrays, units as null."""
    if isinstance(shape, Atom):
        if shape.name == "Unit":
            return F.lit("null")
        if shape.name == "String":
            # the text of a one-field object without its frame
            return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
        return value.cast("string")
    if isinstance(shape, ListOf):
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_encode(shape.item, x)), ","), F.lit("]"))
    if isinstance(shape, TupleOf):
        return F.concat(F.lit("["), F.concat_ws(",", *[json_encode(s, value[f"_{k + 1}"]) for k, s in enumerate(shape.items)]), F.lit("]"))
    if isinstance(shape, RecordOf):
        return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), json_encode(s, value[n])) for n, s in shape.fields]), F.lit("}"))
    if isinstance(shape, MapOf):
        entry = lambda e: F.concat(json_encode(String, e["key"].cast("string")), F.lit(":"), json_encode(shape.value, e["value"]))
        return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(value), entry), ","), F.lit("}"))
    if isinstance(shape, SumOf):
        out = F.lit(None).cast("string")
        for n, s in shape.cases:
            out = F.when(value["tag"] == n, F.concat(F.lit(f'["{n}",'), json_encode(s, value[n]), F.lit("]"))).otherwise(out)
        return out
    raise TypeError(shape)


def marshal_encode(shape: Shape, value: Column) -> Column:
    """Binary: JSON of the shape, base64. Only the round trip is promised."""
    return F.base64(F.encode(json_encode(shape, value), "UTF-8"))


def marshal_decode(shape: Shape, data: Column) -> Column:
    return json_decode(shape, F.decode(F.unbase64(data), "UTF-8"))


@dataclass(frozen=True)
class Encoding:
    """A named pair of codec functions."""

    name: str
    encode: object
    decode: object


def encoding(fmt: str, shape: Shape) -> Encoding:
    enc, dec = {"json": (json_encode, json_decode), "marshal": (marshal_encode, marshal_decode)}[fmt]
    return Encoding(fmt, lambda c: enc(shape, c), lambda c: dec(shape, c))


NO_ENCODING = Encoding("none", lambda c: c, lambda c: F.array(c))


def structural_equal(shape: Shape, a: Column, b: Column) -> Column:
    """Equality by shape; maps by their sorted entries. Doubles: NaN equals no value, itself included."""
    if isinstance(shape, MapOf):
        order = lambda m: F.array_sort(F.map_entries(m))
        return order(a).eqNullSafe(order(b))
    if isinstance(shape, Atom) and shape.name == "Float":
        return (a == b) & ~F.isnan(a)
    if isinstance(shape, (RecordOf, TupleOf)):
        names = [n for n, _ in shape.fields] if isinstance(shape, RecordOf) else [f"_{k + 1}" for k in range(len(shape.items))]
        shapes = [s for _, s in shape.fields] if isinstance(shape, RecordOf) else shape.items
        out = F.lit(True)
        for n, s in zip(names, shapes):
            out = out & structural_equal(s, a[n], b[n])
        return out
    return a.eqNullSafe(b)


def parse_shape(text: str) -> Shape:
    """``Int``, ``[T]``, ``(T, U)``, ``{f: T, g: U}``."""
    tokens = re.findall(r"[A-Za-z_][A-Za-z0-9_]*|[\[\](){}:,]", text)
    at = 0

    def take(want: str | None = None) -> str:
        nonlocal at
        t = tokens[at] if at < len(tokens) else ""
        if want is not None and t != want:
            raise ValueError(f"expected {want} in shape {text!r}")
        at += 1
        return t

    def one() -> Shape:
        t = take()
        if t == "[":
            s = one()
            take("]")
            return ListOf(s)
        if t == "(":
            if tokens[at] == ")":
                take()
                return Unit
            items = [one()]
            while take() == ",":
                items.append(one())
            return items[0] if len(items) == 1 else TupleOf(tuple(items))
        if t == "{":
            fields = []
            while tokens[at] != "}":
                n = take()
                take(":")
                fields.append((n, one()))
                if tokens[at] == ",":
                    take()
            take("}")
            return RecordOf(tuple(fields))
        return Atom(t)

    return one()


def key_paths(shape: Shape, value: Column, prefix: tuple[str, ...] = ()) -> Column:
    """A value as rows of a hierarchical store: an array of (path, value) with text values."""
    if isinstance(shape, RecordOf):
        return F.concat(*[key_paths(s, value[n], (*prefix, n)) for n, s in shape.fields])
    if isinstance(shape, TupleOf):
        return F.concat(*[key_paths(s, value[f"_{k + 1}"], (*prefix, str(k))) for k, s in enumerate(shape.items)])
    at = F.array(*[F.lit(p) for p in prefix]).cast("array<string>")
    if isinstance(shape, ListOf):
        each = F.flatten(F.transform(value, lambda x, i: F.transform(key_paths(shape.item, x), lambda e: F.struct(F.concat(F.array(i.cast("string")), e["path"]).alias("path"), e["value"].alias("value")))))
        return F.transform(each, lambda e: F.struct(F.concat(at, e["path"]).alias("path"), e["value"].alias("value")))
    if isinstance(shape, MapOf):
        each = F.flatten(F.transform(F.map_entries(value), lambda m: F.transform(key_paths(shape.value, m["value"]), lambda e: F.struct(F.concat(F.array(m["key"].cast("string")), e["path"]).alias("path"), e["value"].alias("value")))))
        return F.transform(each, lambda e: F.struct(F.concat(at, e["path"]).alias("path"), e["value"].alias("value")))
    return F.array(F.struct(at.alias("path"), json_encode(shape, value).alias("value")))
