"""Changelog group-by: per input, the removal of a key's old value and the insertion of its new one.

A key is stored once its state first differs from the seed. A change of state emits remove(old)
unless the key is new, then insert(new); an unchanged state emits nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def group_updates(df: DataFrame, key: str, pos: str, running: Callable[[], Column], seed: Column | None = None) -> DataFrame:
    """Batch form: (pos, step, key, sign, value); running() is an aggregate of a row's columns.

    One window per key; the keys are dealt to tasks and each key's rows are read in order.
    """
    w = Window.partitionBy(key).orderBy(pos)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    boxed = F.struct(running().over(upto).alias("v"))
    zero = F.struct((seed if seed is not None else F.lit(None)).alias("v"))
    rows = df.withColumn("_new", boxed).withColumn("_seed", zero)
    rows = rows.withColumn("_new", F.col("_new").cast(rows.schema["_new"].dataType))
    kind = rows.schema["_new"].dataType
    rows = rows.withColumn("_seed", F.col("_seed").cast(kind))
    rows = rows.withColumn("_old", F.coalesce(F.lag("_new").over(w), F.col("_seed")))
    rows = rows.withColumn("_stored", F.coalesce(F.bool_or(~F.col("_new").eqNullSafe(F.col("_seed"))).over(before), F.lit(False)))
    changed = rows.where(~F.col("_new").eqNullSafe(F.col("_old")))
    gone = F.struct(F.lit(0).alias("step"), F.lit(-1).alias("sign"), F.col("_old")["v"].alias("value"))
    come = F.struct(F.lit(1).alias("step"), F.lit(1).alias("sign"), F.col("_new")["v"].alias("value"))
    moves = F.when(F.col("_stored"), F.array(gone, come)).otherwise(F.array(come))
    out = changed.select(F.col(pos).alias("pos"), F.col(key).alias("key"), F.explode(moves).alias("m"))
    return out.select("pos", F.col("m")["step"].alias("step"), "key", F.col("m")["sign"].alias("sign"), F.col("m")["value"].alias("value"))


def running_counts(moves: DataFrame) -> DataFrame:
    """Consumes moves in order: the count of each value after each of its moves.

    A value's moves are dealt to ranges of positions, so a frequent value is the work of many tasks; what a
    value's ranges before come to (a row for each value and range) is added.
    """
    from cairn.operators.series import PART, Series

    rows = Series(moves.select("pos", "step", "key", "value", "sign"), "sign", "pos")._ranged()
    own = Window.partitionBy("value", PART).orderBy("pos", "step", "key").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("value").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("value", PART).agg(F.sum("sign").alias("_sum")).select(F.col("value").alias("_value"), F.col(PART).alias("_range"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    counted = rows.withColumn("_own", F.sum("sign").over(own))
    joined = counted.join(base, F.col("value").eqNullSafe(F.col("_value")) & (F.col(PART) == F.col("_range")))
    return joined.select("pos", "step", "value", (F.col("_own") + F.col("_base")).alias("count"))


def stateful(
    stream: DataFrame,
    keys: list[str],
    order: str,
    seed: Any,
    step: Callable[[Any, Any], tuple[Any, list[tuple]]],
    schema: str,
) -> DataFrame:
    """A keyed stateful flat map for streams: step(state, row) -> (state, rows of schema).

    A key's rows of a batch are put in order first, since a shuffle doesn't keep it. State is pickled.
    Without keys the whole stream is one series and one task, as its order demands.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    rows = stream if keys else stream.withColumn("_all", F.lit(0))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else seed
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        out = []
        for row in pdf.itertuples(index=False):
            held, made = step(held, row)
            out += made
        state.update((pickle.dumps(held),))
        yield pd.DataFrame(out, columns=names)

    return rows.groupBy(*(keys or ["_all"])).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def stream_group_updates(stream: DataFrame, key: str, order: str, seed: Any, push: Callable[[Any, Any], Any], view: Callable[[Any], Any], key_type: str, value_type: str) -> DataFrame:
    """Streaming form of group_updates: (pos, step, key, sign, value)."""

    def step(state: tuple[bool, Any], row) -> tuple[tuple[bool, Any], list[tuple]]:
        stored, acc = state
        new = push(acc, row)
        if new == acc:
            return (stored, acc), []
        k, p = getattr(row, key), getattr(row, order)
        moves = [(p, 0, k, -1, view(acc))] if stored else []
        return (True, new), [*moves, (p, 1, k, 1, view(new))]

    pos_type = stream.schema[order].dataType.simpleString()
    return stateful(stream, [key], order, (False, seed), step, f"pos {pos_type}, step int, key {key_type}, sign int, value {value_type}")


# -- the ordered-series operators on streams --------------------------------------------


def take(stream: DataFrame, order: str, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    width = len(stream.columns)
    return stateful(stream, list(keys), order, 0, lambda s, r: (s + 1, [tuple(r)[:width]] if s < n else []), _same(stream))


def drop(stream: DataFrame, order: str, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    width = len(stream.columns)
    return stateful(stream, list(keys), order, 0, lambda s, r: (s + 1, [tuple(r)[:width]] if s >= n else []), _same(stream))


def take_while(stream: DataFrame, order: str, p: Callable[[Any], bool], keys: tuple[str, ...] = ()) -> DataFrame:
    width = len(stream.columns)
    def step(going: bool, r):
        going = going and p(r)
        return going, [tuple(r)[:width]] if going else []

    return stateful(stream, list(keys), order, True, step, _same(stream))


def drop_while(stream: DataFrame, order: str, p: Callable[[Any], bool], keys: tuple[str, ...] = ()) -> DataFrame:
    width = len(stream.columns)
    def step(dropping: bool, r):
        dropping = dropping and p(r)
        return dropping, [] if dropping else [tuple(r)[:width]]

    return stateful(stream, list(keys), order, True, step, _same(stream))


def dedupe(stream: DataFrame, order: str, item: str, keys: tuple[str, ...] = ()) -> DataFrame:
    width = len(stream.columns)
    def step(s, r):
        x = getattr(r, item)
        return (x,), [] if s == (x,) else [tuple(r)[:width]]

    return stateful(stream, list(keys), order, None, step, _same(stream))


def unique(stream: DataFrame, item: str) -> DataFrame:
    """First occurrences: Spark's own streaming deduplication, keyed by the item."""
    return stream.dropDuplicates([item])


def rolling(stream: DataFrame, order: str, seed: Any, push: Callable[[Any, Any], Any], out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The running fold beside each row; out is 'name type'."""
    width = len(stream.columns)

    def step(s, r):
        s = push(s, r)
        return s, [(*tuple(r)[:width], s)]

    return stateful(stream, list(keys), order, seed, step, f"{_same(stream)}, {out}")


def interpose(stream: DataFrame, order: str, item: str, separator: Any, keys: tuple[str, ...] = ()) -> DataFrame:
    """(order, step, item): the separator between neighbours."""
    kinds = stream.schema

    def step(started: bool, r):
        p, x = getattr(r, order), getattr(r, item)
        return True, ([(p, 0, separator)] if started else []) + [(p, 1, x)]

    return stateful(stream, list(keys), order, False, step, f"{order} {kinds[order].dataType.simpleString()}, step int, {item} {kinds[item].dataType.simpleString()}")


def _same(stream: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
