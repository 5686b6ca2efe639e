"""States that outlive a process: loaded before a fold goes on, saved after each step.

A store has load() and save(state). Stores combine as the folds they belong to do: two states as a pair, several as a list, or
one of them as the state of both.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairn.sources.keyvalue import KeyValue


@dataclass(frozen=True)
class Store:
    load: Callable[[], Any]
    save: Callable[[Any], None]

    def project(self, to: Callable[[Any], Any], back: Callable[[Any], Any]) -> Store:
        """The same store for another form of the state."""
        return Store(lambda: to(self.load()), lambda s: self.save(back(s)))


def unit(state: Any = None) -> Store:
    """Keeps nothing: always the same state."""
    return Store(lambda: state, lambda _: None)


def file_store(spark: SparkSession, path: str, default: Any, encode: Callable[[Any], str] = json.dumps, decode: Callable[[str], Any] = json.loads) -> Store:
    """A snapshot file, on any file system Spark can reach; the default where there is none.

    A state is written beside the old one and then renamed, so that one of them is whole at any time.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda end="": jvm.org.apache.hadoop.fs.Path(path + end)
    fs = at().getFileSystem(conf)

    def read(where) -> str:
        stream = fs.open(where)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def load() -> Any:
        # between the removal of the old file and the renaming only the new one is there
        for where in (at(), at(".next")):
            if fs.exists(where):
                return decode(read(where))
        return default

    def save(state: Any) -> None:
        out = fs.create(at(".writing"), True)
        out.write(bytearray(encode(state).encode()))
        out.close()
        fs.delete(at(".next"), False)
        fs.rename(at(".writing"), at(".next"))
        fs.delete(at(), False)
        fs.rename(at(".next"), at())

    return Store(load, save)


def key_store(table: KeyValue, key: str, default: Any, encode: Callable[[Any], str] = json.dumps, decode: Callable[[str], Any] = json.loads) -> Store:
    """One key of a key-value table of texts."""

    def load() -> Any:
        row = table.get(key).first()
        return default if row is None else decode(row[0])

    def save(state: Any) -> None:
        table.update(table.spark.range(1).select(F.lit(key).alias("k"), F.lit(encode(state)).alias("v"), F.lit(False).alias("removed")))

    return Store(load, save)


def product(a: Store, b: Store) -> Store:
    """A pair of states, each in a store of its own."""

    def save(state: tuple) -> None:
        a.save(state[0])
        b.save(state[1])

    return Store(lambda: (a.load(), b.load()), save)


def combine(*stores: Store) -> Store:
    """A list of states."""

    def save(states: list) -> None:
        for store, state in zip(stores, states, strict=True):
            store.save(state)

    return Store(lambda: [s.load() for s in stores], save)


def both(kept: Store, copy: Store) -> Store:
    """One state in two stores, read from the first."""

    def save(state: Any) -> None:
        kept.save(state)
        copy.save(state)

    return Store(kept.load, save)
