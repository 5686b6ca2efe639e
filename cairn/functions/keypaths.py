"""Paths of a hierarchical key-value store, as array columns and as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def root() -> Column:
    return F.array().cast("array<string>")


def add_suffix(path: Column, suffix: Column) -> Column:
    return F.array_append(path, suffix.cast("string"))


def first_index(path: Column) -> Column:
    """The path of a list's first item."""
    return add_suffix(path, F.lit("0"))


def next_index(path: Column) -> Column:
    """The path of the item after a list's item; null if the last part is no number."""
    following = (F.element_at(path, -1).try_cast("bigint") + 1).cast("string")
    return F.when(following.isNotNull(), F.array_append(F.slice(path, F.lit(1), F.size(path) - 1), following))


def extract_suffix(prefix: Column, path: Column) -> Column:
    """What follows prefix in path; null if path isn't below it."""
    below = F.slice(path, F.lit(1), F.size(prefix)).eqNullSafe(prefix)
    return F.when(below, F.slice(path, F.size(prefix) + 1, F.greatest(F.size(path) - F.size(prefix), F.lit(0))))


def focus(pairs, prefix: str):
    """The (k, v) rows below prefix, with the rest of their keys."""
    start = prefix.rstrip("/") + "/"
    return pairs.where(F.col("k").startswith(start)).select(F.substring("k", len(start) + 1, 1 << 30).alias("k"), "v")
