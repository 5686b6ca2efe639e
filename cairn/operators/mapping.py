"""Mappings: unique keys to values, as a keyed DataFrame, with staged changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Mapping:
    """A keyed table with an overlay of staged changes (key, value, removed)."""

    def __init__(self, df: DataFrame, key: str = "key", value: str = "value", changes: DataFrame | None = None):
        self.df, self.key, self.value, self.changes = df, key, value, changes

    @staticmethod
    def of_pairs(df: DataFrame, key: str, value: str, pos: str) -> Mapping:
        """The last value of each key, in the order of pos."""
        return Mapping(df.groupBy(key).agg(F.max_by(F.struct(value), pos)[value].alias(value)), key, value)

    @staticmethod
    def empty(spark, key_type: str, value_type: str) -> Mapping:
        return Mapping(spark.createDataFrame([], f"key {key_type}, value {value_type}"))

    # -- lookups through the overlay: removed, then replaced, then the source ---------
    def current(self) -> DataFrame:
        if self.changes is None:
            return self.df.select(self.key, self.value)
        kept = _without(self.df.select(self.key, self.value), self.changes, self.key)
        return kept.unionByName(self.changes.where(~F.col("removed")).select(self.key, self.value))

    def pairs(self) -> DataFrame:
        return self.current()

    def keys(self) -> DataFrame:
        return self.current().select(self.key)

    def values(self) -> DataFrame:
        return self.current().select(self.value)

    def get(self, key) -> DataFrame:
        """No row or one; the predicate reaches the scan."""
        return self.current().where(F.col(self.key) == F.lit(key)).select(self.value)

    def project(self, f: Callable[[Column], Column]) -> Mapping:
        return Mapping(self.current().withColumn(self.value, f(F.col(self.value))), self.key, self.value)

    # -- staged changes ------------------------------------------------------------
    def _stage(self, changes: DataFrame) -> Mapping:
        new = changes.select(self.key, self.value, "removed")
        if self.changes is not None:
            new = _without(self.changes, new, self.key).unionByName(new)
        return Mapping(self.df, self.key, self.value, new)

    def replace(self, pairs: DataFrame) -> Mapping:
        return self._stage(pairs.select(self.key, self.value).withColumn("removed", F.lit(False)))

    def remove(self, keys: DataFrame) -> Mapping:
        kind = self.df.schema[self.value].dataType
        return self._stage(keys.select(self.key).withColumn(self.value, F.lit(None).cast(kind)).withColumn("removed", F.lit(True)))

    def update_with(self, other: DataFrame, merge: Callable[[Column, Column], Column]) -> Mapping:
        """Sets each key of other to merge(old, new), or to new where the key is new."""
        old = self.current().select(F.col(self.key).alias("_k"), F.struct(F.col(self.value).alias("v")).alias("_old"))
        joined = other.select(self.key, self.value).join(old, F.col(self.key).eqNullSafe(F.col("_k")), "left")
        merged = F.when(F.col("_old").isNull(), F.col(self.value)).otherwise(merge(F.col("_old")["v"], F.col(self.value)))
        return self._stage(joined.select(self.key, merged.alias(self.value), F.lit(False).alias("removed")))

    def updates(self) -> DataFrame | None:
        return self.changes

    def apply_updates(self, changes: DataFrame) -> Mapping:
        return self._stage(changes)

    def commit_updates(self) -> Mapping:
        return Mapping(self.current(), self.key, self.value)

    def rollback_updates(self) -> Mapping:
        return Mapping(self.df, self.key, self.value)

    def equal(self, other: Mapping, same: Callable[[Column, Column], Column] = lambda a, b: a.eqNullSafe(b)) -> DataFrame:
        """An outer group join: every key on both sides with equal values."""
        a = self.current().select(F.col(self.key).alias("_ka"), F.struct(F.col(self.value).alias("v")).alias("_a"))
        b = other.current().select(F.col(other.key).alias("_kb"), F.struct(F.col(other.value).alias("v")).alias("_b"))
        both = a.join(b, F.col("_ka").eqNullSafe(F.col("_kb")), "full_outer")
        ok = F.col("_a").isNotNull() & F.col("_b").isNotNull() & same(F.col("_a")["v"], F.col("_b")["v"])
        return both.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("equal"))


def _without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't among gone's; a null key equals a null key."""
    return rows.join(gone.select(F.col(key).alias("_gone")), F.col(key).eqNullSafe(F.col("_gone")), "left_anti")


def cogroup(left: DataFrame, right: DataFrame, key: str, left_agg: Column, right_agg: Column, left_zero: Column, right_zero: Column) -> DataFrame:
    """A full outer group join: both sides are aggregated before they meet.

    left_agg and right_agg are aliased aggregates; zeros fill the missing side.
    """
    a, b = left.groupBy(key).agg(left_agg), right.groupBy(key).agg(right_agg)
    ln, rn = a.columns[1], b.columns[1]
    b = b.withColumnRenamed(key, "_other")
    # a key's aggregate is never null as a whole, so a side that is missing is told by its marker
    joined = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), F.col(key).eqNullSafe(F.col("_other")), "full_outer")
    return joined.select(F.when(F.col("_a").isNotNull(), F.col(key)).otherwise(F.col("_other")).alias(key), F.coalesce(F.col(ln), left_zero).alias(ln), F.coalesce(F.col(rn), right_zero).alias(rn))
