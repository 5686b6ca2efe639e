"""Time windows over integer instants, and the standard windows over timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling_id(t: Column, size: int, offset: int = 0) -> Column:
    """(t - offset) / size, truncated towards 0."""
    return _div(t - offset, size)


def _div(a: Column, n: int) -> Column:
    return F.call_function("div", a.cast("bigint"), F.lit(n).cast("bigint"))


def sliding_ids(t: Column, size: int, slide: int, offset: int = 0, mode: str = "reference") -> Column:
    """Ids k - shift for shifts 0..size/slide: one window more than hopping windows have.

    mode "standard" leaves the extra one out.
    """
    last = size // slide - (1 if mode == "standard" else 0)
    k = _div(t - offset, slide)
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint")), lambda s: k - s)


def tumbling(df: DataFrame, t: Column, size: int, *aggs: Column, offset: int = 0, name: str = "win_id") -> DataFrame:
    return df.groupBy(_div(t - offset, size).alias(name)).agg(*aggs)


def sliding(df: DataFrame, t: Column, size: int, slide: int, *aggs: Column, offset: int = 0, mode: str = "reference", name: str = "win_id") -> DataFrame:
    """Each row goes to all its windows; aggregates combine before the shuffle."""
    return df.withColumn(name, F.explode(sliding_ids(t, size, slide, offset, mode))).groupBy(name).agg(*aggs)


def session(df: DataFrame, key: str, ts: str, gap: str, *aggs: Column) -> DataFrame:
    """Sessions per key that end after a gap without rows."""
    return df.groupBy(key, F.session_window(ts, gap).alias("session")).agg(*aggs)
