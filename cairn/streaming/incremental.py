"""Continuous queries: monotonic streams and recomputed values, with sinks and restartable state.

A ``Producer`` is an append-only stream; ``reduce`` and ``group`` turn it into an ``Aggregate``, whose
whole current value is rewritten at each step. State and source positions live in Spark's checkpoint,
so a stopped query goes on where it was; sinks get the batch number and replace a batch that is replayed.
"""

from __future__ import annotations

import signal
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.sources.sinks import Batch, fan_out

Fn = Callable[[Column], Column]


@dataclass(frozen=True)
class Incremental:
    df: DataFrame
    mode: str
    sinks: tuple[Batch, ...] = field(default=())

    def log(self, *sinks: Batch):
        """Attaches sinks for each step's rows (or the whole value, for an aggregate)."""
        return replace(self, sinks=self.sinks + sinks)

    persist_view = log

    def _next(self, df: DataFrame, cls=None, mode: str | None = None):
        if self.sinks:
            raise ValueError("an operator after log() would silently drop the attached sink; attach sinks last")
        return (cls or type(self))(df, mode or self.mode)

    def start(self, checkpoint: str, available_now: bool = False, every: str = "1 second") -> StreamingQuery:
        writer = self.df.writeStream.outputMode(self.mode).option("checkpointLocation", checkpoint).foreachBatch(fan_out(*self.sinks))
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()

    def run(self, checkpoint: str, available_now: bool = True) -> None:
        """Runs to the end of what is available, or until interrupted: the step at hand is finished first."""
        query = self.start(checkpoint, available_now)
        old = {s: signal.signal(s, lambda *_: query.stop()) for s in (signal.SIGINT, signal.SIGTERM)}
        try:
            query.awaitTermination()
        finally:
            for s, handler in old.items():
                signal.signal(s, handler)


class Producer(Incremental):
    @staticmethod
    def of(df: DataFrame) -> Producer:
        return Producer(df, "append")

    @staticmethod
    def files(spark: SparkSession, path: str, schema: str, per_step: int = 1, fmt: str = "parquet") -> Producer:
        return Producer.of(spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_step).load(path))

    def map(self, *columns: Column) -> Producer:
        return self._next(self.df.select(*columns))

    def filter(self, p: Column) -> Producer:
        return self._next(self.df.where(p))

    def filter_map(self, value: Column, name: str) -> Producer:
        return self._next(self.df.select("*", value.alias(name)).where(F.col(name).isNotNull()))

    def flat_map(self, items: Column, name: str) -> Producer:
        return self._next(self.df.select(F.explode(items).alias(name)))

    def unnest(self, items: Column, name: str) -> Producer:
        return self._next(self.df.select("*", F.explode(items).alias(name)))

    def unique(self, item: str) -> Producer:
        return self._next(self.df.dropDuplicates([item]))

    def through(self, f: Callable[[DataFrame], DataFrame]) -> Producer:
        """Any of the stateful stream operators."""
        return self._next(f(self.df))

    def watermark(self, column: str, delay: str) -> Producer:
        return self._next(self.df.withWatermark(column, delay))

    def reduce(self, *aggs: Column) -> Aggregate:
        return self._next(self.df.groupBy().agg(*aggs), Aggregate, "complete")

    def group(self, keys: list, *aggs: Column) -> Aggregate:
        return self._next(self.df.groupBy(*keys).agg(*aggs), Aggregate, "complete")


class Aggregate(Incremental):
    """The view of an aggregate can be mapped, filtered, re-reduced or cut to its top."""

    def view(self, f: Callable[[DataFrame], DataFrame]) -> Aggregate:
        return _Viewed(self.df, self.mode, self.sinks, f)


@dataclass(frozen=True)
class _Viewed(Aggregate):
    """Applies f to the whole current value before the sinks see it."""

    f: Callable[[DataFrame], DataFrame] = lambda df: df

    def log(self, *sinks: Batch) -> _Viewed:
        view = self.f
        return replace(self, sinks=self.sinks + tuple((lambda s: lambda df, n: s(view(df), n))(s) for s in sinks))

    def view(self, f: Callable[[DataFrame], DataFrame]) -> _Viewed:
        old = self.f
        return replace(self, f=lambda df: f(old(df)))
