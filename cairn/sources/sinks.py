"""Sinks for streams and batches: logs, views, keyed topics, and routing by resource name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Batch = Callable[[DataFrame, int], None]


def console_logger(column: str) -> Batch:
    """Prints the items of each batch, a line each."""

    def write(df: DataFrame, _: int) -> None:
        for r in df.select(F.col(column).cast("string")).toLocalIterator():
            print(r[0])

    return write


def file_logger(path: str, column: str) -> Batch:
    """Appends lines. A batch has a directory of its own, so a replayed batch replaces its first try."""

    def write(df: DataFrame, batch: int) -> None:
        df.select(F.col(column).cast("string")).write.mode("overwrite").text(f"{path}/batch={batch}")

    return write


def file_view(path: str) -> Batch:
    """The current value only: written beside the old one, which then goes."""

    def write(df: DataFrame, batch: int) -> None:
        from cairn.sources.keyvalue import KeyValue

        KeyValue(df.sparkSession, path).write(df.select(F.col(df.columns[0]).cast("string").alias("k"), F.to_json(F.struct("*")).alias("v")))

    return write


def topic_logger(path: str, key: Column | None = None, partitions: int = 3, column: str = "value") -> Batch:
    """A topic as a folder of partitions, each batch a file: by key's hash, else dealt in turn."""

    def write(df: DataFrame, batch: int) -> None:
        part = F.pmod(F.xxhash64(key), F.lit(partitions)) if key is not None else F.pmod(F.monotonically_increasing_id(), F.lit(partitions))
        rows = df.select(F.col(column).cast("string").alias("value"), part.cast("int").alias("partition"), F.lit(batch).alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "partition").parquet(path)

    return write


def kafka_options(servers: str, topic: str, partition: int | None = None, per_trigger: int = 16384, start: str = "earliest") -> dict[str, str]:
    """Options for Spark's Kafka source; its jar must be on the class path."""
    out = {"kafka.bootstrap.servers": servers, "maxOffsetsPerTrigger": str(per_trigger), "startingOffsets": start}
    return out | ({"subscribe": topic} if partition is None else {"assign": f'{{"{topic}":[{partition}]}}'})


def kafka_stream(spark: SparkSession, servers: str, topic: str, partition: int | None = None, per_trigger: int = 16384, start: str = "earliest") -> DataFrame:
    """A topic as a stream of (key, value, partition, offset); a restarted query goes on behind the last offset of its checkpoint.

    A step takes what has come since the last one, at most per_trigger messages.
    """
    rows = spark.readStream.format("kafka").options(**kafka_options(servers, topic, partition, per_trigger, start)).load()
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "partition", "offset")


def kafka_sink(servers: str, topic: str, value: Column, key: Column | None = None, partition: int | None = None) -> Batch:
    """Appends each batch to a topic: to a partition, by key, or in turn."""

    def write(df: DataFrame, _: int) -> None:
        rows = kafka_rows(df, value, key)
        rows = rows if partition is None else rows.withColumn("partition", F.lit(partition))
        rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return write


def topic_stream(spark: SparkSession, path: str, partition: int | None = None, per_trigger: int = 1000) -> DataFrame:
    """A folder topic (see topic_logger) as a stream of (value, partition, batch); restarts go on behind the checkpoint."""
    rows = spark.readStream.schema("value string, batch int, partition int").option("maxFilesPerTrigger", per_trigger).parquet(path)
    return rows if partition is None else rows.where(F.col("partition") == partition)


def kafka_rows(df: DataFrame, value: Column, key: Column | None = None) -> DataFrame:
    """Rows for Spark's Kafka sink; with a key its partitioner deals them."""
    return df.select(*([key.cast("string").alias("key")] if key is not None else []), value.cast("string").alias("value"))


def fan_out(*sinks: Batch) -> Batch:
    """Several sinks for one stream: the batch is computed once."""

    def write(df: DataFrame, batch: int) -> None:
        held = df.persist()
        try:
            for sink in sinks:
                sink(held, batch)
        finally:
            held.unpersist()

    return write


def routed(routes: dict[str, Batch], resource: str = "resource") -> Batch:
    """Sends rows to the sink of their resource; ``*`` takes what no other route does."""

    def write(df: DataFrame, batch: int) -> None:
        named = [r for r in routes if r != "*"]
        for name in named:
            routes[name](df.where(F.col(resource) == name), batch)
        if "*" in routes:
            routes["*"](df.where(~F.col(resource).isin(named)) if named else df, batch)

    return write


def publisher(send: Callable[[str], None], column: str) -> Batch:
    """Hands each item of a batch to send, in the order of the batch: the hook for pushing to subscribers."""

    def write(df: DataFrame, _: int) -> None:
        for r in df.select(F.col(column).cast("string")).toLocalIterator():
            send(r[0])

    return write
