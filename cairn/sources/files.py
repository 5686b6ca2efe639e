"""Files as sources: paths, chunks, lines and words, read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of all regular files below path; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def file_chunks(spark: SparkSession, path: str, size: int = 1024) -> DataFrame:
    """(path, chunk number, bytes): pieces of size bytes, the last one shorter.

    A file is cut where it is read, a few thousand pieces at a time, so it isn't copied into each of them. A file is one
    row of the source and so at most 2 GB.
    """
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = memoryview(content.as_buffer())
                for first in range(0, len(data), 4096 * size):
                    cuts = range(first, min(first + 4096 * size, len(data)), size)
                    chunks = [bytes(data[k : k + size]) for k in cuts]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(chunks)), pa.array([k // size for k in cuts], pa.int64()), pa.array(chunks, pa.binary())], ["path", "chunk_no", "chunk"])

    return whole.mapInArrow(run, "path string, chunk_no long, chunk binary")


def file_split(spark: SparkSession, path: str, char: str) -> DataFrame:
    """Pieces between char, in order within a file; a trailing empty piece is dropped, inner ones stay."""
    return spark.read.option("recursiveFileLookup", True).text(path, lineSep=char).select(F.col("value"))


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    return file_split(spark, path, "\n")


def file_words(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between single spaces."""
    return file_split(spark, path, " ")


def words(lines: DataFrame, column: str = "value") -> DataFrame:
    """All [a-zA-Z]+ of each line."""
    from cairn.functions.arrays import string_words

    return lines.select(F.explode(string_words(F.col(column))).alias("word"))


def positions(spark: SparkSession, n: int, seed: int = 7, partitions: int | None = None) -> DataFrame:
    """Random room positions: visitors V002-V999, rooms R{0-3}.{0-4}, rising times in milliseconds."""
    base = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    visitor = F.format_string("V%03d", F.lit(2) + F.floor(F.rand(seed) * 998).cast("int"))
    room = F.concat(F.lit("R"), F.floor(F.rand(seed + 1) * 4).cast("string"), F.lit("."), F.floor(F.rand(seed + 2) * 5).cast("string"))
    return base.select(visitor.alias("visitor"), room.alias("room"), (F.lit(1_700_000_000_000) + F.col("id")).alias("timestamp"))
