"""The session's settings in one place."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "cairn", master: str | None = None, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session with adaptive plans, UTC, and maps whose last duplicate key wins.

    On a cluster leave master and shuffle_partitions to its own settings.
    """
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master).config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
