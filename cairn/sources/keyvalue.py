"""A persistent key-value table: sorted Parquet with point, prefix and range reads, and atomic updates.

Keys are dealt to BUCKETS by hash; a bucket's rows are sorted by key, so that reads by key, prefix and range skip
row groups by their statistics. Each version is a directory below the table's path with the buckets that it
changed; an update rewrites only the buckets of its keys. A version's ``_buckets`` file, written last, says which version holds
each bucket, so readers see one version or the other. It also has the number of the stream's batch
that the version includes: a batch that is replayed changes nothing. Range bounds are both included.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.codecs import NO_ENCODING, Encoding
from cairn.operators.mapping import Mapping


#: Buckets of a table.
BUCKETS = 64


class KeyValue:
    def __init__(self, spark: SparkSession, path: str, value_type: str = "string", encoding: Encoding = NO_ENCODING):
        self.spark, self.path, self.value_type, self.encoding = spark, path.rstrip("/"), value_type, encoding

    # -- versions ---------------------------------------------------------------
    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return at().getFileSystem(conf), at

    def _current(self) -> dict:
        """The newest version: number, bucket -> version that holds it, and the last batch folded in."""
        fs, at = self._fs()
        none = {"version": 0, "buckets": {}, "batch": -1}
        if not fs.exists(at()):
            return none
        done = [int(n[1:]) for n in (f.getPath().getName() for f in fs.listStatus(at())) if n.startswith("v") and fs.exists(at(n, "_buckets"))]
        if not done:
            return none
        stream = fs.open(at(f"v{max(done)}", "_buckets"))
        try:
            held = json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
        return held | {"version": max(done), "buckets": {int(k): v for k, v in held["buckets"].items()}}

    def _read(self, held: dict, buckets=None) -> DataFrame:
        paths = [f"{self.path}/v{v}/bucket={k}" for k, v in sorted(held["buckets"].items()) if buckets is None or k in buckets]
        schema = f"k string, v {self.value_type}"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def pairs(self) -> DataFrame:
        return self._read(self._current())

    def decoded(self) -> DataFrame:
        """(k, v) with v decoded; pairs that don't decode vanish."""
        return self.pairs().select("k", F.explode(self.encoding.decode(F.col("v"))).alias("v"))

    def keys(self) -> DataFrame:
        return self.pairs().select("k")

    def values(self) -> DataFrame:
        return self.pairs().select("v")

    def get(self, key: str) -> DataFrame:
        bucket = self.spark.range(1).select(_bucket(F.lit(key))).first()[0]
        return self._read(self._current(), {bucket}).where(F.col("k") == key).select("v")

    def pairs_with_prefix(self, prefix: str) -> DataFrame:
        return self.pairs().where(F.col("k").startswith(prefix))

    def pairs_within_range(self, low: str, high: str) -> DataFrame:
        return self.pairs().where(F.col("k").between(low, high))

    def mapping(self) -> Mapping:
        """Decoded, if the table has an encoding."""
        return Mapping(self.pairs() if self.encoding is NO_ENCODING else self.decoded(), "k", "v")

    def _put(self, rows: DataFrame, held: dict, touched: set[int] | None, batch: int) -> None:
        """A new version with rows in the touched buckets (all, if None); the last version but one goes."""
        fs, at = self._fs()
        new = held["version"] + 1
        fs.delete(at(f"v{new}"), True)  # what an interrupted write has left
        dealt = rows.select("k", F.col("v").cast(self.value_type).alias("v"), _bucket(F.col("k")).alias("bucket"))
        dealt.repartition("bucket").sortWithinPartitions("bucket", "k").write.partitionBy("bucket").parquet(f"{self.path}/v{new}")
        wrote = {int(n.split("=")[1]) for n in (f.getPath().getName() for f in fs.listStatus(at(f"v{new}"))) if n.startswith("bucket=")}
        kept = {} if touched is None else {k: v for k, v in held["buckets"].items() if k not in touched}
        buckets = kept | dict.fromkeys(wrote, new)
        out = fs.create(at(f"v{new}", "_writing"))
        out.write(bytearray(json.dumps({"buckets": buckets, "batch": batch}).encode()))
        out.close()
        fs.rename(at(f"v{new}", "_writing"), at(f"v{new}", "_buckets"))
        # versions that neither this one nor the one before refers to
        used = {new, held["version"], *buckets.values(), *held["buckets"].values()}
        for n in (f.getPath().getName() for f in fs.listStatus(at())):
            if n.startswith("v") and int(n[1:]) not in used:
                fs.delete(at(n), True)

    def write(self, pairs: DataFrame) -> None:
        """Replaces the table's contents."""
        held = self._current()
        self._put(pairs, held, None, held["batch"])

    def _change(self, keys: DataFrame, make, batch: int | None = None) -> None:
        """Rewrites the buckets of keys with what make gives of their mapping."""
        held = self._current()
        touched = {r[0] for r in keys.select(_bucket(F.col("k"))).distinct().collect()}  # BUCKETS at most
        self._put(make(Mapping(self._read(held, touched), "k", "v")).current(), held, touched, held["batch"] if batch is None else batch)

    def update(self, changes: DataFrame) -> None:
        """Applies (k, v, removed) in one step."""
        self._change(changes, lambda m: m.apply_updates(changes))

    def fold_in(self, batch: DataFrame, merge, batch_id: int | None = None) -> None:
        """Merges (k, v) rows into the table: a foreachBatch sink for running aggregates of one stream.

        With batch_id a batch counts once: one that is not newer than the last is skipped.
        """
        if batch_id is not None and batch_id <= self._current()["batch"]:
            return
        self._change(batch, lambda m: m.update_with(batch, merge), batch_id)


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(BUCKETS)).cast("int")


def stored_struct(df: DataFrame, key: Column, rows: Column) -> DataFrame:
    """(k, v) rows of a hierarchical store: the key and each path joined by '/'."""
    flat = df.select(key.cast("string").alias("_key"), F.explode(rows).alias("e"))
    return flat.select(F.concat_ws("/", F.col("_key"), F.array_join(F.col("e")["path"], "/")).alias("k"), F.col("e")["value"].alias("v"))


def loaded_struct(pairs: DataFrame, paths: list[str]) -> DataFrame:
    """Reads back what stored_struct() has written: a row for each key, with the value at each path (null where there is none)."""
    at = F.instr("k", "/")
    split = pairs.select(F.expr("substring(k, 1, instr(k, '/') - 1)").alias("key"), F.expr("substring(k, instr(k, '/') + 1)").alias("path"), "v").where(at > 0)
    return split.groupBy("key").agg(*[F.max(F.when(F.col("path") == p, F.col("v"))).alias(p) for p in paths])
