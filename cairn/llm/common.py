"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import wraps
from itertools import batched
from types import GeneratorType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor can reach.

    The setting is read from the session; a temporary folder is used only where it is
    unset, as in local tests.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cairn-{uuid.uuid4().hex}"


def stored(df: DataFrame, where: str) -> DataFrame:
    """Writes df as Parquet and reads it back: cuts the lineage with a copy all executors share."""
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that stored() has written and that no later plan reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs before the next large one."""
    spark.sparkContext._jvm.System.gc()


def remainder(doc_id: Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; 0 for a null id, so that such rows are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % m, F.lit(0))


def remainder_py(doc_id, m: int) -> int:
    return zlib.crc32(str(int(doc_id)).encode()) % m


def slots(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def small_batches(spark: SparkSession, records: int = 2000, size: str = "2m") -> None:
    """Bounds what a Python worker holds at a time, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}


def _arrow(kind: str) -> pa.DataType:
    return pa.list_(_arrow(kind[6:-1])) if kind.startswith("array<") else _ARROW[kind]


_HELD: dict[tuple, object] = {}
_USED: set[tuple] = set()


def held(key: tuple, make: Callable[[], object]):
    """What make() gives, kept by the worker from task to task as long as each task asks for it."""
    _USED.add(key)
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def _tidied(run: Callable, batches: Iterator) -> Iterator:
    _USED.clear()
    try:
        yield from run(batches)
    finally:
        for key in set(_HELD) - _USED:
            del _HELD[key]
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function of a task's batches that hands memory back to the system when it ends, as workers live on."""
    # _tidied is found by its name in the worker, so that it sees the worker's own _HELD
    return wraps(run)(lambda batches: _tidied(run, batches))


def mapped(df: DataFrame, start: Callable[[], Callable], new: dict[str, str], keep: Sequence[str] = (), together: int = 1) -> DataFrame:
    """Columns ``keep`` of df as they are, and new ones (name -> type) computed from Arrow batches.

    start() is called once in each task; what it returns takes a batch and gives the new columns as lists
    or arrays, or (columns, mask) where only some rows stay; columns then have values for all rows. Without kept
    columns a batch may give any number of rows, or a generator of such columns. With ``together`` over 1 the function takes
    a list of up to so many batches and gives a list. Kept columns never
    become Python or NumPy values, so a null among integers changes nothing.
    """
    kinds = {n: _arrow(k) for n, k in new.items()}
    fields = T.StructType([df.schema[c] for c in keep] + T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in new.items())).fields if new else [df.schema[c] for c in keep])

    def rows(batch: pa.RecordBatch, got) -> pa.RecordBatch:
        got, mask = got if isinstance(got, tuple) else (got, None)
        made = [v if isinstance(v := got[n], pa.Array) else pa.array(v, type=k) for n, k in kinds.items()]
        out = pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, [*keep, *kinds])
        return out if mask is None else out.filter(pa.array(mask, pa.bool_()))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        if together > 1:
            for held in batched(batches, together):
                for batch, part in zip(held, each(held)):
                    yield rows(batch, part)
            return
        for batch in batches:
            got = each(batch)
            for part in got if isinstance(got, GeneratorType) else (got,):
                yield rows(batch, part)

    return df.mapInArrow(run, fields)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n in taken:
            n += "_"
        out.append(n)
    return out


def with_text(changed: DataFrame, documents: DataFrame, text: str, n: str) -> DataFrame:
    """documents' columns, with text and n_chars taken from the columns text and n where these aren't null."""
    new = {"text": F.coalesce(text, "text")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.coalesce(F.col(n).cast(documents.schema["n_chars"].dataType), "n_chars")
    return changed.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in documents.columns])


class Recent(dict):
    """A cache of two generations: of ``most`` bytes the older half goes first, and what is used again stays.

    An entry counts as its key's and value's bytes and 150 more.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held, self.old = most, 0, {}

    def __setitem__(self, key, value) -> None:
        self.held += len(key) + len(value) + 150
        super().__setitem__(key, value)

    def __missing__(self, key):
        value = self[key] = self.old[key]
        return value

    def lacks(self, keys) -> list:
        old = self.old
        return [k for k in keys if k not in self and k not in old]

    def make_room(self) -> None:
        if self.held > self.most // 2:
            self.old = dict(self)
            self.clear()
            self.held = 0


def ascii_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
