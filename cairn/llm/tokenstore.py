"""Token ids in directly addressable codes: files that give any token without decoding a block.

A segment holds the ids of whole documents as chunk levels of 8 bits. Level 0 has the lowest
chunk of every id and a bitmap that tells which ids go on; level 1 has the next chunk of those,
and so on. A directory holds the ones before each 512 bits of a bitmap, so the place of an id's
next chunk is one rank. Segments are rows of Parquet files in ascending doc_id order (part,
seq), each with its documents' ids and lengths; a segment has about SEGMENT ids, one document at
least.

Edge cases: null and empty text: only the end id. Repeated doc_ids: each row is a document of
its own; ties are ordered by text. Null doc_ids come first. The string of a special token is that token,
as the library has it. Extra columns are ignored. An empty table gives no segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import segments
from cairn.llm.common import Recent, held, mapped, shared_dir, small_batches, table, tidy

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = 2
SEGMENT = 1 << 18
MAGIC = b"DAC1"
_BLOCK = 512


def pack(ids: np.ndarray) -> bytes:
    """ids as directly addressable codes."""
    ids, levels = ids.astype(np.uint64), []
    while True:
        more = ids > 255
        ones = np.concatenate([[0], np.cumsum(more)]).astype("<u4")
        levels.append((len(ids), (ids & np.uint64(255)).astype(np.uint8).tobytes(), np.packbits(more, bitorder="little").tobytes(), ones[:-1:_BLOCK].tobytes()))
        ids = ids[more] >> np.uint64(8)
        if not len(ids):
            break
    head = MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<Q", n) for n, *_ in levels)
    return head + b"".join(x for _, *parts in levels for x in parts)


class Codes:
    """Reads what pack() has written, in place."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        (n,) = struct.unpack_from("<I", data, 4)
        self.sizes = struct.unpack_from(f"<{n}Q", data, 8)
        at, self.levels = 8 + 8 * n, []
        for size in self.sizes:
            chunk = np.frombuffer(data, np.uint8, size, at)
            bits = np.frombuffer(data, np.uint8, -(-size // 8), at + size)
            at += size + len(bits)
            ranks = np.frombuffer(data, "<u4", -(-size // _BLOCK), at)
            at += 4 * len(ranks)
            self.levels.append((chunk, bits, ranks))

    def __len__(self) -> int:
        return self.sizes[0] if self.sizes else 0

    def at(self, i: int) -> int:
        """The i-th id: one rank for each further chunk."""
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            start = i // _BLOCK * (_BLOCK // 8)
            inside = int.from_bytes(bits[start : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - start * 8)) - 1)
            i = int(ranks[i // _BLOCK]) + inside.bit_count()
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out, which = np.zeros(len(self), np.uint32), np.arange(len(self))
        for k, (chunk, bits, _) in enumerate(self.levels):
            out[which] |= chunk.astype(np.uint32) << np.uint32(8 * k)
            which = which[np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)]
        return out


class Encoder:
    """Encodes texts with a tokenizers file; pieces seen before come from a cache of ``most`` bytes.

    Texts that hold a special token's string are encoded whole by the library, which recognises it.
    """

    def __init__(self, vocabulary: str, most: int = 48 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = Recent(most)
        size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            size[i] = len(token)  # the byte-level alphabet has a character for each byte
        self.size = size

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, new: list[bytes]) -> None:
        """Pieces that open with a space and end in none are encoded side by side, then told apart by their bytes."""
        spaced = [x for x in new if x[0] == 32 and x[-1] > 32]
        for x in set(new).difference(spaced):
            self.cache[x] = self._ids(x.decode()).tobytes()
        parts = [spaced[k : k + 512] for k in range(0, len(spaced), 512)]
        for k in range(0, len(parts), 16):
            for part, got in zip(parts[k : k + 16], self.tokenizer.encode_batch_fast([b"".join(p).decode() for p in parts[k : k + 16]], add_special_tokens=False)):
                ids = np.array(got.ids, "<u4")
                cuts = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(x) for x in part])) + 1
                data, at = ids.tobytes(), 0
                for x, end in zip(part, cuts.tolist()):
                    self.cache[x] = data[4 * at : 4 * end]
                    at = end

    def encode(self, text: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        special = np.zeros(len(text), bool)
        for x in self.special:
            special |= pc.fill_null(pc.match_substring(text, x), False).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), "", text) if special.any() else text
        distinct, which, at = segments.pieces(plain)
        self.cache.make_room()
        distinct = distinct.to_pylist()
        if new := self.cache.lacks(distinct):
            self._learn(new)
        runs = [self.cache[x] for x in distinct]
        size = np.array([len(r) for r in runs], np.int64) // 4
        ids, ends = segments.gather(np.frombuffer(b"".join(runs), "<u4"), np.cumsum(size) - size, size, which)
        ends = ends[at].tolist()
        return [self._ids(text[k].as_py()) if special[k] else ids[a:b] for k, (a, b) in enumerate(zip(ends, ends[1:]))]


def encoder(vocabulary: str) -> Encoder:
    """One for each worker process, kept from task to task."""
    return held((vocabulary,), lambda: Encoder(vocabulary))


def write(documents: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, segment: int = SEGMENT) -> None:
    """Encodes documents (doc_id, text) and writes their segments in ascending doc_id order."""

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("codes", pa.binary())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, part, seq, first = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        docs, runs, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, runs, size, seq, first
            row = {"part": part, "seq": seq, "first": first, "n_tokens": size, "docs": docs, "lengths": [len(r) for r in runs], "codes": pack(np.concatenate(runs))}
            seq, first, docs, runs, size = seq + 1, first + size, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for doc, got in zip(batch.column("doc_id").to_pylist(), make.encode(batch.column("text"))):
                ids = np.append(got, np.uint32(end))
                docs.append(doc)
                runs.append(ids)
                size += len(ids)
                if size >= segment:
                    yield flush()
        if docs:
            yield flush()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, "part int, seq int, first long, n_tokens long, docs array<long>, lengths array<long>, codes binary").write.mode("overwrite").parquet(path)


def starts(spark: SparkSession, path: str) -> dict[int, int]:
    """The ids before each part; as many entries as partitions were written."""
    out, at = {}, 0
    for r in spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").toLocalIterator():
        out[r["part"]] = at
        at += r["n"]
    return out


def read(spark: SparkSession, path: str, each: Callable[[object, int, np.ndarray], tuple], new: dict[str, str]) -> DataFrame:
    """each(doc_id, start, ids) of every document of the files, as rows of the columns new (name -> type)."""
    before = starts(spark, path)

    def start() -> Callable:
        def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
            for k in range(len(batch)):
                s = {c: batch.column(c)[k].as_py() for c in ("part", "first", "docs", "lengths", "codes")}
                ids, at, base, rows = Codes(s["codes"]).all(), 0, before[s["part"]] + s["first"], []
                for doc, n in zip(s["docs"], s["lengths"]):
                    rows.append(each(doc, base + at, ids[at : at + n]))
                    at += n
                yield dict(zip(new, zip(*rows)))

        return rows_of

    return mapped(spark.read.parquet(path), start, new)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, size="8m")
    path = f"{shared_dir(spark)}/tokens"
    write(table(spark, sf_dir, "documents"), path)
    new = {"doc_id": "long", "start": "long", "n_tokens": "long", "ids_crc32": "long"}
    return read(spark, path, lambda doc, start, ids: (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), new)
