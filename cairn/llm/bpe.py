"""Byte-level BPE in DuckDB: a recursive query contracts all words of a batch until none changes.

Each partition has its own in-process DuckDB with the merge table (left id, right id, rank of the
joined token). A batch's distinct pre-tokens are rows (word, position, token), at first of single bytes.
Each step of the recursion joins neighbours with the merge table and contracts every word's leftmost
pair of minimum rank; words without a pair to merge leave it. Words that are tokens themselves are not contracted, as
in the library. Ordered aggregation gives each word's ids, and decodes ids to bytes. A worker keeps
the ids of pieces it has seen in a cache of bounded bytes.

A step reads all rows of its words, so a word of n bytes costs up to n * n rows: words of similar length go
together, and words over LONGEST bytes are contracted by a heap in Python with the same
rule and the same result (README has the figures).

Edge cases: null and empty text: no ids, empty bytes. Strings of special tokens are ordinary
text. Extra columns are ignored; each row is encoded on its own, repeated ones too. Null doc_ids stay null.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from cairn.llm import segments
from cairn.llm.common import Recent, held, mapped, small_batches, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONGEST = 1024
#: Bytes of the words contracted together, and ids decoded together.
BATCH, DECODED = 1 << 18, 200_000

_ENCODE = """
WITH RECURSIVE whole AS (
    SELECT word, token FROM given JOIN tokens USING (hex)
), state(word, pos, token, live) AS (
    SELECT word, pos, token, true FROM bytes ANTI JOIN whole USING (word)
    UNION ALL
    (WITH neighbours AS (
        SELECT word, pos, token, lag(pos) OVER near AS before, (token::BIGINT << 32) | lead(token) OVER near AS pair
        FROM state WHERE live WINDOW near AS (PARTITION BY word ORDER BY pos)
    ), ranked AS (
        SELECT word, pos, token, before, rank FROM neighbours LEFT JOIN merges USING (pair)
    ), best AS (
        SELECT word, min((rank::BIGINT << 32) | pos) AS least FROM ranked GROUP BY word
    )
    SELECT word, pos, CASE WHEN pos = least & 4294967295 THEN (least >> 32)::INT ELSE token END, least IS NOT NULL
    FROM ranked JOIN best USING (word)
    WHERE before IS NULL OR least IS NULL OR before <> least & 4294967295)
)
SELECT word, list(token ORDER BY pos) AS ids FROM (SELECT word, pos, token FROM state WHERE NOT live UNION ALL SELECT word, 0, token FROM whole)
GROUP BY word ORDER BY word
"""
_DECODE = """
SELECT i.doc, string_agg(v.hex, '' ORDER BY i.pos) AS hex FROM ids AS i JOIN tokens AS v USING (token) GROUP BY i.doc
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """most: the bytes of the cache."""

    def __init__(self, ranks_path: str, pattern: str, most: int = 40 << 20):
        import duckdb
        import regex

        self.ranks = load_ranks(ranks_path)
        spaces = "\t\n\r " + segments.OTHER_SPACES
        # the library's \s is the Unicode property; Python's also has four control characters
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{spaces}").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]"))
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        merges = [((self.ranks[t[:k]] << 32) | self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "150MB"})
        self._with("CREATE TABLE merges AS SELECT * FROM given", given=pa.table({"pair": pa.array([p for p, _ in merges], pa.int64()), "rank": pa.array([r for _, r in merges], pa.int64())}))
        self._with("CREATE TABLE tokens AS SELECT * FROM given", given=pa.table({"token": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]}))
        self.pieces = Recent(most)

    def _with(self, query: str, **tables: pa.Table) -> pa.Table | None:
        for name, rows in tables.items():
            self.db.register(name, rows)
        got = self.db.sql(query)
        got = got if got is None else got.to_arrow_table()
        for name in tables:
            self.db.unregister(name)
        return got

    def by_heap(self, word: bytes) -> list[int]:
        """The same contraction for a long word: always the smallest (rank, position)."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, bytes, bytes]] = []

        def offer(i: int) -> None:
            if 0 <= i and (j := after[i]) < len(parts) and (r := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(len(word) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] != a or (j := after[i]) >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [self.ranks[p] for p in parts if p is not None]

    def contract(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        out, order, at = {}, sorted(words, key=len), 0
        while at < len(order):
            # words of similar length, so that few rows wait for the last steps
            first, end, held = len(order[at]), at, 0
            while end < len(order) and len(order[end]) <= max(16, 2 * first) and (end == at or held + len(order[end]) <= BATCH):
                held += len(order[end])
                end += 1
            part, at = order[at:end], end
            n = np.array([len(x) for x in part])
            data = np.frombuffer(b"".join(part), np.uint8)
            rows = pa.table({"word": np.repeat(np.arange(len(part), dtype=np.int32), n), "pos": (np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32), "token": self.single[data]})
            got = self._with(_ENCODE, bytes=rows, given=pa.table({"word": np.arange(len(part), dtype=np.int32), "hex": [x.hex() for x in part]}))["ids"].combine_chunks()
            got = got.chunk(0) if isinstance(got, pa.ChunkedArray) else got
            flat, ends = got.values.to_numpy().astype("<u4").tobytes(), (4 * got.offsets.to_numpy()).tolist()
            out.update(zip(part, [flat[a:b] for a, b in zip(ends, ends[1:])]))
        return out

    def learn(self, new: list[bytes]) -> None:
        """Fills the cache with pieces."""
        split = [[w.encode() for w in self.pattern.findall(p.decode())] for p in new]
        words = set().union(*split)
        long_ = {w for w in words if len(w) > LONGEST}
        ids = self.contract(list(words - long_)) | {w: np.array([self.ranks[w]] if w in self.ranks else self.by_heap(w), "<u4").tobytes() for w in long_}
        for p, ws in zip(new, split):
            self.pieces[p] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])

    def encode(self, text: pa.Array) -> pa.ListArray:
        """The ids of each text."""
        distinct, which, at = segments.pieces(text)
        distinct = distinct.to_pylist()
        self.pieces.make_room()
        for k in range(0, len(new := self.pieces.lacks(distinct)), 20_000):
            self.learn(new[k : k + 20_000])
        runs = [self.pieces[x] for x in distinct]
        size = np.array([len(r) for r in runs], np.int64) // 4
        ids, ends = segments.gather(np.frombuffer(b"".join(runs), "<u4"), np.cumsum(size) - size, size, which)
        return pa.ListArray.from_arrays(pa.array(ends[at], pa.int32()), pa.array(ids.astype(np.int32)))

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        """The bytes of each list of ids, by ordered aggregation in blocks of documents."""
        out, ends, flat = [b""] * len(ids), ids.offsets.to_numpy(), ids.values.to_numpy()
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + DECODED, "right")) - 1)
            own = flat[ends[at] : ends[to]]
            rows = pa.table({"doc": np.repeat(np.arange(at, to, dtype=np.int32), np.diff(ends[at : to + 1])), "pos": np.arange(len(own), dtype=np.int32), "token": own})
            got = self._with(_DECODE, ids=rows)
            for d, h in zip(got["doc"].to_pylist(), got["hex"].to_pylist()):
                out[d] = bytes.fromhex(h)
            at = to
        return out


def coder(ranks: str, pattern: str) -> Coder:
    """One for each worker process, kept from task to task."""
    return held((ranks, pattern), lambda: Coder(ranks, pattern))


def encode(documents: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """documents' doc_id and text with ids (array<int>) and decoded (binary)."""

    def start() -> Callable:
        code = coder(ranks, pattern)

        def each(batch: pa.RecordBatch) -> dict:
            ids = code.encode(batch.column("text"))
            return {"ids": ids, "decoded": code.decode(ids)}

        return each

    return mapped(documents.select("doc_id", "text"), start, {"ids": "array<int>", "decoded": "binary"}, ["doc_id", "text"])


def digests(documents: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, keep: bool = False) -> DataFrame:
    """doc_id (or with keep all columns and the ids), n_tokens, ids_sha256, decoded_sha256."""
    new = ({"ids": "array<int>"} if keep else {}) | {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    rows = (documents if keep else documents.select("doc_id", "text")).drop(*new)

    def start() -> Callable:
        code = coder(ranks, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def each(batch: pa.RecordBatch) -> dict:
            ids = code.encode(batch.column("text"))
            joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string())), ",")
            return {"ids": ids, "n_tokens": np.diff(ids.offsets.to_numpy()), "ids_sha256": [sha(x.encode()) for x in joined.to_pylist()], "decoded_sha256": [sha(d) for d in code.decode(ids)]}

        return each

    return mapped(rows, start, new, rows.columns if keep else ["doc_id"])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, size="8m")
    return digests(table(spark, sf_dir, "documents"))
