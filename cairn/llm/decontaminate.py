"""Benchmark decontamination by an FM-index for each shard of the training documents.

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased.
Every 13 consecutive words of a benchmark item form a window; an item of fewer words is one
window.

``index`` writes a row for each shard of some SHARD words of whole documents: its vocabulary (sorted word
hashes), the wavelet matrix of the Burrows-Wheeler transform of all its words, each SAMPLE-th suffix
position, and where its documents begin; equal texts of a shard are indexed once. ``find`` searches all windows of a
benchmark backwards in each shard, locates their occurrences, and merges them to removal spans. An index serves any
number of benchmarks. These are read in blocks of some ``block_bytes`` of text (one item at least), and only
one block is held and broadcast at a time.

Edge cases: null text has no words; rows with a null item_id or no words take no part as items;
repeated item ids count once; an empty benchmark leaves all documents clean; an empty table gives no rows; repeated rows are
each judged, null doc_ids stay null; extra columns are ignored. A document of any length is in one shard.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import segments
from cairn.llm.common import drop, fresh, mapped, shared_dir, small_batches, stored, table, tidy, with_text

WINDOW = 13
SHARD = 600_000
SAMPLE = 16
#: Occurrences located at a time.
LOCATED = 1 << 20
#: Word bytes stay (A-Z lower-cased), all other ASCII parts words.
_TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_BETWEEN = np.array([b == 32 for b in _TABLE])
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_U = np.uint64


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Bits:
    """A bitmap with rank: the ones before each 64 bits are kept."""

    def __init__(self, data: bytes, size: int):
        self.words = np.frombuffer(data + bytes(8 - len(data) % 8), "<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.size = size

    @staticmethod
    def packed(bits: np.ndarray) -> bytes:
        return np.packbits(bits, bitorder="little").tobytes()

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones in the first ``at`` places."""
        block = at >> 6
        return self.before[block] + np.bitwise_count(self.words[block] & ((_U(1) << (at & 63).astype(np.uint64)) - _U(1))).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & _U(1) == 1


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling among suffixes that are still alike; a shorter suffix sorts before its extensions."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    first = np.concatenate([[True], seq[order][1:] != seq[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step = 1
    while True:
        places = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))
        if not len(places):
            return order
        who = order[places]
        beyond = who + step
        key = rank[who] * (n + 1) + np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[places] = who
        opens = np.concatenate([[True], key[1:] != key[:-1]])
        first[places] = opens
        rank[who] = places[np.maximum.accumulate(np.where(opens, np.arange(len(who)), 0))]
        step *= 2


def build(seq: np.ndarray, sigma: int) -> tuple:
    """The parts of the FM-index of seq, whose symbols are 1..sigma-1; the end marker 0 is appended."""
    text = np.concatenate([seq, [0]]).astype(np.int64)
    sa = suffix_array(text)
    bwt, levels = text[sa - 1], []
    for b in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
        bit = (bwt >> b) & 1
        levels.append((Bits.packed(bit), len(bwt) - int(bit.sum())))
        bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
    marked = sa % SAMPLE == 0
    return len(text), levels, np.bincount(text, minlength=sigma).astype(np.uint32).tobytes(), Bits.packed(marked), sa[marked].astype(np.uint32).tobytes()


class FMIndex:
    def __init__(self, parts: tuple):
        self.n, levels, counts, marked, sampled = parts
        self.levels = [(Bits(data, self.n), zeros) for data, zeros in levels]
        self.before = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.uint32), dtype=np.int64)])
        self.marked, self.sampled = Bits(marked, self.n), np.frombuffer(sampled, np.uint32)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol in the first ``at`` places of the transform, elementwise."""
        lo, hi, top = np.zeros_like(at), at.copy(), len(self.levels) - 1
        for k, (bits, zeros) in enumerate(self.levels):
            one = ((symbol >> (top - k)) & 1).astype(bool)
            l1, h1 = bits.rank(lo), bits.rank(hi)
            lo, hi = np.where(one, zeros + l1, lo - l1), np.where(one, zeros + h1, hi - h1)
        return hi - lo

    def symbol(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places of the transform, and how often each occurs before its place."""
        at, start, out = at.copy(), np.zeros_like(at), np.zeros_like(at)
        for bits, zeros in self.levels:
            one = bits.get(at)
            a1, s1 = bits.rank(at), bits.rank(start)
            at, start = np.where(one, zeros + a1, at - a1), np.where(one, zeros + s1, start - s1)
            out = 2 * out + one
        return out, at - start

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns, backwards; patterns are right-aligned in the matrix."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for j in range(width - 1, -1, -1):
            live = np.flatnonzero((lengths >= width - j) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, j]
            lo[live], hi[live] = self.before[c] + self.rank(c, lo[live]), self.before[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walks back to the nearest sampled position."""
        rows, steps, out, walking = rows.copy(), 0, np.empty(len(rows), np.int64), np.arange(len(rows))
        while len(walking):
            here = rows[walking]
            hit = self.marked.get(here)
            out[walking[hit]] = self.sampled[self.marked.rank(here[hit])].astype(np.int64) + steps
            walking, here = walking[~hit], here[~hit]
            c, before = self.symbol(here)
            rows[walking] = self.before[c] + before
            steps += 1
        return out


def _shard(hashes: np.ndarray, at: np.ndarray, ids: list) -> dict:
    """The row of a shard; at: where each document's words begin."""
    n = np.diff(at)
    place = np.arange(len(hashes)) - np.repeat(at[:-1], n)
    some = np.flatnonzero(n)
    content = np.zeros(len(n), np.uint64)
    if len(some):
        content[some] = segments.mix(np.add.reduceat(segments.mix(hashes + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), at[:-1][some]) + n[some].astype(np.uint64))
    # equal texts once; texts without words not at all
    _, first, same = np.unique(content[some], return_index=True, return_inverse=True)
    kept = some[first]
    seq, begin = segments.gather(hashes, at[:-1], n, kept)
    vocabulary, symbol = np.unique(seq, return_inverse=True)
    # each document is closed by the separator 1
    begin = begin + np.arange(len(begin))
    text = np.ones(begin[-1], np.int64)
    inside = np.ones(len(text), bool)
    inside[begin[1:] - 1] = False
    text[inside] = symbol + 2
    of = np.full(len(n), -1, np.int64)
    of[some] = same.reshape(-1)
    parts = build(text, len(vocabulary) + 2) if len(text) else None
    blob = zstandard.ZstdCompressor(level=1).compress(pickle.dumps((vocabulary.tobytes(), begin.astype(np.uint32).tobytes(), parts), protocol=5))
    return {"ids": ids, "n_words": n.tolist(), "text_of": of.tolist(), "fm": blob}


def index(documents: DataFrame, where: str, shard: int | None = None) -> DataFrame:
    """Writes and gives the shards of documents (id, text): part, seq, ids, n_words, text_of (the indexed text of each), fm."""
    shard = shard or SHARD
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("text_of", pa.list_(pa.int64())), ("fm", pa.binary())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, hashes, sizes, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, ids, hashes, sizes, held
            row = {"part": part, "seq": seq} | _shard(np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64), ids)
            seq, ids, hashes, sizes, held = seq + 1, [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            h, at = segments.words(batch.column("text"), _BETWEEN)
            ids += batch.column("id").to_pylist()
            hashes.append(h)
            sizes.append(np.diff(at))
            held += len(h)
            if held >= shard:
                yield flush()
        if ids:
            yield flush()

    rows = documents.select(F.col("id").cast("long").alias("id"), "text")
    return stored(rows.mapInArrow(run, "part int, seq int, ids array<long>, n_words array<long>, text_of array<long>, fm binary"), where)


class Windows:
    """The windows of one block of benchmark items, as word hashes."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        hashes, at = segments.words(pa.array([t for _, t in items], pa.string()), _BETWEEN)
        found: dict[bytes, set[int]] = {}
        names: dict[str, int] = {}
        for (item, _), a, b in zip(items, at.tolist(), at[1:].tolist()):
            if b > a:
                k = names.setdefault(str(item), len(names))
                for i in range(a, max(a + 1, b - window + 1)):
                    found.setdefault(hashes[i : min(i + window, b)].tobytes(), set()).add(k)
        self.names = list(names)
        self.lengths = np.array([len(x) // 8 for x in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.uint64)
        for i, x in enumerate(found):
            self.patterns[i, window - len(x) // 8 :] = np.frombuffer(x, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in found.values()])]).astype(np.int64)
        self.items = np.array([k for x in found.values() for k in sorted(x)], np.int64)

    def find(self, fm: bytes) -> dict[int, tuple[list[int], list[str]]]:
        """For each indexed text with occurrences: merged spans of word numbers [start, end, ...], and items."""
        vocabulary, begin, parts = pickle.loads(zstandard.ZstdDecompressor().decompress(fm))
        vocabulary, begin = np.frombuffer(vocabulary, np.uint64), np.frombuffer(begin, np.uint32).astype(np.int64)
        if parts is None or not len(self.patterns):
            return {}
        at = np.searchsorted(vocabulary, self.patterns).clip(0, len(vocabulary) - 1)
        known = vocabulary[at] == self.patterns
        # all words of a window must be in the vocabulary
        unused = np.arange(known.shape[1])[None, :] < known.shape[1] - self.lengths[:, None]
        live = np.flatnonzero((known | unused).all(1))
        if not len(live):
            return {}
        fmi = FMIndex(parts)
        lo, hi = fmi.search(at[live] + 2, self.lengths[live])
        count = np.maximum(hi - lo, 0)
        cover = np.zeros(begin[-1] + 1, np.int64)
        pairs: list[np.ndarray] = []
        ends = np.cumsum(count)
        for a in range(0, int(ends[-1]), LOCATED):
            n = np.arange(a, min(a + LOCATED, int(ends[-1])))
            which = np.searchsorted(ends, n, side="right")
            place = fmi.locate(lo[which] + n - (ends[which] - count[which]))
            np.add.at(cover, place, 1)
            np.add.at(cover, place + self.lengths[live[which]], -1)
            doc = np.searchsorted(begin, place, side="right") - 1
            pairs.append(np.unique(doc * len(self.lengths) + live[which]))
        if not pairs:
            return {}
        hit = np.cumsum(cover)[:-1] > 0
        out: dict[int, tuple[list[int], set[str]]] = {}
        for x in np.unique(np.concatenate(pairs)).tolist():
            d, w = divmod(x, len(self.lengths))
            if d not in out:
                h = np.concatenate([[False], hit[begin[d] : begin[d + 1]], [False]])
                out[d] = (np.flatnonzero(h[1:] != h[:-1]).tolist(), set())
            out[d][1].update(self.names[k] for k in self.items[self.starts[w] : self.starts[w + 1]].tolist())
        return {d: (spans, sorted(items)) for d, (spans, items) in out.items()}


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find(shards: DataFrame, benchmark: DataFrame, where: str, window: int = WINDOW, block_bytes: int = 8 << 20) -> DataFrame:
    """id, n_words, hit_spans (merged word spans, flat), hit_items (sorted ids as text) of every indexed document."""
    spark = shards.sparkSession
    found: list[DataFrame] = []
    for k, block in enumerate(blocks(benchmark, block_bytes)):
        data = spark.sparkContext.broadcast(block)

        def start(data=data) -> Callable:
            windows = Windows(data.value, window)

            def each(batch: pa.RecordBatch) -> Iterator[dict]:
                for i in range(len(batch)):
                    got = windows.find(batch.column("fm")[i].as_py())
                    docs = [(d, got[t]) for d, t in enumerate(batch.column("text_of")[i].as_py()) if t in got]
                    yield {"part": [batch.column("part")[i].as_py()] * len(docs), "seq": [batch.column("seq")[i].as_py()] * len(docs), "at": [d for d, _ in docs], "hit_spans": [s for _, (s, _) in docs], "hit_items": [x for _, (_, x) in docs]}

            return each

        found.append(stored(mapped(shards.select("part", "seq", "text_of", "fm"), start, {"part": "int", "seq": "int", "at": "long", "hit_spans": "array<long>", "hit_items": "array<string>"}), f"{where}/hits{k}"))
        data.destroy()
    docs = shards.select("part", "seq", F.posexplode(F.arrays_zip("ids", "n_words")).alias("at", "d")).select("part", "seq", F.col("at").cast("long").alias("at"), F.col("d.ids").alias("id"), F.col("d.n_words").alias("n_words"))
    none = {"hit_spans": F.array().cast("array<long>"), "hit_items": F.array().cast("array<string>")}
    if not found:
        return docs.select("id", "n_words", *[v.alias(c) for c, v in none.items()])
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    if len(found) > 1:
        hits = hits.groupBy("part", "seq", "at").agg(_merged(F.flatten(F.collect_list("hit_spans"))).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"))
    return docs.join(hits, ["part", "seq", "at"], "left").select("id", "n_words", *[F.coalesce(c, v).alias(c) for c, v in none.items()])


def _merged(flat: Column) -> Column:
    """The union of spans [start, end, start, end, ...]."""
    n = (F.size(flat) / 2).cast("int")
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get(flat, 2 * k).alias("s"), F.get(flat, 2 * k + 1).alias("e"))))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (x["s"] <= F.element_at(acc, -1)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), x["e"])))).otherwise(F.concat(acc, F.array(x["s"], x["e"])))
    return F.aggregate(pairs, F.array().cast("array<long>"), step)


def digest(df: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated from find()'s columns."""
    hit = F.aggregate(F.transform("hit_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_hit", hit).withColumns({"n_items": F.size("hit_items").cast("long"), "items_sha256": F.sha2(F.array_join("hit_items", ","), 256), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})


def cut(text: str, spans: list[int]) -> str:
    """text without the words in spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s, e in zip(spans[::2], spans[1::2]):
        out.append(text[at : places[s][0]])
        at = places[e - 1][1]
    return "".join(out) + text[at:]


def remove_spans(documents: DataFrame, benchmark: DataFrame, where: str | None = None) -> DataFrame:
    """Cuts every found benchmark passage from the texts; n_chars follows. Documents left without words by that go.

    documents must be a table, or another frame that gives the same rows in the same partitions whenever it is read.
    """
    spark = documents.sparkSession
    where = where or shared_dir(spark)
    row, spans, new, chars = fresh(documents, "__row", "__spans", "__text", "__n")
    numbered = documents.withColumn(row, F.monotonically_increasing_id())
    shards = index(numbered.select(F.col(row).alias("id"), "text"), f"{where}/index")
    hits = stored(find(shards, benchmark, where).where(F.size("hit_spans") > 0).select(F.col("id").alias(row), F.col("hit_spans").alias(spans)), f"{where}/spans")
    drop(spark, f"{where}/index")

    def start() -> Callable:
        def each(batch: pa.RecordBatch) -> tuple[dict, list[bool]]:
            out, keep = [], []
            for t, s in zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist()):
                edited = cut(t, s) if s else None
                out.append(edited)
                keep.append(edited is None or bool(words(edited)))
            return {new: out, chars: [None if t is None else len(t) for t in out]}, keep

        return each

    edited = mapped(numbered.join(hits, row, "left"), start, {new: "string", chars: "long"}, documents.columns)
    return with_text(edited, documents, new, chars)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    where = shared_dir(spark)
    shards = index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), f"{where}/index")
    found = digest(find(shards, table(spark, sf_dir, "benchmark"), where))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def brute(docs: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same digest by plain comparison, for tests."""
    out = []
    wins = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            wins.setdefault(str(i), set()).update(tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1)))
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for i, ps in wins.items():
            for p in ps:
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k : k + len(p)]) == p:
                        hit |= set(range(k, k + len(p)))
                        got.add(i)
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out
