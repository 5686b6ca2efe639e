"""A Katz bigram model: Good-Turing discounts, exactly normalised back-off, in partitioned tables.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, then one end token; a text's first token
follows a start mark. With c the training counts, and d and d1 Good-Turing discounts for counts up to 5 (larger
counts are kept),

    P(w | h) = d(c(h,w)) c(h,w) / c(h)   if c(h,w) > 0
             = alpha(h) P(w)             if c(h) > 0 but c(h,w) = 0
             = P(w)                      if c(h) = 0
    P(w)     = d1(c(w)) c(w) / N, and what is left goes to unknown words
    alpha(h) = (1 - sum of seen P(w|h)) / (1 - sum of seen P(w))

A history none of whose counts is discounted has c(h) + 1 for c(h), so that mass is left for unseen words; so has N.

The model is two stored tables. ``unigrams`` has a row for each bucket of words (by hash) with their counts; ``bigrams``
one for each bucket of histories with their successors' counts. A bucket asks the words' buckets
for its successors' counts once, which gives alpha(h). Each token is then evaluated recursively: its bigram is looked up in
the history's bucket; if it isn't there, log alpha(h) is added and the word is looked up in its unigram bucket. What
tokens ask for is grouped per chunk of documents; a task holds one bucket of the model and streams the questions
past it, so a bigram that every document has costs no memory. Histories that make up over 1 / HOT of the tokens (found exactly, so
at most HOT) have their successors dealt over all buckets; only their sums visit the driver. Questions are dealt
in TURNS parts of the buckets, and a part's shuffle is released before the next.

Edge cases: null and empty text is the end token alone. Null doc_id: never held out. Repeated rows are each
scored and counted. Without training documents every word is unknown and base is log10(1 / 1) = 0. An
empty table gives no rows. Extra columns are ignored. documents must be a table, or another frame that gives the same rows in
the same partitions whenever it is read.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import segments
from cairn.llm.common import ascii_words, drop, release, remainder, shared_dir, small_batches, stored, table, tidy
from cairn.llm.segments import mix

START, END = 1, 2
K = 5
HOT = 1024
BUCKET_TOKENS, CHUNK_TOKENS, TURNS = 1_000_000, 1_500_000, 4
#: Partial sums of so many documents and buckets are added up before they are written.
SUMS = 400_000
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_ROWS = "kind int, key long, part long, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([(a.dtype.str, a.tobytes()) for a in arrays], protocol=5))


def unpack(data: bytes) -> list[np.ndarray]:
    return [np.frombuffer(b, d) for d, b in pickle.loads(zstandard.ZstdDecompressor().decompress(data))]


def small(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest type."""
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 2**32 else np.uint64)


def discounts(n: np.ndarray) -> np.ndarray:
    """d[0..K+1] from n[1..K+1], the numbers of items with each count; d[K+1] is for larger counts."""
    d = np.ones(K + 2)
    if n[1] > 0:
        common = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            star = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
            v = (star / r - common) / (1 - common) if common < 1 else -1.0
            # where the counts of counts don't fall as they should, take half a count off
            d[r] = v if 0 < v < 1 else (r - 0.5) / r
    d[0] = 0
    return d


def tally(counts: np.ndarray) -> list[int]:
    """How many of the counts are 1, 2, ... K+1 (from place 1)."""
    return np.bincount(np.minimum(counts[counts > 0], K + 2), minlength=K + 3)[: K + 2].tolist()


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' tokens, the history of each, and the number of tokens of each text."""
    hashes, at = segments.words(text)
    n = np.diff(at) + 1
    ends = np.cumsum(n)
    w = np.empty(len(hashes) + len(n), np.uint64)
    w[ends - 1] = END
    inside = np.ones(len(w), bool)
    inside[ends - 1] = False
    w[inside] = hashes
    h = np.concatenate([[START], w[:-1]]).astype(np.uint64)
    h[ends - n] = START
    return w, h, n


def _pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * _ODD + w)


def _among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are in known, which is sorted."""
    return known[np.searchsorted(known, x).clip(0, len(known) - 1)] == x


def _alike(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each key begins in it."""
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))


def _dealt(home: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by home, and (home, start, end) of those that have any."""
    order = np.argsort(home.astype(np.uint32), kind="stable")
    ends = np.cumsum(np.bincount(home, minlength=buckets))
    return order, [(b, s, e) for b, (s, e) in enumerate(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())) if e > s]


def _home(w: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(w) % _U(buckets)).astype(np.int64)


def _bucket(h: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    is_hot = _among(hot, h)
    return _home(np.where(is_hot, h ^ (w * _ODD), h), buckets)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kind, key, part, blob = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(part, pa.int64()), pa.array(blob, pa.binary())], ["kind", "key", "part", "blob"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for b in batches:
        kind, key, part, blob = (b.column(c) for c in ("kind", "key", "part", "blob"))
        for i in range(len(b)):
            yield kind[i].as_py(), key[i].as_py(), part[i].as_py(), blob[i].as_py()


def _chunks(batches: Iterator[pa.RecordBatch], trained: bool) -> Iterator[tuple]:
    """(words, histories, places in uids, uids) of some documents; of training ones only if trained."""
    held: list[tuple] = []
    size = 0
    for b in batches:
        w, h, n = tokens(b.column("text"))
        uid = b.column("uid").to_numpy()
        if trained:
            keep = ~b.column("held_out").to_numpy(zero_copy_only=False)
            of = np.repeat(keep, n)
            w, h, n, uid = w[of], h[of], n[keep], uid[keep]
        held.append((w, h, n, uid))
        size += len(w)
        if size >= CHUNK_TOKENS:
            yield _joined(held)
            held, size = [], 0
    if size:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple:
    w, h, n, uid = (np.concatenate(x) for x in zip(*held))
    return w, h, np.repeat(np.arange(len(n)), n), uid


def _sorted(rows: DataFrame) -> DataFrame:
    """All rows of a key in one task, in the order of their kinds."""
    return rows.repartition("key").sortWithinPartitions("key", "kind", "part")


def _unigrams(docs: DataFrame, buckets: int) -> DataFrame:
    """key, blob (words, counts), and the counts of counts, number of words and of tokens."""

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, *_ in _chunks(batches, True):
            u, c = np.unique(w, return_counts=True)
            order, parts = _dealt(_home(u, buckets), buckets)
            yield _rows([(0, b, 0, pack(u[order[s:e]], small(c[order[s:e]]))) for b, s, e in parts])

    @tidy
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groupby(_each(batches), lambda r: r[1]):
            w, c = (np.concatenate(x) for x in zip(*((w, c.astype(np.int64)) for w, c in (unpack(r[3]) for r in rows))))
            u, i = np.unique(w, return_inverse=True)
            c = np.bincount(i, c, len(u)).astype(np.int64)
            yield pa.RecordBatch.from_pylist([{"kind": 0, "key": key, "part": 0, "blob": pack(u, small(c)), "tally": tally(c), "items": len(u), "tokens": int(c.sum())}], schema)

    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("part", pa.int64()), ("blob", pa.binary()), ("tally", pa.list_(pa.int64())), ("items", pa.int64()), ("tokens", pa.int64())])
    return _sorted(docs.mapInArrow(deal, _ROWS)).mapInArrow(merge, _ROWS + ", tally array<long>, items long, tokens long")


def _frequent(unigrams: DataFrame, least: float) -> dict[int, int]:
    """The counts of all words with at least ``least``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, blob in _each(batches):
            w, c = unpack(blob)
            yield pa.RecordBatch.from_arrays([pa.array(w[c >= least].view(np.int64)), pa.array(c[c >= least].astype(np.int64))], ["w", "c"])

    return {r["w"] % 2**64: r["c"] for r in unigrams.select("kind", "key", "part", "blob").mapInArrow(run, "w long, c long").collect()}


def _coded(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """h (sorted) and w in few bytes."""
    uh, nh = np.unique(h, return_counts=True)
    uw, iw = np.unique(w, return_inverse=True)
    return uh, small(nh), uw, small(iw)


def _bigrams(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """key, blob (histories, successors of each, words, the successors, counts), and the counts of counts."""

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, h, *_ in _chunks(batches, True):
            order, at = _alike(_pair(h, w))
            first, c = order[at], np.diff(np.append(at, len(order)))
            order = np.argsort(h[first])
            h, w, c = h[first[order]], w[first[order]], c[order]
            order, parts = _dealt(_bucket(h, w, hot, buckets), buckets)
            yield _rows([(0, b, 0, pack(*_coded(h[o := order[s:e]], w[o]), small(c[o]))) for b, s, e in parts])

    @tidy
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groupby(_each(batches), lambda r: r[1]):
            got = []
            for r in rows:
                uh, nh, uw, iw, c = unpack(r[3])
                got.append((np.repeat(uh, nh), uw[iw], c.astype(np.int64)))
            h, w, c = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((w, h))
            h, w, c = h[order], w[order], c[order]
            at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
            h, w, c = h[at], w[at], np.add.reduceat(c, at)
            yield pa.RecordBatch.from_pylist([{"kind": 0, "key": key, "part": 0, "blob": pack(*_coded(h, w), small(c)), "tally": tally(c)}], schema)

    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("part", pa.int64()), ("blob", pa.binary()), ("tally", pa.list_(pa.int64()))])
    return _sorted(docs.mapInArrow(deal, _ROWS)).mapInArrow(merge, _ROWS + ", tally array<long>")


def _lower(unigrams: DataFrame, bigrams: DataFrame, facts: dict, buckets: int) -> DataFrame:
    """Kind 1, for each bucket of bigrams and home of its words: the words' counts. Kind 9, for hot histories: partial sums."""
    plain = lambda df: df.select("kind", "key", "part", "blob")

    @tidy
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, _, blob in _each(batches):
            uh, nh, uw, iw, c = unpack(blob)
            h = np.repeat(uh, nh)
            order, parts = _dealt(_home(uw, buckets), buckets)
            place = np.empty(len(uw), np.int64)
            place[order] = np.arange(len(uw))
            own = np.flatnonzero(_among(facts["hot"], h))
            which, of, mass = np.searchsorted(facts["hot"], h[own]), place[iw[own]], facts["pairs"][np.minimum(c[own].astype(np.int64), K + 1)] * c[own]
            by = np.argsort(of, kind="stable")
            which, of, mass, rows = which[by], of[by], mass[by], []
            for b, s, e in parts:
                x, y = np.searchsorted(of, (s, e))
                rows.append((1, b, key, pack(uw[order[s:e]], small(which[x:y]), small(of[x:y] - s), mass[x:y])))
            yield _rows(rows)

    @tidy
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in groupby(_each(batches), lambda r: r[1]):
            w, c, n = None, None, len(facts["hot"])
            mass, lower = np.zeros(n), np.zeros(n)
            for kind, _, part, blob in rows:
                if kind == 0:
                    w, c = unpack(blob)
                    continue
                uw, which, of, m = unpack(blob)
                got = c[np.searchsorted(w, uw)].astype(np.int64)
                mass += np.bincount(which, m, n)
                lower += np.bincount(which, _unigram(got, facts)[of], n)
                yield _rows([(1, part, key, pack(small(got)))])
            if n:
                yield _rows([(9, -1, key, pack(mass, lower))])

    return _sorted(plain(unigrams).unionAll(bigrams.select("kind", "key", "part", "blob").mapInArrow(ask, _ROWS))).mapInArrow(answer, _ROWS)


def _unigram(c: np.ndarray, facts: dict) -> np.ndarray:
    """P(w) of words with counts c; of an unknown one for 0."""
    return np.where(c > 0, facts["words"][np.minimum(c, K + 1)] * c / facts["over"], facts["unknown"])


def weights(count: np.ndarray, mass: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What c(h) counts as, and alpha(h), from the sums over the seen successors of h."""
    over = np.where(count - mass > 1e-9 * count, count, count + 1.0)
    return over, (1 - mass / over) / np.maximum(1 - lower, 1e-12)


class Bucket:
    """One bucket of bigrams, ready for questions."""

    def __init__(self, blob: bytes, counts: dict[int, np.ndarray], facts: dict, buckets: int):
        uh, nh, uw, iw, c = unpack(blob)
        order, parts = _dealt(_home(uw, buckets), buckets)
        cw = np.empty(len(uw), np.int64)
        for b, s, e in parts:
            cw[order[s:e]] = counts[b]
        c, of = c.astype(np.int64), np.repeat(np.arange(len(uh)), nh)
        mass, lower = facts["pairs"][np.minimum(c, K + 1)] * c, _unigram(cw, facts)[iw]
        sums = [np.bincount(of, x, len(uh)) for x in (c, mass, lower)]
        hot = np.flatnonzero(_among(facts["hot"], uh))
        which = np.searchsorted(facts["hot"], uh[hot])
        for x, y in zip(sums, facts["hot_sums"]):
            x[hot] = y[which]
        over, alpha = weights(*sums)
        self.h, self.alpha = uh, np.log10(np.maximum(alpha, 1e-300))
        key = _pair(uh[of], uw[iw])
        order = np.argsort(key)
        self.key, self.logp, self.count = key[order], np.log10(mass / over[of])[order], cw[iw][order]

    def ask(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which bigrams are seen, log P or log alpha, and the words' counts (where the bigram is seen)."""
        key = _pair(h, w)
        at = np.searchsorted(self.key, key).clip(0, len(self.key) - 1)
        seen = self.key[at] == key
        own = np.searchsorted(self.h, h).clip(0, len(self.h) - 1)
        return seen, np.where(seen, self.logp[at], np.where(self.h[own] == h, self.alpha[own], 0.0)), np.where(seen, self.count[at], 0)


def asked_of(bucket: Bucket | None, h: np.ndarray, w: np.ndarray, facts: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket.ask(), also for a bucket without bigrams; a hot history may have none of its successors in the bucket."""
    seen, log, count = bucket.ask(h, w) if bucket else (np.zeros(len(h), bool), np.zeros(len(h)), np.zeros(len(h), np.int64))
    hot = np.flatnonzero(~seen & _among(facts["hot"], h))
    which = np.searchsorted(facts["hot"], h[hot])
    log[hot] = np.where(facts["hot_sums"][0][which] > 0, np.log10(np.maximum(weights(*facts["hot_sums"])[1], 1e-300))[which], 0.0)
    return seen, log, count


class Sums:
    """Adds (tokens, known tokens, base, score) up by document, and gives them by the documents' home when there are many."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, uid: np.ndarray, *values: np.ndarray) -> None:
        u, i = np.unique(uid, return_inverse=True)
        self.held.append((u, *(np.bincount(i, v, len(u)) for v in values)))
        self.size += len(u)
        if self.size > SUMS:
            self._merge()

    def _merge(self) -> None:
        uid, *values = (np.concatenate(x) for x in zip(*self.held))
        u, i = np.unique(uid, return_inverse=True)
        self.held, self.size = [(u, *(np.bincount(i, v, len(u)) for v in values))], len(u)

    def full(self) -> bool:
        return self.size > SUMS // 2

    def rows(self) -> list[tuple]:
        if not self.size:
            return []
        self._merge()
        (uid, n, known, base, score), self.held, self.size = self.held[0], [], 0
        order, parts = _dealt(_home(uid.astype(np.uint64), self.buckets), self.buckets)
        return [(5, b, 0, pack(uid[o := order[s:e]], small(n[o].round().astype(np.int64)), small(known[o].round().astype(np.int64)), base[o], score[o])) for b, s, e in parts]


def _questions(docs: DataFrame, hot: np.ndarray, buckets: int, turn: int) -> DataFrame:
    """Kind 2: the bigrams of chunks of documents and who has each how often, for the buckets of a turn."""

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, h, doc, uid in _chunks(batches, False):
            bucket = _bucket(h, w, hot, buckets)
            own = bucket % TURNS == turn
            w, h, doc = w[own], h[own], doc[own]
            order, at = _alike(_pair(h, w))
            first = order[at]
            user, n = np.unique(np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order)))) * len(uid) + doc[order], return_counts=True)
            which, doc = user // len(uid), user % len(uid)
            users = np.bincount(which, minlength=len(first))
            begin = np.cumsum(users) - users
            by = np.argsort(h[first])
            order, parts = _dealt(bucket[own][first[by]], buckets)
            rows = []
            for b, s, e in parts:
                pair = by[order[s:e]]
                of, _ = segments.gather(np.arange(len(doc)), begin, users, pair)
                ids, i = np.unique(doc[of], return_inverse=True)
                rows.append((2, b, 0, pack(*_coded(h[first[pair]], w[first[pair]]), small(users[pair]), uid[ids], small(i), small(n[of]))))
            yield _rows(rows)

    return docs.mapInArrow(deal, _ROWS)


def _answers(rows: DataFrame, facts: dict, buckets: int) -> DataFrame:
    """Kind 5: documents' sums; kind 3: the words of unseen bigrams, by their homes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, ask, waiting = Sums(buckets), [], 0

        def unseen() -> list[tuple]:
            nonlocal ask, waiting
            if not ask:
                return []
            w, uid, n = (np.concatenate(x) for x in zip(*ask))
            order, parts = _dealt(_home(w, buckets), buckets)
            ask, waiting = [], 0
            return [(3, b, 0, pack(w[o := order[s:e]], uid[o], small(n[o]))) for b, s, e in parts]

        for key, group in groupby(_each(batches), lambda r: r[1]):
            model, counts, bucket = None, {}, None
            for kind, _, part, blob in group:
                if kind == 0:
                    model = blob
                elif kind == 1:
                    (counts[part],) = unpack(blob)
                else:
                    if model is not None and bucket is None:
                        bucket = Bucket(model, counts, facts, buckets)
                    uh, nh, uw, iw, users, ids, i, n = unpack(blob)
                    h, w = np.repeat(uh, nh), uw[iw]
                    seen, log, count = asked_of(bucket, h, w, facts)
                    pair = np.repeat(np.arange(len(h)), users)
                    uid, n = ids[i], n.astype(np.float64)
                    known = seen[pair]
                    sums.add(uid, n, n * known, n * np.where(seen, np.log10(count + 1.0), 0)[pair], n * log[pair])
                    if not known.all():
                        ask.append((w[pair[~known]], uid[~known], n[~known].astype(np.int64)))
                        waiting += len(ask[-1][0])
                    if sums.full() or waiting > CHUNK_TOKENS // 2:
                        yield _rows(sums.rows() + unseen())
        yield _rows(sums.rows() + unseen())

    return _sorted(rows).mapInArrow(run, _ROWS)


def _backed_off(rows: DataFrame, facts: dict | None, buckets: int) -> DataFrame:
    """Kind 5: what the words of unseen bigrams add to their documents; without facts, what any words add but for the score."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(buckets)
        for _, group in groupby(_each(batches), lambda r: r[1]):
            w, c = np.empty(0, np.uint64), np.empty(0, np.int64)
            for kind, key, part, blob in group:
                if kind == 0:
                    w, c = unpack(blob)
                    continue
                if kind == 5:
                    yield _rows([(kind, key, part, blob)])
                    continue
                if facts is None:
                    words, users, ids, i, n = unpack(blob)
                    asked, uid = np.repeat(words, users), ids[i]
                else:
                    asked, uid, n = unpack(blob)
                at = np.searchsorted(w, asked).clip(0, max(0, len(w) - 1))
                count = np.where(w[at] == asked, c[at], 0).astype(np.int64) if len(w) else np.zeros(len(asked), np.int64)
                n = n.astype(np.float64)
                # tokens with bigrams were counted where these were looked up
                sums.add(uid, np.zeros(len(n)) if facts else n, n * (count > 0), n * np.log10(count + 1.0), n * np.log10(_unigram(count, facts)) if facts else np.zeros(len(n)))
                if sums.full():
                    yield _rows(sums.rows())
        yield _rows(sums.rows())

    return _sorted(rows).mapInArrow(run, _ROWS)


def _asked_words(docs: DataFrame, often: np.ndarray, counts: np.ndarray, buckets: int) -> DataFrame:
    """Kind 3: the words of chunks of documents and who has each how often, by their homes; kind 5: the sums of the words ``often``."""

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(buckets)
        for w, _, doc, uid in _chunks(batches, False):
            order, at = _alike(w)
            words = w[order[at]]
            user, n = np.unique(np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order)))) * len(uid) + doc[order], return_counts=True)
            which, doc = user // len(uid), user % len(uid)
            known = _among(often, words)
            c, own = counts[np.searchsorted(often, words).clip(0, len(often) - 1)], known[which]
            of, m = c[which[own]], n[own].astype(np.float64)
            sums.add(uid[doc[own]], m, m * (of > 0), m * np.log10(of + 1.0), np.zeros(len(m)))
            users = np.bincount(which, minlength=len(words))
            begin = np.cumsum(users) - users
            asked = np.flatnonzero(~known)
            order, parts = _dealt(_home(words[asked], buckets), buckets)
            rows = []
            for b, s, e in parts:
                ask = asked[order[s:e]]
                at, _ = segments.gather(np.arange(len(doc)), begin, users, ask)
                ids, i = np.unique(doc[at], return_inverse=True)
                rows.append((3, b, 0, pack(words[ask], small(users[ask]), uid[ids], small(i), small(n[at]))))
            yield _rows(rows + (sums.rows() if sums.full() else []))
        yield _rows(sums.rows())

    return docs.mapInArrow(deal, _ROWS)


def _totals(parts: DataFrame) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_each(batches), lambda r: r[1]):
            held: list[tuple] = []
            for *_, blob in group:
                held.append(unpack(blob))
                if len(held) > 64:
                    held = [_added(held)]
            uid, n, known, base, score = _added(held)
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(n.round().astype(np.int64)), pa.array(known.round().astype(np.int64)), pa.array(base), pa.array(score)], ["uid", "n_tokens", "n_known", "base", "score"])

    return _sorted(parts).mapInArrow(run, "uid long, n_tokens long, n_known long, base double, score double")


def _added(held: list[tuple]) -> tuple:
    uid, *values = (np.concatenate(x) for x in zip(*held))
    u, i = np.unique(uid, return_inverse=True)
    return (u, *(np.bincount(i, v, len(u)) for v in values))


def _prepared(documents: DataFrame, heldout: int | None) -> tuple[DataFrame, int]:
    """The documents with uid and held_out, and a number of buckets for their tokens."""
    held = remainder(F.col("doc_id"), heldout) == 2 if heldout else F.lit(False)
    docs = documents.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", held.alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    return docs, max(16, ((size["bytes"] or 0) // 6 + size["rows"]) // BUCKET_TOKENS)


def _found(docs: DataFrame, sums: DataFrame, train: int, words: int) -> DataFrame:
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(train + words + 1)))
    return docs.select("uid", "doc_id", "held_out").join(sums, "uid").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def counted(documents: DataFrame, heldout: int | None = 7) -> DataFrame:
    """score() without its last column, which alone needs the bigrams: all documents' words are looked up in the unigrams.

    Words that make up over 1 / HOT of the training tokens, and the end token, are answered where they are asked.
    """
    spark = documents.sparkSession
    docs, buckets = _prepared(documents, heldout)
    asked = docs.select("uid", "text", "held_out")
    unigrams = stored(_unigrams(asked, buckets), f"{shared_dir(spark)}/unigrams")
    r = unigrams.agg(F.sum("items").alias("v"), F.sum("tokens").alias("n")).first()
    train, words = r["n"] or 0, r["v"] or 0
    # each training text has one end token
    often = (_frequent(unigrams, max(1, train / HOT)) if train else {}) | {END: docs.where(~F.col("held_out")).count()}
    release(spark)
    keys = np.array(sorted(often), np.uint64)
    ask = _asked_words(asked, keys, np.array([often[int(w)] for w in keys], np.int64), buckets)
    sums = _totals(_backed_off(unigrams.select("kind", "key", "part", "blob").unionAll(ask), None, buckets))
    return _found(docs, sums, train, words).drop("score")


def score(documents: DataFrame, heldout: int | None = 7, where: str | None = None, keep_model: bool = False) -> DataFrame:
    """Trains on the documents that aren't held out (crc32(doc_id) mod heldout is not 2) and scores all.

    With keep_model the tables unigrams and bigrams stay in where.
    """
    spark = documents.sparkSession
    where = where or shared_dir(spark)
    docs, buckets = _prepared(documents, heldout)
    asked = docs.select("uid", "text", "held_out")
    unigrams = stored(_unigrams(asked, buckets), f"{where}/unigrams")
    at = lambda k: F.coalesce(F.sum(F.get("tally", F.lit(k))), F.lit(0)).alias(f"n{k}")
    r = unigrams.agg(*map(at, range(K + 2)), F.sum("items").alias("v"), F.sum("tokens").alias("n")).first()
    train, tallies = r["n"] or 0, np.array([r[k] for k in range(K + 2)], float)
    frequent = _frequent(unigrams, max(1, train / HOT)) if train else {}
    hot = np.array(sorted({w for w in frequent if w != END} | {START}), np.uint64)
    release(spark)
    bigrams = stored(_bigrams(asked, hot, buckets), f"{where}/bigrams")
    release(spark)
    r2 = bigrams.agg(*map(at, range(K + 2))).first()
    d1 = discounts(tallies)
    kept = sum(d1[k] * k * tallies[k] for k in range(1, K + 1)) + train - sum(k * tallies[k] for k in range(1, K + 1))
    over = train if train - kept > 1e-9 * train else train + 1
    facts = {"hot": hot, "words": d1, "pairs": discounts(np.array([r2[k] for k in range(K + 2)], float)), "over": max(1, over), "unknown": 1 - kept / over if train else 1.0}
    lower = stored(_lower(unigrams, bigrams, facts, buckets), f"{where}/lower")
    release(spark)
    mass, under = np.zeros(len(hot)), np.zeros(len(hot))
    for row in lower.where("kind = 9").select("blob").toLocalIterator():
        x, y = unpack(row["blob"])
        mass, under = mass + x, under + y
    # each training text has one end token and one start
    ends = docs.where(~F.col("held_out")).count()
    facts["hot_sums"] = (np.array([ends if w == START else frequent[int(w)] for w in hot], float), mass, under)
    plain = lambda df: df.select("kind", "key", "part", "blob")
    parts: list[DataFrame] = []
    for turn in range(TURNS):
        own = F.col("key") % TURNS == turn
        rows = plain(bigrams).where(own).unionAll(plain(lower).where("kind = 1").where(own)).unionAll(_questions(asked, hot, buckets, turn))
        parts.append(stored(_answers(rows, facts, buckets), f"{where}/answers{turn}"))
        release(spark)
    answers = spark.read.schema(parts[0].schema).parquet(*[f"{where}/answers{turn}" for turn in range(TURNS)])
    if not keep_model:
        drop(spark, f"{where}/bigrams")
        drop(spark, f"{where}/lower")
    more = stored(_backed_off(plain(unigrams).unionAll(answers.where("kind = 3")), facts, buckets), f"{where}/backoff")
    release(spark)
    sums = _totals(answers.where("kind = 5").unionAll(more))
    return _found(docs, sums, train, r["v"] or 0)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, size="8m")
    return score(table(spark, sf_dir, "documents"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, size="8m")
    return counted(table(spark, sf_dir, "documents"))


def brute(docs: list[tuple[int, str | None]], heldout: int = 7) -> dict[int, tuple]:
    """The same by dictionaries and the recursive definition, for tests."""
    import math
    import zlib

    toks = {d: [*ascii_words(t), b"</s>"] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % heldout == 2 for d in toks}
    uni, bi = Counter(), Counter()
    for d, ws in toks.items():
        if not held[d]:
            uni.update(ws)
            bi.update(zip([b"<s>", *ws], ws))
    hist = Counter()
    for (h, _), n in bi.items():
        hist[h] += n
    N, V = sum(uni.values()), len(uni)
    tally = lambda c: np.array([0] + [sum(n == r for n in c.values()) for r in range(1, K + 2)], float)
    d1, d2 = discounts(tally(uni)), discounts(tally(bi))
    kept = sum(d1[min(n, K + 1)] * n for n in uni.values())
    over = N if N - kept > 1e-9 * N else N + 1
    unknown = 1 - kept / over if N else 1.0
    p1 = lambda w: d1[min(uni[w], K + 1)] * uni[w] / over if uni[w] else unknown
    follow: dict = {}
    for (h, w), n in bi.items():
        follow.setdefault(h, []).append((w, n))
    alpha, denominator = {}, {}
    for h, ws in follow.items():
        mass = sum(d2[min(n, K + 1)] * n for _, n in ws)
        denominator[h] = hist[h] if hist[h] - mass > 1e-9 * hist[h] else hist[h] + 1
        alpha[h] = (1 - mass / denominator[h]) / (1 - sum(p1(w) for w, _ in ws))

    def p(h, w):
        if bi[h, w]:
            return d2[min(bi[h, w], K + 1)] * bi[h, w] / denominator[h]
        return alpha[h] * p1(w) if h in alpha else p1(w)

    out = {}
    for d, ws in toks.items():
        base = sum(math.log10((uni[w] + 1) / (N + V + 1)) for w in ws)
        out[d] = (held[d], len(ws), sum(uni[w] > 0 for w in ws), N, base, sum(math.log10(p(h, w)) for h, w in zip([b"<s>", *ws], ws)))
    return out
