"""Near-duplicate documents: one-permutation hashing, optimal densification, banding, star edges.

A document's set holds its distinct n-word shingles (with fewer words, the whole sequence as
one; without words it is empty and linked with nothing). Documents are linked when
100 * |A n B| >= percent * |A u B|; the result is the components of those links.

1. Documents with equal sets form a class, represented by its smallest doc_id.
2. Each representative's shingle hashes are dealt to SLOTS bins, the smallest hash of a bin is
   its sketch value, and an empty bin borrows from a non-empty one along a fixed random order of
   its own. BANDS groups of ROWS slots are the buckets. At similarity 0.8 two texts share none
   of the 40 buckets with probability 1e-7.
3. In each bucket every member is paired with centres only (stars), so pairs grow with the
   members. The first centre is the member that meets the most others, which in a group of copies
   is the original. Pairs are confirmed on the full sets, confirmed links joined to components.
4. A bucket whose members are in one component is finished. In the others a second turn of stars
   follows, around the same centre and three more by a hash.
5. Whatever is open then is ended exactly. In buckets of up to SMALL members all untested pairs are
   confirmed. Larger ones are joined to groups by their members, and in a group every text is
   compared with each of another component: the texts are dealt to tiles, and a tile counts the
   shared shingles of all its pairs by products of matrices. So each pair of a bucket is either
   tested or in one component already. Rows grow with the members; the arithmetic grows with the square
   of a group whose texts are alike, but not enough.

Edge cases: null and empty text: n_shingles 0, a component of its own. Null doc_id: takes no part,
component_id null, kept false. Rows that share a doc_id are one document; a link of any of their
texts counts. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import segments
from cairn.llm.common import ascii_words, fresh, mapped, release, shared_dir, small_batches, stored, table
from cairn.llm.segments import mix

SLOTS, ROWS = 200, 5
BANDS = SLOTS // ROWS
#: Up to so many members all pairs of a bucket are rows; texts and shingles on one side of a tile, about.
SMALL, TEXTS, SHINGLES = 8, 2000, 2_000_000
_U = np.uint64


def shingle_sets(text: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    h, at = segments.words(text)
    acc = np.full(len(h), size, np.uint64)
    for k in range(size):
        # a shingle that would leave its text is not used below
        acc = mix(acc * _U(0x9E3779B97F4A7C15) + np.concatenate([h[k:], h[:k]]))
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= size:
            yield np.unique(acc[a : b - size + 1])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = mix(one * _U(0x9E3779B97F4A7C15) + h[k : k + 1])
            yield one
        else:
            yield np.empty(0, np.uint64)


_random = np.random.default_rng(20240607)
#: For each slot, the order in which it looks for a non-empty one; odd multipliers of the bands.
_ORDER = np.stack([_random.permutation(SLOTS) for _ in range(SLOTS)])
_MULTIPLY = _random.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * _U(2) + _U(1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of a sorted, non-empty set of hashes."""
    bins = ((hashes >> _U(32)) * _U(SLOTS)) >> _U(32)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    out, full = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, bool)
    at = bins[first].astype(np.int64)
    out[at], full[at] = hashes[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _ORDER[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(1)]]
    return out


def bucket_keys(hashes: np.ndarray) -> np.ndarray:
    s = sketch(hashes).reshape(BANDS, ROWS)
    return mix((mix(s) * _MULTIPLY).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    def start() -> Callable:
        import xxhash

        def each(batch: pa.RecordBatch) -> dict:
            n, key, keys = [], [], []
            for s in shingle_sets(batch.column("text"), size):
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(bucket_keys(s) if len(s) else None)
            return {"n_shingles": n, "key": key, "bands": keys}

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(rows, start, {"n_shingles": "long", "key": "binary", "bands": "array<long>"}, ["doc_id"])


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    def start() -> Callable:
        return lambda batch: {"shingles": [s.tobytes() for s in shingle_sets(batch.column("text"), size)]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    return mapped(rows.select(F.col("doc_id").alias("id"), "text"), start, {"shingles": "binary"}, ["id"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) whose full sets are similar enough."""

    def start() -> Callable:
        def each(batch: pa.RecordBatch) -> tuple[dict, list[bool]]:
            good = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = sorted((len(a), len(b)))
                if 100 * small < percent * large or not large:
                    good.append(False)
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            return {}, good

        return each

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    return mapped(both.select("a", "b", "sa", "sb"), start, {}, ["a", "b"])


def components(nodes: DataFrame, links: DataFrame, where: str) -> DataFrame:
    """(id, comp): the smallest id of each component; nodes has (id, comp) so far, links (a, b) ids.

    Labels travel along links and jump to their own label's label, so rounds grow with the
    logarithm of a component's diameter; all of it stays in tables.
    """
    c = lambda side: nodes.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}"))
    edges = links.join(c("a"), "a").join(c("b"), "b").where("ca <> cb").select("ca", "cb")
    edges = stored(edges.union(edges.select("cb", "ca")).distinct().toDF("u", "v"), f"{where}/edges")
    label = stored(edges.select("u").distinct().withColumn("l", F.col("u")), f"{where}/label")
    step = 0
    while True:
        near = edges.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("near"))
        new = label.join(near, "u").select("u", F.least("l", "near").alias("m"), "l")
        jump = label.select(F.col("u").alias("m"), F.col("l").alias("ml"))
        new = new.join(jump, "m", "left").select("u", F.coalesce(F.least("m", "ml"), "m").alias("l"), F.col("l").alias("old"))
        new = stored(new, f"{where}/label{step}")
        changed = not new.where("l <> old").isEmpty()
        label, step = new.select("u", "l"), step + 1
        if not changed:
            break
    out = nodes.join(label, F.col("comp") == F.col("u"), "left")
    return stored(out.select("id", F.coalesce("l", "comp").alias("comp")), f"{where}/comp")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of a shares with each of b: frequent ones by dense products, others by their postings."""
    na, nb = len(a), len(b)
    la, lb = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    token = np.unique(np.concatenate([*a, *b]), return_inverse=True)[1].reshape(-1)
    ta, tb = token[: la.sum()], token[la.sum() :]
    oa, ob = np.repeat(np.arange(na), la), np.repeat(np.arange(nb), lb)
    many = int(token.max()) + 1 if len(token) else 0
    ca, cb = np.bincount(ta, minlength=many), np.bincount(tb, minlength=many)
    out = np.zeros((na, nb), np.float32)
    dense = ca * cb * 100 > na * nb
    column = np.where(dense, np.cumsum(dense) - 1, -1)
    da, db = column[ta], column[tb]
    by_a, by_b = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    for first in range(0, int(dense.sum()), 1024):
        x, y = np.zeros((na, 1024), np.float32), np.zeros((nb, 1024), np.float32)
        for m, d, o, by in ((x, da, oa, by_a), (y, db, ob, by_b)):
            own = by[slice(*np.searchsorted(d, (first, first + 1024), sorter=by))]
            m[o[own], d[own] - first] = 1
        out += x @ y.T
    rare = np.flatnonzero(~dense[ta] & (cb[ta] > 0))
    posted, begin = ob[np.argsort(tb, kind="stable")], np.cumsum(cb) - cb
    n = cb[ta[rare]]
    ends, at = np.cumsum(n), 0
    while at < len(rare):
        # some four million postings at a time
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4_000_000, "right")))
        own, k = rare[at:to], n[at:to]
        where = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[ta[own]], k)
        np.add.at(out.reshape(-1), np.repeat(oa[own] * nb, k) + posted[where], np.float32(1))
        at = to
    return out


def _tile(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) that join all components of a tile which any of its pairs joins."""
    sides = [pdf[pdf["own"]], pdf[~pdf["own"]]]
    sets = [[np.frombuffer(x, np.uint64) for x in side["shingles"]] for side in sides]
    ids, out = [side["id"].to_numpy() for side in sides], []
    if len(sets[0]) and len(sets[1]):
        both = overlaps(*sets).astype(np.float64)
        size = [np.array([len(x) for x in side], np.float64) for side in sets]
        good = (both > 0) & (100 * both >= percent * (size[0][:, None] + size[1][None, :] - both))
        label = dict(zip(c := pd.unique(pdf["comp"]), c))

        def top(x):
            while label[x] != x:
                label[x] = x = label[label[x]]
            return x

        comp = [side["comp"].to_numpy() for side in sides]
        while True:
            now = [np.array([top(x) for x in side]) for side in comp]
            good &= now[0][:, None] != now[1][None, :]
            rows = np.flatnonzero(good.any(1))
            if not len(rows):
                break
            # one link a row and turn, if it still joins two
            for i, j in zip(rows, good[rows].argmax(1)):
                x, y = top(comp[0][i]), top(comp[1][j])
                if x != y:
                    label[max(x, y)] = min(x, y)
                    out.append((ids[0][i], ids[1][j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _exact_end(members: DataFrame, comp: DataFrame, tested: DataFrame, sets: DataFrame, percent: int, where: str) -> DataFrame:
    """comp after every pair of the members' buckets that is neither tested nor in one component was tested."""
    held = stored(members.join(comp, "id").select("bucket", "id", "comp"), f"{where}/held")
    size = held.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.min("id").alias("first")).where("lo < hi")
    size = stored(size.select("bucket", "size", "first"), f"{where}/open")
    small = stored(held.join(size.where(F.col("size") <= SMALL), "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("id", "comp"))).alias("m")), f"{where}/small")
    pairs = small.select("m", F.explode("m").alias("x")).select("x", F.explode("m").alias("y")).where("x.id < y.id AND x.comp <> y.comp")
    pairs = stored(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), f"{where}/pairs")
    found = stored(_confirmed(pairs, sets, percent), f"{where}/links")
    large = held.join(size.where(F.col("size") > SMALL).select("bucket", "first"), "bucket")
    links = stored(large.select(F.col("id").alias("a"), F.col("first").alias("b")), f"{where}/ties")
    if links.isEmpty():
        return comp if found.isEmpty() else components(comp, found, f"{where}/by_pairs")
    # groups of buckets first: a member ties the first member of each of its buckets to the smallest such one
    anchor = stored(links.groupBy("a").agg(F.min("b").alias("anchor"), F.collect_set("b").alias("all")), f"{where}/anchors")
    ties = stored(anchor.select(F.col("anchor").alias("a"), F.explode("all").alias("b")).distinct(), f"{where}/graph")
    tied = components(ties.select(F.col("b").alias("id")).distinct().withColumn("comp", F.col("id")), ties, f"{where}/groups")
    group = anchor.join(tied.toDF("anchor", "tied"), "anchor").select(F.col("a").alias("id"), "tied").join(comp, "id")
    size = sets.select("id", (F.length("shingles") / 8).alias("n"))
    group = stored(group.join(size.groupBy("id").agg(F.sum("n").alias("n"), F.count("*").alias("texts")), "id"), f"{where}/group")
    # the largest component of a group is compared with the others only
    parts = group.groupBy("tied", "comp").agg(F.sum("texts").alias("texts"), F.sum("n").alias("n"))
    parts = parts.groupBy("tied").agg(F.sum("texts").alias("texts"), F.sum("n").alias("n"), F.max(F.struct("texts", "n", "comp")).alias("main")).where("main.texts < texts")
    tiles = lambda texts, n: F.greatest(F.ceil(texts / TEXTS), F.ceil(n / SHINGLES), F.lit(1)).cast("int")
    parts = parts.select("tied", F.col("main.comp").alias("main"), tiles(F.col("texts") - F.col("main.texts"), F.col("n") - F.col("main.n")).alias("down"), tiles(F.col("texts"), F.col("n")).alias("across"))
    dealt = group.select("tied", "id", "comp").join(stored(parts, f"{where}/parts"), "tied").join(sets, "id").withColumn("hash", F.xxhash64("id", "shingles"))
    row, col = F.pmod("hash", F.col("down")).cast("int"), F.pmod("hash", F.col("across")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = dealt.where("comp <> main").select("tied", "id", "comp", "shingles", row.alias("i"), every("across").alias("j"), F.lit(True).alias("own"))
    other = dealt.select("tied", "id", "comp", "shingles", every("down").alias("i"), col.alias("j"), F.lit(False).alias("own"))
    links = own.unionByName(other).groupBy("tied", "i", "j").applyInPandas(lambda pdf: _tile(pdf, percent), "a long, b long")
    links = found.union(stored(links, f"{where}/tiles"))
    return comp if links.isEmpty() else components(comp, links, f"{where}/by_tiles")


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80, where: str | None = None) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    spark = documents.sparkSession
    small_batches(spark)
    where = where or shared_dir(spark)
    rows = stored(_sketched(documents, shingle), f"{where}/sketch")
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(some.groupBy("key").agg(F.min("doc_id").alias("rep")), f"{where}/classes")
    reps = some.join(classes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"]).select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    buckets = stored(reps.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("bucket", "size"), f"{where}/buckets")
    members = stored(reps.join(buckets, "bucket"), f"{where}/dealt").groupBy("bucket", "id").agg(F.max("size").alias("size"))
    # the original of a group of copies keeps most of the group's sketch values, so it meets the most members
    central = members.groupBy("id").agg(F.sum("size").alias("weight"))
    members = stored(members.join(central, "id").select("bucket", "id", "weight"), f"{where}/members")
    ids = stored(members.select("id").distinct(), f"{where}/ids")
    comp, turn = ids.withColumn("comp", F.col("id")), 0
    if not ids.isEmpty():
        release(spark)
        sets = stored(_sets(documents, ids, shingle), f"{where}/sets")
        release(spark)
        tested = None
        while True:
            at = f"{where}/turn{turn}"
            held = stored(members.join(comp, "id"), f"{at}/held")
            picks = [F.max_by(F.struct("id", "comp"), F.struct("weight", -F.col("id")))]
            if turn:
                picks += [F.min_by(F.struct("id", "comp"), F.xxhash64("id", F.lit(turn), F.lit(k))) for k in range(3)]
            stars = held.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("weight").alias("weight"), F.array_distinct(F.array(*picks)).alias("centres")).where("lo < hi")
            stars = stored(stars.select("bucket", "weight", F.explode("centres").alias("c")).select("bucket", F.col("weight").alias("most"), F.col("c.id").alias("centre"), F.col("c.comp").alias("centre_comp")), f"{at}/stars")
            open_ = held.join(stars, "bucket")
            pairs = open_.where("comp <> centre_comp").select(F.col("id").alias("a"), F.col("centre").alias("b"), "most")
            # at first one pair for each member: most copies find their component by it
            pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("most", -F.col("b"))).alias("b")) if not turn else pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
            pairs = stored(pairs, f"{at}/pairs")
            none = pairs.isEmpty()
            if not none:
                links = stored(_confirmed(pairs, sets, percent), f"{at}/links")
                if not links.isEmpty():
                    comp = components(comp, links, at)
                pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                tested = pairs if tested is None else tested.union(pairs)
            if none or turn:
                break
            turn += 1
        if not none or turn:
            release(spark)
            comp = _exact_end(members, comp, tested, sets, percent, f"{where}/end")
    release(spark)
    named = classes.join(comp, F.col("rep") == F.col("id"), "left").select("key", F.coalesce("comp", "rep").alias("comp"))
    out = rows.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(False)).alias("kept"))


def keep_one(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """documents without the near-duplicates of another; of repeated rows with one doc_id the one whose text sorts first.

    (Null sorts first; rows that agree in doc_id and text are told apart by their other columns' hash.) Rows with a
    null doc_id can't be told apart and all stay.
    """
    ids, rows, one = fresh(documents, "__kept_id", "__kept_rows", "__kept")
    found = near_duplicates(documents, shingle, percent)
    kept = found.where("kept").groupBy(F.col("doc_id").alias(ids)).agg(F.count("*").alias(rows))
    kept = stored(kept, f"{shared_dir(documents.sparkSession)}/kept")
    columns = documents.columns
    # the ids kept grow with the documents, so they are never broadcast, whatever their size
    named = documents.where("doc_id IS NOT NULL").join(kept.hint("merge"), F.col("doc_id") == F.col(ids))
    once = named.where(F.col(rows) == 1).select(*columns)
    plain = [f.name for f in documents.schema if not isinstance(f.dataType, T.MapType)]
    first = F.min_by(F.struct(*columns), F.struct("text", F.xxhash64(*plain)))
    several = named.where(F.col(rows) > 1).groupBy("doc_id").agg(first.alias(one)).select(f"{one}.*")
    return once.unionByName(several).unionByName(documents.where("doc_id IS NULL"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def brute(docs: list[tuple[int, str | None]], size: int, percent: int = 80) -> list[tuple]:
    """The same by all pairs that share a shingle, for tests."""
    from collections import defaultdict

    sets, by = {}, defaultdict(list)
    for d, t in docs:
        w = ascii_words(t)
        sets[d] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        shared = defaultdict(int)
        for s in sets[d]:
            for e in by[s]:
                shared[e] += 1
            by[s].append(d)
        for e, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((top(d), top(e)))
                parent[b] = a
    return [(d, len(sets[d]), top(d), top(d) == d) for d, _ in docs]
